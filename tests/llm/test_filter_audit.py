"""The audit of filter orders against counting every order by hand."""

import itertools
import random
import re

from flowspark.llm import filter_audit

_WORD = re.compile("[^\x20\x09-\x0D]+")


def _by_hand(docs, labels):
    """{(part, order, step): counts} by running all orders over the documents."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = _WORD.findall(text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs):
            fails.add("E")
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in mine)
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def _run(spark, docs, labels):
    table = spark.createDataFrame([(i, t, lang, 1, "x") for i, t, lang in docs], "doc_id long, text string, lang string, mask int, part string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(table, said).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_every_order_of_mixed_documents(spark):
    rng = random.Random(5)
    docs = []
    for i in range(80):
        size = rng.choice([0, 1, 5, 198, 199, 200, 201, 260])
        pool = rng.choice([3, 99, 100, 101, 400])
        words = [f"w{rng.randrange(pool)}" if rng.random() < 0.98 else rng.choice(["ABC", "#", "A|b", "É"]) for _ in range(size)]
        docs.append((i, rng.choice([" ", "\n", "\x0b", "  "]).join(words), rng.choice(["en", "de", None])))
    docs += [(100, "same", "en"), (101, "same", "de"), (101, "same", "de"), (102, "same", None), (None, "same", "en"), (None, "same", "en"),
             (103, None, "de"), (104, "", "fr"), (99, "SAME # text", "en"), (98, "SAME # text", "xx")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 110, 3)] + [(99, 1, None), (99, 0, 1), (None, 1, 1), (5000, 1, 1)]
    assert _run(spark, docs, labels) == _by_hand(docs, labels)


def test_a_very_long_text_and_no_rows(spark):
    docs = [(1, "word other " * 1_000_000, "en")]
    assert _run(spark, docs, [(1, 1, 0)]) == _by_hand(docs, [(1, 1, 0)])
    assert _run(spark, [], []) == {}


def test_gray_code_walk_stores_the_survivors_of_every_subset():
    rng = random.Random(9)
    for size in (1, 3, 5, 6):
        cells = [(m, (rng.randrange(9), rng.randrange(5), rng.randrange(5))) for m in range(1 << size) if rng.random() < 0.7]
        states = filter_audit.subset_states(cells, size)
        for chosen in range(1 << size):
            assert list(states[chosen]) == [sum(c[k] for m, c in cells if not m & chosen) for k in range(3)]
