"""Chat logs, archives and urls."""

import os
import hashlib
import math
import pytest
from collections import Counter

from flowspark.llm import chat, url_filter, warc
from pyspark.sql import functions as F


def _turns(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, seq string")


def test_chat_round_trip_with_control_strings(spark):
    odd = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nno", "\\<|\\\\", "<<SYS>> <</SYS>> <s>", None, "", "é\U0001F642<", "\\"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)]
    rows += [(2, 0, "a\nb<|im_end|>", "x"), (2, 0, None, "y"), (None, 3, "assistant", "z"), (3, None, "assistant", "q"), (3, 1, "assistant", "r"),
             (4, 0, "user", "same"), (4, 0, "user", "same")]
    got = {r["conv_id"]: r for r in chat.format_log(_turns(spark, rows)).collect()}
    order = lambda v: (v is not None, v)
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (order(r[0]), r[1] or "", r[2] or ""))
        turns = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in mine)
        loss = "".join(text or "" for _, role, text in mine if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), hashlib.sha256(turns.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r["conv_id"]: r["formatted"] for r in chat.conversations(_turns(spark, rows)).collect()}
    assert len(whole[1]) == got[1]["formatted_chars"]
    assert [t for _, t, _, _ in chat.parse(whole[1])] == [t or "" for t in odd]
    assert chat.format_log(_turns(spark, [])).count() == 0


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [(1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "wro"), (1, 4, 1, "delta", None, "ng"),
           (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "ri"), (1, 7, 1, "delta", None, "ght"), (1, 8, 0, "edit", None, "hello"),
           (1, 9, 1, "delta", None, None), (2, 1, 0, "delta", "user", "only"), (2, 2, 0, "delta", None, " deltas")]
    events = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = sorted(map(tuple, chat.fold_events(events).collect()))
    assert got == [(1, 0, "user", "hello"), (1, 1, "assistant", "right"), (2, 0, "user", "only deltas")]


def test_warc_round_trip(spark):
    big = "<p>é\r\n\r\n\n" * 400
    rows = [(1, "http://a/", big), (5, "http://b/\r\nx y", big), (3, None, big), (4, "u", None), (6, "u", ""), (7, "u", "short\r\n"),
            (8, "u", "short\r\n"), (None, "u", big), (9, "u", "WARC/1.0\r\n\r\n" * 200), (5, "again", big), (10, "u", "x" * 999), (11, "u", "x" * 999)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    for chunk in (1 << 16, 7):
        got = sorted(map(tuple, warc.round_trip(pages, chunk=chunk).collect()), key=str)
        want = []
        for page, _, html in rows:
            data = (html or "").encode()
            other = 5 if html == big and page != 5 else None
            want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", other))
        assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chunks_hold_the_payload_and_running_digests(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abcdefghij")], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"), chunk=4)
    rows = sorted(warc.read_warc(spark, str(tmp_path / "w")).collect(), key=lambda r: r["chunk"])
    assert [(r["data"], r["bytes_so_far"], r["last"]) for r in rows] == [("abcd", 4, False), ("efgh", 8, False), ("ij", 10, True)]
    assert rows[1]["digest_so_far"] == hashlib.sha1(b"abcdefgh").hexdigest()


def _probability(counts, text, context):
    """Witten-Bell interpolation, by the definition."""
    p = 1 / url_filter.ALPHABET
    for k in range(len(context) + 1):
        after = counts[context[len(context) - k:]]
        if after:
            n, kinds = sum(after.values()), len(after)
            p = (after[text] + kinds * p) / (n + kinds)
    return p


def test_url_scores_against_the_definition(spark):
    urls = [f"http://a.org/en/{i}" for i in range(20)] + [f"http://x.com/de/{i * 7}?q" for i in range(20)]
    urls += ["http://new.net/en/5", "ftp://q.net/de/9#x", None, "nothing", "HTTP://EXAMPLE.ORG", "http://m.Example.org/en/12", "http://m.example.org/es/?", "http://new.net/en/5"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, line string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert len(rows) == len(urls)
    assert (rows[44]["host"], rows[44]["path"], rows[44]["rule"]) == ("example.org", "", None)
    assert (rows[45]["rule"], rows[45]["verdict"]) == ("example.org/en/1", "block")
    assert (rows[46]["rule"], rows[0]["rule"], rows[20]["rule"]) == ("example.org/es/", "org/", "com/de/")
    assert rows[42]["score"] == rows[43]["score"] == 0.0 and rows[42]["host"] == ""
    models = {c: {} for c in ("allow", "block")}
    crc = dict(map(tuple, pages.select("page_id", F.crc32(F.lit("")).alias("c")).collect()))
    assert crc[0] == 0
    import zlib

    for c, counts in models.items():
        counts.update({})
        for r in rows.values():
            line = r["host"] + r["path"]
            if r["rule"] is None or r["verdict"] != c or zlib.crc32(line.encode()) % 5 == 0:
                continue
            padded = "\x02" * url_filter.ORDER + line
            for at in range(url_filter.ORDER, len(padded)):
                for k in range(url_filter.ORDER + 1):
                    counts.setdefault(padded[at - k:at], Counter())[padded[at]] += 1
    for page in (40, 41, 44, 47):
        line = rows[page]["host"] + rows[page]["path"]
        padded = "\x02" * url_filter.ORDER + line
        total = 0
        for at in range(url_filter.ORDER, len(padded)):
            context = padded[at - url_filter.ORDER:at]
            a, b = (_probability({context[len(context) - k:]: m.get(context[len(context) - k:], Counter()) for k in range(len(context) + 1)},
                                 padded[at], context) for m in (models["allow"], models["block"]))
            total += math.log(a) - math.log(b)
        assert abs(rows[page]["score"] - total / len(line)) < 1e-9
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages.where("page_id in (40, 42)")).collect()} == {"allow"}


def test_a_very_long_turn_is_read_back_without_much_memory(spark):
    import resource
    text = "plain words and <| a mark, a \\ backslash\n" * 500_000
    rendered = chat.render(_turns(spark, [(1, 0, "user", text)])).first()["formatted"]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ((role, got, _, _),) = chat.parse(rendered)
    assert (role, got) == ("user", text)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # kB, for 20 million characters


def test_archives_that_stop_between_two_segments_are_refused(spark, tmp_path):
    import glob
    import gzip
    pages = spark.createDataFrame([(1, "http://a/", "0123456789ab")], "page_id long, url string, html string")
    warc.write_warc(pages.coalesce(1), str(tmp_path / "w"), chunk=4)
    (name,) = [f for f in glob.glob(str(tmp_path / "w" / "*.gz")) if gzip.open(f).read()]
    whole = gzip.open(name).read()
    third = whole.rindex(b"WARC/1.0\r\n")
    with gzip.open(name, "wb") as file:
        file.write(whole[:third])
    for crc in glob.glob(str(tmp_path / "w" / ".*.crc")):
        os.remove(crc)
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_warc(spark, str(tmp_path / "w")).collect()
    # two whole records after one another, the first one cut short
    reader = warc._Reader([], True)
    with pytest.raises(ValueError, match="before its last segment"):
        reader.feed(whole[:third] + whole)
