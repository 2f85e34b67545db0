"""Operators on texts against plain Python."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from flowspark.llm import bpe, decontaminate, language_id, license_scan, line_dedup
from flowspark.llm.queries import tokenizer_file
from pyspark.sql import functions as F

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return _WORD.findall((text or "").translate(_FOLD))


def test_line_dedup_deletes_later_copies_of_runs(spark, docs):
    long = "a line that is longer than fifty characters in all, as it must be"
    rows = [(1, "a\nb\nc"), (2, "x\na\nb\nc\ny"), (3, "b\nc"), (4, long), (5, f"{long}\nz"), (6, "a"), (7, None), (8, ""),
            (9, "q\nq\nq\nq"), (None, "n1\nn2"), (10, "n1\nn2\nn3"), (11, "k\nl"), (11, "k\nl"), (12, "\n\n")]
    got = {(r["doc_id"], r["text"], r["n_deleted"]) for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == {(1, "a\nb\nc", 0), (2, "x\ny", 3), (3, "", 2), (4, long, 0), (5, "z", 1), (6, "a", 0), (7, None, 0), (8, "", 0),
                   (9, "q", 3), (None, "n1\nn2", 0), (10, "n3", 2), (11, "k\nl", 0), (12, "", 2)}


def _line_dedup_by_hand(rows, min_lines, min_chars):
    lines = [(d, i, line) for d, (_, t) in enumerate(rows) for i, line in enumerate(t.split("\n"))]
    by_doc = [[line for dd, _, line in lines if dd == d] for d in range(len(rows))]
    gone, seen = set(), set()
    for d, doc in enumerate(by_doc):
        for i in range(len(doc)):
            for size in {min_lines} | {1}:
                block = tuple(doc[i:i + size])
                if len(block) < size or (size < min_lines and len(doc[i]) < min_chars):
                    continue
                if (size, block) in seen:
                    gone.update((d, i + k) for k in range(size))
                seen.add((size, block))
    return ["\n".join(line for i, line in enumerate(doc) if (d, i) not in gone) for d, doc in enumerate(by_doc)]


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_dedup_against_every_block(spark, docs, min_lines):
    import random

    rng = random.Random(min_lines)
    rows = [(d, "\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))) for d in range(30)]
    want = _line_dedup_by_hand(rows, min_lines, 50)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(rows), min_lines=min_lines).collect()}
    assert [got[d] for d, _ in rows] == want


def test_line_dedup_of_an_empty_table(spark, docs):
    assert line_dedup.dedup_lines(docs([])).count() == 0
    assert line_dedup.dedup_lines(docs([(1, None)])).first()["n_deleted"] == 0


def _contamination_by_hand(text, items):
    words, hit, found = _words(text), set(), set()
    for name, item in items:
        item = _words(item)
        span = min(10, len(item))
        for i, j in itertools.product(range(len(item) - span + 1), range(len(words) - span + 1)):
            if span and item[i:i + span] == words[j:j + span]:
                hit.update(range(j, j + span))
                found.add(str(name))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_against_every_window(spark, docs):
    passage = "The quick brown fox jumps over the lazy dog and runs far away from here"
    items = [(1, passage), (10, "short phrase here"), (2, None), (None, "alpha beta gamma"), (2, ""), (3, passage + " again"),
             (4, "the the the the the the the the the the the")]
    texts = [passage, passage.upper() + "!", "x " + passage[20:] + " y", None, "", "a short, PHRASE here", "alpha beta gamma",
             "the " * 30, "the quick brown fox jumps over the lazy cat and runs", passage, "é" + passage]
    rows = list(enumerate(texts)) + [(0, passage), (None, passage)]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, term string")
    want = sorted([(i, *_contamination_by_hand(t, [x for x in items if x[0] is not None])) for i, t in rows], key=str)
    for settings in ({}, {"block_words": 5}, {"anchors": 3}):
        got = decontaminate.contamination(docs(rows), bench, **settings).drop("n_near")
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert decontaminate.contamination(docs(rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs([]), bench).count() == 0
    clean = decontaminate.remove_contaminated(docs(rows), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, *_, bad in want if not bad)


def test_near_windows_are_told(spark, docs):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("nine", "other")), (2, item), (3, "nothing of it"), (4, "nine nine nine nine")]
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in decontaminate.contamination(docs(rows), bench).collect()}
    assert got == {1: (0, 1), 2: (10, 1), 3: (0, 0), 4: (0, 0)}


def test_near_windows_are_all_found(spark, docs):
    import random

    rng = random.Random(8)
    item = [f"w{i}" for i in range(14)]
    texts = []
    for size in (4, 6, 10, 14):
        for _ in range(25):
            words = item[:size]
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(size)] = "other"
            texts.append(" ".join(["x"] * rng.randrange(3) + words))
    texts += [" ".join(item[1:])] * 2 + ["w9 w8 other w7"] * 5
    items = [(k, " ".join(item[:k])) for k in (1, 4, 6, 10, 14)]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def near(text, item):
        text, item = text.split(), item.split()
        span = min(10, len(item))
        starts = itertools.product(range(len(text) - span + 1), range(len(item) - span + 1))
        return any(10 * sum(text[i + k] == item[j + k] for k in range(span)) >= 8 * span for i, j in starts)

    rows = list(enumerate(texts))
    want = {i: sum(near(t, item) for _, item in items) for i, t in rows}
    got = {r["doc_id"]: r["n_near"] for r in decontaminate.contamination(docs(rows), bench).collect()}
    assert got == want
    spans = decontaminate.phrase_matches(docs([(1, "x x " + " ".join(["other", *item[1:10]]))]), bench.where("item_id = 10"))
    assert [r["near_edges"] for r in spans.collect()] == [[2, 12]]


def test_bpe_fills_gaps_without_copying_the_dictionary():
    class Flat(np.ndarray):
        """Ids that may be read at places but not as a whole."""

        def __array_function__(self, *args):
            raise AssertionError("the dictionary was copied")

    table = pa.table({"word": ["aa", "b"], "n": [9, 5], "ids": pa.array([np.array(i, "<u2").tobytes() for i in ([1, 2, 3], [4])], pa.binary())})
    head = bpe.Head(table, "<u2")
    head.flat = head.flat.view(Flat)
    fill = [b"...." + np.array(i, "<u2").tobytes() for i in ([7, 8, 9, 10, 11, 12], [13])]
    for codes, ids in (([2, 4, 2], [1, 2, 3, 4, 1, 2, 3]), ([0, 4, 0, 2 * 60 + 1], [7, 8, 9, 10, 11, 12, 4, 13, 60]), ([], [])):
        got = bpe._ids(np.array(codes, dtype="<u4"), head, fill[:codes.count(0)], "<u2")
        assert np.frombuffer(got, "<u2").tolist() == ids
    none = bpe.Head(table.slice(0, 0), "<u2")
    assert np.frombuffer(bpe._ids(np.array([0, 0, 9], dtype="<u4"), none, fill, "<u2"), "<u2").tolist() == [7, 8, 9, 10, 11, 12, 13, 4]


def test_bpe_equals_the_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_file()
    library = tokenizers.Tokenizer.from_file(path)
    texts = ["Σίσυφος ΑΣ <|endoftext|>x<|STARTOFTEXT|> don't é​ ²³ 12½ İ  ẛ̣ 你好 🙂🙂 'S ''s", None, "", "<|startoftext|>",
             "it's we'll they've I'm he'd you're can't 'twas ''s !'s 's's 'll 'lx 'r", "éÀ ÿŒ'é'S\t12a3\r\nb", "a" * 3000,
             "'", "x'", "''", "'s", "it's", "-- ... ,,'t", "  a \x0b b \x85 c ", "word " * 500]
    rows = list(enumerate(texts)) + [(1, "it's"), (None, "it's")]

    def by_library(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))

    want = sorted(((i, *by_library(t)) for i, t in rows), key=str)
    for head in (1000, 5, 0):
        assert sorted(map(tuple, bpe.digests(docs(rows), path, head).collect()), key=str) == want
    texts_back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs(rows[:3]), path), path).collect()}
    assert texts_back[2] == ""
    assert bpe.digests(docs([]), path).count() == 0


def test_plain_splitter_equals_the_tokenizers_own():
    import pyarrow as pa

    cut = bpe.splitter(tokenizer_file())
    alphabet = ["'", "s", "l", "v", "e", "É", "1", " ", "-", "\n", "T"]
    texts = ["".join(t) for n in range(1, 6) for t in itertools.islice(itertools.product(alphabet, repeat=n), 0, None, 1 + n * n)]
    parts = cut.split(pa.array(texts))
    words = parts.strings(pa.array(range(len(parts.starts))).to_numpy()).to_pylist()
    for k, text in enumerate(texts):
        assert words[parts.first[k]:parts.first[k + 1]] == cut.words(text)


def test_license_scan_places_and_labels(spark, docs):
    rows = [(1, "This work is licensed under the GNU General Public License, version 3."), (2, "CC BY, cc-by-NC 4.0"),
            (3, "General Public License"), (4, None), (5, ""), (6, "Under the MIT license. All rights reserved, all rights RESERVED"),
            (7, "license rights by general"), (7, "license rights by general"), (None, "mit license")]
    got = sorted(map(tuple, license_scan.scan(docs(rows)).collect()), key=str)
    want = sorted([
        (1, 12, 1, 7, 7, "gpl", "gpl,gpl-3.0", 1.0), (2, 7, 2, 0, 2, "cc-by", "cc-by", 1.0), (3, 3, 1, 0, 0, "gpl", "gpl", 1.0),
        (4, 0, 0, None, None, "", "", 0.0), (5, 0, 0, None, None, "", "", 0.0),
        (6, 10, 2, 4, 7, "reserved", "mit,reserved", 1.0), (7, 4, 0, None, None, "", "", 0.0),
        (7, 4, 0, None, None, "", "", 0.0), (None, 2, 0, None, None, "", "", 0.4)], key=str)
    assert got == want
    assert license_scan.scan(docs([])).count() == 0


def test_license_notices_in_usual_wordings(spark, docs):
    mit = ("MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction")
    gpl = ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
           "the License, or (at your option) any later version.")
    texts = {mit: "mit", mit.split("\n\n")[1]: "mit", gpl: "gpl,gpl-3.0",
             "Licensed under the GNU General Public License version 3": "gpl,gpl-3.0", "Apache License, Version 2.0": "apache-2.0",
             "CC BY-NC 4.0": "cc-by,cc-by-nc", "CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa", "Mozilla Public License Version 1.1": "",
             gpl.replace("version 3", "version 2"): "gpl", "the summit license": ""}
    got = {r["doc_id"]: r["labels"] for r in license_scan.notices(docs(enumerate(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_languages_are_told_on_held_out_rows(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    rows = [(i, "the and of that with for " * 5 + str(i), "en") for i in range(20)]
    rows += [(100 + i, "der und die das nicht mit " * 5 + str(i), "de") for i in range(20)]
    rows += [(200, None, "en"), (201, "", None), (202, "12 34 --", "en"), (None, "und der die", None), (203, "é", "de"), (1, rows[1][1], "en")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, cells string")
    got = [(r["doc_id"], r["lang_pred"], r["held_out"]) for r in language_id.identify(table).collect()]
    assert len(got) == len(rows)
    assert {(i, p) for i, p, _ in got if i in (200, 201, 202)} == {(i, "und") for i in (200, 201, 202)}
    assert (None, "de", False) in got and all(p == "en" for i, p, _ in got if i is not None and i < 20)
    kept = language_id.keep_identified(table)
    assert kept.columns == table.columns and kept.where("doc_id in (200, 201, 202)").count() == 0
    bare = table.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(bare).collect()} == {"und"}
    assert language_id.identify(table.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["__gone", "__doc", "__id", "__text", "__repeated", "__hit_text", "doc", "gone", "part"])
def test_columns_of_any_name_pass_through(spark, name):
    from flowspark.llm import ngram_join

    item = "one two three four five six seven eight nine ten"
    rows = [(1, "a\nb\nc", 7), (2, "x\na\nb\nc", 8), (3, item, 9), (4, item + " eleven", 10), (5, item + " eleven", 11)]
    table = spark.createDataFrame(rows, f"doc_id long, text string, `{name}` long")
    lines = {(r["doc_id"], r["text"], r[name]) for r in line_dedup.dedup_lines(table).collect()}
    assert (2, "x", 8) in lines and (1, "a\nb\nc", 7) in lines
    kept = ngram_join.keep_one_of_each_group(table, words=5, percent=80)
    assert kept.columns == table.columns and {r[name] for r in kept.collect()} == {7, 8, 9}
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = decontaminate.remove_contaminated(table, bench)
    assert clean.columns == table.columns and {r[name] for r in clean.collect()} == {7, 8}
