"""Benchmark decontamination with a positional inverted index of the training texts.

Test items are cut into windows of consecutive words. For every window the rarest words by their
count in all training texts are its anchors. The index stores (word, text, position) for anchors
only; lists are moved by the anchor's place in its item and intersected: places of one text that
agree on the move (a diagonal) gather the anchors that stand right. A diagonal with enough anchors
is then read word by word in the text itself, which gives the exact phrase matches and the
proximity matches.

For exact matches ANCHORS words of a window are enough, and all must stand in place. A near window may
differ in some of its words, so for proximity more anchors are stored than words may differ, and a
diagonal is read once the rest of them stands in place; no near window is missed. Words are compared in
place: an inserted word cuts a window in two parts on two diagonals, and each counts by itself.

Defined cases: a null or empty text has no words and is never hit; rows with the same text, and
repeated rows, get the same result each; repeated items count once per item_id, items with equal
ids but other texts count as one item with all their windows; a null item_id is no item. Columns
beside the named ones are ignored. Empty tables give no hits or no rows.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowspark.llm.keys import columns_of, free_names, text_key
from flowspark.llm.words import NOT_ALNUM, slices, words_of
from flowspark.session import materialise, release

WIDTH = 10
ANCHORS = 2
#: A window is near when this many of its words in ten stand in place.
NEAR = 0.8
#: Items are worked on in blocks with at most this many words, the size of what is sent to each task.
BLOCK_WORDS = 500_000
_MATCHES = "text_id binary, edges array<long>, exact array<string>, near array<string>, near_edges array<long>"


def _item_blocks(items, block_words):
    """Lists of (item_id, word hashes), each with a bounded number of words.

    Items arrive one by one; a list never holds more than a block. An item longer than a block is a
    block of its own.
    """
    rows = items.where("item_id is not null").distinct().orderBy("item_id", "text").toLocalIterator()
    block, size = [], 0
    for row in rows:
        hashes, _ = words_of(pa.array([row["text"]], pa.string()), NOT_ALNUM)
        if not len(hashes):
            continue
        if block and size + len(hashes) > block_words:
            yield block
            block, size = [], 0
        block.append((str(row["item_id"]), hashes))
        size += len(hashes)
    if block:
        yield block


def _term_counts(docs, vocabulary):
    """How often each word of a sorted array of hashes stands in all training texts."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        terms = sent.value
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in slices(batches):
            hashes, _ = words_of(batch.column(0), NOT_ALNUM)
            at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
            total += np.bincount(at[terms[at] == hashes], minlength=len(terms))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary), dtype=np.int64)
    for row in rows.toLocalIterator():
        out[row["term"]] = row["n"]
    return out


def _anchor_rule(n_words, width, anchors, near, proximity):
    """(anchors stored for each window, anchors that must stand in place) of an item with so many words."""
    span = min(width, n_words)
    may_differ = math.floor(span * (1 - near) + 1e-9) if proximity else 0
    stored = min(span, max(anchors, may_differ + 1))
    return stored, max(1, stored - may_differ)


def _anchor_places(items, vocabulary, counts, width, rule):
    """Rows (term, item index, place in the item) for the rarest words of every window."""
    places = set()
    for index, (_, hashes) in enumerate(items):
        rarity = counts[np.searchsorted(vocabulary, hashes)]
        order = np.lexsort((np.arange(len(hashes)), rarity))
        rank = np.empty(len(hashes), dtype=np.int64)
        rank[order] = np.arange(len(hashes))
        last = max(1, len(hashes) - width + 1)
        spans = np.lib.stride_tricks.sliding_window_view(rank, min(width, len(hashes)))[:last]
        best = np.argsort(spans, axis=1)[:, :rule(len(hashes))[0]] + np.arange(len(spans))[:, None]
        places.update((index, int(p)) for p in np.unique(best))
    return [(int(np.searchsorted(vocabulary, items[i][1][p])), i, p) for i, p in sorted(places)]


def build_index(docs, vocabulary, wanted):
    """The stored postings (term, text_id, pos) of the wanted words, once per different text."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary[wanted], wanted))

    def find(batches):
        terms, names = sent.value
        for batch in slices(batches):
            hashes, first = words_of(batch.column(1), NOT_ALNUM)
            at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
            hit = np.flatnonzero(terms[at] == hashes)
            text = np.searchsorted(first, hit, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[at[hit]]), batch.column(0).take(pa.array(text)), pa.array(hit - first[text])],
                names=["term", "text_id", "pos"])

    keyed = docs.select(text_key(F.col("text")).alias("text_id"), "text").where("text is not null")
    return keyed.mapInArrow(find, "term long, text_id binary, pos long")


def _diagonals(spark, index, places, items, rule):
    """(text_id, item index, move) where enough anchors of the item stand in place."""
    known = spark.createDataFrame(places, "term long, item int, place long")
    needed = [(i, rule(len(h))[1]) for i, (_, h) in enumerate(items)]
    needed = spark.createDataFrame(needed, "item int, needed int")
    # both small tables are bounded by the words of a block of items
    moved = index.join(F.broadcast(known), "term").select("text_id", "item", (F.col("pos") - F.col("place")).alias("move"), "place")
    found = moved.groupBy("text_id", "item", "move").agg(F.count_distinct("place").alias("n"))
    return found.join(F.broadcast(needed), "item").where("n >= needed").select("text_id", "item", "move")


def _match(hashes, candidates, items, width, near):
    """(covered words as booleans, exact items, near items, words in near windows as booleans) of one text."""
    covered, touched = np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=bool)
    exact, close = set(), set()
    for item, move in candidates:
        name, words = items[item]
        low, high = max(0, -move), min(len(words), len(hashes) - move)
        span = min(width, len(words))
        if high - low < span:
            continue
        same = hashes[low + move:high + move] == words[low:high]
        sums = np.concatenate(([0], np.cumsum(same)))
        per_window = sums[span:] - sums[:-span]
        for start in np.flatnonzero(per_window >= near * span - 1e-9):
            close.add(name)
            touched[low + move + start:low + move + start + span] = True
        for start in np.flatnonzero(per_window == span):
            exact.add(name)
            covered[low + move + start:low + move + start + span] = True
    return covered, exact, close, touched


def _edges(covered):
    return np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0])))).tolist()


def _judge(docs, found, items, width, near):
    """(text_id, spans, exact, near, near spans) of every text that has diagonals, by reading its words."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    texts = docs.select(text_key(F.col("text")).alias("text_id"), "text").where("text is not null")
    moves = found.groupBy("text_id").agg(F.collect_list(F.struct("item", "move")).alias("moves"))
    texts = texts.join(moves, "text_id").select("text_id", "text", "moves")

    def read(batches):
        known, kinds = sent.value, [pa.list_(kind) for kind in (pa.int64(), pa.string(), pa.string(), pa.int64())]
        for batch in slices(batches, 64):
            hashes, first = words_of(batch.column(1), NOT_ALNUM)
            rows = []
            for k, moves in enumerate(batch.column(2).to_pylist()):
                mine = hashes[first[k]:first[k + 1]]
                covered, exact, close, touched = _match(mine, [(m["item"], m["move"]) for m in moves], known, width, near)
                rows.append((_edges(covered), sorted(exact), sorted(close), _edges(touched)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))],
                names=["text_id", "edges", "exact", "near", "near_edges"])

    return texts.mapInArrow(read, _MATCHES).dropDuplicates(["text_id"])


def phrase_matches(docs, items, width=WIDTH, anchors=ANCHORS, near=NEAR, block_words=BLOCK_WORDS, proximity=True):
    """One row per matched text: text_id, edges (start and end of every hit span of words, in turn),
    exact and near (ids of items with an exact or a near window), near_edges (spans of near windows).
    Without proximity the near columns hold only what the search for exact hits happens to see.

    Every block of items is taken through the whole index; a text may have a row for each block.
    """
    docs = columns_of(docs, "text")
    rule = lambda n: _anchor_rule(n, width, anchors, near, proximity)
    out = None
    for block in _item_blocks(columns_of(items, "item_id", "text"), block_words):
        vocabulary = np.unique(np.concatenate([h for _, h in block]))
        places = _anchor_places(block, vocabulary, _term_counts(docs, vocabulary), width, rule)
        wanted = np.unique([t for t, _, _ in places])
        index = materialise(build_index(docs, vocabulary, wanted), "postings")
        found = materialise(_diagonals(docs.sparkSession, index, places, block, rule), "diagonals")
        part = materialise(_judge(docs, found, block, width, near), "matches")
        release(docs.sparkSession, index, found)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], _MATCHES)
    return out


def _word_counts(batches):
    for batch in slices(batches):
        _, first = words_of(batch.column(1), NOT_ALNUM)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(first).astype(np.int64)), batch.column(2)],
            names=["doc_id", "n_words", "text_id"])


def contamination(docs, items, **settings):
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near."""
    matches = phrase_matches(docs, items, **settings)
    lists = [F.flatten(F.collect_list(F.col(c))).alias(c) for c in ("edges", "exact", "near")]
    matches = matches.groupBy("text_id").agg(*lists)
    plain = columns_of(docs, "doc_id", "text")
    counted = plain.select("doc_id", "text", text_key(F.col("text")).alias("text_id")).mapInArrow(
        _word_counts, f"doc_id {dict(plain.dtypes)['doc_id']}, n_words long, text_id binary")
    joined = counted.join(matches, "text_id", "left")
    none = F.array().cast("array<string>")
    joined = joined.withColumn("names", F.array_sort(F.array_distinct(F.coalesce("exact", none))))
    joined = joined.withColumn("edges", F.coalesce("edges", F.array().cast("array<long>")))
    return joined.select(
        "doc_id", "n_words", _covered(F.col("edges")).alias("n_hit"),
        F.size("names").cast("long").alias("n_items"),
        F.sha2(F.array_join("names", ","), 256).alias("items_sha256"),
        (F.size("edges") > 0).alias("contaminated"),
        F.size(F.array_distinct(F.coalesce("near", none))).cast("long").alias("n_near"))


def _covered(edges):
    """Words covered by spans given as start, end, start, end; spans of several blocks may overlap."""
    pairs = F.array_sort(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(edges)), lambda i: (i % 2 == 0) & (i < F.size(edges))),
        lambda i: F.struct(F.get(edges, i).alias("a"), F.get(edges, i + 1).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    step = lambda s, p: F.struct(
        (s["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(p["a"], s["reach"]))).alias("n"),
        F.greatest(s["reach"], p["b"]).alias("reach"))
    return F.aggregate(pairs, start, step, lambda s: s["n"])


def remove_contaminated(docs, items, **settings):
    """The documents without any hit, with all their columns; null texts stay."""
    (name,) = free_names(docs, "hit_text")
    hit = phrase_matches(docs, items, **{"proximity": False} | settings).where(F.size("edges") > 0).select(
        F.col("text_id").alias(name)).distinct()
    return docs.join(hit, text_key(F.col("text")) == F.col(name), "left_anti")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS span, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
spans AS (SELECT DISTINCT span FROM bw),
dw AS (
  SELECT r, span, i, array_to_string(w[i:i + span - 1], ' ') AS g
  FROM (SELECT r, w, span, unnest(generate_series(1, len(w) - span + 1)) AS i FROM d, spans WHERE len(w) >= span)),
hits AS (SELECT dw.r, dw.i, dw.span, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.span = bw.span),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + span - 1)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
          FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
