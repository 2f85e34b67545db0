"""Filter interaction audit: what every filter of a chain removes, in every order of the filters.

Each document becomes a mask of the filters that it fails, and documents are counted by (part, mask):
at most 32 cells a part with five filters. The counts after any set of filters follow from a walk over
all subsets in Gray-code order, which switches one filter at a time: every cell keeps the number of
active filters that it fails, and leaves or rejoins the running survivors when that number leaves or
reaches zero. The states of all subsets are stored; a step of an order is the difference of two.

The five filters of `audit`, on whole texts (null: empty; words are runs without ASCII white space,
case-sensitive):
    A  fewer than 200 words
    B  100 * distinct words < 50 * words
    C  100 * characters A-Z > 3 * code points
    D  one of the characters # $ % & * |
    E  the text is also that of a smaller doc_id anywhere in the table

Defined cases: a null language is the part ''. A row without doc_id has no smaller doc_id and no labels,
so it never fails E. Rows that repeat a doc_id are rows of their own; none is smaller than the other. A
doc_id with several label rows is good or toxic if one of them says so. Texts equal by the first 16 bytes
of SHA-256 count as equal. Further columns are ignored; a table without rows has no parts and no result.
"""

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from flowspark.llm.keys import columns_of
from flowspark.llm.words import slices, text_buffers

LETTERS = "ABCDE"
_COPY = 16
_upper = np.zeros(256, dtype=np.int64)
_upper[65:91] = 1
_marks = np.zeros(256, dtype=np.int64)
_marks[list(b"#$%&*|")] = 1


def _masks(column):
    """Mask of A to D and text key of every text; Python's bytes.split cuts at exactly the contract's white space."""
    offsets, data = text_buffers(column)
    sums = [np.concatenate(([0], np.cumsum(x)))[offsets] for x in (_upper[data], _marks[data], (data & 0xC0) != 0x80)]
    upper, marks, points = (s[1:] - s[:-1] for s in sums)
    masks, keys = [], []
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        text = data[a:b].tobytes()
        words = text.split()
        masks.append((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
                     | int(100 * upper[i] > 3 * points[i]) << 2 | int(marks[i] > 0) << 3)
        keys.append(hashlib.sha256(text).digest()[:16])
    return masks, keys


def content_failures(docs):
    """(doc_id, part, key, mask) per row: the filters A to D, which look at one text at a time."""

    def check(batches):
        for batch in slices(batches):
            masks, keys = _masks(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(masks, pa.int32())],
                names=["doc_id", "part", "key", "mask"])

    plain = columns_of(docs, "doc_id", "lang", "text")
    rows = plain.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(check, "doc_id long, part string, key binary, mask int")


def failure_cells(docs, labels):
    """(part, mask, n, good, toxic): documents counted by the filters that they fail.

    Only ids, keys and masks are shuffled. Copies of one text are combined before they meet: of each
    (text, part, mask, labels) one row travels with its count and its smallest doc_id.
    """
    rows = content_failures(docs)
    said = columns_of(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.expr("cast(quality <=> 1 as int)")).alias("good"), F.max(F.expr("cast(toxic <=> 1 as int)")).alias("toxic"))
    counted = rows.groupBy("doc_id", "part", "key", "mask").agg(F.count(F.lit(1)).alias("n"))
    # rows without an id find no labels; a second key keeps them from meeting in one task
    spread = counted.withColumn("spread", F.when(F.col("doc_id").isNull(), F.hash("key")).otherwise(F.lit(0)))
    told = spread.join(said.withColumn("spread", F.lit(0)), ["doc_id", "spread"], "left").withColumns(
        {"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    named = F.col("doc_id").isNotNull()
    copies = told.groupBy("key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"),
        F.sum(F.when(named, F.lit(0)).otherwise(F.col("n"))).alias("nameless"))
    least = F.min("first.doc_id").over(Window.partitionBy("key"))
    marked = copies.withColumn("originals", F.col("nameless") + F.when(
        F.col("first.doc_id") == least, F.col("first.n")).otherwise(F.lit(0)))
    sides = F.array(F.struct(F.col("mask").alias("mask"), F.col("originals").alias("n")),
                    F.struct((F.col("mask") + _COPY).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    return marked.select("part", "good", "toxic", F.inline(sides)).where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.expr("n * good")).alias("good"), F.sum(F.expr("n * toxic")).alias("toxic"))


def subset_states(cells, size):
    """Survivors (all, good, toxic) of every subset of `size` filters, by a Gray-code walk over (mask, counts)."""
    active = [0] * len(cells)
    running = np.sum([c for _, c in cells], axis=0, dtype=np.int64) if cells else np.zeros(3, dtype=np.int64)
    states = np.zeros((1 << size, 3), dtype=np.int64)
    states[0] = running
    chosen = 0
    for step in range(1, 1 << size):
        bit = step & -step  # the place at which one Gray code differs from the next
        chosen ^= bit
        change = 1 if chosen & bit else -1
        for i, (mask, counts) in enumerate(cells):
            if mask & bit:
                active[i] += change
                if active[i] == (change > 0):
                    running = running - change * np.asarray(counts, dtype=np.int64)
        states[chosen] = running
    return states


def order_steps(cells, letters=LETTERS):
    """One tuple per order and step: order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    size = len(letters)
    states = subset_states(cells, size)
    total = int(states[0][0])
    # what fails a filter is what it removes first; what fails it alone, what it removes last
    fails = [total - int(states[1 << f][0]) for f in range(size)]
    everything = (1 << size) - 1
    alone = [int(states[everything ^ (1 << f)][0] - states[everything][0]) for f in range(size)]
    rows, shapley = [], [0] * size
    for order in permutations(range(size)):
        before = 0
        for step, f in enumerate(order):
            after = before | 1 << f
            removed, good, toxic = (int(x) for x in states[before] - states[after])
            rows.append(("".join(letters[i] for i in order), step + 1, f, int(states[after][0]), removed, fails[f] - removed,
                         alone[f], good, toxic))
            shapley[f] += removed
            before = after
    return [(order, step, *counts, shapley[f]) for order, step, f, *counts in rows]


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def interactions(cells, letters=LETTERS):
    """All orders and steps of every part, from (part, mask, n, good, toxic); bit i of a mask is the i-th letter."""
    names = ["part", "filter_order", "step", *_COUNTS]
    grouped = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def walk(batches):
        for batch in slices(batches, 16):
            for part, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                steps = order_steps([(c["mask"], (c["n"], c["good"], c["toxic"])) for c in held], letters)
                columns = list(zip(*steps))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(steps), pa.string()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()),
                     *(pa.array(c, pa.int64()) for c in columns[2:])], names=names)

    return grouped.mapInArrow(walk, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))


def audit(docs, labels):
    """One row per part, order of ABCDE and step."""
    return interactions(failure_cells(docs, labels))


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents
), words AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM texts
), masks AS (
  SELECT doc_id, part, CAST(len(w) < 200 AS INT)
    + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) AS INT)
    + 8 * CAST(regexp_matches(body, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS INT) AS mask
  FROM words
), said AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic
  FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM masks LEFT JOIN said USING (doc_id) GROUP BY part, mask
), sets AS (SELECT unnest(range(32)) AS s),
states AS (
  SELECT part, s, coalesce(sum(n) FILTER (mask & s = 0), 0) AS n, coalesce(sum(good) FILTER (mask & s = 0), 0) AS good,
    coalesce(sum(toxic) FILTER (mask & s = 0), 0) AS toxic
  FROM cells, sets GROUP BY part, s
), f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
fails AS (
  SELECT part, bit, coalesce(sum(n) FILTER (mask & bit > 0), 0) AS failing, coalesce(sum(n) FILTER (mask = bit), 0) AS alone
  FROM cells, f GROUP BY part, bit
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before,
    CAST(list_sum(bits[1:step]) AS INT) AS after
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)
), counted AS (
  SELECT x.part, filter_order, step, steps.bit, y.n AS kept, x.n - y.n AS removed, failing - (x.n - y.n) AS redundant,
    alone AS unique_fails, x.good - y.good AS good_lost, x.toxic - y.toxic AS toxic_lost
  FROM steps JOIN states x ON x.s = before JOIN states y ON y.s = after AND y.part = x.part
  JOIN fails ON fails.part = x.part AND fails.bit = steps.bit
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""
