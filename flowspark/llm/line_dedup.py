"""Deletion of repeated line runs with a suffix array over line ids, built by prefix doubling.

A line's id is a 128-bit digest of its characters; suffixes of the sequence of line ids of a document
are sorted by it. Level k names every block of 2**k lines that occurs more than once by its place in
sorted order, from the two level k - 1 names it consists of. Suffixes whose block is unique drop out,
so levels shrink quickly and end by themselves. All suffixes with one name are one interval of the
suffix array with a longest common prefix of 2**k lines or more. The earliest suffix of an interval
is the first copy; the longest common prefix of any other member with its first copy is found by
descending through the levels, which gives maximal repeated runs. Runs that are later copies are
deleted line by line. Everything runs as DataFrame functions.

Order of texts: by doc_id with nulls first, then by a digest of the text.

A run counts when it has at least `min_lines` lines, or is one line of at least `min_chars`
characters. Defined cases: a null text stays null with 0 lines, an empty text is one empty line; rows
that repeat doc_id and text are one document and keep the same lines; equal ids with other texts are
documents of their own. Lines are split at line feeds only. Other columns pass through untouched.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowspark.llm.keys import columns_of, free_names, text_key
from flowspark.session import materialise, release

MIN_LINES = 2
MIN_CHARS = 50


def _document(docs):
    return F.struct(docs["doc_id"].alias("id"), text_key(docs["text"]).alias("text"))


def _lines(docs, min_chars):
    """doc (id and text digest), idx, id and whether it is long, of every line."""
    keyed = docs.where("text is not null").select(_document(docs).alias("doc"), F.split("text", "\n", -1).alias("lines"))
    rows = keyed.select("doc", F.posexplode("lines").alias("idx", "line"))
    return rows.select("doc", "idx", F.substring(F.unhex(F.sha2("line", 256)), 1, 16).alias("id"),
                       (F.char_length("line") >= F.lit(min_chars)).alias("long"))


def _repeated(blocks, *key):
    """Blocks whose key occurs at two places or more, with the key's earliest place as `first`."""
    place = F.struct("doc", "idx")
    classes = blocks.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    return classes.where("first <> last").drop("last")


def doubling_levels(lines):
    """Tables (doc, idx, name, first), one for each block length 1, 2, 4, ... that still repeats.

    The first also tells long lines. A repeated document's lines are taken once.
    """
    classes = materialise(_repeated(lines, "id"), "classes")
    level = lines.join(classes, "id").select("doc", "idx", F.col("id").alias("name"), "first", "long")
    level = materialise(level.dropDuplicates(["doc", "idx"]), "level")
    release(lines.sparkSession, classes)
    levels, width = [], 1
    while not level.isEmpty():
        levels.append(level)
        left = level.select("doc", "idx", F.col("name").alias("a"))
        right = level.select("doc", (F.col("idx") - width).alias("idx"), F.col("name").alias("b"))
        pairs = materialise(left.join(right, ["doc", "idx"]), "pairs")
        # sorting the distinct pairs keeps names in the order of the suffixes
        names = _repeated(pairs, "a", "b").orderBy("a", "b").withColumn("name", F.monotonically_increasing_id())
        names = materialise(names, "names")
        level = materialise(pairs.join(names, ["a", "b"]).select("doc", "idx", "name", "first"), "level")
        release(lines.sparkSession, pairs, names)
        width *= 2
    return levels


def _copies(levels, min_lines):
    """(doc, idx, first) for every block of min_lines lines that is a later copy."""
    k = min_lines.bit_length() - 1
    if k >= len(levels):
        return None
    level = levels[k]
    if min_lines > 1 << k:
        left = level.select("doc", "idx", F.col("name").alias("a"))
        right = level.select("doc", (F.col("idx") - (min_lines - (1 << k))).alias("idx"), F.col("name").alias("b"))
        pairs = materialise(left.join(right, ["doc", "idx"]), "blocks")
        level = pairs.join(_repeated(pairs, "a", "b"), ["a", "b"])
    return level.select("doc", "idx", "first").where(F.struct("doc", "idx") != F.col("first"))


def repeated_runs(levels, min_lines=MIN_LINES):
    """(doc, idx, n, first): every later copy of a maximal repeated run, its length in lines and the
    place of its first copy. Runs that only continue a run one line earlier are left out.
    """
    copies = _copies(levels, min_lines)
    if copies is None:
        return None
    place = lambda d, i: F.struct(d.alias("doc"), i.alias("idx"))
    before = copies.select("doc", (F.col("idx") + 1).alias("idx"), place(F.col("first.doc"), F.col("first.idx") + 1).alias("first"))
    runs = copies.join(before, ["doc", "idx", "first"], "left_anti").select("doc", "idx", "first", F.lit(0).alias("n"))
    for k in reversed(range(len(levels))):
        here = levels[k].select(F.col("doc").alias("hd"), F.col("idx").alias("hi"), F.col("name").alias("hn"))
        there = levels[k].select(F.col("doc").alias("td"), F.col("idx").alias("ti"), F.col("name").alias("tn"))
        runs = runs.join(here, (F.col("doc") == F.col("hd")) & (F.col("idx") + F.col("n") == F.col("hi")), "left")
        runs = runs.join(there, (F.col("first.doc") == F.col("td")) & (F.col("first.idx") + F.col("n") == F.col("ti")), "left")
        grown = F.coalesce(F.col("hn") == F.col("tn"), F.lit(False))
        runs = runs.select("doc", "idx", "first", (F.col("n") + F.when(grown, 1 << k).otherwise(0)).alias("n"))
    return runs


def deleted_lines(docs, min_lines=MIN_LINES, min_chars=MIN_CHARS):
    """A written table (doc, gone): the indexes of the lines to delete, for every document that has any; None for none."""
    levels = doubling_levels(_lines(docs, min_chars))
    if not levels:
        return None
    single = levels[0].where(F.col("long") & (F.struct("doc", "idx") != F.col("first")))
    spans = single.select("doc", "idx", (F.col("idx") + 1).alias("end"))
    runs = repeated_runs(levels, min_lines)
    if runs is not None:
        spans = spans.unionByName(runs.select("doc", "idx", (F.col("idx") + F.col("n")).alias("end")))
    # of overlapping spans of a document each gives only what the earlier ones have not covered
    earlier = Window.partitionBy("doc").orderBy("idx", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("start", F.greatest("idx", F.coalesce(F.max("end").over(earlier), F.lit(0)))).where("start < end")
    gone = spans.groupBy("doc").agg(F.flatten(F.collect_list(F.sequence("start", F.col("end") - 1))).alias("gone"))
    gone = materialise(gone, "gone")
    release(docs.sparkSession, *levels)
    return gone


def dedup_lines(docs, min_lines=MIN_LINES, min_chars=MIN_CHARS):
    """docs with their columns, text replaced by what is left of it, and n_lines and n_deleted added,
    which take the place of columns of these names.

    A document whose every line goes is left with the empty text.
    """
    plain = columns_of(docs, "doc_id", "text")
    gone = deleted_lines(plain, min_lines, min_chars)
    every = F.split("text", "\n", -1)
    if gone is None:
        return docs.withColumns({"n_lines": F.coalesce(F.size(every), F.lit(0)).cast("long"), "n_deleted": F.lit(0).cast("long")})
    own_doc, own_gone = free_names(docs, "doc", "gone")
    gone = gone.select(F.col("doc").alias(own_doc), F.col("gone").alias(own_gone))
    joined = docs.join(gone, _document(docs) == F.col(own_doc), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col(own_gone))
    text = F.when(F.col(own_gone).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(every, i)), "\n"))
    columns = {**{c: F.col(f"`{c}`") for c in docs.columns}, "text": text,
               "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(every)).cast("long"),
               "n_deleted": F.coalesce(F.size(own_gone), F.lit(0)).cast("long")}
    return joined.select(*[c.alias(n) for n, c in columns.items()])


SQL = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, text FROM documents),
l AS (SELECT r, i, w[i] AS line FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i
        FROM (SELECT r, string_split(text, chr(10)) AS w FROM d WHERE text IS NOT NULL))),
n AS (SELECT r, i, line, lead(line) OVER (PARTITION BY r ORDER BY i) AS after FROM l),
k AS (SELECT r, i, line,
             row_number() OVER (PARTITION BY line ORDER BY r, i) > 1 AND length(line) >= 50 AS single,
             after IS NOT NULL AND row_number() OVER (PARTITION BY line, after ORDER BY r, i) > 1 AS pair FROM n),
g AS (SELECT r, i, line, single OR pair OR coalesce(lag(pair) OVER (PARTITION BY r ORDER BY i), false) AS gone FROM k),
t AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_deleted,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY r)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted,
       CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""
