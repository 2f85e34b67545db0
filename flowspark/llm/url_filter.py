"""URL filter: rules first, and for the rest the ratio of two character language models.

Urls that a rule allows or blocks train two variable-order Markov models over the characters of host
and path, smoothed by Witten-Bell interpolation from order 0 up to `ORDER`. Counts, contexts and
probabilities are tables: one row for each distinct string of up to ORDER + 1 characters, joined level
by level to the string without its first character (the shorter context) and to its own context. A url
is scored by the mean over its characters of log P(allowed) - log P(blocked), and a threshold that is
calibrated on labelled urls left out of the counts decides.

Every fifth labelled url by crc32 is left out of the counts and calibrates; both classes weigh the
same in the threshold. All other labelled urls are counted, over all rows.

Defined cases: a null url, or one without ://, has empty host and path and no characters; it scores 0.
With no labelled url of one class, that class is uniform. With nothing to calibrate on, the threshold
is 0; at or above it the verdict is allow. Repeated rows count as often as they occur and get equal
results. Other columns are ignored; an empty table gives no rows.
"""

import math

from pyspark.sql import functions as F

from flowspark.llm.keys import columns_of
from flowspark.session import materialise

#: Host and path of the rules, with their verdicts.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
ORDER = 4
#: Characters a uniform model chooses from.
ALPHABET = 96
#: Scores are counted in cells of this width, between -RANGE and RANGE, to find the threshold.
CELL, RANGE = 0.01, 10.0
_START = "\x02"


def host_and_path(url):
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host, path, rules=RULES):
    """(rule, verdict) columns of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    # the longest is tried last and so stands outermost
    for rule_host, rule_path, effect in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(effect)).otherwise(verdict)
    return rule, verdict


def _strings(urls):
    """(line, string) for every character with its ORDER characters before, the start being padded."""
    padded = F.concat(F.lit(_START * ORDER), "line")
    at = F.explode(F.sequence(F.lit(1), F.char_length("line")))
    rows = urls.where("line <> ''").select("*", padded.alias("padded"), at.alias("at"))
    return rows.withColumn("string", F.expr(f"substring(padded, at, {ORDER + 1})")).drop("padded", "at")


def markov_table(counted):
    """(string, ratio): log P(allowed) - log P(blocked) of the last character after the others.

    counted has distinct strings of ORDER + 1 characters with their counts allow and block.
    """
    level = None
    for length in range(1, ORDER + 2):
        grams = counted.groupBy(F.expr(f"right(string, {length})").alias("string")).agg(
            F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = F.expr(f"left(string, {length - 1})")
        totals = grams.groupBy(context.alias("context")).agg(
            *[F.sum(c).alias(f"{c}_n") for c in ("allow", "block")],
            *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in ("allow", "block")])
        rows = grams.withColumn("context", context).join(totals, "context")
        if level is None:
            shorter = rows.withColumns({f"{c}_p": F.lit(1.0 / ALPHABET) for c in ("allow", "block")})
        else:
            known = level.select(F.col("string").alias("rest"), *[F.col(f"{c}_q").alias(f"{c}_p") for c in ("allow", "block")])
            shorter = rows.withColumn("rest", F.expr(f"right(string, {length - 1})")).join(known, "rest")
        share = {f"{c}_q": F.when(F.col(f"{c}_n") == 0, F.col(f"{c}_p")).otherwise(
            (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_p")) / (F.col(f"{c}_n") + F.col(f"{c}_kinds")))
            for c in ("allow", "block")}
        level = materialise(shorter.withColumns(share).select("string", *share), f"order{length - 1}")
    return level.select("string", (F.log("allow_q") - F.log("block_q")).alias("ratio"))


def _threshold(scored):
    """The score from which on urls are allowed, with the best mean of both classes' hit rates."""
    cell = F.floor(F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), "score")) / F.lit(CELL))
    rows = scored.groupBy(cell.alias("cell")).agg(
        F.count_if(F.col("rule_verdict") == "allow").alias("good"), F.count_if(F.col("rule_verdict") == "block").alias("bad"))
    rows = sorted((r["cell"], r["good"], r["bad"]) for r in rows.collect())  # bounded by the number of cells
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    best, where, passed, stopped = 1.0, [-math.inf], 0, 0
    for i, (cell, g, b) in enumerate(rows):
        passed, stopped = passed + g, stopped + b
        rate = (good - passed) / good + stopped / bad
        if rate > best + 1e-12:
            best, where = rate, [(cell + 1) * CELL, (rows[i + 1][0] if i + 1 < len(rows) else cell + 1) * CELL]
    # halfway across the gap between the cells on both sides
    return sum(where) / len(where)


def judge(pages, rules=RULES):
    """Per page: page_id, host, path, rule, verdict, score (null where a rule decides)."""
    plain = columns_of(pages, "page_id", "url")
    host, path = host_and_path(F.col("url"))
    urls = plain.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.select("*", rule.alias("rule"), verdict.alias("rule_verdict"), F.concat("host", "path").alias("line"))
    apart = F.crc32(F.col("line").cast("binary")) % 5 == 0
    # equal lines have equal scores, so each is taken once with its number of rows
    lines = urls.groupBy("line", "rule_verdict").agg(F.count(F.lit(1)).alias("n"))
    lines = materialise(lines.withColumn("apart", apart & F.col("rule_verdict").isNotNull()), "lines")
    weight = {c: F.sum(F.when((F.col("rule_verdict") == c) & ~F.col("apart"), F.col("n")).otherwise(0)).alias(c) for c in ("allow", "block")}
    strings = _strings(lines)
    counted = materialise(strings.groupBy("string").agg(*weight.values()), "strings")
    ratios = markov_table(counted)
    needed = _strings(lines.where("apart or rule_verdict is null"))
    scores = needed.join(ratios, "string").groupBy("line", "rule_verdict").agg((F.sum("ratio") / F.count(F.lit(1))).alias("score"))
    scores = materialise(scores, "scores")
    cut = _threshold(scores.where("rule_verdict is not null"))
    told = scores.where("rule_verdict is null").select("line", "score")
    ruled = urls.where("rule_verdict is not null").select(
        "page_id", "host", "path", "rule", F.col("rule_verdict").alias("verdict"), F.lit(None).cast("double").alias("score"))
    score = F.coalesce("score", F.lit(0.0))
    scored = urls.where("rule_verdict is null").join(told, "line", "left").select(
        "page_id", "host", "path", "rule", F.when(score >= F.lit(cut), "allow").otherwise("block").alias("verdict"),
        score.alias("score"))
    return ruled.unionByName(scored)


RULE_SQL = """
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN ''
                  ELSE substr(url, position('://' IN url) + 3) END AS a FROM pages),
h AS (SELECT page_id, translate(regexp_extract(a, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
FROM h
"""
