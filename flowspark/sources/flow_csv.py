"""Flow CSV files as cleaned, labelled tables."""

import csv
import logging
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.cleaning import clean_features, present_features
from flowspark.functions.labels import encode_label
from flowspark.operators.sampling import capped_sample
from flowspark.schema import FEATURES, RAW_LABEL, snake
from flowspark.session import materialise
from flowspark.sources import files

log = logging.getLogger(__name__)

ENCODING = "ISO-8859-1"
# File number and line share one number.
_LINE_BITS = 40
#: The table of splits is sent to the tasks up to so many rows, and joined beyond.
MAX_SENT_SPLITS = 500_000


def header_names(line):
    """Column names of a header line; a repeated name gets .1, .2, ... and all become snake_case."""
    seen, names = {}, []
    for raw in next(csv.reader([line])):
        name = raw.strip()
        repeat = seen.get(name, 0)
        seen[name] = repeat + 1
        names.append(snake(f"{name}.{repeat}" if repeat else name))
    return names


def _lines(spark, paths):
    """Every line of the files with its place: file, start of the split, and a number that grows within the split."""
    return spark.read.text(list(paths)).select(
        F.decode(F.col("value").cast("binary"), ENCODING).alias("line"),
        F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
    )


def _scan_splits(spark, paths):
    """One row per split: its lines, the number of the first, the most fields of a line and, at a file's start, the header."""
    fields = F.expr("""CASE WHEN contains(line, '"') THEN size(split(regexp_replace(line, '"[^"]*"', ''), ',', -1))
                       ELSE length(line) - length(replace(line, ',', '')) + 1 END""")
    found = _lines(spark, paths).groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("lines"), F.min("at").alias("first"), F.max(fields).alias("fields"),
        F.min_by(F.when(F.col("block") == 0, F.col("line")), "at").alias("header"),
    )
    return materialise(found, "csv-splits")


def _unreadable(spark, paths):
    """{path: reason} of the files whose lines cannot be read to the end, found by halving the list."""
    try:
        spark.read.text(list(paths)).write.format("noop").mode("overwrite").save()
        return {}
    except Exception as error:
        if len(paths) == 1:
            return {paths[0]: f"unreadable: {str(error).strip().splitlines()[0][:200]}"}
    half = len(paths) // 2
    return _unreadable(spark, paths[:half]) | _unreadable(spark, paths[half:])


class CsvFiles:
    """Flow files after one checking pass over their lines.

    A file is left out as a whole, and reported, when it cannot be read to its end, has no header, or has
    a line with more fields than its header. `splits` is a written table, one row for each split read.
    """

    def __init__(self, spark, paths):
        self.spark, self.paths, self.reasons = spark, list(paths), {}
        self.readable = self.paths
        try:
            self.splits = _scan_splits(spark, self.paths) if self.paths else None
        except Exception:
            self.reasons = _unreadable(spark, self.paths)
            self.readable = [p for p in self.paths if p not in self.reasons]
            if not self.reasons:
                raise
            self.splits = _scan_splits(spark, self.readable) if self.readable else None
        per_file = {} if self.splits is None else {r["file"]: r for r in self.splits.groupBy("file").agg(
            F.sum("lines").alias("lines"), F.max("fields").alias("fields"), F.max("header").alias("header")).collect()}
        self.headers, self.lines = {}, {}
        for path in self.readable:
            row = per_file.get(_file_key(spark, path))
            if row is None or not (row["header"] or "").strip():
                self.reasons[path] = "no header"
                continue
            names = tuple(header_names(row["header"]))
            if row["fields"] > len(names):
                self.reasons[path] = f"a line of {row['fields']} fields under a header of {len(names)}"
                continue
            self.headers[path], self.lines[path] = names, row["lines"]
        for path, reason in self.reasons.items():
            log.warning("skipping %s: %s", path, reason)
        if len(self.paths) > 1 << 63 - _LINE_BITS or max(self.lines.values(), default=0) > 1 << _LINE_BITS:
            raise ValueError(f"more than {1 << 63 - _LINE_BITS} files, or {1 << _LINE_BITS} lines in one")

    def report(self) -> DataFrame:
        """One row per file in order: file_no, file, status (ok, or why it was left out), rows."""
        rows = [(i, p, self.reasons.get(p, "ok"), self.lines.get(p, 1) - 1) for i, p in enumerate(self.paths)]
        return self.spark.createDataFrame(rows, "file_no long, file string, status string, rows long")

    def rows(self) -> DataFrame:
        """All columns as text, with source_file, and the identity of a row: flow_id, which file_order equals.

        flow_id is the file's place in the list and the line within the file, so it neither depends on
        how files are cut into splits nor on how many tasks read them, and it is the order of the rows.
        """
        if not self.headers:
            raise FileNotFoundError(f"no readable CSV file among {self.paths[:5]}")
        kinds = sorted(set(self.headers.values()))
        names = list(dict.fromkeys(n for kind in kinds for n in kind))
        about = self.spark.createDataFrame(
            [(_file_key(self.spark, p), i, kinds.index(self.headers[p])) for i, p in enumerate(self.paths) if p in self.headers],
            "file string, file_no long, kind int")
        before = F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        splits = self.splits.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before")).join(about, "file")
        if self.splits.count() <= MAX_SENT_SPLITS:
            splits = F.broadcast(splits)
        width = max(map(len, kinds))
        cells = F.from_csv("line", ", ".join(f"c{i} string" for i in range(width)), {"mode": "PERMISSIVE"})
        line = F.expr("before + at - first")
        placed = _lines(self.spark, self.readable).join(splits, ["file", "block"]).withColumn("line_no", line).where(
            "line_no > 0 and trim(line) <> ''")
        parsed = placed.select("kind", "file", (F.shiftleft("file_no", _LINE_BITS) + F.col("line_no")).alias("flow_id"), cells.alias("s"))
        return parsed.select(
            *[self._cell(n, kinds).alias(n) for n in names],
            F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("source_file"), F.col("flow_id").alias("file_order"), "flow_id")

    @staticmethod
    def _cell(name, kinds):
        """The cell of a column, whose place depends on the file's header; null where the header has no such name."""
        places = [k.index(name) if name in k else None for k in kinds]
        if len(set(places)) == 1:
            return F.col(f"s.c{places[0]}")
        cases = " ".join(f"WHEN {i} THEN s.c{p}" for i, p in enumerate(places) if p is not None)
        return F.expr(f"CASE kind {cases} END")


def read_flow_text(spark, paths) -> DataFrame:
    """All columns of the sound files among paths as text, with source_file, file_order and flow_id."""
    return CsvFiles(spark, paths).rows()


def csv_report(spark, paths) -> DataFrame:
    """What the checking pass says of every file."""
    return CsvFiles(spark, paths).report()


def _file_key(spark, path):
    """A file's name as the scan gives it: with its scheme, special characters encoded, local ones from /."""
    return re.sub("^file:/+", "/", files.uri(spark, path))


def clean_flow_text(raw: DataFrame, strict_labels=False) -> DataFrame:
    """Known features as clean doubles, label text as label_id; other columns are dropped."""
    label = snake(RAW_LABEL)
    keep = [c for c in ("flow_id", "file_order", "source_file") if c in raw.columns]
    features = present_features(raw, FEATURES)
    labels = [encode_label(F.coalesce(F.col(label), F.lit("nan")), strict_labels).alias("label_id")] \
        if label in raw.columns else []
    cleaned = clean_features(raw, features)
    return cleaned.select(*keep, *features, *labels)


def load_flows(spark, paths, max_rows_per_file=None, seed=42, strict_labels=False) -> DataFrame:
    """Clean flows of the given files; a cap takes a repeatable sample of that many rows per file.

    Files that the checking pass finds broken are left out whole; csv_report tells which and why.
    """
    raw = read_flow_text(spark, paths)
    if max_rows_per_file:
        # files of one name in several folders are several files
        numbered = raw.withColumn("file_no", F.shiftright("flow_id", _LINE_BITS))
        raw = capped_sample(numbered, max_rows_per_file, ["file_no"], "flow_id", seed)
    return clean_flow_text(raw, strict_labels)


def load_directory(spark, directory, **options) -> DataFrame:
    """load_flows over the sorted *.csv files of a directory."""
    paths = files.glob(spark, f"{directory.rstrip('/')}/*.csv")
    if not paths:
        raise FileNotFoundError(f"no CSV files in {directory}")
    return load_flows(spark, paths, **options)


def load_listed(spark, directory, names, **options) -> DataFrame:
    """load_flows over a configured list of file names, those that exist."""
    paths = files.existing(spark, [f"{directory.rstrip('/')}/{n}" for n in names])
    if not paths:
        raise FileNotFoundError(f"none of {list(names)} is in {directory}")
    return load_flows(spark, paths, **options)
