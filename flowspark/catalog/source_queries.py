"""Queries over flow CSV files written from the event table, one file a day."""

from pyspark.sql import functions as F

from flowspark.catalog.adapters import FLOW_COLUMNS, FLOWS_CTE, flows
from flowspark.functions.labels import label_name
from flowspark.operators.quality import label_distribution_by_file
from flowspark.schema import CLIP_LIMIT, FEATURES, LABELS, RAW_FEATURES
from flowspark.session import work_dir
from flowspark.sources import files
from flowspark.sources.flow_csv import csv_report, load_flows

_RAW_NAME = dict(zip(FEATURES, RAW_FEATURES))
_CAP = 40


def _written(spark, sf_dir):
    """Paths of the files: a day's flows each, in the order of their ids, and a last one that is broken half-way."""
    root = work_dir(spark, "csv")
    rows = flows(spark, sf_dir).withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), " Label": label_name(F.col("label_id"))})
    columns = [F.col(c).alias(f" {_RAW_NAME[c]}") for c in FLOW_COLUMNS]
    rows.repartition("day").sortWithinPartitions("day", "flow_id").select("day", *columns, " Label").write.partitionBy("day").option(
        "header", True).csv(f"{root}/flows")
    broken = spark.createDataFrame([(" Flow Duration, Label\n1,BENIGN\n2,BENIGN,too many\n3,BENIGN",)], "value string")
    broken.coalesce(1).write.text(f"{root}/broken")
    return files.glob(spark, f"{root}/flows/day=*/*.csv") + files.glob(spark, f"{root}/broken/*.txt")


def _placed(found):
    """flow_id as the two numbers it is made of."""
    return found.withColumns({"file_no": F.shiftright("flow_id", 40), "line": F.col("flow_id").bitwiseAND((1 << 40) - 1)})


def csv_roundtrip(spark, sf_dir):
    """Cleaned flows of all sound files with their place."""
    return _placed(load_flows(spark, _written(spark, sf_dir))).select("file_no", "line", "label_id", *FLOW_COLUMNS)


def csv_cap(spark, sf_dir):
    """A sample of at most 40 rows a file, which depends on the rows' places only."""
    found = load_flows(spark, _written(spark, sf_dir), max_rows_per_file=_CAP)
    return _placed(found).select("file_no", "line", "label_id", "flow_duration")


def csv_files(spark, sf_dir):
    """The checking pass: a row per file."""
    return csv_report(spark, _written(spark, sf_dir)).select("file_no", "status", "rows")


def csv_labels(spark, sf_dir):
    """Flows by label in every file, with their share."""
    found = load_flows(spark, _written(spark, sf_dir)).withColumn("file_no", F.shiftright("flow_id", 40))
    return label_distribution_by_file(found, file="file_no").select(
        "file_no", "label_id", "label_name", "n", F.round("percent", 6).alias("percent"))


_DAYS = f"""
WITH {FLOWS_CTE},
d AS (SELECT *, dense_rank() OVER (ORDER BY strftime(ts, '%Y-%m-%d')) - 1 AS file_no,
        row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY flow_id) AS line FROM flows)"""
_CLEAN = ", ".join(f"least(greatest({c}, -{CLIP_LIMIT}), {CLIP_LIMIT}) AS {c}" for c in FLOW_COLUMNS)

_NAMES = "[" + ", ".join(f"'{n}'" for n in LABELS.values()) + "]"

QUERIES = {
    "csv_roundtrip": (csv_roundtrip, f"{_DAYS}\nSELECT file_no, line, label_id, {_CLEAN} FROM d"),
    "csv_cap": (csv_cap, f"""{_DAYS}
SELECT file_no, line, label_id, least(flow_duration, {CLIP_LIMIT}) AS flow_duration FROM d
QUALIFY row_number() OVER (PARTITION BY file_no ORDER BY md5('42|' || (file_no * 1099511627776 + line))) <= {_CAP}"""),
    "csv_files": (csv_files, f"""{_DAYS}
SELECT file_no, 'ok' AS status, count(*) AS rows FROM d GROUP BY 1
UNION ALL SELECT max(file_no) + 1, 'a line of 3 fields under a header of 2', 0 FROM d"""),
    "csv_labels": (csv_labels, f"""{_DAYS}
SELECT file_no, label_id, {_NAMES}[label_id + 1] AS label_name, count(*) AS n,
  round(count(*) * 100 / CAST(sum(count(*)) OVER (PARTITION BY file_no) AS DOUBLE), 6) AS percent FROM d GROUP BY 1, 2"""),
}
