"""The alert table: one row per alert id, read from an append-only log of batches.

Every writer owns the folders of its batches, `writer=<name>/batch=<number>`, and writes no other. A
batch is written whole and counts once its _SUCCESS marker exists, so one that died is written again by
its writer, one that is there already is left alone, and writers never touch each other's alerts. Which
alert of an id is the latest, and the order of all, are worked out at reading, by the time a batch was
recorded and the alert's own time. Compaction puts the rows in force into one batch and keeps markers.
"""

import logging
import time
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.alerts import verdict
from flowspark.schema import ALERT_ORDER, ALERT_SCHEMA
from flowspark.session import materialise
from flowspark.sources import files

log = logging.getLogger(__name__)

_FIELDS = [f.name for f in ALERT_SCHEMA.fields if f.name != "seq"]
#: What the log holds besides the alert: micros at which the batch was recorded, and an id of the row.
_STORED = T.StructType([
    T.StructField("recorded", T.LongType()), T.StructField("row_id", T.StringType()),
    *[f for f in ALERT_SCHEMA.fields if f.name != "seq"],
])


def normalise_alerts(batch: DataFrame, source=None) -> DataFrame:
    """Alert rows with every field of the table except seq; absent ones null or derived."""
    have = set(batch.columns)

    def col(name, default):
        return F.coalesce(F.col(name), default) if name in have else default

    null = F.lit(None)
    columns = {
        "alert_uuid": col("alert_uuid", null),
        "ts": col("ts", F.unix_micros(F.current_timestamp()) / 1e6),
        "attack_id": col("attack_id", F.lit(0)),
        "attack_name": col("attack_name", F.lit("Unknown")),
        "confidence": col("confidence", F.lit(0.0)),
        "is_attack": col("is_attack", F.lit(False)),
        "source": F.lit(source) if source is not None else col("source", F.lit("rest")),
        "session_id": col("session_id", null),
        "ground_truth": col("ground_truth", null),
        "n_flows": col("n_flows", F.lit(0)),
    }
    bulky = {"raw", "threat_intelligence"}
    raw = F.to_json(F.struct(*[F.col(c) for c in batch.columns if c not in bulky]))
    out = batch.select(
        *[c.cast(ALERT_SCHEMA[name].dataType).alias(name) for name, c in columns.items()],
        (F.col("raw") if "raw" in have else raw).alias("raw"),
    )
    return out.withColumn("verdict", verdict(F.col("is_attack"), F.col("ground_truth"))).select(*_FIELDS)


def newest_per_id(alerts: DataFrame, order, spare=None) -> DataFrame:
    """The last row of each alert id by the order columns.

    Rows without an id never replace each other, or by the id that `spare` gives. Ranks of one are cut
    inside the tasks before the shuffle, so an id repeated very often costs nothing extra.
    """
    named = alerts if spare is not None else alerts.filter("alert_uuid IS NOT NULL")
    key = F.col("alert_uuid") if spare is None else F.coalesce("alert_uuid", F.concat(F.lit("\0"), F.col(spare)))
    place = F.row_number().over(Window.partitionBy("_key").orderBy(*[F.desc_nulls_last(c) for c in order]))
    latest = named.withColumn("_key", key).withColumn("_place", place).filter("_place = 1").drop("_key", "_place")
    return latest if spare is not None else latest.unionByName(alerts.filter("alert_uuid IS NULL"))


def retain(alerts: DataFrame, max_alerts=None) -> DataFrame:
    """The newest max_alerts rows, all without a number."""
    if max_alerts is None:
        return alerts
    return alerts.orderBy(*[F.desc_nulls_last(c) for c in ALERT_ORDER]).limit(max_alerts)


def numbered(alerts: DataFrame) -> DataFrame:
    """Alerts with seq, 1 for the oldest; ranges of the order are numbered apart and shifted."""
    order = [F.asc_nulls_first(c) for c in ALERT_ORDER]
    # written once, so that the ranges are the same for counting and numbering
    dealt = materialise(alerts.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "alert-order")
    # one row for each range
    earlier = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select(
        "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.join(before, "range").withColumn("seq", (F.col("before") + place).cast("bigint")).select("seq", *_FIELDS)


class AlertTable:
    def __init__(self, spark, root, max_alerts=None):
        self.spark, self.root, self.max_alerts = spark, root.rstrip("/"), max_alerts

    def _folder(self, writer, batch_id):
        # the name of a writer may be a path, such as that of a checkpoint
        return f"{self.root}/writer={uuid.uuid5(uuid.NAMESPACE_URL, writer).hex}/batch={batch_id}"

    def batches(self):
        """Folders of the batches that are complete."""
        return [p.rsplit("/", 1)[0] for p in files.glob(self.spark, f"{self.root}/writer=*/batch=*/_SUCCESS")]

    def log(self, folders=None) -> DataFrame:
        """All rows of complete batches, those that others replace too."""
        folders = self.batches() if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).parquet(*folders)

    def read(self) -> DataFrame:
        """The alerts in force: the latest of each id, the newest max_alerts where that is given."""
        return retain(newest_per_id(self.log(), ALERT_ORDER, spare="row_id"), self.max_alerts)

    def numbered(self) -> DataFrame:
        """read() with seq, the place by the time of recording."""
        return numbered(self.read())

    def record(self, batch: DataFrame, source=None, batch_id=None, writer="stream"):
        """Append a batch; of an id that is in it more than once only the latest alert.

        A stream names itself and its batch; a batch that is stored already changes nothing. Without a
        batch number the batch stands for itself.
        """
        folder = self._folder(writer, batch_id) if batch_id is not None else self._folder(uuid.uuid4().hex, 0)
        if files.exists(self.spark, f"{folder}/_SUCCESS"):
            return
        order = ("ts", "alert_uuid", "raw")
        latest = newest_per_id(normalise_alerts(batch, source), order)
        rows = latest.withColumns({"recorded": F.lit(time.time_ns() // 1000), "row_id": F.expr("uuid()")})
        rows.select(*_STORED.names).write.mode("overwrite").parquet(folder)

    def record_safely(self, batch: DataFrame, source=None, batch_id=None, writer="stream"):
        """record for callers whose detection must go on when the table cannot be written."""
        try:
            self.record(batch, source, batch_id, writer)
            return True
        except Exception as error:
            log.warning("alerts were not stored: %s", error)
            return False

    def compact(self):
        """Put the rows in force into one batch and remove those of the batches it was made from.

        For times when nobody reads. The markers stay, so a batch that is handed in again is still known;
        a compaction that dies leaves rows twice, which reading takes for one.
        """
        folders = self.batches()
        kept = retain(newest_per_id(self.log(folders), ALERT_ORDER, spare="row_id"), self.max_alerts)
        kept.write.parquet(self._folder(uuid.uuid4().hex, 0))
        for folder in folders:
            files.remove(self.spark, f"{folder}/part-*")

    def clear(self):
        """Empty the table; it forgets its batches too."""
        files.remove(self.spark, f"{self.root}/writer=*")
