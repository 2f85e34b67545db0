"""Queries that sample, split, scale and weigh."""

from pyspark.sql import functions as F

from flowspark.catalog.adapters import FLOW_COLUMNS, FLOWS_CTE, flows, table
from flowspark.operators.sampling import (
    balanced_resample, capped_sample, class_pool, first_exemplars, stratified_split,
)
from flowspark.operators.scaling import FeatureScaler, inverse_class_weights, log_class_weights

_ITEM_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def capped(spark, sf_dir):
    """At most 500 rows per return flag of the item table."""
    items = table(spark, sf_dir, "lineitem").withColumn(
        "item_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    )
    return capped_sample(items, 500, ["l_returnflag"], "item_id").groupBy("l_returnflag").agg(
        F.count("*").alias("n")
    )


def capped_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return capped_sample(events, 300, ["event_type"], "event_id").select("event_id", "event_type")


def pool(spark, sf_dir):
    """Class pool of flows whose label text has several spellings."""
    rows = flows(spark, sf_dir)
    text = F.when(F.col("label_id") == 2, F.when(F.col("flow_id") % 2 == 0, "DDoS").otherwise(" ddos "))
    text = text.when(F.col("label_id") == 4, "DoS Hulk").when(F.col("label_id") == 10, "PortScan").otherwise("BENIGN")
    return class_pool(rows.withColumn("label", text), 100).select("flow_id", "class_name")


def exemplars(spark, sf_dir):
    """First 20 flows per class from the first day that has 20 of them."""
    rows = flows(spark, sf_dir).withColumn("source_file", F.date_format("ts", "yyyy-MM-dd"))
    found = first_exemplars(rows, order="flow_id", targets=[0, 2, 4, 10])
    return found.select("flow_id", "label_id", "source_file")


def split(spark, sf_dir):
    return stratified_split(flows(spark, sf_dir)).select("flow_id", "label_id", "split")


def resample(spark, sf_dir):
    drawn = balanced_resample(flows(spark, sf_dir))
    return drawn.select("flow_id", "label_id", "copy")


def scaled_items(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(7.0))
    scaler = FeatureScaler.fit(items, [*_ITEM_MEASURES, "constant"])
    return scaler.transform(items).select(
        "l_orderkey", "l_linenumber", *[F.round(c, 4).alias(c) for c in [*_ITEM_MEASURES, "constant"]]
    )


def scaled_flows(spark, sf_dir):
    rows = flows(spark, sf_dir)
    scaler = FeatureScaler.fit(rows, FLOW_COLUMNS)
    return scaler.transform(rows).select("flow_id", *[F.round(c, 4).alias(c) for c in FLOW_COLUMNS])


def weights_log(spark, sf_dir):
    weighted = log_class_weights(flows(spark, sf_dir))
    return weighted.groupBy("label_id").agg(
        F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"),
        F.round(F.sum("weight"), 3).alias("weight_sum"),
    )


def weights_inverse(spark, sf_dir):
    weighted = inverse_class_weights(flows(spark, sf_dir))
    return weighted.groupBy("label_id").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))


def _scaled_sql(source, keys, columns, constant=False):
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in columns)
    cells = [f"round(({c} - m_{c}) / s_{c}, 4) AS {c}" for c in columns]
    if constant:
        cells.append("0e0 AS constant")
    return f"s AS (SELECT {stats} FROM {source}) SELECT {keys}, {', '.join(cells)} FROM {source}, s"


def split_cte(source, label, item):
    """split_<source>: source with a split of 70 / 15 / 15 percent per label in hash order of item."""
    return f"""r_{source} AS (SELECT *, count(*) OVER (PARTITION BY {label}) AS split_n,
    row_number() OVER (PARTITION BY {label}
      ORDER BY CAST('0x' || substr(md5('42|' || {item}), 1, 8) AS BIGINT), {item}) - 1 AS split_r FROM {source}),
split_{source} AS (SELECT *, CASE WHEN split_r < split_n - (split_n * 30 + 99) // 100 THEN 'train'
    WHEN split_r < split_n - ((split_n * 30 + 99) // 100 * 15 + 29) // 30 THEN 'val' ELSE 'test' END AS split FROM r_{source})"""


QUERIES = {
    "capped_sample": (capped, """
SELECT l_returnflag, least(count(*), 500) AS n FROM lineitem GROUP BY 1"""),
    "capped_sample_rows": (capped_events, """
SELECT event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id), event_id) <= 300"""),
    "class_pool": (pool, f"""
WITH {FLOWS_CTE}
SELECT flow_id, CASE label_id WHEN 0 THEN 'BENIGN' WHEN 2 THEN 'DDoS' WHEN 4 THEN 'DoS Hulk' ELSE 'PortScan' END
  AS class_name FROM flows
QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY md5('42|' || flow_id), flow_id) <= 100"""),
    "first_exemplars": (exemplars, f"""
WITH {FLOWS_CTE},
d AS (SELECT *, strftime(ts, '%Y-%m-%d') AS source_file FROM flows),
c AS (SELECT label_id, min(source_file) AS source_file FROM
      (SELECT label_id, source_file FROM d GROUP BY ALL HAVING count(*) >= 20) GROUP BY 1)
SELECT flow_id, label_id, source_file FROM d JOIN c USING (label_id, source_file)
QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY flow_id) <= 20"""),
    "stratified_split": (split, f"""
WITH {FLOWS_CTE},
{split_cte('flows', 'label_id', 'flow_id')}
SELECT flow_id, label_id, split FROM split_flows"""),
    # Draw j takes a class and a place in it from two hashes.
    "balanced_resample": (resample, f"""
WITH {FLOWS_CTE},
c AS (SELECT label_id, count(*) AS n, row_number() OVER (ORDER BY label_id) - 1 AS number FROM flows GROUP BY 1),
j AS (SELECT unnest(range((SELECT count(*) FROM flows))) AS j),
w AS (SELECT j, CAST('0x' || substr(md5('42|class|' || j), 1, 15) AS BIGINT) % (SELECT count(*) FROM c) AS number FROM j),
d AS (SELECT label_id, CAST('0x' || substr(md5('42|row|' || j), 1, 15) AS BIGINT) % n AS place, count(*) AS copies
      FROM w JOIN c USING (number) GROUP BY ALL),
f AS (SELECT flow_id, label_id, row_number() OVER (PARTITION BY label_id ORDER BY flow_id) - 1 AS place FROM flows)
SELECT flow_id, label_id, unnest(range(copies)) AS copy FROM f JOIN d USING (label_id, place)"""),
    "standard_scale": (scaled_items, "WITH " + _scaled_sql("lineitem", "l_orderkey, l_linenumber", _ITEM_MEASURES, True)),
    "standard_scale_flows": (scaled_flows, f"WITH {FLOWS_CTE}, " + _scaled_sql("flows", "flow_id", FLOW_COLUMNS)),
    "class_weights_log": (weights_log, f"""
WITH {FLOWS_CTE},
c AS (SELECT label_id, count(*) AS n, (SELECT count(*) FROM flows) AS total FROM flows GROUP BY 1),
w AS (SELECT *, ln(total / CAST(n AS DOUBLE)) + 1 AS raw FROM c),
s AS (SELECT sum(raw * n) AS z FROM w)
SELECT label_id, n, round(raw * total / z, 6) AS weight, round(raw * total / z * n, 3) AS weight_sum FROM w, s"""),
    "class_weights_inverse": (weights_inverse, f"""
WITH {FLOWS_CTE},
c AS (SELECT label_id, count(*) AS n FROM flows GROUP BY 1),
s AS (SELECT sum(1e0 / n) AS z, count(*) AS k FROM c)
SELECT label_id, n, round(1e0 / n / z * k, 6) AS weight FROM c, s"""),
}
