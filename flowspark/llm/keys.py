"""Row keys that hold for null or repeated ids, and calls of Arrow functions."""

from pyspark.sql import functions as F


def text_key(text):
    """16 bytes that stand for a text; null has a key of its own."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("n")), 256)), 1, 16)


def columns_of(docs, *names):
    """The named columns alone, so that further columns of any name are neither read nor clash."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def free_names(docs, *names):
    """These names, made longer where a column of the table has one of them."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name in taken:
            name += "_"
        out.append(name)
    return out


def bounded_batches(spark, rows=1000):
    """Lower Spark's default of 10,000 rows in an Arrow batch, as whole texts are long; another setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))
