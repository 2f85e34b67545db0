"""Count windows per host over a stream, kept in the engine's keyed state.

A state holds the number of windows that each of its hosts has filled, and their flows since then, fewer
than `size` a host. Hosts are dealt to a fixed number of states: a call into Python costs some milliseconds
however few rows it is given, so that a state for every host would make the calls of a batch grow with its
hosts. A batch touches the states of its own hosts only; checkpoints, restarts and repeated batches are those
of the query. The last windows of a host, which it never fills, are not emitted, like the dropped tail of the
batch path.
"""

import pickle
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from flowspark.functions.alignment import bad_cells
from flowspark.schema import SESSION_SIZE

#: States that the hosts of a stream are dealt to; fixed for the life of a checkpoint.
STATES = 1024
#: Bits of a bigint that flag nulls.
_FLAGS = 60


def _in_order(first, second):
    """Places of the rows by two columns, nulls last."""
    if "O" in (first.dtype.kind, second.dtype.kind):
        return pd.DataFrame({"first": first, "second": second}).sort_values(["first", "second"], kind="stable").index.to_numpy()
    return np.lexsort((second, first))


def _in_line(rows, names, order, tie, waiting):
    """The packed rows that wait, then those of a batch in order.

    Columns are handled as plain arrays: with a few dozen rows a call, a table's own steps would take most of the time.
    """
    columns = {c: rows[c].to_numpy() for c in names}
    place = _in_order(columns[order], columns[tie])
    before = _unpacked(waiting) if waiting is not None else {}
    return pd.DataFrame({c: np.concatenate([before[c], x[place]]) if before else x[place] for c, x in columns.items()})


def _packed(rows):
    return zlib.compress(pickle.dumps({c: rows[c].to_numpy() for c in rows.columns}), 1)


def _unpacked(packed):
    return pickle.loads(zlib.decompress(packed))


def _cut(rows, size, done, host=None):
    """(flows of the windows that are full, with session_idx and pos; the others; windows filled so far).

    host gives the place of each row's host in done; without it all rows are of one host.
    """
    of = np.zeros(len(rows), dtype="int64") if host is None else host
    done = np.atleast_1d(done)
    n = np.bincount(of, minlength=len(done))
    place = np.empty(len(rows), dtype="int64")
    place[np.argsort(of, kind="stable")] = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    full = place < (n // size * size)[of]
    windows = rows[full].assign(session_idx=(done[of] + place // size)[full], pos=(place % size)[full].astype("int32"))
    done = done + n // size
    return windows, rows[~full], done[0] if host is None else done


def _cut_hosts(rows, size, key, done):
    """The same for rows of many hosts; done is a packed table of hosts and the windows they have filled, or None."""
    before = _unpacked(done) if done is not None else {"host": rows[key].to_numpy()[:0], "n": np.zeros(0, dtype="int64")}
    host, hosts = pd.factorize(np.concatenate([before["host"], rows[key].to_numpy()]), use_na_sentinel=False)
    filled = np.concatenate([before["n"], np.zeros(len(hosts) - len(before["n"]), dtype="int64")])
    full, rest, filled = _cut(rows, size, filled, host[len(before["n"]):])
    return full, rest, _packed(pd.DataFrame({"host": hosts, "n": filled}))


def _without_null_longs(flows, added):
    """(flows whose bigint columns have no nulls but flags of them, what gives the nulls back); added columns see the nulls.

    A table of pandas keeps a bigint column with a null as doubles, which hold whole numbers up to 2**53 only.
    The largest bigint stands for a null, which is last in order as well.
    """
    longs = [f.name for f in flows.schema.fields if isinstance(f.dataType, T.LongType)]
    groups = [longs[i:i + _FLAGS] for i in range(0, len(longs), _FLAGS)]
    flags = {f"_nulls{g}": F.expr(" + ".join(f"IF(`{c}` IS NULL, {2 ** i}L, 0L)" for i, c in enumerate(group)))
             for g, group in enumerate(groups)}
    filled = flows.withColumns({**added, **flags}).withColumns({c: F.coalesce(F.col(c), F.lit(2 ** 63 - 1)) for c in longs})

    def given_back(df):
        values = {c: F.when(F.col(f"_nulls{g}").bitwiseAND(F.lit(2 ** i)) == 0, F.col(c))
                  for g, group in enumerate(groups) for i, c in enumerate(group)}
        return df.withColumns(values).drop(*flags)

    return filled, given_back


def sessionize_stream(flows: DataFrame, size=SESSION_SIZE, key="host", order="ts", tie="flow_id", idle=None,
                      states=STATES) -> DataFrame:
    """Stream of complete windows in long form: every flow with session_idx and pos.

    Flows of a batch are ordered by (order, tie), those of different batches by arrival. With idle, such
    as "1 hour", a host without flows for that long in event time loses the flows that wait for a full
    window; the number of its windows stays, so that a session_idx is never given twice, and flows that
    arrive later than that are left out. A null host is a host. One batch's flows of a host meet in one
    task, so what a trigger reads bounds the work for a hot host. Hosts share `states` states; with idle a
    host has one of its own, as it falls idle by itself.
    """
    columns = flows.columns
    # null hosts keep to themselves
    dealt = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(F.col(key)), F.lit(states))).otherwise(-1)
    state_of = dealt if idle is None else F.col(key)
    flows, given_back = _without_null_longs(flows, {"_state": state_of})
    names = [c for c in flows.columns if c != "_state"]
    out = T.StructType([*[flows.schema[c] for c in names], T.StructField("session_idx", T.LongType()), T.StructField("pos", T.IntegerType())])
    late = GroupStateTimeout.NoTimeout
    if idle is not None:
        late = GroupStateTimeout.EventTimeTimeout
        flows = flows.withColumn("_seen_at", F.col(order).cast("timestamp")).withWatermark("_seen_at", idle)

    def windows(_, chunks, state):
        done, waiting = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            state.update((done, None))
            return
        chunks = list(chunks)
        rows = chunks[0] if len(chunks) == 1 else pd.concat(chunks)
        if idle is not None:
            # the watermark lags behind by the idle time, so it passes the host's last flow when that is over
            last = rows["_seen_at"].max().value // 1_000_000
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        full, rest, done = _cut_hosts(_in_line(rows, names, order, tie, waiting), size, key, done)
        state.update((done, _packed(rest) if len(rest) else None))
        if len(full):
            yield full

    found = flows.groupBy("_state").applyInPandasWithState(windows, out, "done binary, waiting binary", "append", late)
    return given_back(found).select(*columns, "session_idx", "pos")


def start_sessions(flows: DataFrame, path, checkpoint, trigger=None, **options):
    """Append complete windows of a stream to a parquet table; each batch is there once."""
    return (
        sessionize_stream(flows, **options).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def split_valid_sessions(aligned: DataFrame, features, size=SESSION_SIZE, keys=("host", "session_idx")):
    """(flows of sessions fit to be scored, keys of the others with a reason). Nothing is guessed for them."""
    keys = list(keys)
    checked = aligned.groupBy(*keys).agg(
        F.count("*").alias("n_flows"), F.sum(bad_cells(features)).alias("n_bad")
    )
    wrong_size, bad = F.col("n_flows") != size, F.col("n_bad") > 0
    failed = checked.filter(wrong_size | bad).withColumn(
        "reason", F.when(wrong_size, "session size").otherwise("NaN or infinite value")
    )
    return aligned.join(checked.filter(~(wrong_size | bad)).select(*keys), keys), failed
