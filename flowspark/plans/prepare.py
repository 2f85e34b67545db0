"""From flows to sessions with statistics: the one path used by batch, requests and streams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.cleaning import pad_features
from flowspark.functions.alignment import realign
from flowspark.functions.protocol import add_protocol_columns
from flowspark.operators.sampling import hash_long, hash_number, stratified_split
from flowspark.operators.scaling import FeatureScaler
from flowspark.operators.sessions import attack_ids, class_counts, class_counts_sql, majority_label, sessionize
from flowspark.operators.stats import prefix_stats, session_stats
from flowspark.schema import FEATURES, SESSION_SIZE, TRAINED_FEATURES
from flowspark.session import materialise

CARRIED = ("flow_id", "host", "ts", "label_id", "session_idx", "pos", "split", "request_id", "n",
           "file_order", "source_file", "log_type")


def aligned_flows(flows: DataFrame) -> DataFrame:
    """The 81 trained columns next to ids: pad to 78, derive the protocol columns, drop column 64.

    A log_type column in the input is kept as given.
    """
    carried = [c for c in CARRIED if c in flows.columns]
    padded = pad_features(flows, FEATURES, extra=carried)
    given = "log_type" if "log_type" in carried else None
    if given is None:
        padded = add_protocol_columns(padded)
    others = [c for c in carried if c != "log_type"]
    return realign(padded, "log_type", extra=others)


def session_table(session_flows: DataFrame, keys=("host", "session_idx"), label="label_id"):
    """Statistics and labels of sessions from one aggregate."""
    extra = [class_counts(label).alias("_counts")] if label in session_flows.columns else []
    table = session_stats(session_flows, keys, extra)
    if not extra:
        return table
    counts = F.col("_counts")
    return table.withColumns({
        "label": majority_label(counts),
        "has_attack": F.size(attack_ids(counts)) > 0,
        "attack_ids": attack_ids(counts),
    }).drop("_counts")


def session_prefixes(session_flows: DataFrame, points, keys=("host", "session_idx"), label="label_id"):
    """Statistics and observed label of the first n_flows flows of a session, for every number of points, and
    the label of the whole session."""
    counts = class_counts_sql(label)
    cut = prefix_stats(session_flows, points, keys, "n_flows", {"_counts": counts}, {"_whole": counts})
    return cut.withColumns({
        "observed_label": majority_label(F.col("_counts")), "has_attack": F.size(attack_ids(F.col("_counts"))) > 0,
        "attack_ids": attack_ids(F.col("_counts")), "label": majority_label(F.col("_whole")),
    }).drop("_counts", "_whole")


def prepare_sessions(session_flows: DataFrame, scaler: FeatureScaler = None, keys=("host", "session_idx")):
    """(aligned flows, scaled where a scaler is given; session table on the raw values)."""
    aligned = aligned_flows(session_flows)
    table = session_table(aligned, keys)
    return (scaler.transform(aligned) if scaler else aligned), table


def split_sessions(flows: DataFrame, size=SESSION_SIZE, split_first=False, seed=42, keys=("host",),
                   order="ts", tie="flow_id"):
    """Session flows with a `split` column.

    Sessions are cut first and whole sessions are assigned, stratified by session label. With
    split_first the flows are split in hash order and each split is cut into windows of that
    order, so a session mixes flows of all hosts.
    """
    if split_first:
        shuffled = stratified_split(flows, id_column=tie, seed=seed).withColumn("_h", hash_number(seed, tie))
        return sessionize(shuffled, size, keys=("split",), order="_h", tie=tie).drop("_h")
    windows = sessionize(flows, size, keys=keys, order=order, tie=tie)
    session_keys = [*keys, "session_idx"]
    labels = windows.groupBy(*session_keys).agg(majority_label(class_counts()).alias("label"))
    # the split counts, ranks and joins the labels; a row a session is kept, so that windows are cut for them once
    labels = materialise(labels.withColumn("_sid", hash_long("session", *session_keys)), "session-labels")
    assigned = stratified_split(labels, "label", "_sid", seed=seed).select(*session_keys, "split")
    return windows.join(assigned, session_keys)


def fit_flow_scaler(train_flows: DataFrame, columns=tuple(TRAINED_FEATURES)):
    """Scaler over the aligned training flows."""
    return FeatureScaler.fit(train_flows, list(columns))
