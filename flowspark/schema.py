"""Names, sizes and small dimensions shared by every module."""

import re

import pyarrow as pa
from pyspark.sql import types as T

# The flow CSV columns in file order (header names trimmed).
RAW_FEATURES = [
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s",
    "Min Packet Length", "Max Packet Length", "Packet Length Mean", "Packet Length Std",
    "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count",
    "URG Flag Count", "CWE Flag Count", "ECE Flag Count",
    "Down/Up Ratio", "Average Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size",
    "Fwd Header Length.1",
    "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "Init_Win_bytes_forward", "Init_Win_bytes_backward", "act_data_pkt_fwd", "min_seg_size_forward",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]
RAW_LABEL = "Label"


def snake(name):
    """Column name used inside Spark for a CSV header name."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


FEATURES = [snake(n) for n in RAW_FEATURES]

# Sizes of the data contract.
N_RAW_FEATURES = 78
DROPPED_FEATURE_INDEX = 64
SESSION_SIZE = 20
N_CLASSES = 15
EMBEDDING_DIM = 256
MAX_SEQ_LEN = 60
MAX_FLOWS_PER_REQUEST = 1000
CLIP_LIMIT = 1e9
FILES_BYTE_THRESHOLD = 1_000_000
SHORT_FLOW_US = 100_000
ATTACK_GATE = 0.5
MASK_RATE = 0.15

# Protocol-view columns appended to a flow, in this order.
PROTOCOL_COLUMNS = ["log_type", "zeek_proto", "zeek_conn_state", "zeek_service"]
TRAINED_FEATURES = (
    FEATURES[:DROPPED_FEATURE_INDEX] + FEATURES[DROPPED_FEATURE_INDEX + 1:] + PROTOCOL_COLUMNS
)
N_TRAINED_FEATURES = len(TRAINED_FEATURES)

# Ports, log types and service codes.
DNS_PORTS = [53]
HTTP_PORTS = [80, 8080, 8000, 3000]
SSL_PORTS = [443, 8443, 4443]
FILES_PORTS = [21, 22, 25, 143, 993, 995, 3306, 5432]
LOG_TYPE_NAMES = {0: "conn", 1: "dns", 2: "http", 3: "ssl", 4: "files"}
SERVICE_CODES = {53: 1, 80: 2, 443: 3, 21: 4, 22: 5, 25: 6, 143: 7}
CONN_STATE_CODES = {"SF": 0, "S0": 1, "RSTO": 2, "OTH": 3}

# Class ids and names.
LABELS = {
    0: "BENIGN",
    1: "Bot",
    2: "DDoS",
    3: "DoS GoldenEye",
    4: "DoS Hulk",
    5: "DoS Slowhttptest",
    6: "DoS slowloris",
    7: "FTP-Patator",
    8: "Heartbleed",
    9: "Infiltration",
    10: "PortScan",
    11: "SSH-Patator",
    12: "Web Attack Brute Force",
    13: "Web Attack Sql Injection",
    14: "Web Attack XSS",
}

# How the separator of "Web Attack <sep> Brute Force" is spelled in the files
# (windows-1252 dash read as latin-1, double space, hyphen, UTF-8 U+FFFD read as latin-1).
LABEL_SEPARATORS = ["\x96", "", "-", "ï¿½"]
MISREAD_SEPARATOR = "ï¿½"


def label_aliases(strict=False):
    """Spelling -> class id, in match order. strict leaves the plain canonical web names out."""
    plain = {name: i for i, name in LABELS.items() if not name.startswith("Web Attack ")}
    web = {i: name[len("Web Attack "):] for i, name in LABELS.items() if name.startswith("Web Attack ")}
    aliases = dict(plain)
    for sep in LABEL_SEPARATORS:
        for i, tail in web.items():
            aliases[f"Web Attack {sep} {tail}"] = i
    if not strict:
        for i, tail in web.items():
            aliases[f"Web Attack {tail}"] = i
    return aliases


# The 26 per-session statistics in output order.
STAT_NAMES = [
    "stat_flow_count",
    "stat_total_fwd_bytes",
    "stat_total_bwd_bytes",
    "stat_avg_bytes_per_flow",
    "stat_std_bytes_per_flow",
    "stat_avg_duration",
    "stat_std_duration",
    "stat_avg_pkts_per_flow",
    "stat_std_pkts_per_flow",
    "stat_bytes_ratio",
    "stat_pkt_ratio",
    "stat_port_entropy",
    "stat_log_type_entropy",
    "stat_syn_ratio",
    "stat_fin_ratio",
    "stat_rst_ratio",
    "stat_psh_ratio",
    "stat_urg_ratio",
    "stat_avg_flow_bps",
    "stat_max_flow_bps",
    "stat_avg_flow_iat",
    "stat_std_flow_iat",
    "stat_unique_dst_ports",
    "stat_short_flow_ratio",
    "stat_avg_win_size",
    "stat_idle_active_ratio",
]
N_STATS = len(STAT_NAMES)
HYBRID_DIM = EMBEDDING_DIM + N_STATS

# Kill-chain stage of each class.
STAGES = {
    0: "N/A",
    1: "Command and Control",
    2: "Impact",
    3: "Impact",
    4: "Impact",
    5: "Impact",
    6: "Impact",
    7: "Credential Access",
    8: "Exploitation",
    9: "Lateral Movement",
    10: "Reconnaissance",
    11: "Credential Access",
    12: "Credential Access",
    13: "Exploitation",
    14: "Exploitation",
}

# Model configurations.
CONFIGS = {
    "A": "session statistics only",
    "B": "session embedding only",
    "C": "session embedding and statistics",
}

# Thresholds, truncation points and window sizes of the evaluation.
THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
TRUNCATION_POINTS = [3, 5, 8, 10, 15, 20]
ABLATION_SIZES = [10, 20, 50]

ALERT_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("alert_uuid", T.StringType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("attack_id", T.IntegerType()),
    T.StructField("attack_name", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("is_attack", T.BooleanType()),
    T.StructField("source", T.StringType()),
    T.StructField("session_id", T.LongType()),
    T.StructField("ground_truth", T.IntegerType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("n_flows", T.IntegerType()),
    T.StructField("raw", T.StringType()),
])

#: Alerts by the time they were recorded, then by their own.
ALERT_ORDER = ("recorded", "ts", "alert_uuid", "row_id")


def small_table(spark, columns):
    """A fixed dimension as a local relation; columns maps name -> (arrow type, values)."""
    table = pa.table({name: pa.array(values, type=kind) for name, (kind, values) in columns.items()})
    return spark.createDataFrame(table)


def label_dim(spark):
    return small_table(spark, {
        "attack_id": (pa.int32(), list(LABELS)),
        "attack_name": (pa.string(), list(LABELS.values())),
        "stage": (pa.string(), [STAGES[i] for i in LABELS]),
    })
