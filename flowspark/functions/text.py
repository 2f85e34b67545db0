"""Text built from or parsed into columns: retrieval queries, prompts, replies, report lines."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Search and document prefixes of the embedding task.
QUERY_PREFIX = "search_query: "
DOCUMENT_PREFIX = "search_document: "

# Clauses of the retrieval query (statistic, lower bound, text).
QUERY_CLAUSES = [
    ("stat_syn_ratio", 0.5, "High SYN flag ratio suggesting SYN flood"),
    ("stat_port_entropy", 3.0, "High destination port entropy suggesting port scanning"),
    ("stat_unique_dst_ports", 50.0, "Many unique destination ports accessed"),
    ("stat_short_flow_ratio", 0.8, "Mostly very short flows suggesting rapid connection attempts"),
    ("stat_avg_flow_bps", 1e6, "High bandwidth suggesting volumetric attack"),
    ("stat_rst_ratio", 0.3, "High RST flag count suggesting connection refusals"),
]

# Statistics shown in a prompt, with their captions.
PROMPT_STATS = [
    ("stat_syn_ratio", "SYN flag ratio"),
    ("stat_rst_ratio", "RST flag ratio"),
    ("stat_port_entropy", "Destination port entropy"),
    ("stat_unique_dst_ports", "Unique destination ports"),
    ("stat_avg_flow_bps", "Avg flow bandwidth (bps)"),
    ("stat_short_flow_ratio", "Short flow ratio (<1s)"),
    ("stat_avg_duration", "Avg flow duration (s)"),
    ("stat_flow_count", "Flows in session"),
]

# Keys of an analyst reply.
REPLY_KEYS = ["fp_likelihood", "fp_reasoning", "threat_summary", "investigation_steps", "severity_context"]
REPLY_SCHEMA = T.StructType([
    T.StructField("fp_likelihood", T.StringType()),
    T.StructField("fp_reasoning", T.StringType()),
    T.StructField("threat_summary", T.StringType()),
    T.StructField("investigation_steps", T.ArrayType(T.StringType())),
    T.StructField("severity_context", T.StringType()),
])


def kb_text() -> Column:
    """Labelled lines of a knowledge-base row, for embedding."""

    def listed(column, sep):
        return F.array_join(F.col(column), sep)

    # Captions of the lines, in order.
    lines = [
        ("ATTACK", F.col("attack_name")),
        ("CATEGORY", F.col("category")),
        ("SEVERITY", F.col("severity")),
        ("DESCRIPTION", F.col("description")),
        ("MITRE TACTICS", listed("mitre_tactics", ", ")),
        ("MITRE TECHNIQUES", listed("techniques", ", ")),
        ("ZEEK LOG INDICATORS", listed("zeek_indicators", "; ")),
        ("NETWORK IOCS", listed("network_iocs", "; ")),
        ("RESPONSE ACTIONS", listed("response_actions", "; ")),
        ("TAGS", listed("tags", ", ")),
    ]
    return F.concat_ws("\n", *[F.concat(F.lit(f"{caption}: "), value) for caption, value in lines])


def retrieval_query(attack_name: Column, stats=F.col) -> Column:
    """Sentence about a detection: the class and one clause per conspicuous statistic."""
    clauses = [F.when(stats(name) > bound, F.lit(text)) for name, bound, text in QUERY_CLAUSES]
    return F.concat_ws(". ", F.concat(F.lit("Detected attack type: "), attack_name), *clauses)


def with_prefix(text: Column, is_query=False) -> Column:
    return F.concat(F.lit(QUERY_PREFIX if is_query else DOCUMENT_PREFIX), text)


def percent(value: Column) -> Column:
    return F.concat(fixed(value * 100, 1), F.lit("%"))


def fixed(value: Column, digits) -> Column:
    """Fixed-point text with the given number of decimals."""
    return F.round(value, digits).cast(f"decimal(38,{digits})").cast("string")


def prompt_text(attack_name: Column, conf: Column, predictions: Column, context: Column, stats) -> Column:
    """User message for an analyst model.

    predictions is an array of top_predictions structs; stats maps a statistic name to a column,
    names it lacks are left out, and so are zero values.
    """
    named = F.array_join(F.transform(F.slice(predictions, 1, 3), lambda p: F.concat(
        p["attack_name"], F.lit(" ("), percent(p["probability"]), F.lit(")")
    )), ", ")
    shown = [
        F.when(stats[name] != 0, F.concat(F.lit(f"  {caption}: "), fixed(stats[name], 4)))
        for name, caption in PROMPT_STATS if name in stats
    ]
    block = F.concat_ws("\n", *shown) if shown else F.lit("")
    block = F.when(block == "", F.lit("  (no session statistics available)")).otherwise(block)
    snippet = F.when(F.length(context) > 0, F.substring(context, 1, 600)).otherwise(F.lit("(no KB context)"))
    # The layout of the message.
    return F.concat(
        F.lit("DETECTION RESULT:\n  Attack type : "), attack_name,
        F.lit("\n  Confidence  : "), percent(conf),
        F.lit("\n  Top ML preds: "), named,
        F.lit("\n\nSESSION STATISTICS:\n"), block,
        F.lit("\n\nTHREAT KNOWLEDGE BASE CONTEXT:\n"), snippet,
        F.lit("\n\nProvide your SOC analyst assessment as JSON."),
    )


def strip_code_fence(raw: Column) -> Column:
    """Reply text without a surrounding ``` block."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    opened = F.regexp_replace(text, r"^```[^\n]*(\n|$)", "")
    closed = F.regexp_replace(opened, r"(^|\n)[^\S\n]*```[^\S\n]*$", "")
    return F.when(F.startswith(text, F.lit("```")), closed).otherwise(text)


def parse_reply(raw: Column) -> Column:
    """Struct of the reply's fields plus `valid` and the list of missing keys.

    Text that is not a JSON object gives valid=false and null fields.
    """
    text = strip_code_fence(raw)
    keys = F.json_object_keys(text)
    # json_object_keys stops at the first object; a full parse must succeed too.
    valid = keys.isNotNull() & F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}).isNotNull()
    data = F.from_json(text, REPLY_SCHEMA, {"mode": "PERMISSIVE"})
    wanted = F.array(*[F.lit(k) for k in REPLY_KEYS])
    missing = F.array_except(wanted, F.coalesce(keys, F.array().cast("array<string>")))
    return F.struct(
        F.coalesce(valid, F.lit(False)).alias("valid"),
        F.when(valid, missing).alias("missing_keys"),
        *[F.when(valid, data[k]).alias(k) for k in REPLY_KEYS],
    )


def promote_reply(reply: Column, description: Column):
    """Columns an alert takes over from a parsed reply; nothing changes without a valid one."""
    summary = F.when(F.length(reply["threat_summary"]) > 0, reply["threat_summary"])
    return {
        "fp_likelihood": F.when(reply["valid"], F.coalesce(reply["fp_likelihood"], F.lit("UNKNOWN"))),
        "fp_reasoning": F.when(reply["valid"], F.coalesce(reply["fp_reasoning"], F.lit(""))),
        "description": F.coalesce(summary, description),
    }


def technique_root(code: Column) -> Column:
    """T1499 of "T1499.002 - Service Exhaustion Flood"."""
    return F.regexp_extract(code, r"^[^ .]+", 0)


def comparison_line(config: Column, values, auc: Column) -> Column:
    """Fixed-width text row of a configuration table."""
    cells = [F.rpad(config, 30, " ")]
    widths = [10, 8, 8, 10, 8]
    cells += [F.lpad(fixed(v, 4), w, " ") for v, w in zip(values, widths)]
    cells.append(F.lpad(fixed(F.coalesce(auc, F.lit(0.0)), 4), 8, " "))
    return F.concat_ws(" ", *cells)


def kpi_band(value: Column) -> Column:
    """Colour band of a headline number."""
    return F.when(value >= 0.9, "green").when(value >= 0.7, "yellow").otherwise("red")


def schema_hash(names: Column) -> Column:
    """First 16 hex characters of the sha256 of the names joined by "|"."""
    return F.substring(F.sha2(F.array_join(names, "|"), 256), 1, 16)


def explanation_report(attack_name: Column, conf: Column, features: Column, events: Column) -> Column:
    """Report text from the top features (feature, importance, value) and events (pos, weight)."""
    signed = lambda v: F.concat(F.when(v >= 0, "+").otherwise(""), fixed(v, 4))
    feature_lines = F.transform(F.slice(features, 1, 10), lambda f: F.concat(
        F.lit("  "), F.rpad(f["feature"], 40, " "), F.lit("  contribution="), signed(f["importance"]),
        F.lit("  value="), fixed(f["value"], 4),
    ))
    event_lines = F.transform(F.slice(events, 1, 5), lambda e: F.concat(
        F.lit("  Event index "), F.lpad(e["pos"].cast("string"), 3, " "),
        F.lit("  weight="), fixed(e["weight"], 4),
    ))
    return F.concat_ws(
        "\n", F.lit("EXPLANATION REPORT"),
        F.concat(F.lit("Detected: "), attack_name, F.lit("  (confidence: "), percent(conf), F.lit(")")),
        F.lit(""), F.lit("Feature contributions"), F.array_join(feature_lines, "\n"),
        F.lit(""), F.lit("Events with the highest weight"), F.array_join(event_lines, "\n"),
    )
