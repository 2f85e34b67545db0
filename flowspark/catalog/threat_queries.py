"""Queries over the knowledge base, retrieval texts and vectors."""

from pyspark.sql import functions as F

from flowspark.catalog.adapters import (
    ENRICHED_CTE, PREDICTIONS_CTE, predictions, sessions_cte, table,
)
from flowspark.catalog.session_queries import KEYS, windows
from flowspark.functions.labels import label_name
from flowspark.functions.scores import confidence, top_predictions, truncate_vector
from flowspark.functions.text import DOCUMENT_PREFIX, QUERY_PREFIX, kb_text, parse_reply, promote_reply, prompt_text, retrieval_query
from flowspark.knowledge import TACTICS, TECHNIQUES, TRUTH, entries, knowledge_base
from flowspark.operators import threat as T
from flowspark.operators.metrics import class_counts_from, confusion_counts
from flowspark.operators.nearest_join import nearest_join
from flowspark.operators.neighbors import hit_rows, nearest, nearest_in_large
from flowspark.operators.stats import session_stats
from flowspark.plans.enrich import KnowledgeSearch, enrich_alerts
from flowspark.schema import LABELS, STAT_NAMES


def _detections(spark, sf_dir):
    """Predictions as detections; classes 15 and 16 are unknown to the knowledge base."""
    preds = predictions(spark, sf_dir)
    class_id = F.when(F.col("session_id") % 50 == 0, 15).otherwise(F.col("y_pred"))
    return preds.select("session_id", class_id.alias("attack_id"), "probs")


def kb_join(spark, sf_dir):
    found = T.join_knowledge_base(_detections(spark, sf_dir))
    return found.select(
        "session_id", "attack_id", "attack_name", "severity", "category",
        F.size("techniques").cast("bigint").alias("n_techniques"), F.array_join("mitre_tactics", "|").alias("tactics"),
        F.length("description").cast("bigint").alias("description_length"),
    )


def threat_intel(spark, sf_dir):
    rows = _detections(spark, sf_dir).withColumn("attack_name", label_name(F.col("attack_id")))
    found = T.add_threat_intel(rows)
    intel = F.col("threat_intelligence")
    return found.select(
        "session_id", intel["severity"].alias("severity"), F.array_join(intel["techniques"], "|").alias("techniques"),
        F.array_join(intel["tags"], "|").alias("tags"), intel.isNull().alias("no_intel"),
    )


def kb_texts(spark, sf_dir):
    """Embedding text of each entry with the detections of its class."""
    counts = predictions(spark, sf_dir).groupBy(F.col("y_pred").alias("attack_id")).agg(F.count("*").alias("n"))
    texts = knowledge_base(spark).select("attack_id", kb_text().alias("text"))
    return counts.join(F.broadcast(texts), "attack_id")


def _session_rows(spark, sf_dir):
    """Sessions as detections: statistics, a called class and probabilities over two classes."""
    stats = session_stats(windows(spark, sf_dir), KEYS)
    called = F.when(F.col("stat_short_flow_ratio") > 0.47, F.lit(4)).otherwise(F.lit(10))
    share = F.round(F.col("stat_short_flow_ratio"), 6)
    probs = F.array(*[
        share if c == 4 else (F.lit(1.0) - share if c == 10 else F.lit(0.0)) for c in range(15)
    ])
    return stats.withColumns({"attack_id": called, "probs": probs})


def query_text(spark, sf_dir):
    rows = _session_rows(spark, sf_dir)
    return rows.select(*KEYS, retrieval_query(label_name(F.col("attack_id"))).alias("query_text"))


def prompts(spark, sf_dir):
    """Prompts without statistics that differ in the last digit between engines."""
    rows = T.join_knowledge_base(_session_rows(spark, sf_dir).select(*KEYS, "attack_id", "probs", *STAT_NAMES))
    shown = {n: F.round(F.col(n), 6) for n in ("stat_unique_dst_ports", "stat_short_flow_ratio", "stat_flow_count")}
    text = prompt_text(
        F.col("attack_name"), confidence(F.col("probs"), F.col("attack_id")),
        top_predictions(F.col("probs"), 3), F.col("description"), shown,
    )
    return rows.select(*KEYS, text.alias("prompt"))


def _replies(spark, sf_dir):
    """Chat turns as analyst replies: fenced JSON, bare JSON that lacks keys, or the plain text."""
    turns = table(spark, sf_dir, "conversations")
    complete = F.to_json(F.struct(
        F.lit("LOW").alias("fp_likelihood"), F.lit("seen before").alias("fp_reasoning"), F.col("text").alias("threat_summary"),
        F.array(F.lit("look"), F.lit("act")).alias("investigation_steps"), F.lit("small").alias("severity_context"),
    ))
    partial = F.to_json(F.struct(F.lit("").alias("threat_summary"), F.lit("x").alias("other")))
    raw = (
        F.when(F.col("role") == "assistant", F.concat(F.lit("```json\n"), complete, F.lit("\n```")))
        .when(F.col("role") == "user", F.concat(F.lit("  "), partial))
        .otherwise(F.col("text"))
    )
    return turns.withColumn("reply", parse_reply(raw))


def parsed(spark, sf_dir):
    r = F.col("reply")
    return _replies(spark, sf_dir).select(
        "conv_id", "turn", r["valid"].alias("valid"), F.array_join(r["missing_keys"], ",").alias("missing_keys"),
        r["threat_summary"].alias("threat_summary"), F.size(r["investigation_steps"]).cast("bigint").alias("n_steps"),
    )


def promoted(spark, sf_dir):
    rows = _replies(spark, sf_dir).withColumn("description", F.lit("from the knowledge base"))
    return rows.withColumns(promote_reply(F.col("reply"), F.col("description"))).select(
        "conv_id", "turn", "fp_likelihood", "fp_reasoning", "description"
    )


def _centroids(spark, sf_dir):
    """Mean vector of each label: as many rows as there are labels."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy("label").agg(F.transform(ordered, lambda p: p["m"]).alias("embedding"))


def vector_topk(spark, sf_dir):
    """The five vectors nearest to each label's mean, among all vectors."""
    found = nearest_in_large(
        table(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir), 5, "vec_id", "embedding", "label", "embedding"
    )
    return found.select(F.col("query_id").alias("label"), F.col("id").alias("vec_id"), "rank", F.round("distance", 6).alias("distance"))


def vector_topk_filtered(spark, sf_dir):
    """The same among vectors of even labels only."""
    found = nearest_in_large(
        table(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir), 5, "vec_id", "embedding", "label", "embedding",
        where=F.col("label") % 2 == 0,
    )
    return found.select(F.col("query_id").alias("label"), F.col("id").alias("vec_id"), "rank", F.round("distance", 6).alias("distance"))


def vector_nearest_class(spark, sf_dir):
    """The three label means nearest to every vector."""
    found = nearest(
        table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _centroids(spark, sf_dir), 3,
        index_id="label",
    )
    return hit_rows(found, ["vec_id"]).select(
        "vec_id", F.col("rank").cast("bigint").alias("rank"), F.col("id").alias("label"),
        F.round("distance", 6).alias("distance"),
    )


def vector_join(spark, sf_dir):
    """The five vectors nearest to every vector, both sides taken as large."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = nearest_join(vectors, vectors, 5, "vec_id", "embedding", "vec_id", "embedding")
    return found.select(F.col("query_id").alias("vec_id"), F.col("id").alias("near_id"), "rank", F.round("distance", 6).alias("distance"))


def vector_truncate(spark, sf_dir):
    """Vectors cut to 16 entries: their length and squared norm show that nothing is rescaled."""
    cut = truncate_vector(F.col("embedding"), 16)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", cut.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.select("vec_id", F.size("v").cast("bigint").alias("dims"), F.round(norm, 6).alias("squared_norm"))


def _search(spark):
    return KnowledgeSearch.build(spark)


def text_search(spark, sf_dir):
    """The three knowledge-base entries nearest to every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = _search(spark).search(docs, "text", 3)
    return hit_rows(found, ["doc_id"]).select(
        "doc_id", "rank", F.col("id").alias("attack_id"), F.round("distance", 6).alias("distance")
    )


def text_search_severity(spark, sf_dir):
    """The two entries of high severity nearest to every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = _search(spark).search(docs, "text", 2, severity="HIGH")
    return hit_rows(found, ["doc_id"]).select(
        "doc_id", "rank", F.col("id").alias("attack_id"), F.round("distance", 6).alias("distance")
    )


def _called_names(spark, sf_dir):
    """Names of the attacks that flows were called, with the number of flows."""
    called = predictions(spark, sf_dir).filter("y_pred <> 0")
    return called.groupBy(label_name(F.col("y_pred")).alias("query")).agg(F.count("*").alias("n"))


def _named(spark, sf_dir):
    """Every class but the first, as top_predictions over all 15 classes names each once per flow."""
    named = predictions(spark, sf_dir).select(F.explode(top_predictions(F.col("probs"), 15)).alias("p"))
    names = named.groupBy(F.col("p.attack_name").alias("query")).agg(F.count("*").alias("n"))
    return names.filter(F.col("query") != LABELS[0])


def threat_lookup(spark, sf_dir):
    """The entries found for the name of every class, with the number of flows that name it."""
    found = _search(spark).lookup(_named(spark, sf_dir))
    return found.select("query", "n", "attack_id", "top_result", F.size("similar_threats").alias("n_similar"))


def lookup_precision(spark, sf_dir):
    return T.precision_at_1(_search(spark).lookup(_called_names(spark, sf_dir)))


def enriched_alerts(spark, sf_dir):
    found = enrich_alerts(_session_rows(spark, sf_dir), _search(spark))
    hits = F.transform("retrieved", lambda h: F.concat_ws(":", h["id"].cast("string"), F.round(h["distance"], 6).cast("string")))
    return found.select(
        *KEYS, "attack_id", "attack_name", "severity", F.array_join(hits, ",").alias("retrieved"),
        F.array_join("rag_context", "|").alias("context"), F.get("top_predictions", F.lit(0))["attack_id"].alias("first_id"),
        F.size("techniques").alias("n_techniques"),
    )


def _classes(spark, sf_dir):
    counts = class_counts_from(confusion_counts(predictions(spark, sf_dir)), all_classes=True)
    return counts.select("class_id", "support")


def technique_coverage(spark, sf_dir):
    return T.technique_coverage(_classes(spark, sf_dir)).withColumn(
        "technique_overlap", F.col("technique_overlap").cast("bigint")
    )


def coverage_totals(spark, sf_dir):
    found = T.coverage_totals(_classes(spark, sf_dir))
    return found.withColumns({c: F.col(c).cast("bigint") for c in found.columns if found.schema[c].dataType.simpleString() == "int"})


def _with_config(spark, sf_dir):
    preds = predictions(spark, sf_dir)
    return preds.withColumn("config", F.lit("C")).unionByName(
        preds.withColumn("config", F.lit("B")).withColumn("y_pred", F.lit(10))
    )


def mapping_rows(spark, sf_dir):
    return T.mapping_by_class(_with_config(spark, sf_dir))


def mapping_consistency(spark, sf_dir):
    return T.mapping_consistency(_with_config(spark, sf_dir))


_NAMES = "[" + ", ".join(f"'{n}'" for n in LABELS.values()) + "]"


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def _kb_cte():
    rows = []
    for e in entries():
        text = ", ".join("'" + str(e[c]).replace("'", "''") + "'" for c in ("attack_name", "category", "severity", "description"))
        lists = ", ".join(_list(e[c]) for c in ("techniques", "zeek_indicators", "network_iocs", "response_actions", "mitre_tactics", "tags"))
        rows.append(f"({e['attack_id']}, {text}, {lists})")
    return ("kb(kb_id, kb_name, category, severity, description, techniques, zeek_indicators, network_iocs, "
            f"response_actions, mitre_tactics, tags) AS (VALUES {', '.join(rows)})")


def _root_cte():
    roots = lambda codes: _list(dict.fromkeys(c.split(".")[0] for c in codes))
    rows = ", ".join(
        f"({i}, '{LABELS[i]}', {_list(TACTICS[i])}, {_list(TRUTH[i][0])}, {roots(TECHNIQUES[i])}, {roots(TRUTH[i][1])}, {len(TRUTH[i][1])})"
        for i in LABELS
    )
    return f"""dim(class_id, attack_name, kb_tactics, true_tactics, kb_roots, true_roots, n_true) AS (VALUES {rows}),
cov AS (SELECT *, len(list_intersect(true_tactics, kb_tactics)) AS both_tactics, len(list_intersect(true_roots, kb_roots)) AS overlap FROM dim),
rec AS (SELECT *, round(CASE WHEN len(true_tactics) > 0 THEN both_tactics / CAST(len(true_tactics) AS DOUBLE) ELSE 1e0 END, 4) AS tactic_recall,
  round(overlap / CAST(greatest(n_true, 1) AS DOUBLE), 4) AS technique_recall FROM cov)"""


_P = f"WITH {PREDICTIONS_CTE}"
_D = f"""{_P},
{_kb_cte()},
d AS (SELECT session_id, CASE WHEN session_id % 50 = 0 THEN 15 ELSE y_pred END AS attack_id FROM preds)"""

_SESSION_ROWS = f"""
WITH {ENRICHED_CTE}{sessions_cte()},
st AS (SELECT host, session_idx,
  sum(syn_flag_count) / sum(fin_flag_count + syn_flag_count + rst_flag_count + psh_flag_count + urg_flag_count + 1e-9) AS syn,
  sum(rst_flag_count) / sum(fin_flag_count + syn_flag_count + rst_flag_count + psh_flag_count + urg_flag_count + 1e-9) AS rst,
  entropy(CAST(destination_port AS BIGINT)) AS pe, count(DISTINCT destination_port) AS ports,
  avg(CASE WHEN flow_duration < 100000 THEN 1e0 ELSE 0e0 END) AS short, avg(least(greatest(flow_bytes_s, 0e0), 1e8)) AS bps
  FROM session_flows GROUP BY ALL),
called AS (SELECT *, CASE WHEN short > 0.47e0 THEN 'DoS Hulk' ELSE 'PortScan' END AS name FROM st)"""

_CENTROIDS = """
WITH c AS (SELECT label, list(m ORDER BY i) AS centre FROM
  (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL) GROUP BY 1)"""
_DISTANCE = "1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre)"


def _topk_sql(where=""):
    return f"""{_CENTROIDS},
d AS (SELECT c.label, vec_id, round({_DISTANCE}, 9) AS distance FROM embeddings e, c {where}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS INT) AS rank FROM d)
SELECT label, vec_id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 5"""


def _prompt_sql():
    text = {e["attack_name"]: e["description"].replace("'", "''") for e in entries()}
    return f"""{_SESSION_ROWS},
p AS (SELECT *, round(short, 6) AS s, CASE WHEN name = 'DoS Hulk' THEN round(short, 6) ELSE 1 - round(short, 6) END AS conf FROM called),
q AS (SELECT *, CASE WHEN s > 0.5 OR (s = 0.5) THEN 'DoS Hulk' ELSE 'PortScan' END AS n1, greatest(s, 1 - s) AS p1, least(s, 1 - s) AS p2 FROM p)
SELECT host, session_idx, 'DETECTION RESULT:' || chr(10) || '  Attack type : ' || name || chr(10)
  || '  Confidence  : ' || printf('%.1f', round(conf * 100, 1)) || '%' || chr(10) || '  Top ML preds: '
  || CASE WHEN p2 = 0 THEN CASE WHEN s = 1 THEN 'DoS Hulk (100.0%), BENIGN (0.0%), Bot (0.0%)' ELSE 'PortScan (100.0%), BENIGN (0.0%), Bot (0.0%)' END
     ELSE n1 || ' (' || printf('%.1f', round(p1 * 100, 1)) || '%), ' || CASE n1 WHEN 'DoS Hulk' THEN 'PortScan' ELSE 'DoS Hulk' END
          || ' (' || printf('%.1f', round(p2 * 100, 1)) || '%), BENIGN (0.0%)' END
  || chr(10) || chr(10) || 'SESSION STATISTICS:' || chr(10) || '  Unique destination ports: ' || printf('%.4f', CAST(ports AS DOUBLE))
  || CASE WHEN s <> 0 THEN chr(10) || '  Short flow ratio (<1s): ' || printf('%.4f', s) ELSE '' END
  || chr(10) || '  Flows in session: 20.0000' || chr(10) || chr(10) || 'THREAT KNOWLEDGE BASE CONTEXT:' || chr(10)
  || CASE name WHEN 'DoS Hulk' THEN '{text["DoS Hulk"]}' ELSE '{text["PortScan"]}' END
  || chr(10) || chr(10) || 'Provide your SOC analyst assessment as JSON.' AS prompt FROM q"""


def _search_ctes(where="true"):
    """Cosines of weighted words of every asked(doc_id, text) against every entry: r(doc_id, id, distance, rank)."""
    split = r"[^\p{L}\p{N}.]+"
    return f"""
e AS (SELECT kb_id AS id, severity, {_KB_TEXT} AS body FROM kb),
ew AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest(string_split_regex(lower('{DOCUMENT_PREFIX}' || body), '{split}')) AS word FROM e)
  WHERE word <> '' GROUP BY 1, 2),
i AS (SELECT word, ln((SELECT count(*) + 1 FROM e) / CAST(count(*) + 1 AS DOUBLE)) AS idf FROM ew GROUP BY 1),
l AS (SELECT id, sqrt(sum(tf * idf * tf * idf)) AS length FROM ew JOIN i USING (word) GROUP BY 1),
p AS (SELECT ew.word, idf, id, tf * idf / length AS weight FROM ew JOIN i USING (word) JOIN l USING (id)),
q AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id,
  unnest(string_split_regex(lower('{QUERY_PREFIX}' || coalesce(text, '')), '{split}')) AS word FROM asked) WHERE word <> '' GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(power(tf * coalesce(idf, ln((SELECT count(*) + 1 FROM e))), 2))) AS length FROM q LEFT JOIN i USING (word) GROUP BY 1),
s AS (SELECT doc_id, id, sum(tf * idf * weight) AS product FROM q JOIN p USING (word) GROUP BY 1, 2),
far AS (SELECT n.doc_id, e.id, body, round(1 - coalesce(product, 0) / n.length, 9) AS distance FROM n CROSS JOIN e
  LEFT JOIN s ON s.doc_id = n.doc_id AND s.id = e.id WHERE {where}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY distance, id) - 1 AS INT) AS rank FROM far)"""


def _search_sql(k, where="true"):
    return f"""WITH {_kb_cte()},
asked AS (SELECT doc_id, text FROM documents),{_search_ctes(where)}
SELECT doc_id, rank, CAST(id AS INT) AS attack_id, round(distance, 6) AS distance FROM r WHERE rank < {k}"""


_SENTENCE = """'Detected attack type: ' || name
  || CASE WHEN syn > 0.5 THEN '. High SYN flag ratio suggesting SYN flood' ELSE '' END
  || CASE WHEN pe > 3 THEN '. High destination port entropy suggesting port scanning' ELSE '' END
  || CASE WHEN ports > 50 THEN '. Many unique destination ports accessed' ELSE '' END
  || CASE WHEN short > 0.8e0 THEN '. Mostly very short flows suggesting rapid connection attempts' ELSE '' END
  || CASE WHEN bps > 1e6 THEN '. High bandwidth suggesting volumetric attack' ELSE '' END
  || CASE WHEN rst > 0.3 THEN '. High RST flag count suggesting connection refusals' ELSE '' END"""

_KB_TEXT = """'ATTACK: ' || kb_name || chr(10) || 'CATEGORY: ' || category || chr(10)
  || 'SEVERITY: ' || severity || chr(10) || 'DESCRIPTION: ' || description || chr(10)
  || 'MITRE TACTICS: ' || array_to_string(mitre_tactics, ', ') || chr(10)
  || 'MITRE TECHNIQUES: ' || array_to_string(techniques, ', ') || chr(10)
  || 'ZEEK LOG INDICATORS: ' || array_to_string(zeek_indicators, '; ') || chr(10)
  || 'NETWORK IOCS: ' || array_to_string(network_iocs, '; ') || chr(10)
  || 'RESPONSE ACTIONS: ' || array_to_string(response_actions, '; ') || chr(10)
  || 'TAGS: ' || array_to_string(tags, ', ')"""

QUERIES = {
    "kb_join": (kb_join, f"""{_D}
SELECT session_id, attack_id, coalesce(kb_name, 'Unknown (' || attack_id || ')') AS attack_name,
  coalesce(severity, 'UNKNOWN') AS severity, category, coalesce(len(techniques), 0) AS n_techniques,
  coalesce(array_to_string(mitre_tactics, '|'), '') AS tactics, coalesce(length(description), 0) AS description_length
FROM d LEFT JOIN kb ON attack_id = kb_id"""),
    "threat_intel": (threat_intel, f"""{_D}
SELECT session_id, CASE WHEN attack_id <> 0 THEN coalesce(severity, 'UNKNOWN') END AS severity,
  CASE WHEN attack_id <> 0 THEN coalesce(array_to_string(techniques[1:3], '|'), '') END AS techniques,
  CASE WHEN attack_id <> 0 THEN coalesce(array_to_string(tags[1:8], '|'), '') END AS tags, attack_id = 0 AS no_intel
FROM d LEFT JOIN kb ON attack_id = kb_id"""),
    "kb_text": (kb_texts, f"""{_D}
SELECT y_pred AS attack_id, count(*) AS n, any_value({_KB_TEXT}) AS text
FROM preds JOIN kb ON y_pred = kb_id GROUP BY 1"""),
    "rag_query_text": (query_text, f"""{_SESSION_ROWS}
SELECT host, session_idx, {_SENTENCE} AS query_text
FROM called"""),
    "prompt_text": (prompts, _prompt_sql()),
    "response_parse": (parsed, """
SELECT conv_id, turn, role IN ('assistant', 'user') AS valid,
  CASE role WHEN 'assistant' THEN '' WHEN 'user' THEN 'fp_likelihood,fp_reasoning,investigation_steps,severity_context' END AS missing_keys,
  CASE role WHEN 'assistant' THEN text WHEN 'user' THEN '' END AS threat_summary,
  CASE role WHEN 'assistant' THEN CAST(2 AS BIGINT) END AS n_steps FROM conversations"""),
    "response_promote": (promoted, """
SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'LOW' WHEN 'user' THEN 'UNKNOWN' END AS fp_likelihood,
  CASE role WHEN 'assistant' THEN 'seen before' WHEN 'user' THEN '' END AS fp_reasoning,
  CASE WHEN role = 'assistant' AND length(text) > 0 THEN text ELSE 'from the knowledge base' END AS description FROM conversations"""),
    "vector_topk": (vector_topk, _topk_sql()),
    "vector_topk_filtered": (vector_topk_filtered, _topk_sql("WHERE e.label % 2 = 0")),
    "vector_nearest_class": (vector_nearest_class, f"""{_CENTROIDS},
d AS (SELECT vec_id, c.label, round({_DISTANCE}, 9) AS distance FROM embeddings e, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, label) - 1 AS rank FROM d)
SELECT vec_id, rank, label, round(distance, 6) AS distance FROM r WHERE rank < 3"""),
    "vector_join_topk": (vector_join, """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS near_id, round(1 - list_cosine_similarity(a.e, b.e), 9) AS distance FROM v a, v b),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, near_id) AS INT) AS rank FROM d)
SELECT vec_id, near_id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 5"""),
    "vector_truncate": (vector_truncate, """
SELECT vec_id, CAST(16 AS BIGINT) AS dims,
  round(list_sum(list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS squared_norm FROM embeddings"""),
    "text_search": (text_search, _search_sql(3)),
    "text_search_severity": (text_search_severity, _search_sql(2, "severity = 'HIGH'")),
    # Every class name finds its own entry.
    "threat_lookup": (threat_lookup, f"""{_P}
SELECT CAST(i AS INT) AS attack_id, {_NAMES}[i + 1] AS query, {_NAMES}[i + 1] AS top_result, (SELECT count(*) FROM preds) AS n,
  CAST(3 AS INT) AS n_similar FROM range(1, 15) r(i)"""),
    "lookup_precision": (lookup_precision, f"""{_P}
SELECT count(DISTINCT y_pred) AS correct, count(DISTINCT y_pred) AS total, 1e0 AS precision_at_1 FROM preds WHERE y_pred <> 0"""),
    "alert_enrichment": (enriched_alerts, f"""{_SESSION_ROWS}, {_kb_cte()},
said AS (SELECT *, {_SENTENCE} AS query_text FROM called),
asked AS (SELECT DISTINCT query_text AS doc_id, query_text AS text FROM said),{_search_ctes()},
h AS (SELECT doc_id AS query_text, string_agg(id || ':' || round(distance, 6), ',' ORDER BY rank) FILTER (rank < 3) AS retrieved,
  string_agg(substr(body, 1, 400), '|' ORDER BY rank) FILTER (rank < 2) AS context FROM r GROUP BY 1)
SELECT host, session_idx, CAST(CASE name WHEN 'DoS Hulk' THEN 4 ELSE 10 END AS INT) AS attack_id, name AS attack_name,
  CASE name WHEN 'DoS Hulk' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, retrieved, context,
  CAST(CASE WHEN round(short, 6) >= 0.5 THEN 4 ELSE 10 END AS INT) AS first_id,
  CAST(CASE name WHEN 'DoS Hulk' THEN 2 ELSE 3 END AS INT) AS n_techniques FROM said JOIN h USING (query_text)"""),
    "technique_coverage": (technique_coverage, f"""{_P},
{_root_cte()}
SELECT CAST(class_id AS INT) AS class_id, (SELECT count(*) FROM preds WHERE y_true = class_id) AS support, attack_name, tactic_recall,
  overlap AS technique_overlap, technique_recall FROM rec"""),
    "coverage_totals": (coverage_totals, f"""
WITH {_root_cte()},
s AS (SELECT list_distinct(flatten(list(kb_tactics))) AS kt, list_distinct(flatten(list(true_tactics))) AS gt,
  list_distinct(flatten(list(kb_roots))) AS kx, list_distinct(flatten(list(true_roots))) AS gx,
  round(avg(tactic_recall), 4) AS mean_tactic_recall, round(avg(technique_recall), 4) AS mean_technique_recall FROM rec)
SELECT len(kt) AS kb_tactics, len(gt) AS true_tactics, len(list_intersect(kt, gt)) AS shared_tactics,
  round(len(list_intersect(kt, gt)) / CAST(len(gt) AS DOUBLE), 4) AS tactic_coverage,
  len(kx) AS kb_techniques, len(gx) AS true_techniques, len(list_intersect(kx, gx)) AS shared_techniques,
  round(len(list_intersect(kx, gx)) / CAST(len(gx) AS DOUBLE), 4) AS technique_coverage,
  mean_tactic_recall, mean_technique_recall FROM s"""),
    "mapping_by_class": (mapping_rows, f"""{_P},
{_root_cte()},
c AS (SELECT 'C' AS config, y_true, y_pred FROM preds UNION ALL SELECT 'B', y_true, 10 FROM preds),
ids AS (SELECT config, y_true AS class_id FROM c UNION SELECT config, y_pred FROM c),
a AS (SELECT config, y_true AS class_id, count(*) FILTER (y_true = y_pred) / CAST(count(*) AS DOUBLE) AS r FROM c GROUP BY ALL)
SELECT config, CAST(class_id AS INT) AS class_id, attack_name, round(coalesce(r, 0), 4) AS detection_recall,
  overlap > 0 AS technique_match, both_tactics > 0 AS tactic_match
FROM ids JOIN rec USING (class_id) LEFT JOIN a USING (config, class_id) WHERE class_id <> 0"""),
    "mapping_consistency": (mapping_consistency, f"""{_P},
{_root_cte()},
c AS (SELECT 'C' AS config, y_true, y_pred FROM preds UNION ALL SELECT 'B', y_true, 10 FROM preds),
ids AS (SELECT config, y_true AS class_id FROM c UNION SELECT config, y_pred FROM c)
SELECT config, round(avg(CASE WHEN overlap > 0 THEN 1e0 ELSE 0e0 END), 4) AS technique_consistency_rate, count(*) AS n_attacks_evaluated
FROM ids JOIN rec USING (class_id) WHERE class_id <> 0 GROUP BY config"""),
}

