"""Registered queries: name -> (function(spark, sf_dir), DuckDB statement or None)."""


def all_queries():
    from flowspark.catalog import (
        alert_queries, flow_queries, metric_queries, model_queries, sample_queries, session_queries,
        source_queries, stream_queries, threat_queries,
    )

    found = {}
    modules = (
        flow_queries, session_queries, sample_queries, metric_queries, alert_queries, threat_queries,
        model_queries, source_queries, stream_queries,
    )
    for module in modules:
        for name, pair in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = pair
    return found
