"""SQL surface: the log and the dimensions as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenledger.plans.fixtures import Dims

#: statements of the documented reports, over the views below
REPORTS = {
    "spend_by_model": """
        SELECT model, COUNT(*) AS requests, SUM(input_tokens) AS input_tokens, SUM(output_tokens) AS output_tokens,
               CAST(SUM(total_cost) AS DECIMAL(38,8)) AS total_cost FROM llm_requests GROUP BY model ORDER BY total_cost DESC, model""",
    "daily_spend": """
        SELECT DATE(created_at) AS date, COUNT(*) AS requests, CAST(SUM(total_cost) AS DECIMAL(38,8)) AS total_cost
        FROM llm_requests GROUP BY 1 ORDER BY date DESC LIMIT 30""",
    "spend_by_api_key": """
        SELECT k.name AS key_name, COUNT(*) AS requests, CAST(SUM(r.total_cost) AS DECIMAL(38,8)) AS total_cost
        FROM llm_requests r JOIN api_keys k ON k.id = r.api_key_id GROUP BY k.id, k.name ORDER BY total_cost DESC""",
    "spend_by_metadata": """
        SELECT raw_metadata['user-id'] AS user_id, COUNT(*) AS requests, CAST(SUM(total_cost) AS DECIMAL(38,8)) AS total_cost
        FROM llm_requests WHERE raw_metadata['user-id'] IS NOT NULL GROUP BY 1""",
    "user_cost_in_feature": """
        SELECT raw_metadata['user-id'] AS user_id, COUNT(*) AS requests, CAST(SUM(total_cost) AS DECIMAL(38,8)) AS total_cost
        FROM llm_requests WHERE raw_metadata['feature'] = 'purchase' GROUP BY 1""",
    "spend_by_proxy_key": """
        SELECT p.name AS proxy_key_name, COUNT(*) AS requests, CAST(SUM(r.total_cost) AS DECIMAL(38,8)) AS total_cost
        FROM llm_requests r JOIN proxy_keys p ON p.id = r.proxy_key_id GROUP BY p.id, p.name""",
    "latest_request": """
        SELECT model, input_tokens, output_tokens, total_cost FROM llm_requests ORDER BY created_at DESC, id DESC LIMIT 1""",
    "cost_by_step": """
        SELECT raw_metadata['step'] AS step, CAST(AVG(total_cost) AS DECIMAL(38,6)) AS avg_cost,
               CAST(SUM(total_cost) AS DECIMAL(38,8)) AS total_cost
        FROM llm_requests WHERE raw_metadata['feature'] = 'click' GROUP BY 1""",
    "unpriced_models": """
        SELECT model, COUNT(*) AS requests, SUM(input_tokens) AS input_tokens, SUM(output_tokens) AS output_tokens,
               MIN(requested_at) AS first_seen, MAX(requested_at) AS last_seen
        FROM llm_requests WHERE NOT model_alias_found GROUP BY model""",
}

#: statements about one key or request, with named parameters (``spark.sql(text, args)``)
LOOKUPS = {
    "recent_by_proxy_key": """
        SELECT model, input_tokens, output_tokens, total_cost, requested_at FROM llm_requests
        WHERE proxy_key_id = :proxy_key_id ORDER BY requested_at DESC, id DESC LIMIT 10""",
    "body_pointer": "SELECT id, body_s3_key FROM llm_requests WHERE id = :request_id",
}


def register_views(spark: SparkSession, log: DataFrame, dims: Dims, users: DataFrame | None = None) -> list[str]:
    """Temporary views for SQL text: llm_requests (accepted rows), api_keys,
    proxy_keys, metadata_keys, prices, provider_mappings without the
    encrypted keys and, if given, users. Returns the names."""
    views = {
        "llm_requests": log, "api_keys": dims.api_keys, "proxy_keys": dims.proxy_keys,
        "provider_mappings": dims.mappings.drop("encrypted_key"), "metadata_keys": dims.metadata_keys,
        "prices": dims.prices}
    if users is not None:
        views["users"] = users
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
