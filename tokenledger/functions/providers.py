"""Provider detection, request model and usage decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.config import DEFAULT, LedgerConfig
from tokenledger.functions.json_strict import Str, strict_json

# ---------------------------------------------------------------------------
# Provider names and their default upstream base URLs. These
# must equal what the gateway reports, in this order of precedence.
PROVIDER_BASE_URLS = {
    "openai": "https://api.openai.com",
    "anthropic": "https://api.anthropic.com",
    "gemini": "https://generativelanguage.googleapis.com",
    "gemini-openai": "https://generativelanguage.googleapis.com/v1beta/openai",
    "anthropic-openai": "https://api.anthropic.com",
    "azure": "",
    "bedrock": "",
}
UNKNOWN = "unknown"
# Path rules: OpenAI path prefixes, the Anthropic prefix, Gemini substrings.
OPENAI_PATH_PREFIXES = ["/v1/chat/completions", "/v1/completions", "/v1/embeddings", "/v1/responses"]
ANTHROPIC_PATH_PREFIX = "/v1/messages"
GEMINI_PATH_PARTS = ["generateContent", "streamGenerateContent"]
# Parsers: these providers have their own; every other one uses OpenAI's.
OWN_PARSER = ["anthropic", "gemini"]
# ---------------------------------------------------------------------------

LONG = T.LongType()

OPENAI_USAGE = T.StructType([
    T.StructField("model", Str()),
    T.StructField("usage", T.StructType([
        T.StructField("prompt_tokens", LONG),
        T.StructField("completion_tokens", LONG),
        T.StructField("prompt_tokens_details", T.StructType([T.StructField("cached_tokens", LONG)])),
        T.StructField("input_tokens", LONG),
        T.StructField("output_tokens", LONG),
        T.StructField("input_tokens_details", T.StructType([T.StructField("cached_tokens", LONG)])),
        T.StructField("output_tokens_details", T.StructType([T.StructField("reasoning_tokens", LONG)])),
        T.StructField("total_tokens", LONG),
    ])),
])

ANTHROPIC_USAGE = T.StructType([
    T.StructField("model", Str()),
    T.StructField("usage", T.StructType([
        T.StructField("input_tokens", LONG),
        T.StructField("output_tokens", LONG),
        T.StructField("cache_read_input_tokens", LONG),
        T.StructField("cache_creation_input_tokens", LONG),
    ])),
])

GEMINI_USAGE = T.StructType([
    T.StructField("usageMetadata", T.StructType([
        T.StructField("promptTokenCount", LONG),
        T.StructField("candidatesTokenCount", LONG),
        T.StructField("totalTokenCount", LONG),
        T.StructField("cachedContentTokenCount", LONG),
    ])),
    T.StructField("modelVersion", Str()),
])

MODEL_REQUEST = T.StructType([T.StructField("model", Str())])



def _z(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def detect_provider(path: Column, headers: Column, cfg: LedgerConfig = DEFAULT) -> Column:
    """``struct<provider, base_url>`` from the explicit header, else the path.

    ``headers`` is the lower-cased gateway header map of ``extract_headers``.
    """
    explicit = F.lower(F.element_at(headers, F.lit(cfg.provider_header)))
    known = F.create_map(*[x for name, url in PROVIDER_BASE_URLS.items() for x in (F.lit(name), F.lit(url))])
    from_header = F.when(
        explicit.isin(list(PROVIDER_BASE_URLS)),
        F.struct(explicit.alias("provider"), F.element_at(known, explicit).alias("base_url")),
    ).otherwise(F.struct(F.lit(UNKNOWN).alias("provider"), F.lit("").alias("base_url")))

    def named(name: str) -> Column:
        return F.struct(F.lit(name).alias("provider"), F.lit(PROVIDER_BASE_URLS[name]).alias("base_url"))

    is_openai = F.lit(False)
    for p in OPENAI_PATH_PREFIXES:
        is_openai = is_openai | path.startswith(p)
    is_gemini = F.lit(False)
    for p in GEMINI_PATH_PARTS:
        is_gemini = is_gemini | path.contains(p)
    from_path = (
        F.when(is_openai, named("openai"))
        .when(path.startswith(ANTHROPIC_PATH_PREFIX), named("anthropic"))
        .when(is_gemini, named("gemini"))
        .otherwise(named("openai"))
    )
    has_header = F.coalesce(F.map_contains_key(headers, F.lit(cfg.provider_header)), F.lit(False))
    return F.when(has_header, from_header).otherwise(from_path)


def parser_name(provider: Column) -> Column:
    """Name a successful parse reports: anthropic, gemini, or openai for the rest."""
    return F.when(provider.isin(OWN_PARSER), provider).otherwise(F.lit("openai"))


def extract_model(request_body: Column) -> Column:
    """``model`` of the request JSON; absent, empty or undecodable -> 'unknown'."""
    p = strict_json(request_body, MODEL_REQUEST)
    m = F.when(p["ok"], p["v"]["model"])
    return F.coalesce(F.nullif(m, F.lit("")), F.lit(UNKNOWN))


def _usage(ok: Column, model: Column, inp: Column, out: Column, cached: Column, creation: Column) -> Column:
    return F.struct(
        ok.alias("ok"), model.alias("model"), inp.alias("input"), out.alias("output"),
        cached.alias("cached"), creation.alias("creation"),
    )


def openai_usage(parsed: Column) -> Column:
    """P5 from a ``strict_json(body, OPENAI_USAGE)`` struct.

    Chat fields, unless the Responses fields report input or output > 0, in
    which case all three come from the Responses fields.
    """
    u = parsed["v"]["usage"]
    use_responses = (_z(u["input_tokens"]) > 0) | (_z(u["output_tokens"]) > 0)
    return _usage(
        parsed["ok"],
        F.coalesce(parsed["v"]["model"], F.lit("")),
        F.when(use_responses, _z(u["input_tokens"])).otherwise(_z(u["prompt_tokens"])),
        F.when(use_responses, _z(u["output_tokens"])).otherwise(_z(u["completion_tokens"])),
        F.when(use_responses, _z(u["input_tokens_details"]["cached_tokens"]))
        .otherwise(_z(u["prompt_tokens_details"]["cached_tokens"])),
        F.lit(0).cast("bigint"),
    )


def anthropic_usage(parsed: Column) -> Column:
    """Input is normalised to include cache reads and cache creation."""
    u = parsed["v"]["usage"]
    return _usage(
        parsed["ok"],
        F.coalesce(parsed["v"]["model"], F.lit("")),
        _z(u["input_tokens"]) + _z(u["cache_read_input_tokens"]) + _z(u["cache_creation_input_tokens"]),
        _z(u["output_tokens"]),
        _z(u["cache_read_input_tokens"]),
        _z(u["cache_creation_input_tokens"]),
    )


def gemini_usage(parsed: Column) -> Column:
    """``usageMetadata`` counts, model from ``modelVersion``."""
    u = parsed["v"]["usageMetadata"]
    return _usage(
        parsed["ok"],
        F.coalesce(parsed["v"]["modelVersion"], F.lit("")),
        _z(u["promptTokenCount"]),
        _z(u["candidatesTokenCount"]),
        _z(u["cachedContentTokenCount"]),
        F.lit(0).cast("bigint"),
    )


def parse_usage_openai(body: Column) -> Column:
    return openai_usage(strict_json(body, OPENAI_USAGE))


def parse_usage_anthropic(body: Column) -> Column:
    return anthropic_usage(strict_json(body, ANTHROPIC_USAGE))


def parse_usage_gemini(body: Column) -> Column:
    return gemini_usage(strict_json(body, GEMINI_USAGE))
