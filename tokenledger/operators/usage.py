"""Usage extraction and OpenAI<->Anthropic translation.

Each body is parsed once: the provider decides which schema a response is
parsed with (``when`` guards), parses are columns of their own before they are
read several times, and the request body is only parsed for rows that need
its model or its translation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.functions import json_strict as J
from tokenledger.functions import providers as P
from tokenledger.functions.json_strict import Str

ANTHROPIC_RESPONSE = T.StructType([
    T.StructField("id", Str()),
    T.StructField("type", Str()),
    T.StructField("role", Str()),
    T.StructField("content", T.ArrayType(T.StructType([
        T.StructField("type", Str()), T.StructField("text", Str())]))),
    T.StructField("model", Str()),
    T.StructField("stop_reason", Str()),
    T.StructField("stop_sequence", Str()),
    T.StructField("usage", T.StructType([
        T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType())])),
])

OPENAI_REQUEST = T.StructType([
    T.StructField("model", Str()),
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", Str()), T.StructField("content", Str())]))),
    T.StructField("max_tokens", T.LongType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("top_p", T.DoubleType()),
    T.StructField("stream", T.BooleanType()),
])

# Anthropic stop_reason -> OpenAI finish_reason (else "stop"),
# the default max_tokens of a translated request and its new path.
FINISH_REASONS = {"end_turn": "stop", "max_tokens": "length", "stop_sequence": "stop", "tool_use": "tool_calls"}
DEFAULT_MAX_TOKENS = 4096
TRANSLATED_PATH = "/v1/messages"
TRANSLATING_PROVIDER = "anthropic-openai"


def usage_metrics(df: DataFrame, provider: str = "provider", status: str = "status_code",
                  response_body: str = "response_body", request_body: str = "request_body",
                  out: str = "usage") -> DataFrame:
    """Add ``usage`` = struct<ok, provider, model, input, output, cached, creation>.

    * anthropic / gemini bodies use their own parser, every other provider OpenAI's;
    * anthropic-openai responses with status < 400 are first translated
      (P10): a translated body always decodes, cached counts are lost;
    * on a failed decode all counts are 0 and the provider is the detected one;
    * an empty or missing model falls back to the request's model (P4).

    Each response body is parsed once with the schema its parser needs (twice
    only where a translation fails).
    """
    prov = F.col(provider)
    translate = F.coalesce((prov == TRANSLATING_PROVIDER) & (F.col(status) < 400), F.lit(False))
    df = J.with_stricts(df, response_body, {
        "_a": (P.ANTHROPIC_USAGE, prov == "anthropic"),
        "_g": (P.GEMINI_USAGE, prov == "gemini"),
        "_t": (ANTHROPIC_RESPONSE, translate),
        "_o": (P.OPENAI_USAGE, ~prov.isin(P.OWN_PARSER) & ~translate),
    })
    # what could not be translated is read as it stands
    df = J.with_stricts(df, response_body, {"_f": (P.OPENAI_USAGE, translate & ~F.col("_t__ok"))})

    def v(name: str) -> Column:
        return F.struct(J.lit_true(), F.col(name).alias("v"))

    zero = F.lit(0).cast("bigint")
    tu = F.col("_t.usage")
    translated = F.struct(
        F.lit(True).alias("ok"), F.coalesce(F.col("_t.model"), F.lit("")).alias("model"),
        F.coalesce(tu["input_tokens"], zero).alias("input"), F.coalesce(tu["output_tokens"], zero).alias("output"),
        zero.alias("cached"), zero.alias("creation"),
    )
    df = df.withColumns({"_u": (
        F.when(F.col("_a__ok"), P.anthropic_usage(v("_a")))
        .when(F.col("_g__ok"), P.gemini_usage(v("_g")))
        .when(F.col("_t__ok"), translated)
        .when(F.col("_o__ok"), P.openai_usage(v("_o")))
        .when(F.col("_f__ok"), P.openai_usage(v("_f")))),
    }).drop(*[f"_{k}{x}" for k in "agtof" for x in ("", "__ok")])
    ok = F.col("_u").isNotNull()
    need_model = ~ok | (F.col("_u.model") == "")
    df = J.with_strict(df, request_body, P.MODEL_REQUEST, "_req", guard=need_model)
    req_model = F.coalesce(F.nullif(F.when(F.col("_req.ok"), F.col("_req.v.model")), F.lit("")), F.lit(P.UNKNOWN))
    result = F.struct(
        ok.alias("ok"),
        F.when(ok, P.parser_name(prov)).otherwise(prov).alias("provider"),
        F.when(need_model, req_model).otherwise(F.col("_u.model")).alias("model"),
        *[F.coalesce(F.col(f"_u.{c}"), zero).alias(c) for c in ("input", "output", "cached", "creation")],
    )
    return df.withColumn(out, result).drop("_u", "_req")


USAGE_OF = {"openai": (P.OPENAI_USAGE, P.openai_usage), "anthropic": (P.ANTHROPIC_USAGE, P.anthropic_usage),
            "gemini": (P.GEMINI_USAGE, P.gemini_usage)}


def parse_usage(df: DataFrame, parser: str, body: str = "response_body", out: str = "usage") -> DataFrame:
    """P5-P7 over a table: add ``usage`` = struct<ok, model, input, output,
    cached, creation> by one parser, one parse a body."""
    schema, read = USAGE_OF[parser]
    df = J.with_strict(df, body, schema, "_parsed")
    return df.withColumn(out, read(F.col("_parsed"))).drop("_parsed")


def request_models(df: DataFrame, body: str = "request_body", out: str = "model") -> DataFrame:
    """P4 over a table: ``model`` of the request JSON, one parse a body."""
    df = J.with_strict(df, body, P.MODEL_REQUEST, "_parsed")
    return df.withColumn(out, F.coalesce(F.nullif(F.col("_parsed.v.model"), F.lit("")), F.lit(P.UNKNOWN))).drop("_parsed")


def translate_requests(df: DataFrame, body: str = "request_body", out: str = "translated") -> DataFrame:
    """OpenAI chat request -> Anthropic request.

    Adds ``out`` = struct<ok, body, path, system, n_messages, max_tokens>.
    System messages are removed and the last one becomes ``system``; other
    messages keep their order; ``max_tokens`` defaults to 4096; temperature,
    top_p and stream are carried when present. On a decode error the request
    is passed on unchanged (ok=false, body and path null).
    """
    df = J.with_strict(df, body, OPENAI_REQUEST, "_oreq")
    v = F.col("_oreq.v")
    # a missing or null role, content or message reads as empty text
    msgs = F.transform(F.coalesce(v["messages"], F.array().cast("array<struct<role:string,content:string>>")),
                       lambda m: F.struct(F.coalesce(m["role"], F.lit("")).alias("role"),
                                          F.coalesce(m["content"], F.lit("")).alias("content")))
    system_msgs = F.filter(msgs, lambda m: m["role"] == "system")
    others = F.filter(msgs, lambda m: m["role"] != "system")
    system = F.try_element_at(system_msgs, F.lit(-1))["content"]
    max_tokens = F.coalesce(v["max_tokens"], F.lit(DEFAULT_MAX_TOKENS).cast("bigint"))
    # model, messages and max_tokens are always written (no messages: null)
    always = F.to_json(F.struct(
        F.coalesce(v["model"], F.lit("")).alias("model"),
        F.when(F.size(others) > 0, others).alias("messages"),
        max_tokens.alias("max_tokens")), {"ignoreNullFields": "false"})
    given = F.to_json(F.struct(
        F.nullif(system, F.lit("")).alias("system"),
        v["temperature"].alias("temperature"),
        v["top_p"].alias("top_p"),
        v["stream"].alias("stream")))
    text = F.when(given == "{}", always).otherwise(
        F.concat(F.substr(always, F.lit(1), F.length(always) - 1), F.lit(","), F.substr(given, F.lit(2))))
    ok = F.col("_oreq.ok")
    res = F.struct(
        ok.alias("ok"),
        F.when(ok, text).alias("body"),
        F.when(ok, F.lit(TRANSLATED_PATH)).alias("path"),
        F.when(ok, F.coalesce(system, F.lit(""))).alias("system"),
        F.when(ok, F.size(others)).alias("n_messages"),
        F.when(ok, max_tokens).alias("max_tokens"),
    )
    return df.withColumn(out, res).drop("_oreq")


def finish_reason(stop_reason: Column) -> Column:
    chain = None
    for k, v in FINISH_REASONS.items():
        chain = F.when(stop_reason == k, F.lit(v)) if chain is None else chain.when(stop_reason == k, F.lit(v))
    return chain.otherwise(F.lit("stop"))


def translate_responses(df: DataFrame, body: str = "response_body", out: str = "translated") -> DataFrame:
    """P10: Anthropic response -> OpenAI chat completion.

    Adds ``out`` = struct<ok, body, content, finish_reason, prompt_tokens,
    completion_tokens, total_tokens>. Text blocks are concatenated, other
    blocks skipped; cache counts are not carried over.
    """
    df = J.with_strict(df, body, ANTHROPIC_RESPONSE, "_aresp")
    v = F.col("_aresp.v")
    blocks = F.coalesce(v["content"], F.array().cast("array<struct<type:string,text:string>>"))
    content = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"),
                                       lambda b: F.coalesce(b["text"], F.lit(""))), "")
    reason = finish_reason(F.coalesce(v["stop_reason"], F.lit("")))
    pin = F.coalesce(v["usage"]["input_tokens"], F.lit(0).cast("bigint"))
    pout = F.coalesce(v["usage"]["output_tokens"], F.lit(0).cast("bigint"))
    oa = F.struct(
        F.coalesce(v["id"], F.lit("")).alias("id"),
        F.lit("chat.completion").alias("object"),
        F.lit(0).cast("bigint").alias("created"),
        F.coalesce(v["model"], F.lit("")).alias("model"),
        F.array(F.struct(
            F.lit(0).alias("index"),
            F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message"),
            reason.alias("finish_reason"),
        )).alias("choices"),
        F.struct(pin.alias("prompt_tokens"), pout.alias("completion_tokens"),
                 (pin + pout).alias("total_tokens")).alias("usage"),
    )
    ok = F.col("_aresp.ok")
    res = F.struct(
        ok.alias("ok"),
        F.when(ok, F.to_json(oa)).alias("body"),
        F.when(ok, content).alias("content"),
        F.when(ok, reason).alias("finish_reason"),
        F.when(ok, pin).alias("prompt_tokens"),
        F.when(ok, pout).alias("completion_tokens"),
        F.when(ok, pin + pout).alias("total_tokens"),
    )
    return df.withColumn(out, res).drop("_aresp")
