"""Translator inputs built from ``conversations`` (FIXTURES.md 2.2).

One OpenAI chat request and one Anthropic response per conversation: the
turns of a conversation are gathered in turn order (a conversation is one
request body, so its size is bounded by what one request can carry).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.plans.fixtures import STOP_REASONS, table


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def chat_requests(spark: SparkSession, sf: str) -> DataFrame:
    """``conv_id, request_body``: messages in turn order, max_tokens on even ids."""
    t = _turns(spark, sf)
    msgs = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    body = F.to_json(F.struct(
        F.lit("gpt-alpha").alias("model"), msgs.alias("messages"),
        F.when(F.col("conv_id") % 2 == 0, F.col("conv_id") + 256).alias("max_tokens")))
    return t.select("conv_id", body.alias("request_body"))


def anthropic_responses(spark: SparkSession, sf: str) -> DataFrame:
    """``conv_id, response_body``: a block per assistant turn (every third
    turn number a tool_use block), usage from character counts."""
    t = _turns(spark, sf)
    assistant = F.filter("turns", lambda x: x["role"] == "assistant")
    blocks = F.transform(assistant, lambda x: F.when(
        x["turn"] % 3 == 0,
        F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"),
                 F.concat(F.lit("tu-"), x["turn"].cast("string")).alias("id"), F.lit("lookup").alias("name")),
    ).otherwise(F.struct(F.lit("text").alias("type"), x["text"].alias("text"),
                         F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"))))
    chars = lambda pred: F.aggregate(F.filter("turns", pred), F.lit(0).cast("bigint"),
                                     lambda acc, x: acc + F.length(x["text"]))
    stop = F.element_at(F.array(*[F.lit(s) for s in STOP_REASONS]), (F.col("conv_id") % 5 + 1).cast("int"))
    body = F.to_json(F.struct(
        F.concat(F.lit("msg-"), F.col("conv_id").cast("string")).alias("id"), F.lit("message").alias("type"),
        F.lit("assistant").alias("role"), blocks.alias("content"), F.lit("cl-big").alias("model"),
        stop.alias("stop_reason"),
        F.struct(chars(lambda x: x["role"] != "assistant").alias("input_tokens"),
                 chars(lambda x: x["role"] == "assistant").alias("output_tokens")).alias("usage")))
    return t.select("conv_id", body.alias("response_body"))
