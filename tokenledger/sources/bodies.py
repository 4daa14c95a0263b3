"""Body envelopes (S1 read, S2 stream, S6 write) and the exchange stream.

The gateway stores one gzip JSON object per request under
``{first16(api key id)}/{yyyy-MM-dd}/{request id}.json.gz``. Here many
envelopes share a file: the table is gzip JSON Lines partitioned by
``date`` and a 16-way ``bucket`` of the key prefix (its first hex digit),
so reads prune by day and key prefix while the directory count stays
bounded (16 per day) however many keys exist. Each record carries its full
``key_prefix``, from which the gateway's object key is rebuilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.functions.json_strict import single_value
from tokenledger.operators.quality import CORRUPT

# Microsecond timestamps in recorded JSON (the JSON default keeps only ms).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

ENVELOPE_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("key_prefix", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("request", T.StructType([
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("body", T.StringType()),     # JSON text of an object, or the string
    ])),
    T.StructField("response", T.StructType([
        T.StructField("status_code", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("body", T.StringType()),
    ])),
])

EXCHANGE_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("requested_at", T.TimestampType()),
    T.StructField("responded_at", T.TimestampType()),
    T.StructField("upstream_us", T.LongType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("api_key", T.StringType()),
    T.StructField("authorization", T.StringType()),
    T.StructField("request_body", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("response_headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("response_body", T.StringType()),
])


def _json_str(c: Column) -> Column:
    """A string as a JSON string literal (quotes and escapes included)."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1))


def raw_json(body: Column) -> Column:
    """S6 body rule: empty -> omitted (null); valid JSON -> embedded as is
    (CR, LF, TAB can only stand between tokens there and become spaces, so a
    record stays on one line); anything else -> a JSON string."""
    flat = F.translate(body, "\r\n\t", "   ")
    return (F.when(body.isNull() | (body == ""), F.lit(None))
            .when(single_value(body), flat)
            .otherwise(_json_str(body)))


def _field(name: str, value: Column, first: bool = False) -> Column:
    """``,"name":value`` (or without the comma), empty when value is null."""
    sep = "" if first else ","
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f'{sep}"{name}":'), value))


def envelope_text(request_id: Column, ts: Column, method: Column, path: Column, headers: Column,
                  request_body: Column, status: Column, response_headers: Column, response_body: Column,
                  key_prefix: Column | None = None) -> Column:
    """One envelope as a JSON line. ``to_json`` would quote the raw bodies,
    so the object is assembled with ``concat`` around ``to_json`` parts."""
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    req = F.concat(F.lit("{"), _field("method", _json_str(method), True), _field("path", _json_str(path)),
                   _field("headers", F.to_json(headers)), _field("body", raw_json(request_body)), F.lit("}"))
    resp = F.concat(F.lit("{"), _field("status_code", status.cast("string"), True),
                    _field("headers", F.to_json(response_headers)), _field("body", raw_json(response_body)),
                    F.lit("}"))
    prefix = _field("key_prefix", _json_str(key_prefix)) if key_prefix is not None else F.lit("")
    return F.concat(F.lit("{"), _field("request_id", _json_str(request_id), True), prefix,
                    _field("timestamp", _json_str(stamp)), F.lit(',"request":'), req,
                    F.lit(',"response":'), resp, F.lit("}"))


def write_bodies(envelopes: DataFrame, path: str, mode: str = "append") -> None:
    """``envelopes`` has request_id, api_key_id, requested_at, method,
    path, headers, request_body, status_code, response_headers,
    response_body. Written as gzip JSON Lines under date=/bucket=."""
    prefix = F.substring("api_key_id", 1, 16)
    out = envelopes.select(
        F.date_format("requested_at", "yyyy-MM-dd").alias("date"),
        F.lower(F.substring(prefix, 1, 1)).alias("bucket"),
        envelope_text(F.col("request_id"), F.col("requested_at"), F.col("method"), F.col("path"),
                      F.col("headers"), F.col("request_body"), F.col("status_code"),
                      F.col("response_headers"), F.col("response_body"), prefix).alias("value"),
    )
    # cluster by (date, bucket) so a task writes few files; AQE splits a hot
    # key's day into advisory-size pieces instead of giving it one task
    out = out.hint("rebalance", "date", "bucket")
    out.write.mode(mode).partitionBy("date", "bucket").option("compression", "gzip").text(path)


def read_exchanges(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes back as typed rows, plus ``object_key`` (the gateway's
    key for the request) from the key prefix, the day and the id. A line that
    is no envelope keeps its text in ``_corrupt_record``."""
    schema = T.StructType(ENVELOPE_SCHEMA.fields + [T.StructField("date", T.StringType()),
                                                    T.StructField("bucket", T.StringType())])
    df = (spark.read.schema(schema.add(CORRUPT, T.StringType())).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    return df.withColumn("object_key", F.concat_ws("/", "key_prefix", "date",
                                                   F.concat("request_id", F.lit(".json.gz"))))


def stream_exchanges(spark: SparkSession, path: str, max_files: int = 8) -> DataFrame:
    """Recorded exchanges (JSON Lines, ``EXCHANGE_SCHEMA``) as a stream.

    Every file is read exactly once (the source's log is in the query's
    checkpoint); nothing is dropped under load, backlog just waits. A line
    that is no exchange keeps its text in ``_corrupt_record``; the ETL writes
    it to the log as a reject."""
    schema = T.StructType(EXCHANGE_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("columnNameOfCorruptRecord", CORRUPT).option("timestampFormat", TS_FORMAT).json(path))


def write_exchanges(exchanges: DataFrame, path: str, files: int | None = None) -> None:
    """Record exchanges as JSON Lines (input of S2)."""
    df = exchanges.select(*[f.name for f in EXCHANGE_SCHEMA.fields])
    if files:
        df = df.repartition(files)
    df.write.mode("append").option("timestampFormat", TS_FORMAT).json(path)
