"""Price lookup, request costs and as-of repricing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenledger.config import DEFAULT, LedgerConfig
from tokenledger.session import dim_side

PRICE_STRUCT = ["input_price", "output_price", "cached_price"]
COST_TYPE = "decimal(12,8)"


def one_price(prices: DataFrame, *keys: str) -> DataFrame:
    """One row per model (and ``keys``): the largest price where a list names
    a model twice; rows without a model are dropped."""
    return (prices.where(F.col("model").isNotNull()).groupBy("model", *keys)
            .agg(F.max(F.struct(*PRICE_STRUCT)).alias("price")))


def one_target(aliases: DataFrame) -> DataFrame:
    """One target per alias (the largest where a list names an alias twice)."""
    return aliases.where("alias is not null").groupBy("alias").agg(F.max("target").alias("target"))


def price_lookup(prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every model name that has a price -> ``price`` struct, one row a name.

    Exact names first; an alias only for names without an exact price, and
    only one hop (an alias pointing at another alias finds nothing).
    """
    exact = one_price(prices).select(F.col("model").alias("name"), "price")
    via = (one_target(aliases).join(exact, F.col("target") == F.col("name"), "inner").select(F.col("alias").alias("name"), "price")
           .join(exact.select("name"), "name", "left_anti"))
    return exact.unionByName(via)


def lookup_prices(df: DataFrame, prices: DataFrame, aliases: DataFrame, model_col: str = "model",
                  cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Adds ``price`` (struct or null) and ``model_alias_found``.

    One join whatever the size of the price list: a broadcast behind a size
    check, else a shuffle join. A null model finds no price."""
    lk = dim_side(price_lookup(prices, aliases).withColumnRenamed("name", "_price_name"), cfg.dim_broadcast_bytes)
    # null-safe, though no name is null: for a plain equality the optimizer
    # would trace the model back through all decode expressions (dynamic
    # partition pruning), which takes longer than the query
    j = df.join(lk, F.col(model_col).eqNullSafe(F.col("_price_name")), "left").drop("_price_name")
    return j.withColumn("model_alias_found", F.col("price").isNotNull())


def cost_columns(input_tokens: Column, output_tokens: Column, cached_tokens: Column, price: Column) -> list[Column]:
    """J4 as three columns: double arithmetic in the gateway's order, then
    each rounded to NUMERIC(12,8) on its own (overflow -> null)."""
    per_m = F.lit(1_000_000.0)
    fresh = (input_tokens - cached_tokens).cast("double") * price["input_price"] / per_m
    cached = cached_tokens.cast("double") * price["cached_price"] / per_m
    out = output_tokens.cast("double") * price["output_price"] / per_m
    zero = F.lit(0.0)
    inp = F.coalesce(fresh + cached, zero)
    tot = F.coalesce(fresh + cached + out, zero)
    outc = F.coalesce(out, zero)
    return [inp.try_cast(COST_TYPE).alias("input_cost"),
            outc.try_cast(COST_TYPE).alias("output_cost"),
            tot.try_cast(COST_TYPE).alias("total_cost")]


def request_costs(df: DataFrame, input_col: str = "input_tokens", output_col: str = "output_tokens",
                  cached_col: str = "cached_tokens", price_col: str = "price") -> DataFrame:
    """Add input_cost, output_cost, total_cost (unpriced -> 0)."""
    cols = cost_columns(F.col(input_col), F.col(output_col), F.col(cached_col), F.col(price_col))
    return df.select("*", *cols)


def _day(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / 86_400)


def version_days(versions: DataFrame) -> tuple[DataFrame, Column | None, int]:
    """Versions (name, valid_from, valid_to, price) cut by day, for an
    equi-join: ``(rows with a day, bounds, how many rows at most)``.

    Days before the first change of any price and from the last start on are
    one day each, so a version in force since ever or without end adds no rows
    there; a name has one row a day between them and one for each of its versions.
    ``bounds`` (an array of the first and last day) is null without versions.
    """
    starts = versions.withColumn("_day", _day(F.col("valid_from")))
    # the first change of a price is the earliest end of a version
    b = starts.agg(F.least(F.min(_day(F.col("valid_to"))), F.max("_day")).alias("low"), F.max("_day").alias("high"),
                   F.count("_day").alias("n"), F.countDistinct("name").alias("names")).first()
    if b.high is None:
        return versions.withColumn("day", F.lit(0).cast("long")), None, 0
    bounds = F.array(F.lit(b.low), F.lit(b.high))
    last = F.coalesce(_day(F.col("valid_to")), F.lit(b.high))
    days = F.sequence(clamped(F.col("_day"), bounds), clamped(last, bounds))
    cut = starts.where("valid_from is not null").withColumn("day", F.explode(days)).drop("_day")
    return cut, bounds, b.names * (b.high - b.low + 1) + b.n


def clamped(day: Column, bounds: Column) -> Column:
    return F.greatest(F.least(day, bounds[1]), bounds[0])


#: bytes of a version's row in a hash table, for the broadcast bound
_VERSION_BYTES = 160


def reprice_as_of(df: DataFrame, price_versions: DataFrame, aliases: DataFrame, model_col: str = "model",
                  ts_col: str = "requested_at", cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Cost with the price version in force at ``ts_col``.

    Versions become half-open validity intervals with ``lead`` over each
    model (a small window on the price list, not on the facts) and are cut by
    day; the fact side joins on (resolved name, day), so a row meets only the
    versions of its day however long the history, and the range decides among
    them.  Broadcast only if the counted rows fit the bound, else a shuffle
    join on both keys, which also spreads a hot model over its days.
    Alias resolution is the same one-hop rule as J3, applied per version.
    """
    w = Window.partitionBy("model").orderBy("effective_from")
    exact = (one_price(price_versions, "effective_from").withColumn("valid_to", F.lead("effective_from").over(w))
             .withColumnRenamed("model", "name"))
    via = (one_target(aliases).join(exact, F.col("target") == F.col("name"), "inner")
           .select(F.col("alias").alias("name"), "effective_from", "price", "valid_to")
           .join(exact.select("name").distinct(), "name", "left_anti"))
    cut, bounds, rows = version_days(exact.unionByName(via).withColumnRenamed("effective_from", "valid_from"))
    lk = cut.select(F.col("name").alias("_v_name"), F.col("day").alias("_v_day"), F.col("valid_from").alias("_v_from"),
                    F.col("valid_to").alias("_v_to"), "price")
    if rows * _VERSION_BYTES <= cfg.dim_broadcast_bytes:
        lk = F.broadcast(lk)
    ts = F.col(ts_col)
    day = clamped(_day(ts), bounds) if bounds is not None else F.lit(0).cast("long")
    cond = (F.col(model_col).eqNullSafe(F.col("_v_name")) & (day == F.col("_v_day")) & (ts >= F.col("_v_from"))
            & (F.col("_v_to").isNull() | (ts < F.col("_v_to"))))
    j = df.join(lk, cond, "left").drop("_v_name", "_v_day", "_v_from", "_v_to")
    return j.withColumn("model_alias_found", F.col("price").isNotNull())
