"""Currency conversion: as-of rates, the peso table and half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrecon.functions.numbers import MONEY, PLACES, RATE, round_half_even, times

TTL_SECONDS = 15 * 60
PESO = "DOP"
DERIVED_RATE = RATE
# Missing decimals of an account mean two places.
DEFAULT_DECIMALS = 2


def densify(rates: DataFrame, to_date: Column | None = None) -> DataFrame:
    """One row per pair and calendar day: each rate holds until the next one.

    Weekends and holidays take the nearest earlier rate this way, and the as-of join
    becomes an equi-join. The window spans one pair's published days; ``to_date``
    extends the last rate.
    """
    w = Window.partitionBy("from_ccy", "to_ccy").orderBy("rate_date")
    until = F.coalesce(F.date_sub(F.lead("rate_date").over(w), 1), to_date if to_date is not None else F.col("rate_date"))
    spans = rates.select("from_ccy", "to_ccy", "rate_date", "rate", until.alias("_until"))
    days = F.sequence("rate_date", F.greatest("rate_date", "_until"))
    return spans.select("from_ccy", "to_ccy", F.explode(days).alias("rate_date"), "rate")


def with_rate(
    df: DataFrame,
    rates: DataFrame,
    from_col: str,
    to_col: str,
    date_col: str,
    dop_rates: DataFrame | None = None,
) -> DataFrame:
    """Add ``rate`` (multiply by it) and ``defer_reason`` where none is known.

    Equal currencies need no rate. With ``dop_rates`` (currency, venta: pesos per unit)
    either side being the peso is served from that table, inverted when it is the source.
    The rate side is left to the optimizer: it is broadcast only below the size limit.
    """
    # Days past the newest published one are looked up on that day, so every pair is spread
    # up to it and the facts are read once.
    newest = rates.agg(F.max("rate_date")).scalar()
    daily = densify(rates, newest).select(
        F.col("from_ccy").alias("_f"),
        F.col("to_ccy").alias("_t"),
        F.col("rate_date").alias("_d"),
        F.col("rate").cast(RATE).alias("_table_rate"),
    )
    f, t = F.upper(F.trim(F.col(from_col))), F.upper(F.trim(F.col(to_col)))
    out = df.join(
        daily, (f == F.col("_f")) & (t == F.col("_t")) & (F.least(F.col(date_col), newest) == F.col("_d")), "left"
    ).drop("_f", "_t", "_d")
    rate = F.col("_table_rate")
    if dop_rates is not None:
        pesos = dop_rates.select(
            F.upper(F.trim("currency")).alias("_c"), F.col("venta").cast(RATE).alias("_venta")
        )
        foreign = F.when(f == PESO, t).when(t == PESO, f)
        out = out.join(pesos, foreign == F.col("_c"), "left").drop("_c")
        rate = (
            F.when(f == PESO, peso_rate(F.col("_venta"), invert=True))
            .when(t == PESO, F.col("_venta").cast(DERIVED_RATE))
            .otherwise(rate)
        )
    rate = F.when(f == t, F.lit(1).cast(RATE)).otherwise(rate)
    out = out.withColumn("rate", rate).drop("_table_rate", "_venta")
    return out.withColumn("defer_reason", F.when(F.col("rate").isNull(), "rate unavailable"))


def peso_rate(venta: Column, invert: bool) -> Column:
    """Rate between the peso and another currency from the bank's selling price."""
    inverse = F.lit(1).cast("decimal(10,0)") / venta.cast(RATE)
    return (inverse if invert else venta).cast(DERIVED_RATE)


def account_targets(df: DataFrame, accounts: DataFrame) -> DataFrame:
    """Add the currency and decimals of ``account_id``."""
    dim = accounts.select(
        "account_id",
        F.col("currency").alias("account_currency"),
        F.coalesce("decimals", F.lit(DEFAULT_DECIMALS)).alias("account_decimals"),
    )
    return df.join(dim, "account_id", "left")


def convert(df: DataFrame) -> DataFrame:
    """Amount in the account currency, half-even at its decimals; the original becomes
    the foreign leg when the currencies differ. A product that can't be held defers the record."""
    same = F.upper("currency") == F.upper("account_currency")
    places = F.coalesce("account_decimals", F.lit(DEFAULT_DECIMALS))
    priced = ~same & F.col("amount").isNotNull() & F.col("rate").isNotNull()
    converted = round_half_even(times(F.col("amount"), F.col("rate")), places)
    reason = F.coalesce(
        F.col("defer_reason") if "defer_reason" in df.columns else F.lit(None).cast("string"),
        F.when(priced & ~places.isin(*PLACES), "unsupported account decimals"),
        F.when(priced & converted.isNull(), "amount_out_of_range"),
    )
    return df.select(
        *[c for c in df.columns if c != "defer_reason"],
        reason.alias("defer_reason"),
        F.when(same, F.col("amount").cast(MONEY)).otherwise(converted).alias("booked_amount"),
        F.when(~same, F.col("amount")).alias("foreign_amount"),
        F.when(~same, F.col("currency")).alias("foreign_currency"),
    )


def is_fresh(rate_date: Column, fetched_at: Column, now: Column) -> Column:
    """Past days never expire; today's and later ones live for fifteen minutes."""
    age = F.unix_timestamp(now) - F.unix_timestamp(fetched_at)
    return (rate_date < now.cast("date")) | (age < TTL_SECONDS)


def latest_rates(cache: DataFrame) -> DataFrame:
    """Newest entry per pair and day of an append-only rate table."""
    entry = F.max_by(F.struct("rate", "fetched_at"), "fetched_at").alias("_e")
    keys = [F.upper("from_ccy").alias("from_ccy"), F.upper("to_ccy").alias("to_ccy"), F.col("rate_date")]
    return cache.groupBy(*keys).agg(entry).select("from_ccy", "to_ccy", "rate_date", "_e.*")


def stale_keys(needed: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Distinct (from, to, day) keys that no fresh cache entry serves."""
    fresh = latest_rates(cache).where(is_fresh(F.col("rate_date"), F.col("fetched_at"), now))
    keys = ["from_ccy", "to_ccy", "rate_date"]
    wanted = needed.select(
        F.upper(F.trim("from_ccy")).alias("from_ccy"), F.upper(F.trim("to_ccy")).alias("to_ccy"), "rate_date"
    )
    return wanted.where(F.col("from_ccy") != F.col("to_ccy")).distinct().join(fresh, keys, "left_anti")
