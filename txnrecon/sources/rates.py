"""Rate JSON. Figures stay text until they are cast to decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrecon.functions.numbers import RATE
from txnrecon.functions.text import utrim


def parse_rates(bodies: DataFrame, body: str = "body") -> DataFrame:
    """``{"rates": {CCY: rate}}`` bodies with from_ccy, rate_date and fetched_at to rate rows."""
    doc = F.from_json(body, "rates MAP<STRING, STRING>")
    listed = bodies.select("from_ccy", "rate_date", "fetched_at", F.explode(doc["rates"]).alias("_to", "_rate"))
    return listed.select(
        F.upper(utrim("from_ccy")).alias("from_ccy"),
        F.upper(utrim("_to")).alias("to_ccy"),
        "rate_date",
        F.col("_rate").try_cast(RATE).alias("rate"),
        "fetched_at",
    )


def wanted_rates(rates: DataFrame, wanted: DataFrame) -> DataFrame:
    """The asked-for keys with their rate, or ``error`` where the provider has none."""
    keys = ["from_ccy", "to_ccy", "rate_date"]
    joined = wanted.select(*keys).distinct().join(rates, keys, "left")
    return joined.withColumn("error", F.when(F.col("rate").isNull(), "rate missing from response"))


def parse_peso_table(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The bank's table: currency, venta (pesos per unit). ``venta`` may be a number or a
    text; rows at or below zero are dropped, and a body left with none raises."""
    doc = F.from_json(body, "monedas STRUCT<moneda: ARRAY<STRUCT<descripcion: STRING, venta: STRING>>>")
    rows = F.transform(
        doc["monedas"]["moneda"],
        lambda m: F.struct(
            F.upper(utrim(m["descripcion"])).alias("currency"), utrim(m["venta"]).try_cast(RATE).alias("venta")
        ),
    )
    usable = F.filter(rows, lambda m: m["venta"] > 0)
    checked = F.when(F.size(usable) > 0, usable).otherwise(F.raise_error(F.lit("no usable rates in the bank's table")))
    carried = [c for c in bodies.columns if c != body]
    return bodies.select(*carried, F.inline(checked))
