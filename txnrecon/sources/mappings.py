"""``key:value`` configuration text as dimension rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrecon.functions.text import utrim


def parse(texts: DataFrame, text: str = "text", kind: str = "kind", digits_only: bool = False, upper_key: bool = False) -> DataFrame:
    """Rows (kind, key, value) of texts like ``k:v,k:v``.

    The first ``:`` splits, blank entries are ignored, a repeated key keeps its last
    value, and a malformed entry fails the job. ``digits_only`` demands numeric values.
    """
    entries = texts.select(kind, F.posexplode(F.split(text, ",")).alias("_pos", "_raw"))
    entries = entries.select(kind, "_pos", utrim("_raw").alias("_entry")).where(F.col("_entry") != "")
    at = F.instr("_entry", ":")
    key = utrim(F.substring("_entry", F.lit(1), at - 1))
    value = utrim(F.substring("_entry", at + 1, F.length("_entry")))

    def fail(message: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{message}: "), "_entry"))

    checked = F.when(at == 0, fail("entry without a colon")).when(key == "", fail("entry with an empty key"))
    if digits_only:
        checked = checked.when(~value.rlike(r"^[0-9]+\z"), fail("entry value is not numeric"))
    else:
        checked = checked.when(value == "", fail("entry with an empty value"))
    rows = entries.select(
        F.col(kind).alias("kind"),
        (F.upper(key) if upper_key else key).alias("key"),
        "_pos",
        checked.otherwise(value).alias("value"),
    )
    return rows.groupBy("kind", "key").agg(F.max_by("value", "_pos").alias("value"))
