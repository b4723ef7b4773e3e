"""Reading JSON out of free-form model answers.

A well-formed answer is used as it is. Anything else is cleaned with expressions, and one
Arrow UDF finds the balanced object span in what is left.
"""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrecon.functions.numbers import decimal_text
from txnrecon.functions.text import let, nonblank, once, utrim


def without_reasoning(col: Column) -> Column:
    """Drop ``<think>`` blocks; an unclosed one takes the rest with it."""
    return F.regexp_replace(col, r"(?is)<think>.*?(?:</think>|\z)", "")


def without_fence(col: Column) -> Column:
    """Drop one surrounding code fence with its language line."""
    text = utrim(col)
    opened = F.regexp_replace(text, r"^```(?:[^\n]*\n)?", "")
    return F.when(text.startswith("```"), F.regexp_replace(opened, r"```\s*\z", "")).otherwise(text)


# What decides where an object ends: strings (an unclosed one takes the rest) and braces.
_MARK = re.compile(r'"(?:[^"\\]|\\.)*+"?|[{}]', re.DOTALL)


def _span(text: str | None) -> str | None:
    """First ``{`` to its matching ``}``, braces inside JSON strings not counted."""
    begin = -1 if text is None else text.find("{")
    if begin < 0:
        return None
    marks = [(m.end(), m.group()) for m in _MARK.finditer(text, begin) if m.group() in "{}"]
    open_after = itertools.accumulate(1 if mark == "{" else -1 for _, mark in marks)
    end = next((at for (at, _), depth in zip(marks, open_after, strict=True) if depth == 0), None)
    return None if end is None else text[begin:end]


def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(_span, na_action="ignore").astype("object")


# Marked non-deterministic so that no filter is pushed below it and computes it again.
balanced_object = F.pandas_udf(_spans, T.StringType()).asNondeterministic()


def salvage_answers(df: DataFrame, answer: str = "answer", out: str = "doc") -> DataFrame:
    """Add the answer as VARIANT, in one pass over the rows.

    A UDF inside a conditional would still run for every row; here it is handed null where
    the answer parses as it stands, so only the residue is cleaned and scanned.
    """
    parsed = df.select("*", once(_whole=F.try_parse_json(utrim(answer))))
    rest = F.when(F.col("_whole").isNull(), without_fence(without_reasoning(F.col(answer))))
    scanned = parsed.withColumn("_span", balanced_object(rest))
    found = F.coalesce("_whole", F.try_parse_json("_span"))
    return scanned.select(*df.columns, once(**{out: found}))


def variant_kind(doc: Column) -> Column:
    """object / array / text / number / other, null for an absent value."""

    def named(schema: Column) -> Column:
        return (
            F.when(schema == "STRING", "text")
            .when(schema.startswith("OBJECT"), "object")
            .when(schema.startswith("ARRAY"), "array")
            .when(schema.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number")
            .when(schema.isNotNull(), "other")
        )

    return let(F.schema_of_variant(doc), named)


def member(doc: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(doc, f"$.{key}", kind)


def text_of(doc: Column, key: str) -> Column:
    """A *string* member as it is; other types count as absent."""
    return let(
        member(doc, key),
        lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")),
    )


def text_field(doc: Column, key: str) -> Column:
    """A present, non-blank string member, trimmed."""
    return nonblank(text_of(doc, key))


def figure_of(doc: Column, key: str) -> Column:
    """A string member trimmed, or a number member written out with all its places, so that a
    gate sees the scale as sent; a number with an exponent stays as it is."""

    def written(figure: Column) -> Column:
        return F.when(figure.rlike("[eE]"), figure).otherwise(decimal_text(figure))

    def read(v: Column) -> Column:
        return let(
            variant_kind(v),
            lambda kind: F.when(kind == "text", utrim(F.try_variant_get(v, "$", "string"))).when(
                kind == "number", written(F.try_variant_get(v, "$", "string"))
            ),
        )

    return let(member(doc, key), read)


def objects_of(doc: Column) -> Column:
    """Candidate records of an answer: a list, the list under ``transactions``, or the
    single object; anything else is empty."""

    def inside() -> Column:
        return let(
            member(doc, "transactions"),
            lambda listed: F.when(
                variant_kind(listed) == "array", F.try_variant_get(listed, "$", "array<variant>")
            ).otherwise(F.array(doc)),
        )

    return let(
        variant_kind(doc),
        lambda kind: F.when(kind == "array", F.try_variant_get(doc, "$", "array<variant>"))
        .when(kind == "object", inside())
        .otherwise(F.array().cast("array<variant>")),
    )
