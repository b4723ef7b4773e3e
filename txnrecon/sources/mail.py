"""Mail tables: incremental batches and the text of a message."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrecon.functions.text import html_to_text, nonblank


def new_messages(messages: DataFrame, last_seq: int | None = None) -> DataFrame:
    """Messages created or changed since the cursor, still in the inbox, once each.

    ``messages``: msg_id, created_seq, updated_seq, in_inbox and the message columns.
    Without a cursor the whole inbox is new.
    """
    inbox = messages.where("in_inbox")
    if last_seq is None:
        return inbox.dropDuplicates(["msg_id"])
    created = inbox.where(F.col("created_seq") > last_seq)
    updated = inbox.where(F.col("updated_seq") > last_seq)
    return created.unionByName(updated).dropDuplicates(["msg_id"])


def next_cursor(messages: DataFrame) -> DataFrame:
    """The cursor to save once a batch is handled, as a one-row table."""
    return messages.agg(F.max(F.greatest("created_seq", "updated_seq")).alias("last_seq"))


def body_text(messages: DataFrame) -> DataFrame:
    """Add ``text``: the joined text parts, else the HTML part as text, else the decoded raw
    message. Only rows that need the decoder reach Python."""
    joined = nonblank(F.array_join(F.transform("text_parts", lambda p: F.concat(p, F.lit("\n"))), ""))
    parts = F.array_join(F.transform("text_parts", lambda p: F.concat(p, F.lit("\n"))), "")
    text = F.when(joined.isNotNull(), parts).when(nonblank("html").isNotNull(), html_to_text("html"))
    known = messages.withColumn("text", text)
    easy = known.where(F.col("text").isNotNull() | F.col("raw").isNull())
    hard = known.where(F.col("text").isNull() & F.col("raw").isNotNull()).drop("text")
    schema = T.StructType(list(hard.schema.fields)).add("decoded_text", "string").add("decoded_html", "string")
    decoded = hard.mapInPandas(_decode_raw, schema)
    decoded = decoded.withColumn("text", F.coalesce("decoded_text", html_to_text("decoded_html")))
    return easy.unionByName(decoded.drop("decoded_text", "decoded_html"))


def _decode_raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """RFC 822 bytes to their first plain-text part, else their first HTML part."""
    from email import message_from_bytes, policy

    def part(message, kind: str) -> str | None:
        found = message.get_body(preferencelist=(kind,))
        return None if found is None else found.get_content()

    for batch in batches:
        parsed = [message_from_bytes(bytes(raw), policy=policy.default) for raw in batch["raw"]]
        plain = [part(m, "plain") for m in parsed]
        html = [part(m, "html") if p is None else None for m, p in zip(parsed, plain)]
        yield batch.assign(decoded_text=plain, decoded_html=html)
