"""From messages to typed records: unwrap, dispatch, fixed formats, model answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrecon.functions import answers
from txnrecon.functions.numbers import amount_gate, currency_gate
from txnrecon.functions.receipts import usd_transaction_total
from txnrecon.functions.text import BLANK_LINE, HSPACE, ascii_lower, let, nonblank, once, unless_empty, utrim
from txnrecon.operators import validate
from txnrecon.sources.registry import SOURCES, Source, match_sender, per_source

FORWARD_MARKER = "Forwarded message"
# Message columns that travel with whatever is extracted from it.
CARRIED = ["msg_id", "msg_seq", "adapter"]
TRANSFER_COLUMNS = [
    "amount", "currency", "txn_date", "description", "external_id",
    "source_kind", "source_key", "dest_kind", "dest_key", "parse_error",
]


def email_address(value: Column) -> Column:
    """Address in angle brackets, else the first word with an ``@``."""
    bracketed = utrim(F.regexp_extract(value, r"^[^<>]*<([^>]*)>", 1))
    word = F.regexp_extract(value, r"(?U)(\S*@\S*)", 1)
    bare = F.regexp_replace(word, r"^[^\x21-\x7E]+|[^\x21-\x7E]+\z", "")
    return let(bracketed, lambda b: F.when(F.contains(b, F.lit("@")), b).otherwise(unless_empty(bare)))


def unwrap(messages: DataFrame) -> DataFrame:
    """Recover the original sender, subject and body of a forwarded message.

    With the marker the sender comes from the inner header block only: if that cannot
    be read the message stays unattributed rather than being pinned on the forwarder.
    Without it the envelope sender is the original one.
    """
    parts = _unwrapped(F.coalesce("text", F.lit("")), F.col("from_hdr"))
    return messages.select("*", once(_u=parts)).select(messages.columns + [f"_u.{c}" for c in UNWRAPPED])


UNWRAPPED = ["original_sender", "original_subject", "body"]


def _unwrapped(text: Column, from_hdr: Column) -> Column:
    def manual(t: Column) -> Column:
        # Everything after the marker line, kept with the newline before it; the marker
        # line itself when nothing follows.
        marker = F.substring(t, F.instr(t, FORWARD_MARKER), F.length(t))
        after = F.regexp_replace(marker, r"^[^\n]*(?=\n)", "")
        region = F.when(after.startswith("\n"), after).otherwise(F.concat(F.lit("\n"), marker))
        return let(region, lambda r: let(F.split(r, BLANK_LINE, 2), lambda halves: headers(r, halves)))

    def headers(region: Column, halves: Column) -> Column:
        def header(name: str) -> Column:
            return nonblank(
                F.regexp_extract(F.get(halves, 0), rf"(?i)\n{HSPACE}*{name}{HSPACE}*:([^\n]*)", 1)
            )

        rest = F.when(F.size(halves) > 1, F.regexp_replace(F.get(halves, 1), r"^\n", "")).otherwise(
            F.substring(region, F.lit(2), F.length(region))
        )
        return let(
            ascii_lower(let(header("from"), email_address)),
            lambda sender: F.struct(
                sender.alias("original_sender"),
                F.when(sender.isNotNull(), header("subject")).alias("original_subject"),
                rest.alias("body"),
            ),
        )

    def automatic(t: Column) -> Column:
        return F.struct(
            ascii_lower(email_address(from_hdr)).alias("original_sender"),
            F.lit(None).cast("string").alias("original_subject"),
            t.alias("body"),
        )

    return let(text, lambda t: F.when(F.contains(t, F.lit(FORWARD_MARKER)), manual(t)).otherwise(automatic(t)))


def is_statement(sender_hint: str | None) -> Column:
    """A PDF attachment, and the subject or the sender says it is an account statement."""
    pdf = F.exists(
        "attachments",
        lambda a: F.coalesce(ascii_lower(a["content_type"]) == "application/pdf", F.lit(False))
        | F.coalesce(ascii_lower(a["name"]).endswith(".pdf"), F.lit(False)),
    )
    by_subject = F.contains(F.lower(F.coalesce("subject", F.lit(""))), F.lit("cuenta"))
    by_sender = F.lit(False)
    if sender_hint is not None:
        by_sender = F.contains(F.lower(F.coalesce("from_hdr", F.lit(""))), F.lit(sender_hint.lower()))
    return F.coalesce(pdf, F.lit(False)) & (by_subject | by_sender)


def dispatch(
    messages: DataFrame, sources: tuple[Source, ...] = SOURCES, sender_hint: str | None = None
) -> DataFrame:
    """Add ``adapter`` and ``branch``: statement, skip, deterministic, model or review."""
    statement = is_statement(sender_hint) if "attachments" in messages.columns else F.lit(False)

    def decide(u: Column) -> Column:
        return let(match_sender(u["original_sender"], sources), lambda adapter: branches(u, adapter))

    def branches(u: Column, adapter: Column) -> Column:
        body = u["body"]
        branch = (
            F.when(statement, "statement")
            .when(adapter.isNull(), "review")
            .when(~per_source(sources, lambda s: s.is_transaction(body), adapter), "skip")
            .when(per_source(sources, lambda s: s.is_fixed(body), adapter), "deterministic")
            .otherwise("model")
        )
        return F.struct(*[u[c].alias(c) for c in UNWRAPPED], adapter.alias("adapter"), branch.alias("branch"))

    whole = let(_unwrapped(F.coalesce("text", F.lit("")), F.col("from_hdr")), decide)
    sent = messages.select("*", once(_d=whole))
    reason = F.when(
        F.col("_d.branch") == "review",
        F.when(F.col("_d.original_sender").isNull(), validate.NO_FORWARD).otherwise(validate.NO_SOURCE),
    ).when(F.col("_d.branch") == "skip", "not a transaction notification")
    return sent.select(
        *messages.columns, *[f"_d.{c}" for c in (*UNWRAPPED, "adapter", "branch")], reason.alias("branch_reason")
    )


def deterministic(dispatched: DataFrame, sources: tuple[Source, ...] = SOURCES) -> DataFrame:
    """Transfers of fixed-format bodies. A body of the right shape that does not parse
    carries ``parse_error``: it is reviewed, never skipped."""
    rows = dispatched.where(F.col("branch") == "deterministic")
    parts = []
    for source in sources:
        if source.fixed_fields is not None:
            own = rows.where(F.col("adapter") == source.name)
            read = own.select(*CARRIED, source.fixed_fields(F.col("body")).alias("_t"))
            parts.append(read.select(*CARRIED, *[f"_t.{c}" for c in TRANSFER_COLUMNS]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def model(
    dispatched: DataFrame,
    answer_fn: Callable[[pd.DataFrame], pd.Series],
    sources: tuple[Source, ...] = SOURCES,
) -> DataFrame:
    """Run the injected extraction callable over the model branch only.

    ``answer_fn`` gets a batch with ``adapter`` and ``prompt_body`` and returns one answer
    text per row. The branch is a separate DataFrame, so no other message reaches Python.
    """
    trimmed = [s for s in sources if s.model_body is not None]
    rows = dispatched.where(F.col("branch") == "model").select(
        *CARRIED, "body", per_source(tuple(trimmed), lambda s: s.model_body(F.col("body"))).alias("prompt_body")
    )

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(answer=answer_fn(batch)).drop(columns="prompt_body")

    return rows.mapInPandas(ask, "msg_id string, msg_seq bigint, adapter string, body string, answer string")


RECORD = (
    "struct<external_id:string,amount:decimal(20,4),currency:string,direction:string,txn_date:date,"
    "merchant:string,account_hint:string,status:string,raw_ref:string,parse_error:string>"
)


def _typed(obj: Column, sources: tuple[Source, ...]) -> Column:
    """One answer object as a typed record with its ``parse_error``."""
    wallet = per_source(sources, lambda s: F.lit(s.wallet_rules))
    raw = F.struct(
        (answers.variant_kind(obj) == "object").alias("is_object"),
        answers.figure_of(obj, "amount").alias("amount"),
        answers.text_of(obj, "date").alias("date"),
        currency_gate(answers.text_field(obj, "currency")).alias("currency"),
        ascii_lower(utrim(answers.text_of(obj, "direction"))).alias("direction"),
        answers.text_field(obj, "merchant").alias("merchant"),
        answers.text_field(obj, "account_hint").alias("account_hint"),
        answers.text_field(obj, "status").alias("status"),
        answers.text_field(obj, "raw_ref").alias("raw_ref"),
        F.when(wallet, answers.text_field(obj, "external_id")).alias("external_id"),
    )

    def gated(r: Column) -> Column:
        return F.struct(
            r.alias("raw"),
            per_source(sources, lambda s: amount_gate(s.amount_text(r["amount"]))).alias("amount"),
            per_source(sources, lambda s: s.parse_date(r["date"])).alias("day"),
        )

    def finished(g: Column) -> Column:
        r = g["raw"]
        error = (
            F.when(~F.coalesce(r["is_object"], F.lit(False)), "expected a JSON object")
            .when(g["amount"].isNull(), "amount rejected")
            .when(r["currency"].isNull(), "missing or malformed code")
            .when(g["day"].isNull(), "unrecognised date")
            .when(r["merchant"].isNull(), "missing merchant")
        )
        return F.struct(
            r["external_id"].alias("external_id"),
            g["amount"].alias("amount"),
            r["currency"].alias("currency"),
            F.when(wallet & (r["direction"] == "in"), "in").otherwise("out").alias("direction"),
            g["day"].alias("txn_date"),
            r["merchant"].alias("merchant"),
            r["account_hint"].alias("account_hint"),
            F.coalesce(r["status"], F.lit("")).alias("status"),
            F.coalesce(r["raw_ref"], r["external_id"], F.lit("")).alias("raw_ref"),
            error.alias("parse_error"),
        )

    return let(raw, lambda r: let(gated(r), finished))


def records(answered: DataFrame, sources: tuple[Source, ...] = SOURCES) -> DataFrame:
    """Typed records of model answers, one row per record.

    A message whose answer is unusable, or that holds one unusable record, fails as a
    whole: all its rows carry ``message_error``. A wallet answer of kind "other" is a
    clean ``skip_reason``. The objects of an answer are typed before they are exploded, so
    the message's fate needs no grouping.
    """
    sources = tuple(s for s in sources if s.model_body is not None)
    docs = answers.salvage_answers(answered)
    doc = F.col("doc")
    wallet = per_source(sources, lambda s: F.lit(s.wallet_rules))
    other = ascii_lower(utrim(answers.member(doc, "kind", "string"))).isin("other", "not_a_transaction")
    skips = (
        wallet
        & (answers.variant_kind(doc) == "object")
        & (answers.variant_kind(answers.member(doc, "kind")) == "text")
        & other
    )
    carried = [c for c in answered.columns if c not in ("answer", "body")]

    def finish(found: Column) -> Column:
        """Records with the fate of their message; one bare row where there is none."""
        flaw = F.when(F.size(found) == 0, "answer holds no transaction object").otherwise(
            F.get(F.filter(found, lambda r: r["parse_error"].isNotNull()), 0)["parse_error"]
        )
        listed = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(None).cast(RECORD)))
        return let(
            flaw,
            lambda e: F.transform(
                listed,
                lambda r: F.struct(r.alias("record"), F.when(~F.col("_skip"), e).alias("message_error")),
            ),
        )

    typed = docs.select(
        *carried,
        F.when(wallet, usd_transaction_total(F.col("body"))).alias("_usd"),
        F.coalesce(skips, F.lit(False)).alias("_skip"),
        F.transform(answers.objects_of(doc), lambda o: _typed(o, sources)).alias("_records"),
    )
    # The fate travels inside the exploded array: as a column before the explode, a filter
    # on it would be pushed down and type every answer again.
    rows = typed.select(*carried, "_usd", "_skip", F.posexplode(let(F.col("_records"), finish)).alias("rec_idx", "_f"))
    return rows.select(
        *carried,
        "rec_idx",
        per_source(sources, lambda s: F.lit(s.record_source)).alias("source"),
        "_f.record.external_id",
        F.coalesce("_usd", "_f.record.amount").alias("amount"),
        F.when(F.col("_usd").isNotNull(), "USD").otherwise(F.col("_f.record.currency")).alias("currency"),
        *[
            f"_f.record.{c}"
            for c in ("direction", "txn_date", "merchant", "account_hint", "status", "raw_ref", "parse_error")
        ],
        "_f.message_error",
        F.when(F.col("_skip"), "model classified the mail as no transaction").alias("skip_reason"),
    )


def usable_records(extracted: DataFrame) -> DataFrame:
    """Records of messages that parsed as a whole and were not skipped."""
    return extracted.where(F.col("message_error").isNull() & F.col("skip_reason").isNull())
