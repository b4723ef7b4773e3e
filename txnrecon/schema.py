"""Table schemas, as DDL."""

MESSAGES = (
    "msg_id STRING, subject STRING, from_hdr STRING, text STRING, "
    "attachments ARRAY<STRUCT<blob_id: STRING, content_type: STRING, name: STRING, size: BIGINT>>, "
    "received_at TIMESTAMP"
)
EXTRACTED = (
    "msg_id STRING, rec_idx INT, source STRING, external_id STRING, amount DECIMAL(20,4), currency STRING, "
    "direction STRING, txn_date DATE, merchant STRING, account_hint STRING, status STRING, raw_ref STRING"
)
TRANSFERS = (
    "msg_id STRING, amount DECIMAL(20,4), currency STRING, txn_date DATE, description STRING, external_id STRING, "
    "source_kind STRING, source_key STRING, dest_kind STRING, dest_key STRING"
)
TEXT_RUNS = "stmt_id BIGINT, page INT, run_no INT, x DOUBLE, y DOUBLE, text STRING"
TEXT_ROWS = "stmt_id BIGINT, row_no BIGINT, y DOUBLE, cells ARRAY<STRUCT<x: DOUBLE, text: STRING>>"
CHARGES = (
    "account_id BIGINT, charge_id BIGINT, reference STRING, merchant STRING, amount DECIMAL(20,4), "
    "currency STRING, auth_date DATE"
)
JOURNALS = (
    "account_id BIGINT, journal_id BIGINT, txn_date DATE, amount DECIMAL(20,4), currency STRING, "
    "merchant STRING, external_id STRING"
)
ALIASES = "pos BIGINT, trigger STRING, canonical STRING"
RATES = "from_ccy STRING, to_ccy STRING, rate_date DATE, rate DECIMAL(28,12), fetched_at TIMESTAMP"
PESO_RATES = "currency STRING, venta DECIMAL(28,12)"
ACCOUNTS = "account_id BIGINT, currency STRING, decimals INT"
DIMS = "kind STRING, key STRING, value STRING"
OUTCOME_EVENTS = (
    "ts TIMESTAMP, msg_id STRING, source STRING, disposition STRING, review_reason_category STRING"
)
RUN_EVENTS = (
    "ts TIMESTAMP, processed BIGINT, booked BIGINT, duplicates BIGINT, review BIGINT, skipped BIGINT, "
    "statements BIGINT, corrected BIGINT, deferred BIGINT"
)
STATEMENT_EVENTS = (
    "ts TIMESTAMP, reconciled BIGINT, booked_new BIGINT, payments_booked BIGINT, amount_mismatch BIGINT, "
    "corrected BIGINT, unmatched_booked BIGINT, balance_mismatch BIGINT, deferred BIGINT, review BIGINT, "
    "balance_checked BOOLEAN, balance_delta DECIMAL(24,4)"
)
