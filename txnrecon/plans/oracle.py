"""The same queries as DuckDB SQL, written from the columns rather than from rendered text."""

from __future__ import annotations

from txnrecon.plans import views

_UNITS = ", ".join(f"('{c}', {v})" for c, v in views.UNIT_VALUES.items())

# Views as CTEs; a query names the ones it needs.
CTE = {
    "n_acc": "SELECT greatest(1, count(*) // 60) AS n FROM customer",
    "accounts": f"""
        SELECT account_id, {views.CURRENCY_OF_ACCOUNT} AS currency,
               CASE account_id % 5 WHEN 3 THEN 0 ELSE 2 END AS decimals
        FROM (SELECT DISTINCT c_custkey % n AS account_id FROM customer, n_acc)""",
    "v_orders": """
        SELECT o_orderkey, o_custkey, o_custkey % n AS account_id, substr(o_orderpriority, 1, 1) AS prio,
               o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
               CAST(o_orderdate AS DATE) AS order_date, p_name, p_brand, p_type
        FROM orders, n_acc, part
        WHERE p_partkey = o_orderkey % (SELECT count(*) FROM part)""",
    "rates": f"""
        SELECT from_ccy, to_ccy, rate_date,
               CAST(CAST(micro + micro * (dayofyear(rate_date) % 10) // 1000 AS DECIMAL(12,0))
                    * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(18,6)) AS rate,
               least(CAST(rate_date AS TIMESTAMP), TIMESTAMP '2000-06-30 00:00:00')
                 - to_minutes(dayofyear(rate_date) % 30) AS fetched_at
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS rate_date FROM orders),
             (SELECT f.c AS from_ccy, t.c AS to_ccy, CAST(f.v AS BIGINT) * 1000000 // t.v AS micro
              FROM (VALUES {_UNITS}) AS f(c, v), (VALUES {_UNITS}) AS t(c, v) WHERE f.c <> t.c)
        WHERE isodow(rate_date) < 6""",
}
_NEEDS = {"accounts": ["n_acc"], "v_orders": ["n_acc"]}


#: CTEs that several others read: computed once, whatever the planner would rather do.
_SHARED = {"alert_near", "journals", "exact", "near", "cand", "asked", "decided"}


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` with the named CTEs and what they depend on."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in _SHARED else ''}({CTE[name]})" for name in order)
    body = body.strip()
    joiner = ",\n" if body.upper().startswith("WITH ") else "\n"
    return f"WITH {ctes}{joiner}{body[5:] if joiner[0] == ',' else body}"


ORACLE: dict[str, str] = {}

ORACLE["fx_asof_convert"] = with_views(
    "accounts v_orders rates",
    f"""
    WITH paid AS (
      SELECT o_orderkey, account_id, {views.ORDER_CURRENCY} AS currency, order_date AS txn_date, amount FROM v_orders
    ), rated AS (
      SELECT p.*, a.currency AS account_currency, a.decimals,
             CASE WHEN p.currency = a.currency THEN CAST(1 AS DECIMAL(18,6)) ELSE r.rate END AS rate
      FROM paid p JOIN accounts a USING (account_id)
      ASOF LEFT JOIN rates r ON p.currency = r.from_ccy AND a.currency = r.to_ccy AND p.txn_date >= r.rate_date
    )
    SELECT o_orderkey, currency, account_currency, txn_date, rate,
           CAST(CASE WHEN currency = account_currency THEN amount
                     WHEN decimals = 0 THEN round_even(amount * rate, 0)
                     ELSE round_even(amount * rate, 2) END AS DECIMAL(24,2)) AS booked_amount,
           CASE WHEN currency <> account_currency THEN amount END AS foreign_amount,
           CASE WHEN rate IS NULL THEN 'rate unavailable' END AS defer_reason
    FROM rated
    """,
)

_LINE_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(expr: str) -> str:
    return f"translate({expr}, '{_UP}', '{_LOW}')"


def _trim_zeros(expr: str) -> str:
    """Decimal text without trailing zeros; ``expr`` has a fraction."""
    return f"rtrim(rtrim(CAST({expr} AS VARCHAR), '0'), '.')"


def _case(column: str, values: dict[str, str]) -> str:
    arms = " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in values.items())
    return f"CASE {column} {arms} END"


def _status_texts() -> dict[str, str]:
    from txnrecon.plans import catalog

    return catalog.STATUS_TEXTS


ORACLE["amount_gate"] = f"""
    WITH p AS (SELECT {_LINE_KEY}, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem)
    SELECT {_LINE_KEY},
           CAST(CASE WHEN l_linenumber IN (1, 6) OR (l_linenumber = 2 AND v < 1000) THEN v END AS DECIMAL(18,4)) AS amount,
           CAST(CASE WHEN l_linenumber IN (1, 2, 6) THEN v END AS DECIMAL(18,4)) AS without_commas,
           CASE l_linenumber WHEN 4 THEN CAST(-v AS DECIMAL(18,4))
                WHEN 5 THEN CAST(CAST(v AS VARCHAR) || '1' AS DECIMAL(18,4)) ELSE CAST(v AS DECIMAL(18,4)) END AS loose,
           CASE WHEN l_linenumber IN (1, 6) OR (l_linenumber = 2 AND v < 1000) THEN {_trim_zeros("v")} END AS shown
    FROM p
"""


def _status_class(said: str) -> str:
    from txnrecon.functions import status

    def some(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    return f"""CASE WHEN list_has_any({said}, {some(status.REJECT_TOKENS)}) THEN 'declined'
        WHEN list_has_any({said}, {some(status.IN_FLIGHT_TOKENS)}) THEN 'other'
        WHEN list_has_any({said}, {some(status.APPROVE_TOKENS)}) THEN 'approved' ELSE 'other' END"""


ORACLE["status_class"] = with_views(
    "v_orders",
    f"""
    WITH said AS (
      SELECT 'order' AS kind, o_orderkey AS id, {_case("prio || status", _status_texts())} AS said FROM v_orders
      UNION ALL SELECT 'document', doc_id, text FROM documents
    ), n AS (
      SELECT kind, id, trim(regexp_replace({_ascii_lower("said")}, '[^a-z0-9]+', ' ', 'g')) AS norm FROM said
    )
    SELECT kind, id, {_status_class("string_split(norm, ' ')")} AS status_class, md5(norm) AS normalized_md5 FROM n
    """,
)

ORACLE["merchant_text"] = f"""
    SELECT doc_id,
           md5({_ascii_lower("trim(regexp_replace(text, '[[:space:]\\x{00A0}]+', ' ', 'g'))")}) AS canon_md5,
           CAST(len(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) >= 2)) AS INTEGER)
             AS n_tokens
    FROM documents
"""

ORACLE["noise_trim"] = """
    WITH whole AS (
      SELECT page_id, CASE WHEN contains(url, '?') THEN
        'You paid' || chr(10) || chr(10) || chr(10) || chr(10) || '<' || url || '>' || chr(10) || '[image: logo' || chr(10)
        || 'of us]' || chr(10) || chr(10) || replace(html, '<p>', '<https://p>' || chr(10) || chr(10) || chr(10))
        || chr(10) || 'Help & Contact <https://end' ELSE html END AS body FROM pages
    ), cut AS (
      SELECT page_id, body,
             CASE WHEN instr(body, 'Help & Contact') > 0 THEN left(body, instr(body, 'Help & Contact') - 1) ELSE body END AS core,
             contains(body, '<http://') OR contains(body, '<https://') OR contains(body, '[image:')
               OR contains(body, 'Help & Contact') AS noisy
      FROM whole
    ), t AS (
      SELECT page_id, CASE WHEN noisy THEN
        regexp_replace(regexp_replace(core, '<https?://[^>]*(?:>|\\z)|\\[image:[^\\]]*(?:\\]|\\z)', '', 'g'),
                       '\\n{3,}', chr(10) || chr(10), 'g') ELSE body END AS t FROM cut
    )
    SELECT page_id, md5(t) AS trimmed_md5, CAST(length(t) AS INTEGER) AS trimmed_chars FROM t
"""

ORACLE["html_text"] = """
    WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<head\\b[^>]*>.*?</head\\s*>|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<!--.*?-->|<![a-z][^>]*>', '', 'g') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g') AS t FROM a),
    c AS (SELECT page_id, regexp_replace(t, '(?i)<br\\s*/?>|</(?:p|div|li|ul|ol|tr|h[1-6]|article|table|nav)\\s*>', chr(10), 'g') AS t FROM b),
    d AS (SELECT page_id, regexp_replace(t, '<[^>]*>', '', 'g') AS t FROM c),
    e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
                 '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM d),
    f AS (SELECT page_id, regexp_replace(t, ' *\\n[ \\n]*', chr(10), 'g') AS t FROM e),
    g AS (SELECT page_id, regexp_replace(t, '^[ \\n]+|[ \\n]+\\z', '', 'g') AS t FROM f)
    SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS chars FROM g
"""

ORACLE["win1252_text"] = """
    SELECT doc_id, md5(translate(regexp_replace(text, '[^\\x00-\\x7F\\x{00A0}-\\x{00FF}]', '?', 'g'),
        'abcdefghijklmnopqrstuvwxyz012345', '€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ')) AS decoded_md5
    FROM documents
"""

CTE["order_records"] = f"""
    SELECT o_orderkey, account_id, CASE WHEN prio IN ('1', '3') THEN 'paypal' ELSE 'banco_popular' END AS source,
           {_case("prio || status", _status_texts())} AS status,
           CASE WHEN prio || status = '2F' THEN 'in' ELSE 'out' END AS direction,
           CAST(CASE WHEN prio || status = '3F' THEN 0 ELSE amount END AS DECIMAL(18,4)) AS amount,
           CASE WHEN prio || status = '4F' THEN 'XXX' ELSE {views.ORDER_CURRENCY} END AS currency,
           CASE WHEN prio || status = '5F' AND account_id % 2 = 0 THEN ' ' ELSE p_name END AS merchant,
           CASE account_id % 3 WHEN 0 THEN 'Pay in 4' WHEN 1 THEN 'VISA' END AS account_hint,
           order_date AS txn_date, prio || status AS kase
    FROM v_orders"""
_NEEDS["order_records"] = ["v_orders"]

# Class of the written status of each case.
_APPROVED = ("1F", "2F", "3F", "4F", "5F")
_DECLINED = ("1P", "2P", "3P", "4P")

ORACLE["validate_gates"] = with_views(
    "order_records",
    f"""
    WITH r AS (
      SELECT *, CASE WHEN kase IN {_DECLINED} THEN 'status_declined: ' || status
                     WHEN kase NOT IN {_APPROVED} THEN 'status_unclear: ' || status
                     WHEN direction = 'in' THEN 'direction_in: incoming (deposit/refund), routed to review'
                     WHEN amount <= 0 THEN 'amount_not_positive: 0'
                     WHEN currency = 'XXX' THEN 'currency_unknown: XXX'
                     WHEN merchant = ' ' THEN 'merchant_empty' END AS review_reason
      FROM order_records
    )
    SELECT o_orderkey, CASE WHEN review_reason IS NULL THEN 'booked' ELSE 'review' END AS verdict, review_reason,
           CASE WHEN review_reason IS NULL THEN NULL WHEN kase = '2F' THEN 'over_ceiling'
                WHEN kase = '4F' THEN 'currency_mismatch' ELSE 'other' END AS review_category
    FROM r
    """,
)

ORACLE["transfer_gates"] = with_views(
    "order_records",
    """
    WITH r AS (
      SELECT o_orderkey, CASE WHEN kase = '3F' THEN 'amount_not_positive: 0'
                              WHEN kase = '4F' THEN 'currency_unknown: XXX'
                              WHEN merchant = ' ' THEN 'description_empty'
                              WHEN status = '' THEN 'key_empty' END AS review_reason
      FROM order_records
    )
    SELECT o_orderkey, CASE WHEN review_reason IS NULL THEN 'booked' ELSE 'review' END AS verdict, review_reason FROM r
    """,
)

ORACLE["review_category"] = """
    SELECT event_id,
           ['not_a_forward', 'no_adapter', 'double_book', 'over_ceiling', 'currency_mismatch', 'no_account',
            'extraction', 'extraction', 'other', 'over_ceiling'][user_id % 10 + 1] AS category,
           ['not_a_forward', 'no_adapter', 'double_book', 'over_ceiling', 'currency_mismatch', 'no_account',
            'extraction', 'extraction', 'other', 'incoming'][user_id % 10 + 1] AS split_category,
           CASE WHEN event_id % 7 IN (4, 5) THEN 'review' ELSE 'defer' END AS http_fate
    FROM events
"""

ORACLE["usd_ceiling"] = with_views(
    "order_records rates",
    f"""
    WITH r AS (
      SELECT o.*, CASE WHEN currency = 'USD' THEN CAST(1 AS DECIMAL(18,6)) ELSE r.rate END AS rate
      FROM order_records o
      ASOF LEFT JOIN (SELECT * FROM rates WHERE to_ccy = 'USD') r
        ON o.currency = r.from_ccy AND o.txn_date >= r.rate_date
    )
    SELECT o_orderkey, CAST(round_even(amount * rate, 2) AS DECIMAL(24,2)) AS usd_equivalent,
           CASE WHEN amount * rate > 400000
                THEN 'worth USD ' || {_trim_zeros("CAST(round_even(amount * rate, 2) AS DECIMAL(24,2))")}
                     || ', above 400000: routed to review' END AS ceiling_reason,
           CASE WHEN rate IS NULL THEN 'rate unavailable' END AS defer_reason
    FROM r
    """,
)

CTE["peso_rates"] = """
    SELECT from_ccy AS currency, arg_max(rate, rate_date) AS venta FROM rates WHERE to_ccy = 'DOP' GROUP BY from_ccy"""
_NEEDS["peso_rates"] = ["rates"]

ORACLE["dop_inverse_rate"] = with_views(
    "order_records peso_rates",
    """
    WITH r AS (
      SELECT o_orderkey, currency, CASE WHEN currency = 'DOP' THEN 'USD' ELSE 'DOP' END AS to_ccy
      FROM order_records
    )
    SELECT o_orderkey, r.currency, to_ccy,
           CAST(CASE WHEN r.currency = 'DOP' THEN round(1.0 / venta, 6) ELSE venta END AS DECIMAL(18,6)) AS rate
    FROM r LEFT JOIN peso_rates p ON p.currency = CASE WHEN r.currency = 'DOP' THEN to_ccy ELSE r.currency END
    """,
)

CTE["dims"] = """
    SELECT 'account' AS kind, CASE currency WHEN 'USD' THEN 'banco_popular_usd' WHEN 'EUR' THEN 'paypal_credit'
             WHEN 'GBP' THEN 'paypal_balance' WHEN 'JPY' THEN 'banco_popular_paying_usd' ELSE 'banco_popular_dop' END AS key,
           CAST(min(account_id) AS VARCHAR) AS value
    FROM accounts GROUP BY currency
    UNION ALL
    SELECT kind, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'), CAST(min(c_custkey % n) AS VARCHAR)
    FROM customer, n_acc, (VALUES ('paypal_funding_last4'), ('swift_debtor_last4')) k(kind)
    WHERE c_mktsegment <> 'HOUSEHOLD' GROUP BY kind, c_custkey % 10000
    UNION ALL
    SELECT 'creditor_bic', 'BANK' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '2A', CAST(n_nationkey AS VARCHAR)
    FROM nation WHERE n_regionkey <> 0"""
_NEEDS["dims"] = ["accounts", "n_acc"]

ORACLE["account_route"] = with_views(
    "order_records dims",
    """
    WITH r AS (
      SELECT o_orderkey, CASE WHEN source = 'paypal' THEN
               CASE WHEN account_hint = 'Pay in 4' THEN 'paypal_credit' ELSE 'paypal_balance' END
             WHEN currency = 'DOP' THEN 'banco_popular_dop' ELSE 'banco_popular_usd' END AS routed_account
      FROM order_records
    )
    SELECT o_orderkey, routed_account, d.value AS routed_id,
           CASE WHEN d.value IS NULL THEN 'no account is set for ' || routed_account END AS route_reason
    FROM r LEFT JOIN dims d ON d.kind = 'account' AND d.key = routed_account
    """,
)

ORACLE["transfer_route"] = with_views(
    "order_records dims",
    """
    SELECT o_orderkey, s.value AS source_account_id, t.value AS dest_account_id,
           CASE WHEN s.value IS NULL THEN 'no paying account configured'
                WHEN t.value IS NULL THEN 'no card account configured' END AS route_reason
    FROM order_records o
    LEFT JOIN dims s ON s.kind = 'account' AND s.key =
      CASE WHEN o.currency = 'DOP' THEN 'banco_popular_paying_dop' ELSE 'banco_popular_paying_usd' END
    LEFT JOIN dims t ON t.kind = 'account' AND t.key =
      CASE WHEN o.currency = 'DOP' THEN 'banco_popular_dop' ELSE 'banco_popular_usd' END
    """,
)

ORACLE["dedup_key"] = f"""
    SELECT {_LINE_KEY},
           CASE WHEN l_returnflag = 'A' THEN 'T' || l_orderkey ELSE
             sha256('banco_popular|' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || '|'
               || {_trim_zeros("CAST(l_extendedprice AS DECIMAL(18,4))")} || '|'
               || CASE WHEN l_linestatus = 'O' THEN 'USD' ELSE 'EUR' END || '|Shop ' || l_suppkey || '|'
               || CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber AS VARCHAR) ELSE '' END || '|posted') END AS external_id
    FROM lineitem
"""

ORACLE["dedup_first_wins"] = f"""
    WITH r AS (
      SELECT {_LINE_KEY}, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey * 10 + l_linenumber) AS rn
      FROM lineitem
    )
    SELECT {_LINE_KEY},
           CASE WHEN rn > 1 OR l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
                THEN 'duplicate' ELSE 'booked' END AS outcome
    FROM r
"""

_OTHER = "CASE WHEN kase = '5O' AND account_id % 2 = 0"
CTE["mail"] = """
    SELECT *, CAST(o_orderkey AS VARCHAR) AS msg_id, prio || status AS kase, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key,
           lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS card, account_id % 2 = 0 AS even
    FROM v_orders"""
_NEEDS["mail"] = ["v_orders"]
_ADAPTER = (
    "CASE WHEN prio = '1' OR kase = '5F' THEN 'paypal' WHEN prio IN ('2', '4') THEN 'banco_popular' "
    "WHEN prio = '3' THEN 'paypal_payment' END"
)



def _sql_text(template: str, **values: str) -> str:
    """A mail template as a SQL concatenation."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += ["'" + head.replace("'", "''") + "'", values[name]]
    parts.append("'" + rest.replace("'", "''") + "'")
    return " || ".join(p for p in parts if p != "''")


def _by_status(paid: str, open_: str, other: str) -> str:
    return f"CASE status WHEN 'F' THEN '{paid}' WHEN 'O' THEN '{open_}' ELSE '{other}' END"


_WALLET_BODY = _sql_text(
    views.WALLET_BODY, merchant="p_name", amount="amt", key="key", day="day", ccy=_by_status("EUR", "USD", "GBP"),
    state=_by_status("approved", "pending", "successfully refunded"),
    funding="CASE WHEN even THEN 'Pay in 4' ELSE 'PayPal balance' END",
    total="CASE WHEN status = 'F' THEN 'Total amount of this Transaction: $' "
    "|| CAST(CAST(amount * 1.25 AS DECIMAL(18,2)) AS VARCHAR) || ' USD' || chr(10) ELSE '' END",
)
_ALERT_BODY = _sql_text(
    views.ALERT_BODY, card="card", prefix=_by_status("EUR$", "US$", "RD$"), amount="grouped",
    name=_by_status("Euro", "Dólar", "Peso dominicano"), day="strftime(order_date, '%d/%m/%Y')", merchant="p_name",
    state=_by_status("Aprobada", "Pendiente", "Declinada"),
)
_PAYMENT_BODY = _sql_text(
    views.PAYMENT_BODY, amount="grouped", day="day", key="key",
    proof=_by_status("PayPal Credit will receive it soon", "PayPal Credit will receive it soon", "About your dispute"),
    funding="CASE WHEN status <> 'O' THEN 'Paid with' || chr(10) || 'FIRST BANK fx-99 x-' || card || chr(10) || chr(10) "
    "|| 'Thank you' ELSE 'Thank you' END",
)
_WIRE_BODY = _sql_text(
    views.WIRE_BODY, n=_by_status("1", "1", "2"), key="key", amount="grouped", day="CAST(order_date AS VARCHAR)",
    instructed=_by_status("USD", "DOP", "USD"), card="card",
    bic="'BANK' || lpad(CAST(o_custkey % 25 AS VARCHAR), 2, '0') || '2A'",
    creditor="CASE WHEN even THEN '<Nm> ' || p_name || ' </Nm>' ELSE '' END",
)

ORACLE["unwrap_sender"] = with_views(
    "mail",
    f"""
    WITH m AS (
      SELECT *, CAST(amount AS VARCHAR) AS amt, strftime(order_date, '%B %-d, %Y') AS day,
             format('{{:,.2f}}', CAST(amount AS DOUBLE)) AS grouped FROM mail
    )
    SELECT msg_id,
           CASE WHEN prio = '1' OR kase = '5F' THEN 'service@paypal.com'
                WHEN prio IN ('2', '4') THEN 'notificaciones@popularenlinea.com'
                WHEN prio = '3' THEN 'customercare@paypal.com' WHEN kase = '5P' THEN 'buyer@example.com'
                WHEN NOT even THEN 'news@example.org' END AS original_sender,
           CASE WHEN prio = '1' THEN 'You paid ' || p_name WHEN prio = '3' THEN 'Receipt for your payment to PayPal Credit'
                WHEN kase = '5F' THEN 'Your order is on its way' END AS original_subject,
           md5(CASE WHEN prio = '1' THEN {_WALLET_BODY} WHEN prio = '2' THEN {_ALERT_BODY}
                    WHEN prio = '3' THEN {_PAYMENT_BODY} WHEN prio = '4' THEN {_WIRE_BODY}
                    WHEN kase = '5F' THEN 'Parcel ' || key || ' left us.'
                    WHEN kase = '5O' AND even THEN 'From: service@paypal.com' || chr(10) ELSE 'Hello' END) AS body_md5
    FROM m
    """,
)

ORACLE["source_dispatch"] = with_views(
    "mail",
    f"""
    SELECT msg_id, {_ADAPTER} AS adapter,
           CASE WHEN kase = '5P' THEN 'statement' WHEN kase IN ('5F', '3P') THEN 'skip' WHEN prio = '5' THEN 'review'
                WHEN prio IN ('1', '2') THEN 'model' ELSE 'deterministic' END AS branch,
           CASE WHEN kase IN ('5F', '3P') THEN 'not a transaction notification'
                WHEN kase = '5O' AND even THEN 'unwrap_failed: not a recognisable forward'
                WHEN kase = '5O' THEN 'source_unknown: no adapter' END AS branch_reason
    FROM mail
    """,
)

ORACLE["receipt_parse"] = with_views(
    "mail",
    """
    SELECT msg_id, CAST(amount AS DECIMAL(18,4)) AS amount, 'USD' AS currency, order_date AS txn_date,
           'Payment to PayPal Credit' AS description, 'pp-payment:P' || key AS external_id,
           'paypal_funding_last4' AS source_kind, CASE WHEN status = 'F' THEN card END AS source_key,
           'paypal_credit' AS dest_kind, 'paypal_credit' AS dest_key,
           CASE WHEN status = 'O' THEN 'no funding last-4 under paid with' END AS parse_error
    FROM mail WHERE prio = '3' AND status <> 'P'
    """,
)

ORACLE["wire_parse"] = with_views(
    "mail",
    """
    SELECT msg_id, CAST(amount AS DECIMAL(18,4)) AS amount, 'USD' AS currency, order_date AS txn_date,
           CASE WHEN even THEN 'SWIFT wire to ' || p_name
                ELSE 'International transfer (BANK' || lpad(CAST(o_custkey % 25 AS VARCHAR), 2, '0') || '2A)' END AS description,
           'swift:' || key AS external_id, 'swift_debtor_last4' AS source_kind, card AS source_key,
           'creditor_bic' AS dest_kind, 'BANK' || lpad(CAST(o_custkey % 25 AS VARCHAR), 2, '0') || '2A' AS dest_key,
           CASE status WHEN 'P' THEN 'multi-transaction wire not supported'
                       WHEN 'O' THEN 'cross-currency wire not supported' END AS parse_error
    FROM mail WHERE prio = '4'
    """,
)

ORACLE["model_json_normalise"] = with_views(
    "mail",
    """
    WITH shape AS (
      SELECT *, unnest(CASE
        WHEN kase IN ('1F', '1P', '5F') THEN [{'i': 0, 'k': 'obj', 'e': NULL, 'm': NULL}]
        WHEN kase = '1O' THEN [{'i': 0, 'k': 'obj', 'e': NULL, 'm': NULL}, {'i': 1, 'k': 'obj', 'e': NULL, 'm': NULL}]
        WHEN kase = '2F' THEN [{'i': 0, 'k': 'num', 'e': NULL, 'm': NULL}]
        WHEN kase = '2O' THEN [{'i': 0, 'k': 'num', 'e': NULL, 'm': NULL}, {'i': 1, 'k': 'grp', 'e': NULL, 'm': NULL}]
        WHEN kase = '2P' THEN [{'i': 0, 'k': 'grp', 'e': NULL, 'm': NULL}]
        WHEN kase = '3F' THEN [{'i': 0, 'k': 'other', 'e': 'amount rejected', 'm': NULL}]
        WHEN kase = '3O' THEN [{'i': 0, 'k': 'obj', 'e': NULL, 'm': 'missing merchant'},
                               {'i': 1, 'k': 'none', 'e': 'missing merchant', 'm': 'missing merchant'}]
        WHEN kase = '4P' THEN [{'i': 0, 'k': 'obj', 'e': NULL, 'm': 'expected a JSON object'},
                               {'i': 1, 'k': 'five', 'e': 'expected a JSON object', 'm': 'expected a JSON object'}]
        WHEN kase = '5O' THEN [{'i': 0, 'k': 'badccy', 'e': 'missing or malformed code', 'm': 'missing or malformed code'}]
        WHEN kase = '5P' THEN [{'i': 0, 'k': 'badamt', 'e': 'amount rejected', 'm': 'amount rejected'}]
        ELSE [{'i': 0, 'k': 'empty', 'e': NULL, 'm': 'answer holds no transaction object'}] END) AS s
      FROM mail
    ), t AS (SELECT *, s.i AS i, s.k AS k FROM shape)
    SELECT msg_id, i AS rec_idx, CASE WHEN prio = '2' THEN 'banco_popular' ELSE 'paypal' END AS source,
           CASE WHEN k IN ('obj', 'badccy', 'badamt') THEN 'E' || o_orderkey END AS external_id,
           CAST(CASE WHEN k IN ('obj', 'num', 'grp', 'badccy') THEN amount WHEN k = 'none' THEN 1 END AS DECIMAL(18,4)) AS amount,
           CASE WHEN k = 'none' THEN 'USD' WHEN k IN ('obj', 'badamt') THEN 'USD' WHEN k = 'num' THEN 'EUR' WHEN k = 'grp' THEN 'DOP' END AS currency,
           CASE WHEN k = 'empty' THEN NULL WHEN k IN ('obj', 'badccy', 'badamt') THEN 'in' ELSE 'out' END AS direction,
           CASE WHEN k IN ('obj', 'num', 'grp', 'badccy', 'badamt') THEN order_date WHEN k = 'none' THEN DATE '2020-01-01' END AS txn_date,
           CASE WHEN k IN ('obj', 'badccy', 'badamt') THEN 'Corner } ' || p_name WHEN k IN ('num', 'grp') THEN p_name END AS merchant,
           CAST(NULL AS VARCHAR) AS account_hint,
           CASE WHEN k = 'empty' THEN NULL WHEN k IN ('obj', 'badccy', 'badamt') THEN 'Approved' WHEN k = 'num' THEN 'Aprobada' ELSE '' END AS status,
           CASE WHEN k = 'empty' THEN NULL WHEN k IN ('obj', 'badccy', 'badamt') THEN 'E' || o_orderkey WHEN k = 'num' THEN 'r' ELSE '' END AS raw_ref,
           s.e AS parse_error, s.m AS message_error,
           CASE WHEN kase = '3F' THEN 'model classified the mail as no transaction' END AS skip_reason
    FROM t
    """,
)

# The message path, record by record, from the order's columns.
CTE["alert_near"] = """
    SELECT DISTINCT m.o_orderkey FROM mail m, dims d, journals j
    WHERE m.kase = '2F' AND d.key = 'banco_popular_usd' AND d.kind = 'account'
      AND j.account_id = CAST(d.value AS BIGINT) AND starts_with(j.external_id, 'bpstmt:')
      AND abs(date_diff('day', m.order_date, j.txn_date)) <= 5
      AND (jaro_winkler_similarity(m.p_name, lower(j.merchant)) >= 0.70
           OR list_has_any(string_split(m.p_name, ' '), string_split(lower(j.merchant), ' ')) AND
              len(list_filter(string_split(m.p_name, ' '), lambda t: list_contains(string_split(lower(j.merchant), ' '), t)))
                / len(string_split(m.p_name, ' ')) >= 0.70)"""
_NEEDS["alert_near"] = ["mail", "dims", "journals"]

CTE["journals"] = f"""
    SELECT account_id, o_orderkey * 2 + copy AS journal_id,
           CASE kase WHEN '2F' THEN order_date + 3 WHEN '2P' THEN order_date + 9 ELSE order_date END AS txn_date,
           CASE kase WHEN '1P' THEN CAST(amount * 1.03 AS DECIMAL(18,2)) ELSE amount END AS amount,
           CASE kase WHEN '3P' THEN 'CHF' ELSE {views.CURRENCY_OF_ACCOUNT} END AS currency,
           CASE kase WHEN '2O' THEN p_name || ' ONLINE' WHEN '3F' THEN p_brand || ' ' || p_type ELSE p_name END AS merchant,
           CASE WHEN kase = '1O' THEN 'bpstmt:' || key WHEN prio = '4' THEN 'tx-' || key END AS external_id
    FROM (SELECT *, unnest(CASE WHEN kase = '3O' THEN [0, 1] ELSE [0] END) AS copy FROM mail WHERE kase <> '1F')"""
_NEEDS["journals"] = ["mail"]

ORACLE["message_disposition"] = with_views(
    "mail dims accounts rates alert_near",
    """
    WITH usd AS (SELECT * FROM rates WHERE to_ccy = 'USD'),
    rec AS (
      SELECT m.*, CASE WHEN prio = '1' THEN CAST(amount * 1.25 AS DECIMAL(18,2)) ELSE amount END AS paid,
             CASE WHEN prio = '2' THEN 'EUR' ELSE 'USD' END AS ccy,
             CASE WHEN prio = '1' THEN CASE WHEN even THEN 'paypal_credit' ELSE 'paypal_balance' END
                  WHEN prio = '2' THEN 'banco_popular_usd' WHEN prio = '3' THEN 'paypal_credit' END AS logical
      FROM mail m WHERE kase IN ('1F', '2F', '3F', '4F')
    ), placed AS (
      SELECT rec.*, d.value AS booked_on, s.value AS source_on, b.value AS bic_on
      FROM rec LEFT JOIN dims d ON d.kind = 'account' AND d.key = logical
      LEFT JOIN dims s ON s.kind = CASE prio WHEN '3' THEN 'paypal_funding_last4' WHEN '4' THEN 'swift_debtor_last4' END AND s.key = card
      LEFT JOIN dims b ON prio = '4' AND b.kind = 'creditor_bic' AND b.key = 'BANK' || lpad(CAST(o_custkey % 25 AS VARCHAR), 2, '0') || '2A'
    ), legs AS (
      SELECT p.*, ta.currency AS target_ccy, sa.currency AS source_ccy
      FROM placed p
      LEFT JOIN accounts ta ON ta.account_id = CAST(CASE WHEN prio = '4' THEN bic_on ELSE booked_on END AS BIGINT)
      LEFT JOIN accounts sa ON sa.account_id = CAST(source_on AS BIGINT)
    ), ceil AS (
      SELECT l.*, CASE WHEN ccy = 'USD' THEN 1 ELSE u.rate END AS usd_rate
      FROM legs l ASOF LEFT JOIN usd u ON l.ccy = u.from_ccy AND l.order_date >= u.rate_date
    ), conv AS (
      SELECT c.*, CASE WHEN ccy = target_ccy THEN 1 ELSE r.rate END AS book_rate,
             c.o_orderkey IN (SELECT o_orderkey FROM alert_near) AS doubled
      FROM ceil c ASOF LEFT JOIN rates r ON c.ccy = r.from_ccy AND c.target_ccy = r.to_ccy AND c.order_date >= r.rate_date
    ), fate AS (
      SELECT o_orderkey, CASE
        WHEN prio IN ('3', '4') THEN CASE
          WHEN CASE WHEN prio = '4' THEN bic_on ELSE booked_on END IS NULL OR source_on IS NULL THEN 'review:no_account'
          WHEN paid * usd_rate > 400000 THEN 'review:over_ceiling'
          WHEN source_ccy <> 'USD' THEN 'review:currency_mismatch'
          WHEN book_rate IS NULL THEN 'deferred:' ELSE 'booked:' END
        WHEN usd_rate IS NULL THEN 'deferred:'
        WHEN paid * usd_rate > 400000 THEN 'review:over_ceiling'
        WHEN prio = '2' AND doubled THEN 'review:double_book'
        WHEN booked_on IS NULL THEN 'review:no_account'
        WHEN book_rate IS NULL THEN 'deferred:'
        -- A restated record of a booked key is a duplicate; its message still books unless the ledger had it.
        WHEN prio = '1' AND account_id % 7 = 0 THEN 'duplicate:'
        WHEN prio = '2' AND row_number() OVER same_alert > 1 THEN 'duplicate:'
        ELSE 'booked:' END AS fate
      FROM conv
      WINDOW same_alert AS (PARTITION BY prio, order_date, paid, p_name, card ORDER BY o_orderkey)
    )
    SELECT msg_id,
           CASE WHEN prio = '1' OR kase = '5F' THEN 'paypal' WHEN prio IN ('2', '4') THEN 'banco_popular'
                WHEN prio = '3' THEN 'paypal_payment' ELSE 'unknown' END AS source,
           CASE WHEN fate IS NOT NULL THEN split_part(fate, ':', 1) WHEN kase IN ('5F', '3P') THEN 'skipped' ELSE 'review' END AS disposition,
           CASE WHEN fate IS NOT NULL THEN nullif(split_part(fate, ':', 2), '')
                WHEN kase IN ('5F', '3P') THEN NULL WHEN kase = '5O' AND even THEN 'not_a_forward'
                WHEN kase = '5O' THEN 'no_adapter' WHEN kase = '4O' THEN 'currency_mismatch' ELSE 'other' END AS category
    FROM mail LEFT JOIN fate USING (o_orderkey) WHERE kase <> '5P'
    """,
)


def _similarity(a: str, b: str) -> str:
    """Similarity of two lower-case names of single-spaced words."""
    wa = f"list_filter(string_split({a}, ' '), lambda t: strlen(t) >= 2)"
    wb = f"list_filter(string_split({b}, ' '), lambda t: strlen(t) >= 2)"

    def share(x: str, y: str) -> str:
        return f"len(list_filter({x}, lambda t: list_contains({y}, t))) / len({x})"

    return (
        f"greatest(jaro_winkler_similarity({a}, {b}), "
        f"CASE WHEN len({wa}) <= len({wb}) THEN {share(wa, wb)} ELSE {share(wb, wa)} END)"
    )


ORACLE["alias_canonical"] = """
    WITH rules AS (SELECT lower(p_brand) AS trig, min(p_name) AS canonical, min(p_partkey) AS pos FROM part GROUP BY p_brand),
    named AS (
      SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '  Order ' || p_brand || '  ' || p_type
                             ELSE upper(p_name) || chr(9) || p_type END AS merchant FROM part
    ), hit AS (
      SELECT p_partkey, arg_min(r.canonical, r.pos) AS canonical FROM named JOIN rules r ON contains(lower(merchant), trig) GROUP BY p_partkey
    )
    SELECT n.p_partkey, lower(trim(regexp_replace(coalesce(h.canonical, merchant), '\\s+', ' ', 'g'))) AS canonical
    FROM named n LEFT JOIN hit h USING (p_partkey)
"""

ORACLE["merchant_similarity"] = f"""
    WITH pairs AS (
      SELECT a.p_partkey, a.p_name AS name_a,
             b.p_name || CASE WHEN b.p_size > 25 THEN ' ' || lower(b.p_type) ELSE '' END AS name_b
      FROM part a JOIN part b ON b.p_partkey = (a.p_partkey + 7) % (SELECT count(*) FROM part)
    ), scores AS (SELECT name_a, name_b, {_similarity("name_a", "name_b")} AS s FROM (SELECT DISTINCT name_a, name_b FROM pairs))
    SELECT p_partkey, round(s, 9) AS score FROM pairs JOIN scores USING (name_a, name_b)
"""

CTE["charges"] = f"""
    SELECT account_id, o_orderkey * 2 + extra AS charge_id, CASE WHEN extra = 1 THEN '9' || key ELSE key END AS reference,
           p_name AS merchant, CASE WHEN extra = 1 THEN CAST(amount * 0.5 AS DECIMAL(18,2)) ELSE amount END AS amount,
           {views.CURRENCY_OF_ACCOUNT} AS currency, order_date + extra AS auth_date
    FROM (SELECT *, unnest(CASE WHEN kase = '5P' THEN [0, 1] ELSE [0] END) AS extra FROM mail)"""
_NEEDS["charges"] = ["mail"]

CTE["exact"] = """
    SELECT c.account_id, c.charge_id, j.journal_id FROM charges c
    JOIN journals j ON j.account_id = c.account_id AND j.external_id = 'bpstmt:' || c.reference"""
_NEEDS["exact"] = ["charges", "journals"]

CTE["near"] = """
    SELECT c.account_id, c.charge_id, c.merchant AS cm, lower(j.merchant) AS jm, j.journal_id,
           t.journal_id IS NULL AS is_free
    FROM charges c ANTI JOIN exact e ON e.charge_id = c.charge_id
    JOIN journals j ON j.account_id = c.account_id AND j.currency = c.currency
      AND abs(date_diff('day', c.auth_date, j.txn_date)) <= 5
    LEFT JOIN (SELECT DISTINCT journal_id FROM exact) t ON t.journal_id = j.journal_id"""
_NEEDS["near"] = ["exact"]

CTE["cand"] = f"""
    SELECT n.*, s.score FROM near n
    JOIN (SELECT cm, jm, {_similarity("cm", "jm")} AS score FROM (SELECT DISTINCT cm, jm FROM near)) s USING (cm, jm)
    WHERE s.score >= 0.70"""
_NEEDS["cand"] = ["near"]

CTE["ranked"] = """
    SELECT account_id, charge_id, journal_id, score, row_number() OVER w AS rn, lead(score) OVER w AS second_score
    FROM cand WHERE is_free WINDOW w AS (PARTITION BY account_id, charge_id ORDER BY score DESC, journal_id)"""
_NEEDS["ranked"] = ["cand"]

CTE["asked"] = """
    SELECT c.*, e.journal_id AS exact_journal, p.n AS n_plausible, r.journal_id AS best_journal, r.score AS best_score,
           r.second_score,
           CASE WHEN e.journal_id IS NOT NULL THEN 'exact' WHEN r.score IS NULL THEN 'book'
                WHEN r.score < 0.85 THEN 'review_gray'
                WHEN r.second_score >= 0.85 AND r.score - r.second_score < 0.03 THEN 'review_ambiguous' ELSE 'claim' END AS intent
    FROM charges c LEFT JOIN exact e USING (account_id, charge_id)
    LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r USING (account_id, charge_id)
    LEFT JOIN (SELECT account_id, charge_id, count(*) AS n FROM cand GROUP BY ALL) p USING (account_id, charge_id)"""
_NEEDS["asked"] = ["ranked"]

ORACLE["recon_candidates"] = with_views(
    "asked",
    """
    SELECT account_id, charge_id, intent, n_plausible, best_journal, round(best_score, 9) AS best_score,
           round(second_score, 9) AS second_score FROM asked
    """,
)

CTE["decided"] = """
    SELECT a.account_id, a.charge_id, a.reference, a.amount, a.intent,
           CASE WHEN intent = 'exact' THEN exact_journal
                WHEN intent = 'claim' AND (cl.n = 1 OR (cl.clear AND cl.near_id = a.charge_id)) THEN best_journal END AS journal_id,
           CASE WHEN intent = 'claim' AND cl.n > 1 THEN
             CASE WHEN NOT cl.clear THEN 'several charges contend for one journal'
                  WHEN cl.near_id <> a.charge_id AND a.n_plausible > 1 THEN 'cluster loser with another plausible journal' END
             WHEN intent = 'review_gray' THEN 'possible duplicate in the gray zone'
             WHEN intent = 'review_ambiguous' THEN 'several journals match equally well' END AS reason
    FROM asked a LEFT JOIN (
      SELECT account_id, journal_id, count(*) AS n, arg_min(charge_id, rn) AS near_id,
             coalesce(2 * min(d) FILTER (rn = 1) < min(d) FILTER (rn = 2) AND any_value(jamt) > 0
                      AND 100 * min(d) FILTER (rn = 1) <= 15 * any_value(jamt), false) AS clear
      FROM (SELECT a.account_id, a.best_journal AS journal_id, a.charge_id, j.amount AS jamt, abs(a.amount - j.amount) AS d,
                   row_number() OVER (PARTITION BY a.account_id, a.best_journal ORDER BY abs(a.amount - j.amount), a.charge_id) AS rn
            FROM asked a JOIN journals j ON j.account_id = a.account_id AND j.journal_id = a.best_journal WHERE a.intent = 'claim')
      GROUP BY account_id, journal_id) cl ON a.intent = 'claim' AND cl.account_id = a.account_id AND cl.journal_id = a.best_journal"""
_NEEDS["decided"] = ["asked"]

ORACLE["recon_outcomes"] = with_views(
    "decided",
    """
    SELECT d.account_id, d.charge_id, d.reference,
           CASE WHEN d.journal_id IS NOT NULL THEN CASE WHEN abs(d.amount - j.amount) <= 0.01 THEN 'confirmed' ELSE 'mismatch' END
                WHEN d.reason IS NOT NULL THEN 'review' ELSE 'book_new' END AS outcome,
           d.journal_id, j.amount AS booked, d.reason
    FROM decided d LEFT JOIN journals j ON j.account_id = d.account_id AND j.journal_id = d.journal_id
    """,
)

ORACLE["recon_unmatched"] = with_views(
    "decided",
    """
    SELECT j.account_id, j.journal_id, j.txn_date, j.amount, j.currency, j.merchant
    FROM journals j ANTI JOIN decided d ON d.journal_id = j.journal_id
    """,
)

ORACLE["double_book_probe"] = with_views(
    "v_orders journals",
    f"""
    WITH near AS MATERIALIZED (
      SELECT o.o_orderkey, o.p_name AS cm, lower(j.merchant) AS jm, j.journal_id
      FROM v_orders o JOIN journals j ON j.account_id = o.account_id AND starts_with(j.external_id, 'bpstmt:')
        AND abs(date_diff('day', o.order_date, j.txn_date)) <= 5
    ), hit AS (
      SELECT o_orderkey, min(journal_id) AS statement_journal_id FROM near
      JOIN (SELECT cm, jm, {_similarity("cm", "jm")} AS s FROM (SELECT DISTINCT cm, jm FROM near)) USING (cm, jm)
      WHERE s >= 0.70 GROUP BY o_orderkey
    )
    SELECT o_orderkey, statement_journal_id FROM v_orders LEFT JOIN hit USING (o_orderkey)
    """,
)

ORACLE["amount_correction"] = with_views(
    "charges journals",
    f"""
    WITH m AS (
      SELECT j.journal_id, j.account_id % 5 AS five, j.amount AS booked,
             CAST(c.amount * CASE WHEN j.account_id % 5 = 2 THEN 1.30 ELSE 1.00 END AS DECIMAL(18,2)) AS billed,
             CASE WHEN j.account_id % 5 = 1 THEN j.amount + 1 ELSE j.amount END AS cur
      FROM journals j JOIN charges c ON c.account_id = j.account_id AND c.charge_id = j.journal_id
    ), d AS (
      SELECT *, CASE WHEN five = 3 THEN 'review: journal has several splits' WHEN cur = billed THEN 'noop'
                     WHEN cur <> booked THEN 'review: journal amount changed since reconcile'
                     WHEN booked = 0 THEN 'review: booked estimate is zero'
                     WHEN abs(billed - booked) * 100 > 25 * booked THEN 'review: correction exceeds the bound'
                     ELSE 'corrected' END AS decision FROM m
    )
    SELECT journal_id, decision, CAST(CASE WHEN decision = 'corrected' THEN billed ELSE cur END AS DECIMAL(18,2)) AS new_amount,
           CASE WHEN decision = 'corrected' THEN 'txnrecon,bp-estimate:' || {_trim_zeros("booked")} ELSE 'txnrecon' END AS tags
    FROM d
    """,
)

ORACLE["ledger_payload"] = with_views(
    "order_records accounts rates",
    f"""
    WITH r AS (
      SELECT o.*, a.currency AS target, a.decimals,
             CASE WHEN o.currency = a.currency THEN CAST(1 AS DECIMAL(18,6)) ELSE r.rate END AS rate
      FROM order_records o JOIN accounts a USING (account_id)
      ASOF LEFT JOIN rates r ON o.currency = r.from_ccy AND a.currency = r.to_ccy AND o.txn_date >= r.rate_date
    ), b AS (
      SELECT *, CAST(CASE WHEN currency = target THEN amount WHEN decimals = 0 THEN round_even(amount * rate, 0)
                          ELSE round_even(amount * rate, 2) END AS DECIMAL(24,4)) AS booked FROM r
    )
    SELECT CASE direction WHEN 'out' THEN 'withdrawal' ELSE 'deposit' END AS type, txn_date AS date,
           {_trim_zeros("booked")} AS amount, target AS currency_code, merchant AS description,
           CAST(o_orderkey AS VARCHAR) AS external_id, 'txnrecon' AS tags, account_id AS source_id, merchant AS destination_name,
           CAST(NULL AS VARCHAR) AS destination_id,
           CASE WHEN currency <> target THEN {_trim_zeros("amount")} END AS foreign_amount,
           CASE WHEN currency <> target THEN currency END AS foreign_currency_code, n_name AS category_name
    FROM b LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON n_nationkey = account_id % 10000
    """,
)

ORACLE["stale_rate_keys"] = with_views(
    "v_orders accounts rates",
    f"""
    WITH needed AS (
      SELECT DISTINCT {views.ORDER_CURRENCY} AS from_ccy, a.currency AS to_ccy, order_date AS rate_date
      FROM v_orders JOIN accounts a USING (account_id)
    )
    SELECT * FROM needed n WHERE from_ccy <> to_ccy AND NOT EXISTS (
      SELECT 1 FROM rates r WHERE r.from_ccy = n.from_ccy AND r.to_ccy = n.to_ccy AND r.rate_date = n.rate_date
        AND (r.rate_date < DATE '2000-06-30' OR epoch(TIMESTAMP '2000-06-30 00:10:00') - epoch(r.fetched_at) < 900))
    """,
)

ORACLE["rates_parse"] = with_views("rates", "SELECT from_ccy, to_ccy, rate_date, rate FROM rates")

ORACLE["peso_table_parse"] = with_views(
    "rates", "SELECT rate_date, from_ccy AS currency, rate AS venta FROM rates WHERE to_ccy = 'DOP' AND from_ccy IN ('USD', 'EUR')"
)

ORACLE["ledger_scan"] = with_views(
    "journals",
    """
    SELECT account_id, journal_id, 1 AS split_count, txn_date, CAST(amount AS DECIMAL(18,4)) AS amount,
           CASE WHEN currency <> 'CHF' THEN currency END AS currency, merchant, external_id, currency <> 'CHF' AS is_usable
    FROM journals WHERE account_id % 4 <> 3
    """,
)

ORACLE["alias_rules"] = """
    SELECT p_partkey, lower(p_name) AS trigger, p_type AS canonical FROM part WHERE p_size BETWEEN 5 AND 40
"""

ORACLE["kv_map"] = """
    SELECT CAST(c_custkey // 50 AS VARCHAR) AS kind, lpad(CAST(c_custkey % 30 AS VARCHAR), 2, '0') AS key,
           arg_max(c_name, c_custkey) AS value
    FROM customer GROUP BY c_custkey // 50, c_custkey % 30
"""

# --- statements: folds over the turns of a conversation ---------------------------------

CTE["turns"] = """
    SELECT conv_id, turn, role, text, DATE '1996-01-15' + CAST(conv_id % 900 AS INTEGER) AS cut,
           CAST(length(text) AS DECIMAL(18,2)) + 1000.25 AS money,
           role = 'user' AS is_txn, role = 'assistant' AND turn % 4 = 3 AS closes,
           coalesce(sum(CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 1 ELSE 0 END)
             OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed
    FROM conversations"""

# A section opens where the printed currency changes; the title after turn t is set by
# the number of fourth turns up to t.
CTE["opens"] = """
    SELECT conv_id, -1 AS turn, CASE WHEN conv_id % 2 = 0 THEN 'DOP' ELSE 'USD' END AS currency,
           CAST(conv_id * 10 AS DECIMAL(18,2)) AS anterior
    FROM (SELECT DISTINCT conv_id FROM turns WHERE turn = 0)
    UNION ALL
    SELECT conv_id, turn, CASE WHEN (conv_id + (turn + 1) // 4) % 2 = 0 THEN 'DOP' ELSE 'USD' END, CAST(turn * 100 AS DECIMAL(18,2))
    FROM turns WHERE closes"""
_NEEDS["opens"] = ["turns"]

CTE["sections"] = """
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS section_no,
           lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS until
    FROM (SELECT *, lag(currency) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM opens)
    WHERE before IS NULL OR before <> currency"""
_NEEDS["sections"] = ["opens"]

CTE["txns"] = """
    SELECT t.*, row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn) AS txn_no, s.section_no, s.currency,
           lead(t.turn) OVER (PARTITION BY t.conv_id ORDER BY t.turn) AS next_txn
    FROM turns t JOIN sections s ON s.conv_id = t.conv_id AND t.turn > s.turn AND (s.until IS NULL OR t.turn < s.until)
    WHERE t.is_txn"""
_NEEDS["txns"] = ["sections"]

ORACLE["statement_fold"] = with_views(
    "txns",
    f"""
    WITH follow AS (
      SELECT x.conv_id, x.txn_no, min(a.turn) AS turn FROM txns x
      JOIN turns a ON a.conv_id = x.conv_id AND a.role = 'assistant' AND a.turn > x.turn AND (x.next_txn IS NULL OR a.turn < x.next_txn)
      GROUP BY ALL
    )
    SELECT x.conv_id AS stmt_id, x.txn_no, x.section_no, x.currency,
           x.cut - CAST(x.turn * 7 AS INTEGER) AS posting_date, x.cut - CAST(x.turn * 7 AS INTEGER) AS auth_date,
           lpad(CAST(x.conv_id * 1000 + x.turn AS VARCHAR), 12, '0') AS reference,
           md5(trim(regexp_replace(x.text, '[[:space:]\\x{{00A0}}]+', ' ', 'g'))) AS merchant_md5,
           CAST(x.money AS DECIMAL(18,4)) AS amount, CASE WHEN x.turn % 4 = 2 THEN 'in' ELSE 'out' END AS direction,
           lpad(CAST(length(a.text) % 10000 AS VARCHAR), 4, '0') AS mcc, lpad(CAST(a.turn AS VARCHAR), 6, '0') AS auth_code
    FROM txns x LEFT JOIN follow f USING (conv_id, txn_no) LEFT JOIN turns a ON a.conv_id = f.conv_id AND a.turn = f.turn
    """,
)

CTE["balances"] = """
    SELECT s.conv_id AS stmt_id, s.section_no, s.currency, lpad(CAST(s.conv_id % 10000 AS VARCHAR), 4, '0') AS last4,
           DATE '1996-01-15' + CAST(s.conv_id % 900 AS INTEGER) AS cut_date, CAST(s.anterior AS DECIMAL(18,4)) AS balance_anterior,
           CAST(b.total AS DECIMAL(18,4)) AS balance_total,
           CAST(abs(s.anterior + coalesce(m.moved, 0) - b.total) AS DECIMAL(24,4)) AS delta
    FROM sections s
    LEFT JOIN (SELECT s.conv_id, s.section_no, arg_max(CAST(length(t.text) AS DECIMAL(18,2)), t.turn) AS total
               FROM sections s JOIN turns t ON t.conv_id = s.conv_id AND t.closes AND t.turn > s.turn AND (s.until IS NULL OR t.turn <= s.until)
               GROUP BY ALL) b USING (conv_id, section_no)
    LEFT JOIN (SELECT conv_id, section_no, sum(CASE WHEN turn % 4 = 2 THEN -money ELSE money END) AS moved FROM txns GROUP BY ALL) m
      USING (conv_id, section_no)"""
_NEEDS["balances"] = ["txns"]

ORACLE["balance_check"] = with_views(
    "balances",
    "SELECT *, delta IS NOT NULL AS balance_checked, coalesce(delta > 0.01, false) AS balance_mismatch FROM balances",
)

ORACLE["row_grouping"] = """
    WITH RECURSIVE runs AS (
      SELECT l_suppkey AS stmt_id, l_linenumber AS page, l_orderkey * 1000000 + l_partkey AS run_no, l_quantity AS x,
             CAST(700.0 AS DOUBLE) - dayofyear(l_shipdate) * CAST(1.3 AS DOUBLE) AS y, 'p' || l_partkey AS text
      FROM lineitem
    ), heights AS (SELECT DISTINCT stmt_id, page, y FROM runs),
    anchors AS (
      SELECT stmt_id, page, 1 AS row_no, max(y) AS y FROM heights GROUP BY stmt_id, page
      UNION ALL
      SELECT a.stmt_id, a.page, a.row_no + 1, (SELECT max(h.y) FROM heights h WHERE h.stmt_id = a.stmt_id AND h.page = a.page AND a.y - h.y > 2.5)
      FROM anchors a WHERE a.y IS NOT NULL
    ), spans AS (
      SELECT *, lead(y) OVER (PARTITION BY stmt_id, page ORDER BY row_no) AS below FROM anchors WHERE y IS NOT NULL
    )
    SELECT s.stmt_id, s.page, s.row_no, round(s.y, 6) AS y, CAST(count(*) AS INTEGER) AS n_cells,
           md5(string_agg(r.text, ' ' ORDER BY r.y DESC, r.x, r.run_no)) AS text_md5
    FROM spans s JOIN runs r ON r.stmt_id = s.stmt_id AND r.page = s.page AND r.y <= s.y AND (s.below IS NULL OR r.y > s.below)
    GROUP BY s.stmt_id, s.page, s.row_no, s.y
"""

# --- scoring ---------------------------------------------------------------------------

CTE["field_scores"] = """
    SELECT * FROM (
      WITH e AS (
        SELECT l.doc_id AS example, quality, toxic, lang, n_chars,
               trim(regexp_replace(text, '[[:space:]\\x{00A0}]+', ' ', 'g')) <> '' AS named, model
        FROM labels l JOIN documents USING (doc_id), (VALUES ('alpha'), ('beta'), ('gamma')) m(model)
      ), s AS (
        SELECT *, quality = 1 AS real, quality = 1 OR model = 'gamma' AS answered FROM e
      )
      SELECT model, example, unnest([
          {'field': 'kind', 'score': CASE WHEN real = answered THEN 'correct' ELSE 'wrong' END},
          {'field': 'amount', 'score': CASE WHEN NOT real THEN 'na' WHEN model = 'beta' AND toxic = 1 THEN 'wrong' ELSE 'correct' END},
          {'field': 'currency', 'score': CASE WHEN NOT real THEN 'na' ELSE 'correct' END},
          {'field': 'direction', 'score': CASE WHEN NOT real THEN 'na' ELSE 'correct' END},
          {'field': 'date', 'score': CASE WHEN NOT real THEN 'na' WHEN model = 'gamma' THEN 'wrong' ELSE 'correct' END},
          {'field': 'merchant', 'score': CASE WHEN NOT real THEN 'na' ELSE 'correct' END},
          {'field': 'status', 'score': CASE WHEN NOT real THEN 'na' WHEN model = 'beta' AND n_chars % 2 = 1 THEN 'wrong' ELSE 'correct' END},
          {'field': 'account', 'score': CASE WHEN NOT real OR toxic = 1 THEN 'na' ELSE 'correct' END}], recursive := true)
      FROM s)"""

ORACLE["field_scores"] = with_views("field_scores", "SELECT model, example, field, score FROM field_scores")

ORACLE["accuracy_matrix"] = with_views(
    "field_scores",
    """
    WITH t AS (
      SELECT model, coalesce(field, 'overall') AS field, count(*) FILTER (score = 'correct') AS c, count(*) FILTER (score <> 'na') AS n
      FROM field_scores GROUP BY GROUPING SETS ((model, field), (model))
    ), a AS (SELECT model, field, CASE WHEN n > 0 THEN round(c / n, 9) END AS acc FROM t)
    SELECT model, max(acc) FILTER (field = 'kind') AS kind, max(acc) FILTER (field = 'amount') AS amount,
           max(acc) FILTER (field = 'currency') AS currency, max(acc) FILTER (field = 'direction') AS direction,
           max(acc) FILTER (field = 'date') AS date, max(acc) FILTER (field = 'merchant') AS merchant,
           max(acc) FILTER (field = 'status') AS status, max(acc) FILTER (field = 'account') AS account,
           max(acc) FILTER (field = 'overall') AS overall
    FROM a GROUP BY model
    """,
)

# --- monitoring ------------------------------------------------------------------------

CTE["outcomes"] = """
    SELECT ts, event_id, CAST(event_id AS VARCHAR) AS msg_id,
           ['paypal', 'paypal_payment', 'banco_popular', 'unknown'][user_id % 4 + 1] AS source,
           CASE event_type WHEN 'purchase' THEN 'booked' WHEN 'click' THEN 'duplicate' WHEN 'view' THEN 'skipped'
                WHEN 'signup' THEN 'deferred' ELSE 'review' END AS disposition, value
    FROM events"""

ORACLE["outcome_events"] = with_views(
    "outcomes",
    """
    SELECT ts, msg_id, source, disposition, CASE WHEN disposition = 'review' THEN
             ['not_a_forward', 'no_adapter', 'double_book', 'over_ceiling', 'currency_mismatch', 'no_account', 'extraction',
              'extraction', 'other', 'over_ceiling'][event_id % 10 + 1] END AS review_reason_category
    FROM outcomes
    """,
)

ORACLE["outcome_rate_5m"] = with_views(
    "outcomes",
    "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, source, disposition, count(*) AS n FROM outcomes GROUP BY ALL",
)

ORACLE["review_1h"] = with_views(
    "outcomes",
    """
    WITH r AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS t0 FROM outcomes WHERE disposition = 'review'),
    w AS (SELECT t0 - to_minutes(CAST(5 * k AS INTEGER)) AS window_start FROM r, range(12) t(k))
    SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM w GROUP BY ALL
    """,
)

ORACLE["last_value_3h"] = with_views(
    "outcomes",
    """
    SELECT time_bucket(INTERVAL 5 MINUTE, ts) + to_minutes(CAST(5 * k AS INTEGER)) AS window_end, source,
           arg_max(value, (ts, event_id)) AS value
    FROM outcomes, range(1, 37) t(k) GROUP BY ALL
    """,
)

ORACLE["sustained_alert"] = with_views(
    "outcomes",
    """
    WITH s AS (
      SELECT time_bucket(INTERVAL 2 HOUR, ts) AS t0 FROM outcomes GROUP BY t0 HAVING count(*) FILTER (disposition = 'review') > 5
    ), g AS (SELECT t0, t0 - to_hours(CAST(2 * row_number() OVER (ORDER BY t0) AS INTEGER)) AS island FROM s),
    r AS (SELECT min(t0) AS started, max(t0) + INTERVAL 2 HOUR AS ended, count(*) AS steps FROM g GROUP BY island)
    SELECT started, ended, steps, started + INTERVAL 6 HOUR AS fires_at FROM r WHERE ended >= started + INTERVAL 6 HOUR
    """,
)

ORACLE["run_summary"] = with_views(
    "outcomes balances",
    """
    WITH s AS (
      SELECT count(DISTINCT conv_id) AS statements, count(*) FILTER (role = 'user') AS booked,
             count(*) FILTER (role = 'assistant') AS duplicates, count(*) FILTER (role NOT IN ('user', 'assistant')) AS review
      FROM conversations
    ), m AS (
      SELECT count(*) AS n, count(*) FILTER (disposition = 'booked') AS booked, count(*) FILTER (disposition = 'duplicate') AS duplicates,
             count(*) FILTER (disposition = 'review') AS review, count(*) FILTER (disposition = 'skipped') AS skipped,
             count(*) FILTER (disposition = 'deferred') AS deferred FROM outcomes
    )
    SELECT n + statements AS processed, m.booked + s.booked AS booked, m.duplicates + s.duplicates AS duplicates,
           m.review + s.review AS review, skipped, statements, 0 AS corrected, deferred,
           (SELECT count(*) FILTER (delta > 0.01) FROM balances) AS balance_mismatch
    FROM s, m
    """,
)

ORACLE["outcome_rate_stream"] = ORACLE["outcome_rate_5m"]

ORACLE["book_once_stream"] = f"""
    SELECT DISTINCT concat_ws('/', {_LINE_KEY}) AS msg_id, 'T' || l_orderkey AS external_id,
           CASE WHEN l_returnflag = 'R' THEN 'review'
                WHEN row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R'
                                        ORDER BY l_partkey, l_suppkey * 10 + l_linenumber) = 1 THEN 'booked'
                ELSE 'duplicate' END AS outcome,
           CASE WHEN l_returnflag = 'R' THEN 'returned' END AS reason
    FROM lineitem
"""

ORACLE["ledger_window"] = with_views(
    "v_orders journals",
    """
    SELECT j.* FROM journals j
    JOIN (SELECT account_id, max(order_date) AS until FROM v_orders GROUP BY account_id) a USING (account_id)
    WHERE j.txn_date BETWEEN a.until - 30 AND a.until
    """,
)

# A message's newest change within the numbers that a run sees.
_NEWEST = "SELECT msg_id, max(seq) AS seq, arg_max(kind, seq) AS kind FROM changes, ends WHERE"
ORACLE["inbox_scan"] = f"""
    WITH changes AS (SELECT CAST(user_id AS VARCHAR) AS msg_id, CAST(event_id AS BIGINT) AS seq, event_type AS kind FROM events),
    ends AS (SELECT max(seq) AS top, max(seq) // 4 AS first_end, max(seq) * 2 // 4 AS second_end FROM changes),
    clean AS ({_NEWEST} seq <= first_end GROUP BY msg_id),
    deferring AS ({_NEWEST} seq > first_end AND seq <= second_end GROUP BY msg_id),
    rest AS ({_NEWEST} seq > first_end GROUP BY msg_id)
    SELECT CAST(0 AS BIGINT) AS run, msg_id, seq, CASE kind WHEN 'purchase' THEN 'booked' ELSE 'skipped' END AS outcome,
           CAST(NULL AS VARCHAR) AS reason, first_end AS last_seq
    FROM clean, ends WHERE kind <> 'view'
    UNION ALL
    SELECT 1, msg_id, seq, CASE kind WHEN 'signup' THEN 'deferred' WHEN 'purchase' THEN 'booked' ELSE 'skipped' END,
           CASE kind WHEN 'signup' THEN 'no rate' END, NULL
    FROM deferring WHERE kind <> 'view'
    UNION ALL
    SELECT 2, msg_id, seq, CASE kind WHEN 'purchase' THEN 'booked' ELSE 'skipped' END, NULL, top
    FROM rest r, ends WHERE kind <> 'view' AND NOT EXISTS (
      SELECT 1 FROM deferring d WHERE d.msg_id = r.msg_id AND d.seq = r.seq AND d.kind NOT IN ('view', 'signup'))
"""

ORACLE["late_alert_stream"] = with_views(
    "v_orders journals",
    f"""
    WITH near AS MATERIALIZED (
      SELECT o.o_orderkey, o.p_name AS cm, lower(j.merchant) AS jm, j.journal_id
      FROM v_orders o JOIN journals j ON j.account_id = o.account_id AND starts_with(j.external_id, 'bpstmt:')
        AND j.txn_date BETWEEN o.order_date - 5 AND o.order_date + 5
      WHERE o.prio = '1'
    ), hit AS (
      SELECT o_orderkey, min(journal_id) AS statement_journal_id FROM near
      JOIN (SELECT cm, jm, {_similarity("cm", "jm")} AS s FROM (SELECT DISTINCT cm, jm FROM near)) USING (cm, jm)
      WHERE s >= 0.70 GROUP BY o_orderkey
    )
    SELECT o_orderkey, statement_journal_id FROM v_orders LEFT JOIN hit USING (o_orderkey) WHERE prio = '1'
    """,
)

ORACLE["rate_cache_runs"] = with_views(
    "v_orders accounts rates",
    f"""
    WITH needed AS (
      SELECT DISTINCT {views.ORDER_CURRENCY} AS from_ccy, a.currency AS to_ccy, order_date AS rate_date
      FROM v_orders JOIN accounts a USING (account_id)
    ), found AS (
      SELECT from_ccy, to_ccy, rate_date, CAST(rate AS DECIMAL(28,12)) AS rate
      FROM needed JOIN rates USING (from_ccy, to_ccy, rate_date) WHERE from_ccy <> to_ccy
    )
    SELECT CAST(0 AS BIGINT) AS run, * FROM found
    UNION ALL SELECT 1, * FROM found WHERE rate_date >= DATE '1998-06-30'
    """,
)


def _held(window: str) -> str:
    return with_views(
        "outcomes",
        f"""
        WITH s AS (
          SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS began, source, arg_max(value, (ts, event_id)) AS value
          FROM outcomes WHERE value IS NOT NULL GROUP BY ALL
        ), grid AS (
          SELECT source, unnest(generate_series(min(began), max(began) + INTERVAL '{window}', INTERVAL 5 MINUTE)) AS past FROM s GROUP BY source
        ), seen AS (
          SELECT g.past + INTERVAL 5 MINUTE AS window_end, g.source, s.value, s.began
          FROM grid g ASOF JOIN s ON g.source = s.source AND g.past >= s.began
        )
        SELECT window_end, source, value FROM seen WHERE began + INTERVAL '{window}' >= window_end
        """,
    )


ORACLE["last_value_12h"] = _held("12 hours")
ORACLE["last_value_14d"] = _held("14 days")

ORACLE["transfer_payload"] = with_views(
    "v_orders accounts rates",
    f"""
    WITH m AS (
      SELECT *, {views.CURRENCY_OF_ACCOUNT} AS currency, (account_id + 1) % (SELECT count(*) FROM accounts) AS dest FROM v_orders
    ), r AS (
      SELECT m.*, a.currency AS target, a.decimals,
             CASE WHEN m.currency = a.currency THEN CAST(1 AS DECIMAL(18,6)) ELSE r.rate END AS rate
      FROM m JOIN (SELECT account_id AS dest, currency, decimals FROM accounts) a USING (dest)
      ASOF LEFT JOIN rates r ON m.currency = r.from_ccy AND a.currency = r.to_ccy AND m.order_date >= r.rate_date
    ), b AS (
      SELECT *, CAST(CASE WHEN decimals = 0 THEN round_even(amount * rate, 0) ELSE round_even(amount * rate, 2) END
                     AS DECIMAL(24,4)) AS leg FROM r
    )
    SELECT 'transfer' AS type, order_date AS date, {_trim_zeros("amount")} AS amount, currency AS currency_code,
           p_name AS description, CAST(o_orderkey AS VARCHAR) AS external_id, 'txnrecon' AS tags, account_id AS source_id,
           CAST(NULL AS VARCHAR) AS destination_name, dest AS destination_id,
           CASE WHEN currency <> target THEN {_trim_zeros("leg")} END AS foreign_amount,
           CASE WHEN currency <> target THEN target END AS foreign_currency_code, CAST(NULL AS VARCHAR) AS category_name
    FROM b
    """,
)
