"""The registered queries in SQL, straight from the base tables.

``r`` has one row per receipt with its parsed fields (all NULL for a document that is cut
off), ``i`` one row per line of a receipt that parses.
"""

_RECEIPTS = r"""
h AS (
  SELECT o_orderkey AS k, o_orderkey % 43 = 0 AS broken, o_totalprice AS price,
         lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS cust12,
         lpad(CAST(o_custkey AS VARCHAR), 11, '0') AS cust11,
         o_orderdate + INTERVAL 30 YEAR
           + to_seconds(CAST(o_orderkey * 7 % 86400 AS INTEGER)) AS ts,
         c_name, n_name, c_mktsegment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
              LEFT JOIN nation ON c_nationkey = n_nationkey
),
f AS (
  SELECT k, broken, ts,
    c_name AS company_name,
    CASE WHEN k % 53 = 0 THEN NULL
         WHEN k % 59 = 1 THEN translate(cust12, '0123456789', '٠١٢٣٤٥٦٧٨٩')
         WHEN k % 5 = 1 THEN cust11 WHEN k % 5 = 2 THEN cust12 || 'x' ELSE cust12 END AS iin,
    chr(CAST(65 + k % 26 AS INTEGER)) || lpad(CAST(k AS VARCHAR), 9, '0') AS factory_number,
    CASE WHEN k % 71 = 0 THEN '12.5' WHEN k % 67 = 0 THEN 'x12'
         WHEN k % 73 = 0 THEN '99999999999999999999'
         ELSE CAST((k * 104729) % 1000000000000 AS VARCHAR) END AS registration_text,
    CASE WHEN k % 71 = 0 THEN 12 WHEN k % 67 = 0 OR k % 73 = 0 THEN NULL
         ELSE (k * 104729) % 1000000000000 END AS registration_number,
    CASE WHEN k % 79 <> 0 THEN k % 999999 + 1 END AS receipt_number,
    CASE WHEN k % 59 = 0 THEN NULL WHEN k % 47 = 0 THEN 'not a date'
         WHEN k % 37 = 0 THEN strftime(ts, '%-d/%-m/%Y %-H:%-M:%-S')
         WHEN k % 53 = 1 THEN strftime(ts - INTERVAL 55 YEAR, '%d.%m.%y %H:%M')
         WHEN k % 3 = 0 THEN strftime(ts, '%Y-%m-%d, %H:%M:%S')
         WHEN k % 3 = 1 THEN strftime(ts, '%d.%m.%y %H:%M')
         ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END AS date_text,
    CASE WHEN k % 59 = 0 OR k % 47 = 0 THEN NULL
         WHEN k % 37 = 0 THEN CASE WHEN length(date_text) = 19 THEN ts END
         WHEN k % 53 = 1
         THEN date_trunc('minute', ts - INTERVAL 55 YEAR) + INTERVAL 100 YEAR
         WHEN k % 3 = 1 THEN date_trunc('minute', ts) ELSE ts END AS event_time,
    CASE WHEN k % 61 = 0 OR k % 83 = 0 THEN NULL WHEN k % 29 = 0 THEN 0
         WHEN k % 31 = 0 THEN -price ELSE price END AS total_sum,
    CASE WHEN k % 44 = 4 THEN '012%' WHEN k % 44 = 8 THEN '12.5%'
         WHEN k % 44 = 12 THEN '99999999999%' WHEN k % 4 = 0 THEN '12%'
         WHEN k % 4 = 1 THEN '0%' WHEN k % 4 = 2 THEN '' ELSE 'VAT 5' END AS vat_rate,
    CASE WHEN k % 101 <> 0
         THEN CAST(CAST(price AS DECIMAL(18,2)) * 0.12 AS DECIMAL(18,2)) END AS vat_sum,
    CASE k % 3 WHEN 0 THEN 'Cash' WHEN 1 THEN 'Card' ELSE 'QR' END AS payment,
    (k * 15485863) % 10000000000 AS fiscal_sign,
    CASE WHEN k % 41 = 0 THEN NULL WHEN k % 2 = 0 THEN 'АО Казахтелеком'
         ELSE 'АО Транстелеком' END AS ofd_name,
    CASE WHEN k % 41 = 0 THEN NULL WHEN k % 2 = 0 THEN 'https://ofd.telecom.kz'
         ELSE 'https://ofd.ttc.kz' END AS ofd_site,
    CASE WHEN k % 6 = 1 THEN 'unknown' WHEN k % 6 = 2 THEN ''
         WHEN k % 6 = 3 THEN ' ' || n_name || chr(9) || ', ' || c_mktsegment
         ELSE n_name || ', ' || c_mktsegment END AS address,
    CASE WHEN k % 7 = 1 THEN '' WHEN k % 7 = 2 THEN 'битый_qr_code'
         ELSE 'QR' || lpad(CAST(k AS VARCHAR), 22, '0') END AS qr_code
  FROM h
),
p AS (
  SELECT f.k, broken, {parsed}
  FROM f
),
r AS (
  SELECT p.*, NOT broken AND k IN (SELECT l_orderkey FROM lineitem) AS has_items FROM p
),
i AS (
  SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey, p_type AS category,
         CASE (l_partkey + l_linenumber) % 8 WHEN 0 THEN p_name || '!!!'
              WHEN 1 THEN p_name || '***' WHEN 2 THEN p_name || '??' WHEN 3 THEN p_name || ' '
              WHEN 4 THEN substr(p_name, 1, 3) || '!!!' || substr(p_name, 4)
              WHEN 5 THEN '??' || p_name || ' *** ' ELSE p_name END AS name,
         p_retailprice AS unit_price, CAST(trunc(l_quantity) AS INTEGER) AS quantity,
         l_extendedprice AS total,
         CASE (l_partkey + l_linenumber) % 4 WHEN 0 THEN '012%' WHEN 1 THEN '0%'
              WHEN 2 THEN '' ELSE 'VAT' END AS item_rate
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
  WHERE l_orderkey % 43 <> 0
),
t AS (
  SELECT k, count(*) AS item_count, {total} AS item_sum FROM i GROUP BY k
)"""

_FIELDS = (
    "company_name iin factory_number registration_text registration_number receipt_number date_text event_time "
    "total_sum vat_rate vat_sum payment fiscal_sign ofd_name ofd_site address qr_code"
).split()


def _total(value: str) -> str:
    """A sum that is unknown if one of its values is."""
    return f"CASE WHEN count({value}) = count(*) THEN CAST(sum({value}) AS DECIMAL(18,2)) END"


_RECEIPTS = _RECEIPTS.replace(
    "{parsed}", ", ".join(f"CASE WHEN NOT broken THEN {c} END AS {c}" for c in _FIELDS)
).replace("{total}", _total("CAST(total AS DECIMAL(18,2))"))

_CHECKS = r""",
v AS (
  SELECT r.*, regexp_matches(iin, '^\d{12}$') AS iin_valid,
    CASE WHEN address IS NOT NULL AND address NOT IN ('', 'unknown')
         THEN address END AS address_correct,
    CASE WHEN has_items THEN vat_rate ELSE '' END AS main_vat_rate,
    CASE WHEN qr_code IS NOT NULL AND qr_code NOT IN ('', 'битый_qr_code')
         THEN qr_code END AS qr_code_valid
  FROM r
),
w AS (
  SELECT v.*,
    CAST(TRY_CAST(regexp_extract(main_vat_rate, '\d+') AS INTEGER) AS VARCHAR) || '%' AS vat_valid
  FROM v
),
c AS (
  SELECT w.*, event_time IS NOT NULL AND iin_valid AND address_correct IS NOT NULL
    AND vat_valid IS NOT NULL AND qr_code_valid IS NOT NULL AND total_sum > 0 AS is_clean
  FROM w
)"""

_FIRST_ITEM = r""",
first_item AS (
  SELECT k, item_rate FROM i
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey, l_suppkey) = 1
),
u AS (
  SELECT r.*, CASE WHEN has_items THEN item_rate ELSE '' END AS item_vat,
         CASE WHEN has_items AND regexp_matches(item_rate, '[0-9]+')
              THEN regexp_extract(item_rate, '[0-9]+') || '%' END AS py_vat,
         coalesce(regexp_matches(iin, '^\p{Nd}{12}$'), false) AS py_iin,
         coalesce(try_strptime(date_text, '%Y-%m-%d, %H:%M:%S'),
                  try_strptime(date_text, '%d.%m.%y %H:%M'),
                  try_strptime(date_text, '%d/%m/%Y %H:%M:%S')) AS py_event_time
  FROM r LEFT JOIN first_item USING (k)
)"""

_CLEAN_ITEMS = r"""
SELECT k, company_name, iin AS tax_payer_iin, factory_number AS kkt_factor_number,
  registration_number AS kkt_registration_number, receipt_number, event_time AS date_time,
  category, regexp_replace(name, '!!!|\*\*\*|\?\?| +$', '', 'g') AS product_name,
  CAST(unit_price AS DECIMAL(18,2)) AS unit_price, CAST(quantity AS BIGINT) AS quantity,
  CAST(total AS DECIMAL(18,2)) AS total_amount_by_position,
  CAST(total_sum AS DECIMAL(18,2)) AS total_sum, vat_rate, vat_sum, payment, fiscal_sign,
  coalesce(ofd_name, 'unknown') AS ofd_name, coalesce(ofd_site, 'unknown') AS ofd_site,
  address_correct AS address, qr_code
FROM c JOIN i USING (k) WHERE is_clean"""

_REASON = r"""concat_ws('; ', CASE WHEN event_time IS NULL THEN 'bad_datetime' END,
    CASE WHEN NOT iin_valid THEN 'bad_iin' END,
    CASE WHEN vat_valid IS NOT NULL THEN 'bad_vat' END,
    CASE WHEN total_sum <= 0 THEN 'total <= 0' END)"""

_COMPLETE_REASON = r"""concat_ws('; ', CASE WHEN event_time IS NULL THEN 'bad_datetime' END,
    CASE WHEN iin_valid IS NOT TRUE THEN 'bad_iin' END,
    CASE WHEN address_correct IS NULL THEN 'bad_address' END,
    CASE WHEN vat_valid IS NULL THEN 'bad_vat' END,
    CASE WHEN qr_code_valid IS NULL THEN 'bad_qr' END,
    CASE WHEN (total_sum > 0) IS NOT TRUE THEN 'total <= 0' END)"""

_DECODED = r"""k, company_name, iin, factory_number, registration_text AS registration_number,
  receipt_number, date_text, CAST(total_sum AS DECIMAL(18,2)) AS total_sum, vat_rate, vat_sum,
  payment, CAST(fiscal_sign AS VARCHAR) AS fiscal_sign, ofd_name, ofd_site, address, qr_code,
  coalesce(item_count, 0) AS item_count, item_sum"""

_LINE_TOTAL = "CAST(round(CAST(unit_price AS DECIMAL(18,2)) * quantity, 2) AS DECIMAL(18,2))"
_VAT_DUE = r"""CAST(CASE WHEN starts_with(vat_rate, '12')
    THEN round(CAST(total_sum AS DECIMAL(18,2)) * 0.12, 2) ELSE 0 END AS DECIMAL(18,2))"""
_OFD_SITE = r"""CASE WHEN ofd_name = 'АО Казахтелеком' THEN 'https://ofd.telecom.kz'
    ELSE 'https://ofd.ttc.kz' END"""


def _with(select: str, *ctes: str) -> str:
    return "WITH " + _RECEIPTS.strip() + "".join(ctes) + "\n" + select


def _r(select: str) -> str:
    return _with(select)


def _c(select: str) -> str:
    return _with(select, _CHECKS)


def _u(select: str) -> str:
    return _with(select, _FIRST_ITEM)


def oracle_sql() -> dict[str, str]:
    clean_items = _c(_CLEAN_ITEMS.strip())
    decoded = _r(f"SELECT {_DECODED} FROM r LEFT JOIN t USING (k)")
    destinations = _c(
        f"""SELECT k, 'clean' AS destination, '' AS reason, product_name,
          total_amount_by_position AS amount, CAST(1 AS BIGINT) AS lines
        FROM ({_CLEAN_ITEMS})
        UNION ALL SELECT k, 'error', {_REASON}, NULL, item_sum, coalesce(item_count, 0)
        FROM c LEFT JOIN t USING (k) WHERE NOT is_clean"""
    )
    by_month = _c("SELECT *, strftime(date_time, '%Y-%m') AS month FROM (" + _CLEAN_ITEMS + ")")
    error_rows = _c(f"SELECT k, {_REASON} AS reason FROM c WHERE NOT is_clean")
    return {
        "decode_receipts": decoded,
        "sse_decode": _r(f"SELECT {_DECODED} FROM r LEFT JOIN t USING (k) WHERE NOT broken"),
        "sse_frames": _r(f"SELECT {_DECODED} FROM r LEFT JOIN t USING (k) WHERE NOT broken"),
        "parse_types": """
            SELECT o_orderkey AS k, '$' AS field, 'struct' AS declared, 'malformed' AS found_type
            FROM orders WHERE o_orderkey % 43 = 0
            UNION ALL SELECT o_orderkey, 'ReceiptNumber', 'bigint', 'STRING'
            FROM orders WHERE o_orderkey % 43 <> 0 AND o_orderkey % 79 = 0
            UNION ALL SELECT o_orderkey, 'TotalSum', 'double', 'STRING'
            FROM orders WHERE o_orderkey % 43 <> 0 AND o_orderkey % 83 = 0 AND o_orderkey % 61 <> 0
              AND (o_orderkey % 29 = 0 OR o_totalprice IS NOT NULL)""",
        "sql_clean_items": clean_items,
        "sql_errors": _c(
            f"""SELECT k, 'reference' AS mode, {_REASON} AS reason FROM c WHERE NOT is_clean
            UNION ALL SELECT k, 'complete', {_COMPLETE_REASON} FROM c WHERE is_clean IS NOT TRUE"""
        ),
        "sql_checks": _with(
            f"""SELECT k, event_time, strftime(event_time, '%Y-%m') AS year_month, iin_valid,
              address_correct AS address, coalesce(split_part(address_correct, ',', 1), '') AS city,
              vat_valid, qr_code_valid AS qr_code, {_VAT_DUE} AS vat_due, {_OFD_SITE} AS ofd_site,
              py_event_time, py_iin,
              coalesce(trim(split_part(address_correct, ',', 1), ' ' || chr(9)), '') AS py_city,
              coalesce(address_correct, '') AS py_address,
              CASE WHEN regexp_matches(vat_rate, '[0-9]+')
                THEN regexp_extract(vat_rate, '[0-9]+') || '%' END AS py_vat
            FROM c JOIN (SELECT k, py_event_time, py_iin FROM u) USING (k)""",
            _FIRST_ITEM,
            _CHECKS,
        ),
        "catalogue_flatten": """
            SELECT p_partkey AS k, coalesce(p_type, '') AS category, 0 AS pos, p_name AS product
            FROM part
            UNION ALL SELECT p_partkey, coalesce(p_type, ''), 1, p_brand FROM part
            UNION ALL SELECT p_partkey, 'brand ' || coalesce(p_brand, ''), 0, p_name
            FROM part""",
        "clock_columns": _r("SELECT k, TRUE AS clock_set FROM r"),
        "event_time": _r("SELECT k, event_time FROM r"),
        "year_month": _r("SELECT k, strftime(event_time, '%Y-%m') AS year_month FROM r"),
        "iin_check": _r(r"SELECT k, regexp_matches(iin, '^\d{12}$') AS iin_valid FROM r"),
        "address_check": _c("SELECT k, address_correct FROM v"),
        "city": _c(
            "SELECT k, coalesce(split_part(address_correct, ',', 1), '') AS city FROM v"
        ),
        "main_vat_rate": _c("SELECT k, main_vat_rate FROM v"),
        "vat_normalize": _c("SELECT k, vat_valid FROM w"),
        "qr_check": _c("SELECT k, qr_code_valid FROM v"),
        "clean_flag": _c("SELECT k, is_clean FROM c"),
        "clean_receipts": _c(
            """SELECT k, event_time, company_name, iin AS tax_payer_iin,
              factory_number AS kkt_factor_number,
              registration_text AS kkt_registration_number,
              receipt_number, date_text AS date_time,
              CAST(total_sum AS DECIMAL(18,2)) AS total_sum, vat_rate, vat_sum, payment,
              CAST(fiscal_sign AS VARCHAR) AS fiscal_sign, address_correct AS address,
              qr_code AS qrcode
            FROM c WHERE is_clean"""
        ),
        "clean_items": clean_items,
        "error_reasons": error_rows,
        "error_reasons_complete": _c(
            f"SELECT k, {_COMPLETE_REASON} AS reason FROM c WHERE is_clean IS NOT TRUE"
        ),
        "error_payload": _c(
            f"""SELECT {_DECODED}, TRUE AS stamped, event_time
            FROM c LEFT JOIN t USING (k) WHERE NOT is_clean"""
        ),
        "strip_marks": _r(
            r"""SELECT k, name,
              regexp_replace(name, '!!!|\*\*\*|\?\?| +$', '', 'g') AS product_name
            FROM i"""
        ),
        "ofd_defaults": _r(
            """SELECT k, coalesce(ofd_name, 'unknown') AS ofd_name,
              coalesce(ofd_site, 'unknown') AS ofd_site FROM r"""
        ),
        "numeric_typing": _r(
            """SELECT k, registration_number, receipt_number,
              CAST(total_sum AS DECIMAL(18,2)) AS total_sum, vat_sum, fiscal_sign,
              CAST(unit_price AS DECIMAL(18,2)) AS unit_price,
              CAST(quantity AS BIGINT) AS quantity,
              CAST(total AS DECIMAL(18,2)) AS total_amount_by_position
            FROM r JOIN i USING (k)"""
        ),
        "line_totals": _r(
            f"""SELECT k, name, quantity, {_LINE_TOTAL} AS line_total,
              CAST(CAST(total AS DECIMAL(18,2)) - {_LINE_TOTAL} AS DECIMAL(18,2)) AS line_diff
            FROM i"""
        ),
        "receipt_totals": _r(
            f"""SELECT k, receipt_total,
              CAST(CAST(total_sum AS DECIMAL(18,2)) - receipt_total AS DECIMAL(18,2))
                AS receipt_diff
            FROM r LEFT JOIN (SELECT k, {_total(_LINE_TOTAL)} AS receipt_total
                FROM i GROUP BY k) USING (k)"""
        ),
        "vat_sum": _r(
            f"""SELECT k, {_VAT_DUE} AS vat_due,
              CAST(vat_sum - {_VAT_DUE} AS DECIMAL(18,2)) AS vat_diff FROM r"""
        ),
        "ofd_site": _r(
            f"SELECT k, {_OFD_SITE} AS ofd_site, ofd_site = {_OFD_SITE} AS ofd_site_ok FROM r"
        ),
        "receipt_reconcile": _r(
            f"""SELECT k, coalesce(line_count, 0) AS line_count, line_diff, receipt_total,
              CAST(CAST(total_sum AS DECIMAL(18,2)) - receipt_total AS DECIMAL(18,2))
                AS receipt_diff,
              {_VAT_DUE} AS vat_due, CAST(vat_sum - {_VAT_DUE} AS DECIMAL(18,2)) AS vat_diff,
              {_OFD_SITE} AS ofd_site, ofd_site = {_OFD_SITE} AS ofd_site_ok
            FROM r LEFT JOIN (SELECT k, count(*) AS line_count,
                {_total(f"CAST(CAST(total AS DECIMAL(18,2)) - {_LINE_TOTAL} AS DECIMAL(18,2))")}
                  AS line_diff,
                {_total(_LINE_TOTAL)} AS receipt_total
                FROM i GROUP BY k) USING (k)"""
        ),
        "raw_landing_stream": _r(
            f"""SELECT {_DECODED}, event_time, strftime(event_time, '%Y-%m') AS year_month,
              TRUE AS stamped FROM r LEFT JOIN t USING (k)"""
        ),
        "clean_items_stream": clean_items,
        "errors_stream": _c(
            f"""SELECT {_DECODED}, TRUE AS stamped, event_time, {_REASON} AS reason
            FROM c LEFT JOIN t USING (k) WHERE NOT is_clean"""
        ),
        "clean_and_errors_stream": destinations,
        "published_stream": destinations,
        "supervised_stream": destinations,
        "merged_layout": by_month,
        "clean_layout": by_month,
        "batch_clocks": _c(
            """SELECT k, CASE WHEN is_clean THEN 'clean' ELSE 'error' END AS destination,
              TRUE AS one_time, TRUE AS kept_time FROM c WHERE is_clean IS NOT NULL"""
        ),
        "routing_metrics": _c(
            """SELECT 'clean' AS route, count(*) AS receipts FROM c WHERE is_clean
            UNION ALL SELECT 'error', count(*) FROM c WHERE NOT is_clean
            UNION ALL SELECT 'neither', count(*) FROM c WHERE is_clean IS NULL"""
        ),
        "kafka_value": decoded,
        "py_event_time": _u("SELECT k, py_event_time AS event_time FROM u"),
        "py_iin": _u("SELECT k, py_iin AS iin_valid FROM u"),
        "py_city": _c(
            "SELECT k, coalesce(trim(split_part(address_correct, ',', 1), ' ' || chr(9)), '') AS city FROM v"
        ),
        "py_address": _c("SELECT k, coalesce(address_correct, '') AS address FROM v"),
        "py_vat": _r(
            r"""SELECT k, CASE WHEN regexp_matches(vat_rate, '[0-9]+')
              THEN regexp_extract(vat_rate, '[0-9]+') || '%' END AS vat FROM r"""
        ),
        "item_vat": _u("SELECT k, item_vat FROM u"),
        "py_clean_flag": _u(
            """SELECT k, py_event_time IS NOT NULL AND py_iin AND py_vat IS NOT NULL
              AND total_sum > 0 AS is_clean FROM u"""
        ),
    }
