"""The driver's tables in the shape of the source contracts: text as a source gives it, with defects that numbers decide.

One SQL text for each dataset serves both engines, so that queries and their oracle begin with the same rows. Every rule of
the detectors and gates, and every check, has rows that hit it and rows that don't.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import contracts as C


def _lineage(columns: str) -> str:
    """Row numbers are given (n); the uid names file and row."""
    return f"source_file, CAST(n AS BIGINT) AS source_row_number, batch_order, md5(concat_ws('|', {columns})) AS row_hash, source_file || ':' || CAST(n AS STRING) AS source_row_uid"


#: Common to all order rows: numbers of the order, the member, the product and the price in hundreds; the day; hour and minute.
_BASE = """SELECT k, c, k % 200 AS p, 10 + (k % 200) % 50 AS hundreds, 1 + k % 4 AS q, DATE '2026-05-01' + CAST(k % 61 AS INT) AS day,
  'T' || lpad(CAST(k % 24 AS STRING), 2, '0') || ':' || lpad(CAST(k % 60 AS STRING), 2, '0') AS hm, CASE WHEN k % 7 = 6 THEN 'Z' ELSE '+08:00' END AS zone
  FROM (SELECT o_orderkey AS k, o_custkey AS c FROM {orders})"""
#: (rows, number of the kind, file, batch, order number, created day, updated text, status, product).
_KINDS = [
    ("k >= 0", 0, 0, "k", "day", "hm || ':30' || zone", "CASE WHEN k % 37 = 4 THEN 'lost' WHEN k % 3 = 0 THEN 'completed' WHEN k % 3 = 1 THEN 'created' ELSE 'paid' END", "p"),
    ("k % 4 = 0", 1, 0, "k", "day", None, "CASE WHEN k % 8 = 0 THEN 'paid' ELSE 'cancelled' END", "p"),
    ("k % 11 = 0", 2, 0, "k", "day", "hm || ':30' || zone", "CASE WHEN k % 37 = 4 THEN 'lost' WHEN k % 3 = 0 THEN 'completed' WHEN k % 3 = 1 THEN 'created' ELSE 'paid' END", "p"),
    ("k % 29 = 0", 3, 0, "k", "day", "hm || ':30' || zone", "'paid'", "(p + 1) % 200"),
    ("k % 13 = 0", 4, 1, "k", "day", "hm || ':45' || zone", "'paid'", "p"),
    ("k % 17 = 0", 5, 1, "(k + 50000000)", "DATE '2026-07-01'", "hm || ':30' || zone", "'paid'", "p"),
    ("k % 19 = 0", 6, 2, "(k + 60000000)", "CASE WHEN k % 38 = 0 THEN DATE '2026-07-05' ELSE DATE '2026-07-02' END", "hm || ':30' || zone", "'created'", "p"),
    ("k % 23 = 0", 7, 3, "(k + 70000000)", "DATE '2026-07-03'", "hm || ':30' || zone", "'completed'", "p"),
]


def _kind(rows: str, kind: int, batch: int, number: str, day: str, updated: str | None, status: str, product: str) -> str:
    time = f"CAST({day} AS STRING) || {updated}" if updated else "CAST(day + CAST(1 + k % 5 AS INT) AS STRING) || hm || ':30' || zone"
    return f"""SELECT
  CASE WHEN k % 61 = 7 THEN 'X' ELSE 'ORD' END || lpad(CAST({number} AS STRING), 8, '0') AS order_id,
  CASE WHEN k % 73 = 8 THEN 'M999999' ELSE 'M' || lpad(CAST(c AS STRING), 6, '0') END AS member_id,
  CASE WHEN k % 67 = 9 THEN 'P99999' ELSE 'P' || lpad(CAST({product} AS STRING), 5, '0') END AS product_id,
  CASE WHEN k % 41 = 5 THEN 'fax' WHEN k % 4 = 0 THEN 'app' WHEN k % 4 = 1 THEN 'web' WHEN k % 4 = 2 THEN '門市' ELSE '電銷' END AS channel,
  {status} AS order_status,
  CASE WHEN k % 43 = 6 THEN '0' WHEN k % 86 = 10 THEN 'two' ELSE CAST(q AS STRING) END AS quantity,
  CASE WHEN k % 47 = 3 THEN 'EUR' WHEN k % 5 = 0 THEN 'USD' WHEN k % 5 = 1 THEN 'JPY' WHEN k % 9 = 2 THEN 'NTD' WHEN k % 53 = 11 THEN 'TWD ' ELSE 'TWD' END AS currency,
  CASE WHEN k % 79 = 12 THEN '0' WHEN k % 158 = 13 THEN 'n/a' ELSE CAST(hundreds * q * CASE WHEN k % 5 = 0 THEN 4 WHEN k % 5 = 1 THEN 500 ELSE 100 END * CASE WHEN k % 71 = 5 THEN 10 ELSE 1 END AS STRING) || '.' || lpad(CAST(k % 100 AS STRING), 2, '0') || '00' END AS amount,
  CASE WHEN k % 83 = 14 THEN '-1.0000' WHEN k % 166 = 15 THEN '' WHEN k % 89 = 16 THEN '999999.0000' ELSE CAST(k % 30 AS STRING) || '.5000' END AS coupon_discount,
  CASE WHEN k % 10 = 3 THEN replace(CAST({day} AS STRING), '-', '/') || replace(hm, 'T', ' ') || ':00' ELSE CAST({day} AS STRING) || hm || ':00' || CASE WHEN k % 59 = 17 THEN '-08:00' ELSE zone END END AS order_created_at,
  CASE WHEN k % 97 = 18 THEN '2026-04-01' WHEN k % 101 = 19 THEN '2026/08/01' WHEN k % 202 = 20 THEN '' ELSE CAST({day} + CAST(30 + k % 40 AS INT) AS STRING) END AS departure_date,
  {time} AS updated_at,
  k * 10 + {kind} AS n, '{C.ORDERS.files[batch]}' AS source_file, {batch} AS batch_order
 FROM base WHERE {rows}"""


_SNAPSHOTS = [("c >= 0", 0, "2026-04-30"), ("c % 2 = 0", 1, "2026-05-31"), ("c % 3 = 0", 2, "2026-06-30"), ("c % 19 = 0", 3, "2026-04-30"), ("c % 31 = 0", 4, "2026-04-30")]


def _snapshot(rows: str, kind: int, day: str) -> str:
    later = "" if kind in (0, 3, 4) else f" + {kind}"
    level = "c" if not later else f"(c + CASE WHEN c % 6 = 0 THEN {kind} ELSE 0 END)"
    level = f"({level} + 1)" if kind == 4 else level
    return f"""SELECT
  CASE WHEN c % 47 = 5 THEN 'MX' || CAST(c AS STRING) WHEN c % 59 = 7 THEN ' M' || lpad(CAST(c AS STRING), 6, '0') ELSE 'M' || lpad(CAST(c AS STRING), 6, '0') END AS member_id,
  CASE WHEN {kind} = 1 AND c % 61 = 8 THEN '' ELSE 'Name ' || CAST(c AS STRING) END AS member_name,
  CASE WHEN c % 53 = 6 THEN 'gold' WHEN {level} % 4 = 0 THEN '一般' WHEN {level} % 4 = 1 THEN '銀卡' WHEN {level} % 4 = 2 THEN '金卡' ELSE '白金' END AS member_level,
  'City ' || CAST((c{later if later else ""} + CASE WHEN c % 10 = 0 THEN 1 ELSE 0 END) % 7 AS STRING) AS city,
  CASE WHEN c % 5 = 0 AND {kind} IN (0, 3, 4) THEN '1900-01-01' WHEN c % 29 = 1 THEN '' WHEN c % 41 = 2 THEN 'soon' ELSE CAST(DATE '1950-01-01' + CAST((c * 37) % 15000{' + CASE WHEN c % 23 = 0 THEN 1 ELSE 0 END' if later else ''} AS INT) AS STRING) END AS birth_date,
  CASE WHEN c % 37 = 3 THEN '2027-01-01' WHEN c % 43 = 4 THEN '2020/01/01' ELSE CAST(DATE '2015-01-01' + CAST(c % 3000 AS INT) AS STRING) END AS register_date,
  '{day}' AS extract_date, c * 10 + {kind} AS n FROM (SELECT c_custkey AS c FROM {{customer}}) AS x WHERE {rows}"""


def _parts(id_: str, rows: str, kind: int) -> str:
    return f"""SELECT CASE WHEN p % 89 = 2 THEN 'Q' ELSE 'P' END || lpad(CAST({id_} AS STRING), 5, '0') AS product_id, CASE WHEN p % 83 = 3 THEN '' ELSE name END AS product_name, kind AS product_type,
  CASE WHEN p % 4 = 0 THEN 'JP' WHEN p % 4 = 1 THEN 'KR' WHEN p % 4 = 2 THEN 'TW' ELSE 'US' END AS destination_country, 'Town ' || CAST(p % 5 AS STRING) AS destination_city,
  CASE WHEN p % 61 = 5 THEN 'x' ELSE CAST(1 + p % 9 AS STRING) END AS trip_days, CASE WHEN p % 79 = 4 THEN '0' ELSE CAST((10 + p % 50) * 100 AS STRING) || '.0000' END AS base_price_twd,
  CASE WHEN p % 71 = 6 THEN 'maybe' WHEN p % 8 = 0 THEN 'N' ELSE 'Y' END AS is_active, p * 10 + {kind} AS n FROM (SELECT p_partkey AS p, p_name AS name, p_type AS kind FROM {{part}}) AS x WHERE {rows}"""


#: Of the first days one rate each; some are missing, come twice, or are no rates.
_DAY = "DATE '2026-05-01' + CAST(c AS INT)"
_RATES = f"""SELECT CAST({_DAY} AS STRING) AS rate_date, 'USD' AS currency, CASE WHEN c = 30 THEN 'x' WHEN c = 31 THEN '-1' ELSE '25.00000000' END AS rate_to_twd, c * 10 AS n FROM days WHERE c % 13 <> 12
 UNION ALL SELECT CAST({_DAY} AS STRING), CASE WHEN c = 33 THEN 'EUR' ELSE 'JPY' END, '0.20000000', c * 10 + 1 FROM days
 UNION ALL SELECT CAST({_DAY} AS STRING), 'JPY', CASE WHEN c = 21 THEN '0.30000000' ELSE '0.20000000' END, c * 10 + 2 FROM days WHERE c IN (20, 21)
 UNION ALL SELECT replace(CAST({_DAY} AS STRING), '-', '/'), 'JPY', '0.20000000', c * 10 + 3 FROM days WHERE c = 40"""


def _of(contract: C.Contract, ctes: str, rows: str) -> str:
    columns = ", ".join(contract.names)
    given = rows if contract is C.ORDERS else f"(SELECT *, '{contract.files[0]}' AS source_file, 0 AS batch_order FROM {rows}) AS x"
    return f"WITH {ctes} SELECT {columns}, {_lineage(columns)} FROM {given}"


SHAPES: dict[str, str] = {
    "orders": _of(C.ORDERS, f"base AS ({_BASE}), events AS ({' UNION ALL '.join(_kind(*k) for k in _KINDS)})", "events"),
    "members": _of(C.MEMBERS, f"snapshots AS ({' UNION ALL '.join(_snapshot(*k) for k in _SNAPSHOTS)})", "snapshots"),
    "products": _of(C.PRODUCTS, f"parts AS ({' UNION ALL '.join((_parts('p', 'p >= 0', 0), _parts('p', 'p % 97 = 1', 1), _parts('(p + 90000)', 'p < 3', 2)))})", "parts"),
    "fx_rates": _of(C.FX_RATES, f"days AS (SELECT c_custkey AS c FROM {{customer}} WHERE c_custkey < 66), rates AS ({_RATES})", "rates"),
}
TABLES = ("orders", "customer", "part")


def sql(dataset: str) -> str:
    """The shape over tables of their own names."""
    return SHAPES[dataset].format(**{t: t for t in TABLES})


def raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four raw datasets, by name."""
    own = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES}
    return {name: spark.sql(text, **{t: df for t, df in own.items() if f"{{{t}}}" in text}) for name, text in SHAPES.items()}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that the cluster names; a temporary one only on a local master where none is set."""
    import tempfile

    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder for intermediate tables")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"
