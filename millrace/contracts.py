"""Source contracts: the columns of each dataset, their types, domains and patterns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Domains and patterns that results must agree on: fixed values.
STATUSES = ("created", "paid", "completed", "cancelled")
TERMINAL = ("completed", "cancelled")
CHANNELS = ("app", "web", "門市", "電銷")
LEVELS = ("一般", "銀卡", "金卡", "白金")
FOREIGN = ("USD", "JPY")
CURRENCIES = ("TWD", *FOREIGN)
ALIASES = {"NTD": "TWD"}
BIRTH_SENTINEL = "1900-01-01"
OPEN_END = "9999-12-31"
BUSINESS_ZONE = "Asia/Taipei"
ISO_OFFSET = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})\z"
NAIVE = r"\A[0-9]{4}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"
ISO_DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
ORDER_ID, MEMBER_ID, PRODUCT_ID = r"\AORD[0-9]{8}\z", r"\AM[0-9]{6}\z", r"\AP[0-9]{5}\z"


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "string"
    required: bool = True
    domain: tuple[str, ...] = ()
    pattern: str = ""
    sentinel: str = ""
    sensitive: bool = False


@dataclass(frozen=True)
class Contract:
    dataset: str
    key: tuple[str, ...]
    columns: tuple[Column, ...]
    files: tuple[str, ...] = field(default=())

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def raw_schema(self) -> T.StructType:
        """All text; the contract goes along as metadata of the fields."""
        return T.StructType([T.StructField(c.name, T.StringType(), True, {"type": c.type, "domain": list(c.domain), "pattern": c.pattern, "sensitive": c.sensitive}) for c in self.columns])


ORDERS = Contract(
    "orders",
    ("order_id",),
    (
        Column("order_id", pattern=ORDER_ID), Column("member_id", pattern=MEMBER_ID), Column("product_id", pattern=PRODUCT_ID), Column("channel", domain=CHANNELS),
        Column("order_status", domain=STATUSES), Column("quantity", "int"), Column("currency", domain=(*CURRENCIES, *ALIASES)), Column("amount", "decimal(24,4)"),
        Column("coupon_discount", "decimal(24,4)"), Column("order_created_at", "timestamp"), Column("departure_date", "date"), Column("updated_at", "timestamp"),
    ),
    ("orders_base.csv", "orders_incremental_day1.csv", "orders_incremental_day2.csv", "orders_incremental_day3.csv"),
)
MEMBERS = Contract(
    "members",
    ("member_id", "extract_date"),
    (
        Column("member_id", pattern=MEMBER_ID), Column("member_name", sensitive=True), Column("member_level", domain=LEVELS), Column("city"),
        Column("birth_date", "date", required=False, sentinel=BIRTH_SENTINEL, sensitive=True), Column("register_date", "date"), Column("extract_date", "date"),
    ),
    ("members.csv",),
)
PRODUCTS = Contract(
    "products",
    ("product_id",),
    (
        Column("product_id", pattern=PRODUCT_ID), Column("product_name"), Column("product_type"), Column("destination_country"), Column("destination_city"),
        Column("trip_days", "int"), Column("base_price_twd", "decimal(24,4)"), Column("is_active", domain=("Y", "N")),
    ),
    ("products.csv",),
)
FX_RATES = Contract("fx_rates", ("rate_date", "currency"), (Column("rate_date", "date"), Column("currency", domain=FOREIGN), Column("rate_to_twd", "decimal(24,8)")), ("fx_rates.csv",))
CONTRACTS = {c.dataset: c for c in (ORDERS, MEMBERS, PRODUCTS, FX_RATES)}

#: Business dates that each order file may hold (ORD-021), and the one date that an incremental file should hold (ORD-022): fixed values.
WINDOWS = {
    "orders_base.csv": (0, "2026-05-01", "2026-06-30"),
    "orders_incremental_day1.csv": (1, "2026-05-01", "2026-07-01"),
    "orders_incremental_day2.csv": (2, "2026-05-01", "2026-07-02"),
    "orders_incremental_day3.csv": (3, "2026-05-01", "2026-07-03"),
}
