import csv
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("OMP_NUM_THREADS", "1")

from millrace import contracts as C  # noqa: E402
from millrace.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    own = session(
        "local[8]", **{"spark.sql.shuffle.partitions": "3", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    )
    own.sparkContext.setLogLevel("ERROR")
    yield own
    own.stop()


def write_csv(path, header, rows):
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(header)
        out.writerows(rows)


DEFAULT = {
    "member_id": "M310001", "product_id": "P04210", "channel": "app", "order_status": "paid", "quantity": "2", "currency": "TWD", "amount": "640.0000", "coupon_discount": "15.2500",
    "order_created_at": "2026-05-12T10:15:00+08:00", "departure_date": "2026-09-20", "updated_at": "2026-05-12T10:20:00+08:00",
}
SOON, LATER = "2026-05-13T09:00:00+08:00", "2026-05-14T21:30:00+08:00"


def event(number, **changes):
    row = DEFAULT | changes | {"order_id": f"ORD{number:08d}"}
    return [row[c] for c in C.ORDERS.names]


class Case:
    """Events of an order as changes of the usual one; whether the order is accepted; what detectors count in it."""

    def __init__(self, *events, accepted=True, **found):
        self.events, self.accepted, self.found = events, accepted, {k.replace("_", "-"): n for k, n in found.items()}


def at(time, **changes):
    return changes | {"updated_at": time}


CASES = {
    "usual": Case({}),
    "sent twice": Case({}, {}, ORD_001=2, ORD_002=2, ORD_005=2),
    "two products at one time": Case(at(SOON), at(SOON, product_id="P04211"), accepted=False, ORD_002=2, ORD_003=2, ORD_004=2, ORD_005=2),
    "product changed": Case(at(SOON), at(LATER, product_id="P04211"), accepted=False, ORD_002=2, ORD_004=2),
    "moves on": Case(at(SOON), at(LATER, order_status="completed"), ORD_002=2),
    "unknown product": Case({"product_id": "P99001"}, ORD_016=1),
    "member in a gap": Case({"member_id": "M310005", "order_created_at": "2026-06-10T10:15:00+08:00", "updated_at": "2026-06-10T10:20:00+08:00"}),
    "member after a gap": Case({"member_id": "M310005", "order_created_at": "2026-06-26T10:15:00+08:00", "updated_at": "2026-06-26T10:20:00+08:00"}),
    "alias of the currency": Case({"currency": "NTD"}, ORD_009=1),
    "dollars": Case({"currency": "USD", "amount": "16.0000"}),
    "yen": Case({"currency": "JPY", "amount": "2560.0000"}),
    "euros": Case({"currency": "EUR"}, accepted=False, ORD_009=1),
    "negative amount": Case({"amount": "-640.0000"}, accepted=False, ORD_010=1),
    "negative coupon": Case({"coupon_discount": "-0.5000"}, accepted=False, ORD_011=1),
    "ten times the price": Case({"amount": "6400.0000"}, accepted=False, ORD_023=1),
    "half a cent": Case({"amount": "640.0050"}),
    "reopened": Case(at(SOON, order_status="completed"), at(LATER, order_status="paid"), ORD_002=2, ORD_018=1),
    "one traveller": Case({"quantity": "1", "amount": "320.0000"}),
    "same instant in UTC": Case(at(SOON, order_created_at="2026-05-12T02:15:00Z"), at(LATER), ORD_002=2, ORD_004=2),
    "same instant without zone": Case(at(SOON, order_created_at="2026/05/12 10:15:00"), at(LATER), ORD_002=2, ORD_004=2, ORD_012=1),
    "created anew": Case(at(SOON), at(LATER, order_created_at=SOON), accepted=False, ORD_002=2, ORD_004=2),
}
#: Orders of each case, alike but for number and channel.
EACH = ("app", "web", "電銷")


def numbers(name):
    first = 70_000 + 10 * list(CASES).index(name)
    return [first + i for i in range(len(EACH))]


def ids(name):
    return [f"ORD{n:08d}" for n in numbers(name)]


SNAPSHOTS = {
    "restated birth": (1, [("銀卡", "台南", "1900-01-01", "2026-04-12"), ("銀卡", "台南", "1975-08-09", "2026-05-20")]),
    "unknown birth": (2, [("一般", "花蓮", "1900-01-01", "2026-04-12")]),
    "two births": (3, [("一般", "花蓮", "1968-02-03", "2026-04-12"), ("一般", "花蓮", "1968-03-02", "2026-05-20")]),
    "sent twice": (4, [("金卡", "基隆", "1990-11-30", "2026-04-12")] * 2),
    "clash on a day": (5, [("一般", "新竹", "1988-07-06", "2026-04-12"), ("銀卡", "新竹", "1988-07-06", "2026-06-02"), ("白金", "新竹", "1988-07-06", "2026-06-02"), ("白金", "宜蘭", "1988-07-06", "2026-06-25")]),
    "moved and rose": (6, [("一般", "屏東", "2001-01-19", "2026-04-12"), ("銀卡", "台東", "2001-01-19", "2026-05-20")]),
}


def member_id(name):
    return f"M31{SNAPSHOTS[name][0]:04d}"


def snapshot(number, level="一般", city="花蓮", birth="1977-12-24", day="2026-04-12"):
    return [f"M31{number:04d}", f"Person {number}", level, city, birth, "2018-03-15", day]


def write_sources(root, members, products, rates, **orders):
    write_csv(root / "members.csv", C.MEMBERS.names, members)
    write_csv(root / "products.csv", C.PRODUCTS.names, products)
    write_csv(root / "fx_rates.csv", C.FX_RATES.names, rates)
    for name, rows in orders.items():
        write_csv(root / f"orders_{name}.csv", C.ORDERS.names, rows)


PRODUCTS = [[f"P0421{i}", f"Trip {i}", "cruise", "JP", f"Port {i}", str(3 + i), "320.0000", "Y"] for i in range(3)]


def rates(*days):
    return [[d, c, r] for d in days for c, r in (("USD", "40.00000000"), ("JPY", "0.25000000"))]


@pytest.fixture(scope="session")
def base_sources(tmp_path_factory):
    """Every case of members and orders."""
    root = tmp_path_factory.mktemp("base")
    members = [snapshot(n, *row) for n, rows in SNAPSHOTS.values() for row in rows]
    rows = [event(n, **({"channel": channel} | e)) for name, case in CASES.items() for n, channel in zip(numbers(name), EACH, strict=True) for e in case.events]
    write_sources(root, members, PRODUCTS, rates("2026-05-12", "2026-05-13", "2026-06-30"), base=rows)
    return root


#: Orders of batches: of each its events by batch, as changes of the usual one.
HISTORY = {
    "turns into a clash": {0: [{}], 1: [{"member_id": "M310002"}, {}]},
    "late status": {0: [at(LATER)], 1: [at(SOON, order_status="created")]},
    "one instant written twice": {0: [{"order_created_at": "2026-05-12T02:15:00Z"}, {}]},
    "of the first day": {1: [{"order_created_at": "2026-07-01T07:45:00+08:00", "updated_at": "2026-07-01T08:00:00+08:00"}]},
    "of the second day": {2: [{"order_created_at": "2026-07-02T07:45:00+08:00", "updated_at": "2026-07-02T08:00:00+08:00", "quantity": "3", "amount": "960.0000"}]},
    "of the third day": {3: [{"order_created_at": "2026-07-03T07:45:00+08:00", "updated_at": "2026-07-03T08:00:00+08:00", "currency": "USD", "amount": "16.0000"}]},
}


def history_ids(name):
    first = 81_000 + 10 * list(HISTORY).index(name)
    return [f"ORD{first + i:08d}" for i in range(2)]


def batch(n):
    return [event(int(i[3:]), **e) for name, by in HISTORY.items() for i in history_ids(name) for e in by.get(n, [])]


@pytest.fixture
def batch_sources(tmp_path):
    root = tmp_path / "source"
    root.mkdir()
    write_sources(root, [snapshot(i) for i in range(1, 4)], PRODUCTS, rates("2026-05-12", "2026-07-01", "2026-07-02", "2026-07-03"), base=batch(0), **{f"incremental_day{n}": batch(n) for n in (1, 2, 3)})
    return root
