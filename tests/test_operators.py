import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from millrace.functions.money import convert, less, reported
from millrace.functions.times import business_date, instant
from millrace.operators import rules, scd2, states, tables
from millrace.plans import features, metrics
from millrace.sources.files import generated_events, write_evidence, write_result_csv
from millrace.streaming import events as stream


def test_money_keeps_all_digits(spark):
    df = spark.sql("SELECT cast('1234.5678' AS decimal(24,4)) AS a, cast('2.54381234' AS decimal(24,8)) AS r, cast('0.0001' AS decimal(24,4)) AS c")
    gross = convert(F.col("a"), F.col("r"))
    row = df.select(gross.alias("g"), less(gross, F.col("c")).alias("n"), reported(F.lit("1.005").cast("decimal(38,12)")).alias("up"), reported(F.lit("-1.005").cast("decimal(38,12)")).alias("down")).first()
    exact = Decimal("1234.5678") * Decimal("2.54381234")
    assert row.g == exact and row.n == exact - Decimal("0.0001") and row.up == Decimal("1.01") and row.down == Decimal("-1.01")
    assert spark.sql("SELECT cast('99999999999999999999.0000' AS decimal(24,4)) AS a").select(convert(F.col("a"), F.lit(2).cast("decimal(24,8)")).alias("g")).first().g is None


def test_instants(spark):
    df = spark.createDataFrame([("2026-05-01T00:00:00Z",), ("2026-05-01T08:00:00+08:00",), ("2026/05/01 08:00:00",), ("2026/13/01 08:00:00",), ("x",), ("2026/05/01 08:00:00\n",)], "t string")
    got = [r.i for r in df.select(instant(F.col("t")).alias("i")).collect()]
    assert got[0] == got[1] == got[2] and got[3] is None and got[4] is None
    assert df.limit(1).select(business_date(F.lit("2026-05-01T20:00:00Z").cast("timestamp")).alias("d")).first().d == dt.date(2026, 5, 2)


def test_scd2_conflicts_and_gaps(spark):
    day = lambda n: dt.date(2026, 1, n)
    rows = [(1, day(1), "a"), (1, day(2), "a"), (1, day(3), "b"), (1, day(4), "b"), (1, day(4), "c"), (1, day(6), "b"), (2, day(5), None), (2, day(6), "x")]
    v = scd2.build(spark.createDataFrame(rows, "k int, d date, s string"), "k", "d", ["s"]).orderBy("k", "valid_from").collect()
    end = dt.date(9999, 12, 31)
    assert [(r.k, r.s, r.valid_from, r.valid_to, r.is_current) for r in v] == [(1, "a", day(1), day(3), False), (1, "b", day(3), day(4), False), (1, "b", day(6), end, True), (2, None, day(5), day(6), False), (2, "x", day(6), end, True)]
    gaps = scd2.gaps(spark.createDataFrame([(1, day(1)), (1, day(4)), (1, day(4)), (2, day(9))], "k int, d date"), "k", "d").collect()
    assert sorted(r.missing_date for r in gaps) == [day(2), day(3)]


def test_quantiles_are_exact(spark):
    df = spark.createDataFrame([("a", Decimal(x)) for x in ("1.1", "1.1", "2.2", "3.35")] + [("b", Decimal("5"))], "g string, v decimal(10,4)")
    got = {r.g: (r.q, r.m) for r in tables.exact_quantiles(df, ["g"], "v", {"q": (1, 4), "m": (1, 2)}).collect()}
    assert got == {"a": (Decimal("1.1"), Decimal("1.65")), "b": (Decimal(5), Decimal(5))}


def test_quantiles_of_many_values_are_exact(spark):
    """Against sorted lists: negative values, zeros, powers of ten, a null group, one value in most rows and a group of one row."""
    rng = random.Random(4)
    some = [Decimal(rng.randint(-10 ** rng.randint(1, 12), 10 ** rng.randint(1, 12))).scaleb(-4) for _ in range(500)]
    groups = {"a": some, "b": [Decimal("1.0000")] * 200 + [Decimal(i).scaleb(-4) for i in range(9990, 10030)], "c": [Decimal("-0.0001")], None: [Decimal(10**i) for i in range(9)] + [Decimal(-(10**i)) for i in range(9)] + [Decimal(0)]}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v] + [("a", None)], "g string, v decimal(18,4)")
    points = {"p0": (0, 1), "p1": (1, 100), "p33": (1, 3), "p50": (1, 2), "p99": (99, 100), "p100": (1, 1)}
    got = {r.g: r for r in tables.exact_quantiles(df, ["g"], "v", points).collect()}
    assert got.keys() == groups.keys()
    for g, v in groups.items():
        v = sorted(v)
        for name, (a, b) in points.items():
            low, rest = divmod((len(v) - 1) * a, b)
            want = v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * Decimal(rest) / Decimal(b)
            assert abs(got[g][name] - want) <= Decimal("0.000001") * max(1, abs(want))


def test_checksums_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("t", F.lit("x"))
    line = F.concat_ws("|", "id", "t")
    for digits in (1, 3):
        sums = {tables.checksum(df.repartition(n), line, digits).first().checksum for n in (1, 7)}
        assert len(sums) == 1 and tables.checksum(df.filter("id > 0"), line, digits).first().checksum not in sums
    assert tables.checksum(df.limit(0), line).first().row_count == 0 and tables.digits_for(10) == 1 and tables.digits_for(10**8) == 3


def test_unknown_conditions_are_no_hits(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "k int, v int")
    found = rules.hits(df, "d", "e", F.col("k").cast("string"), "k", [rules.Rule("A", "WARN", F.col("v") > 3), rules.Rule("B", "QUARANTINE", F.col("v").isNull())])
    assert sorted((r.business_key, r.rule_id) for r in found.collect()) == [("1", "B"), ("2", "A")]


def test_upsert_and_late(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(a, b, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    late = states.late_arrivals(spark.createDataFrame([(1, 0, 5), (1, 1, 4), (1, 1, 6), (1, 2, 5)], "k int, b int, t int"), ["k"], "b", "t")
    assert sorted((r.b, r.t) for r in late.collect()) == [(1, 4), (2, 5)]


def test_features_see_no_future(spark):
    """Changes of later outcomes leave earlier features as they were; a sample's own label never counts."""
    rows = [(i, i % 3, float(i), i % 2, i + 2.5) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, k int, t double, y int, av double")
    other = df.withColumn("y", F.when(F.col("av") >= 20, 1 - F.col("y")).otherwise(F.col("y")))
    known = lambda o: {r.id: (r.n_known, r.label_sum) for r in features.known_history(df, o, ["k"], "id", "t", "y", "av").collect()}
    a, b = known(df), known(other)
    for i, k, t, _, _ in rows:
        seen = [y for j, kk, _, y, av in rows if kk == k and av < t]
        assert a[i] == (len(seen), sum(seen))
        if t <= 20:
            assert a[i] == b[i]
    leaky = features.leaky_rate(df, ["k"], "y").join(features.leaky_rate(other, ["k"], "y").select("id", F.col("rate").alias("other")), "id")
    assert leaky.filter("rate <> other and t < 20").count() > 0  # the negative control does see it
    parts = features.split_by_time(df, "t", "10", "20").groupBy("part").agg(F.min("t").alias("a"), F.max("t").alias("b")).collect()
    assert {r.part: (r.a, r.b) for r in parts} == {"train": (0, 9), "valid": (10, 19), "test": (20, 39)}


def test_leakage_is_found_and_stops_the_release(spark):
    """A clean split is released; each kind of leakage, one at a time, is counted under its own name and stops it."""
    rows = [(i, i, float(i), float(i) + 2) for i in range(30)]
    frame = lambda rows: features.split_by_time(spark.createDataFrame(rows, "id long, logical long, t double, known double"), "t", "10", "20")
    found = lambda split: {r["check"]: r.violations for r in features.leakage_checks(split, "logical", "t", "known", F.lit(40.0)).collect()}
    clean = frame(rows)
    none = dict.fromkeys(["OUTCOME_KNOWN_BEFORE", "OUTCOME_NOT_MATURE", "LOGICAL_ID_CROSSES_PARTS", "PARTS_OVERLAP"], 0)
    assert found(clean) == none and features.release(features.leakage_checks(clean, "logical", "t", "known", F.lit(40.0))) == "DEPLOY"
    bad = {
        "OUTCOME_KNOWN_BEFORE": frame([*rows, (30, 30, 5.0, 5.0)]), "OUTCOME_NOT_MATURE": frame([*rows, (30, 30, 25.0, 41.0)]), "LOGICAL_ID_CROSSES_PARTS": frame([*rows, (30, 3, 25.0, 27.0)]),
        "PARTS_OVERLAP": clean.withColumn("part", F.when(F.col("id") == 12, "train").when(F.col("id") == 11, "valid").otherwise(F.col("part"))),
    }
    for name, split in bad.items():
        got = found(split)
        assert got == none | {name: 1}
    assert features.release(features.leakage_checks(bad["OUTCOME_NOT_MATURE"], "logical", "t", "known", F.lit(40.0))) == "NO_DEPLOY"
    assert features.release(features.leakage_checks(clean, "logical", "t", "known", F.lit(40.0)).limit(0)) == "NO_DEPLOY"


def test_unseen_keys_fall_back_and_are_marked(spark):
    """Without known history of the finer keys the coarser ones speak, then the prior, marked cold; the same rows in another order and partitioning give the same features, and outcomes that are not known yet change none."""
    rows = [(i, "m1", "p1", float(i), i % 2, i + 1.5) for i in range(10)] + [(20, "m1", "p9", 12.0, 0, 14.0), (21, "m9", "p9", 12.0, 0, 14.0)]
    df = spark.createDataFrame(rows, "id long, m string, p string, t double, y int, known double")
    made = lambda d: sorted(map(tuple, features.hierarchical(d, d, [["m", "p"], ["m"]], "id", "t", "y", "known").collect()))
    got = {r[0]: r for r in made(df)}
    assert got[20][2:] == (1, False) and got[21] == (21, 200_000, 2, True) and got[9][2:] == (0, False) and got[0] == (0, 200_000, 2, True)
    later = df.withColumn("y", F.when(F.col("known") >= 12, 1 - F.col("y")).otherwise(F.col("y")))
    assert made(df.orderBy(F.desc("id")).repartition(5)) == made(df) == made(later)


def test_daily_revenue_of_generated_events(spark, tmp_path):
    events = generated_events(spark, 5000)
    assert events.count() > 5000 and events.select("event_id").distinct().count() == 5000
    products = spark.range(1, 251).select(F.format_string("P%05d", "id").alias("product_id"), F.lit("TW").alias("destination_country"))
    rates = spark.createDataFrame([("2026-06-01", "USD", Decimal("32.5"))], "rate_date string, currency string, rate_to_twd decimal(24,8)")
    own = metrics.daily_revenue(events, products, rates)
    rows = {(r.event_date, r.destination_country): r.revenue for r in own.collect()}
    expected = {}
    for r in events.filter("event_type = 'paid'").dropDuplicates(["event_id"]).collect():
        rate = Decimal("32.5") if (r.event_ts[:10], r.currency) == ("2026-06-01", "USD") else 1
        key = (r.event_ts[:10], "TW" if int(r.product_id[1:]) <= 250 else "UNKNOWN")
        expected[key] = expected.get(key, 0) + r.amount * rate
    assert rows.keys() == expected.keys() and all(abs(rows[k] - expected[k]) <= Decimal("0.005") for k in rows)
    write_result_csv(own, f"file://{tmp_path}/out", ["event_date", "destination_country"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").count() == len(rows)


def test_evidence_is_byte_identical(spark, tmp_path):
    a = write_evidence(spark, f"file://{tmp_path}/a", {"x": {"b": 1, "a": "é"}})
    b = write_evidence(spark, f"file://{tmp_path}/b", {"x": {"a": "é", "b": 1}})
    assert a == b and (tmp_path / "a/x.json").read_bytes() == (tmp_path / "b/x.json").read_bytes()


def test_grading_compares_rows(spark):
    right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert metrics.grade(right.select("v", "k"), right) and not metrics.grade(right.limit(1), right) and not metrics.grade(right.withColumnRenamed("v", "w"), right)


def test_judging_runs_statements_over_the_star_alone(spark):
    fact = spark.createDataFrame([(1, "paid"), (1, "cancelled"), (2, "paid")], "member_id int, order_status string")
    members = "SELECT count(*) AS members FROM (SELECT member_id FROM fact_order {} GROUP BY member_id HAVING count(*) >= 2)"
    answers = [("a", "q09", members.format("")), ("b", "q09", members.format("WHERE order_status <> 'cancelled'")), ("c", "q09", "SELECT 1 AS members, 2 AS more"), ("d", "q09", "DROP TABLE fact_order"), ("e", "q09", "SELECT x FROM y"), ("f", "q09", "WITH t AS (SELECT '{}' AS x) SELECT bigint(1) AS members FROM t")]
    got = {r.answer_id: r.verdict for r in metrics.judge(spark, {"fact_order": fact}, answers, "2026-05", "2026-06").collect()}
    assert got == {"a": "right", "b": "wrong", "c": "error", "d": "error", "e": "error", "f": "right"}
    assert metrics.departures("q07", "SELECT avg(amount_twd) FROM f WHERE month(d) = 5") == ["cancelled_counted", "member_undated", "gross_for_net", "month_without_year"]


def test_stream_deduplicates_and_reconciles(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=20 * i), i % 5, "view", 1.5, "{}") for i in range(60)]
    again = [r for r in rows if r[0] % 7 == 0]
    for n, part in enumerate((rows[:30], again[:4] + rows[30:])):
        spark.createDataFrame(part, stream.SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
    got = stream.run_minutes(spark, f"file://{tmp_path}/in/*/*.parquet", f"file://{tmp_path}/run", files_per_batch=1)
    want = stream.minute_counts(spark.createDataFrame(rows, stream.SCHEMA).withColumn("ts", F.col("ts").cast("timestamp")))
    assert stream.reconcile(got, want, ["minute", "event_type"], ["n"]).count() == 0 and got.count() == 20
    state, aside = stream.upsert_latest(None, spark.createDataFrame([(1, 5, 0, "a"), (1, 5, 0, "b"), (2, 4, 1, "c"), (2, 4, 0, "d")], "k int, t int, s int, v string"), "k", "t", "s")
    assert [tuple(r) for r in state.collect()] == [(2, 4, 1, "c")] and aside.count() == 2


def test_streams_go_on_after_a_stop(spark, tmp_path):
    """Latest rows with conflicts and late events over two deliveries, each run from the checkpoint; a run without anything new changes nothing."""
    base = dt.datetime(2026, 1, 1)
    row = lambda i, minute, user, kind: (i, base + dt.timedelta(minutes=minute), user, kind, 1.0, "{}")
    waves = [[row(0, 0, 1, "a"), row(1, 60, 2, "a"), row(2, 60, 3, "a"), row(3, 5, 4, "x"), row(4, 5, 4, "y")], [row(5, 30, 1, "b"), row(6, 55, 2, "old"), row(7, 60, 3, "c"), row(8, 6, 4, "z"), row(9, 90, 5, None)]]
    for n, rows in enumerate(waves):
        spark.createDataFrame(rows, stream.SCHEMA).write.parquet(f"file://{tmp_path}/in/{n}")
        for _ in range(2):
            own = stream.source(spark, f"file://{tmp_path}/in/*").withColumn("sequence", F.lit(0))
            state = {r.user_id: (r.event_type, r.conflict) for r in stream.run_latest(own, f"file://{tmp_path}/latest", "user_id", "ts", "sequence", ["event_type"]).collect()}
            on_time, late = stream.run_on_time(stream.source(spark, f"file://{tmp_path}/in/*"), f"file://{tmp_path}/late")
            ids = sorted(r.event_id for r in on_time.collect()), sorted(r.event_id for r in late.collect())
            if n == 0:
                assert state == {1: ("a", False), 2: ("a", False), 3: ("a", False), 4: (None, True)} and ids == ([0, 1, 2, 3, 4], [])
    assert state == {1: ("b", False), 2: ("a", False), 3: (None, True), 4: ("z", False), 5: (None, False)}
    assert ids == ([0, 1, 2, 3, 4, 6, 7, 9], [5, 8])


def test_classifier_is_fitted_on_training_rows_alone(spark):
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), F.rand(3).alias("b")).withColumn("y", (F.col("a") + F.col("b") > 4).cast("double"))
    train, later = df.filter("id < 300"), df.filter("id >= 300")
    model = features.fit_classifier(train, ["a", "b"], "y")
    again = features.fit_classifier(train.unionByName(later.filter("id < 0")), ["a", "b"], "y")
    assert model.stages[2].coefficients == again.stages[2].coefficients
    score = features.evaluate(model, later, "y")
    assert score["roc"] > 0.95 and score["pr"] > 0.9 and score["brier"] < 0.1
