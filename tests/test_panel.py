"""Operators on hand-calculated panels, and the planner around them."""

import datetime as dt
import math
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sightline.functions import scalars as S
from sightline.operators import asof, cross_section, evaluation, labels, models, panel, rolling, schedules, signals
from sightline.plans import catalog, config, contracts, dag, experiment, experiments, registry, signal_plan
from sightline.sources import columns, documents, facts, library
from sightline.streaming import windows

D = dt.date
DAY = dt.timedelta(days=1)


def panel_of(spark, columns, n_days, securities=("A",), start=D(2024, 1, 1)):
    """A complete grid: columns are functions of (security, 0-based position)."""
    rows = [(s, start + i * DAY, i + 1, *(f(s, i) for f in columns.values())) for s in securities for i in range(n_days)]
    kinds = ", ".join(f"{c} {'boolean' if c == 'member' else 'double'}" for c in columns)
    return spark.createDataFrame(rows, f"security_id string, session date, pos long, {kinds}")


def column(df, c="x"):
    return [r[c] for r in df.orderBy("security_id", "session").collect()]


# pointwise


def test_nulls_nan_and_three_valued_logic(spark):
    df = spark.createDataFrame([(1.0, 0.0, True), (None, 2.0, None), (float("nan"), 3.0, False)], "a double, b double, c boolean")
    out = panel.ingress(df).select(S.divide(F.col("a"), F.col("b")).alias("q"), S.where(F.col("c"), F.lit("y"), F.lit("n")).alias("w"), S.clip(F.col("a"), -3, 3).alias("k"), S.fill(F.col("a"), 0.0).alias("f"), F.col("a").isNull().alias("m")).collect()
    assert [tuple(r) for r in out] == [(None, "y", 1.0, 1.0, False), (None, None, None, 0.0, True), (None, "n", None, 0.0, True)]


def test_clocks_round_away_from_leaks(spark):
    r = spark.sql("SELECT timestamp'2024-01-01 12:00:00.000001' AS t").select(S.ceil_second(F.col("t")).alias("c"), S.floor_second(F.col("t")).alias("f")).first()
    assert (r.c.second, r.f.second) == (1, 0)
    same = spark.sql("SELECT timestamp'2024-01-01 12:00:07' AS t").select(S.ceil_second(F.col("t")).alias("c")).first()
    assert same.c.second == 7


def test_visibility_and_reasons(spark):
    df = spark.createDataFrame([(1.0, 5, 5), (2.0, 6, 5), (3.0, None, 5)], "x double, at int, cut int")
    assert [r[0] for r in df.select(S.visible(F.col("x"), F.col("at"), F.col("cut"))).collect()] == [1.0, None, 3.0]
    assert [r[0] for r in df.select(S.visible(F.col("x"), F.col("at"), F.col("cut"), strict=True)).collect()] == [None, None, None]
    reason = S.first_reason([("late", F.col("at") > F.col("cut")), ("unknown", F.col("at").isNull())])
    assert [r[0] for r in df.select(reason).collect()] == [None, "late", "unknown"]


def test_frozen_preprocessing(spark):
    df = spark.createDataFrame([(5.0, 1.0, 2.0), (99.0, 1.0, 2.0), (None, 1.0, 2.0), (4.0, 1.0, 0.0)], "x double, c double, s double")
    assert [r[0] for r in df.select(S.frozen_transform(F.col("x"), F.col("c"), F.col("s"))).collect()] == [2.0, 3.0, 0.0, 3.0]


# windows


def test_shift_change_and_gaps(spark):
    p = panel_of(spark, {"x": lambda s, i: [1.0, 2.0, None, 4.0, 0.0, 6.0][i]}, 6)
    assert column(p.withColumn("x", rolling.shift(F.col("x"), 1))) == [None, 1.0, 2.0, None, 4.0, 0.0]
    assert column(p.withColumn("x", rolling.pct_change(F.col("x"), 2))) == [None, None, None, 1.0, None, 0.5]
    assert column(p.withColumn("x", rolling.pct_change(F.col("x"), 1)))[-1] is None  # a zero base


@pytest.mark.parametrize(("kind", "kw", "want"), [("mean", {}, 8 / 3), ("sum", {}, 8.0), ("min", {}, 1.0), ("max", {}, 4.0), ("median", {}, 3.0), ("std", {"ddof": 1}, math.sqrt(7 / 3)), ("std", {"ddof": 0}, math.sqrt(14 / 9)), ("rank", {}, 1 / 3)])
def test_rolling_needs_the_whole_window(spark, kind, kw, want):
    p = panel_of(spark, {"x": lambda s, i: [3.0, 4.0, 1.0, None, 5.0][i]}, 5)
    out = column(p.withColumn("x", rolling.rolling(F.col("x"), 3, kind, **kw)))
    assert out[:2] == [None, None] and out[2] == pytest.approx(want) and out[3:] == [None, None]


def test_rolling_options_and_ties(spark):
    p = panel_of(spark, {"x": lambda s, i: [1.0, 3.0, 3.0, None][i]}, 4)
    assert column(p.withColumn("x", rolling.rolling(F.col("x"), 3, "rank")))[2] == pytest.approx(2.5 / 3)
    assert column(p.withColumn("x", rolling.rolling(F.col("x"), 2, "sum", inclusive=False))) == [None, None, 4.0, 6.0]
    assert column(p.withColumn("x", rolling.rolling(F.col("x"), 2, "mean", min_periods=1))) == [1.0, 2.0, 3.0, 3.0]


# cross-section


def test_zscore_of_members_only(spark):
    rows = [("A", 1.0, True), ("B", 3.0, True), ("C", 1e6, False), ("D", None, True)]
    df = spark.createDataFrame([(s, D(2024, 1, 1), x, m) for s, x, m in rows], "security_id string, session date, x double, member boolean")
    assert column(cross_section.zscore(df, "x", "member", "z"), "z") == [-1.0, 1.0, None, None]
    assert column(df.withColumn("z", cross_section.zscore_column(F.col("x"), F.col("member"))), "z") == [-1.0, 1.0, None, None]
    flat = df.withColumn("x", F.lit(2.0))
    assert column(cross_section.zscore(flat, "x", "member", "z"), "z") == [None] * 4
    with pytest.raises(panel.PanelError):
        signals.daily_zscore(flat, "x")


def test_rank_and_winsorize(spark):
    df = spark.createDataFrame([(s, D(2024, 1, 1), x, m) for s, x, m in [("A", 1.0, True), ("B", 1.0, True), ("C", 3.0, True), ("D", 0.0, False)]], "security_id string, session date, x double, member boolean")
    assert column(df.withColumn("r", cross_section.rank_column(F.col("x"), F.col("member"))), "r") == [0.5, 0.5, 1.0, None]
    w = spark.createDataFrame([("A", D(2024, 1, 1), 0.0, True), ("B", D(2024, 1, 1), 100.0, True), ("C", D(2024, 1, 1), 1e4, False)], df.schema)
    assert column(cross_section.winsorize(w, "x", "member", "w"), "w") == [pytest.approx(1.0), pytest.approx(99.0), None]


# grids and joins


def test_grid_keys_and_overlaps(spark):
    f = spark.createDataFrame([("A", D(2024, 1, 1), 1.0), ("B", D(2024, 1, 3), 2.0)], "security_id string, session date, x double")
    full = panel.grid_reasons(panel.grid(f, panel.calendar(f), f), ["x"])
    assert column(full) == [1.0, None, None, 2.0] and column(full, "x__missing_reason") == [None, "grid_hole", "grid_hole", None]
    assert panel.missing_keys(full, f).count() == 2
    with pytest.raises(panel.PanelError):
        panel.require_unique(f.union(f))
    with pytest.raises(panel.PanelError):
        panel.join_one_to_one(f, f.limit(1))
    with pytest.raises(panel.PanelError):
        panel.concatenate([f, f])
    assert panel.join_one_to_one(f, f.withColumnRenamed("x", "y")).count() == 2


def test_iso_weeks_probe_and_ranges(spark):
    days = spark.createDataFrame([(D(2020, 12, 31),), (D(2021, 1, 1),), (D(2021, 1, 4),)], "session date")
    assert sorted(r.session for r in panel.first_of_iso_week(days).collect()) == [D(2020, 12, 31), D(2021, 1, 4)]
    states = spark.createDataFrame([(D(2021, 1, 1), "open"), (D(2021, 1, 2), "closed"), (D(2021, 1, 4), "closed"), (D(2021, 1, 5), "open")], "session date, state string")
    out = {r.session: r.problem for r in panel.probe_calendar(states, days, "2021-01-01", "2021-01-05").collect()}
    assert out == {D(2021, 1, 3): "unprobed", D(2021, 1, 4): "session_while_closed", D(2021, 1, 5): "open_without_session"}
    spans = spark.createDataFrame([("k", D(2024, 1, 1), D(2024, 1, 3)), ("k", D(2024, 1, 4), D(2024, 1, 5)), ("k", D(2024, 1, 8), D(2024, 1, 9))], "k string, a date, b date")
    assert sorted((r.a.day, r.b.day) for r in panel.coalesce_ranges(spans, ["k"], "a", "b").collect()) == [(1, 5), (8, 9)]


def reports(spark, rows):
    t = lambda s: dt.datetime.fromisoformat(s)
    return spark.createDataFrame([("A", D.fromisoformat(p), t(u), r, v) for p, u, r, v in rows], "security_id string, report_period date, usable_from timestamp, revision_id string, value double")


def visits(spark, days, hour=20):
    return spark.createDataFrame([("A", d, dt.datetime(d.year, d.month, d.day, hour)) for d in days], "security_id string, session date, cutoff timestamp")


def test_reports_as_they_were_known(spark):
    days = [D(2025, 1, 2), D(2025, 1, 3), D(2025, 1, 6)]
    e = reports(spark, [("2024-09-30", "2024-11-01T00:00:00", "r1", 100.0), ("2024-09-30", "2025-01-06T10:00:00", "r2", 120.0), ("2024-06-30", "2025-01-03T09:00:00", "late", 999.0)])
    assert column(asof.latest_report(visits(spark, days), e, "value", "x")) == [100.0, 100.0, 120.0]  # an older period that comes late doesn't win
    gone = reports(spark, [("2024-09-30", "2025-01-03T00:00:00", "r1", 100.0), ("2024-09-30", "2025-01-06T00:00:00", "r2", None)])
    assert column(asof.latest_report(visits(spark, days), gone, "value", "x")) == [None, 100.0, None]
    edge = reports(spark, [("2024-09-30", "2025-01-03T20:00:00", "r1", 7.0)])
    assert column(asof.latest_report(visits(spark, days), edge, "value", "x")) == [None, 7.0, 7.0]
    assert column(asof.latest_report(visits(spark, days), edge, "value", "x", strict=True)) == [None, None, 7.0]
    ahead = reports(spark, [("2025-01-05", "2025-01-01T00:00:00", "r1", 5.0)])
    assert column(asof.latest_report(visits(spark, days), ahead, "value", "x")) == [None, None, 5.0]  # not before its period


def test_reports_against_brute_force(spark):
    r = random.Random(1)
    base = dt.datetime(2025, 1, 1)
    for strict in (False, True):
        rows = [((base + dt.timedelta(days=r.randrange(12))).date().isoformat(), (base + dt.timedelta(hours=4 * r.randrange(90))).isoformat(), f"r{i:03}", float(i)) for i in range(60)]
        days = [base.date() + i * DAY for i in range(14)]
        got = column(asof.latest_report(visits(spark, days), reports(spark, rows), "value", "x", strict=strict))
        want = []
        for d in days:
            cut = dt.datetime(d.year, d.month, d.day, 20).isoformat()
            seen = [x for x in rows if x[0] <= d.isoformat() and (x[1] < cut if strict else x[1] <= cut)]
            want.append(max(seen)[3] if seen else None)
        assert got == want


def test_common_anchor_adjustment(spark):
    p = panel_of(spark, {"close": lambda s, i: [10.0, 10.0, None, 5.0][i]}, 4)
    f = panel_of(spark, {"factor": lambda s, i: [1.0, 1.0, 1.0, 2.0][i]}, 4)
    anchor = p.agg(F.max("session").alias("anchor_session"))
    out = asof.adjust_to_anchor(p, f, ["close"], anchor)
    assert column(out, "close__adjusted") == [5.0, 5.0, None, 5.0] and column(out, "close__reason") == [None, None, "price_missing", None]
    own = asof.adjust_to_anchor(p, f.withColumn("factor", F.when(F.col("pos") != 2, F.col("factor"))), ["close"])
    assert column(own, "close__reason") == [None, "factor_missing", "price_missing", None]


def test_window_rule_uses_the_output_sessions_cutoff(spark):
    f = spark.createDataFrame([("A", 1, 1.0, 5), ("A", 2, 2.0, 2), ("A", 3, 3.0, 3)], "security_id string, pos long, x double, usable_from int")
    outs = spark.createDataFrame([(2, 2, 2), (3, 3, 5)], "out_session int, out_pos long, cutoff int")
    got = sorted((r.out_session, r.x) for r in asof.visible_window(f, outs, 3).collect())
    assert got == [(2, 2.0), (3, 1.0), (3, 2.0), (3, 3.0)]


# labels


def test_labels_on_an_irregular_calendar(spark):
    days = [D(2024, 2, 7), D(2024, 2, 8), D(2024, 2, 19), D(2024, 2, 20), D(2024, 2, 21), D(2024, 2, 22), D(2024, 2, 23)]
    rows = [("A", d, i + 1, 10.0, 15.0, dt.datetime(d.year, d.month, d.day, 8, 15)) for i, d in enumerate(days)]
    p = spark.createDataFrame(rows, "security_id string, session date, pos long, open double, close double, clock timestamp")
    out = labels.forward_labels(p, 5, clock="clock").orderBy("session").collect()
    assert (out[0].start_session, out[0].end_session, out[0]["return"]) == (D(2024, 2, 8), D(2024, 2, 22), 0.5)
    assert [r.invalid_reason for r in out] == [None, None] + ["calendar_endpoint_uncovered"] * 5
    mature = labels.mature(labels.forward_labels(p, 5, clock="clock"), "2024-02-22 08:15:00")
    assert mature.count() == 1 and labels.mature(labels.forward_labels(p, 5, clock="clock"), "2024-02-22 08:15:00", strict=True).count() == 0
    bad = labels.forward_labels(p.withColumn("open", F.when(F.col("pos") == 2, 0.0).otherwise(F.col("open"))), 5).orderBy("session").first()
    assert bad.invalid_reason == "start_not_positive" and bad["return"] is None


def test_label_normalisation_ignores_the_ineligible(spark):
    rows = [("A", 0.1, None), ("B", 0.3, None), ("C", 50.0, "NOT_MEMBER"), ("D", None, "RAW_LABEL_INVALID")]
    df = spark.createDataFrame([(s, D(2024, 1, 1), r, why) for s, r, why in rows], "security_id string, session date, `return` double, reason string")
    out = column(labels.normalize(df), "normalized")
    assert out[:2] == [pytest.approx(-1.0), pytest.approx(1.0)] and out[2:] == [None, None]
    assert {r.reason: r.n for r in labels.exclusion_counts(df).collect()} == {"ELIGIBLE": 2, "NOT_MEMBER": 1, "RAW_LABEL_INVALID": 1}
    with pytest.raises(labels.LabelError):
        labels.resolve_target("close", "close", 5)


# signals and evaluation


def test_blends_top_k_and_joins(spark):
    with pytest.raises(panel.PanelError):
        signals.weighted({"a": 0.7, "b": 0.7})
    df = spark.createDataFrame([("B", D(2024, 1, 1), 2.0), ("A", D(2024, 1, 1), 2.0), ("C", D(2024, 1, 1), -1.0), ("A", D(2024, 1, 2), 0.0)], "security_id string, session date, score double")
    assert [(r.security_id, r["rank"]) for r in signals.top_k(df, 1).collect()] == [("A", 1)]
    other = df.filter("security_id <> 'B'").withColumn("score", F.col("score") * 2)
    assert signals.join_signals({"a": df, "b": other}).count() == 3 and signals.join_signals({"a": df, "b": other}, outer=True).count() == 4
    assert signals.join_signals({"a": df, "b": other}, outer=True).select(signals.weighted({"a": 0.25, "b": 0.75}).alias("x")).filter("x is null").count() == 1


def pairs_of(spark, rows):
    return spark.createDataFrame([(g, f"S{i:03}", D(2024, 1, d), float(x), float(y)) for g, d, i, x, y in rows], "signal string, security_id string, session date, score double, outcome double")


def test_coefficients_and_why_there_is_none(spark):
    rows = [("a", 1, i, i, i / 100) for i in range(20)] + [("a", 2, i, 1, i) for i in range(20)] + [("a", 3, i, i, i) for i in range(19)] + [("a", 4, i, i, -(i**3)) for i in range(20)]
    p = pairs_of(spark, rows)
    scope = p.select("signal", "session").distinct().union(spark.createDataFrame([("a", D(2024, 1, 9))], "signal string, session date"))
    out = {r.session.day: r for r in evaluation.daily_ic(p, scope).collect()}
    assert out[1].ic == pytest.approx(1.0) and out[2].reason == "CONSTANT_CROSS_SECTION" and out[3].reason == out[9].reason == "INSUFFICIENT_PAIRS" and out[9].n_pairs == 0
    ranked = {r.session.day: r.ic for r in evaluation.daily_ic(p.repartition(7), scope, rank=True).collect()}
    assert ranked[4] == pytest.approx(-1.0) and ranked[2] is None and -1 < out[4].ic < -0.8
    s = evaluation.ic_summary(evaluation.daily_ic(p, scope)).first()
    assert s.n_sessions == 2 and s.mean_ic == pytest.approx((1 + out[4].ic) / 2) and s.icir == pytest.approx(s.mean_ic / s.std_ic)
    empty = evaluation.ic_summary(evaluation.daily_ic(p.filter("session = '2024-01-03'"))).first()
    assert empty.reason == "NO_VALID_SESSIONS" and empty.icir is None


def test_common_sample_and_groups(spark):
    p = pairs_of(spark, [("a", 1, i, i, i) for i in range(24)] + [("b", 1, i, -i, i) for i in range(5, 24)])
    both = evaluation.daily_ic(evaluation.samples(p, 2), by=("sample", "signal"))
    out = {(r["sample"], r.signal): (r.n_pairs, r.ic) for r in both.collect()}
    assert out["native", "a"] == (24, pytest.approx(1.0)) and out["common", "a"] == (19, None) and out["native", "b"] == (19, None)
    g = {r.group: r for r in evaluation.quantile_groups(p, 4).collect()}
    assert sorted(g) == [1, 2, 3, 4] and g[1].mean_outcome == pytest.approx(2.5) and g[4].n_pairs == 6
    tied = evaluation.quantile_groups(pairs_of(spark, [("a", 1, i, 0, i) for i in range(20)]), 4).collect()
    assert [(r.group, r.n_pairs) for r in tied] == [(3, 20)]  # ties are never split


# schedules and models


def test_weekly_and_periodic_folds(spark):
    cal = [d for i in range(1886) if (d := D(2019, 1, 1) + i * DAY).weekday() < 5]
    days = spark.createDataFrame([(d,) for d in cal], "session date")
    w = schedules.weekly_folds(days).orderBy("fold").collect()
    assert (w[0].first_trade, w[0].last_trade, w[0].prediction_session) == (D(2019, 1, 1), D(2019, 1, 4), None) and w[1].prediction_session == D(2019, 1, 4)
    p = schedules.periodic_folds(days, 20, 504, 40)
    first = p.orderBy("fold").first()
    assert first.train_length == 543 and first.first_trade == cal[543] and first.n_trades == 20
    train = schedules.training_sessions(p.filter("fold = 1"), days, last=543)
    assert train.count() == 543 and schedules.nominally_mature(train, 40).count() == 504
    leap = schedules.training_sessions(spark.createDataFrame([(1, 9999, D(2024, 2, 29))], "fold long, fit_pos long, first_trade date"), days, years=1)
    assert leap.agg(F.min("session")).first()[0] == D(2023, 2, 28)


def test_clocks_of_folds():
    assert schedules.local_clock("2024-07-01", "20:30", "Asia/Shanghai").hour == 12
    for day in ("2024-03-31", "2024-10-27"):
        with pytest.raises(ValueError):
            schedules.local_clock(day, "02:30", "Europe/Berlin")
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3, 4)]
    schedules.check_fold_clocks(*t)
    with pytest.raises(ValueError):
        schedules.check_fold_clocks(t[1], t[1], t[2], t[3])


def test_models_learn_and_say_why_not(spark):
    p = panel_of(spark, {"x": lambda s, i: float(i % 10), "label": lambda s, i: float(i % 10 > 4), "member": lambda s, i: s != "N"}, 60, ("A", "N"))
    model = models.fit(p.filter("member"), ["x"], "label", models.TrainingProfile(rounds=3, depth=2))
    out = models.predict(model, p.withColumn("x", F.when(F.col("pos") != 60, F.col("x"))), ["x"])
    assert {(r.invalid_reason, r.valid) for r in out.collect()} == {(None, True), ("NOT_MEMBER", False), ("FEATURE_MISSING", False)}
    high = out.join(p, ["security_id", "session"]).filter("valid").groupBy((F.col("x") > 4).alias("h")).agg(F.avg("score").alias("m"))
    m = {r.h: r.m for r in high.collect()}
    assert m[True] > m[False]
    with pytest.raises(panel.PanelError):
        models.fit(p.limit(5), ["x"], "label")


# plans


def test_stock_catalog_on_hand_values(spark):
    p = panel_of(spark, {"open": lambda s, i: 9.0, "high": lambda s, i: 12.0 + i, "low": lambda s, i: 8.0 + i, "close": lambda s, i: 10.0 + i if i != 3 else None, "amount": lambda s, i: 100.0 * (i + 1), "member": lambda s, i: True}, 30)
    nodes, outputs = catalog.stock_catalog()
    rows = dag.compile_plan(p, nodes, outputs).orderBy("session").collect()
    assert rows[2].ret1 == pytest.approx(12 / 11 - 1) and rows[3].ret1 is None and rows[4].ret1 is None and rows[9].ret5 == pytest.approx(19 / 14 - 1) and rows[8].ret5 is None
    assert rows[2].intraday_range == pytest.approx(4 / 12) and rows[0].close_to_open == pytest.approx(10 / 9 - 1) and rows[4].amount_relative_5 == pytest.approx(500 / 300)
    assert rows[23].ret20 is None and rows[24].ret20 == pytest.approx(34 / 14 - 1)
    assert [dag.history(nodes, [o]) for o in outputs] == [2, 6, 21, 1, 1, 5]


def test_price_catalog_has_all_columns_and_histories(spark):
    nodes, outputs = catalog.price_catalog()
    assert len(outputs) == len(set(outputs)) == 88 and dag.history(nodes, ["PRICEPOS252"]) == 252 and dag.history(nodes, ["VOLADJRET120"]) == 121
    assert next(n for n in nodes if n.name == "ILLIQ20").unit == "1/CNY"
    b = catalog.Builder()
    out = catalog.rolling_features(b, (5,)) + catalog.bar_features(b)
    p = panel_of(spark, {"open": lambda s, i: 10.0 + i, "high": lambda s, i: 13.0 + i, "low": lambda s, i: 9.0 + i, "close": lambda s, i: 12.0 + i, "amount": lambda s, i: 1.0}, 8)
    r = dag.compile_plan(p, b.nodes, out).orderBy("session").collect()[7]
    c = 19.0
    assert (r.ROC5, r.MA5, r.MAX5, r.MIN5, r.RANK5) == pytest.approx((14 / c, 17 / c, 20 / c, 12 / c, 1.0)) and r.RSV5 == pytest.approx(7 / 8)
    assert (r.CNTP5, r.CNTN5, r.CNTD5) == (1.0, 0.0, 1.0) and r.SUMP5 == pytest.approx(1.0) and r.STD5 == pytest.approx(math.sqrt(2.5) / c)
    assert r.KMID == pytest.approx(2 / 17) and r.KUP == pytest.approx(1 / 17) and r.KLOW2 == pytest.approx(1 / 4) and r.KSFT == pytest.approx(2 / 17)


def test_plans_that_are_wrong(spark):
    p = panel_of(spark, {"x": lambda s, i: 1.0}, 2)
    node = lambda *a: dag.Node(*a)
    for nodes in ([node("a", "nope", ("x",))], [node("a", "add", ("x",))], [node("a", "identity", ("b",)), node("b", "identity", ("a",))], [node("x", "identity", ("x",))]):
        with pytest.raises(dag.PlanError):
            dag.compile_plan(p, nodes, [nodes[0].name])
    out = dag.compile_plan(p, [dag.Node("y", "identity", ("x",), {}, "CNY", "fact"), dag.Node("z", "log1p", ("x",))], ["y"])
    assert out.columns == ["security_id", "session", "y"] and out.schema["y"].metadata == {"unit": "CNY", "stage": "fact"}
    assert "| y | identity | x | CNY |" in catalog.render([dag.Node("y", "identity", ("x",), {}, "CNY")], ["y"])


def test_results_don_t_depend_on_order_or_the_future(spark):
    p = panel_of(spark, {"close": lambda s, i: 10.0 + (i * 7 + ord(s)) % 5, "member": lambda s, i: s != "C"}, 12, ("A", "B", "C"))
    nodes, outputs = catalog.rotation_recipe(3)
    whole = [tuple(r) for r in dag.compile_plan(p, nodes, outputs).orderBy("security_id", "session").collect()]
    assert whole == [tuple(r) for r in dag.compile_plan(p.orderBy(F.rand(3)).repartition(5), nodes, outputs).orderBy("security_id", "session").collect()]
    past = dag.compile_plan(p.filter("pos <= 8"), nodes, outputs).orderBy("security_id", "session").collect()
    assert [tuple(r) for r in past] == [r for r in whole if r[1] < D(2024, 1, 9)]


# sources


def test_facts_as_known_at_each_cutoff(spark):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [("A", D(2024, 1, 1), "close", 1.0, t(1, 12), "r1", None), ("A", D(2024, 1, 1), "close", 9.0, t(2, 12), "r2", None), ("A", D(2024, 1, 2), "close", float("nan"), t(2, 12), "r1", None), ("A", D(2024, 1, 2), "open", 5.0, t(2, 23), "r1", None)]
    f = spark.createDataFrame(rows, facts.FACTS)
    cuts = spark.createDataFrame([(D(2024, 1, 1), t(1, 20)), (D(2024, 1, 2), t(2, 20))], "session date, cutoff timestamp")
    out = facts.select_facts(f, facts.FactQuery(("close", "open"), "2024-01-01", "2024-01-02"), cuts).orderBy("session").collect()
    assert (out[0].close, out[0].close__at, out[1].close, out[1].open) == (1.0, t(1, 12), None, None)
    for bad in ("", "latest", "current "):
        with pytest.raises(facts.SourceError):
            facts.pinned(bad)
    spans = spark.createDataFrame([("A", D(2024, 1, 1), D(2024, 1, 2)), ("B", D(2024, 1, 2), None)], "security_id string, valid_from date, valid_to date")
    assert sorted((r.security_id, r.session.day) for r in facts.members(spans, cuts).collect()) == [("A", 1), ("B", 2)]


def test_panels_on_disk(spark, tmp_path):
    p = panel_of(spark, {"x": lambda s, i: float(i)}, 4, ("A", "B"))
    path = str(tmp_path / "p")
    facts.write_panel(p, path)
    assert facts.read_panel(spark, path, "2024-01-03").count() == 4
    assert facts.read_view(spark, path, ["x"], "2024-01-01", "2024-01-02", symbols=["A"]).count() == 2
    with pytest.raises(facts.SourceError):
        facts.read_view(spark, path, ["x"], "2023-01-01", "2024-01-02", symbols=["A"])
    with pytest.raises(facts.SourceError):
        facts.read_view(spark, path, ["x"], "2024-01-01", "2024-01-02")


def test_library_computes_only_gaps(spark, tmp_path):
    path, asked = str(tmp_path / "lib"), []
    cells = lambda n, ref="v1": spark.createDataFrame([("f", "A", D(2024, 1, d), ref) for d in range(1, n + 1)], "feature string, security_id string, session date, dependency_ref string")

    def compute(gap):
        asked.append(gap.count())
        return gap.withColumns({"value": F.lit(1.0), "available_at": F.lit("2024-02-01").cast("timestamp")})

    for n, ref in ((3, "v1"), (5, "v1"), (5, "v1"), (5, "v2")):
        assert library.ensure(spark, path, cells(n, ref), compute).count() == n
    assert asked == [3, 2, 5]


def test_documents_are_strict():
    assert documents.canonical({"b": 1, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}'
    for bad in ('{"a":1,"a":2}', "NaN"):
        with pytest.raises(documents.DocumentError):
            documents.parse(bad)
    with pytest.raises(documents.DocumentError):
        documents.canonical(float("nan"))
    assert documents.differences({"a": 1, "b/c": {"d": 2}}, {"b/c": {"d": 3}}) == [
        {"pointer": "/a", "before": 1, "after": None, "before_present": True, "after_present": False},
        {"pointer": "/b~1c/d", "before": 2, "after": 3, "before_present": True, "after_present": True},
    ]
    pointers = lambda a, b: [(x["pointer"], x["before_present"], x["after_present"]) for x in documents.differences(a, b)]
    assert pointers({"l": [1, {"x": 1}], "m": [1]}, {"l": [2, {"x": 1.0}], "m": [1, 2]}) == [("/l/0", True, True), ("/l/1/x", True, True), ("/m", True, True)]
    assert pointers({"a": {"b": {"c": 1}}}, {"a": {"z": {"c": 1}}}) == [("/a/b", True, False), ("/a/z", False, True)]
    assert pointers(1, True) == [("", True, True)] and pointers({"a": None}, {}) == [("/a", True, False)] and pointers([], []) == []


def test_yaml_subset():
    pytest.importorskip("yaml")
    assert documents.load_yaml("day: 2024-01-02\nn: 3\nl: [1, x]") == {"day": "2024-01-02", "n": 3, "l": [1, "x"]}
    assert documents.load_yaml("a: {b: [{c: 1}, {c: 2}], d: null}\n1: yes") == {"a": {"b": [{"c": 1}, {"c": 2}], "d": None}, "1": True}
    for bad in ("a: 1\na: 2", "a: &x 1\nb: *x", "b: {<<: {c: 1}}", "? [a]\n: 1", "a: !!binary aGk=", "a: !!python/none ''", "x" * (documents.MOST_YAML + 1)):
        with pytest.raises(documents.DocumentError):
            documents.load_yaml(bad)


# contracts, records and whole queries


def test_contracts_round_trip_and_reject():
    plan = contracts.SignalPlanSpec((contracts.SignalNode("a", "raw"), contracts.SignalNode("z", "daily_zscore", ("a",)), contracts.SignalNode("w", "weighted_combine", ("z", "a"), (0.25, 0.75))), "w")
    assert contracts.loads(contracts.dumps(contracts.validate(plan))) == plan
    for bad in (contracts.SignalPlanSpec(plan.nodes, "nope"), contracts.SignalPlanSpec(plan.nodes[1:], "w"), contracts.LabelSpec(horizon=0), contracts.Column("x", "int8"), contracts.FoldSpec("f", "2024-02-01", "2024-01-01", "2024-03-01", 3)):
        with pytest.raises(contracts.ContractError):
            contracts.validate(bad)
    a, b = contracts.LabelSpec(metadata={"x": 1}), contracts.LabelSpec(metadata={"x": 2})
    assert contracts.semantic_identity(a) == contracts.semantic_identity(b) and contracts.content_digest(a) != contracts.content_digest(b)
    assert contracts.semantic_identity(a) != contracts.semantic_identity(contracts.LabelSpec(horizon=6))
    with pytest.raises(contracts.ContractError):
        contracts.loads('{"type":"Unknown"}')
    with pytest.raises(contracts.ContractError):
        contracts.admit(contracts.LabelSpec(price_basis=contracts.Unknown("not decided")))
    assert contracts.contract_schema(contracts.DatasetSpec)["properties"]["folds"]["items"]["properties"]["type"] == {"const": "FoldSpec"}


def test_experiment_records(tmp_path):
    store = experiments.ExperimentStore(str(tmp_path / "x" / "records.jsonl"))
    q, v, r = store.register({"name": "does it work"}, {"h": 5}, {"n": 1}, "2024-01-01")
    assert store.register({"name": "does it work"}, {"h": 5}, {"n": 1}, "2024-01-09") == (q, v, r)
    _, v2, _ = store.register({"name": "does it work"}, {"h": 6}, {"n": 1}, "2024-01-02")
    store.set_state(r, "RUNNING", "2024-01-03")
    store.set_state(r, "COMPLETE", "2024-01-04")
    with pytest.raises(experiments.RecordError):
        store.set_state(r, "RUNNING", "2024-01-05")
    assert store.organise(q, "ideas", 0, "2024-01-05") == 1
    with pytest.raises(experiments.RevisionConflict):
        store.organise(q, "other", 0, "2024-01-05")
    reader = experiments.ExperimentReader(store)
    (row,) = reader.index("ideas")
    assert (row["n_versions"], row["n_runs"], row["last_activity"]) == (2, 2, "2024-01-05")
    assert [d["pointer"] for d in reader.compare_versions(v, v2)] == ["/h"] and {x["state"] for x in reader.detail(q)["runs"]} == {"COMPLETE", None}
    text = (tmp_path / "x" / "records.jsonl").read_text().replace('"h":5', '"h":7')
    (tmp_path / "x" / "records.jsonl").write_text(text)
    with pytest.raises(documents.DocumentError):
        store.entries()


def test_rotation_is_built_once(spark, tmp_path):
    p = panel_of(spark, {"close": lambda s, i: 100.0 + i * (1 if s == "A" else -1), "member": lambda s, i: True}, 21, ("A", "B"))
    f = panel_of(spark, {"factor": lambda s, i: 1.0 if i < 10 else 2.0}, 21, ("A", "B"))
    features, picks = experiment.build_rotation(spark, str(tmp_path), "snap@1", p, f, momentum=5)
    assert not features.reused and not picks.reused
    assert {r.security_id for r in picks.read(spark).collect()} == {"A"}
    again = experiment.build_rotation(spark, str(tmp_path), "snap@1", p, f, momentum=5)
    assert again[0].reused and again[1].reused and again[0].path == features.path
    step = {r.session.day: r.momentum for r in features.read(spark).filter("security_id = 'A'").collect()}
    assert step[12] == pytest.approx(2 * 111 / 106 - 1)  # a factor step within the window
    with pytest.raises(panel.PanelError):
        experiment.build_rotation(spark, str(tmp_path), "snap@1", p, f, momentum=21)


def test_rotation_looks_at_nothing_after_a_session(spark, tmp_path):
    p = panel_of(spark, {"close": lambda s, i: None if s == "B" and i > 14 else 100.0 + i, "member": lambda s, i: True}, 21, ("A", "B"))
    f = panel_of(spark, {"factor": lambda s, i: None if s == "B" and i > 14 else 1.0 if i < 10 else 2.0}, 21, ("A", "B"))
    out = experiment.rotation_features(p, f, 5)
    early = {(r.security_id, r.session): r for r in out.collect()}
    for last in (9, 14):  # what is known up to a session gives the same up to it
        cut = lambda df, last=last: df.filter(F.col("pos") <= last + 1)
        assert all(early[r.security_id, r.session] == r for r in experiment.rotation_features(cut(p), cut(f), 5).collect())
    held = [r.momentum for r in out.filter("security_id = 'B'").orderBy("session").collect()]
    assert [x is None for x in held] == [True] * 5 + [False] * 10 + [True] * 6 and held[9] == pytest.approx(109 / 104 - 1)
    assert [r.adjusted_close for r in out.filter("security_id = 'B'").orderBy("session").collect()][12:16] == [112.0, 113.0, 114.0, None]


def test_identities_hold_the_content(spark, tmp_path):
    p = panel_of(spark, {"close": lambda s, i: 100.0 + i, "member": lambda s, i: True}, 8, ("A", "B"))
    f = panel_of(spark, {"factor": lambda s, i: 1.0}, 8, ("A", "B"))
    build = lambda prices, factors, **more: experiment.build_rotation(spark, str(tmp_path), "s@1", prices, factors, momentum=3, **more)[0]
    one = build(p, f)
    assert build(p.repartition(5).orderBy(F.desc("session")), f).reused
    other = build(p.withColumn("close", F.col("close") * F.when(F.col("pos") == 2, 2.0).otherwise(1.0)), f)
    assert not other.reused and other.path != one.path and not build(p, f.withColumn("factor", F.lit(2.0))).reused
    trusted = build(p, f, trusted=True)
    assert not trusted.reused and build(p, f, trusted=True).reused
    # what was published is checked, by its files and by its rows
    assert documents.audit(spark, one.path, experiment.rotation_features(p, f, 3)) == {"only_published": 0, "only_rebuilt": 0}
    assert documents.audit(spark, one.path, other.read(spark))["only_rebuilt"] > 0
    documents.published(spark, one.path, scan=True)
    table = Path(one.path) / "table"
    victim = next(table.glob("part-*"))
    victim.rename(victim.with_name("part-lost.txt"))
    with pytest.raises(documents.DocumentError):
        one.read(spark)


def test_column_sources(spark, tmp_path):
    p = panel_of(spark, {"close": lambda s, i: None if i == 2 else 0.1 + i}, 4, ("A", "B")).withColumn("close__missing_reason", F.when(F.col("close").isNull(), "suspended"))
    path, there = columns.build_column_source(spark, str(tmp_path), "s@1", p, ["close"])
    assert not there and columns.build_column_source(spark, str(tmp_path), "s@1", p, ["close"]) == (path, True)
    out = columns.load_column_source(spark, path, scan=True).filter("security_id = 'A'").orderBy("session").collect()
    assert [r.close for r in out] == [pytest.approx(0.1, abs=1e-7), pytest.approx(1.1, abs=1e-7), None, pytest.approx(3.1, abs=1e-6)] and [r.close__missing_reason for r in out] == [None, None, "suspended", None]
    assert [(r.path.rpartition("/")[2], r.kind) for r in columns.index_of(spark, str(tmp_path)).collect()] == [(path.rpartition("/")[2], "columns")]
    for bad in (p.filter("security_id = 'A' or pos > 1"), p.union(p.limit(1))):
        with pytest.raises(panel.PanelError):
            columns.build_column_source(spark, str(tmp_path), "s@1", bad, ["close"])
    with pytest.raises(panel.PanelError):
        columns.load_column_source(spark, path, ["open"])


def test_views_are_exported_and_sources_watched(spark, tmp_path):
    p = panel_of(spark, {"close": lambda s, i: 1.0 + i}, 4, ("A", "B"))
    facts.export_view(p, str(tmp_path / "v"), ["close"], p.filter("security_id = 'B'"))
    out = facts.read_view(spark, str(tmp_path / "v"), ["close"], "2024-01-02", "2024-01-03", ["A", "B"]).collect()
    assert sorted((r.security_id, r.close) for r in out) == [("B", 2.0), ("B", 3.0)]
    with documents.Unchanged(spark, str(tmp_path / "v")):
        pass
    with pytest.raises(documents.DocumentError), documents.Unchanged(spark, str(tmp_path / "v")):
        (tmp_path / "v" / "more").write_text("x")


def test_rank_buffer_against_a_loop(spark):
    r = random.Random(5)
    score = {(s, i): r.choice([None, -1.0, round(r.random(), 1)]) if i != 4 else None for s in "ABCDEFG" for i in range(12)}
    p = panel_of(spark, {"score": lambda s, i: score[s, i]}, 12, tuple("ABCDEFG"))
    got = [x.held for x in signals.rank_buffer(p, 2, 4).orderBy("session").collect()]
    held, want = [], []
    for i in range(12):
        best = [s for _, s in sorted((-score[s, i], s) for s in "ABCDEFG" if (score[s, i] or 0) > 0)][:4]
        held = ([s for s in held if s in best] + [s for s in best if s not in held])[:2]
        want.append(held)
    assert got == want and [] in want


def test_plugged_in_functions(spark):
    if "twice" not in dag.OPERATORS:
        dag.plug_in("twice", 1, lambda x: x * 2)
    with pytest.raises(dag.PlanError):
        dag.plug_in("twice", 1, lambda x: x)
    p = panel_of(spark, {"close": lambda s, i: None if i == 1 else 1.0 + i}, 3)
    assert column(dag.compile_plan(p, [dag.Node("y", "twice", ("close",))], ["y"]), "y") == [2.0, None, 6.0]


def test_clocks_of_features(spark):
    p = panel_of(spark, {"x": lambda s, i: float(i % 5), "label": lambda s, i: float(i % 5 > 2), "member": lambda s, i: s != "N"}, 60, ("A", "N"))
    cutoff = F.col("session").cast("timestamp")
    p = p.withColumns({"cutoff": cutoff, "features_at": F.when(F.col("pos") == 60, cutoff + F.expr("interval 1 second")).when(F.col("pos") != 59, cutoff)})
    model = models.fit(p.filter(models.usable(["x"], p)), ["x"], "label", models.TrainingProfile(rounds=2, depth=2))
    out = models.predict(model, p.withColumn("x", F.when(F.col("pos") < 59, F.col("x")).when(F.col("pos") == 60, float("nan"))), ["x"]).filter("security_id = 'A'")
    assert [r.invalid_reason for r in out.orderBy("session").collect()][57:] == [None, "FEATURE_AVAILABILITY_UNKNOWN", "FEATURE_AVAILABILITY_UNKNOWN"]


def test_gaps_are_filled_by_a_stream(spark, tmp_path):
    cells = lambda days: spark.createDataFrame([("f", s, D(2024, 1, d), "v1") for s in "AB" for d in days], "feature string, security_id string, session date, dependency_ref string")
    asked = []

    def compute(gap):
        asked.append(gap.count())
        return gap.withColumns({"value": F.lit(1.0), "available_at": F.lit(dt.datetime(2024, 1, 9))})

    for days in ((1, 2), (2, 3)):
        cells(days).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(cells((1,)).schema).parquet(str(tmp_path / "in"))
        windows.fill_gaps(stream, str(tmp_path / "lib"), str(tmp_path / "at"), compute).awaitTermination()
    assert asked == [4, 2] and library.ensure(spark, str(tmp_path / "lib"), cells((1, 2, 3)), compute).count() == 6 and asked == [4, 2]


def test_joint_features(spark, tmp_path):
    p = panel_of(spark, {"close": lambda s, i: [10.0, None, 20.0][i]}, 3)
    sessions = p.select("security_id", "session", "pos", (F.col("session").cast("timestamp") + F.expr("interval 20 hours")).alias("cutoff"))
    e = reports(spark, [("2023-12-31", "2024-01-02T00:00:00", "r1", 50.0)])
    built = experiment.build_joint(spark, str(tmp_path), "s@1", {"daily": p.drop("pos")}, sessions, e, "value")
    out = built.read(spark).orderBy("session").collect()
    assert [r.report__value for r in out] == [None, 50.0, 50.0] and [r.daily__close__return for r in out] == [None, None, None]


def test_sequential_experiment(spark, tmp_path):
    r = random.Random(4)
    x = {(s, i): r.random() for s in "ABCDEFGH" for i in range(60)}
    p = panel_of(spark, {"open": lambda s, i: 10.0, "close": lambda s, i: 10.0 + x[s, i - 2] if i > 1 else 10.0, "x": lambda s, i: x[s, i], "member": lambda s, i: True}, 60, tuple("ABCDEFGH"))
    n = contracts.SignalNode
    plan = contracts.SignalPlanSpec((n("raw", "raw"), n("z", "daily_zscore", ("raw",))), "z")
    build = lambda **more: experiment.build_sequential(spark, str(tmp_path), "s@1", p, ["x"], horizon=2, refit=15, mature=28, profile=models.TrainingProfile(rounds=8, depth=3), minimum_pairs=5, **more)
    scored, daily, derived = build(plan=plan)
    assert scored.read(spark).select("fold").distinct().count() == 3
    ic = {k: [r.ic for r in daily.read(spark).orderBy("session").collect() if r.ic is not None and r.signal == k] for k in ("raw", "derived")}
    assert all(sum(x) / len(x) > 0.8 for x in ic.values()) and ic["raw"] == pytest.approx(ic["derived"])
    z = derived.read(spark).groupBy("session").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("d")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.d - 1) < 1e-9 for r in z)
    # models are saved with receipts; what was built isn't built again
    folder = next(str(f) for f in tmp_path.iterdir() if f.name.startswith("folds-"))
    saved = models.load_folds(spark, folder, ["fold1", "fold2", "fold3"])
    first = scored.read(spark).filter("fold = 'fold2' and valid").select("security_id", "session", "score").collect()
    again = {(r.security_id, r.session): r.score for r in models.predict(saved["fold2"][0], p, ["x"]).collect()}
    assert first and all(again[r.security_id, r.session] == r.score for r in first) and saved["fold2"][1]["features"] == ["x"]
    assert [b.reused for b in build()] == [True, False] and [b.reused for b in build(plan=plan)] == [True] * 3
    with pytest.raises(panel.PanelError):
        models.load_folds(spark, folder, ["fold9"])
    outcomes = experiment.build_evaluation_labels(spark, str(tmp_path), "s@1", p, 2)
    frozen = experiment.freeze_evaluation(spark, str(tmp_path), {"raw": scored, "derived": derived}, outcomes)
    assert {r.signal for r in frozen.read(spark).collect()} == {"raw", "derived"} and experiment.freeze_evaluation(spark, str(tmp_path), {"raw": scored, "derived": derived}, outcomes).reused


def test_signal_plans(spark):
    day = D(2024, 1, 1)
    make = lambda xs: spark.createDataFrame([(k, day, v) for k, v in xs.items()], "security_id string, session date, score double")
    a, b = make({"A": 1.0, "B": 3.0, "C": 5.0}), make({"A": 2.0, "B": 0.0})
    n = contracts.SignalNode
    plan = lambda join: contracts.SignalPlanSpec((n("a", "raw"), n("b", "raw"), n("za", "daily_zscore", ("a",)), n("mix", "weighted_combine", ("za", "b"), (0.5, 0.5))), "mix", join)
    inner = column(signal_plan.run_plan(plan("inner_on_security_session"), {"a": a, "b": b}), "score")
    assert inner == [0.5, 0.5]  # z-scores of the joined rows, -1 and 1
    outer = signal_plan.run_plan(plan("outer_on_security_session"), {"a": a, "b": b})
    assert column(outer, "invalid_reason") == [None, None, "MISSING_INPUT"]
    with pytest.raises(panel.PanelError):
        signal_plan.run_plan(plan("inner_on_security_session"), {"a": a})
    signal_plan.check_parents(outer, {"a": a})
    with pytest.raises(panel.PanelError):
        signal_plan.check_parents(outer, {"b": b.filter("security_id = 'A'")})
    outcome = a.withColumnRenamed("score", "outcome")
    out = {(r["sample"], r.signal): r.ic for r in signal_plan.compare({"x": a.withColumn("valid", F.lit(True)), "y": b.withColumn("valid", F.lit(True))}, outcome, minimum=2).collect()}
    assert out == {("native", "x"): pytest.approx(1.0), ("native", "y"): pytest.approx(-1.0), ("common", "x"): pytest.approx(1.0), ("common", "y"): pytest.approx(-1.0)}


def test_saved_models(spark, tmp_path):
    p = panel_of(spark, {"x": lambda s, i: float(i % 10), "label": lambda s, i: float(i % 10 > 4), "member": lambda s, i: True}, 50)
    model = models.fit(p, ["x"], "label", models.TrainingProfile(rounds=2, depth=2))
    models.save_model(model, ["x"], str(tmp_path / "m"))
    assert column(models.predict_saved(spark, str(tmp_path / "m"), p, ["x"]), "score") == column(models.predict(model, p, ["x"]), "score")
    with pytest.raises(panel.PanelError):
        models.predict_saved(spark, str(tmp_path / "m"), p, ["x", "label"])


def test_configurations():
    pytest.importorskip("yaml")
    text = "snapshot: s@1\nfeatures: [ret1, KMID]\nlabel: {horizon: 3}\nschedule: {refit: 20, mature: 100}\ntraining: {rounds: 7}"
    c = config.compile_config(text)
    assert (c.features, c.label.horizon, c.refit, c.profile.rounds) == (("ret1", "KMID"), 3, 20, 7) and c.identity != config.compile_config(text.replace("7", "8")).identity
    for bad in (text.replace("ret1", "nope"), text.replace("s@1", "latest"), text + "\nmore: 1", text.replace("horizon", "horizons"), text.replace("horizon: 3", "entry: close")):
        with pytest.raises((documents.DocumentError, facts.SourceError, labels.LabelError)):
            config.compile_config(bad)


# streams


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    e.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(s, "1 day", late="60 days").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.window_start, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("tumbled")) == key(windows.tumbling(e, "1 day"))


def test_ingest_keeps_every_version(spark, tmp_path):
    schema = "security_id string, session date, value double, usable_from timestamp, revision_id string"
    rows = [("A", D(2024, 1, 1), 1.0, dt.datetime(2024, 1, 1, 12), "r1"), ("A", D(2024, 1, 1), 2.0, dt.datetime(2024, 1, 3, 12), "r2")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        windows.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["security_id", "session"]).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == i + 1
    versions = spark.read.parquet(str(tmp_path / "out"))
    known = lambda day: windows.as_known(versions, ["security_id", "session"], f"2024-01-0{day} 20:00:00").collect()
    assert [known(d)[0].value for d in (2, 3)] == [1.0, 2.0]


def test_registered_folds_reach_the_last_session(spark, monkeypatch):
    from sightline.plans import catalog, registry

    got = []
    monkeypatch.setattr(registry.models, "run_folds", lambda rows, folds, features, label, *more: got.append((folds, features, more)) or rows)
    rows = registry.QUERIES["fold_fit_predict"](spark, "/root/testdata/sf0.001")
    days = [r.session for r in rows.select("session").distinct().orderBy("session").collect()]
    folds, features, more = got[0]
    assert features == catalog.stock_catalog()[1] and not more
    at = [(days.index(str(f["train_to"])), days.index(str(f["predict_from"])), days.index(str(f["predict_to"]))) for f in folds]
    assert all(to + 3 < first for to, first, _ in at)
    assert [p for _, first, last in at for p in range(first, last + 1)] == list(range(33, len(days)))


# the entry


def test_entry_without_what_the_text_queries_need():
    hide = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['{0}'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = lambda name: subprocess.run([sys.executable, "-c", hide.format(name)], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True).stdout.split()
    want = [str(len(registry.QUERIES)), str(len(registry.ORACLE))]
    assert run("sightline.llm.queries") == run("xxhash") == run("corpus_pipeline") == want
