from datetime import timedelta

import pytest
from helpers import START, elo, frame, history, season, table
from pyspark.sql import functions as F

from touchline.functions import names as N
from touchline.operators import features as Fe
from touchline.operators import history as H
from touchline.operators import ratings as R
from touchline.operators import standings as S

CASES = [dict(seed=1, n=120), dict(seed=2, n=200, hot=0.9, crowd=25), dict(seed=3, n=40, teams=3, crowd=12)]


@pytest.mark.parametrize("case", CASES)
def test_last_n_split_rest_match_brute_force(spark, case):
    rows = season(**case)
    p = frame(spark, rows)
    got = {r["fixture_id"]: r for r in Fe.with_families(p, p, None, ("form", "goals", "split", "rest")).collect()}
    for fid, c, _s, h, a, k, *_ in rows:
        g = got[fid]
        for side, team in (("home", h), ("away", a)):
            past = history(rows, c, team, k)
            for n in (3, 5, 10):
                last = past[:n] if len(past) >= n else None
                assert g[f"{side}_wins_last_{n}"] == (None if last is None else sum(x[2] > x[3] for x in last))
                assert g[f"{side}_losses_last_{n}"] == (None if last is None else sum(x[2] < x[3] for x in last))
                if n > 3:
                    assert g[f"{side}_goals_for_last_{n}"] == (None if last is None else sum(x[2] for x in last))
                    pts = None if last is None else sum(3 if x[2] > x[3] else 1 if x[2] == x[3] else 0 for x in last)
                    assert g[f"{side}_points_last_{n}"] == pts
            own = history(rows, c, team, k, venue=side == "home")
            want = sum(x[3] for x in own[:5]) if len(own) >= 5 else None
            assert g[f"{side}_{side}_goals_against_last_5"] == want
            assert g[f"{side}_rest_days"] == ((k - past[0][0]).days if past else None)


@pytest.mark.parametrize("case", CASES)
def test_table_positions_match_brute_force(spark, case):
    rows = season(**case)
    p = frame(spark, rows)
    got = {r["fixture_id"]: r for r in Fe.with_families(p, p, None, ("table",)).collect()}
    for fid, c, _s, h, a, k, *_ in rows:
        t = table(rows, c, k)
        for side, team in (("home", h), ("away", a)):
            want = t.get(team, (None, None, None))
            g = got[fid]
            assert (g[f"{side}_table_position"], g[f"{side}_points_table"], g[f"{side}_goal_difference_table"]) == want
        both = h in t and a in t
        assert got[fid]["table_points_difference"] == (t[h][1] - t[a][1] if both else None)


@pytest.mark.parametrize("batch", ["10000", "7"])
@pytest.mark.parametrize("case", CASES[:2])
def test_elo_carries_ratings_over_batches(spark, case, batch):
    rows = season(**case)
    p = frame(spark, rows)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    states = R.rating_states(p).cache()
    states.count()
    spark.conf.set(key, before)
    found = H.as_of(H.probes(p), [states], N.TEAM, ["elo"])
    got = {(r["team_id"], r["at"]): r["elo"]["rating"] if r["elo"] else 1500.0 for r in found.collect()}
    for fid, (eh, ea) in elo(rows).items():
        x = rows[fid - 1]
        at = int(x[5].timestamp()) * 1_000_000
        assert got[(x[3], at)] == pytest.approx(eh, abs=1e-9)
        assert got[(x[4], at)] == pytest.approx(ea, abs=1e-9)


def test_as_of_strict_and_inclusive(spark):
    day = H.BLOCK_DAYS * 86_400_000_000
    states = spark.createDataFrame([(1, 10, "a"), (1, 3 * day, "b"), (1, 9 * day, "c"), (2, 5, "z")], "k long, at long, v string")
    states = states.select("k", "at", F.struct("v").alias("s"))
    probes = spark.createDataFrame([(1, 10), (1, 11), (1, 3 * day), (1, 7 * day), (1, 20 * day), (2, 1), (3, 9)], "k long, at long")
    pick = lambda strict: {(r["k"], r["at"]): r["s"]["v"] if r["s"] else None for r in H.as_of(probes, [states], ["k"], ["s"], strict).collect()}
    assert pick(True) == {(1, 10): None, (1, 11): "a", (1, 3 * day): "a", (1, 7 * day): "b", (1, 20 * day): "c", (2, 1): None, (3, 9): None}
    assert pick(False)[(1, 10)] == "a" and pick(False)[(1, 3 * day)] == "b"


def _features(spark, rows, targets):
    p = frame(spark, rows)
    stats = spark.createDataFrame([(100, 1, 2020, (START + timedelta(days=50)).date(), 1.5, None)], "team_id long, competition_id long, season_id long, as_of_date date, xg double, xga double")
    return Fe.build_examples(p.where(F.col("fixture_id").isin(targets)), p, stats)


def test_future_and_simultaneous_rows_change_nothing(spark):
    rows = season(4, 90)
    cut = START + timedelta(days=200)
    targets = [x[0] for x in rows if x[5] <= cut]
    later = [(5000 + i, 1, 2020, 100 + i % 5, 105, cut + timedelta(hours=1 + i), "finished", 4, 0) for i in range(20)]
    same = [(6000 + i, 1, 2020, 103, 104, x[5], "finished", 4, 0) for i, x in enumerate(rows) if x[5] == max(y[5] for y in rows if y[5] <= cut)]
    base = _features(spark, rows, targets).cache()
    # Later rows change nothing for any target.
    assert base.exceptAll(_features(spark, rows + later, targets)).count() == 0
    # Rows at the very instant of the last target change nothing for the targets at that instant.
    last = [x[0] for x in rows if x[5] == max(y[5] for y in rows if y[5] <= cut)]
    keep = base.where(F.col("fixture_id").isin(last))
    assert keep.exceptAll(_features(spark, rows + same, last)).count() == 0


def test_input_order_does_not_matter(spark):
    rows = season(5, 60)
    ids = [x[0] for x in rows]
    assert _features(spark, rows, ids).exceptAll(_features(spark, rows[::-1], ids)).count() == 0


def test_unplayed_targets_use_history_only(spark):
    rows = season(6, 80, leagues=1)
    after = START + timedelta(days=400)
    target = frame(spark, [(9001, 1, 2020, 100, 101, after, "scheduled", None, None), (9002, 1, 2020, 199, 198, after, "scheduled", None, None)])
    p = frame(spark, rows)
    got = {r["fixture_id"]: r for r in Fe.with_families(target, p, None, ("form", "table", "elo", "h2h")).collect()}
    past = history(rows, 1, 100, after)
    assert got[9001]["home_wins_last_10"] == sum(x[2] > x[3] for x in past[:10])
    assert got[9001]["home_table_position"] == table(rows, 1, after)[100][0]
    assert got[9002]["home_table_position"] is None and got[9002]["home_elo_pre_match"] == 1500.0
    assert got[9002]["h2h_sample_size"] == 0 and got[9002]["h2h_home_wins"] is None


def test_table_as_of_orders_ties(spark):
    rows = season(7, 50, leagues=1)
    at = START + timedelta(days=150)
    got = {r["team_id"]: r["position"] for r in S.table_as_of(frame(spark, rows), str(at)[:19]).collect()}
    assert got == {t: v[0] for t, v in table(rows, 1, at).items()}


@pytest.mark.parametrize("size", [1, 7, 40])
def test_crowded_stretches_split_into_blocks_of_rows(spark, size):
    """Many matches inside one month: blocks follow the rows, and positions stay right in every block."""
    rows = [(*r[:5], START + timedelta(hours=i // 3), *r[6:]) for i, r in enumerate(season(11, 90, leagues=1))]
    p = frame(spark, rows)
    got = {(r["team_id"], r["at"]): (r["position"], r["points"]) for r in S.positions(p, H.probes(p), size).collect()}
    micro = lambda t: int(t.timestamp() * 1_000_000)
    for _f, c, _s, h, a, k, *_ in rows:
        t = table(rows, c, k)
        for team in (h, a):
            assert got.get((team, micro(k))) == (t[team][:2] if team in t else None)
    blocks = S.row_blocks(H.probes(p), size).select("_block").distinct().count()
    assert blocks > 1 and S.row_blocks(H.probes(p), 10**6).select("_block").distinct().count() == 1


def test_builds_and_scores_read_only_what_their_targets_need(spark, tmp_path):
    from touchline.plans import dataset as Ds
    from touchline.plans import scoring as Sc

    rows = season(12, 160, leagues=4)
    after = START + timedelta(days=400)
    rows += [(9001, 2, 2020, 200, 201, after, "scheduled", None, None), (9002, 3, 2020, 300, 301, after, "scheduled", None, None)]
    frame(spark, rows).write.partitionBy("competition_id").parquet(str(tmp_path / "m"))
    m = spark.read.parquet(str(tmp_path / "m")).withColumn("competition_id", F.col("competition_id").cast("long"))
    stats = spark.createDataFrame([(c * 100, c, 2020, START.date(), 1.5, None) for c in range(1, 5)], "team_id long, competition_id long, season_id long, as_of_date date, xg double, xga double")
    asked = spark.createDataFrame([(9001,)], "fixture_id long")
    got = Sc.scoring_features(m, stats, asked)
    whole = Sc.scoring_features(m, stats).where("fixture_id = 9001")
    assert got.exceptAll(whole).count() == 0 and got.count() == 1
    targets = m.where("fixture_id = 9001")
    kept = Fe.in_leagues(H.finished(m), targets)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert {r["competition_id"] for r in kept.collect()} == {2} and "PartitionFilters: [" in plan and "IN (2)" in plan.replace("= 2", "IN (2)")
    pairs = {frozenset((r["home_team_id"], r["away_team_id"])) for r in Fe.of_pairs(H.finished(m), targets).collect()}
    assert pairs <= {frozenset((200, 201))}
    part = Ds.dataset_rows(m, stats, [1, 2], [2020], cutoff="2100-01-01 00:00:00")
    every = Ds.dataset_rows(m, stats, [1, 2, 3, 4], [2020], cutoff="2100-01-01 00:00:00").where("competition_id < 3")
    assert part.exceptAll(every).count() == 0 and part.count() == every.count() > 0


def test_target_rows_are_dealt_once_for_both_sides(spark):
    """A build joins both teams' columns where the rows lie: no shuffle by a team."""
    from touchline.plans import dataset as Ds
    from touchline.session import co_partitioned

    m = frame(spark, season(12, 60, leagues=2))
    stats = spark.createDataFrame([(100, 1, 2020, START.date(), 1.5, None)], "team_id long, competition_id long, season_id long, as_of_date date, xg double, xga double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with co_partitioned(spark):
            rows = Ds.dataset_rows(m, stats, [1, 2], [2020], cutoff="2100-01-01 00:00:00")
            plan = rows._jdf.queryExecution().executedPlan().toString()
            got = rows.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == H.finished(m).count() and "_team_id" in plan
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "_team_id" in x], plan
