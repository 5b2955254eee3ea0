from datetime import datetime, timedelta

import pytest
from helpers import START, elo, frame, season
from pyspark.sql import functions as F

from touchline import session as Se
from touchline.functions import names as N
from touchline.operators import history as H
from touchline.operators import upsert as U
from touchline.plans import dataset as Ds
from touchline.plans import models as Mo
from touchline.sources import datasets as D
from touchline.sources import payloads as P
from touchline.sources import runs as R
from touchline.streaming import elo as SE
from touchline.streaming import ingest as SI


def stats(spark):
    return spark.createDataFrame([(100, 1, 2020, START.date(), 1.5, 0.5)], "team_id long, competition_id long, season_id long, as_of_date date, xg double, xga double")


def test_dataset_round_trip_and_tampering(spark, tmp_path):
    m = frame(spark, season(11, 60))
    path = str(tmp_path / "d")
    manifest = Ds.build_dataset(m, stats(spark), path, "v1", [1, 2], [2020], end="2020-12-31 00:00:00").first()
    df = D.read_dataset(spark, path, "v1")
    assert df.columns == N.DATASET_COLUMNS and df.count() == manifest["row_count"]
    with pytest.raises(D.DatasetError, match="version"):
        D.read_dataset(spark, path, "v2")
    df.limit(1).write.mode("append").partitionBy("competition_id", "season_id").parquet(f"{path}/rows")
    with pytest.raises(D.DatasetError, match="digest"):
        D.read_dataset(spark, path)


def test_build_parameters_are_checked(spark):
    m = frame(spark, season(12, 20))
    with pytest.raises(ValueError, match="before the end"):
        Ds.resolve_cutoff("2020-01-01 00:00:00", "2020-06-01 00:00:00")
    with pytest.raises(ValueError, match="unknown competition_id"):
        Ds.dataset_rows(m, stats(spark), [1, 99], [2020])
    with pytest.raises(ValueError, match="must both be given"):
        Ds.dataset_rows(m, stats(spark), [], [2020])


def test_strict_csv_rejects_bad_cells(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text(",".join(N.DATASET_COLUMNS) + "\n" + ",".join(["x"] * len(N.DATASET_COLUMNS)) + "\n")
    with pytest.raises(Exception):  # noqa: B017
        D.read_csv(spark, str(path)).collect()


def test_upsert_is_idempotent_and_keeps_results(spark):
    cols = "external_id long, home_team_id long, kickoff_time timestamp, status string, home_goals long, away_goals long, finished_at timestamp, synced_at timestamp"
    old = spark.createDataFrame([(1, 7, START, "scheduled", None, None, None, None), (2, 7, START, "finished", 1, 1, START, None)], cols)
    new = spark.createDataFrame([(1, 8, START, "finished", 3, None, 1), (2, 8, START, "finished", 9, 9, 2), (3, 8, START, "scheduled", None, None, 3)], "external_id long, home_team_id long, kickoff_time timestamp, status string, home_goals long, away_goals long, landing long")
    now = "2021-01-01 00:00:00"
    once = U.upsert_matches(old, new, now).drop("_outcome")
    twice = U.upsert_matches(once, new, now).drop("_outcome")
    assert once.exceptAll(twice).count() == 0 and twice.count() == 3
    r = {x["external_id"]: x for x in once.collect()}
    assert (r[1]["home_team_id"], r[1]["home_goals"], r[1]["away_goals"]) == (7, 3, 0)
    assert (r[2]["home_goals"], r[3]["home_team_id"], r[3]["status"]) == (1, 8, "scheduled")


def test_insert_only_and_registry_conflicts(spark, tmp_path):
    t = spark.createDataFrame([(1,), (2,)], "id long")
    assert U.insert_only(t, spark.createDataFrame([(3,)], "id long"), ["id"]).count() == 1
    for clash in ([(2,)], [(5,), (5,)]):
        with pytest.raises(ValueError):
            U.insert_only(t, spark.createDataFrame(clash, "id long"), ["id"])
    reg = R.ModelRegistry(spark, str(tmp_path / "r"))
    model = Mo.EloModel({"HFA": 65.0})
    reg.save(model, "1", "d", "c", "n", 1, ["a"])
    with pytest.raises(ValueError, match="already registered"):
        reg.save(model, "1", "d", "c", "n", 1, ["a"])
    assert reg.load("elo_baseline", "1")["hyper"] == {"HFA": 65.0}
    with pytest.raises(KeyError):
        reg.load("elo_baseline", "2")


def test_run_identity_depends_on_every_part():
    base = ("d", {"gap_days": 1}, "poisson", "v1", 42)
    ids = {R.run_id(*base), R.run_id("e", *base[1:]), R.run_id(*base[:4], 43), R.run_id("d", {"gap_days": 2}, *base[2:])}
    assert len(ids) == 4 and all(len(i) == 16 for i in ids)


def test_payload_tolerates_broken_pages(spark):
    pages = spark.createDataFrame([("not json",), ('{"response": null}',), ('{"response": [{"league": {"id": "9", "name": "A"}}, {"league": {"name": "B"}}]}',)], "body string")
    good, bad = P.split_rejects(P.competitions(pages))
    assert [r["external_id"] for r in good.collect()] == [9] and bad.count() == 1


MATCH_COLS = "external_id long, kickoff_time timestamp, status string, home_goals long, away_goals long, finished_at timestamp, synced_at timestamp"
UPDATE_COLS = "external_id long, kickoff_time timestamp, status string, home_goals long, away_goals long, landing long"


def test_a_replayed_batch_changes_and_counts_nothing_twice(spark, tmp_path):
    first = spark.createDataFrame([(1, START, "scheduled", None, None, None, None)], MATCH_COLS)
    t = SI.BucketedTable(spark, str(tmp_path / "t"), first.schema, "external_id", 4)
    t.create(first)
    batch = spark.createDataFrame([(1, START, "finished", 2, 1, 1), (2, START, "scheduled", None, None, 2)], UPDATE_COLS)
    apply = SI.apply_matches("2021-01-01 00:00:00")
    for _ in range(3):
        out = {r["external_id"]: r["_outcome"] for r in t.merge(batch, 0, apply).collect()}
        assert out == {1: "updated", 2: "inserted"}
    assert {(r["external_id"], r["status"], r["batch_id"]) for r in t.read().collect()} == {(1, "finished", 0), (2, "scheduled", 0)}
    with pytest.raises(Exception, match="already exists"):
        t.create(first)


def test_a_batch_writes_only_the_buckets_of_its_keys(spark, tmp_path):
    first = spark.createDataFrame([(i, START, "scheduled", None, None, None, None) for i in range(100)], MATCH_COLS)
    t = SI.BucketedTable(spark, str(tmp_path / "t"), first.schema, "external_id", 16)
    t.create(first)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t/rows").glob("_bucket=*/*.parquet")}
    batch = spark.createDataFrame([(7, START, "finished", 2, 1, 1), (1000, START, "scheduled", None, None, 2)], UPDATE_COLS)
    src = str(tmp_path / "in")
    batch.coalesce(1).write.parquet(src)
    counters = str(tmp_path / "counts")
    SI.upsert_stream(SI.landed(spark, src, batch.schema), t, counters, str(tmp_path / "c"), SI.apply_matches("2021-01-01 00:00:00")).awaitTermination()
    same = [f for f, at in before.items() if f.exists() and f.stat().st_mtime_ns == at]
    touched = {f"_bucket={b}" for b in t.touched(batch)}
    assert {f.parent.name for f in before} - {f.parent.name for f in same} <= touched and len(touched) <= 2
    now = {r["external_id"]: r for r in t.read().collect()}
    assert len(now) == 101 and now[7]["status"] == "finished" and now[8]["status"] == "scheduled"
    assert [i for i, r in sorted(now.items()) if r["batch_id"] is not None] == [7, 1000]
    assert [tuple(r) for r in spark.read.parquet(counters).select("batch_id", "inserted", "updated").collect()] == [(0, 1, 1)]


def test_many_waiting_results_of_one_season(spark, tmp_path):
    """All rows arrive before any is due; a second input releases them in order."""
    n = 100_000
    rows = spark.range(n).selectExpr("id as fixture_id", "1L as competition_id", "2020L as season_id", "id % 40 as home_team_id", "40 + id % 37 as away_team_id",
                                     f"timestamp_seconds(1600000000 + (id * 7919 % 500) * 60) as kickoff", "id % 4 as home_goals", "id % 3 as away_goals")
    src = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(src)
    last = rows.limit(1).withColumn("kickoff", F.lit("2022-01-01").cast("timestamp")).withColumn("fixture_id", F.lit(10**9))
    last.coalesce(1).write.mode("append").parquet(src)
    stream = SE.rating_stream(SI.landed(spark, src, rows.schema, 1))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = {r["fixture_id"]: (r["home_elo"], r["away_elo"]) for r in spark.read.parquet(str(tmp_path / "o")).where("not late").collect()}
    games = [(r["fixture_id"], 1, 2020, r["home_team_id"], r["away_team_id"], r["kickoff"], "finished", r["home_goals"], r["away_goals"]) for r in rows.collect()]
    want = elo(games)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in range(0, n, 997))


def test_rating_stream_equals_batch_and_reports_late_rows(spark, tmp_path):
    rows = sorted(season(13, 60, leagues=1), key=lambda x: x[5])
    cols = ["fixture_id", *N.LEAGUE, "home_team_id", "away_team_id", "kickoff", "home_goals", "away_goals"]
    src = str(tmp_path / "in")
    late = [(9999, 1, 2020, 100, 101, START - timedelta(days=5), "finished", 5, 0)]
    end = [(9000, 1, 2020, 100, 101, START + timedelta(days=900), "finished", 1, 0)]
    for part in (rows[:30], rows[30:], end, late, [(9001, *end[0][1:5], START + timedelta(days=1000), *end[0][6:])]):
        frame(spark, part).select(*cols).coalesce(1).write.mode("append").parquet(src)
    schema = frame(spark, rows).select(*cols).schema
    q = SE.rating_stream(SI.landed(spark, src, schema, 1)).writeStream.format("memory").queryName("ratings_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = {r["fixture_id"]: r for r in spark.table("ratings_out").collect()}
    for fid, (h, a) in elo(rows).items():
        assert (got[fid]["home_elo"], got[fid]["away_elo"]) == pytest.approx((h, a))
    assert got.get(9999) is None or got[9999]["late"]


def test_scratch_folder_comes_from_the_session(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Ctx:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class Fake:
        conf, sparkContext = Conf(), Ctx()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        Se.scratch_root(Fake())
    assert Se.scratch_path(spark, "x") != Se.scratch_path(spark, "x")


def test_poisson_heads_have_zero_gradient(spark):
    import numpy as np

    r = np.random.default_rng(1)
    rows = []
    for i in range(400):
        vals = {c: float(r.normal()) for c in N.FEATURES}
        lam = np.exp(0.2 + 0.3 * vals["home_elo_pre_match"])
        rows.append((*[vals[c] for c in N.FEATURES], int(r.poisson(lam)), int(r.poisson(1.0))))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in N.FEATURES) + ", home_goals long, away_goals long")
    model = Mo.PoissonTrainer(l2=0.1).fit(df)
    pdf = df.toPandas()
    x = pdf[N.HEAD["home"]].to_numpy(dtype="float32").astype("float64")
    w = model.heads["home"].coefficients
    lam = np.exp(x @ w + model.heads["home"].intercept)
    y = pdf["home_goals"].to_numpy()
    assert np.abs((lam - y) @ x / len(y) + 0.1 * w).max() < 1e-5 and abs((lam - y).mean()) < 1e-5
    out = model.transform(df.withColumn("home_rest_days", F.lit(None).cast("double")))
    assert out.where(F.col("p_home_win").isNull()).count() == 0


def test_elo_baseline_is_symmetric_without_advantage(spark):
    df = spark.createDataFrame([(1500.0, 1600.0), (1600.0, 1500.0)], "home_elo_pre_match double, away_elo_pre_match double")
    m = Mo.EloModel({"beta_0_home": 0.2, "beta_0_away": 0.2, "HFA": 0.0, "beta_1": 0.002, "max_goals": 10})
    a, b = m.transform(df).collect()
    assert a["p_home_win"] == pytest.approx(b["p_away_win"]) and a["p_draw"] == pytest.approx(b["p_draw"])


def test_unknown_trainer_is_refused():
    with pytest.raises(ValueError, match="unknown model"):
        Mo.trainer("crystal ball")


def test_finished_needs_both_goals(spark):
    rows = [(1, 1, 2020, 1, 2, START, "finished", 1, None), (2, 1, 2020, 1, 2, START, "scheduled", 1, 1), (3, 1, 2020, 1, 2, START, "finished", 1, 1)]
    assert [r["fixture_id"] for r in H.finished(frame(spark, rows)).collect()] == [3]


def test_updates_of_one_match_apply_in_landing_order(spark):
    cols = "external_id long, kickoff_time timestamp, status string, home_goals long, away_goals long"
    old = spark.createDataFrame([(1, START, "scheduled", None, None, None, None)], cols + ", finished_at timestamp, synced_at timestamp")
    moved = START - timedelta(days=7)
    new = spark.createDataFrame([(1, START, "scheduled", None, None, 1), (1, moved, "finished", 2, 1, 2), (1, moved, "finished", 5, 5, 3)], cols + ", landing long")
    r = U.upsert_matches(old, new, "2021-01-01 00:00:00").first()
    assert (r["status"], r["home_goals"], r["away_goals"]) == ("finished", 2, 1)


def test_filled_columns_keep_the_last_known_value(spark):
    old = spark.createDataFrame([(1, "a", 10)], "external_id long, name string, size long")
    new = spark.createDataFrame([(1, "b", 20, 1), (1, "a", None, 2), (2, "z", 5, 3), (2, "y", None, 4)], "external_id long, name string, size long, landing long")
    got = {r["external_id"]: (r["name"], r["size"]) for r in U.merge_upsert(old, new, ["external_id"], {"name": "overwrite", "size": "fill"}, "landing").collect()}
    assert got == {1: ("a", 20), 2: ("y", 5)}


def test_new_rows_get_the_next_ids_in_key_order(spark):
    rows = [(k, k if k < 50 else None) for k in range(200)]
    got = {r["external_id"]: r["id"] for r in U.assign_ids(spark.createDataFrame(rows, "external_id long, id long").repartition(7)).collect()}
    assert got == {k: k for k in range(200)}
    assert U.assign_ids(spark.createDataFrame([(1, 1)], "external_id long, id long")).count() == 1


def test_only_a_missing_table_reads_as_empty(spark, tmp_path):
    like = spark.createDataFrame([(1,)], "id long")
    assert R.read_or_empty(spark, str(tmp_path / "none"), like).count() == 0
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        R.read_or_empty(spark, str(tmp_path / "empty"), like)


def test_registered_models_load_and_score_as_before(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(2)
    rows = [(i, *[float(r.normal()) for _ in N.FEATURES], int(r.poisson(1.4)), int(r.poisson(1.1))) for i in range(120)]
    df = spark.createDataFrame(rows, "fixture_id long, " + ", ".join(f"{c} double" for c in N.FEATURES) + ", home_goals long, away_goals long")
    df = df.withColumns({"home_win": (F.col("home_goals") > F.col("away_goals")).cast("int"), "draw": (F.col("home_goals") == F.col("away_goals")).cast("int"), "away_win": (F.col("home_goals") < F.col("away_goals")).cast("int")})
    gappy = df.withColumn("home_rest_days", F.lit(None).cast("double"))
    reg = R.ModelRegistry(spark, str(tmp_path / "r"))
    for trainer in (Mo.trainer("poisson"), Mo.trainer("gradient_boosting", rounds=2, leaves=4), Mo.trainer("elo_baseline", HFA=70.0, beta_1=0.002, K=25)):
        model = trainer.fit(df)
        reg.save(model, "1", "d", "c", "n", 1, N.FEATURES)
        again = reg.load_model(model.name, "1")
        pick = lambda m: [v for x in sorted(m.transform(gappy).collect(), key=lambda x: x["fixture_id"]) for v in (x["p_home_win"], x["p_draw"])]  # noqa: E731, B023
        assert pick(model) == pytest.approx(pick(again))
    assert reg.load("elo_baseline", "1")["hyper"]["HFA"] == 70.0


def test_unknown_keys_are_counted_in_the_error(spark):
    from touchline.operators.reads import require_keys

    wanted, known = (spark.range(n).withColumnRenamed("id", "k") for n in (40, 5))
    with pytest.raises(ValueError, match="and 15 more"):
        require_keys(wanted, known, "k")


def test_a_scope_removes_what_was_written_inside(spark):
    import glob

    with Se.scratch_scope(spark) as root:
        assert Se.materialise(spark.range(5), "x").count() == 5
        assert glob.glob(root.removeprefix("file:") + "/x-*")
    assert not glob.glob(root.removeprefix("file:")) and not Se.scratch_path(spark, "y").startswith(root)


def test_another_session_zone_is_refused(spark):
    key = "spark.sql.session.timeZone"
    spark.conf.set(key, "Asia/Tokyo")
    try:
        with pytest.raises(RuntimeError, match="time zone"):
            Se.require_utc(spark)
    finally:
        spark.conf.set(key, "UTC")
    Se.require_utc(spark)


def test_a_merge_into_a_bucketed_target_moves_only_the_updates(spark, tmp_path):
    from touchline.operators import upsert as U

    rows = spark.createDataFrame([(i, START, "scheduled", None, None, None, None) for i in range(60)], MATCH_COLS)
    target = U.bucketed(rows, ["external_id"], 4, str(tmp_path / "b"))
    batch = spark.createDataFrame([(7, START, "finished", 2, 1, 1), (1000, START, "scheduled", None, None, 2), (7, START, "finished", 5, 5, 2)], UPDATE_COLS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = U.upsert_matches(target, batch, "2021-01-01 00:00:00")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r["external_id"]: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Join") == 1, plan
    assert len(got) == 61 and (got[7]["home_goals"], got[7]["_outcome"], got[1000]["_outcome"], got[3]["_outcome"]) == (2, "updated", "inserted", "untouched")


def test_bootstrap_goes_on_after_a_bad_league(spark):
    """One league's row is broken: its teams, matches and totals fail or are skipped, the other league's come in."""
    from touchline.plans import ingest as In

    good = spark.createDataFrame([(1, "one", 1)], "external_id long, name string, landing long")
    listed = spark.createDataFrame([(1, 2020, 2020, True, 1), (2, 2020, 2020, True, 2)], "competition_external_id long, external_id long, year long, is_current boolean, landing long")
    teams = spark.createDataFrame([(t, f"t{t}", c, 2020, t) for c, t in ((1, 10), (1, 11), (2, 20), (2, 21))], "external_id long, name string, competition_external_id long, season_external_id long, landing long")
    cols = "external_id long, competition_external_id long, season_year long, home_team_external_id long, away_team_external_id long, kickoff_time timestamp, status string, home_goals long, away_goals long, landing long"
    games = spark.createDataFrame([(100, 1, 2020, 10, 11, START, "finished", 1, 0, 1), (200, 2, 2020, 20, 21, START, "finished", 1, 0, 2)], cols)
    totals = spark.createDataFrame([(10, 1, 2020, 5), (20, 2, 2020, 5)], "team_external_id long, competition_external_id long, season_external_id long, fixtures_played long")
    totals = totals.withColumn("as_of_date", F.lit("2020-01-01").cast("date"))
    empty = {
        "competitions": "external_id long, id long, name string", "seasons": "competition_id long, year long, external_id long, id long, is_current boolean",
        "teams": "external_id long, id long, name string", "team_statistics": "team_id long, competition_id long, season_id long, as_of_date date, fixtures_played long",
        "matches": "external_id long, competition_id long, season_id long, home_team_id long, away_team_id long, " + MATCH_COLS.replace("external_id long, ", ""),
    }
    stored = {k: spark.createDataFrame([], v) for k, v in empty.items()}
    bad = good.withColumn("external_id", F.lit(None).cast("long"))
    staged = {"competitions": (good, bad), "seasons": (listed, listed.limit(0)), "teams": (teams, teams.limit(0)), "matches": (games, games.limit(0)), "team_statistics": (totals, totals.limit(0))}
    tables, report = In.bootstrap(staged, stored, 2, 2020, "2021-05-01 00:00:00")
    got = {r["job"]: (r["received"], r["inserted"], r["skipped"], r["failed"]) for r in report.collect()}
    assert got["competitions_seasons"] == (4, 2, 1, 1) and got["teams"] == (4, 2, 0, 2)
    assert got["matches"][2:] == (1, 0) and got["team_statistics"] == (2, 1, 1, 0)
    assert {r["external_id"] for r in tables["matches"].collect()} == {100} and tables["team_statistics"].first()["as_of_date"].isoformat() == "2021-05-01"
    again, second = In.bootstrap(staged, {k: v.drop("_outcome") for k, v in tables.items()}, 2, 2020, "2021-05-01 00:00:00")
    done = {r["job"]: (r["inserted"], r["updated"]) for r in second.collect()}
    assert done["full_bootstrap"][0] == 0 and done["team_statistics"] == (0, 1)
    assert {r["id"] for r in again["teams"].collect()} == {r["id"] for r in tables["teams"].collect()}


def test_landed_rows_are_made_once(spark):
    """Rows landed in three periods are made once and not once per period."""
    from checks.ingest import _land

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(30).mapInArrow(count, "id long")
    path = _land(spark, rows, F.col("id") % 3, "landed-once")
    assert made.value == 30 and sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(30))


def test_bootstrap_parses_and_merges_rows_once(spark):
    """Pages were parsed for a filter and again for their rows, and the merged rows were made three times to give out ids."""
    from checks.ingest import pages as listed
    from touchline.plans import ingest as In

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    landed = spark.createDataFrame([(1, '{"response": [{"fixture": {"id": 5}}, null, {"fixture": {"id": 6}}]}'), (2, '{"response": []}'), (3, "{}"), (4, "no"), (5, None)], "page long, body string")
    assert plan(P.matches_a(landed)).count("from_json(") == 1
    assert [tuple(r) for r in P.matches_a(landed).orderBy("landing").select("landing.page", "landing.pos", "external_id").collect()] == [(1, 0, 5), (1, 1, None), (1, 2, 6)]
    keys = landed.selectExpr("page AS team_external_id", "1L AS competition_external_id", "1L AS season_external_id", "DATE'2020-01-01' AS as_of_date", "IF(page < 3, '{\"response\": {\"form\": \"W\"}}', body) AS body")
    assert plan(P.team_statistics(keys)).count("from_json(") == 1
    assert sorted((r["team_external_id"], r["form"]) for r in P.team_statistics(keys).collect()) == [(1, "W"), (2, "W")]
    entries = spark.range(250).select("id", F.struct("id").alias("e"))
    assert plan(listed(entries, "id")).count("Exchange") == 1 and "REPARTITION_BY_COL" in plan(listed(entries, "id"))

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(1, 7), (2, None), (3, None)], "external_id long, id long").mapInArrow(count, "external_id long, id long")
    assert {tuple(r) for r in U.assign_ids(rows).collect()} == {(1, 7), (2, 8), (3, 9)} and made.value == 3
    good, bad = In.staged_once(rows.withColumn("reject", F.when(F.col("id").isNull(), "missing id")), "test")
    assert (good.count(), bad.count(), good.columns) == (1, 2, ["external_id", "id"]) and made.value == 6


def test_updates_of_a_key_carry_their_order_once(spark):
    """The order came with every column; values, missing ones included, are those of the first and the last update."""
    new = spark.createDataFrame([(1, "a", "x", 1, 1, 1), (1, None, "y", None, 2, 2), (2, "b", None, 3, 3, 1), (2, "c", "z", None, 4, 2)], "k long, name string, town string, size long, other long, at long")
    out = U.combined(new, ["k"], {"name": "overwrite", "other": lambda old, val: val, "size": "fill"}, "at")
    assert out.columns == new.columns
    assert sorted(map(tuple, out.collect())) == [(1, None, "x", 1, 2, 2), (2, "c", None, 3, 4, 2)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("min_by("), plan.count("max_by(")) == (1, 2)
    by_order = U.combined(new.select("k", "at", "name"), ["k", "at"], {"name": "overwrite"}, "at")
    assert by_order.columns == ["k", "at", "name"] and by_order.count() == 4


def test_lineup_pages_gather_slots_of_one_shuffle_partition(spark, tmp_path):
    """A task that gathered the slots of all the rows it scanned held more the larger the table."""
    from checks import ingest as Ci

    orders = [(k, 7 * k, datetime(2000, 1, 1 + k), "F", 100.0 * k) for k in (1, 2, 3, 3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(1, 10, 1, "N"), (1, 11, 2, "R"), (1, 11, 2, "R"), (2, None, 1, "A"), (3, 12, 1, "A"), (9, 13, 1, "A"), (None, 14, 1, "A")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    pages = Ci.lineup_pages(spark, str(tmp_path))
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.index("partial_collect_list") :] and "BroadcastHashJoin" not in plan
    rows = P.split_rejects(P.lineups(pages))[0].select("fixture_external_id", F.transform("players", lambda p: F.struct("fixture_external_id", p["player_external_id"], p["is_starter"]))).collect()
    got = sorted((r[0], [(p[1], p[2]) for p in r[1]]) for r in rows)
    first, second = [(11, True), (11, True), (10, False)], [(0, True)]
    assert got == [(1, first)] * 2 + [(2, second)] * 2 + [(3, [(12, True), (12, True)])] * 2
