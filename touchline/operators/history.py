"""Point-in-time histories.

Every value for a match at instant T may use only rows strictly before T, and rows that share one
instant never see each other. The operators here keep that rule and stay split when one key holds
a large share of the rows:

* rows of one (key, instant) are collapsed before the shuffle, to running sums or to the few rows a
  window can still reach;
* each key's time line is cut into blocks of ``BLOCK_DAYS`` days. A block is one window partition;
  what it needs from earlier blocks arrives as a handful of carried rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import scalars as X
from touchline.functions.names import LEAGUE, TEAM

BLOCK_DAYS = 28
BEFORE_ALL = -(1 << 62)


def block_of(at: Column) -> Column:
    return F.floor(at / F.lit(BLOCK_DAYS * X.DAY_MICROS)).cast("int")


def finished(matches: DataFrame) -> DataFrame:
    """Matches that carry a result."""
    return matches.where(
        (F.col("status") == "finished") & F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull()
    )


def team_matches(matches: DataFrame) -> DataFrame:
    """Two rows per match, one seen from each side, from one scan."""

    def side(me: str, other: str) -> Column:
        return F.struct(
            F.col(f"{me}_team_id").alias("team_id"),
            F.col(f"{other}_team_id").alias("opponent_id"),
            F.lit(me == "home").alias("is_home"),
            F.col(f"{me}_goals").cast("long").alias("goals_for"),
            F.col(f"{other}_goals").cast("long").alias("goals_against"),
        )

    long = matches.select(
        "fixture_id",
        *LEAGUE,
        "kickoff",
        X.instant("kickoff").alias("at"),
        F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s"),
    ).select("fixture_id", *LEAGUE, "kickoff", "at", "s.*")
    gf, ga = F.col("goals_for"), F.col("goals_against")
    return long.withColumn("outcome", F.when(gf > ga, "W").when(gf < ga, "L").when(gf == ga, "D")).withColumn(
        "points", F.when(gf > ga, 3).when(gf == ga, 1).when(gf < ga, 0).cast("long")
    )


def probes(matches: DataFrame) -> DataFrame:
    """The distinct (team, instant) pairs at which features are wanted."""
    return (
        matches.select(
            *LEAGUE,
            X.instant("kickoff").alias("at"),
            F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"),
        )
        .select(*TEAM, "at")
        .distinct()
    )


# --- last n ---------------------------------------------------------------------------------


def reachable(long: DataFrame, keys: Sequence[str], n: int, tie: str = "fixture_id") -> DataFrame:
    """Of the rows at one (key, instant) keep the ``n`` a last-``n`` window can reach.

    Newest first means (instant descending, id ascending). Spark applies the rank limit on the map
    side, so a crowded instant shrinks before it is shuffled.
    """
    w = Window.partitionBy(*keys, "at").orderBy(tie)
    return long.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def with_halo(rows: DataFrame, keys: Sequence[str], n: int, tie: str = "fixture_id") -> DataFrame:
    """Add to each (key, block) the last ``n`` rows of the key's earlier blocks, flagged ``_halo``.

    ``rows`` is first reduced to the last ``n`` rows per block. On that short list a row is carried
    into every later block that starts within the next ``n`` rows.
    """
    blocked = rows.withColumn("_block", block_of(F.col("at")))
    newest = Window.partitionBy(*keys, "_block").orderBy(F.desc("at"), F.asc(tie))
    tails = blocked.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")
    ahead = Window.partitionBy(*keys).orderBy(F.asc("at"), F.desc(tie)).rowsBetween(1, n)
    carried = (
        tails.withColumn("_into", F.array_except(F.collect_set("_block").over(ahead), F.array("_block")))
        .withColumn("_block", F.explode("_into"))
        .drop("_into")
    )
    return blocked.withColumn("_halo", F.lit(False)).unionByName(carried.withColumn("_halo", F.lit(True)))


def with_recent(rows: DataFrame, keys: Sequence[str], windows: Sequence[int], measures: Sequence[str], name: str) -> DataFrame:
    """Add the struct ``name`` to the last row of each (key, instant); NULL on all other rows.

    The struct holds ``seen`` (rows seen, reliable up to the halo size), ``last_at`` and one struct
    ``last_<n>`` per window with the sums over the last n rows. ``rows`` comes from ``with_halo``. Running
    sums and offsets keep the cost per row constant whatever the window length.
    """
    order = Window.partitionBy(*keys, "_block").orderBy(F.asc("at"), F.desc("fixture_id"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = list(rows.columns)
    run = rows.select(
        *own,
        F.row_number().over(order).alias("_seen"),
        F.lead("at").over(order).alias("_next"),
        *[F.sum(m).over(upto).alias(f"_run_{m}") for m in measures],
    ).select("*", *[F.lag(f"_run_{m}", n, 0).over(order).alias(f"_lag{n}_{m}") for n in windows for m in measures])
    sums = [
        F.struct(*[(F.col(f"_run_{m}") - F.col(f"_lag{n}_{m}")).alias(m) for m in measures]).alias(f"last_{n}")
        for n in windows
    ]
    state = F.struct(F.col("_seen").alias("seen"), F.col("at").alias("last_at"), *sums)
    closing = ~F.col("_halo") & (F.col("_next").isNull() | (F.col("_next") != F.col("at")))
    return run.select(*own, F.when(closing, state).alias(name))


def recent_states(
    long: DataFrame, keys: Sequence[str], windows: Sequence[int], measures: Sequence[str], name: str
) -> DataFrame:
    """State after each (key, instant): sums of ``measures`` over the last n rows for each n."""
    top = max(windows)
    rows = with_halo(reachable(long.select(*keys, "at", "fixture_id", *measures), keys, top), keys, top)
    return with_recent(rows, keys, windows, measures, name).where(F.col(name).isNotNull()).select(*keys, "at", name)


def recent_lists(rows: DataFrame, keys: Sequence[str], n: int, fields: Sequence[str], name: str) -> DataFrame:
    """State after each (key, instant): the last ``n`` rows as an array, newest first.

    ``rows`` carries keys, ``at``, ``fixture_id`` and ``fields``.
    """
    base = with_halo(reachable(rows.select(*keys, "at", "fixture_id", *fields), keys, n), keys, n)
    order = Window.partitionBy(*keys, "_block").orderBy(F.asc("at"), F.desc("fixture_id"))
    item = F.struct("at", "fixture_id", *fields)
    run = base.withColumns(
        {"_list": F.collect_list(item).over(order.rowsBetween(-(n - 1), 0)), "_next": F.lead("at").over(order)}
    )
    closing = run.where(~F.col("_halo") & (F.col("_next").isNull() | (F.col("_next") != F.col("at"))))
    return closing.select(*keys, "at", F.struct(F.reverse("_list").alias("items")).alias(name))


# --- running totals -------------------------------------------------------------------------


def instant_totals(rows: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums per (key, instant); partial sums are formed before the shuffle."""
    return rows.groupBy(*keys, "at").agg(*[F.sum(m).alias(m) for m in measures])


def running_states(totals: DataFrame, keys: Sequence[str], measures: Sequence[str], name: str) -> DataFrame:
    """State after each (key, instant): totals since the key's first row, as the struct ``name``.

    ``totals`` has one row per (key, instant). Sums run inside a block and start from the summed
    totals of the key's earlier blocks.
    """
    blocked = totals.withColumn("_block", block_of(F.col("at")))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        blocked.groupBy(*keys, "_block")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(*keys, "_block", *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_c_{m}") for m in measures])
    )
    upto = (
        Window.partitionBy(*keys, "_block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = blocked.select(*keys, "_block", "at", *[F.sum(m).over(upto).alias(m) for m in measures])
    return local.join(carry, [*keys, "_block"]).select(
        *keys, "at", F.struct(*[(F.col(m) + F.col(f"_c_{m}")).alias(m) for m in measures]).alias(name)
    )


# --- as-of lookup ---------------------------------------------------------------------------


def as_of(
    wanted: DataFrame, states: Sequence[DataFrame], keys: Sequence[str], names: Sequence[str], strict: bool = True
) -> DataFrame:
    """For each distinct (key, at) of ``wanted`` the latest state of every kind before ``at``.

    Each of ``states`` carries (key, at) and one or more structs out of ``names``. All kinds share one
    shuffle and one window pass over (key, block); the latest state of earlier blocks is joined on,
    one row per block. With ``strict=False`` a state at the same instant counts.
    """
    types = {n: s.schema[n].dataType for s in states for n in s.columns if n in names}

    def widen(df: DataFrame, probe: bool) -> DataFrame:
        cols = [F.col(n) if n in df.columns else F.lit(None).cast(types[n]).alias(n) for n in names]
        return df.select(*keys, "at", block_of(F.col("at")).alias("_block"), F.lit(probe).alias("_probe"), *cols)

    rows = widen(wanted, True)
    for s in states:
        rows = rows.unionByName(widen(s, False))
    # One explicit shuffle serves both branches below. Each reads every column, and stating the null
    # rule here keeps the join from adding it to one branch only, so Spark reuses the shuffle.
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    rows = rows.repartition(*keys, "_block")
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*keys, "_block")
        .agg(
            F.bool_or("_probe").alias("_asked"),
            *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("at"))).alias(n) for n in names],
        )
        .select(
            *keys, "_block", "_asked", *[F.last(n, ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in names]
        )
        .where("_asked")
        .drop("_asked")
    )
    line = Window.partitionBy(*keys, "_block").orderBy("at")
    line = line.rangeBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    return (
        rows.withColumns({n: F.last(n, ignorenulls=True).over(line) for n in names})
        .where("_probe")
        .join(carried, [*keys, "_block"], "left")
        .select(*keys, "at", *[F.coalesce(F.col(n), F.col(f"_c_{n}")).alias(n) for n in names])
    )
