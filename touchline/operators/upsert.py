"""Upserts, append-only inserts and activation as joins that return the new table.

A write goes to a new path and readers move over afterwards; no table format with MERGE is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import materialise

Policy = str | Callable[[Column, Column], Column]


def combined(updates: DataFrame, keys: Sequence[str], policy: dict[str, Policy], order: str, extra: dict[str, Column] | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """One row per key that has the effect of all its updates one after the other in ``order``.

    The first update fixes kept columns, the last value wins for overwritten ones and the last value that
    is not NULL for filled ones. Partial aggregates run before the shuffle; kept and overwritten columns travel as one
    value each, so the order is not repeated per column. ``extra`` adds further aggregates, ``only`` names the columns to return.
    """
    at = F.col(order)
    rest = [c for c in updates.columns if c not in keys and (only is None or c in only or c == order)]
    rule = {c: policy.get(c, "keep") for c in rest if c != order}
    first = [c for c, r in rule.items() if r == "keep"]
    last = [c for c, r in rule.items() if r not in ("keep", "fill")]
    aggregates = [F.max(at).alias(order)] if order in rest else []
    aggregates += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c, r in rule.items() if r == "fill"]
    aggregates += [F.min_by(F.struct(*first), at).alias("_first")] if first else []
    aggregates += [F.max_by(F.struct(*last), at).alias("_last")] if last else []
    more = [c.alias(name) for name, c in (extra or {}).items()]
    out = updates.groupBy(*keys).agg(*aggregates, *more)
    place = {c: F.col("_first")[c] for c in first} | {c: F.col("_last")[c] for c in last}
    return out.select(*keys, *[place.get(c, F.col(c)).alias(c) for c in rest], *(extra or {}))


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int, path: str) -> DataFrame:
    """The rows as a table at ``path`` in sorted buckets of their key. A merge or join on the key moves only the other side."""
    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def merge_upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], policy: dict[str, Policy], order: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Insert unknown keys and update known ones column by column.

    ``policy`` maps a column to ``"overwrite"``, ``"keep"`` (fixed at insert), ``"fill"`` (new value unless
    NULL) or a function of (old, new). A column without an entry is kept. ``order`` names the column that
    puts several updates of one key in sequence. The result carries ``_outcome``: inserted, updated or untouched, and
    ``extra``, aggregates over all updates of a key. A target in buckets of its key (``bucketed``) is not shuffled.
    """
    new = combined(updates, keys, policy, order, extra, target.columns)
    t, u = target.alias("t"), new.alias("u")
    on = [F.col(f"t.{k}") == F.col(f"u.{k}") for k in keys]
    joined = t.withColumn("_t", F.lit(True)).alias("t").join(u.withColumn("_u", F.lit(True)).alias("u"), on, "full")
    known, given = F.col("t._t").isNotNull(), F.col("u._u").isNotNull()
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.coalesce(F.col(f"t.{c}"), F.col(f"u.{c}")).alias(c))
            continue
        kind = target.schema[c].dataType
        if c not in new.columns:
            cols.append(F.col(f"t.{c}").alias(c))
            continue
        old, val = F.col(f"t.{c}"), F.col(f"u.{c}").cast(kind)
        rule = policy.get(c, "keep")
        changed = {"overwrite": val, "keep": old, "fill": F.coalesce(val, old)}[rule] if isinstance(rule, str) else rule(old, val)
        cols.append(F.when(known & given, changed).when(known, old).otherwise(val).alias(c))
    outcome = F.when(known & given, "updated").when(known, "untouched").otherwise("inserted")
    return joined.select(*cols, outcome.alias("_outcome"), *[F.col(f"u.{name}") for name in extra or {}])


def all_columns(df: DataFrame, keys: Sequence[str], rule: Policy = "overwrite") -> dict[str, Policy]:
    return {c: rule for c in df.columns if c not in keys}


MATCH_POLICY: dict[str, Policy] = {c: "overwrite" for c in ("kickoff_time", "matchday", "round", "venue", "status", "status_short", "synced_at")}
PLAYER_POLICY: dict[str, Policy] = {
    "name": "overwrite",
    **{c: "fill" for c in ("photo", "nationality", "birth_date", "height_cm", "weight_kg", "position")},
}
INJURY_POLICY: dict[str, Policy] = {
    c: "overwrite"
    for c in ("player_id", "team_id", "competition_id", "fixture_id", "type", "reason", "status", "end_date", "updated_external_at")
}


def upsert_matches(target: DataFrame, updates: DataFrame, now: str, order: str = "landing") -> DataFrame:
    """Upsert matches, then mark those finished whose updates carry a result and whose goals are unset.

    ``updates`` are resolved match rows with ``home_goals``/``away_goals`` as reported, several per match
    applied in ``order``. The first finished update sets the goals, a missing one as 0; goals that are stored
    never change. Later updates still overwrite the other columns, the status among them.
    """
    stamp = F.lit(now).cast("timestamp")
    told = ("home_goals", "away_goals")
    given = updates.withColumns({f"_{c}": F.col(c) for c in told} | {c: F.lit(None).cast("long") for c in told})
    blank = given.withColumns({"synced_at": stamp, "finished_at": F.lit(None).cast("timestamp")})
    finished = F.when(F.col("status") == "finished", F.col(order))
    extra = {
        "_told": F.min_by(F.struct(*[f"_{c}" for c in told]), finished),
        "_fin": F.bool_or(finished.isNotNull()),
    }
    j = merge_upsert(target, blank, ["external_id"], MATCH_POLICY, order, extra)
    marks = F.coalesce(F.col("_fin"), F.lit(False)) & (F.col("home_goals").isNull() | F.col("away_goals").isNull())
    zero = F.lit(0).cast("long")
    return j.withColumns(
        {
            "home_goals": F.when(marks, F.coalesce(F.col("_told._home_goals"), zero)).otherwise(F.col("home_goals")),
            "away_goals": F.when(marks, F.coalesce(F.col("_told._away_goals"), zero)).otherwise(F.col("away_goals")),
            "finished_at": F.when(marks, stamp).otherwise(F.col("finished_at")),
            "_outcome": F.when(marks, "updated").otherwise(F.col("_outcome")),
        }
    ).drop("_told", "_fin")


def replace_children(children: DataFrame, parents_touched: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop every child of a touched parent and add the fresh ones."""
    kept = children.join(parents_touched.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(fresh)


def upsert_lineups(parents: DataFrame, slots: DataFrame, updates: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(lineups with ``_outcome``, slots): the last update of a lineup overwrites its row and replaces its slots.

    ``updates`` carry ``players``, an array of slot structs; a NULL list leaves the stored slots as they are, an empty one removes them.
    """
    whole = combined(updates, keys, {**all_columns(updates, keys), "players": "fill"}, order)
    merged = merge_upsert(parents, whole.drop("players"), keys, all_columns(parents, keys), order)
    given = whole.where(F.col("players").isNotNull())
    fresh = given.select(*keys, F.explode("players").alias("p")).select(*keys, "p.*")
    return merged, replace_children(slots, given, fresh.select(*slots.columns), keys)


def insert_only(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows to append; a key that already exists, or occurs twice, is a conflict and raises."""
    clash = rows.join(target.select(*keys), list(keys), "left_semi").limit(1).count()
    twice = rows.groupBy(*keys).count().where("count > 1").limit(1).count()
    if clash or twice:
        raise ValueError(f"rows conflict with existing or repeated keys {list(keys)}; this table is append-only")
    return rows


def append_new(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows whose key is not stored yet; a repeated write appends nothing.

    Of several rows with one key the first in ``order`` is taken, without an order the one with the least values.
    """
    rest = [c for c in rows.columns if c not in keys]
    if rest:
        whole = F.struct(*rest)
        first = F.min_by(whole, F.col(order)) if order else F.min(whole)
        rows = rows.groupBy(*keys).agg(first.alias("_b")).select(*[c if c in keys else F.col("_b")[c].alias(c) for c in rows.columns])
    else:
        rows = rows.distinct()
    return rows.join(target.select(*keys), list(keys), "left_anti")


def assign_ids(merged: DataFrame, key: str = "external_id", id_col: str = "id") -> DataFrame:
    """Give rows without an id the numbers after the largest one, in the order of ``key``.

    The new keys are range-partitioned and sorted; a row's number is its place in its partition plus the rows of
    the partitions before, of which there is one small row each. No window spans the table. The rows are written once,
    since the new keys, the largest id and the result all read them.
    """
    merged = materialise(merged, "merged")
    fresh = merged.where(F.col(id_col).isNull()).select(key).repartitionByRange(key).sortWithinPartitions(key)
    fresh = materialise(fresh.select(key, F.monotonically_increasing_id().alias("_n")), "new-ids")
    part = F.shiftright("_n", 33)
    sizes = fresh.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    top = merged.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    numbered = fresh.join(shifts, part == F.col("_part")).select(key, (F.lit(top) + 1 + F.col("_shift") + F.col("_n") - F.shiftleft("_part", 33)).alias("_id"))
    kind = merged.schema[id_col].dataType
    return merged.join(numbered, key, "left").withColumn(id_col, F.coalesce(id_col, F.col("_id").cast(kind))).drop("_id")


def activate(versions: DataFrame, version_id: int) -> DataFrame:
    """Switch one model version on and its siblings of the same name off."""
    name = versions.where(F.col("id") == version_id).select(F.col("name").alias("_name"))
    if not name.limit(1).count():
        raise ValueError(f"unknown model version {version_id}")
    marked = versions.join(F.broadcast(name.limit(1)), F.col("name") == F.col("_name"), "left")
    on = F.when(F.col("_name").isNull(), F.col("is_active")).otherwise(F.col("id") == version_id)
    return marked.withColumn("is_active", on).drop("_name")
