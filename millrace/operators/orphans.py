"""References to records that do not exist.

A fixpoint cascade down the foreign-key graph. Level 0, the direct orphans: references whose type has no live
declaration at the moment of the reference. A class with an orphaned base is itself orphaned, and by semi-joins, round
after round, so are the classes below it; whatever refers to an orphaned class is an inherited orphan. The rounds run
over class names only, stored once; the large tables of references are joined once, with one row per type name, which is
broadcast while it is small enough.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import named
from ..session import stored

_NEVER = "9999-12-31"
#: Rows of a table of names that is broadcast, and spans in it, at most; beyond, it is joined by shuffle.
BROADCAST_NAMES, BROADCAST_SPANS = 100_000, 200_000
#: Edges that one task may go down at once, each two names, so about 100 MB at most; beyond, every round is a join.
LOCAL_EDGES = 300_000


def lifetimes(declarations: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per type name its disjoint live spans: (name, first_seen, spans array<struct<s,e>>), spans in order.

    ``declarations``: (name, from_ts, to_ts); a declaration lives from ``from_ts`` until before ``to_ts`` (null: for
    good). Rows without a name are left out; a null ``from_ts`` declares the name without ever being live. Overlapping
    spans are merged within each month first, so a name declared very often is not sorted in one piece. ``scope``: more
    columns that a name is told apart by.
    """
    name = [*(scope or []), "name"]
    far = F.lit(_NEVER).cast("timestamp")
    rows = declarations.where(F.col("name").isNotNull()).select(*name, F.col("from_ts").alias("s"), F.coalesce("to_ts", far).alias("e"))
    # null starts open no span: they would come first in the windows and swallow all later ones
    never = rows.where(F.col("s").isNull()).select(*name, "s", "e").distinct()
    rows = rows.where(F.col("s").isNotNull())
    # equal starts need only the latest end: a partial aggregate before any shuffle of spans
    rows = rows.groupBy(*name, "s").agg(F.max("e").alias("e"))
    for keys in ([*name, F.date_trunc("month", "s")], name):
        order = Window.partitionBy(*keys).orderBy("s")
        before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0)
        rows = rows.withColumn("opens", opens).withColumn("k", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        group = [F.date_trunc("month", "s").alias("m")] if keys is not name else []
        rows = rows.groupBy(*name, "k", *group).agg(F.min("s").alias("s"), F.max("e").alias("e")).select(*name, "s", "e")
    rows = rows.unionByName(never)
    live = F.when(F.col("s").isNotNull() & (F.col("s") < F.col("e")), F.struct("s", "e"))
    return rows.groupBy(*name).agg(F.min("s").alias("first_seen"), F.array_sort(F.collect_list(live)).alias("spans"))


def _reason(at: str, declared: str, spans: str, first: str) -> F.Column:
    """null: live; else missing, late or deleted."""
    live = F.exists(spans, lambda x: (x["s"] <= F.col(at)) & (F.col(at) < x["e"]))
    return (
        F.when(F.col(declared).isNull(), F.lit("missing"))
        .when(F.col(at).isNull() | F.coalesce(live, F.lit(False)), F.lit(None).cast("string"))
        .when(F.col(first) > F.col(at), F.lit("late"))
        .otherwise(F.lit("deleted"))
    )


def _small(table: DataFrame) -> DataFrame:
    """A stored ``table`` of names, as a broadcast where it has few enough rows and spans."""
    spans = F.sum(F.size("spans")) if "spans" in table.columns else F.count("*")
    rows, size = table.agg(F.count("*"), spans).first()
    return F.broadcast(table) if rows <= BROADCAST_NAMES and (size or 0) <= BROADCAST_SPANS else table


def _cascade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All rounds over the edges of one task; rows without a type are seeds."""
    below: dict[str, list[str]] = defaultdict(list)
    level: dict[str, int] = {}
    for b in batches:
        for owner, name in zip(b["owner"], b["type_name"]):
            if name is None:
                level[owner] = 1
            else:
                below[name].append(owner)
    frontier, k = list(level), 1
    while frontier:
        k += 1
        frontier = [o for o in dict.fromkeys(o for name in frontier for o in below.get(name, ())) if o not in level]
        level.update(dict.fromkeys(frontier, k))
    yield pd.DataFrame({"name": pd.Series(list(level), dtype=object), "level": pd.Series(list(level.values()), dtype="int32")})


def orphaned_classes(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(name, level): the ``seeds`` (name) at level 1 and what hangs below them along ``edges`` (owner, type_name).

    Each round semi-joins the stored edges with the last round's names; names found before are dropped, so cycles end.
    Few edges go through all rounds in one task.
    """
    few = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_NAMES else df
    edges = stored(edges.distinct(), "edges")
    if edges.count() <= LOCAL_EDGES:
        rows = edges.unionByName(seeds.select(F.col("name").alias("owner"), F.lit(None).cast("string").alias("type_name")).distinct())
        return rows.repartition(1).mapInPandas(_cascade, "name string, level int")
    found = frontier = stored(seeds.select("name", F.lit(1).alias("level")).distinct(), "orphaned")
    level, total = 1, 0
    while fresh := frontier.count():
        level, total = level + 1, total + fresh
        below = edges.join(few(frontier.select(F.col("name").alias("type_name")), fresh), "type_name", "left_semi").select(F.col("owner").alias("name")).distinct()
        frontier = stored(below.join(few(found.select("name"), total), "name", "left_anti").withColumn("level", F.lit(level)), "orphaned")
        found = found.unionByName(frontier)
    return found


def orphan_references(calls: DataFrame, classes: DataFrame, class_iface: DataFrame, interfaces: DataFrame, external: DataFrame) -> DataFrame:
    """All orphaned references: (ref_table, ref_month, ref_id, type_name, kind, reason, level), one row per table and id.

    ``callee_class`` and ``iface`` may name classes, interfaces or external types, ``base_class`` classes only. kind is
    'direct' with a reason ('missing': never declared, 'late': first declared after, 'deleted': otherwise) and level 0,
    or 'inherited' with null reason: the named class is declared, but it or a class above it has an orphaned base, level
    steps up. Null and blank references are none. A reference without ``scanned_at`` is a case only if its type was
    never declared; its month is null. Rows that came again count once; empty tables give no rows.
    """
    class_decl = classes.select(named(F.col("name")).alias("name"), F.col("scanned_at").alias("from_ts"), F.col("deleted_at").alias("to_ts"))
    other = interfaces.select(named(F.col("name")).alias("name"), F.col("scanned_at").alias("from_ts"), F.col("deleted_at").alias("to_ts"))
    ancient = F.lit("0001-01-01").cast("timestamp")
    fixed = external.select(named(F.col("name")).alias("name"), ancient.alias("from_ts"), F.lit(None).cast("timestamp").alias("to_ts"))
    # declarations of classes twice: among classes, and among all types
    declared = class_decl.withColumn("any", F.explode(F.array(F.lit(False), F.lit(True)))).unionByName(other.unionByName(fixed).withColumn("any", F.lit(True)))
    types = stored(lifetimes(declared, ["any"]).select("any", F.col("name").alias("type_name"), "first_seen", "spans", F.lit(True).alias("declared")), "types")

    bases = classes.select(
        F.col("class_id").alias("ref_id"), named(F.col("name")).alias("owner"), named(F.col("base_class")).alias("type_name"), "scanned_at"
    ).where(F.col("type_name").isNotNull())
    reason = _reason("scanned_at", "declared", "spans", "first_seen")
    based = stored(bases.join(_small(types.where("not any").drop("any")), "type_name", "left").select("ref_id", "owner", "type_name", "scanned_at", reason.alias("reason")), "based")
    owned = based.where(F.col("owner").isNotNull())
    reached = orphaned_classes(owned.where(F.col("reason").isNull()).select("owner", "type_name"), owned.where(F.col("reason").isNotNull()).select(F.col("owner").alias("name")))
    reached = stored(reached.select(F.col("name").alias("type_name"), F.col("level").alias("above")), "reached")

    names = stored(types.where("any").drop("any").join(_small(reached), "type_name", "left"), "names")
    refs = (
        calls.select(F.lit("calls").alias("ref_table"), F.col("site_id").alias("ref_id"), named(F.col("callee_class")).alias("type_name"), "scanned_at")
        .unionByName(class_iface.select(F.lit("class_iface").alias("ref_table"), F.col("link_id").alias("ref_id"), named(F.col("iface")).alias("type_name"), "scanned_at"))
        .where(F.col("type_name").isNotNull())
    )
    judged = refs.join(_small(names), "type_name", "left").select("ref_table", "ref_id", "type_name", "scanned_at", reason.alias("reason"), "above")
    judged_bases = based.join(_small(reached), "type_name", "left").select(F.lit("classes").alias("ref_table"), "ref_id", "type_name", "scanned_at", "reason", "above")
    cases = judged.unionByName(judged_bases).where(F.col("reason").isNotNull() | F.col("above").isNotNull())
    level_ = F.when(F.col("reason").isNotNull(), F.lit(0)).otherwise(F.col("above"))
    return (
        cases.select("ref_table", F.date_format("scanned_at", "yyyy-MM").alias("ref_month"), "ref_id", "type_name", "reason", level_.alias("level"))
        .dropDuplicates(["ref_table", "ref_id"])
        .select("ref_table", "ref_month", "ref_id", "type_name", F.when(F.col("level") == 0, "direct").otherwise("inherited").alias("kind"), "reason", "level")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month, kind and reason, with the number of rows and of different types."""
    return orphans.groupBy("ref_table", "ref_month", "kind", "reason").agg(F.count("*").alias("refs"), F.countDistinct("type_name").alias("types"))
