"""Impact of a method and of the difference between two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, stored
from .facts import Facts
from .fixpoint import reach, walk_counts


def call_edges(facts: Facts) -> DataFrame:
    """(src, dst, n): 'Class.Method' of caller and callee with the number of call sites; callers and callees without a name are left out."""
    c = facts.calls.where("callee_class <> '' and callee <> '' and caller_method <> ''")
    return c.groupBy(F.concat_ws(".", "caller_class", "caller_method").alias("src"), F.concat_ws(".", "callee_class", "callee").alias("dst")).agg(F.count("*").alias("n"))


def method_keys(facts: Facts) -> DataFrame:
    """(key): every method that calls or is called."""
    edges = call_edges(facts)
    return edges.select(F.col("dst").alias("key")).unionByName(edges.select(F.col("src").alias("key"))).distinct()


def suggestions(facts: Facts, cls: str, method: str) -> list[str]:
    """Keys like a target that does not exist: names that contain it in any case."""
    near = F.lower(F.col("key"))
    rows = method_keys(facts).where(F.contains(near, F.lit(cls.lower())) & F.contains(near, F.lit(method.lower()))).orderBy("key").limit(10).collect()
    return [r[0] for r in rows]


def impact(facts: Facts, target: str, check: bool = True, walks: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) above ``target`` ('Class.Method'): who reaches it over calls.

    nodes(id, level, direct, distinct_callers, transitive): call sites that call the node; all methods above it; walks
    that end in it, null where calls run in circles above it (and for all without ``walks``). edges(caller, callee), each once.
    """
    edges = stored(call_edges(facts), "calls")
    spark = edges.sparkSession
    if check and not edges.where((F.col("dst") == target) | (F.col("src") == target)).limit(1).count():
        cls, _, method = target.rpartition(".")
        raise ValueError(f"{target} not found; like it: {', '.join(suggestions(facts, cls, method)) or 'none'}")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    nodes = cut(reach(back, spark.createDataFrame([(target,)], "node string")))
    inner = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    direct = inner.groupBy(F.col("dst").alias("node")).agg(F.sum("n").alias("direct"), F.count("*").alias("callers"))
    counted = walk_counts(edges, target, nodes) if walks else nodes.select("node", F.lit(None).cast("decimal(38,0)").alias("walks"))
    counted = counted.withColumnRenamed("walks", "transitive")
    out = nodes.join(direct, "node", "left").join(counted, "node", "left")
    return (
        out.select(F.col("node").alias("id"), "level", F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("callers", F.lit(0)).alias("distinct_callers"), "transitive"),
        inner.select(F.col("src").alias("caller"), F.col("dst").alias("callee")).distinct(),
    )


def callers_of(facts: Facts) -> DataFrame:
    """(key, callers): the distinct callers of every method called."""
    return call_edges(facts).groupBy(F.col("dst").alias("key")).agg(F.array_sort(F.collect_set("src")).alias("callers"))


def diff(v1: Facts, v2: Facts) -> DataFrame:
    """(key, kind, removed_callers, added_callers): methods added, removed, or called by others than before.

    Keys are those that call or are called. A key that lost all its callers but still calls is no change of callers.
    """
    old, new = method_keys(v1), method_keys(v2)
    none = F.array().cast("array<string>")
    added = new.join(old, "key", "left_anti").select("key", F.lit("added").alias("kind"), none.alias("removed_callers"), none.alias("added_callers"))
    removed = old.join(new, "key", "left_anti").select("key", F.lit("removed").alias("kind"), none.alias("removed_callers"), none.alias("added_callers"))
    a, b = callers_of(v1).withColumnRenamed("callers", "was"), callers_of(v2).join(old, "key", "left_semi")
    both = b.join(a, "key", "left").select("key", F.coalesce("was", none).alias("was"), "callers")
    changed = both.select("key", F.lit("callers_changed").alias("kind"), F.array_except("was", "callers").alias("removed_callers"), F.array_except("callers", "was").alias("added_callers"))
    return added.unionByName(removed).unionByName(changed.where((F.size("removed_callers") > 0) | (F.size("added_callers") > 0)))


def diff_impact(v1: Facts, v2: Facts, target: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, nodes, edges): the difference, and the impact on v2 of the target, or of the first changed key with a class."""
    changes = cut(diff(v1, v2))
    spark = changes.sparkSession
    known = method_keys(v2)
    if target is None or not known.where(F.col("key") == target).limit(1).count():
        first = changes.where("kind <> 'removed' and key not like '.%'").agg(F.min("key")).first()[0]
        target = first
    if target is None:
        return changes, spark.createDataFrame([], "id string, level int, direct long, distinct_callers long, transitive decimal(38,0)"), spark.createDataFrame([], "caller string, callee string")
    return (changes, *impact(v2, target, check=False))
