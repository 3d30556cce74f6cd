"""Type hierarchy: subclasses, implementors, subtypes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .facts import Facts
from .forest import MERGE_ROWS, hierarchy

_PAIR = "class string, ancestor string, depth int"
#: Pairs a walking task gives at a time.
_PAIRS = 50_000


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All ancestors of the nodes of one task, whose links are all in the task."""
    parent: dict[str, str] = {}
    for b in batches:
        parent.update(zip(b["class"], b["ancestor"]))
    out: list[tuple[str, str, int]] = []
    for start in parent:
        seen: set[str] = set()
        at, depth = parent[start], 1
        while at is not None and at not in seen:
            seen.add(at)
            out.append((start, at, depth))
            at, depth = parent.get(at), depth + 1
        if len(out) >= _PAIRS:
            yield pd.DataFrame(out, columns=["class", "ancestor", "depth"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["class", "ancestor", "depth"])


def ancestors(facts: Facts) -> DataFrame:
    """(class, ancestor, depth): each class with every class above it along ``base_class``, depth from 1.

    Chains come from the forest of bases; classes on or below a cycle walk round it once, so a class on a cycle is its
    own ancestor.
    """
    links = facts.classes.where(F.col("base_class").isNotNull()).select("name", "base_class")
    forest = cut(hierarchy(links, "name", "base_class"))
    steps = forest.where("depth > 0").select(F.col("node").alias("class"), "depth", F.posexplode("path").alias("pos", "ancestor"))
    tree = steps.where("pos < depth").select("class", "ancestor", (F.col("depth") - F.col("pos")).cast("int").alias("depth"))
    ring = cut(forest.where("leads_to_cycle").select(F.col("node").alias("class"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    if ring.count() <= MERGE_ROWS:  # few enough links for one task; their pairs are given in batches
        return tree.unionByName(ring.repartition(1).mapInPandas(_walk, _PAIR))
    frontier, found, depth = ring, ring, 1
    up = forest.select(F.col("node").alias("at"), "parent")
    while frontier.limit(1).count():
        depth += 1
        step = frontier.join(up, F.col("ancestor") == F.col("at")).select("class", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth"))
        frontier = cut(step.join(found.select("class", "ancestor"), ["class", "ancestor"], "left_anti"))
        found = cut(found.unionByName(frontier))
    return tree.unionByName(found)


def lineage(facts: Facts, above: DataFrame | None = None) -> DataFrame:
    """(class, ancestor, depth) with every class as its own ancestor at depth 0."""
    above = ancestors(facts) if above is None else above
    return facts.classes.select(F.col("name").alias("class"), F.col("name").alias("ancestor"), F.lit(0).alias("depth")).unionByName(above.where("class <> ancestor"))


def implementors(facts: Facts, above: DataFrame | None = None) -> DataFrame:
    """(iface, class): classes that implement an interface themselves or through a base class."""
    line = lineage(facts, above)
    return line.join(facts.class_iface.select(F.col("class").alias("ancestor"), "iface"), "ancestor").select("iface", "class").distinct()


def concrete_subtypes(facts: Facts, above: DataFrame | None = None) -> DataFrame:
    """(name, class): for every type name the classes that may stand for it: neither abstract nor static, and it itself, below it or implementing it."""
    above = ancestors(facts) if above is None else above
    line = lineage(facts, above)
    concrete = facts.classes.where(~F.col("is_abstract") & ~F.col("is_static")).select(F.col("name").alias("class"))
    pairs = line.select(F.col("ancestor").alias("name"), "class").unionByName(implementors(facts, above).withColumnRenamed("iface", "name"))
    return pairs.distinct().join(concrete, "class", "left_semi").select("name", "class")


def direct_implementors(facts: Facts) -> DataFrame:
    """(iface, class) as declared, without inheritance."""
    return facts.class_iface.select("iface", "class").distinct()


def interface_names(facts: Facts) -> DataFrame:
    """(name): interfaces declared, or mentioned in any class's interface list."""
    return facts.interfaces.select("name").unionByName(facts.class_iface.select(F.col("iface").alias("name"))).distinct()


def subtypes(facts: Facts, above: DataFrame | None = None) -> DataFrame:
    """(sub, super): pairs along ``base_class``, every class and interface with itself."""
    names = facts.classes.select("name").unionByName(interface_names(facts)).distinct()
    chain = (ancestors(facts) if above is None else above).select(F.col("class").alias("sub"), F.col("ancestor").alias("super"))
    return names.select(F.col("name").alias("sub"), F.col("name").alias("super")).unionByName(chain).distinct()


def controllers(facts: Facts, above: DataFrame | None = None) -> DataFrame:
    """(class): classes whose chain of bases reaches ControllerBase or Controller."""
    return (ancestors(facts) if above is None else above).where(F.col("ancestor").isin("ControllerBase", "Controller")).select("class").distinct()


def unique_methods(facts: Facts) -> DataFrame:
    """(method, owner): methods that exactly one class has."""
    own = facts.methods.where("owner_kind = 'class'").select("owner", "method").distinct()
    return own.groupBy("method").agg(F.count("*").alias("n"), F.min("owner").alias("owner")).where("n = 1").select("method", "owner")


def user_parameters(facts: Facts) -> DataFrame:
    """(owner, method, type): the parameter types of class methods that the program itself declares."""
    known = facts.classes.select(F.col("name").alias("type")).unionByName(facts.interfaces.select(F.col("name").alias("type"))).distinct()
    own = facts.methods.where("owner_kind = 'class'").select("owner", "method", F.explode("params").alias("type")).distinct()
    return own.join(known, "type", "left_semi").select("owner", "method", "type")


def compatible_methods(facts: Facts, above: DataFrame | None = None) -> DataFrame:
    """(a_owner, a_method, b_owner, b_method): class methods of different classes that share a parameter type, equal or one below the other.

    Each parameter type leads to its supertypes, and methods meet in a common pair (sub, super); nothing is compared
    that has no type in common.
    """
    own = user_parameters(facts)
    left = own.select(F.col("owner").alias("a_owner"), F.col("method").alias("a_method"), F.col("type").alias("sub"))
    right = own.select(F.col("owner").alias("b_owner"), F.col("method").alias("b_method"), F.col("type").alias("super"))
    met = left.join(subtypes(facts, above), "sub").join(right, "super").where("a_owner <> b_owner")
    down = met.select("a_owner", "a_method", "b_owner", "b_method")
    up = down.select(F.col("b_owner").alias("a_owner"), F.col("b_method").alias("a_method"), F.col("a_owner").alias("b_owner"), F.col("a_method").alias("b_method"))
    return down.unionByName(up).distinct()
