"""Parent-child links to full hierarchies.

Links are resolved by weighted disjoint-set forests. Each input partition first builds its own forests: every node gets
the top of its local tree and its weight, the number of links up to it. Only tops that another partition knows the
parent of must be looked at again. These boundary trees are merged level by level: while there are more than
``MERGE_ROWS``, a level takes out a random quarter of them, trees whose own top stays, and hangs what was below them
straight under that top, the weights added up; so each level is a join of three quarters as many rows, no chain and no
cycle makes a row longer, and trees that have run into themselves are taken out as loops. The rest is one task's forest.
Then the levels are gone back: what a level took out looks up the root of its top. Paths are made last, and only for
nodes with a root: each open path looks up its top's path in the index of boundary nodes, which at least doubles it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Boundary links that one task may merge; each is two names and a number, so about 100 MB at most.
MERGE_ROWS = 200_000
#: Links of one local forest at most; a partition with more builds several.
LOCAL_LINKS = 500_000

_TREE = "node string, top string, off bigint, looped boolean"


def local_forest(nodes: list[str], tops: list[str], offs: list[int]) -> list[tuple[str, str, int, bool]]:
    """One forest of weighted links: (node, top, offset, runs into a cycle)."""
    link = {n: (t, o) for n, t, o in zip(nodes, tops, offs)}
    done: dict[str, tuple[str, int, bool]] = {}
    for start in nodes:
        trail, seen, at = [], set(), start
        while at in link and at not in done and at not in seen:
            seen.add(at)
            trail.append(at)
            at = link[at][0]
        top, off, looped = done[at] if at in done else (at, 0, at in seen)
        for node in reversed(trail):
            off += link[node][1]
            done[node] = (top, off, looped)
    return [(n, *done[n]) for n in nodes]


def _segments(nodes: list[str], tops: list[str], forest: list[tuple]) -> list[list[str]]:
    """The names from each node of a local forest up to below its top; none for loops."""
    parent = dict(zip(nodes, tops))
    out = []
    for node, top, off, looped in forest:
        seg = []
        while not looped and node != top:
            seg.append(node)
            node = parent[node]
        out.append(seg)
    return out


def _forests(paths: bool) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(parts: list[pd.DataFrame]) -> pd.DataFrame:
            rows = pd.concat(parts, ignore_index=True)
            nodes, tops = rows["node"].tolist(), rows["top"].tolist()
            forest = local_forest(nodes, tops, rows["off"].tolist())
            out = pd.DataFrame(forest, columns=["node", "top", "off", "looped"])
            if paths:
                out["seg"] = _segments(nodes, tops, forest)
            return out

        parts: list[pd.DataFrame] = []
        for b in batches:
            parts += [b] if len(b) else []
            if sum(map(len, parts)) >= LOCAL_LINKS:
                yield flush(parts)
                parts = []
        if parts:
            yield flush(parts)

    return run


def _below(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """``rows`` with the top, weight and loops of what they hang on, where that is known."""
    known = resolved.select(F.col("node").alias("top"), F.col("top").alias("t2"), F.col("off").alias("o2"), F.col("looped").alias("l2"))
    return rows.join(known, "top", "left").select(
        "node", F.coalesce("t2", "top").alias("top"), (F.col("off") + F.coalesce("o2", F.lit(0))).alias("off"), (F.col("looped") | F.coalesce("l2", F.lit(False))).alias("looped")
    )


def _merge(edge: DataFrame, merge_rows: int) -> DataFrame:
    """Boundary trees with their final top; those that run into a cycle flagged."""
    levels: list[DataFrame] = []
    loops = cut(edge.where("looped"))
    edge = cut(edge.where("not looped"))
    rows = edge.count()
    while rows > merge_rows:
        coin = lambda c: F.xxhash64(c, F.lit(len(levels))).bitwiseAND(F.lit(1))
        out = (coin("node") == 1) & (coin("top") == 0)
        gone = cut(edge.where(out))
        rest = _below(edge.where(~out), gone)
        rest = cut(rest.withColumn("looped", F.col("top") == F.col("node")))
        levels.append(gone)
        edge, found = rest.where("not looped"), rest.where("looped")
        loops = loops.unionByName(found)
        rows = edge.count()
    last = edge.repartition(1).mapInPandas(_forests(False), _TREE)
    loops = cut(loops)
    resolved = _below(last, loops).unionByName(loops)
    for gone in reversed(levels):
        resolved = cut(resolved)
        resolved = resolved.unionByName(_below(gone, resolved))
    return cut(resolved)


def _cycle_nodes(links: DataFrame, merge_rows: int) -> DataFrame:
    """(node, cycle_id, cycle_size) of the nodes on cycles, of links all of which run into one.

    Few links are walked in one task; of many, the nodes on cycles are the image of the parent function applied 2^k >= n
    times, by k joins.
    """
    rows = links.count()
    if rows <= merge_rows:

        def on_cycle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parent: dict[str, str] = {}
            for b in batches:
                parent.update(zip(b["node"], b["top"]))
            walk: dict[str, str] = {}
            found: list[tuple[str, str, int]] = []
            for start in parent:
                at = start
                while at not in walk:
                    walk[at] = start
                    at = parent[at]
                if walk[at] == start:  # a ring no walk before has met
                    ring, x = [at], parent[at]
                    while x != at:
                        ring.append(x)
                        x = parent[x]
                    least = min(ring)
                    found += [(n, least, len(ring)) for n in ring]
            yield pd.DataFrame(found, columns=["node", "cycle_id", "cycle_size"])

        return links.select("node", "top").repartition(1).mapInPandas(on_cycle, "node string, cycle_id string, cycle_size bigint")
    walk = cut(links.select("node", "top", F.least("node", "top").alias("low")))
    span = 1
    while span < rows:
        nxt = walk.select(F.col("node").alias("top"), F.col("top").alias("t2"), F.col("low").alias("l2"))
        walk = cut(walk.join(nxt, "top").select("node", F.col("t2").alias("top"), F.least("low", "l2").alias("low")))
        span *= 2
    ring = walk.select(F.col("top").alias("node")).distinct().join(walk.select("node", F.col("low").alias("cycle_id")), "node")
    return ring.join(ring.groupBy("cycle_id").agg(F.count("*").alias("cycle_size")), "cycle_id").select("node", "cycle_id", "cycle_size")


def _paths(trees: DataFrame, tops: DataFrame, looped: DataFrame) -> DataFrame:
    """(node, up): the names from each node that has a root up to below that root."""
    solid = trees.where("not looped").join(looped, "node", "left_anti").select("node", "top", "seg")
    index = solid.join(tops, "node", "left_semi")
    inner = index.select(F.col("node").alias("top"), F.lit(True).alias("open"))
    index = cut(index.join(inner, "top", "left").select("node", "top", "seg", F.coalesce("open", F.lit(False)).alias("open")))
    known = lambda: index.select(F.col("node").alias("top"), F.col("top").alias("t2"), F.col("seg").alias("s2"), F.col("open").alias("more"))
    longer = F.concat("seg", F.coalesce("s2", F.array().cast("array<string>")))
    while index.where("open").limit(1).count():
        index = cut(index.where("not open").unionByName(index.where("open").join(known(), "top").select("node", F.col("t2").alias("top"), longer.alias("seg"), F.col("more").alias("open"))))
    return solid.join(known(), "top", "left").select("node", longer.alias("up"))


def hierarchy(links: DataFrame, child: str, parent: str, merge_rows: int = MERGE_ROWS, paths: bool = True) -> DataFrame:
    """The whole forest of ``links``: (node, parent, root, depth, path, on_cycle, leads_to_cycle, cycle_id, cycle_size).

    ``links`` needs the two named columns; others are ignored. One row comes out per distinct name among children and
    parents. ``path`` runs from the root to the node (null for all without ``paths``); depth is its number of links, 0 for
    a root. A child with several different parents keeps the greatest in string order, repeated links count once; rows
    with a null child or a null parent make no link (a null parent still makes its child a node). A node on a cycle, or
    below one, has null root, depth and path; ``cycle_id`` is the least name of the cycle the node is on. An empty input
    gives no rows.
    """
    pairs = links.select(F.col(child).alias("node"), F.col(parent).alias("top")).where(F.col("node").isNotNull())
    flat = cut(pairs.groupBy("node").agg(F.max("top").alias("top")))
    up = flat.where(F.col("top").isNotNull())
    trees = cut(up.select("node", "top", F.lit(1).cast("long").alias("off")).mapInPandas(_forests(paths), _TREE + (", seg array<string>" if paths else "")))
    tops = trees.where("not looped").select(F.col("top").alias("node")).distinct()
    merged = _merge(trees.select("node", "top", "off", "looped").join(tops, "node", "left_semi"), merge_rows)
    whole = cut(_below(trees.select("node", "top", "off", "looped"), merged)).select("node", F.col("top").alias("root"), F.col("off").alias("depth"), "looped")
    looped = whole.where("looped").select("node")
    rings = _cycle_nodes(up.join(looped, "node", "left_semi"), merge_rows)
    if paths:
        whole = whole.join(_paths(trees, tops, looped), "node", "left")
    else:
        whole = whole.withColumn("up", F.lit(None).cast("array<string>"))
    names = flat.select("node").unionByName(up.select(F.col("top").alias("node"))).distinct()
    ok = ~F.coalesce("looped", F.lit(False))
    path = F.reverse(F.concat(F.coalesce("up", F.array().cast("array<string>")), F.array(F.coalesce("root", "node")))) if paths else F.col("up")
    return (
        names.join(up.withColumnRenamed("top", "parent"), "node", "left")
        .join(whole, "node", "left")
        .join(rings, "node", "left")
        .select(
            "node",
            "parent",
            F.when(ok, F.coalesce("root", "node")).alias("root"),
            F.when(ok, F.coalesce("depth", F.lit(0))).alias("depth"),
            F.when(ok, path).alias("path"),
            F.col("cycle_id").isNotNull().alias("on_cycle"),
            (~ok).alias("leads_to_cycle"),
            "cycle_id",
            "cycle_size",
        )
    )


def descendants(forest: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for each node of ``hierarchy`` and each node above it; none for cycles."""
    steps = forest.where(F.col("path").isNotNull()).select("node", "depth", F.posexplode("path").alias("pos", "ancestor"))
    return steps.where(F.col("pos") < F.col("depth")).select("ancestor", F.col("node").alias("descendant"), (F.col("depth") - F.col("pos")).alias("distance"))


def current_bases(classes: DataFrame) -> DataFrame:
    """(name, base): for each class name the base of its latest ``scanned_at`` row that has one, deleted or not.

    Names without any base come with null. Ties go to the later ``loaded_at``, then the greater id, then base. Rows
    without a name are left out; a null ``scanned_at`` counts as earliest.
    """
    from ..functions.names import named

    rows = classes.select(named(F.col("name")).alias("name"), named(F.col("base_class")).alias("base"), "scanned_at", "loaded_at", "class_id").where(F.col("name").isNotNull())
    best = F.max_by("base", F.when(F.col("base").isNotNull(), F.struct(F.coalesce("scanned_at", F.lit("0001-01-01").cast("timestamp")), F.col("loaded_at"), F.col("class_id"), F.col("base"))))
    return rows.groupBy("name").agg(best.alias("base"))
