"""Reachability and walk counts over edges, as loops over a frontier; cycles end.

Graphs of few edges go through all rounds in one task; of larger ones every round is a join. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard, stored

#: Rounds after which a loop gives up with an error; a guard against edges that never end, not a limit on results.
MAX_ROUNDS = 10_000
#: Edges that one task may walk, each three numbers, so about 200 MB with the names of their nodes at most.
LOCAL_EDGES = 2_000_000


class _Graph:
    """The edges of one task by number of node, in the order of their sources; rows without a source name a node only."""

    def __init__(self, batches: Iterator[pd.DataFrame]) -> None:
        self.number: dict[str, int] = {}
        parts: list[tuple[np.ndarray, ...]] = []
        alone: list[np.ndarray] = []
        for b in batches:
            src, dst = self._numbers(b["src"]), self._numbers(b["dst"])
            edge = src >= 0
            parts.append((src[edge], dst[edge], b["n"].to_numpy(np.int64)[edge] if "n" in b else np.ones(int(edge.sum()), np.int64)))
            alone.append(dst[~edge])
        none = np.zeros(0, np.int64)
        src, self.dst, self.n = (np.concatenate([none, *x]) for x in (zip(*parts) if parts else ((), (), ())))
        self.alone = np.unique(np.concatenate([none, *alone]))
        self.names = list(self.number)
        order = np.argsort(src, kind="stable")
        self.dst, self.n = self.dst[order], self.n[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(self.names)))]).astype(np.int64)

    def _numbers(self, names: pd.Series) -> np.ndarray:
        code, distinct = pd.factorize(names)
        known = np.array([self.number.setdefault(x, len(self.number)) for x in distinct] + [-1], np.int64)
        return known[code]

    def after(self, nodes: np.ndarray) -> np.ndarray:
        """The distinct nodes one step after ``nodes``."""
        first, size = self.first[nodes], self.first[nodes + 1] - self.first[nodes]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(nodes) else np.zeros(0, np.int64)
        return np.unique(self.dst[at])


def _reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Levels of all nodes from the edges of one task; rows without a source are seeds."""
    g = _Graph(batches)
    level = np.full(len(g.names), -1, np.int32)
    frontier, k = g.alone, 0
    level[frontier] = 0
    while len(frontier):
        k += 1
        frontier = g.after(frontier)
        frontier = frontier[level[frontier] < 0]
        level[frontier] = k
    found = np.flatnonzero(level >= 0)
    yield pd.DataFrame({"node": pd.Series([g.names[i] for i in found], dtype=object), "level": level[found]})


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, level): the nodes reached from ``seeds`` (node) along ``edges`` (src, dst), seeds at level 0.

    Edges and seeds with a null are left out. Each round joins the last frontier only, and only nodes not seen before go
    on; lineage is cut every round.
    """
    edges = stored(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct(), "edges")
    seeds = seeds.select("node").where(F.col("node").isNotNull()).distinct()
    if edges.count() <= LOCAL_EDGES:
        rows = edges.unionByName(seeds.select(F.lit(None).cast("string").alias("src"), F.col("node").alias("dst")))
        return rows.repartition(1).mapInPandas(_reach, "node string, level int")
    frontier = cut(seeds.withColumn("level", F.lit(0)))
    seen, level = frontier, 0
    while frontier.limit(1).count():
        level += 1
        if level > MAX_ROUNDS:
            raise RuntimeError("no fixpoint")
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level)))
        seen = cut(seen.unionByName(frontier)) if level % 8 == 0 else seen.unionByName(frontier)
    return seen


def _walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks into every node whose incoming walks end, as text, from the edges of one task; rows without a source are nodes."""
    g = _Graph(batches)
    missing = np.bincount(g.dst, minlength=len(g.names)).tolist()
    first, dst, n = g.first.tolist(), g.dst.tolist(), g.n.tolist()
    total = [0] * len(g.names)
    ready = [k for k, m in enumerate(missing) if m == 0]
    done: list[int] = []
    while ready:
        src = ready.pop()
        done.append(src)
        walks = 1 + total[src]
        for e in range(first[src], first[src + 1]):
            total[dst[e]] += n[e] * walks
            missing[dst[e]] -= 1
            if missing[dst[e]] == 0:
                ready.append(dst[e])
    # what has more digits than the result holds is not written out
    text = [str(total[k]) if total[k] < 10**39 else None for k in done]
    yield pd.DataFrame({"node": pd.Series([g.names[k] for k in done], dtype=object), "walks": pd.Series(text, dtype=object)})


def walk_counts(edges: DataFrame, target: str, within: DataFrame | None = None) -> DataFrame:
    """(node, walks DECIMAL(38,0)): for each node that reaches ``target``, the walks that end in it.

    ``edges``: (src, dst, n) with n parallel edges. T(node) is the sum over edges into the node of n * (1 + T(src)),
    worked out from the nodes without edges into them; nodes that a cycle leads to have endless walks and get null, and
    so do nodes with more walks than 38 digits hold. ``within`` (node): the nodes that reach the target, if known.
    """
    spark = edges.sparkSession
    if within is None:
        within = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), spark.createDataFrame([(target,)], "node string"))
    within = cut(within.select("node"))
    inner = stored(edges.join(within.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy("src", "dst").agg(F.sum("n").alias("n")), "inner")
    if inner.count() <= LOCAL_EDGES:
        rows = inner.unionByName(within.select(F.lit(None).cast("string").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("long").alias("n")))
        known = rows.repartition(1).mapInPandas(_walks, "node string, walks string")
        return within.join(known, "node", "left").select("node", F.expr("try_cast(walks as decimal(38,0))").alias("walks"))
    # every node waits for the edges into it; only edges out of the nodes done last are joined in a round
    zero = F.lit(0).cast("decimal(38,0)")
    waits = inner.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("missing"))
    state = stored(within.join(waits, "node", "left").select("node", F.coalesce("missing", F.lit(0)).alias("missing"), zero.alias("walks"), F.lit(False).alias("big")), "state")
    done, rounds = [], 0
    while True:
        fresh = state.where("missing = 0").select("node", F.when(~F.col("big"), F.col("walks")).alias("walks"))
        if not fresh.limit(1).count():
            break
        if (rounds := rounds + 1) > MAX_ROUNDS:
            raise RuntimeError("no fixpoint")
        done.append(stored(fresh, "walks"))
        met = inner.join(done[-1].withColumnRenamed("node", "src"), "src")
        term = F.try_multiply(F.col("n").cast("decimal(20,0)"), F.try_add("walks", F.lit(1).cast("decimal(1,0)")))
        come = met.select(F.col("dst").alias("node"), term.alias("term")).groupBy("node").agg(F.count("*").alias("k"), F.bool_or(F.col("term").isNull()).alias("over"), F.try_sum("term").alias("sum"))
        both = F.expr("try_cast(try_add(walks, coalesce(sum, 0)) as decimal(38,0))")
        late = F.col("k").isNotNull() & (F.coalesce("over", F.lit(False)) | F.col("sum").isNull() | both.isNull())
        last = state
        state = stored(
            state.where("missing > 0").join(come, "node", "left").select("node", (F.col("missing") - F.coalesce("k", F.lit(0))).alias("missing"), F.coalesce(both, zero).alias("walks"), (F.col("big") | late).alias("big")),
            "state",
        )
        discard(last)  # the next state holds all that is still needed of it
    known = spark.createDataFrame([], "node string, walks decimal(38,0)")
    for part in done:
        known = known.unionByName(part)
    return within.join(known, "node", "left")
