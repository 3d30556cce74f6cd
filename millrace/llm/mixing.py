"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Every source has a weight schedule: weights at equally spaced knots, linear between them.
Schedules are scaled, by turns, until the weights sum to 1 at every knot (so at any time) and each source's weight,
integrated over time, is its target share. Integrated up to t, a schedule is the source's cumulative token demand. Its
documents are laid end to end in hash order, pass after pass; inverting the demand at the middle of each copy gives the
copy's position, and a range sort by position gives the training order. Running sizes come from sums of hash buckets and
a window within each bucket, so no source, however large, is summed in one task.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import tokens

#: Most rows of targets; the plan is made from them on the driver.
MAX_SOURCES = 10_000
#: Documents per bucket of a running sum, on average.
BUCKET_ROWS = 20_000
#: Bucket sums are broadcast up to this many rows; beyond, they are joined.
BROADCAST_BUCKETS = 50_000


def source_name(source: Column) -> Column:
    """A source's name however spelt: lower case, hyphens and blanks as underscores, none outside; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(source), r"[\s\-_]+", "_"), "^_|_$", ""), F.lit(""))


def source_key(source: str) -> str:
    """``source_name`` of a string."""
    return re.sub(r"^_|_$", "", re.sub(r"[\s\-_]+", "_", source.lower()))


def sized(documents: DataFrame, key: str, text: str, source: str, name: str = "byte_bpe_50k.json", folder: str = tokens.TOKENIZERS) -> DataFrame:
    """(doc, source, tokens) of every document, stored: its size in tokens of the public tokenizer ``name``."""
    counted = tokens.count(documents, text, "tokens", name, folder, keep=(key, source))
    return stored(counted.select(F.col(key).alias("doc"), source_name(F.col(source)).alias("source"), "tokens"), "sizes")


def fitted(shapes: np.ndarray, shares: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weights (sources x knots) that sum to 1 at each knot and whose integrals are the shares, scaled from ``shapes``."""
    knots = shapes.shape[1]
    each = np.full(knots, 1.0 / (knots - 1))
    each[[0, -1]] /= 2  # the trapezoid rule is exact for linear pieces
    w = shapes * (shares / np.maximum(shapes @ each, 1e-300))[:, None]
    for _ in range(rounds):
        w = w / np.maximum(w.sum(axis=0), 1e-300)
        off = shares / np.maximum(w @ each, 1e-300)
        w = w * off[:, None]
        if abs(off - 1).max() < 1e-12:
            break
    if abs(w.sum(axis=0) - 1).max() > 1e-6:
        raise ValueError("no weights over time follow the schedules and give the shares: at some time too few sources may be used")
    return w


def plan(have: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], total: int | None = None, schedules: dict[str, list[float]] | None = None) -> list[dict]:
    """What each source gives: tokens wanted, whole passes, the rest, its weights over time, and whether it limits the mix.

    ``have``: tokens and documents per source; ``targets``: (source, share, most repeats). Without ``total`` the mix is
    as large as it can be with every present source at its share; ``binding`` marks the source that runs out first. With
    a larger one, scarce sources (all binding) stop at their most repeats and fall short. Sources without tokens, or with
    a share or repeats of zero, give nothing; shares of the rest are scaled to 1. ``schedules``: for some sources, the
    weights relative to each other at equally spaced times from 0 to 1, all of one length of at least 2, none negative;
    sources without one keep an even weight. By default sources that may repeat come in towards the end.
    """
    merged: dict[str, tuple[float, int]] = {}
    for source, share, most in targets:
        old = merged.get(source, (0.0, 0))
        merged[source] = (old[0] + max(0.0, share or 0.0), max(old[1], int(most or 0)))
    usable = {s: (w, r) for s, (w, r) in merged.items() if w > 0 and r > 0 and have.get(s, (0, 0))[0] > 0}
    norm = sum(w for w, _ in usable.values())
    room = {s: have[s][0] * r / (w / norm) for s, (w, r) in usable.items()}
    if total is None:
        total = int(min(room.values(), default=0))
    given = {s: [0.5, 1.5] for s, (_, r) in usable.items() if r > 1} if schedules is None else schedules
    lengths = {len(v) for v in given.values()} or {2}
    if len(lengths) > 1 or min(lengths) < 2 or any(x < 0 or x != x for v in given.values() for x in v):
        raise ValueError("schedules are lists of one length, at least 2, of weights that are not negative")
    even = [1.0] * lengths.pop()
    names = sorted(usable)
    weights = dict(zip(names, fitted(np.array([given.get(s, even) for s in names], float), np.array([usable[s][0] / norm for s in names])))) if names else {}
    rows = []
    for source, (share, most) in sorted(merged.items()):
        size, docs = have.get(source, (0, 0))
        want = min(total * share / norm, size * most) if source in usable else 0
        passes = int(want // size) if want else 0
        own = weights.get(source, np.array(even)) / (share / norm if source in usable else 1.0)
        cum = np.concatenate([[0.0], np.cumsum((own[1:] + own[:-1]) / 2 / (len(own) - 1))])
        rows.append({
            "source": source, "target_share": share, "max_repeats": most, "size": size, "docs": docs, "want": float(want), "passes": passes, "rest": float(want - passes * size),
            "knots": own.tolist(), "cum": cum.tolist(), "binding": source in usable and room[source] < total + 1,
        })
    return rows


def position(u: Column, knots: Column, cum: Column) -> Column:
    """The time at which a source's cumulative demand is the part ``u`` of its whole."""
    j = F.least(F.size(F.filter(cum, lambda c: c <= u)), F.size(cum) - 1) - 1
    at = lambda a, k: F.get(a, k)
    step = F.lit(1.0) / (F.size(cum) - 1)
    r, v, slope = u - at(cum, j), at(knots, j), (at(knots, j + 1) - at(knots, j)) / step
    root = v + F.sqrt(F.greatest(v * v + 2 * slope * r, F.lit(0.0)))
    return F.least(j * step + F.when(root > 0, 2 * r / root).otherwise(F.lit(0.0)), F.lit(1.0))


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, schedules: dict[str, list[float]] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(copies, shares). copies: (doc, source, repeat, tokens, position), in training order; shares: one row per target.

    ``sizes``: (doc, source, tokens) as of ``sized``; ``targets``: (source, target_share, max_repeats). No document is
    used more often than its source's ``max_repeats``; in the last, partial pass the documents of least hash come, up to
    the nearest whole document. Documents of no target, without source or without tokens are not used. Repeated rows
    are documents of their own. Sources without documents are reported with a share of 0; shares are of what was used.
    ``schedules``: see ``plan``. ``binding`` in the shares marks the source that limits the size of the mix.
    """
    spark = sizes.sparkSession
    rows = targets.select(source_name(F.col("source")).alias("s"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where(F.col("s").isNotNull()).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    wanted = [tuple(r) for r in rows]
    named = {r[0] for r in wanted}
    have = {r["source"]: (r["n"], r["docs"]) for r in sizes.where(F.col("source").isin(sorted(named)) & (F.col("tokens") > 0)).groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")).collect()} if named else {}
    plans = plan(have, wanted, total, {source_key(k): v for k, v in schedules.items()} if schedules is not None else None)
    schema = "source string, target_share double, max_repeats int, size bigint, docs bigint, want double, passes int, rest double, knots array<double>, cum array<double>, binding boolean"
    table = F.broadcast(spark.createDataFrame([tuple(p.values()) for p in plans], schema))

    used = sizes.where(F.col("tokens") > 0).join(table.where("want > 0"), "source")
    items = used.select("doc", "source", "tokens", "size", "docs", "want", "passes", "rest", "knots", "cum", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("repeat"))
    items = items.where((F.col("repeat") < F.col("passes")) | (F.col("rest") > 0))
    hashed = F.xxhash64("doc", "repeat", F.lit(seed))
    place = hashed.cast("double") / F.lit(2.0**64) + F.lit(0.5)
    items = items.withColumn("h", hashed).withColumn("bucket", F.floor(place * F.ceil(F.col("docs") / F.lit(BUCKET_ROWS))))
    ranked = ["source", "repeat", "bucket"]
    buckets = stored(items.groupBy(*ranked).agg(F.sum("tokens").alias("n")), "buckets")
    before = Window.partitionBy("source", "repeat").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(*ranked, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = F.broadcast(starts) if buckets.count() <= BROADCAST_BUCKETS else starts
    inside = Window.partitionBy(*ranked).orderBy("h", "doc").rowsBetween(Window.unboundedPreceding, -1)
    items = items.join(starts, ranked).withColumn("at", F.col("start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    middle = F.col("at") + F.col("tokens") / 2
    chosen = items.where((F.col("repeat") < F.col("passes")) | (middle <= F.col("rest")))
    u = F.least((F.col("repeat") * F.col("size") + middle) / F.col("want"), F.lit(1.0))
    copies = stored(chosen.select("doc", "source", "repeat", "tokens", position(u, F.col("knots"), F.col("cum")).alias("position")), "copies")
    done = copies.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc").alias("documents"), F.count("*").alias("copies"), (F.max("repeat") + 1).alias("repeats"))
    shares = table.join(done, "source", "left").select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), F.lit(0.0)).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("repeats", F.lit(0)).alias("repeats"), "max_repeats", "binding",
    )
    return copies.orderBy("position", "doc", "repeat"), shares
