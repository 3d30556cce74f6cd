import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing


def mixed(spark, docs, targets, **kw):
    sizes = spark.createDataFrame(docs, "doc long, source string, tokens long")
    return mixing.mix(sizes, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), **kw)


DOCS = [(i, "big", 10 + i % 7) for i in range(900)] + [(1000 + i, "mid", 20) for i in range(150)] + [(2000 + i, "small", 15) for i in range(40)] + [(3000, "other", 50), (3001, None, 50), (3002, "big", 0)]
TARGETS = [("Big", 0.5, 1), ("mid", 0.3, 3), ("small ", 0.2, 8), ("absent", 0.1, 4)]


@pytest.mark.parametrize("bucket_rows", [20_000, 30])
def test_shares_and_repeats(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    copies, shares = mixed(spark, DOCS, TARGETS)
    rows, report = copies.collect(), {r.source: r for r in shares.collect()}
    size = Counter()
    for r in rows:
        size[r.source] += r.tokens
    total = sum(size.values())
    for source, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert size[source] / total == pytest.approx(share, abs=0.004)
        assert report[source].actual_share == pytest.approx(size[source] / total)
        assert report[source].tokens == size[source]
    assert report["absent"].actual_share == 0 and report["absent"].copies == 0
    used = Counter((r.source, r.doc) for r in rows)
    assert all(n <= {"big": 1, "mid": 3, "small": 8}[s] for (s, _), n in used.items())
    assert len({(r.doc, r.repeat) for r in rows}) == len(rows)
    for source in ("mid", "small"):  # passes are whole before a new one begins
        counts = [used[source, d] for d, s, _ in DOCS if s == source]
        assert max(counts) - min(counts) <= 1
    assert [(r.position, r.doc) for r in rows] == sorted((r.position, r.doc) for r in rows)
    assert all(0 <= r.position <= 1 for r in rows)


@pytest.mark.parametrize("schedules", [{"Big": [1.4, 0.6], "mid": [0.5, 1.5]}, {"big": [2, 1, 0.5, 1], "mid": [0, 1, 0, 3], "small": [1, 1, 5, 0.2]}])
def test_positions_follow_the_schedule(spark, schedules):
    copies, _ = mixed(spark, DOCS, TARGETS, schedules=schedules)
    low = {k.lower(): v for k, v in schedules.items()}
    names, shares = ["big", "mid", "small"], np.array([0.5, 0.3, 0.2])
    even = [1.0] * len(next(iter(low.values())))
    weights = mixing.fitted(np.array([low.get(s, even) for s in names], float), shares)
    grid, knots = np.linspace(0, 1, 4001), np.linspace(0, 1, weights.shape[1])
    dense = np.array([np.interp(grid, knots, w) for w in weights])
    assert dense.sum(axis=0) == pytest.approx(1, abs=1e-6) and np.trapezoid(dense, grid, axis=1) == pytest.approx(shares, abs=1e-4)
    by = defaultdict(list)
    for r in copies.collect():
        by[r.source].append(r)
    for k, source in enumerate(names):
        demand = np.concatenate([[0], np.cumsum((dense[k, 1:] + dense[k, :-1]) / 2 / 4000)]) / shares[k]
        done, want = 0, sum(r.tokens for r in by[source])
        for r in by[source]:  # in order of position the source's demand at each position is what came before
            assert want * np.interp(r.position, grid, demand) == pytest.approx(done + r.tokens / 2, abs=25)
            done += r.tokens


def test_schedules_that_cannot_be(spark):
    with pytest.raises(ValueError):
        mixing.plan({"a": (10, 1), "b": (10, 1)}, [("a", 0.5, 1), ("b", 0.5, 1)], schedules={"a": [1, 0], "b": [1, 0]})
    with pytest.raises(ValueError):
        mixing.plan({"a": (10, 1)}, [("a", 0.5, 1)], schedules={"a": [1, -1]})


def test_binding_source(spark):
    _, shares = mixed(spark, DOCS, TARGETS)
    assert [r.source for r in shares.collect() if r.binding] == ["big"]
    assert mixing.plan({}, [("a", 0.5, 1)])[0]["binding"] is False


def test_scarce_sources_fall_short(spark):
    copies, shares = mixed(spark, DOCS, TARGETS, total=40_000)
    report = {r.source: r for r in shares.collect()}
    assert report["big"].repeats == 1 and report["big"].documents == 900
    assert report["mid"].tokens == 150 * 20 * 3 and report["small"].tokens <= 40 * 15 * 8


def test_edges(spark):
    copies, shares = mixed(spark, [], TARGETS)
    assert copies.count() == 0 and [r.actual_share for r in shares.collect()] == [0.0] * 4
    copies, shares = mixed(spark, DOCS, [])
    assert copies.count() == 0 and shares.count() == 0
    copies, _ = mixed(spark, [(1, "a", 5), (1, "a", 5)], [("a", 1.0, 2)])
    assert copies.count() == 4  # repeated rows are documents of their own
    with pytest.raises(ValueError):
        mixing.plan({"a": (10, 1), "b": (10, 1)}, [("a", 0.5, 1), ("b", 0.5, 1)], schedules={"a": [1, 2], "b": [1, 2, 3]})


def test_source_names(spark):
    df = spark.createDataFrame([("Fan-Relay",), (" fan_relay",), ("FAN RELAY",), ("",), (None,), (" - ",)], "s string")
    assert [r[0] for r in df.select(mixing.source_name(F.col("s"))).collect()] == ["fan_relay"] * 3 + [None] * 3


def test_sizes_from_text(spark):
    df = spark.createDataFrame([(1, "hello world", "A"), (2, None, "a"), (3, "", None)], "doc_id long, text string, source string")
    assert sorted((r.doc, r.source, r.tokens) for r in mixing.sized(df, "doc_id", "text", "source").collect()) == [(1, "a", 2), (2, "a", 0), (3, None, 0)]
    assert math.isclose(sum(p["want"] for p in mixing.plan({"a": (100, 3)}, [("a", 0.2, 2)])), 200)
