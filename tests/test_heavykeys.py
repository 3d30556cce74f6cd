import random
from collections import Counter

import pytest

from millrace.operators import heavykeys
from millrace.operators.heavykeys import callee_chunks, callee_sets, chunked, heavy_keys, key_sizes


def test_chunks_are_exact(spark):
    data = [("hot", i) for i in range(5000)] + [(f"k{i % 40}", i) for i in range(400)] + [(None, i) for i in range(2500)] + [("", 1)]
    df = spark.createDataFrame(data, "k string, v long").repartition(7)
    got = chunked(df, "k", chunk_rows=1000).collect()
    assert Counter(r.k for r in got) == Counter(k for k, _ in data)
    for key, n in (("hot", 5000), (None, 2500)):
        assert sorted(r.row_no for r in got if r.k == key) == list(range(n))
        sizes = Counter(r.chunk for r in got if r.k == key)
        assert sizes == {c: min(1000, n - 1000 * c) for c in range(-(-n // 1000))}
    assert {r.chunk for r in got if r.k not in ("hot", None)} == {0}
    assert {(r.k, r.v) for r in got} == set(data)


def test_joined_offsets_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([("a", i) for i in range(3000)] + [("b", 1)], "k string, v long").repartition(5)
    monkeypatch.setattr(heavykeys, "BROADCAST_OFFSETS", 0)
    assert sorted(r.row_no for r in chunked(df, "k", chunk_rows=1000).where("k = 'a'").collect()) == list(range(3000))


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([("a", (i * 7919) % 5003) for i in range(5003)] + [("b", i) for i in range(30)], "k string, v long").repartition(6)
    got = [r for r in chunked(df, "k", ["v"], 500).collect() if r.k == "a"]
    assert all(r.row_no == r.v and r.chunk == r.v // 500 for r in got) and len(got) == 5003


@pytest.mark.parametrize("broadcast", [50_000, 0])
@pytest.mark.parametrize("chunk_rows", [7, 100, None])
def test_states_merge_over_chunk_boundaries(spark, monkeypatch, chunk_rows, broadcast):
    monkeypatch.setattr(heavykeys, "BROADCAST_OFFSETS", broadcast)
    rng = random.Random(3)
    sites = [(i * rng.randrange(1, 9) + 10**6 * i, rng.choice("AAAAAB") if rng.random() < 0.97 else None, rng.choice(["f", "f", "f", "g", None])) for i in range(1500)]
    want: dict = {}
    for site, cls, callee in sorted(sites):
        if cls is not None and callee is not None:
            n, low, high, gap = want.get((cls, callee), (0, site, site, 0))
            want[cls, callee] = (n + 1, low, site, max(gap, site - high))
    calls = spark.createDataFrame(sites + sites[:40], "site_id long, caller_class string, callee string").repartition(5)
    got = {(r.caller_class, r.callee): (r.n_sites, r.first_site, r.last_site, r.longest_gap) for r in callee_sets(callee_chunks(calls, chunk_rows)).collect()}
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v long")
    assert chunked(df, "k").count() == 0
    assert key_sizes(chunked(df, "k"), "k").count() == 0


def test_callers(spark, rows):
    calls = spark.createDataFrame(
        [(1, "A", "f", "c"), (1, "A", "f", "c"), (2, "N.A<int>", "g", "c"), (3, "", "f", "c"), (4, None, "h", "c"), (5, "A", None, "c"), (None, "A", "z", "c"), (6, "A", "f", "c")],
        "site_id long, caller_class string, callee string, chunk string",
    )
    chunks = callee_chunks(calls)
    assert rows(callee_sets(chunks)) == [("", "f", 1, 3, 3, None), ("A", "f", 2, 1, 6, 5), ("A", "g", 1, 2, 2, None)]
    assert rows(key_sizes(chunks, "caller_class"), "caller_class", "n_rows") == [(None, 1), ("", 1), ("A", 4)]
    assert rows(heavy_keys(chunks, "caller_class", 0.5), "caller_class") == [("A",)]
