import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators.forest import current_bases, descendants, hierarchy, local_forest


def brute(links):
    """(root, depth, path) of acyclic nodes and the nodes on cycles, by walking."""
    nodes = set(links) | set(links.values())
    trees, ring = {}, set()
    for n in nodes:
        path, at = [n], n
        while at in links and links[at] not in path:
            at = links[at]
            path.append(at)
        if at not in links:
            trees[n] = (at, len(path) - 1, path[::-1])
        elif links[at] == n:
            ring.add(n)
    return nodes, trees, ring


def check(spark, links, **kw):
    df = spark.createDataFrame([(c, p, 1) for c, p in links.items()], "c string, p string, node int")
    got = {r.node: r for r in hierarchy(df, "c", "p", **kw).collect()}
    nodes, trees, ring = brute(links)
    assert set(got) == nodes
    for n, r in got.items():
        assert r.on_cycle == (n in ring)
        assert r.leads_to_cycle == (n not in trees)
        assert (r.root, r.depth, r.path) == trees.get(n, (None, None, None))
        assert r.parent == links.get(n)


@pytest.mark.parametrize("merge_rows", [100_000, 3])
def test_random_forests_with_cycles(spark, merge_rows):
    rng = random.Random(7)
    names = [f"n{i}" for i in range(60)]
    links = {n: rng.choice(names) for n in names if rng.random() < 0.8}
    links |= {"self": "self", "a": "b", "b": "c", "c": "a", "d": "c", "chain0": "chain1"} | {f"chain{i}": f"chain{i + 1}" for i in range(40)}
    check(spark, links, merge_rows=merge_rows)


def test_many_links_over_cycles_and_tails(spark):
    """Levels of merging on rings of 3 and 5 with long tails, and a deep tree: nothing grows, all comes out."""
    links = {}
    for i in range(1000):
        k = 3 if i % 2 else 5
        links |= {f"r{i}_{j}": f"r{i}_{(j + 1) % k}" for j in range(k)} | {f"r{i}_t{j}": f"r{i}_t{j + 1}" if j < 5 else f"r{i}_0" for j in range(6)}
    links |= {f"c{j}": f"c{j + 1}" for j in range(300)} | {f"w{j}": f"c{j % 300}" for j in range(3000)}
    check(spark, links, merge_rows=500)
    flat = hierarchy(spark.createDataFrame(list(links.items()), "c string, p string"), "c", "p", merge_rows=500, paths=False)
    assert flat.where("path is not null").count() == 0 and flat.where("on_cycle").count() == 4000


def test_levels_use_no_growing_rows(spark):
    rows = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 2033}") for i in range(2033)], "c string, p string").repartition(8)
    got = hierarchy(rows, "c", "p", merge_rows=200)
    assert got.where("on_cycle and cycle_size = 2033 and cycle_id = 'n0' and path is null").count() == 2033


def test_local_forests_are_bounded(spark, monkeypatch):
    from millrace.operators import forest

    monkeypatch.setattr(forest, "LOCAL_LINKS", 7)
    check(spark, {f"n{i}": f"n{i + 1}" for i in range(60)} | {"x": "y", "y": "x"}, merge_rows=5)


def test_empty_null_and_repeated_links(spark, rows):
    empty = spark.createDataFrame([], "c string, p string")
    assert hierarchy(empty, "c", "p").count() == 0
    df = spark.createDataFrame([("a", None), ("b", "a"), ("b", "a"), (None, "x"), ("b", None), ("t", "u"), ("t", "v")], "c string, p string")
    assert rows(hierarchy(df, "c", "p"), "node", "root", "depth") == [("a", "a", 0), ("b", "a", 1), ("t", "v", 1), ("v", "v", 0)]


def test_descendants(spark, rows):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "x")], "c string, p string")
    assert rows(descendants(hierarchy(df, "c", "p"))) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def test_current_bases(spark, rows):
    df = spark.createDataFrame(
        [
            ("A", "Old", "2024-01-01", None, 1), ("A", "N.New<int>", "2024-02-01", None, 2), ("A", None, "2024-03-01", None, 3), ("A", " ", "2024-04-01", None, 4),
            ("B", "P", None, None, 5), ("C", None, "2024-01-01", None, 6), (None, "P", "2024-01-01", None, 7), ("D", "X", "2024-01-01", "2024-01-02", 8), ("D", "Y", "2024-01-01", "2024-01-03", 8),
        ],
        "name string, base_class string, scanned_at string, loaded_at string, class_id long",
    )
    df = df.selectExpr("name", "base_class", "timestamp(scanned_at) scanned_at", "timestamp(loaded_at) loaded_at", "class_id")
    assert rows(current_bases(df)) == [("A", "New"), ("B", "P"), ("C", None), ("D", "Y")]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 12).map(str), st.integers(0, 12).map(str), min_size=1))
def test_local_forest_against_walking(links):
    nodes = list(links)
    out = local_forest(nodes, [links[n] for n in nodes], [1] * len(nodes))
    _, trees, _ = brute(links)
    for node, top, off, looped in out:
        assert looped == (node not in trees)
        if not looped:
            assert (top, off) == trees[node][:2]
