import random

from millrace.operators import graphs


def reachable(edges, root, without=None):
    seen, stack = set(), [root] if root != without else []
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            stack += [b for a, b in edges if a == x and b != without]
    return seen


def random_graph(rng):
    n = rng.randrange(3, 10)
    edges = [(i, i + 1) for i in range(n - 1)] + [(rng.randrange(n - 1), rng.randrange(1, n)) for _ in range(rng.randrange(6))]
    return list(range(n)), [e for e in dict.fromkeys(edges) if e[0] != n - 1]


def test_dominators_by_definition():
    rng = random.Random(1)
    for _ in range(60):
        nodes, edges = random_graph(rng)
        dom = graphs.dominators(nodes, edges, 0)
        for v in reachable(edges, 0):
            assert dom[v] == {d for d in nodes if d == v or v not in reachable(edges, 0, d)}


def test_control_dependence_by_definition():
    rng = random.Random(2)
    for _ in range(60):
        nodes, edges = random_graph(rng)
        last = nodes[-1]
        pdom = graphs.dominators(nodes, [(b, a) for a, b in edges], last)
        want = {
            (u, w) for u in nodes for w in nodes if w not in (0, last) and len([1 for a, _ in edges if a == u]) > 1 and any(a == u and w in pdom[b] for a, b in edges) and not (w in pdom[u] and w != u)
        }
        assert graphs.control_dependence(nodes, edges, 0, last) == want


def test_small_shapes():
    # if / else: both branches depend on the condition
    edges = [(0, 2), (2, 4), (4, 3), (2, 5), (5, 3), (3, 1)]
    assert graphs.control_dependence(range(6), edges, 0, 1) == {(2, 4), (2, 5)}
    assert graphs.control_dependence(range(6), edges, 0, 1, compat=True) >= {(2, 4), (2, 5)}
    assert graphs.hammocks(list(range(6)), edges, 0, 1) == [(2, 3, [2, 4, 5])]
    assert graphs.hammocks([0, 1, 2, 3], [(0, 2), (2, 3), (3, 1)], 0, 1) == []
    assert graphs.hammocks([0, 1, 2, 3, 4], [(0, 2), (2, 3), (3, 4), (4, 1)], 0, 1) == [(2, 4, [2, 3])]
    assert graphs.control_dependence(range(4), [(0, 2), (2, 3), (3, 1)], 0, 1) == set()


def test_reaching_definitions():
    edges = [(0, 1), (1, 2), (2, 1), (1, 3)]
    got = graphs.reaching_definitions([0, 1, 2, 3], edges, {0: {"x"}, 2: {"x"}}, {1: {"x"}, 3: {"x"}})
    assert got == {(0, 1, "x"), (2, 1, "x"), (0, 3, "x"), (2, 3, "x")}


def test_relations(spark):
    blocks = spark.createDataFrame([("f", m, i, k, i, i) for m in (0, 1) for i, k in enumerate(["Entry", "Exit", "Condition", "Statement", "Statement", "Statement"])], "file string, method_ord int, id int, kind string, start_line int, end_line int")
    edges = spark.createDataFrame([("f", m, a, b, "Seq") for m in (0, 1) for a, b in [(0, 2), (2, 4), (4, 3), (2, 5), (5, 3), (3, 1)]], "file string, method_ord int, src int, dst int, kind string")
    assert sorted(tuple(r) for r in graphs.control_dependences(blocks, edges).collect()) == [("f", m, 2, x) for m in (0, 1) for x in (4, 5)]
    assert {(r.header, r.footer, tuple(r.body)) for r in graphs.regions(blocks, edges).collect()} == {(2, 3, (2, 4, 5))}
    assert graphs.dependence_graph(blocks, edges).where("kind = 'cfg(Seq)'").count() == 12
    lines = spark.createDataFrame([("f", 5)], "file string, line int")
    got = graphs.control_context(blocks, edges, lines).collect()
    assert [(r.id, r.conditions) for r in got] == [(5, ["Condition [L2]"])]
    sources = spark.createDataFrame([("f", "\nx\nx = 1;\ny = x;\nz = x + y;\n")], "file string, text string")
    flow = graphs.data_dependences(blocks.where("method_ord = 0"), edges.where("method_ord = 0"), sources)
    assert ("f", 0, 2, 4, "x") not in [tuple(r) for r in flow.collect()]
    assert graphs.dominator_pairs(blocks.limit(0), edges.limit(0)).count() == 0
