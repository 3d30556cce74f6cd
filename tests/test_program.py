import glob
import os

import pytest

import __spark_entry__
from millrace.operators import fixpoint, navigate, render
from millrace.operators.facts import Facts

DATA = "/root/testdata/sf0.001"
CHECKED = [
    "p1_found", "p1_hierarchy", "p1_descendants", "p2_found", "p2_report", "p4_found", "p4_class_callees", "p5_found", "p5_report", "OP-F10_inheritance", "OP-F15_callee_binding", "OP-H3_concrete_subtypes", "OP-H7_subtypes",
    "OP-R1_call_targets", "OP-R5_abstract", "OP-R9_di", "OP-R17_best", "OP-D6_composite", "OP-D12_strategy_command_state", "OP-D0_all", "OP-A3_call_tree", "OP-A5_summary", "OP-A8_impact_nodes", "OP-A12_A13_diff", "OP-N2_down", "OP-N6_up",
    "OP-G1_dominators", "OP-G9_control_dependence", "OP-U5_paths",
]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    cur = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in df.collect()) == want


def test_every_check_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_reach_and_walks(spark, rows):
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("x", "y", 1), ("y", "x", 1), ("y", "c", 1), (None, "c", 1)], "src string, dst string, n int")
    assert rows(fixpoint.reach(edges, spark.createDataFrame([("a",), ("a",), (None,)], "node string"))) == [("a", 0), ("b", 1), ("c", 1)]
    got = {r.node: r.walks for r in fixpoint.walk_counts(edges.where("src in ('a', 'b')"), "c").collect()}
    assert {k: int(v) for k, v in got.items()} == {"a": 0, "b": 2, "c": 4}
    assert {r.node: r.walks for r in fixpoint.walk_counts(edges.where("src is not null"), "c").collect()}["c"] is None  # walks round x and y never end


def test_too_many_walks_are_null(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 10**9) for i in range(6)], "src string, dst string, n long")
    got = {r.node: r.walks for r in fixpoint.walk_counts(chain, "n6").collect()}
    assert int(got["n1"]) == 10**9 and int(got["n4"]) > 10**36 and got["n5"] is None and got["n6"] is None


def test_actions():
    parse = navigate.parse_action
    assert [parse(x) for x in ("q", "h", "d", "c p", "c  u", "3", "2b", "u1", "u12a", "c x", "", "u")] == [
        ("quit", ()), ("history", ()), ("discard", ()), ("judge", ("pattern",)), ("judge", ("unclear",)), ("down", (3, "")), ("down", (2, "b")), ("up", (1, "")), ("up", (12, "a")), ("unknown", ()), ("unknown", ()), ("unknown", ()),
    ]


@pytest.fixture(scope="module")
def facts(spark):
    from millrace.sources.csharp import frontend

    code = """class Shop { IStore s; public void Sell(Item i) { s.Put(i); Note(); } void Note() { Log.Write(1); } public void get_X() {} }
    class Market { void Sell(Item i) { Outside.Go(); } }
    interface IStore { void Put(Item i); } class Disk : IStore { public void Put(Item i) { } } class Ram : IStore { public void Put(Item i) { } } class Item { }"""
    return frontend.facts_of(frontend.parse(spark.createDataFrame([("a.cs", code)], "file string, text string"))).settled()


def test_session(facts):
    assert isinstance(facts, Facts)
    walk = navigate.Session.begin(facts, "sho")
    assert walk.current == ("Shop", "Sell") and walk.queue == [("Shop", "Note")]
    assert [(r.callee, r.kind) for r in walk.below()] == [("Note", "Direct"), ("Put", "Interface")]
    assert walk.step("2b") == "Ram.Put" and walk.step("9") == "no such edge" and walk.step("z") == "unknown action"
    assert walk.step("h") == "down from Shop.Sell"
    assert walk.step("c p") == "Shop.Note" and walk.judged == {"Ram": "pattern"}
    assert walk.step("u1") == "Shop.Sell"
    assert walk.step("d") == "done"
    with pytest.raises(ValueError, match="no class is like"):
        navigate.start(facts, "Nothing")
    with pytest.raises(ValueError, match="several"):
        navigate.start(facts, "a")


def test_dispatch(facts):
    got = {tuple(r) for r in navigate.dispatch_sources(facts).collect()}
    assert ("Shop", "Sell", "Market", "Sell") in got


def test_drawings():
    assert 'label="B.g (affects 2 sites)", style=filled, fillcolor=lightcoral, penwidth=2' in render.impact_dot([("A.f", 1), ("B.g", 2)], [("A.f", "B.g")], "B.g")
    assert "CALLERS CHANGED" in render.diff_dot([("A.f", "callers_changed")]) and "lightyellow" in render.diff_dot([("A.f", "callers_changed")])
    blocks, edges = [(0, "Entry", 1, 2), (1, "Exit", 1, 2), (2, "Statement", 2, 2)], [(0, 1, "control"), (0, 2, "cfg(Seq)"), (2, 1, "data")]
    assert 'n0 -> n1 [label="control"];' in render.pdg_dot(blocks, edges)
    drawn = render.pdg_drawing(blocks, edges, "Shop")
    assert drawn.startswith("digraph PDG {\n  rankdir=TB;\n  node [shape=box style=rounded];\n\n  label=\"Shop\";") and 'n0 [label="L1-2:Entry" style=filled fillcolor=green];' in drawn and "fillcolor=red" in drawn
    assert "n0 -> n1 [style=dashed color=red];" in drawn and "n2 -> n1 [style=dotted color=blue];" in drawn and "n0 -> n2 [style=solid color=black];" in drawn
    assert render.pdg_lines(blocks, edges, "  ").splitlines()[0].startswith("  n0 [")
    assert render.routes_text([("", "GET", "/x", "h")]).splitlines() == ["(top-level)", "   GET  /x                              h"]
    assert render.snippet("a\nb\nc", 2, 9) == "│    2 b\n│    3 c"
