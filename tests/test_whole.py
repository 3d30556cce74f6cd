"""Operators that did less than the whole job once."""

import io
import json
import os

import pytest

import __spark_entry__
from millrace import cli
from millrace.operators import callgraph, fixpoint, graphs, impact, navigate, pairs, resolve, types
from millrace.operators.facts import from_tables
from millrace.operators.orphans import lifetimes
from millrace.plans import generated, idioms
from millrace.sources.csharp import frontend

from .test_program import DATA, duck, plain  # noqa: F401


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["OP-N6_up", "OP-N7_up_by_class"])
def test_against_sql(spark, duck, name):  # noqa: F811
    df = __spark_entry__.queries()[name](spark, DATA)
    cur = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in cur.fetchall())
    assert want and sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in df.collect()) == want


def test_up_tiers(spark):
    code = """interface IStore { void Put(); void Flush(); } interface IOther { void Rare(); }
    class Disk : IStore { public void Put() { } public void Flush() { } } class Ram : IStore { public void Put() { } public void Flush() { } }
    class User { IStore s; void Go() { s.Put(); Each(Flush); } void Flush() { } } class Lone : IOther { public void Rare() { } public void Quiet() { } }
    class Guess { IOther o; void Try() { o.Rare(); } }"""
    facts = frontend.facts_of(frontend.parse(spark.createDataFrame([("a.cs", code)], "file string, text string"))).settled()
    got = {tuple(r) for r in navigate.up(facts).select("class", "method", "tier", "delegate", "caller_class", "caller_method", "sites").collect()}
    assert ("IOther", "Rare", 0, False, "Guess", "Try", 1) in got  # unresolved, but one class only has the name
    assert not any(r[:2] == ("IStore", "Put") for r in got)  # two classes have it
    assert ("Disk", "Put", 3, False, "User", "Go", 1) in got and ("Ram", "Put", 3, False, "User", "Go", 1) in got
    assert ("Disk", "Flush", 5, False, "IStore", "Flush", 0) in got and ("Disk", "Flush", 5, True, "User", "Go", 1) in got
    assert ("User", "Flush", 2, True, "User", "Go", 1) in got
    assert ("Lone", "Quiet", 5, False, "IOther", "Quiet", 0) in got
    assert {r[:2] for r in got if r[2] == 1} == {("Lone", "Rare")}


def walks_above(edges):
    """The most called node, and for each node above it the walks that end there; None where a cycle leads to it."""
    into, called = {}, {}
    for a, b, n in edges:
        into.setdefault(b, []).append((a, n))
        called[b] = called.get(b, 0) + n
    above, stack = set(), [min(called, key=lambda x: (-called[x], x))]
    while stack:
        x = stack.pop()
        if x not in above:
            above.add(x)
            stack += [a for a, _ in into.get(x, [])]
    counts, changed = {}, True
    while changed:
        ready = [x for x in above - set(counts) if all(a in counts for a, _ in into.get(x, []))]
        counts |= {x: sum(n * (1 + counts[a]) for a, n in into.get(x, [])) for x in ready}
        changed = bool(ready)
    return {x: str(counts[x]) if x in counts else None for x in above}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_walks_over_all_edges(spark):
    edges = [tuple(r) for r in impact.call_edges(from_tables(spark, DATA)).collect()]
    want = walks_above(edges)
    assert len(want) > 1
    queries = __spark_entry__.queries()
    assert {r.node: r.walks for r in queries["OP-A9_walk_counts"](spark, DATA).collect()} == want
    assert {r.id: r.transitive for r in queries["OP-A8_impact_nodes_whole"](spark, DATA).collect()} == want


def test_data_dependence_of_bodies(spark):
    code = """class K { int Go(List<Item> items, int n) {
    int total = 0;
    foreach (var x in items)
    {
        total += x.Weight;
    }
    lock (this) { n =
        total; }
    if (n > 1 &&
        total > 2) { n++; }
    do { total = n; } while (total < 9);
    switch (n) { case 1: int y = 1; Use(y); break; }
    try { n = 3; } catch (E e) { n = 4; }
    return Sum(n,
        total); } }"""
    p = frontend.parse(spark.createDataFrame([("a.cs", code)], "file string, text string"), compat=False)
    blocks = frontend.relation(p, "blocks")
    line = {r.id: (r.start_line, r.kind) for r in blocks.collect()}
    flow = {(line[r.src][0], line[r.dst][0], r.name) for r in graphs.data_dependences(blocks, frontend.relation(p, "edges"), frontend.relation(p, "names")).collect()}
    assert flow >= {(2, 5, "total"), (5, 5, "total"), (3, 5, "x"), (2, 7, "total"), (5, 7, "total"), (5, 9, "total"), (7, 9, "n"), (7, 10, "n"), (11, 11, "total"), (12, 12, "y"), (13, 14, "n"), (11, 14, "total")}
    assert (2, 14, "total") not in flow and (7, 14, "n") not in flow and not any(n == "Weight" for *_, n in flow)


def test_listings_are_whole(spark, tmp_path):
    (tmp_path / "many.cs").write_text("\n".join(f"class C{i:04} {{ }}" for i in range(1203)))
    out = cli.run(spark, cli._parser().parse_args(["parse", str(tmp_path)]))
    assert len(out.splitlines()) == 1203 and '"name":"C1202"' in out


def test_callgraph_of_all_matching_classes(spark, tmp_path):
    (tmp_path / "a.cs").write_text("class ShopA { void Go() { Left(); } void Left() { } }\nclass ShopB { void Run() { Right(); } void Right() { } }\nclass Other { void Do() { ShopB.Right(); Stray(); } void Stray() { } }\n")
    run = lambda *argv: cli.run(spark, cli._parser().parse_args(["callgraph", str(tmp_path), "--class", *argv])).splitlines()
    both = run("shop")
    assert both == ["Outbound calls:", "ShopA  Go  Left  1  ", "ShopB  Run  Right  1  ", "Inbound calls:", "ShopA  Left  ShopA  1  ", "ShopB  Right  Other  1  ShopB", "ShopB  Right  ShopB  1  "]
    assert run("shop", "--outbound") == both[:3] and run("shop", "--inbound") == both[3:]
    traced = run("shop", "--trace", "--outbound")
    assert any("ShopA.Left" in x for x in traced) and any("ShopB.Right" in x for x in traced)
    assert run("nothing") == ["No class found matching 'nothing'", "  Other", "  ShopA", "  ShopB"]


def test_contexts_have_both_halves(spark):
    code = "class K { void Go(int n) {\n int size = n;\n Plain(size);\n if (n > 1) {\n  Inner(size);\n }\n Last();\n }\n void Plain(int a) { } void Inner(int a) { } void Last() { } }"
    sources = spark.createDataFrame([("a.cs", code)], "file string, text string")
    p = frontend.parse(sources)
    f = frontend.facts_of(p)
    conditions = graphs.control_context(frontend.relation(p, "blocks"), frontend.relation(p, "edges"), f.calls.select("file", "line").distinct(), sources)
    got = navigate.contexts(f, conditions, graphs.data_context(frontend.relation(p, "arguments"), sources)).join(f.calls.select("site_id", "callee"), "site_id")
    got = {r.callee: r.context for r in got.collect()}
    assert got["Plain"] == "data: [size from L2]"
    assert got["Inner"].endswith("; data: [size from L2]") or got["Inner"] == "data: [size from L2]"
    texts = [c for r in conditions.collect() for c in r.conditions]
    assert any(c.startswith("when: if (if (n > 1) {") and c.endswith(" [L4]") for c in texts)
    assert not any(c.startswith("Condition") for c in texts)


def test_null_start_leaves_spans_apart(spark):
    df = spark.createDataFrame([("A", None, None), ("A", "2024-01-01", "2024-01-10"), ("A", "2024-03-01", "2024-03-05"), ("B", None, None)], "name string, f string, t string")
    got = {r.name: r for r in lifetimes(df.selectExpr("name", "timestamp(f) from_ts", "timestamp(t) to_ts")).collect()}
    assert [(str(s.s)[:10], str(s.e)[:10]) for s in got["A"].spans] == [("2024-01-01", "2024-01-10"), ("2024-03-01", "2024-03-05")]
    assert str(got["A"].first_seen)[:10] == "2024-01-01" and got["B"].spans == [] and got["B"].first_seen is None


def test_dependence_json_and_nav_lists(spark, tmp_path, monkeypatch):
    (tmp_path / "a.cs").write_text("class Shop { IStore s; void Sell() { s.Put(); Note(); } void Note() { } }\ninterface IStore { void Put(); } class Disk : IStore { public void Put() { } }\n")
    run = lambda *argv: cli.run(spark, cli._parser().parse_args([*argv]))
    graphs_ = json.loads(run("pdg", str(tmp_path), "--format", "json"))["graphs"]
    assert len(graphs_) == 3 and {g["method_ord"] for g in graphs_} == {0, 1, 2}
    graph = graphs_[0]
    assert {n["kind"] for n in graph["nodes"]} >= {"Entry", "Exit"} and any(e["kind"] == "cfg(Seq)" for e in graph["edges"])
    monkeypatch.setattr("sys.stdin", io.StringIO("9\nc p\nq\n"))
    out = run("traverse", str(tmp_path), "--class", "Shop")
    assert "[2] Put via s" in out and "[2a] Disk.Put  (c=0.70)" in out and "[u1] Shop.Sell" in out and "Shop -> pattern" in out


def test_call_tree_by_dispatch(spark):
    """Through every interface that declares the name to all concrete subtypes, and cycles only within a class."""
    code = """interface IRun { void Go(); } interface IAlso { void Go(); } class Lib { public static void Do() { } }
    abstract class Base : IRun { public void Go() { } } class Low : Base { } class Other : IAlso { public void Go() { Help(); } void Help() { Help(); } }
    class Main { IRun r; void Start() { r.Go(); Lib.Do(); Loop(); out1.Gone(); } void Loop() { Back(); } void Back() { Loop(); } }"""
    facts = frontend.facts_of(frontend.parse(spark.createDataFrame([("a.cs", code)], "file string, text string"))).settled()
    rows = {(r.level, r.path[-1], r.callee, r.iface, r["class"], r.cycle) for r in callgraph.call_tree(facts, "Main", "Start", 3).collect()}
    assert {r[2:5] for r in rows if r[0] == 1} == {("Go", "IAlso", "Other"), ("Go", "IRun", "Low"), ("Do", None, "Lib"), ("Loop", None, "Main"), ("Gone", None, None)}
    assert (3, "Main.Back", "Loop", None, "Main", True) in rows  # back to Main.Loop
    assert (3, "Other.Help", "Help", None, "Other", True) in rows


def test_call_tree_stores_what_it_reaches(spark, monkeypatch):
    """Calls that the walk does not meet are not led to every implementor."""
    many = " ".join(f"class Impl{i} : IRun {{ public void Go() {{ }} }} class Far{i} {{ IRun r; void Use() {{ r.Go(); }} }}" for i in range(30))
    code = f"interface IRun {{ void Go(); }} {many} class Main {{ void Start() {{ Next(); }} void Next() {{ Lib.Do(); }} }}"
    facts = frontend.facts_of(frontend.parse(spark.createDataFrame([("a.cs", code)], "file string, text string"))).settled()
    kept = []
    monkeypatch.setattr(callgraph, "stored", lambda df, name="t": kept.append(df.count()) or df)
    assert {(r.level, r.callee, r["class"]) for r in callgraph.call_tree(facts, "Main", "Start", 3).collect()} == {(1, "Next", "Main"), (2, "Do", None)}
    assert max(kept) < 100  # 30 callers and 30 implementors make 900 pairs
    assert callgraph.call_hops(facts).where("callee = 'Go'").count() == 900


def _pairs_come_last(df):
    """Whether rows are made from lists above every join, so that nothing with a row per pair is shuffled."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Generate inline" in plan and plan.rindex("Generate inline", 0, plan.index("RepartitionByExpression")) < plan.index("Join")


def test_call_hops_pairs_come_last(spark):
    code = "interface IRun { void Go(); } class A : IRun { public void Go() { } } class B : IRun { public void Go() { } } class Main { IRun r; void Start() { r.Go(); Gone(); } }"
    facts = frontend.facts_of(frontend.parse(spark.createDataFrame([("a.cs", code)], "file string, text string"))).settled()
    hops = callgraph.call_hops(facts)
    assert {(r.callee, r.iface, r["class"]) for r in hops.collect()} == {("Go", "IRun", "A"), ("Go", "IRun", "B"), ("Gone", None, None)}
    assert _pairs_come_last(hops)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_paired(spark, rows, how):
    left = spark.createDataFrame([("a", i % 5, "x") for i in range(7)] + [("b", 1, "y"), ("c", 1, None), (None, 1, "z")], "k string, n int, t string")
    right = spark.createDataFrame([("a", f"r{i}") for i in range(5)] + [("b", None), ("d", "r"), (None, "r")], "k string, r string")
    assert rows(pairs.paired(left, right, "k", how, size=2), "k", "n", "t", "r") == rows(left.join(right, "k", how), "k", "n", "t", "r")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_made_project_is_parsed_once(spark):
    """In several tasks, although the table of parts is one small file."""
    df = __spark_entry__.queries()["OP-S5_made_project"](spark, DATA)
    assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert generated.sources(spark, DATA).rdd.getNumPartitions() > 4


def test_abstract_pairs_come_last(spark):
    code = "interface IRun { void Go(); } class A : IRun { public void Go() { } } class B : IRun { public void Go() { } }"
    facts = frontend.facts_of(frontend.parse(spark.createDataFrame([("a.cs", code)], "file string, text string"))).settled()
    targets = spark.createDataFrame([(1, "Abstract", "IRun", "Go"), (2, "Virtual", "A", "Go")], "site_id long, kind string, class string, method string")
    found = resolve.resolve_abstract(facts, targets, types.concrete_subtypes(facts))
    assert {tuple(r) for r in found.select("site_id", "confidence", "owner").collect()} == {(1, "CHA", "A"), (1, "CHA", "B")}
    assert _pairs_come_last(found)


def test_di_pairs_come_last(spark):
    code = "interface IRun { void Go(); } class A : IRun { public void Go() { } } class B : IRun { public void Go() { } }"
    facts = frontend.facts_of(frontend.parse(spark.createDataFrame([("a.cs", code)], "file string, text string"))).settled()
    targets = spark.createDataFrame([(1, "Abstract", "IRun", "Go"), (2, "Virtual", "A", "Go")], "site_id long, kind string, class string, method string")
    known = spark.createDataFrame([("IRun", "A", "Scoped", "DiRegistration"), ("IRun", "A", "Scoped", "Reflection"), ("IRun", "B", "Scoped", "Reflection"), ("IRun", "Gone", "Scoped", "Reflection")], "interface_type string, implementation_type string, lifetime string, confidence string")
    found = resolve.resolve_di(facts, targets, known)
    assert sorted(tuple(r) for r in found.select("site_id", "confidence", "owner").collect()) == [(1, "DiRegistration", "A"), (1, "DiRegistration", "B")]
    assert _pairs_come_last(found)


def test_inherited_methods_of_interfaces(spark):
    code = "interface IRun { void Go(); void Stop(); } interface INone { void Else(); } class Base { public void Go() { } } class Low : Base, IRun, INone { public void Stop() { } }"
    facts = frontend.facts_of(frontend.parse(spark.createDataFrame([("a.cs", code)], "file string, text string")))
    got = {tuple(r) for r in navigate.matching_interfaces(facts).collect()}
    assert got == {("Low", "Stop", "IRun"), ("Low", "Stop", "INone"), ("Low", "Go", "IRun"), ("Low", "Else", "INone")}


@pytest.mark.parametrize("local", [300_000, 0])
def test_reach_and_walks_by_rounds(spark, monkeypatch, local):
    monkeypatch.setattr(fixpoint, "LOCAL_EDGES", local)
    pairs = [("a", "b", 2), ("b", "c", 1), ("a", "c", 3), ("x", "y", 1), ("y", "x", 1), ("y", "c", 1), ("q", "a", 1), ("z", "nowhere", 1)]
    edges = spark.createDataFrame(pairs, "src string, dst string, n long")
    assert {r.node: r.walks and int(r.walks) for r in fixpoint.walk_counts(edges, "b").collect()} == {"b": 4, "a": 1, "q": 0}
    assert {r.node: r.walks for r in fixpoint.walk_counts(edges, "c").collect()}["c"] is None  # a cycle leads to it
    seeds = spark.createDataFrame([("q",), (None,), ("q",)], "node string")
    assert {(r.node, r.level) for r in fixpoint.reach(edges, seeds).collect()} == {("q", 0), ("a", 1), ("b", 2), ("c", 2)}
    assert fixpoint.reach(edges.limit(0), seeds).count() == 1


def test_best_is_the_best_of_all(spark):
    facts = idioms.facts(spark, DATA).settled()
    every = resolve.resolutions(facts).groupBy("site_id", "strategy", "confidence", "score").agg({"owner": "count"}).collect()
    want: dict = {}
    for r in every:
        now = (r.score, r.strategy, r.confidence, r["count(owner)"])
        want[r.site_id] = max(want.get(r.site_id, now), now)
    assert {r.site_id: (r.score, r.strategy, r.confidence, r.targets) for r in resolve.best(facts).collect()} == want


def test_drawings_of_folders_are_apart(spark, tmp_path):
    for name in ("a.cs", "b.cs"):
        (tmp_path / name).write_text("class A { void M(int x) { var y = x; Use(y); } void N() { } void Use(int n) { } }\n" * (1 if name == "a.cs" else 2))
    args = cli._parser().parse_args(["pdg", str(tmp_path)])
    out = cli.run(spark, args)
    assert out.count("digraph PDG {") == 9 and 'label="data"' in out
    assert cli.run(spark, cli._parser().parse_args(["cfg", str(tmp_path)])).count("digraph {") == 2
