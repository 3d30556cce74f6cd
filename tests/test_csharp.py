import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import render
from millrace.sources.csharp import frontend
from millrace.sources.csharp.cfg import graphs
from millrace.sources.csharp.parser import File


def flow(body, strict=False):
    (_, g), *_ = graphs(File("class K {\n void Go(int n) {\n" + body + "\n }\n}"), strict)
    return [(i, k) for i, k, _, _ in g.blocks], g.edges


def test_sequence_and_empty():
    assert flow("") == ([(0, "Entry"), (1, "Exit")], [(0, 1, "Seq")])
    assert flow("A(); B();")[1] == [(2, 3, "Seq"), (0, 2, "Seq"), (3, 1, "Seq")]


def test_branches():
    blocks, edges = flow("if (n > 1) A(); else { B(); C(); }\nD();")
    assert blocks[2:] == [(2, "Condition"), (3, "Statement"), (4, "Statement"), (5, "Statement"), (6, "Statement"), (7, "Statement")]
    assert edges == [(2, 4, "CondTrue"), (4, 3, "Seq"), (5, 6, "Seq"), (2, 5, "CondFalse"), (6, 3, "Seq"), (3, 7, "Seq"), (0, 2, "Seq"), (7, 1, "Seq")]
    assert flow("if (n > 1) return;")[1] == [(2, 4, "CondTrue"), (2, 3, "CondFalse"), (0, 2, "Seq"), (3, 1, "Seq")]


def test_loops():
    assert flow("while (n > 0) { A(); }")[1] == [(2, 4, "CondTrue"), (4, 2, "LoopBack"), (2, 3, "CondFalse"), (0, 2, "Seq"), (3, 1, "Seq")]
    assert flow("for (int i = 0; i < n; i++) A();")[1] == [(4, 2, "Seq"), (2, 5, "CondTrue"), (5, 2, "LoopBack"), (2, 3, "CondFalse"), (0, 2, "Seq"), (3, 1, "Seq")]
    assert flow("do { A(); } while (n > 0);")[1] == [(2, 4, "Seq"), (4, 3, "CondFalse"), (4, 2, "LoopBack"), (0, 2, "Seq"), (3, 1, "Seq")]
    assert [k for _, k in flow("foreach (var x in xs) { A(x); }")[0]] == ["Entry", "Exit", "Unknown"]
    assert [k for _, k in flow("foreach (var x in xs) { A(x); }", strict=True)[0]] == ["Entry", "Exit", "LoopHeader", "LoopExit", "Statement"]


def test_switch_and_try():
    blocks, edges = flow("switch (n) { case 1: A(); break; default: return; }")
    assert [k for _, k in blocks[2:]] == ["Condition", "Statement", "Unknown", "Statement", "Statement", "Statement"]
    assert edges[-3:] == [(2, 3, "CondFalse"), (0, 2, "Seq"), (3, 1, "Seq")]
    assert (2, 6, "CondTrue") in edges and (6, 3, "Seq") not in edges  # a break goes nowhere else
    assert flow("try { A(); } catch (E e) { B(); } finally { C(); }")[1] == [(2, 3, "Throw"), (3, 4, "Finally"), (2, 4, "Seq"), (0, 2, "Seq"), (4, 1, "Seq")]


def test_strict_jumps():
    _, edges = flow("while (n > 0) { if (n == 3) break; A(); }\nreturn;", strict=True)
    assert any(k == "Break" for *_, k in edges) and any(k == "Return" for *_, k in edges)


def test_labels_and_dot():
    (_, g), *_ = graphs(File("class K {\n void Go() {\n A();\n }\n}"))
    dot = render.cfg_dot(g.blocks, g.edges)
    assert dot.startswith('digraph {\n    0 [ label = "[0] Entry (L2-L4)" ]\n') and '    2 -> 1 [ label = "Seq" ]\n' in dot
    assert '"start_line": 3' in render.cfg_json(g.blocks, g.edges)


CODE = """
using System;
namespace App.Web;
[Route("api/things")]
public class ThingsController : ControllerBase, IDisposable, Deep.Down.Thing {
    private static readonly Dictionary<string, int> _cache = new();
    int a, b;
    public ThingsController(IStore store, Func<int, string> f = null) { _store = store; }
    public string Name { get { return Other(); } set; }
    [HttpGet("{id}")]
    public async Task<List<Thing>> Find(int id, [FromBody] Filter f) {
        var t = new Thing(3);
        this.Check(id); _store?.Load<Thing>(id, Check); Console.WriteLine($"{Format(id)} {{no}}");
        if (id < Max && id > (Min)) { return _store.All().Where(x => x.Ok()).ToList(); }
        string Local(int q) => Again(q);
        return null;
    }
    [HttpPost] [HttpPut("/all")] public void Save() => Store();
    void Check(int n) { }
    class Inner { void Deep() { Call(); } }
    void After() { Lost(); }
}
interface IStore { void Load(int id); }
abstract class Base<T> where T : class { protected abstract void Do(); public virtual int X() { return 1; } }
record Point(int X, int Y) : Base;
static class Api { static void Map(WebApplication app) { app.MapGet("/x", Handle); app.MapGet("y", () => 1); app.MapPost("z", Handle); } }
"""


@pytest.fixture(scope="module")
def parsed():
    return frontend.parse_text(CODE)


def test_types_and_members(parsed):
    types = {t["name"]: t for t in parsed["types"]}
    assert types["ThingsController"]["interfaces"] == ["ControllerBase", "IDisposable"] and types["ThingsController"]["base_class"] is None
    assert types["Point"]["base_class"] == "Base" and types["Base"]["is_abstract"] and types["IStore"]["kind"] == "interface"
    sig = {(m["owner"], m["method"]): m["signature"] for m in parsed["methods"]}
    assert sig["ThingsController", "Find"] == "Task<List<Thing>> Find(int, Filter)"
    assert sig["ThingsController", "ThingsController"] == "void ThingsController(IStore, Func<int, string>)"
    assert sig["ThingsController", "Save"] == "void Save" and sig["Point", ".ctor"] == ".ctor ((int X, int Y))"
    assert ("ThingsController", "Deep") in sig and ("Inner", "Deep") in sig  # credited to the outer type as well
    assert [(f["name"], f["field_type"], f["is_static"]) for f in parsed["fields"]] == [("_cache", "Dictionary<string, int>", True), ("a", "int", False), ("b", "int", False)]


def test_calls(parsed):
    got = [(c["caller_method"], c["callee"], c["target_expr"], c["is_self_call"]) for c in parsed["calls"] if c["caller_class"] == "ThingsController"]
    assert got == [
        ("Find", "Check", "this", True), ("Find", "Load<Thing>", "_store", False), ("Find", "WriteLine", "Console", False), ("Find", "Format", "", False), ("Find", "ToList", "_store.All().Where(x => x.Ok())", False),
        ("Find", "Where", "_store.All()", False), ("Find", "All", "_store", False), ("Find", "Ok", "x", False), ("Find", "Again", "", False), ("Save", "Store", "", False),
    ]
    assert "After" in {c["caller_method"] for c in frontend.parse_text(CODE, compat=False)["calls"]}
    assert parsed["creations"] == [{"class": "ThingsController", "created_type": "Thing"}]
    assert next(c for c in parsed["calls"] if c["callee"] == "Load<Thing>")["delegates"] == ["id", "Check"]


def test_routes(parsed):
    got = [(r["http_method"], r["path"], r["handler"]) for r in parsed["routes"] if r["source"] == "controller"]
    assert got == [("GET", "/api/things/{id}", "Find"), ("POST", "/api/things", "Save"), ("PUT", "/all", "Save"), ("GET", "/api/things", "Check"), ("GET", "/api/things", "After")]
    assert [(r["path"], r["handler"], r["class"]) for r in parsed["routes"] if r["source"] == "minimal"] == [("/x", "Handle", "Api"), ("/z", "Handle", "Api")]


@pytest.mark.parametrize(
    "base,sub,path", [(None, None, "/"), ("api", None, "/api"), ("api/catalog", "{id}", "/api/catalog/{id}"), (None, "{id}", "/{id}"), ("api/", "/{id}", "/{id}"), ("api", "items", "/api/items")]
)
def test_paths(spark, base, sub, path):
    from pyspark.sql import functions as F

    assert frontend.combine_paths(base, sub) == path
    df = spark.createDataFrame([(base, sub)], "b string, s string")
    assert df.select(frontend.route_path(F.col("b"), F.col("s"))).first()[0] == path


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='class{}()[];=>."\'$@/*#\n aBif:?,<try case new 1', max_size=120))
def test_any_text_is_read(text):
    frontend.parse_text(text)
    frontend.parse_text("class A { void M() { " + text + " } }", compat=False)


def test_relations_and_facts(spark):
    df = spark.createDataFrame([("a.cs", CODE), ("b.cs", None), ("c.cs", ""), ("d.cs", "class ThingsController : Base { void Extra() { Find(); } }")], "file string, text string")
    p = frontend.parse(df).cache()
    assert p.count() == 3 and p.where("error is not null").count() == 0
    first, append = frontend.facts_of(p, "first"), frontend.facts_of(p, "append")
    assert first.methods.where("method = 'Extra'").count() == 0 and append.methods.where("method = 'Extra'").count() == 1
    bound = {(r.callee, r.target_expr): r.callee_class for r in append.calls.where("caller_class = 'ThingsController'").collect()}
    assert bound["Check", "this"] == "ThingsController" and bound["WriteLine", "Console"] == "" and bound["Find", ""] == "ThingsController"
    assert append.calls.where("callee = 'Load<Thing>'").first().delegates == ["Check"]
    assert frontend.parse(df.limit(0)).count() == 0


def test_statements_and_arguments(spark):
    from millrace.operators import graphs

    code = "class A {\n void M(int n) {\n  var x = 1;\n  if (n > 0) { Put(x); } else while (n < 3) n++;\n }\n}"
    p = frontend.parse(spark.createDataFrame([("a.cs", code)], "file string, text string"))
    got = [(r.depth, r.kind, r.start_line) for r in frontend.relation(p, "statements").orderBy("ord").collect()]
    assert got == [(0, "simple", 3), (0, "if", 4), (1, "block", 4), (2, "simple", 4), (1, "while", 4), (2, "simple", 4)]
    sources = spark.createDataFrame([("a.cs", code)], "file string, text string")
    assert [(r.name, r.defined) for r in graphs.data_context(frontend.relation(p, "arguments"), sources).collect()] == [("x", 3)]


def test_stored_tables_can_be_cleared(spark):
    from millrace import session

    kept = session._WRITTEN[:]
    session._WRITTEN.clear()
    df = session.stored(spark.range(3), "probe")
    assert df.count() == 3 and len(session._WRITTEN) == 1
    session.clear(spark)
    assert not session._WRITTEN
    session._WRITTEN.extend(kept)
