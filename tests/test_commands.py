import pytest

from millrace import cli
from millrace.sources.csharp import frontend
from millrace.streaming import facts as stream

A = "class Shop {\n public void Sell() { Note(); if (1 > 0) { Note(); } else Done(); }\n void Note() { Done(); }\n void Done() { }\n}\n"
B = "class ShopController {\n [HttpGet(\"x\")]\n public int Get() { return 1; }\n}\nclass One { public static One Make() { return null; } }\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "deep").mkdir()
    (root / "a.cs").write_text(A)
    (root / "deep" / "b.cs").write_text(B)
    (root / "notes.txt").write_text("class Not { }")
    return root


def run(spark, *argv):
    return cli.run(spark, cli._parser().parse_args([*map(str, argv)]))


def test_commands(spark, tree):
    assert '"name":"Shop"' in run(spark, "parse", tree) and '"Not"' not in run(spark, "parse", tree)
    assert '"[2] Statement' in run(spark, "cfg", tree / "a.cs") and '"from": 0' in run(spark, "cfg", tree / "a.cs", "--format", "json")
    assert "cfg(Seq)" in run(spark, "pdg", tree / "a.cs")
    assert run(spark, "hammock", tree / "a.cs")
    assert run(spark, "resolve", tree).splitlines()[0] == "Done  2"
    assert "Singleton" in run(spark, "detect", tree)
    assert "GET  /x" in run(spark, "route", tree) and '"path": "/x"' in run(spark, "route", tree, "--json")
    assert "Shop  Sell  Done" in run(spark, "callgraph", tree, "--class", "shop")
    assert "Shop.Note" in run(spark, "callgraph", tree, "--class", "shop", "--trace")
    assert "Done  Shop  2" in run(spark, "callgraph", tree, "--inbound")
    assert '"Shop.Done" [label="Shop.Done (affects 2 sites)"' in run(spark, "impact", tree, "--class", "Shop", "--method", "Done")
    with pytest.raises(ValueError, match="not found"):
        run(spark, "impact", tree, "--class", "Shop", "--method", "Nope")


def test_difference(spark, tree, tmp_path):
    (tmp_path / "a.cs").write_text(A.replace("else Done();", ""))
    out = run(spark, "diffimpact", tree, tmp_path)
    assert "Shop.Done CALLERS CHANGED" in out


def test_stream(spark, tree, tmp_path):
    q = stream.append_facts(spark, str(tree), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2 and frontend.relation(out, "types").where("name = 'One'").count() == 1


def test_rates(spark):
    calls = spark.createDataFrame([(1, "A", "2024-01-01 10:00:00"), (1, "A", "2024-01-01 10:00:00"), (2, "N.A", "2024-01-01 11:00:00"), (3, "A", "2024-01-02 01:00:00")], "site_id long, caller_class string, scanned_at string")
    got = sorted((str(r.window.start), r.caller_class, r.sites) for r in stream.call_rates(calls).collect())
    assert got == [("2024-01-01 00:00:00", "A", 2), ("2024-01-02 00:00:00", "A", 1)]
