import pytest

from millrace.operators import orphans
from millrace.operators.orphans import lifetimes, orphan_references, orphan_report


def tables(spark, calls=(), classes=(), links=(), interfaces=(), external=()):
    ts = lambda df, *cs: df.selectExpr(*[f"timestamp({c}) {c}" if c in cs else c for c in df.columns])
    return (
        ts(spark.createDataFrame(list(calls), "site_id long, callee_class string, scanned_at string, type_name string"), "scanned_at"),
        ts(spark.createDataFrame(list(classes), "class_id long, name string, base_class string, scanned_at string, deleted_at string"), "scanned_at", "deleted_at"),
        ts(spark.createDataFrame(list(links), "link_id long, iface string, scanned_at string"), "scanned_at"),
        ts(spark.createDataFrame(list(interfaces), "name string, scanned_at string, deleted_at string"), "scanned_at", "deleted_at"),
        spark.createDataFrame(list(external), "name string"),
    )


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_reasons_and_cascade(spark, rows, monkeypatch, broadcast):
    monkeypatch.setattr(orphans, "BROADCAST_NAMES", broadcast)
    monkeypatch.setattr(orphans, "LOCAL_EDGES", broadcast)
    found = orphan_references(
        *tables(
            spark,
            calls=[
                (1, "A", "2024-02-01", "x"), (1, "A", "2024-02-01", "x"), (2, "A", "2024-05-01", "x"), (3, "N.Gone<int>", "2024-02-01", "x"), (4, "A", "2023-12-31", "x"),
                (5, None, "2024-02-01", "x"), (6, " ", "2024-02-01", "x"), (7, "Ext", "1999-01-01", "x"), (8, "Kid", "2024-02-01", "x"), (9, "I", "2024-02-01", "x"), (10, "Gone", None, "x"), (11, "A", None, "x"),
                (12, "A", "2024-04-01", "x"),
            ],
            classes=[(1, "A", None, "2024-01-01", "2024-04-01"), (2, "Sick", "Nowhere", "2024-01-01", None), (3, "Kid", "Sick", "2024-01-02", None), (4, "GrandKid", "Kid", "2024-01-03", None), (5, "Bad", "I", "2024-01-01", None)],
            links=[(1, "I", "2024-01-05"), (2, "A", "2024-01-05"), (3, "Lost", "2024-01-05")],
            interfaces=[("I", "2024-01-01", None)],
            external=[("Ext",)],
        )
    )
    assert rows(found, "ref_table", "ref_id", "ref_month", "kind", "reason", "level") == sorted(
        [
            ("calls", 2, "2024-05", "direct", "deleted", 0), ("calls", 3, "2024-02", "direct", "missing", 0), ("calls", 4, "2023-12", "direct", "late", 0),
            ("calls", 8, "2024-02", "inherited", None, 2), ("calls", 10, None, "direct", "missing", 0), ("calls", 12, "2024-04", "direct", "deleted", 0),
            ("class_iface", 3, "2024-01", "direct", "missing", 0),
            ("classes", 2, "2024-01", "direct", "missing", 0), ("classes", 3, "2024-01", "inherited", None, 1), ("classes", 4, "2024-01", "inherited", None, 2), ("classes", 5, "2024-01", "direct", "missing", 0),
        ]
    )
    assert orphan_report(found).where("kind = 'direct'").selectExpr("sum(refs)").first()[0] == 8


@pytest.mark.parametrize("local", [300_000, 0])
def test_levels(spark, rows, monkeypatch, local):
    monkeypatch.setattr(orphans, "LOCAL_EDGES", local)
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("a", "d"), ("e", "x"), ("b", "a")], "owner string, type_name string")
    seeds = spark.createDataFrame([("a",), ("a",)], "name string")
    assert rows(orphans.orphaned_classes(edges, seeds)) == [("a", 1), ("b", 2), ("c", 2), ("d", 3)]
    assert orphans.orphaned_classes(edges, seeds.limit(0)).count() == 0


def test_cyclic_bases_end(spark):
    found = orphan_references(*tables(spark, classes=[(1, "A", "B", "2024-01-01", None), (2, "B", "A", "2024-01-01", None), (3, "B", "Gone", "2024-01-01", None)]))
    assert {(r.ref_id, r.kind) for r in found.collect()} == {(1, "inherited"), (2, "inherited"), (3, "direct")}


def test_empty_tables(spark):
    assert orphan_references(*tables(spark)).count() == 0
    assert orphan_references(*tables(spark, calls=[(1, "A", "2024-01-01", "")])).collect()[0].reason == "missing"


def test_lifetimes_merge(spark):
    df = spark.createDataFrame(
        [("A", "2024-01-01", "2024-01-10"), ("A", "2024-01-05", "2024-02-03"), ("A", "2024-02-03", "2024-02-04"), ("A", "2024-03-01", None), ("A", "2024-03-01", "2024-03-02"), ("B", None, None), (None, "2024-01-01", None)],
        "name string, f string, t string",
    ).selectExpr("name", "timestamp(f) from_ts", "timestamp(t) to_ts")
    got = {r.name: [(str(s.s)[:10], str(s.e)[:10]) for s in r.spans] for r in lifetimes(df).collect()}
    assert got["A"] == [("2024-01-01", "2024-02-04"), ("2024-03-01", "9999-12-31")]
    assert got["B"] == []
