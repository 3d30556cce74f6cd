from pyspark.sql import functions as F

from millrace.functions.names import blank_free, named, simple_name


def test_simple_names(spark):
    cases = {
        "Foo": "Foo", " Foo ": "Foo", "A.B.Foo": "Foo", "global::Foo": "Foo", "global::A.Foo": "Foo", "Foo<int>": "Foo", "A.Foo<List<A.Row>>": "Foo",
        "Foo?": "Foo", "A.Foo<int>?": "Foo", "": "", "  ": "", "foo": "foo", "Foo\t": "Foo", None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r[0]: r[1] for r in df.select("t", simple_name(F.col("t"))).collect()}
    assert got == cases


def test_named_is_null_without_a_name(spark):
    df = spark.createDataFrame([("",), ("  ",), (None,), ("X",)], "t string")
    assert [r[0] for r in df.select(named(F.col("t"))).collect()] == [None, None, None, "X"]
    assert [r[0] for r in df.select(blank_free(F.col("t"))).collect()] == ["", "", None, "X"]
