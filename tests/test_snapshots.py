import pytest

from millrace.operators import snapshots
from millrace.operators.snapshots import change_report, snapshot_changes

SCHEMA = "no int, key string, m array<string>, delivery string"


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_changes(spark, rows, monkeypatch, broadcast):
    monkeypatch.setattr(snapshots, "BROADCAST_KEYS", broadcast)
    df = spark.createDataFrame(
        [
            (1, "a", ["x", "y"], "?"), (1, "b", ["x"], "?"), (1, "c", None, "?"), (1, "d", ["x"], "?"), (1, "e", ["x"], "?"),
            (3, "a", ["y "], "?"), (3, "a", ["x", "x", None, ""], "?"), (3, "b", ["x", "z"], "?"), (3, "c", [], "?"), (3, "e", [], "?"),
            (7, "a", ["x", "y"], "?"), (7, "b", ["z", "x"], "?"), (7, "d", ["x"], "?"), (7, "c", [None], "?"), (7, None, ["x"], "?"), (None, "q", ["x"], "?"), (7, " ", ["x"], "?"),
        ],
        SCHEMA,
    )
    got = snapshot_changes(df, "no", "key", "m")
    assert rows(got) == [(3, "b", "changed"), (3, "d", "removed"), (3, "e", "changed"), (7, "d", "added"), (7, "e", "removed")]
    assert rows(change_report(got)) == [(3, "changed", 2), (3, "removed", 1), (7, "added", 1), (7, "removed", 1)]


def test_empty_and_single(spark):
    assert snapshot_changes(spark.createDataFrame([], SCHEMA), "no", "key", "m").count() == 0
    assert snapshot_changes(spark.createDataFrame([(1, "a", ["x"], "")], SCHEMA), "no", "key", "m").count() == 0
