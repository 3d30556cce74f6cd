"""What changed between full snapshots.

Each key of each delivery is reduced to one row with a fingerprint of its set; over all deliveries a single window per
key, ordered by the delivery's index, shows every kind of change: the fingerprint differs from the lagged one (changed),
the index before is missing (added) or the index after is missing (removed). One pass serves any number of deliveries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import blank_free
from ..session import stored

#: Keys with several different lists are broadcast up to this many, each a number and a name; beyond, they are joined by shuffle.
BROADCAST_KEYS = 100_000


def delivery_sets(rows: DataFrame, delivery: str, key: str, members: str) -> DataFrame:
    """(delivery, key, n, h1, h2): the set of members over all rows of a key in a delivery, as count and two combined hashes.

    Members and keys count without blanks; null and empty members are none, so a null list is an empty set. Rows
    without a delivery or without a key are left out. Each row's list becomes a fingerprint before anything is shuffled, and
    rows of equal lists are combined at once. Most keys then have a single list; only the lists of keys with several
    different ones are taken apart, member by member, so that a key with very many rows is spread.
    """
    rows = rows.select(F.col(delivery).alias("delivery"), F.nullif(blank_free(F.col(key)), F.lit("")).alias("key"), F.col(members).alias("members"))
    rows = rows.where(F.col("delivery").isNotNull() & F.col("key").isNotNull())
    lists = rows.select("delivery", "key", _hashes("members").alias("m"))
    mix = lambda c: F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x[c]))
    mark = F.struct(F.size("m").cast("long").alias("n"), mix("a").alias("h1"), mix("b").alias("h2"))
    # the least and greatest list of each key, by fingerprint: equal where there is one
    marks = lists.select("delivery", "key", mark.alias("mark"))
    ends = stored(marks.groupBy("delivery", "key").agg(F.min("mark").alias("low"), F.max("mark").alias("high")), "ends")
    single = ends.where(F.col("low") == F.col("high")).select("delivery", "key", "low.*")
    keys = ends.where(F.col("low") != F.col("high")).select("delivery", "key")
    several = rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, ["delivery", "key"], "left_semi")
    parts = several.select("delivery", "key", F.explode(_hashes("members")).alias("x")).select("delivery", "key", "x.a", "x.b").distinct()
    whole = parts.groupBy("delivery", "key").agg(F.count("*").alias("n"), F.bit_xor("a").alias("h1"), F.bit_xor("b").alias("h2"))
    return single.unionByName(whole)


def _hashes(members: str) -> Column:
    """Two hashes of each different member of a list, without blanks; null and empty members are none."""
    names = F.array_distinct(F.filter(F.transform(F.coalesce(members, F.array().cast("array<string>")), lambda x: F.nullif(blank_free(x), F.lit(""))), lambda x: x.isNotNull()))
    return F.transform(names, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b")))


def snapshot_changes(rows: DataFrame, delivery: str, key: str, members: str) -> DataFrame:
    """(delivery, key, change_kind): 'added', 'removed' or 'changed' from each delivery to the next in number order.

    ``delivery`` is the later of the two; numbers need not be contiguous, and the first delivery has no changes.
    'changed' means that the set of members differs, nothing else. Repeated rows, order and repeats in the lists make
    no change. Empty tables and a single delivery give no rows.
    """
    sets = delivery_sets(rows, delivery, key, members)
    numbers = rows.select(F.col(delivery).alias("delivery")).where(F.col(delivery).isNotNull()).distinct()
    order = Window.orderBy("delivery")  # over the deliveries' numbers only
    index = numbers.select("delivery", F.row_number().over(order).alias("idx"), F.lead("delivery").over(order).alias("next_delivery"))
    by_key = Window.partitionBy("key").orderBy("idx")
    seen = sets.join(index, "delivery").select(
        "delivery", "next_delivery", "key", "idx",
        F.lag("idx").over(by_key).alias("idx0"), F.lead("idx").over(by_key).alias("idx1"),
        F.struct("n", "h1", "h2").alias("now"), F.lag(F.struct("n", "h1", "h2")).over(by_key).alias("was"),
    )
    follows = F.col("idx0") == F.col("idx") - 1
    here = F.when(F.col("idx") == 1, None).when(F.coalesce(~follows, F.lit(True)), "added").when(F.col("now") != F.col("was"), "changed")
    gone = F.when(F.col("next_delivery").isNotNull() & F.coalesce(F.col("idx1") != F.col("idx") + 1, F.lit(True)), "removed")
    events = F.array(F.struct(F.col("delivery").alias("delivery"), here.alias("kind")), F.struct(F.col("next_delivery").alias("delivery"), gone.alias("kind")))
    return seen.select("key", F.inline(events).alias("delivery", "change_kind")).where(F.col("change_kind").isNotNull()).select("delivery", "key", "change_kind")


def change_report(changes: DataFrame) -> DataFrame:
    """Number of keys added, removed and changed per delivery."""
    return changes.groupBy("delivery", "change_kind").agg(F.count("*").alias("keys"))
