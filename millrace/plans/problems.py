"""Queries of the general data problems (pN_...) and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forest, heavykeys, orphans, snapshots
from ..sources.tables import table


def _forest(spark: SparkSession, d: str, paths: bool = True) -> DataFrame:
    return forest.hierarchy(forest.current_bases(table(spark, d, "classes")), "name", "base", paths=paths)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _forest(spark, d, paths=False).where("on_cycle").select(F.col("node").alias("name"))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return _forest(spark, d).select(F.col("node").alias("name"), "parent", "root", "depth", F.array_join("path", "/").alias("path"), "on_cycle", "leads_to_cycle")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return forest.descendants(_forest(spark, d))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(*(table(spark, d, t) for t in ("calls", "classes", "class_iface", "interfaces", "external_types")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).where("kind = 'direct'").select("ref_table", "ref_month", "ref_id", "reason")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "calls")
    return heavykeys.heavy_keys(heavykeys.callee_chunks(calls), "caller_class", 0.01).where(F.col("caller_class").isNotNull()).select("caller_class")


def p4_class_callees(spark: SparkSession, d: str) -> DataFrame:
    return heavykeys.callee_sets(heavykeys.callee_chunks(table(spark, d, "calls")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = snapshots.snapshot_changes(table(spark, d, "method_snapshots"), "snapshot_no", "method_key", "callers")
    return found.select(F.col("delivery").alias("snapshot_no"), F.col("key").alias("method_key"), "change_kind")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_report(p5_found(spark, d).withColumnRenamed("snapshot_no", "delivery")).withColumnRenamed("delivery", "snapshot_no")


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p2_found, p2_report, p4_found, p4_class_callees, p5_found, p5_report)}


def _simple(c: str) -> str:
    bare = f"translate(split_part({c}, '<', 1), '?' || ' ' || chr(9) || chr(10) || chr(13) || chr(160), '')"
    return f"regexp_extract({bare}, '[^.:]*$')"


def _named(c: str) -> str:
    return f"nullif({_simple(c)}, '')"


_BASES = f"""
declared AS (SELECT {_named('name')} AS name, {_named('base_class')} AS base, scanned_at, loaded_at, class_id FROM classes),
current_base AS (
  SELECT name, base FROM (
    SELECT name, base, row_number() OVER (PARTITION BY name ORDER BY scanned_at DESC NULLS LAST, loaded_at DESC NULLS LAST, class_id DESC NULLS LAST, base DESC) AS rn
    FROM declared WHERE name IS NOT NULL AND base IS NOT NULL) WHERE rn = 1),
reach AS (SELECT name, base AS above FROM current_base UNION SELECT r.name, b.base FROM reach r JOIN current_base b ON b.name = r.above)
"""

_TREE = f"""WITH RECURSIVE {_BASES},
cyclic AS (SELECT DISTINCT r.name FROM reach r JOIN (SELECT name FROM reach WHERE name = above) c ON c.name IN (r.name, r.above)),
nodes AS (SELECT name FROM declared WHERE name IS NOT NULL UNION SELECT base FROM current_base),
roots AS (SELECT name FROM nodes WHERE name NOT IN (SELECT name FROM current_base)),
down AS (SELECT name, name AS root, 0 AS depth, name AS path FROM roots
  UNION ALL SELECT b.name, d.root, d.depth + 1, d.path || '/' || b.name FROM down d JOIN current_base b ON b.base = d.name)
"""

_SPANS = f"""
class_decl AS (SELECT {_named('name')} AS name, scanned_at AS s, coalesce(deleted_at, TIMESTAMP '9999-12-31') AS e FROM classes),
any_decl AS (SELECT * FROM class_decl UNION ALL SELECT {_named('name')}, scanned_at, coalesce(deleted_at, TIMESTAMP '9999-12-31') FROM interfaces
  UNION ALL SELECT {_named('name')}, TIMESTAMP '0001-01-01', TIMESTAMP '9999-12-31' FROM external_types),
refs AS (
  SELECT DISTINCT 'calls' AS ref_table, site_id AS ref_id, {_named('callee_class')} AS n, scanned_at AS t FROM calls
  UNION ALL SELECT DISTINCT 'class_iface', link_id, {_named('iface')}, scanned_at FROM class_iface),
base_refs AS (SELECT DISTINCT 'classes' AS ref_table, class_id AS ref_id, {_named('base_class')} AS n, scanned_at AS t, {_named('name')} AS owner FROM classes),
judged AS (
  SELECT r.ref_table, r.ref_id, r.n, r.t, min(d.s) AS first_seen, count(d.name) AS decls, coalesce(bool_or(d.s <= r.t AND r.t < d.e), false) AS live
  FROM refs r LEFT JOIN any_decl d ON d.name = r.n WHERE r.n IS NOT NULL GROUP BY ALL),
judged_bases AS (
  SELECT r.ref_table, r.ref_id, r.n, r.t, r.owner, min(d.s) AS first_seen, count(d.name) AS decls, coalesce(bool_or(d.s <= r.t AND r.t < d.e), false) AS live
  FROM base_refs r LEFT JOIN class_decl d ON d.name = r.n WHERE r.n IS NOT NULL GROUP BY ALL),
direct AS (
  SELECT ref_table, ref_id, n, t, CASE WHEN decls = 0 THEN 'missing' WHEN first_seen > t THEN 'late' ELSE 'deleted' END AS reason
  FROM (SELECT ref_table, ref_id, n, t, first_seen, decls, live FROM judged UNION ALL SELECT ref_table, ref_id, n, t, first_seen, decls, live FROM judged_bases)
  WHERE NOT live)
"""

_SITES = f"SELECT DISTINCT site_id, {_simple('caller_class')} AS caller_class, callee FROM calls WHERE site_id IS NOT NULL"

_SETS = """
m AS (SELECT snapshot_no, translate(method_key, ' ' || chr(9) || chr(10) || chr(13) || chr(160), '') AS method_key, callers FROM method_snapshots
  WHERE snapshot_no IS NOT NULL),
names AS (SELECT DISTINCT snapshot_no, method_key, translate(c, ' ' || chr(9) || chr(10) || chr(13) || chr(160), '') AS c
  FROM (SELECT snapshot_no, method_key, unnest(callers) AS c FROM m)),
sets AS (SELECT k.snapshot_no, k.method_key, coalesce(string_agg(n.c, ',' ORDER BY n.c), '') AS s
  FROM (SELECT DISTINCT snapshot_no, method_key FROM m WHERE method_key <> '') k
  LEFT JOIN names n ON n.snapshot_no = k.snapshot_no AND n.method_key = k.method_key AND n.c <> '' GROUP BY ALL),
pairs AS (SELECT snapshot_no AS a, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS b FROM (SELECT DISTINCT snapshot_no FROM m)),
changes AS (
  SELECT p.b AS snapshot_no, coalesce(x.method_key, y.method_key) AS method_key,
    CASE WHEN x.method_key IS NULL THEN 'added' WHEN y.method_key IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM pairs p JOIN sets x ON x.snapshot_no = p.a LEFT JOIN sets y ON y.snapshot_no = p.b AND y.method_key = x.method_key
  WHERE p.b IS NOT NULL AND (y.method_key IS NULL OR x.s <> y.s)
  UNION ALL
  SELECT p.b, y.method_key, 'added' FROM pairs p JOIN sets y ON y.snapshot_no = p.b LEFT JOIN sets x ON x.snapshot_no = p.a AND x.method_key = y.method_key
  WHERE x.method_key IS NULL)
"""

ORACLES = {
    "p1_found": f"WITH RECURSIVE {_BASES} SELECT DISTINCT name FROM reach WHERE name = above",
    "p1_hierarchy": _TREE
    + """SELECT n.name, b.base AS parent, d.root, CAST(d.depth AS BIGINT) AS depth, d.path,
    n.name IN (SELECT name FROM reach WHERE name = above) AS on_cycle, n.name IN (SELECT name FROM cyclic) AS leads_to_cycle
    FROM nodes n LEFT JOIN current_base b USING (name) LEFT JOIN down d USING (name)""",
    "p1_descendants": _TREE
    + """, up AS (SELECT name AS descendant, base AS ancestor, 1 AS distance FROM current_base WHERE name NOT IN (SELECT name FROM cyclic)
    UNION ALL SELECT u.descendant, b.base, u.distance + 1 FROM up u JOIN current_base b ON b.name = u.ancestor)
    SELECT ancestor, descendant, CAST(distance AS BIGINT) AS distance FROM up""",
    "p2_found": f"WITH {_SPANS} SELECT ref_table, strftime(t, '%Y-%m') AS ref_month, ref_id, reason FROM direct",
    "p2_report": f"""WITH RECURSIVE {_SPANS},
    sick AS (SELECT DISTINCT owner AS name FROM judged_bases WHERE NOT live AND owner IS NOT NULL
      UNION SELECT b.owner FROM sick s JOIN judged_bases b ON b.n = s.name WHERE b.live AND b.owner IS NOT NULL),
    cases AS (SELECT ref_table, t, n, 'direct' AS kind, reason FROM direct UNION ALL
      SELECT ref_table, t, n, 'inherited', NULL FROM
        (SELECT ref_table, ref_id, n, t FROM judged WHERE live UNION ALL SELECT ref_table, ref_id, n, t FROM judged_bases WHERE live) WHERE n IN (SELECT name FROM sick))
    SELECT ref_table, strftime(t, '%Y-%m') AS ref_month, kind, reason, count(*) AS refs, count(DISTINCT n) AS types FROM cases GROUP BY ALL""",
    "p4_found": f"""WITH s AS (SELECT DISTINCT site_id, {_simple('caller_class')} AS caller_class FROM calls WHERE site_id IS NOT NULL)
    SELECT caller_class FROM s WHERE caller_class IS NOT NULL GROUP BY 1 HAVING count(*) >= 0.01 * (SELECT count(*) FROM s)""",
    "p4_class_callees": f"""SELECT caller_class, callee, count(*) AS n_sites, min(site_id) AS first_site, max(site_id) AS last_site, max(gap) AS longest_gap
    FROM (SELECT *, site_id - lag(site_id) OVER (PARTITION BY caller_class, callee ORDER BY site_id) AS gap FROM ({_SITES}) WHERE caller_class IS NOT NULL AND callee IS NOT NULL) GROUP BY ALL""",
    "p5_found": f"WITH {_SETS} SELECT DISTINCT snapshot_no, method_key, change_kind FROM changes",
    "p5_report": f"WITH {_SETS} SELECT snapshot_no, change_kind, count(*) AS keys FROM (SELECT DISTINCT * FROM changes) GROUP BY ALL",
}
