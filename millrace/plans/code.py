"""Queries of the call graph, impact, navigation, the C# frontend and the graphs of methods, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import callgraph, fixpoint, graphs, impact, navigate, patterns, render, resolve
from ..operators.facts import from_tables
from ..session import cut, stored
from ..sources.csharp import frontend
from ..sources.tables import table
from .program import _facts, _more, query
from . import generated
from .program import ORACLES as ORACLES_ALL
from .program import QUERIES as QUERIES_ALL

_before = set(QUERIES_ALL)

# ---- call graph

_EDGES = """edge AS (SELECT caller_class || '.' || caller_method AS src, callee_class || '.' || callee AS dst, count(*) AS n FROM call WHERE callee_class <> '' AND callee <> '' AND caller_method <> '' GROUP BY ALL)"""
_TOP = "(SELECT dst FROM (SELECT dst, sum(n) AS s FROM {} GROUP BY dst) ORDER BY s DESC, dst LIMIT 1)"


def _inner(ctes: str, body: str) -> str:
    return f"SELECT * FROM (WITH RECURSIVE {ctes} {body})"


def _most_called(edges: DataFrame) -> str:
    row = edges.groupBy("dst").agg(F.sum("n").alias("s")).orderBy(F.desc("s"), "dst").first()
    return row[0] if row else ""


@query("OP-A1_match_class", "SELECT name FROM cls WHERE contains(lower(name), 'ledger')")
def _(spark, d):
    return callgraph.match_class(_facts(spark, d), "Ledger")


@query("OP-A2_outbound", "SELECT caller_class, caller_method, callee, count(*) AS calls, arg_min(target_expr, site_id) AS via FROM call WHERE NOT starts_with(caller_method, 'get_') AND NOT starts_with(caller_method, 'set_') GROUP BY ALL")
def _(spark, d):
    return callgraph.outbound(_facts(spark, d))


@query(
    "OP-A3_call_tree",
    _inner(
        """per AS (SELECT caller_class, caller_method, callee, count(*) AS calls, arg_min(target_expr, site_id) AS via FROM call GROUP BY ALL),
        dispatch AS (SELECT DISTINCT f.method AS callee, f.owner AS iface, s.class FROM met f JOIN sub s ON s.name = f.owner WHERE f.owner_kind = 'interface' AND f.owner IN (SELECT name FROM ifc)),
        home AS (SELECT method, min(owner) AS owner FROM defs GROUP BY method),
        hop AS (SELECT p.*, d.iface, CASE WHEN d.iface IS NOT NULL THEN d.class ELSE coalesce(c.name, s.owner) END AS class
          FROM per p LEFT JOIN dispatch d ON d.callee = p.callee LEFT JOIN cls c ON c.name = p.via LEFT JOIN home s ON s.method = p.callee),
        top AS (SELECT caller_class, caller_method, caller_class || '.' || caller_method AS t FROM call WHERE caller_class <> '' AND caller_method <> '' GROUP BY ALL ORDER BY count(*) DESC, t LIMIT 1),
        tree AS (SELECT 1 AS level, [t] AS path, [t] AS seen, h.* FROM top JOIN hop h USING (caller_class, caller_method)
          UNION ALL SELECT level + 1, list_append(path, w.class || '.' || w.callee), CASE WHEN stays THEN list_append(seen, w.class || '.' || w.callee) ELSE [w.class || '.' || w.callee] END, h.*
          FROM (SELECT *, iface IS NULL AND class = caller_class AS stays FROM tree) w JOIN hop h ON h.caller_class = w.class AND h.caller_method = w.callee
          WHERE NOT (stays AND list_contains(seen, w.class || '.' || w.callee)) AND level < 3)""",
        """SELECT level, array_to_string(path, ' > ') AS path, callee, calls, via, iface, class,
          coalesce(iface IS NULL AND class = caller_class AND list_contains(seen, class || '.' || callee), false) AS cycle FROM tree""",
    ),
)
def _(spark, d):
    f = _facts(spark, d)
    named = f.calls.where("caller_class <> '' and caller_method <> ''")
    busiest = named.groupBy("caller_class", "caller_method").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.concat_ws(".", "caller_class", "caller_method")).first()
    cls, method = busiest[:2] if busiest else ("", "")
    return callgraph.call_tree(f, cls, method, 3).withColumn("path", F.array_join("path", " > "))


@query("OP-A3_call_hops", """SELECT p.caller_class, p.caller_method, p.callee, p.calls, p.via, d.iface, CASE WHEN d.iface IS NOT NULL THEN d.class ELSE coalesce(c.name, s.owner) END AS class
    FROM (SELECT caller_class, caller_method, callee, count(*) AS calls, arg_min(target_expr, site_id) AS via FROM call GROUP BY ALL) p
    LEFT JOIN (SELECT DISTINCT f.method AS callee, f.owner AS iface, s.class FROM met f JOIN sub s ON s.name = f.owner WHERE f.owner_kind = 'interface' AND f.owner IN (SELECT name FROM ifc)) d ON d.callee = p.callee
    LEFT JOIN cls c ON c.name = p.via LEFT JOIN (SELECT method, min(owner) AS owner FROM defs GROUP BY method) s ON s.method = p.callee""")
def _(spark, d):
    return callgraph.call_hops(_facts(spark, d))


@query("OP-A4_inbound", "SELECT callee, caller_class, count(*) AS calls, CASE WHEN count(*) = 1 THEN min(target_expr) ELSE '' END AS via FROM call GROUP BY callee, caller_class")
def _(spark, d):
    return callgraph.inbound(_facts(spark, d))


@query(
    "OP-A5_summary",
    """SELECT caller_class, total, callee, calls, CAST(rank AS INT) AS rank FROM (SELECT caller_class, callee, count(*) AS calls, CAST(sum(count(*)) OVER (PARTITION BY caller_class) AS BIGINT) AS total,
      row_number() OVER (PARTITION BY caller_class ORDER BY count(*) DESC, callee) AS rank FROM call GROUP BY caller_class, callee) WHERE rank <= 5""",
)
def _(spark, d):
    return callgraph.summary(_facts(spark, d))


_REACH = f"""{_EDGES}, top AS (SELECT {_TOP.format('edge')} AS t), above AS (SELECT t AS id FROM top UNION SELECT e.src FROM above a JOIN edge e ON e.dst = a.id)"""


@query(
    "OP-A8_impact_nodes",
    _inner(_REACH, "SELECT a.id, CAST(coalesce(sum(e.n), 0) AS BIGINT) AS direct, count(e.src) AS distinct_callers FROM above a LEFT JOIN edge e ON e.dst = a.id GROUP BY a.id"),
)
def _(spark, d):
    f = _facts(spark, d)
    return impact.impact(f, _most_called(impact.call_edges(f)), walks=False)[0].select("id", "direct", "distinct_callers")


@query("OP-A8_impact_nodes_whole")
def _(spark, d):
    """With the walks that end in each node, null below a cycle, which SQL cannot follow."""
    f = _facts(spark, d)
    return impact.impact(f, _most_called(impact.call_edges(f)))[0].select("id", "direct", "distinct_callers", F.col("transitive").cast("string").alias("transitive"))


@query("OP-A10_impact_edges", _inner(_REACH, "SELECT e.src AS caller, e.dst AS callee FROM edge e WHERE e.dst IN (SELECT id FROM above)"))
def _(spark, d):
    f = _facts(spark, d)
    return impact.impact(f, _most_called(impact.call_edges(f)), walks=False)[1]


@query("OP-A7_reachable", _inner(_REACH, "SELECT id FROM above"))
def _(spark, d):
    edges = impact.call_edges(_facts(spark, d))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return fixpoint.reach(back, spark.createDataFrame([(_most_called(edges),)], "node string")).select(F.col("node").alias("id"))


@query("OP-A9_walk_counts")
def _(spark, d):
    """Walks over all edges for every node above the target, null below a cycle, which SQL cannot follow."""
    edges = cut(impact.call_edges(_facts(spark, d)))
    return fixpoint.walk_counts(edges, _most_called(edges)).select("node", F.col("walks").cast("string").alias("walks"))


@query("OP-A11_method_keys", _inner(_EDGES, "SELECT src AS key FROM edge UNION SELECT dst FROM edge"))
def _(spark, d):
    return impact.method_keys(_facts(spark, d))


_SPLIT = "TIMESTAMP '2024-05-15'"
_V = "SELECT caller_class || '.' || caller_method AS src, callee_class || '.' || callee AS dst FROM call WHERE callee_class <> '' AND callee <> '' AND caller_method <> '' AND site_id {} (SELECT site_id FROM calls WHERE scanned_at < {})"
_DIFF = f"""e1 AS ({_V.format('IN', _SPLIT)}), e2 AS ({_V.format('NOT IN', _SPLIT)}),
k1 AS (SELECT src AS key FROM e1 UNION SELECT dst FROM e1), k2 AS (SELECT src AS key FROM e2 UNION SELECT dst FROM e2),
gone AS (SELECT dst AS key, src FROM e1 EXCEPT SELECT dst, src FROM e2), come AS (SELECT dst AS key, src FROM e2 EXCEPT SELECT dst, src FROM e1),
changes AS (SELECT key, 'added' AS kind, 0 AS removed, 0 AS added FROM k2 WHERE key NOT IN (SELECT key FROM k1)
  UNION ALL SELECT key, 'removed', 0, 0 FROM k1 WHERE key NOT IN (SELECT key FROM k2)
  UNION ALL SELECT key, 'callers_changed', (SELECT count(*) FROM gone g WHERE g.key = x.key), (SELECT count(*) FROM come c WHERE c.key = x.key)
    FROM (SELECT DISTINCT dst AS key FROM e2) x WHERE key IN (SELECT key FROM k1) AND (key IN (SELECT key FROM gone) OR key IN (SELECT key FROM come)))"""


def _versions(spark: SparkSession, d: str):
    return tuple(from_tables(spark, d, calls_where=f"scanned_at {op} timestamp_ntz'2024-05-15'") for op in ("<", ">="))


@query("OP-A12_A13_diff", _inner(_DIFF, "SELECT key, kind, CAST(removed AS INT) AS removed, CAST(added AS INT) AS added FROM changes"))
def _(spark, d):
    return impact.diff(*_versions(spark, d)).select("key", "kind", F.size("removed_callers").alias("removed"), F.size("added_callers").alias("added"))


@query(
    "OP-A14_diff_impact",
    _inner(_DIFF + ", top AS (SELECT min(key) AS t FROM changes WHERE kind <> 'removed' AND key NOT LIKE '.%'), above AS (SELECT t AS id FROM top UNION SELECT e.src FROM above a JOIN e2 e ON e.dst = a.id)", "SELECT id FROM above WHERE id IS NOT NULL"),
)
def _(spark, d):
    return impact.diff_impact(*_versions(spark, d))[1].select("id")


@query("OP-A15_by_directory", "SELECT array_to_string(string_split(file, '/')[1:2], '/') AS directory, count(DISTINCT file) AS files, count(*) AS calls, count(DISTINCT callee) AS callees FROM call GROUP BY 1")
def _(spark, d):
    return callgraph.by_directory(_facts(spark, d))


@query(
    "OP-A15_directory_report",
    """SELECT directory, callee, calls, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY calls DESC, callee) AS rank FROM (
      SELECT array_to_string(string_split(file, '/')[1:2], '/') AS directory, CASE WHEN is_creation AND created_type IS NOT NULL THEN 'new ' || created_type ELSE callee END AS callee, count(*) AS calls FROM call GROUP BY ALL)) WHERE rank <= 10""",
)
def _(spark, d):
    return callgraph.directory_report(_facts(spark, d))


@query("OP-R19_created_types", "SELECT DISTINCT class, created_type FROM cre")
def _(spark, d):
    return callgraph.created_types(_facts(spark, d))


@query("OP-F14_delegates", "SELECT DISTINCT c.site_id, d AS delegate FROM (SELECT site_id, caller_class, unnest(delegates) AS d FROM call) c JOIN defs o ON o.owner = c.caller_class AND o.method = c.d")
def _(spark, d):
    return callgraph.delegates(_facts(spark, d))


# ---- navigation

_KINDS = "kinds AS (SELECT m.method AS callee, min(m.owner) AS iface FROM met m JOIN subs s ON s.owner = m.owner WHERE m.owner_kind = 'interface' GROUP BY m.method)"


@query(
    "OP-N2_down",
    _inner(
        _KINDS,
        """SELECT c.caller_class AS class, c.caller_method AS method, c.callee, c.callee_class AS target_class, CASE WHEN k.iface IS NOT NULL THEN 'Interface' WHEN c.callee_class IN (SELECT name FROM cls) THEN 'Direct' ELSE 'External' END AS kind,
          k.iface, count(*) AS sites FROM call c LEFT JOIN kinds k ON k.callee = c.callee WHERE c.caller_class <> '' AND c.caller_method <> '' GROUP BY ALL
        UNION ALL SELECT caller_class, caller_method, x, caller_class, 'Delegate', NULL, count(*) FROM (SELECT caller_class, caller_method, unnest(delegates) AS x FROM call WHERE caller_class <> '' AND caller_method <> '') q
          WHERE EXISTS (SELECT 1 FROM defs WHERE defs.owner = q.caller_class AND defs.method = q.x) GROUP BY ALL""",
    ),
)
def _(spark, d):
    return navigate.down(_facts(spark, d)).select("class", "method", "callee", "target_class", "kind", "iface", "sites")


@query("OP-N3_down_interface", "SELECT ci.iface, m.method, ci.class FROM ci JOIN (SELECT DISTINCT owner, method FROM met WHERE owner_kind = 'interface') m ON m.owner = ci.iface JOIN cls ON cls.name = ci.class AND NOT is_abstract AND NOT is_static JOIN defs ON defs.owner = ci.class AND defs.method = m.method", idiomatic=True)
def _(spark, d):
    return navigate.down_interface(_more(spark, d))


@query("OP-N4_edge_kinds", _inner(_KINDS, "SELECT callee, iface, (SELECT count(*) FROM sub WHERE name = iface) AS options FROM kinds"))
def _(spark, d):
    return navigate.edge_kinds(_facts(spark, d)).select("callee", "iface", F.size("options").cast("long").alias("options"))


_UP = """free AS (SELECT * FROM call WHERE callee_class = ''), single AS (SELECT method FROM defs GROUP BY method HAVING count(*) = 1),
faced AS (SELECT name FROM ifc UNION SELECT iface FROM ci UNION SELECT owner FROM met WHERE owner_kind = 'interface'), node AS (SELECT DISTINCT owner, method FROM met WHERE owner_kind IN ('class', 'interface')),
face AS (SELECT * FROM node WHERE owner IN (SELECT name FROM faced)), own AS (SELECT * FROM node WHERE owner NOT IN (SELECT name FROM faced)),
given AS (SELECT caller_class, caller_method, x FROM (SELECT caller_class, caller_method, unnest(list_distinct(delegates)) AS x FROM call) WHERE caller_method <> x),
zero AS (SELECT f.owner AS class, f.method, c.caller_class, c.caller_method FROM face f JOIN call c ON c.callee = f.method
  WHERE c.callee_class = f.owner OR (c.callee_class = '' AND NOT coalesce(c.is_self_call, false) AND c.caller_class <> f.owner AND f.method IN (SELECT method FROM single))),
one AS (SELECT o.owner AS class, o.method, c.caller_class, c.caller_method FROM own o JOIN call c ON c.callee = o.method
  WHERE c.callee_class = o.owner OR (c.callee_class = '' AND NOT coalesce(c.is_self_call, false) AND c.target_expr NOT IN (SELECT name FROM cls) AND o.method IN (SELECT method FROM single))),
rest AS (SELECT owner AS class, method, owner IN (SELECT class FROM ci) AS linked FROM own o WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.class = o.owner AND one.method = o.method)),
three AS (SELECT r.class, r.method, c.caller_class, c.caller_method FROM rest r JOIN ci ON ci.class = r.class JOIN call c ON c.callee_class = ci.iface AND c.callee = r.method
  UNION ALL SELECT r.class, r.method, c.caller_class, c.caller_method FROM rest r JOIN free c ON c.callee = r.method WHERE r.linked AND c.caller_class <> r.class),
placed AS (SELECT r.*, CASE WHEN NOT linked THEN 2 WHEN EXISTS (SELECT 1 FROM three t WHERE t.class = r.class AND t.method = r.method) THEN 3 ELSE 5 END AS tier FROM rest r),
whole AS (SELECT class, method, 0 AS tier, false AS delegate, caller_class, caller_method, 1 AS n FROM zero UNION ALL SELECT class, method, 1, false, caller_class, caller_method, 1 FROM one
  UNION ALL SELECT class, method, 3, false, caller_class, caller_method, 1 FROM three
  UNION ALL SELECT class, method, 5, false, (SELECT iface FROM ci WHERE ci.class = p.class ORDER BY ord NULLS LAST, iface LIMIT 1), method, 0 FROM placed p WHERE tier = 5
  UNION ALL SELECT p.class, p.method, p.tier, true, g.caller_class, g.caller_method, 1 FROM placed p JOIN given g ON g.x = p.method)"""


@query("OP-N6_up", _inner(_UP, "SELECT class, method, tier, delegate, caller_class, caller_method, CAST(sum(n) AS BIGINT) AS sites FROM whole GROUP BY ALL"))
def _(spark, d):
    return navigate.up(_facts(spark, d))


@query("OP-N7_up_by_class", _inner(_UP, "SELECT class, method, caller_class, min(caller_method) AS first_method, count(DISTINCT caller_method) AS methods FROM whole GROUP BY ALL"))
def _(spark, d):
    return navigate.up_by_class(navigate.up(_facts(spark, d)))


@query("OP-N8_matching_interfaces", """SELECT o.owner AS class, o.method, ci.iface FROM defs o JOIN cls ON cls.name = o.owner JOIN ci ON ci.class = o.owner
    UNION SELECT ci.class, m.method, ci.iface FROM ci JOIN cls ON cls.name = ci.class JOIN met m ON m.owner = ci.iface AND m.owner_kind = 'interface' WHERE m.owner IN (SELECT name FROM ifc)
      AND NOT EXISTS (SELECT 1 FROM defs o WHERE o.owner = ci.class AND o.method = m.method)""")
def _(spark, d):
    return navigate.matching_interfaces(_facts(spark, d))


@query(
    "OP-N9_dispatch_sources",
    """SELECT DISTINCT a.owner AS class, a.method, b.owner AS source_class, b.method AS source_method
    FROM (SELECT DISTINCT owner, method, unnest(params) AS t FROM met WHERE owner_kind = 'class') a JOIN (SELECT name AS x, name AS y FROM cls UNION SELECT name, name FROM ifc UNION SELECT class, ancestor FROM up UNION SELECT ancestor, class FROM up) p ON p.x = a.t
    JOIN (SELECT DISTINCT owner, method, unnest(params) AS t FROM met WHERE owner_kind = 'class') b ON b.t = p.y
    WHERE a.owner <> b.owner AND (a.t IN (SELECT name FROM cls) OR a.t IN (SELECT name FROM ifc)) AND (b.t IN (SELECT name FROM cls) OR b.t IN (SELECT name FROM ifc))
      AND EXISTS (SELECT 1 FROM call c WHERE c.caller_class = b.owner AND c.caller_method = b.method AND c.callee_class = '' AND c.callee NOT IN (SELECT method FROM defs))""",
    idiomatic=True,
)
def _(spark, d):
    return navigate.dispatch_sources(_more(spark, d))


# ---- frontend over the source texts


def _parsed(spark: SparkSession, d: str, *relations: str, compat: bool = True) -> DataFrame:
    return frontend.parse(table(spark, d, "sources"), compat, relations=relations or None)


@query("OP-F3_types")
def _(spark, d):
    return frontend.relation(_parsed(spark, d, "types"), "types").select("file", "name", "kind", "base_class", F.array_join("interfaces", ",").alias("interfaces"), "is_abstract", "is_sealed", "is_static")


@query("OP-F6_methods")
def _(spark, d):
    return frontend.relation(_parsed(spark, d, "methods"), "methods").select("file", "owner", "owner_kind", "method", "signature", "line_start", "line_end")


@query("OP-F8_fields")
def _(spark, d):
    return frontend.relation(_parsed(spark, d, "fields"), "fields")


@query("OP-F12_calls")
def _(spark, d):
    return frontend.relation(_parsed(spark, d, "calls"), "calls").drop("delegates")


@query("OP-F16_creations")
def _(spark, d):
    return frontend.relation(_parsed(spark, d, "creations"), "creations")


@query("OP-C0_blocks")
def _(spark, d):
    return frontend.relation(_parsed(spark, d, "blocks"), "blocks")


@query("OP-C1_edges")
def _(spark, d):
    return frontend.relation(_parsed(spark, d, "edges"), "edges")


@query("OP-U1_routes")
def _(spark, d):
    return frontend.relation(_parsed(spark, d, "routes"), "routes")


@query("OP-S3_errors")
def _(spark, d):
    return _parsed(spark, d).where("error is not null").select("file", "error")


@query("OP-G11_dependence_graph")
def _(spark, d):
    p = _parsed(spark, d, "blocks", "edges", "names", compat=False)
    return graphs.dependence_graph(frontend.relation(p, "blocks"), frontend.relation(p, "edges"), compat=False, names=frontend.relation(p, "names"))


@query("OP-S16_code", "SELECT DISTINCT file, CAST(k AS INT) AS line, rtrim(code, chr(13)) AS code FROM (SELECT m.file, line_start, line_end, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM (SELECT DISTINCT file, line_start, line_end FROM met) m JOIN sources s ON s.file = m.file) WHERE k BETWEEN line_start AND line_end")
def _(spark, d):
    spans = _facts(spark, d).methods.select("file", "line_start", "line_end").distinct()
    return render.code_lines(table(spark, d, "sources").select("file", "text"), spans)


@query(
    "OP-U5_paths",
    """SELECT DISTINCT base, sub, CASE WHEN starts_with(sub, '/') THEN sub ELSE '/' || trim(trim(base, '/') || '/' || trim(coalesce(sub, ''), '/'), '/') END AS path
    FROM (SELECT array_to_string(string_split(file, '/')[1:2], '/') AS base, CASE WHEN line % 3 = 0 THEN '/' || callee WHEN line % 3 = 1 THEN callee || '/' END AS sub FROM call)""",
)
def _(spark, d):
    sub = F.when(F.col("line") % 3 == 0, F.concat(F.lit("/"), "callee")).when(F.col("line") % 3 == 1, F.concat("callee", F.lit("/")))
    rows = _facts(spark, d).calls.select(F.substring_index("file", "/", 2).alias("base"), sub.alias("sub")).distinct()
    return rows.withColumn("path", frontend.route_path(F.col("base"), F.col("sub")))


# ---- frontend over programs made from the parts, against lists of what is in them

_FLOW = [k for k, text in enumerate(generated.PROGRAMS) if any(r[0] == k for r in generated.FACTS["blocks"])]


def _made(spark: SparkSession, d: str, *relations: str) -> DataFrame:
    return frontend.parse(generated.sources(spark, d), relations=relations)


for _name, _relation in {
    "OP-F3_made_types": "types", "OP-F6_made_methods": "methods", "OP-F8_made_fields": "fields", "OP-F12_made_calls": "calls", "OP-F16_made_creations": "creations", "OP-U1_made_routes": "routes",
}.items():

    def _made_relation(spark, d, relation=_relation):
        return generated.shown(_made(spark, d, relation), relation)

    QUERIES_ALL[_name], ORACLES_ALL[_name] = _made_relation, generated.expected(_relation)

for _name, _relation in {"OP-C0_made_blocks": "blocks", "OP-C1_made_edges": "edges"}.items():

    def _made_flow(spark, d, relation=_relation):
        rows = generated.shown(_made(spark, d, relation), relation)
        part = F.regexp_extract("file", r"(\d+)", 1).cast("long") % len(generated.PROGRAMS)
        return rows.where(part.isin(_FLOW))

    QUERIES_ALL[_name], ORACLES_ALL[_name] = _made_flow, generated.expected(_relation)


def _made_count(table_: str, where: str = "true") -> str:
    """Number of rows of an expected relation over all parts."""
    return f"SELECT count(*) FROM ({generated.expected(table_)}) WHERE {where}"


QUERIES_ALL["OP-S5_made_project"], ORACLES_ALL["OP-S5_made_project"] = (
    lambda spark, d: _counted(frontend.facts_of(stored(_made(spark, d, *frontend.FACTS), "parsed"))),
    f"""SELECT 'classes' AS relation, ({_made_count('types', "kind = 'class'")}) AS n UNION ALL SELECT 'interfaces', ({_made_count('types', "kind = 'interface'")})
    UNION ALL SELECT 'methods', ({_made_count('methods')}) UNION ALL SELECT 'calls', ({_made_count('calls')}) UNION ALL SELECT 'fields', ({_made_count('fields')})""",
)
QUERIES_ALL["OP-U8_made_report"], ORACLES_ALL["OP-U8_made_report"] = (
    lambda spark, d: render.route_report(frontend.relation(_made(spark, d, "routes"), "routes")),
    f"""SELECT source, class, count(*) AS routes, string_agg(lpad(http_method, 6, ' ') || '  ' || rpad(path, 30, ' ') || '  ' || handler, chr(10) ORDER BY file, ord) AS listing FROM ({generated.expected('routes')}) GROUP BY ALL""",
)


def _dot(relation: str, text: str, order: str) -> str:
    return f"(SELECT file, string_agg({text}, chr(10) ORDER BY {order}) AS t FROM ({generated.expected(relation)}) GROUP BY file)"


QUERIES_ALL["OP-S10_made_dots"], ORACLES_ALL["OP-S10_made_dots"] = (
    lambda spark, d: _made_dots(spark, d),
    f"""SELECT n.file, concat_ws(chr(10), 'digraph {{', n.t, e.t, '}}') AS dot
    FROM {_dot('blocks', "'    ' || id || ' [ label = \"[' || id || '] ' || kind || ' (L' || start_line || '-L' || end_line || ')\" ]'", 'id')} n
    JOIN {_dot('edges', "'    ' || src || ' -> ' || dst || ' [ label = \"' || kind || '\" ]'", 'method_ord, edge_ord')} e USING (file)""",
)


def _made_dots(spark: SparkSession, d: str) -> DataFrame:
    p = _made(spark, d, "blocks", "edges")
    part = F.regexp_extract("file", r"(\d+)", 1).cast("long") % len(generated.PROGRAMS)
    return render.cfg_dots(frontend.relation(p, "blocks"), frontend.relation(p, "edges")).where(part.isin(_FLOW))


@query("OP-S3_made_errors", "SELECT CAST(NULL AS VARCHAR) AS file, CAST(NULL AS VARCHAR) AS error, count(*) AS files FROM part")
def _(spark, d):
    """No program fails: all files come out in one group without an error."""
    rows = _made(spark, d, *frontend.FACTS)
    return rows.groupBy(F.when(F.col("error").isNotNull(), F.col("file")).alias("file"), "error").agg(F.count("*").alias("files"))


# ---- graphs of single methods, over the events of a user as a method: event i goes on to i + 1, a click also skips one, a purchase loops

_CFG = """ev AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
node AS (SELECT user_id, i AS v, n FROM ev UNION ALL SELECT DISTINCT user_id, 0, n FROM ev UNION ALL SELECT DISTINCT user_id, n + 1, n FROM ev),
flow AS (SELECT DISTINCT user_id, 0 AS a, 1 AS b FROM ev UNION SELECT user_id, i, i + 1 FROM ev UNION SELECT user_id, i, i + 2 FROM ev WHERE event_type IN ('click', 'purchase') AND i < n UNION SELECT user_id, i + 1, i FROM ev WHERE event_type = 'purchase' AND i < n)"""


def _event_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("user_id")
    ev = table(spark, d, "events").select("user_id", "event_type", F.row_number().over(w.orderBy("event_id")).alias("i"), F.count("*").over(w).cast("int").alias("n"))
    file = F.col("user_id").cast("string").alias("file")
    key = [file, F.lit(0).alias("method_ord")]
    ends = ev.select("user_id", "n").distinct()
    row = lambda df, v, k: df.select(*key, v.cast("int").alias("id"), F.lit(k).alias("kind"))
    blocks = row(ends, F.lit(0), "Entry").unionByName(row(ends, F.col("n") + 1, "Exit")).unionByName(row(ev, F.col("i"), "Statement"))
    edge = lambda df, a, b: df.select(*key, a.cast("int").alias("src"), b.cast("int").alias("dst"))
    i = F.col("i")
    edges = edge(ends, F.lit(0), F.lit(1)).unionByName(edge(ev, i, i + 1))
    edges = edges.unionByName(edge(ev.where("event_type in ('click', 'purchase') and i < n"), i, i + 2)).unionByName(edge(ev.where("event_type = 'purchase' and i < n"), i + 1, i))
    return blocks, edges.distinct()


def _dominance(root: str, a: str, b: str) -> str:
    """d dominates v: v cannot be reached from the root once d is removed."""
    return f"""cut_ AS (SELECT n.user_id, n.v AS d, {root} AS v FROM node n WHERE n.v <> {root} UNION SELECT c.user_id, c.d, f.{b} FROM cut_ c JOIN flow f ON f.user_id = c.user_id AND f.{a} = c.v WHERE f.{b} <> c.d),
    dom AS (SELECT x.user_id, y.v AS node, x.v AS dominator FROM node x JOIN node y USING (user_id) WHERE x.v = {root.replace('n.n', 'x.n')} OR x.v = y.v OR NOT EXISTS (SELECT 1 FROM cut_ c WHERE c.user_id = x.user_id AND c.d = x.v AND c.v = y.v))"""


_DOM = _dominance("0", "a", "b")
_PDOM = _dominance("n.n + 1", "b", "a")


_PAIRS = "SELECT CAST(user_id AS VARCHAR) AS file, CAST(node AS INT) AS node, CAST(dominator AS INT) AS dominator FROM dom"
# the closest of the strict dominators is the one with most dominators itself
_NEAREST = """SELECT CAST(user_id AS VARCHAR) AS file, CAST(node AS INT) AS node, CAST(arg_max(d.dominator, s.n) AS INT) AS dominator
    FROM dom d JOIN (SELECT user_id, node AS dominator, count(*) AS n FROM dom GROUP BY ALL) s USING (user_id, dominator) WHERE d.node <> d.dominator GROUP BY ALL"""


@query("OP-G1_dominators", _inner(f"{_CFG}, {_DOM}", _PAIRS))
def _(spark, d):
    return graphs.dominator_pairs(*_event_graph(spark, d)).select("file", "node", "dominator")


@query("OP-G2_post_dominators", _inner(f"{_CFG}, {_PDOM}", _PAIRS))
def _(spark, d):
    return graphs.dominator_pairs(*_event_graph(spark, d), post=True).select("file", "node", "dominator")


@query("OP-G3_immediate_dominators", _inner(f"{_CFG}, {_DOM}", _NEAREST))
def _(spark, d):
    return graphs.dominator_pairs(*_event_graph(spark, d)).where("immediate").select("file", "node", "dominator")


@query("OP-G3_immediate_post_dominators", _inner(f"{_CFG}, {_PDOM}", _NEAREST))
def _(spark, d):
    return graphs.dominator_pairs(*_event_graph(spark, d), post=True).where("immediate").select("file", "node", "dominator")


_CONTROL = """SELECT DISTINCT CAST(f.user_id AS VARCHAR) AS file, CAST(f.a AS INT) AS src, CAST(d.dominator AS INT) AS dst FROM flow f JOIN dom d ON d.user_id = f.user_id AND d.node = f.b
    WHERE NOT EXISTS (SELECT 1 FROM dom s WHERE s.user_id = f.user_id AND s.node = f.a AND s.dominator = d.dominator AND s.dominator <> f.a)
      AND d.dominator NOT IN (0, (SELECT max(v) FROM node WHERE node.user_id = f.user_id)) AND (SELECT count(*) FROM flow g WHERE g.user_id = f.user_id AND g.a = f.a) >= 2"""
# an event defines its kind, and uses its kind and clicks; a definition comes along until the name is defined again
_COMES = """comes AS (SELECT e.user_id, e.i AS d, e.event_type AS x, f.b AS v FROM ev e JOIN flow f ON f.user_id = e.user_id AND f.a = e.i
  UNION SELECT c.user_id, c.d, c.x, f.b FROM comes c JOIN ev e ON e.user_id = c.user_id AND e.i = c.v AND e.event_type <> c.x JOIN flow f ON f.user_id = c.user_id AND f.a = c.v)"""
_DATA = "SELECT CAST(c.user_id AS VARCHAR) AS file, CAST(c.d AS INT) AS src, CAST(c.v AS INT) AS dst, c.x AS name FROM comes c JOIN ev u ON u.user_id = c.user_id AND u.i = c.v AND (c.x = u.event_type OR c.x = 'click')"


def _event_names(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    ev = table(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), F.lit(0).alias("method_ord"), F.row_number().over(w).alias("id"), "event_type")
    return ev.select("file", "method_ord", "id", F.array("event_type").alias("defs"), F.array("event_type", F.lit("click")).alias("uses"))


@query("OP-G10_reaching_definitions", _inner(f"{_CFG}, {_COMES}", _DATA))
def _(spark, d):
    return graphs.data_dependences(*_event_graph(spark, d), _event_names(spark, d)).select("file", "src", "dst", "name")


@query(
    "OP-G11_event_graph",
    _inner(
        f"{_CFG}, {_PDOM}, {_COMES}",
        f"""SELECT CAST(user_id AS VARCHAR) AS file, CAST(a AS INT) AS src, CAST(b AS INT) AS dst, 'cfg(Seq)' AS kind FROM flow
        UNION ALL SELECT file, src, dst, 'control' FROM ({_CONTROL}) UNION ALL SELECT DISTINCT file, src, dst, 'data' FROM ({_DATA})""",
    ),
)
def _(spark, d):
    blocks, edges = _event_graph(spark, d)
    return graphs.dependence_graph(blocks, edges.withColumn("kind", F.lit("Seq")), compat=False, names=_event_names(spark, d)).select("file", "src", "dst", "kind")


@query("OP-G9_control_dependence", _inner(f"{_CFG}, {_PDOM}", _CONTROL))
def _(spark, d):
    return graphs.control_dependences(*_event_graph(spark, d)).select("file", "src", "dst")


_REGIONS = f"""{_CFG}, {_DOM}, {_PDOM.replace('cut_', 'pcut_').replace('dom AS (SELECT x', 'pdom AS (SELECT x')},
pair AS (SELECT d.user_id, d.dominator AS h, d.node AS t FROM dom d JOIN pdom p ON p.user_id = d.user_id AND p.node = d.dominator AND p.dominator = d.node JOIN node k ON k.user_id = d.user_id AND k.v = d.node
  WHERE d.dominator <> d.node AND d.dominator <> 0 AND d.node <> k.n + 1),
body AS (SELECT user_id, h, t, h AS v FROM pair UNION SELECT b.user_id, b.h, b.t, f.b FROM body b JOIN flow f ON f.user_id = b.user_id AND f.a = b.v WHERE f.b <> b.t),
entered AS (SELECT DISTINCT b.user_id, b.h, b.t FROM body b JOIN flow f ON f.user_id = b.user_id AND f.b = b.v WHERE b.v <> b.h
  AND NOT EXISTS (SELECT 1 FROM body c WHERE c.user_id = b.user_id AND c.h = b.h AND c.t = b.t AND c.v = f.a))"""


@query(
    "OP-G4_hammocks",
    _inner(
        _REGIONS,
        """SELECT CAST(user_id AS VARCHAR) AS file, CAST(h AS INT) AS header, CAST(t AS INT) AS footer, CAST(count(*) AS INT) AS blocks FROM body b
        WHERE NOT EXISTS (SELECT 1 FROM entered e WHERE e.user_id = b.user_id AND e.h = b.h AND e.t = b.t) GROUP BY user_id, h, t HAVING count(*) > 1""",
    ),
)
def _(spark, d):
    return graphs.regions(*_event_graph(spark, d)).select("file", "header", "footer", F.size("body").alias("blocks"))


@query("OP-G12_control_context")
def _(spark, d):
    p = _parsed(spark, d, "blocks", "edges", "calls")
    lines = frontend.relation(p, "calls").select("file", "line").distinct()
    return graphs.control_context(frontend.relation(p, "blocks"), frontend.relation(p, "edges"), lines, table(spark, d, "sources")).select("file", "line", F.array_join("conditions", "; ").alias("conditions"))


@query("OP-G10_data_dependence")
def _(spark, d):
    p = _parsed(spark, d, "blocks", "edges", "names", compat=False)
    return graphs.data_dependences(frontend.relation(p, "blocks"), frontend.relation(p, "edges"), frontend.relation(p, "names"))


# ---- the rest of the inventory


@query("OP-R8_di_registrations", r"""SELECT DISTINCT trim(a[1]) AS interface_type, trim(coalesce(a[2], a[1])) AS implementation_type, regexp_extract(callee, '^Add(Scoped|Singleton|Transient)<', 1) AS lifetime, 'DiRegistration' AS confidence
    FROM (SELECT callee, string_split(regexp_extract(callee, '^Add(?:Scoped|Singleton|Transient)<(.+)>$', 1), ',') AS a FROM call WHERE regexp_matches(callee, '^Add(Scoped|Singleton|Transient)<.+>$'))""", idiomatic=True)
def _(spark, d):
    return resolve.di_registrations(_more(spark, d))


@query(
    "OP-R7_register",
    r"""SELECT DISTINCT trim(a[1]) AS interface_type, trim(coalesce(a[2], a[1])) AS implementation_type, regexp_extract(callee, '^Add(Scoped|Singleton|Transient)<', 1) AS lifetime, 'DiRegistration' AS confidence
    FROM (SELECT callee, string_split(regexp_extract(callee, '^Add(?:Scoped|Singleton|Transient)<(.+)>$', 1), ',') AS a FROM call WHERE regexp_matches(callee, '^Add(Scoped|Singleton|Transient)<.+>$'))
    UNION ALL SELECT 'IByHand', 'ByHand', 'Transient', 'DynamicString'""",
    idiomatic=True,
)
def _(spark, d):
    return resolve.register(resolve.di_registrations(_more(spark, d)), "IByHand", "ByHand", "Transient", "DynamicString")


@query(
    "OP-R9_registered_di",
    r"""SELECT DISTINCT t.site_id, 'di' AS strategy, 'DiRegistration' AS confidence, r.c AS owner, t.method FROM target t JOIN (SELECT trim(a[1]) AS i, trim(coalesce(a[2], a[1])) AS c
      FROM (SELECT string_split(regexp_extract(callee, '^Add(?:Scoped|Singleton|Transient)<(.+)>$', 1), ',') AS a FROM call WHERE regexp_matches(callee, '^Add(Scoped|Singleton|Transient)<.+>$'))) r ON r.i = t.class
    WHERE r.c IN (SELECT name FROM cls)""",
    idiomatic=True,
)
def _(spark, d):
    """By the registrations that the calls themselves make."""
    f = _more(spark, d)
    return resolve.resolve_di(f, resolve.call_targets(f), resolve.di_registrations(f))


@query("OP-A6_suggestions", _inner(_EDGES, "SELECT key FROM (SELECT src AS key FROM edge UNION SELECT dst FROM edge) WHERE contains(lower(key), 'ledger') AND contains(lower(key), 'load') ORDER BY key LIMIT 10"))
def _(spark, d):
    return spark.createDataFrame([(k,) for k in impact.suggestions(_facts(spark, d), "Ledger", "load")], "key string")


@query(
    "OP-N1_start",
    """SELECT method, CAST(row_number() OVER (ORDER BY spot, method) - 1 AS INT) AS place FROM (SELECT m.method, min((m.file, m.ord)) AS spot FROM met m
      WHERE m.owner_kind = 'class' AND m.owner = (SELECT owner FROM met WHERE owner_kind = 'class' AND owner IN (SELECT name FROM cls) GROUP BY owner ORDER BY count(DISTINCT method) DESC, owner LIMIT 1)
      AND NOT regexp_matches(m.method, '^(get_|set_|add_|remove_|[.]ctor$)') AND m.method <> m.owner GROUP BY m.method)""",
)
def _(spark, d):
    f = _facts(spark, d)
    known = f.methods.where("owner_kind = 'class'").join(f.classes.select(F.col("name").alias("owner")), "owner", "left_semi")
    top = known.groupBy("owner").agg(F.count_distinct("method").alias("n")).orderBy(F.desc("n"), "owner").first()
    nodes = navigate.start(f, top[0]) if top else []
    return spark.createDataFrame([(m, k) for k, (_, m) in enumerate(nodes)], "method string, place int")


@query("OP-R10_di_calls", r"""SELECT site_id, CASE WHEN m IN ('AddScoped', 'AddSingleton', 'AddTransient') THEN 'Static' ELSE 'DiResolved' END AS kind, t AS type, m AS method
    FROM (SELECT site_id, regexp_extract(callee, '^(\w+)<', 1) AS m, trim(regexp_extract(callee, '^\w+<((?:[^,<>]|<[^<>]*>)*)', 1)) AS t FROM call WHERE suffix(callee, '>'))
    WHERE t <> '' AND m IN ('AddScoped', 'AddSingleton', 'AddTransient', 'GetService', 'GetRequiredService', 'GetKeyedService')""", idiomatic=True)
def _(spark, d):
    return resolve.di_calls(_more(spark, d))


@query("OP-R15_reflection_patterns", r"SELECT site_id, regexp_extract(target_expr, '^typeof\(\s*([\w.<>, ]+?)\s*\)$', 1) AS type, callee AS method FROM call WHERE regexp_matches(target_expr, '^typeof\(.+\)$') AND callee IN ('GetMethod', 'GetProperty', 'GetField', 'CreateInstance')", idiomatic=True)
def _(spark, d):
    return resolve.reflection_patterns(_more(spark, d))


@query("OP-R10_parsed_di_calls")
def _(spark, d):
    return resolve.di_calls(frontend.facts_of(_parsed(spark, d, *frontend.FACTS)))


@query(
    "OP-N5_bare_targets",
    """SELECT c.caller_class, c.callee, c.targeted, min(o.owner) AS target_class FROM (SELECT DISTINCT caller_class, callee, target_expr <> '' AS targeted FROM call WHERE callee_class = '') c
    JOIN defs o ON o.method = c.callee WHERE NOT targeted OR o.owner <> c.caller_class GROUP BY ALL""",
)
def _(spark, d):
    return navigate.bare_targets(_facts(spark, d))


@query("OP-G14_method_files", "SELECT owner, method, min(file) AS file FROM met WHERE file <> '' GROUP BY owner, method")
def _(spark, d):
    return navigate.method_files(_facts(spark, d))


@query("OP-N10_contexts")
def _(spark, d):
    p = stored(_parsed(spark, d, "blocks", "edges", "arguments", *frontend.FACTS), "parsed")
    f = frontend.facts_of(p)
    lines = f.calls.select("file", "line").distinct()
    sources = table(spark, d, "sources").select("file", "text")
    conditions = graphs.control_context(frontend.relation(p, "blocks"), frontend.relation(p, "edges"), lines, sources)
    return navigate.contexts(f, conditions, graphs.data_context(frontend.relation(p, "arguments"), sources)).where("context <> ''")


@query("OP-F2_statements")
def _(spark, d):
    return frontend.relation(_parsed(spark, d, "statements"), "statements")


@query("OP-G13_data_context")
def _(spark, d):
    return graphs.data_context(frontend.relation(_parsed(spark, d, "arguments"), "arguments"), table(spark, d, "sources").select("file", "text"))


@query("OP-S7_type_graph")
def _(spark, d):
    f = _more(spark, d)
    return render.type_graph_json(f)


@query("OP-S10_cfg_dot")
def _(spark, d):
    p = _parsed(spark, d, "blocks", "edges")
    return render.cfg_dots(frontend.relation(p, "blocks"), frontend.relation(p, "edges"))


@query("OP-U8_route_report")
def _(spark, d):
    return render.route_report(frontend.relation(_parsed(spark, d, "routes"), "routes"))


@query("OP-S5_parsed_project")
def _(spark, d):
    return _counted(frontend.facts_of(_parsed(spark, d, *frontend.FACTS)))


def _counted(f) -> DataFrame:
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("relation"), "n") for k, df in (("classes", f.classes), ("interfaces", f.interfaces), ("methods", f.methods), ("calls", f.calls), ("fields", f.fields))]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3]).unionByName(counted[4])


@query("OP-D0_parsed")
def _(spark, d):
    return patterns.hits(patterns.detect(frontend.facts_of(_parsed(spark, d, *frontend.FACTS), "first")))


# the checks are registered with the program's; this module names its own share of them
QUERIES = {k: v for k, v in QUERIES_ALL.items() if k not in _before}
ORACLES = {k: v for k, v in ORACLES_ALL.items() if k in QUERIES}
