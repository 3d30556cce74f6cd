"""Queries of the operators on programs, over the code tables, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as facts_
from ..operators import patterns, resolve, types
from . import idioms
from .problems import _named, _simple

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, idiomatic: bool = False) -> Callable[[Query], Query]:
    """Register a query and its check; ``idiomatic``: both over the tables with the small programs of ``idioms``."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE {idioms.as_sql(FACTS) if idiomatic else FACTS}\n{sql}"
        return f

    return keep


#: The facts in plain SQL, common to the checks below.
FACTS = f"""
cls AS (
  SELECT name, base_class, is_abstract, is_sealed, is_static, file FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, class_id) AS rn FROM (
      SELECT {_named('name')} AS name, {_named('base_class')} AS base_class, is_abstract, is_sealed, is_static, coalesce(file, '') AS file, class_id FROM classes)
    WHERE name IS NOT NULL) WHERE rn = 1),
cls_append AS (
  SELECT name, arg_max(base_class, (file, class_id)) FILTER (base_class IS NOT NULL) AS base_class FROM (
    SELECT {_named('name')} AS name, {_named('base_class')} AS base_class, coalesce(file, '') AS file, class_id FROM classes) WHERE name IS NOT NULL GROUP BY name),
ifc AS (SELECT {_named('name')} AS name, min(coalesce(file, '')) AS file FROM interfaces WHERE {_named('name')} IS NOT NULL GROUP BY ALL),
ci AS (SELECT {_named('class')} AS class, {_named('iface')} AS iface, min(ord) AS ord FROM class_iface WHERE {_named('class')} IS NOT NULL AND {_named('iface')} IS NOT NULL GROUP BY ALL),
met AS (
  SELECT DISTINCT {_named('owner')} AS owner, coalesce(owner_kind, '') AS owner_kind, ord, coalesce(method, '') AS method, coalesce(signature, '') AS signature, coalesce(ret, '') AS ret,
    coalesce(params, []) AS params, is_static, is_virtual, is_abstract, coalesce(file, '') AS file, line_start, line_end,
    coalesce(nullif(split_part(ltrim(coalesce(signature, '')), ' ', 1), ''), 'void') AS ret1,
    (starts_with(method, 'get_') OR starts_with(method, 'set_')) AS accessor,
    CASE WHEN contains(signature, '(') THEN split_part(substr(signature, strpos(signature, '(') + 1), ')', 1) ELSE '' END AS between_
  FROM methods WHERE {_named('owner')} IS NOT NULL),
call AS (
  SELECT site_id, any_value(coalesce(file, '')) AS file, any_value(coalesce({_simple('caller_class')}, '')) AS caller_class, any_value(coalesce(caller_method, '')) AS caller_method,
    any_value(coalesce(callee, '')) AS callee, any_value(coalesce({_simple('callee_class')}, '')) AS callee_class, any_value(coalesce(target_expr, '')) AS target_expr,
    any_value(is_self_call) AS is_self_call, any_value(is_creation) AS is_creation, any_value({_named('created_type')}) AS created_type, any_value(line) AS line, any_value(coalesce(delegates, [])) AS delegates
  FROM calls WHERE site_id IS NOT NULL GROUP BY site_id),
cre AS (SELECT caller_class AS class, created_type FROM call WHERE is_creation AND created_type IS NOT NULL),
up AS (SELECT name AS class, base_class AS ancestor FROM cls WHERE base_class IS NOT NULL
  UNION SELECT u.class, c.base_class FROM up u JOIN cls c ON c.name = u.ancestor WHERE c.base_class IS NOT NULL),
line_ AS (SELECT name AS class, name AS ancestor FROM cls UNION SELECT class, ancestor FROM up),
impl AS (SELECT DISTINCT ci.iface, l.class FROM line_ l JOIN ci ON ci.class = l.ancestor),
sub AS (SELECT DISTINCT x.name, x.class FROM (SELECT ancestor AS name, class FROM line_ UNION ALL SELECT iface, class FROM impl) x
  JOIN cls c ON c.name = x.class AND NOT c.is_abstract AND NOT c.is_static),
own AS (SELECT * FROM met WHERE owner_kind = 'class' AND owner IN (SELECT name FROM cls)),
face AS (SELECT * FROM met WHERE owner_kind = 'interface' AND owner IN (SELECT name FROM ifc)),
faces AS (SELECT owner, count(*) AS n, list(method) AS methods, min(method) AS one, min(ret1) AS one_ret FROM face WHERE NOT accessor GROUP BY owner),
subs AS (SELECT name AS owner, count(*) AS subs FROM sub GROUP BY name),
open_ AS (SELECT name FROM ifc UNION SELECT name FROM cls WHERE is_abstract),
direct_ AS (SELECT ci.iface AS owner, count(DISTINCT class) AS n_direct, min(class) AS one_class FROM ci JOIN cls ON cls.name = ci.class AND NOT is_abstract GROUP BY ci.iface),
target AS (
  SELECT site_id,
    CASE WHEN is_creation THEN 'Static' WHEN regexp_full_match(target_expr, '\\p{{Lu}}[\\p{{L}}\\p{{N}}_]*') THEN 'Static' WHEN callee_class IN (SELECT name FROM open_) THEN 'Abstract'
      WHEN callee_class IN (SELECT name FROM cls) THEN 'Virtual' ELSE 'Instance' END AS kind,
    coalesce(CASE WHEN is_creation THEN created_type WHEN regexp_full_match(target_expr, '\\p{{Lu}}[\\p{{L}}\\p{{N}}_]*') THEN target_expr ELSE callee_class END, '') AS class,
    CASE WHEN is_creation THEN '.ctor' ELSE callee END AS method FROM call),
defs AS (SELECT DISTINCT owner, method FROM met WHERE owner_kind = 'class'),
cand AS (SELECT t.site_id, t.kind, t.class AS called, t.method, s.class AS owner, d.owner IS NOT NULL AS defined
  FROM target t JOIN sub s ON s.name = t.class LEFT JOIN defs d ON d.owner = s.class AND d.method = t.method)"""


def _facts(spark: SparkSession, d: str, merge: str = "first") -> facts_.Facts:
    return facts_.from_tables(spark, d, merge)


def _more(spark: SparkSession, d: str) -> facts_.Facts:
    return idioms.facts(spark, d)


# ---- facts


@query("OP-S5_project", "SELECT (SELECT count(*) FROM cls) AS classes, (SELECT count(*) FROM ifc) AS interfaces, (SELECT count(*) FROM call) AS calls, (SELECT count(*) FROM met) AS methods")
def _(spark, d):
    f = _facts(spark, d)
    parts = [df.select(F.lit(k).alias("k")) for k, df in (("classes", f.classes), ("interfaces", f.interfaces), ("calls", f.calls), ("methods", f.methods))]
    counted = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy().agg(*(F.count_if(F.col("k") == k).alias(k) for k in ("classes", "interfaces", "calls", "methods")))
    return counted


@query("OP-F4_classes_first", "SELECT name, base_class, is_abstract, is_sealed, is_static, file FROM cls")
def _(spark, d):
    return _facts(spark, d).classes


@query("OP-F4_classes_append", "SELECT name, base_class FROM cls_append")
def _(spark, d):
    return _facts(spark, d, "append").classes.select("name", "base_class")


@query(
    "OP-F10_inheritance",
    """, refs AS (SELECT name AS class, base_class AS ref FROM cls WHERE base_class IS NOT NULL UNION SELECT class, iface FROM ci)
    SELECT class, ref, CASE WHEN ref IN (SELECT name FROM ifc) THEN 'interface' WHEN ref IN (SELECT name FROM cls) THEN 'class' ELSE 'interface' END AS kind FROM refs""".replace(", refs", "SELECT * FROM (WITH refs", 1) + ")",
)
def _(spark, d):
    f = _facts(spark, d)
    refs = f.classes.where("base_class is not null").select(F.col("name").alias("class"), F.col("base_class").alias("ref")).unionByName(f.class_iface.select("class", F.col("iface").alias("ref"))).distinct()
    faces, classes = f.interfaces.select(F.col("name").alias("ref"), F.lit(True).alias("i")), f.classes.select(F.col("name").alias("ref"), F.lit(True).alias("c"))
    return refs.join(faces, "ref", "left").join(classes, "ref", "left").select("class", "ref", F.when(F.col("i"), "interface").when(F.col("c"), "class").otherwise("interface").alias("kind"))


@query(
    "OP-F15_callee_binding",
    """SELECT c.site_id, CASE WHEN c.is_self_call OR c.target_expr = '' THEN coalesce(CASE WHEN o.owner IS NOT NULL THEN c.caller_class END, a.owner, '')
      WHEN k.name IS NOT NULL THEN c.target_expr ELSE '' END AS bound
    FROM call c LEFT JOIN defs o ON o.owner = c.caller_class AND o.method = c.callee LEFT JOIN (SELECT method, min(owner) AS owner FROM defs GROUP BY method) a ON a.method = c.callee
    LEFT JOIN cls k ON k.name = c.target_expr""",
)
def _(spark, d):
    from ..operators.callgraph import bind_callees

    return bind_callees(_facts(spark, d)).select("site_id", "bound")


# ---- hierarchy


@query("OP-H1_ancestors", "SELECT class, ancestor FROM up")
def _(spark, d):
    return types.ancestors(_facts(spark, d)).select("class", "ancestor")


@query("OP-H2_implementors", "SELECT iface, class FROM impl")
def _(spark, d):
    return types.implementors(_facts(spark, d))


QUERIES["OP-H4_implementors_of"], ORACLES["OP-H4_implementors_of"] = (
    lambda spark, d: types.implementors(_facts(spark, d)).groupBy("iface").agg(F.count("*").alias("n"), F.min("class").alias("first")),
    f"WITH RECURSIVE {FACTS} SELECT iface, count(*) AS n, min(class) AS first FROM impl GROUP BY iface",
)


@query("OP-H3_concrete_subtypes", "SELECT name, class FROM sub")
def _(spark, d):
    return types.concrete_subtypes(_facts(spark, d))


@query("OP-H5_direct_implementors", "SELECT DISTINCT iface, class FROM ci")
def _(spark, d):
    return types.direct_implementors(_facts(spark, d))


@query("OP-H6_interface_names", "SELECT name FROM ifc UNION SELECT iface FROM ci")
def _(spark, d):
    return types.interface_names(_facts(spark, d))


@query("OP-H7_subtypes", "SELECT name AS sub, name AS super FROM (SELECT name FROM cls UNION SELECT name FROM ifc UNION SELECT iface FROM ci) UNION SELECT class, ancestor FROM up")
def _(spark, d):
    return types.subtypes(_facts(spark, d))


@query(
    "OP-H8_compatible_methods",
    """SELECT a_owner, count(*) AS pairs FROM (SELECT DISTINCT a.owner AS a_owner, a.method AS a_method, b.owner AS b_owner, b.method AS b_method
    FROM (SELECT DISTINCT owner, method, unnest(params) AS t FROM met WHERE owner_kind = 'class') a
    JOIN (SELECT t AS x, t AS y FROM (SELECT name AS t FROM cls UNION SELECT name FROM ifc) UNION SELECT class, ancestor FROM up UNION SELECT ancestor, class FROM up) p ON p.x = a.t
    JOIN (SELECT DISTINCT owner, method, unnest(params) AS t FROM met WHERE owner_kind = 'class') b ON b.t = p.y
    WHERE a.owner <> b.owner AND a.t IN (SELECT name FROM cls UNION SELECT name FROM ifc) AND b.t IN (SELECT name FROM cls UNION SELECT name FROM ifc)) GROUP BY a_owner""",
    idiomatic=True,
)
def _(spark, d):
    return types.compatible_methods(_more(spark, d)).groupBy("a_owner").agg(F.count("*").alias("pairs"))


@query("OP-H9_controllers", "SELECT DISTINCT class FROM up WHERE ancestor IN ('ControllerBase', 'Controller')", idiomatic=True)
def _(spark, d):
    return types.controllers(_more(spark, d))


@query("OP-H10_unique_methods", "SELECT method, min(owner) AS owner FROM defs GROUP BY method HAVING count(*) = 1")
def _(spark, d):
    return types.unique_methods(_facts(spark, d))


# ---- resolution

_R = {
    "direct": "SELECT site_id, 'direct' AS strategy, 'Direct' AS confidence, class AS owner, method FROM target WHERE kind IN ('Static', 'Instance')",
    "cha": "SELECT site_id, 'cha' AS strategy, 'CHA' AS confidence, owner, method FROM cand WHERE kind IN ('Virtual', 'Abstract') AND defined",
    "rta": "SELECT site_id, 'rta' AS strategy, 'RTA' AS confidence, owner, method FROM cand WHERE kind IN ('Virtual', 'Abstract') AND defined AND owner IN (SELECT created_type FROM cre)",
    "abstract": """SELECT site_id, 'abstract' AS strategy, CASE WHEN count(*) OVER (PARTITION BY site_id) = 1 THEN 'ExplicitImpl' ELSE 'CHA' END AS confidence, owner, method
      FROM cand WHERE kind = 'Abstract' OR (kind IN ('Static', 'Virtual') AND called IN (SELECT name FROM cls WHERE is_abstract))""",
    "interface": """SELECT site_id, 'interface' AS strategy, CASE WHEN count(*) OVER (PARTITION BY site_id) = 1 THEN 'ExplicitImpl' ELSE 'MultiImpl' END AS confidence, owner, method
      FROM cand WHERE kind IN ('Abstract', 'Virtual') AND called IN (SELECT name FROM ifc) AND defined""",
    "factory": "SELECT site_id, 'factory' AS strategy, 'RTA' AS confidence, CAST(NULL AS VARCHAR) AS owner, method FROM target WHERE kind IN ('Static', 'Instance') AND method IN ('Create', 'Build', 'Make', 'Resolve', 'GetInstance')",
    "reflection": "SELECT site_id, 'reflection' AS strategy, 'DynamicString' AS confidence, nullif(class, '') AS owner, '' AS method FROM target WHERE kind = 'Static' AND method IN ('GetMethod', 'GetProperty', 'GetField', 'CreateInstance')",
    "dynamic": "SELECT site_id, 'dynamic' AS strategy, 'Unknown' AS confidence, CAST(NULL AS VARCHAR) AS owner, method FROM target",
}
_SCORE = "CASE confidence WHEN 'Direct' THEN 100 WHEN 'ExplicitImpl' THEN 95 WHEN 'CHA' THEN 70 WHEN 'MultiImpl' THEN 60 WHEN 'RTA' THEN 50 WHEN 'DynamicString' THEN 10 ELSE 0 END"


@query("OP-R1_call_targets", "SELECT site_id, kind, class, method FROM target")
def _(spark, d):
    return resolve.call_targets(_facts(spark, d))


def _strategy(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = _more(spark, d)
        targets = resolve.call_targets(f)
        if name in ("direct", "factory", "reflection", "dynamic"):
            return getattr(resolve, f"resolve_{name}")(targets)
        return getattr(resolve, f"resolve_{name}")(f, targets, types.concrete_subtypes(f))

    return run


for _key, _op in (("direct", "R2"), ("cha", "R3"), ("rta", "R4"), ("abstract", "R5"), ("interface", "R6"), ("factory", "R12"), ("reflection", "R14"), ("dynamic", "R16")):
    query(f"OP-{_op}_{_key}", _R[_key], idiomatic=True)(_strategy(_key))

_REG = """reg AS (SELECT iface AS interface_type, class AS implementation_type, CASE WHEN ord = 0 THEN 'DiRegistration' ELSE 'Reflection' END AS confidence FROM ci)"""


@query(
    "OP-R9_di",
    f"""SELECT * FROM (WITH {_REG}, best AS (SELECT interface_type, max(CASE confidence WHEN 'DiRegistration' THEN 95 ELSE 40 END) AS top FROM reg WHERE implementation_type IN (SELECT name FROM cls) GROUP BY 1)
    SELECT DISTINCT t.site_id, 'di' AS strategy, CASE WHEN b.top = 95 THEN 'DiRegistration' ELSE 'Reflection' END AS confidence, r.implementation_type AS owner, t.method
    FROM target t JOIN reg r ON r.interface_type = t.class JOIN best b ON b.interface_type = r.interface_type WHERE r.implementation_type IN (SELECT name FROM cls))""",
)
def _(spark, d):
    """The class-interface links stand in for registrations: the first interface registered, later ones seen by reflection."""
    f = _facts(spark, d)
    registrations = f.class_iface.select(
        F.col("iface").alias("interface_type"), F.col("class").alias("implementation_type"), F.lit("Scoped").alias("lifetime"), F.when(F.col("ord") == 0, "DiRegistration").otherwise("Reflection").alias("confidence")
    )
    return resolve.resolve_di(f, resolve.call_targets(f), registrations)


@query("OP-R11_factories", "SELECT DISTINCT ret AS return_type, owner, method FROM met WHERE ret IN (SELECT name FROM open_) AND regexp_matches(method, '^(Create|Build|Make|Resolve|GetInstance)')", idiomatic=True)
def _(spark, d):
    return resolve.factories(_more(spark, d))


@query(
    "OP-R17_best",
    f"""SELECT site_id, strategy, confidence, score, targets FROM (
      SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, strategy DESC) AS rn FROM (
        SELECT site_id, strategy, confidence, {_SCORE} AS score, count(owner) AS targets FROM ({' UNION ALL '.join(_R.values())}) GROUP BY ALL)) WHERE rn = 1""",
    idiomatic=True,
)
def _(spark, d):
    return resolve.best(_more(spark, d))


@query("OP-R18_top_callees", "SELECT callee, count(*) AS calls FROM call GROUP BY callee ORDER BY calls DESC, callee LIMIT 15")
def _(spark, d):
    return resolve.top_callees(_facts(spark, d))


@query("OP-R19_creations", "SELECT class, created_type, count(*) AS n FROM cre GROUP BY ALL")
def _(spark, d):
    return resolve.creation_counts(_facts(spark, d))


# ---- patterns


def _detector(*names: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = patterns.context(_more(spark, d))
        out = None
        for name in names:
            found = getattr(patterns, name)(c)
            out = found if out is None else out.unionByName(found)
        return out.select("pattern", "class", "confidence", F.array_join("evidence", ",").alias("evidence"))

    return run


_EV = "array_to_string(list_sort({}), ',')"
_SOLID = "SELECT name FROM cls WHERE NOT is_abstract"
_D: dict[str, tuple[str, str]] = {
    "D1": ("singleton", f"SELECT 'Singleton' AS pattern, owner AS class, CAST(0.9 AS DOUBLE) AS confidence, {_EV.format('list(method)')} AS evidence FROM own WHERE is_static AND ret1 = owner GROUP BY owner"),
    "D2": ("factory_method", "SELECT 'FactoryMethod' AS pattern, owner AS class, CAST(0.85 AS DOUBLE) AS confidence, method AS evidence FROM own WHERE ret1 NOT IN ('void', owner) AND ret1 IN (SELECT name FROM open_)"),
    "D3": ("abstract_factory", f"SELECT 'AbstractFactory' AS pattern, owner AS class, CAST(0.9 AS DOUBLE) AS confidence, {_EV.format('list(method)')} AS evidence FROM face WHERE ret1 <> 'void' AND ret1 IN (SELECT name FROM ifc) GROUP BY owner HAVING count(*) >= 2"),
    "D4": (
        "builder",
        f"""SELECT 'Builder' AS pattern, owner AS class, CAST(0.85 AS DOUBLE) AS confidence, {_EV.format("list(method) FILTER ((NOT is_static AND ret1 = owner) OR ret1 NOT IN ('void', owner))")} AS evidence
        FROM own WHERE owner IN ({_SOLID}) GROUP BY owner HAVING count(*) FILTER (NOT is_static AND ret1 = owner) >= 2 AND count(*) FILTER (ret1 NOT IN ('void', owner)) >= 1""",
    ),
    "D5": ("prototype", "SELECT 'Prototype' AS pattern, class, CAST(0.95 AS DOUBLE) AS confidence, 'ICloneable' AS evidence FROM ci WHERE iface = 'ICloneable' AND class IN (SELECT name FROM cls)"),
    "D6": (
        "composite",
        """SELECT 'Composite' AS pattern, m.owner AS class, CAST(CASE WHEN bool_or(ret1 = m.owner) THEN 0.85 ELSE 0.65 END AS DOUBLE) AS confidence, 'implementations: ' || any_value(subs) AS evidence
        FROM (SELECT 'i' AS kind, owner, ret1, accessor FROM face UNION ALL SELECT 'c', owner, ret1, accessor FROM own o WHERE owner IN (SELECT name FROM cls WHERE is_abstract)
          AND NOT EXISTS (SELECT 1 FROM cls a JOIN cls b ON b.name = a.base_class AND b.is_abstract WHERE a.name = o.owner) AND owner NOT IN (SELECT base_class FROM cls WHERE is_abstract AND base_class IS NOT NULL)) m
        JOIN subs s ON s.owner = m.owner WHERE NOT accessor AND subs >= 2 GROUP BY kind, m.owner
        HAVING count(*) >= 2 AND (bool_or(ret1 = m.owner) OR (count(*) >= 3 AND bool_or(ret1 = 'void') AND bool_or(ret1 <> 'void')))""",
    ),
    "D7": (
        "wrappers",
        f"""SELECT CASE WHEN EXISTS (SELECT 1 FROM face f WHERE f.owner = l.iface AND f.ret1 IN (SELECT name FROM open_)) THEN 'Decorator' ELSE 'Adapter' END AS pattern, l.class, CAST(0.5 AS DOUBLE) AS confidence,
          (SELECT {_EV.format('list(DISTINCT method)')} FROM face f WHERE f.owner = l.iface) AS evidence
        FROM ci l WHERE l.iface IN (SELECT owner FROM face) AND l.class IN (SELECT name FROM cls)
          AND NOT EXISTS (SELECT 1 FROM face f WHERE f.owner = l.iface AND f.method NOT IN (SELECT method FROM own o WHERE o.owner = l.class))
          AND (EXISTS (SELECT 1 FROM (SELECT trim(unnest(string_split(between_, ','))) AS p, owner, method FROM own) x WHERE x.owner = l.class AND x.method = l.class AND p <> '' AND p <> l.iface AND p IN (SELECT name FROM cls))
            OR EXISTS (SELECT 1 FROM own o WHERE o.owner = l.class AND NOT o.accessor AND o.method <> l.class AND o.method NOT IN (SELECT method FROM face f WHERE f.owner = l.iface)))""",
    ),
    "D8": (
        "decorator",
        f"""SELECT 'Decorator' AS pattern, a.name AS class, CAST(0.7 AS DOUBLE) AS confidence, (SELECT {_EV.format('list(name)')} FROM cls s WHERE s.base_class = a.name AND NOT s.is_abstract) AS evidence
        FROM cls a JOIN cls b ON b.name = a.base_class AND b.is_abstract WHERE a.is_abstract AND (SELECT count(*) FROM own WHERE owner = a.name) > (SELECT count(*) FROM own WHERE owner = b.name)
          AND (SELECT count(*) FROM cls s WHERE s.base_class = a.name AND NOT s.is_abstract) >= 2""",
    ),
    "D9": (
        "bridge",
        """SELECT 'Bridge' AS pattern, c.name AS class, CAST(0.6 AS DOUBLE) AS confidence, 'subclasses: ' || subs AS evidence FROM cls c JOIN (SELECT class, arg_min(iface, (ord, iface)) AS iface FROM ci GROUP BY class) f ON f.class = c.name
        JOIN subs ON subs.owner = c.name WHERE is_abstract AND f.iface IN (SELECT name FROM ifc) AND subs >= 2""",
    ),
    "D10": (
        "flyweight",
        """SELECT 'Flyweight' AS pattern, owner AS class, CAST(CASE WHEN cached AND made > 0 THEN 0.85 WHEN cached THEN 0.6 ELSE 0.4 END AS DOUBLE) AS confidence, '' AS evidence
        FROM (SELECT c.name AS owner, c.name IN (SELECT owner FROM fld WHERE is_static AND regexp_matches(field_type, 'Dictionary|Cache|Pool')) AS cached,
          (SELECT count(*) FROM own WHERE own.owner = c.name AND is_static AND ret1 = own.owner) AS made, (SELECT count(*) FROM own WHERE own.owner = c.name AND NOT is_static AND ret1 = own.owner) AS own_kind FROM cls c)
        WHERE cached OR own_kind >= 2""",
    ),
    "D11": (
        "facade",
        f"SELECT 'Facade' AS pattern, owner AS class, CAST(0.3 AS DOUBLE) AS confidence, {_EV.format('list(method)')} AS evidence FROM own WHERE owner IN (SELECT name FROM cls WHERE NOT is_abstract AND NOT is_static) AND owner NOT IN (SELECT class FROM ci) GROUP BY owner HAVING count(*) >= 4",
    ),
    "D12": (
        "strategy_command_state",
        """SELECT v[1] AS pattern, owner AS class, CAST(v[2] AS DOUBLE) AS confidence, m AS evidence FROM (SELECT owner, m,
          CASE WHEN s THEN ['State', '0.75'] WHEN c2 THEN ['Command', '0.8'] WHEN m IN ('Execute', 'Run', 'Handle') THEN ['Command', CASE WHEN x THEN '0.75' ELSE '0.55' END] WHEN p AND x AND NOT c1 THEN ['Strategy', '0.85']
            WHEN p THEN ['Strategy', '0.7'] WHEN x AND NOT c1 THEN ['Strategy', '0.75'] WHEN c1 THEN ['Command', '0.6'] ELSE ['Strategy', '0.9'] END AS v
          FROM (SELECT f.owner, f.one AS m,
            EXISTS (SELECT 1 FROM call c JOIN sub ON sub.class = c.caller_class WHERE sub.name = f.owner AND c.callee = f.one) AS s,
            EXISTS (SELECT 1 FROM cre JOIN sub ON sub.class = cre.created_type WHERE sub.name = f.owner AND cre.class <> cre.created_type) AS c1,
            EXISTS (SELECT 1 FROM cre JOIN sub ON sub.class = cre.created_type JOIN call c ON c.caller_class = cre.class WHERE sub.name = f.owner AND cre.class <> cre.created_type AND c.callee = f.one) AS c2,
            EXISTS (SELECT 1 FROM own WHERE contains(between_, f.owner) AND own.owner NOT IN (SELECT class FROM sub WHERE sub.name = f.owner)) AS p,
            EXISTS (SELECT 1 FROM call c WHERE c.callee = f.one) AS x
          FROM faces f JOIN subs USING (owner) WHERE f.n = 1 AND subs >= 2))""",
    ),
    "D13": (
        "observer",
        f"""SELECT 'Observer' AS pattern, owner AS class, CAST(0.75 AS DOUBLE) AS confidence, 'methods: ' || count(*) AS evidence FROM face WHERE NOT accessor GROUP BY owner HAVING count(*) >= 2 AND bool_or(contains(signature, owner))
        UNION ALL SELECT 'Observer', class, 0.9, {_EV.format('list(iface)')} FROM ci WHERE iface IN ('IObservable', 'IObserver') AND class IN (SELECT name FROM cls) GROUP BY class""",
    ),
    "D14": (
        "mediator",
        f"""SELECT 'Mediator' AS pattern, f.owner AS class, CAST(0.6 AS DOUBLE) AS confidence, {_EV.format('f.methods')} AS evidence FROM faces f JOIN direct_ d USING (owner) WHERE f.n >= 2 AND n_direct = 1
          AND EXISTS (SELECT 1 FROM call c WHERE c.caller_class = d.one_class AND c.callee_class NOT IN ('', d.one_class) AND c.callee_class NOT IN (SELECT name FROM ifc)
            AND c.callee_class NOT IN (SELECT iface FROM ci WHERE class = d.one_class))""",
    ),
    "D15": (
        "dotnet_mediator",
        f"""SELECT * FROM (WITH chief AS (SELECT f.owner, d.one_class FROM faces f JOIN direct_ d USING (owner) WHERE f.n >= 2 AND n_direct = 1 ORDER BY owner LIMIT 1),
          h AS (SELECT f.owner FROM faces f JOIN direct_ d USING (owner) WHERE f.n = 1 AND n_direct >= 2 AND f.owner NOT IN (SELECT iface FROM ci WHERE class = (SELECT one_class FROM chief)))
        SELECT 'DotnetMediator' AS pattern, owner AS class, CAST(0.85 AS DOUBLE) AS confidence, (SELECT {_EV.format('list(owner)')} FROM h) AS evidence FROM chief WHERE (SELECT count(*) FROM h) >= 2)""",
    ),
    "D16": ("chain_of_responsibility", "SELECT 'ChainOfResponsibility' AS pattern, owner AS class, CAST(0.5 AS DOUBLE) AS confidence, 'implementations: ' || subs AS evidence FROM faces JOIN subs USING (owner) WHERE n >= 2 AND subs >= 2"),
    "D17": ("handler", "SELECT 'Handler' AS pattern, owner AS class, CAST(0.7 AS DOUBLE) AS confidence, '' AS evidence FROM faces JOIN subs USING (owner) WHERE n = 1 AND subs >= 2 QUALIFY count(*) OVER () >= 2"),
    "D18": (
        "template_method",
        """SELECT 'TemplateMethod' AS pattern, owner AS class, CAST(0.75 AS DOUBLE) AS confidence, 'abstract: ' || count(*) FILTER (is_abstract) || ',concrete: ' || count(*) FILTER (NOT is_abstract AND NOT is_virtual AND NOT accessor) AS evidence
        FROM own WHERE owner IN (SELECT name FROM cls WHERE is_abstract) GROUP BY owner HAVING count(*) FILTER (is_abstract) >= 1 AND count(*) FILTER (NOT is_abstract AND NOT is_virtual AND NOT accessor) >= 1""",
    ),
    "D19": (
        "visitor",
        f"""SELECT 'Visitor' AS pattern, v.owner AS class, CAST(0.7 AS DOUBLE) AS confidence, {_EV.format('v.methods')} AS evidence FROM (
          SELECT f.owner AS element, (SELECT min(o.owner) FROM faces o WHERE o.n >= 2 AND o.owner <> f.owner) AS vis FROM faces f JOIN subs USING (owner) WHERE n = 1 AND one_ret = 'void' AND subs >= 2) e JOIN faces v ON v.owner = e.vis""",
    ),
    "D20": (
        "iterator",
        f"""SELECT 'Iterator' AS pattern, class, CAST(0.95 AS DOUBLE) AS confidence, {_EV.format('list(iface)')} AS evidence FROM ci WHERE iface IN ('IEnumerable', 'IEnumerator') AND class IN (SELECT name FROM cls) GROUP BY class
        UNION ALL SELECT 'Iterator', name, 0.9, '' FROM ifc WHERE name IN ('IEnumerable', 'IEnumerator')""",
    ),
    "D21": (
        "memento",
        f"SELECT 'Memento' AS pattern, owner AS class, CAST(0.4 AS DOUBLE) AS confidence, {_EV.format('list(method)')} AS evidence FROM own WHERE owner IN (SELECT name FROM cls WHERE NOT is_abstract AND NOT is_static) GROUP BY owner HAVING count(*) <= 6 AND bool_and(accessor)",
    ),
    "D22": ("interpreter", "SELECT 'Interpreter' AS pattern, owner AS class, CAST(0.8 AS DOUBLE) AS confidence, 'implementations: ' || subs || ',method: ' || one AS evidence FROM faces JOIN subs USING (owner) WHERE n = 1 AND one_ret <> 'void' AND subs >= 2"),
    "D23": (
        "di_container",
        f"""SELECT 'DiContainer' AS pattern, owner AS class, CAST(0.9 AS DOUBLE) AS confidence, coalesce({_EV.format("list(e) FILTER (e <> '')")}, '') AS evidence FROM (
          SELECT owner, regexp_extract(substr(signature, strpos(signature, k)), '<([^>]*)>', 1) AS e FROM own, (SELECT unnest({patterns.DI_KEYWORDS}) AS k)
          WHERE contains(signature, k) AND owner IN (SELECT name FROM cls WHERE is_static OR name = 'Program' OR regexp_matches(name, '(Startup|Extension|Extensions)$'))) GROUP BY owner HAVING count(*) >= 2""",
    ),
    "D24": (
        "controller_api",
        f"""SELECT 'ControllerApi' AS pattern, owner AS class, CAST(CASE WHEN owner IN (SELECT class FROM up WHERE ancestor IN ('ControllerBase', 'Controller')) THEN 0.95 ELSE 0.7 END AS DOUBLE) AS confidence, {_EV.format('list(method)')} AS evidence
        FROM own WHERE owner IN ({_SOLID}) AND NOT accessor AND method <> owner GROUP BY owner
        HAVING count(*) >= 2 AND (owner IN (SELECT class FROM up WHERE ancestor IN ('ControllerBase', 'Controller')) OR (count(*) >= 3 AND 2 * count(*) FILTER (between_ <> '') >= count(*)))""",
    ),
    "D25": (
        "minimal_api",
        f"""SELECT 'MinimalApi' AS pattern, owner AS class, CAST(0.8 AS DOUBLE) AS confidence, {_EV.format('list(method) FILTER (method <> owner)')} AS evidence FROM own WHERE owner IN (SELECT name FROM cls WHERE is_static OR name = 'Program')
        GROUP BY owner HAVING bool_or(contains(between_, 'WebApplication')) AND count(*) FILTER (method <> owner) > 0""",
    ),
}
for _op, (_name, _sql) in _D.items():
    query(f"OP-{_op}_{_name}", _sql, idiomatic=True)(_detector(_name))


@query("OP-D0_all", f"SELECT * FROM ({' UNION ALL '.join(f'SELECT pattern, class, confidence, evidence FROM ({sql})' for _, sql in _D.values())})", idiomatic=True)
def _(spark, d):
    return patterns.detect(_more(spark, d)).select("pattern", "class", "confidence", F.array_join("evidence", ",").alias("evidence"))


@query("OP-D0_hits", f"SELECT pattern, count(*) AS hits, max(confidence) AS best FROM ({' UNION ALL '.join(f'SELECT pattern, class, confidence FROM ({sql})' for _, sql in _D.values())}) GROUP BY pattern", idiomatic=True)
def _(spark, d):
    return patterns.hits(patterns.detect(_more(spark, d)))
