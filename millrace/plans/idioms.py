"""The code tables with small programs added to them in which every idiom occurs, as one SQL text for Spark and for the checks.

Sixteen consecutive class ids make a group g; the class with the k-th id of it adds the class ``Qk_g`` with what the lists
below say for k. ``$g`` stands for the group in all names. So the rules find their cases among all rows of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.facts import Facts, from_frames
from ..sources.tables import table

_CLASSES = [
    # k, base class, abstract, static
    (0, None, 0, 0), (1, None, 0, 0), (2, None, 0, 0), (3, None, 0, 0), (4, None, 0, 0), (5, None, 0, 0), (6, None, 0, 0), (7, None, 0, 0), (8, None, 1, 0), (9, "Q8_$g", 1, 0),
    (10, "Q9_$g", 0, 0), (11, "Q9_$g", 0, 0), (12, None, 0, 1), (13, None, 0, 1), (14, "ControllerBase", 0, 0), (15, None, 0, 0),
]
_INTERFACES = [(0, "IA_$g"), (1, "IF_$g"), (2, "IB_$g"), (3, "IC_$g")]
_LINKS = [(3, "ICloneable"), (4, "IA_$g"), (6, "IObservable"), (7, "IEnumerable"), (10, "IB_$g"), (11, "IB_$g"), (5, "IC_$g")]
_METHODS = [
    # k, owner, kind, ord, method, signature, return type, parameter types, static, virtual, abstract
    (0, "Q0_$g", "class", 0, "Instance", "Q0_$g Instance()", "Q0_$g", "", 1, 0, 0), (0, "Q0_$g", "class", 1, "Use", "void Use(IA_$g a)", "void", "IA_$g", 0, 0, 0),
    (1, "Q1_$g", "class", 0, "CreateThing", "IA_$g CreateThing()", "IA_$g", "", 0, 0, 0), (1, "Q1_$g", "class", 1, "Open", "void Open(Q2_$g q)", "void", "Q2_$g", 0, 0, 0),
    (2, "Q2_$g", "class", 0, "WithA", "Q2_$g WithA(int a)", "Q2_$g", "int", 0, 0, 0), (2, "Q2_$g", "class", 1, "WithB", "Q2_$g WithB(int b)", "Q2_$g", "int", 0, 0, 0), (2, "Q2_$g", "class", 2, "Build", "string Build()", "string", "", 0, 0, 0),
    (3, "Q3_$g", "class", 0, "Clone", "object Clone()", "object", "", 0, 0, 0),
    (4, "Q4_$g", "class", 0, "Q4_$g", "Q4_$g Q4_$g(Q5_$g)", "Q4_$g", "Q5_$g", 0, 0, 0), (4, "Q4_$g", "class", 3, "Extra", "void Extra()", "void", "", 0, 0, 0), (4, "Q4_$g", "class", 1, "First", "void First(IA_$g x)", "void", "IA_$g", 0, 0, 0), (4, "Q4_$g", "class", 2, "Second", "int Second()", "int", "", 0, 0, 0),
    (5, "Q5_$g", "class", 0, "get_State", "string get_State()", "string", "", 0, 0, 0), (5, "Q5_$g", "class", 1, "set_State", "void set_State(string v)", "void", "string", 0, 0, 0),
    (8, "Q8_$g", "class", 0, "Op", "void Op()", "void", "", 0, 0, 1), (9, "Q9_$g", "class", 0, "Op", "void Op()", "void", "", 0, 1, 0), (9, "Q9_$g", "class", 1, "More", "void More()", "void", "", 0, 0, 0),
    (10, "Q10_$g", "class", 0, "Handle", "void Handle(Q0_$g q)", "void", "Q0_$g", 0, 0, 0), (11, "Q11_$g", "class", 0, "Handle", "void Handle(Q0_$g q)", "void", "Q0_$g", 0, 0, 0),
    (12, "Q12_$g", "class", 0, "Register", "void Register(IServiceCollection s, AddScoped<IA_$g> a)", "void", "IServiceCollection", 1, 0, 0), (12, "Q12_$g", "class", 1, "More", "void More(IServiceCollection s, AddSingleton<IB_$g> b)", "void", "IServiceCollection", 1, 0, 0),
    (13, "Q13_$g", "class", 0, "Map", "void Map(WebApplication app)", "void", "WebApplication", 1, 0, 0),
    (14, "Q14_$g", "class", 0, "Get", "string Get(int id)", "string", "int", 0, 0, 0), (14, "Q14_$g", "class", 1, "List", "string List(string q)", "string", "string", 0, 0, 0), (14, "Q14_$g", "class", 2, "Put", "void Put(Q5_$g q)", "void", "Q5_$g", 0, 0, 0),
    (15, "Q15_$g", "class", 0, "Shared", "Q15_$g Shared(string key)", "Q15_$g", "string", 1, 0, 0),
    (0, "IA_$g", "interface", 0, "First", "void First(IA_$g x)", "void", "IA_$g", 0, 0, 0), (0, "IA_$g", "interface", 1, "Second", "int Second()", "int", "", 0, 0, 0),
    (1, "IF_$g", "interface", 0, "MakeA", "IA_$g MakeA()", "IA_$g", "", 0, 0, 0), (1, "IF_$g", "interface", 1, "MakeB", "IA_$g MakeB()", "IA_$g", "", 0, 0, 0),
    (2, "IB_$g", "interface", 0, "Handle", "void Handle(Q0_$g q)", "void", "Q0_$g", 0, 0, 0), (3, "IC_$g", "interface", 0, "Undo", "void Undo()", "void", "", 0, 0, 0),
]
_CALLS = [
    # k, number, caller's method, callee, callee's class, target, class created
    (0, 0, "Use", "First", "IA_$g", "a", None), (1, 0, "Open", "Create", "", "Maker", None), (1, 1, "Open", "Build", "Q2_$g", "b", None), (1, 2, "Open", ".ctor", "", "", "Q4_$g"), (1, 3, "Open", "Handle", "IB_$g", "h", None),
    (10, 0, "Handle", "OutsideCall", "", "lib", None), (11, 0, "Handle", "OutsideCall", "", "lib", None), (11, 1, "Handle", "Op", "Q8_$g", "o", None),
    (12, 0, "Register", "AddScoped<IA_$g, Q4_$g>", "", "s", None), (12, 1, "Register", "AddSingleton<Q0_$g>", "", "s", None), (12, 2, "More", "GetService<IA_$g>", "", "sp", None), (12, 3, "More", "AddTransient<IB_$g, Q10_$g>", "", "s", None),
    (13, 0, "Map", "GetMethod", "", "typeof(Q0_$g)", None), (13, 1, "Map", "GetProperty", "", "Q0_$g", None), (13, 2, "Map", "CreateInstance", "", "Activator", None),
]
_FIELDS = [(15, "Q15_$g", 0, "pool", "Dictionary<string, Q15_$g>", 1), (14, "Q14_$g", 0, "cache", "MemoryCache", 1), (14, "Q14_$g", 1, "name", "string", 0)]


def _values(rows: list[tuple], columns: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS i({columns})"


_AT = "(SELECT class_id, CAST(class_id % 16 AS INT) AS k, CAST(class_id - class_id % 16 AS STRING) AS g FROM {classes} WHERE class_id IS NOT NULL) c"
_N = lambda c: f"replace({c}, '$g', c.g)"

#: The tables as SQL over the tables, in ``str.format`` fields.
TABLES = {
    "classes": f"""SELECT class_id, name, base_class, is_abstract, is_sealed, is_static, file FROM {{classes}}
        UNION ALL SELECT 1000000000 + c.class_id, 'Q' || CAST(c.k AS STRING) || '_' || c.g, {_N('i.base')}, i.a = 1, false, i.s = 1, 'idioms.cs' FROM {_AT} JOIN {_values(_CLASSES, 'k, base, a, s')} ON i.k = c.k""",
    "interfaces": f"SELECT name, file FROM {{interfaces}} UNION ALL SELECT {_N('i.name')}, 'idioms.cs' FROM {_AT} JOIN {_values(_INTERFACES, 'k, name')} ON i.k = c.k",
    "class_iface": f"SELECT class, iface, ord FROM {{class_iface}} UNION ALL SELECT 'Q' || CAST(c.k AS STRING) || '_' || c.g, {_N('i.name')}, 0 FROM {_AT} JOIN {_values(_LINKS, 'k, name')} ON i.k = c.k",
    "methods": f"""SELECT owner, owner_kind, ord, method, signature, ret, params, is_static, is_virtual, is_abstract, file, line_start, line_end FROM {{methods}}
        UNION ALL SELECT {_N('i.owner')}, i.kind, i.ord, {_N('i.method')}, {_N('i.signature')}, {_N('i.ret')}, CASE WHEN i.params = '' THEN NULL ELSE split({_N('i.params')}, ',') END, i.s = 1, i.v = 1, i.a = 1, 'idioms.cs', 1, 2
        FROM {_AT} JOIN {_values(_METHODS, 'k, owner, kind, ord, method, signature, ret, params, s, v, a')} ON i.k = c.k""",
    "calls": f"""SELECT site_id, file, caller_class, caller_method, callee, callee_class, target_expr, is_self_call, is_creation, created_type, line, delegates FROM {{calls}}
        UNION ALL SELECT -10 * c.class_id - i.j - 1, 'idioms.cs', 'Q' || CAST(c.k AS STRING) || '_' || c.g, i.method, {_N('i.callee')}, {_N('i.class')}, {_N('i.target')}, false, i.made IS NOT NULL, {_N('i.made')}, i.j + 1, NULL
        FROM {_AT} JOIN {_values(_CALLS, 'k, j, method, callee, class, target, made')} ON i.k = c.k""",
    "fields": f"SELECT DISTINCT {_N('i.owner')} AS owner, i.ord, i.name, {_N('i.type')} AS field_type, i.s = 1 AS is_static, false AS is_readonly FROM {_AT} JOIN {_values(_FIELDS, 'k, owner, ord, name, type, s')} ON i.k = c.k",
}


def facts(spark: SparkSession, folder: str, merge: str = "first") -> Facts:
    """The facts of the tables with the small programs."""

    def get(name: str) -> DataFrame:
        text = TABLES[name]
        names = [t for t in TABLES if "{" + t + "}" in text]
        return spark.sql(text, **{t: table(spark, folder, t) for t in names})

    return from_frames(get, merge)


def as_sql(facts_sql: str) -> str:
    """``facts_sql`` over the tables with the small programs, which go before it; ``fld`` are the fields."""
    names = {t: t for t in TABLES}
    added = ", ".join(f"{t}_more AS ({sql.format(**names)})" for t, sql in TABLES.items())
    for t in TABLES:
        facts_sql = facts_sql.replace(f"FROM {t} ", f"FROM {t}_more ").replace(f"FROM {t})", f"FROM {t}_more)")
    return f"{added}, fld AS (SELECT * FROM fields_more), {facts_sql}"
