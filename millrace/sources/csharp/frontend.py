"""From source texts to fact relations: one Arrow stage that parses each file once, then relations by explode and join."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ...operators.facts import Facts, merged_classes
from . import cfg
from .parser import File, Method, Type

_STRUCTS = {
    "types": "name string, kind string, base_class string, interfaces array<string>, is_abstract boolean, is_sealed boolean, is_static boolean, ord int",
    "methods": "owner string, owner_kind string, ord int, method string, signature string, ret string, params array<string>, is_static boolean, is_virtual boolean, is_abstract boolean, line_start int, line_end int",
    "fields": "owner string, ord int, name string, field_type string, is_static boolean, is_readonly boolean",
    "calls": "ord int, caller_class string, caller_method string, callee string, target_expr string, is_self_call boolean, line int, delegates array<string>",
    "creations": "class string, created_type string",
    "blocks": "method_ord int, owner string, method string, id int, kind string, start_line int, end_line int",
    "edges": "method_ord int, edge_ord int, src int, dst int, kind string",
    "names": "method_ord int, id int, defs array<string>, uses array<string>",
    "statements": "method_ord int, ord int, depth int, kind string, start_line int, end_line int",
    "arguments": "call_ord int, line int, name string",
    "routes": "ord int, http_method string, path string, class string, handler string, source string",
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_LISTS = {k: pa.list_(pa.struct([(n, _ARROW[t]) for n, t in (x.split(" ", 1) for x in v.split(", "))])) for k, v in _STRUCTS.items()}

#: The relations ``facts_of`` reads.
FACTS = ("types", "methods", "fields", "calls", "creations")

# Attributes and calls that make routes.
HTTP_VERBS = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH"}
MAP_VERBS = {"MapGet": "GET", "MapPost": "POST", "MapPut": "PUT", "MapDelete": "DELETE", "MapPatch": "PATCH"}
CONTROLLER_BASES = {"Controller", "ControllerBase"}


def combine_paths(base: str | None, sub: str | None) -> str:
    """A route path: a sub-path from '/' replaces the base, otherwise both are joined; '/' where nothing is left."""
    if sub is not None and sub.startswith("/"):
        return sub
    parts = [p.strip("/") for p in (base or "", sub or "") if p.strip("/")]
    return "/" + "/".join(parts)


def _routes(file: File) -> list[dict]:
    found: list[dict] = []

    def visit(t: Type) -> None:
        if t.kind == "class" and (t.name.endswith("Controller") or CONTROLLER_BASES & set(t.bases)):
            base = next((a.argument for a in t.attributes if a.name == "Route" and a.argument is not None), None)
            for m in t.methods:
                if m.constructor:
                    continue
                verbs = [(HTTP_VERBS[a.name], a.argument) for a in m.attributes if a.name in HTTP_VERBS] or [("GET", None)]
                found.extend({"http_method": v, "path": combine_paths(base, sub), "class": t.name, "handler": m.name, "source": "controller"} for v, sub in verbs)
            for inner in t.types:
                visit(inner)

    for t in file.types:
        if t.outer is None:
            visit(t)
    for c in file.calls:
        name = c.callee.split("<", 1)[0]
        if name in MAP_VERBS and c.target and len(c.literals) >= 2:
            path = c.literals[0] or ""
            found.append({"http_method": MAP_VERBS[name], "path": path if path.startswith("/") else "/" + path, "class": c.caller_class, "handler": c.literals[1], "source": "minimal"})
    return [r | {"ord": k} for k, r in enumerate(found)]


def _owners(file: File, t: Type, compat: bool) -> list[Method]:
    """The methods credited to a type, as they appear; in compatible mode those of nested types too."""
    own = list(t.methods)
    if compat:
        for inner in t.types:
            own += _owners(file, inner, compat)
    return sorted(own, key=lambda m: m.rest[0])


def _callable(file: File, m: Method, types: dict[str, list[Type]]) -> bool:
    """Whether calls of a method are attributed to its class in compatible mode: only in classes, and not after a nested class."""
    owner = next((t for t in types.get(m.owner, []) if m in t.methods), None)
    return owner is not None and owner.kind == "class" and not any(i.kind == "class" and i.tokens[1] <= m.rest[0] for i in owner.types)


def _flat(statements: list, depth: int = 0) -> Iterator[tuple]:
    """(depth, statement) of statements and those inside them, in the order of the text."""
    for s in statements:
        yield depth, s
        for part in s.parts.values():
            inner = [x for p in part for x in (p if isinstance(p, list) else [p])] if isinstance(part, list) else [part]
            yield from _flat([x for x in inner if x is not None], depth + 1)


def _names(tokens: list, first: int, last: int, loop: bool = False) -> tuple[list[str], list[str]]:
    """(defined, used) names of tokens first..last; ``loop`` for the head of a foreach, which defines what stands before 'in'.

    Members behind a dot are no names, except after ``this``. Compound assignments, ++, -- and ref define and use.
    """
    text = lambda k: tokens[k].text if first <= k <= last else ""
    defs, uses = {}, {}
    listed: set[int] = set()
    stop = next((k for k in range(first, last + 1) if text(k) == "in"), first) if loop else first
    for k in range(first, last + 1):  # (a, b) = ... and var (a, b) in ...
        if text(k) == ")" and (text(k + 1) == "=" or (loop and k + 1 == stop)):
            depth, j = 1, k - 1
            while j >= first and depth:
                depth += (text(j) == ")") - (text(j) == "(")
                if tokens[j].kind == "id" and text(j + 1) in (",", ")"):
                    listed.add(j)
                j -= 1
    for k in range(first, last + 1):
        t = tokens[k]
        if t.kind == "str" and "$" in t.text[:2]:
            for hole in re.findall(r"\{([^{}]+)\}", t.text):
                uses |= dict.fromkeys(re.findall(r"(?<![\w.])[^\W\d]\w*", hole))
        if t.kind != "id" or (text(k - 1) in (".", "?.", "::", "->") and text(k - 2) != "this"):
            continue
        after, then = text(k + 1), text(k + 2)
        both = after in ("+=", "-=", "*=", "/=", "??=", "++", "--") or (after in "%|&^" and after and then == "=") or (after, then) in (("<", "<="), (">", ">="))
        both = both or text(k - 1) in ("++", "--", "ref")
        typed = k - 2 >= first and tokens[k - 1].kind == "id" and text(k - 2) in ("out", "is")
        plain = after == "=" or k in listed or (typed and text(k - 1) != "not") or (text(k - 1) == "out" and after in (",", ")")) or (loop and k + 1 == stop)
        if both or plain:
            defs[t.text] = None
        if not plain:
            uses[t.text] = None
    return list(defs), list(uses)


def parse_text(text: str, compat: bool = True, relations: frozenset[str] = frozenset(_LISTS)) -> dict:
    """The facts of one text; ``relations`` are those wanted, the rest may be left empty."""
    file = File(text)
    faces = {t.name for t in file.types if t.kind == "interface"}
    classes = {t.name for t in file.types if t.kind != "interface" and t.kind != "enum"}
    by_name: dict[str, list[Type]] = {}
    for t in file.types:
        by_name.setdefault(t.name, []).append(t)
    types, methods, fields = [], [], []
    for k, t in enumerate(x for x in file.types if x.kind != "enum"):
        base, listed = None, []
        if t.kind != "interface":
            for b in t.bases:
                if b == t.name:
                    continue
                if b in faces or b not in classes:
                    listed.append(b)
                else:
                    base = b
        types.append({"name": t.name, "kind": "interface" if t.kind == "interface" else "class", "base_class": base, "interfaces": listed, "is_abstract": "abstract" in t.flags, "is_sealed": "sealed" in t.flags, "is_static": "static" in t.flags, "ord": k})
        kind = "interface" if t.kind == "interface" else "class"
        for n, m in enumerate(_owners(file, t, compat)):
            methods.append({
                "owner": t.name, "owner_kind": kind, "ord": n, "method": m.name, "signature": m.signature, "ret": m.ret, "params": m.params, "is_static": "static" in m.flags,
                "is_virtual": bool({"virtual", "override"} & m.flags), "is_abstract": "abstract" in m.flags, "line_start": m.start, "line_end": m.end,
            })
        fields += [{"owner": t.name, "ord": n, "name": f.name, "field_type": f.type, "is_static": "static" in f.flags, "is_readonly": "readonly" in f.flags} for n, f in enumerate(t.fields)]
    allowed = {(m.owner, m.name, m.start) for m in file.methods if not compat or _callable(file, m, by_name)}
    ok = {(o, n) for o, n, _ in allowed}
    calls = [
        {"ord": k, "caller_class": c.caller_class, "caller_method": c.caller_method, "callee": c.callee, "target_expr": c.target, "is_self_call": c.target == "this", "line": c.line, "delegates": c.arguments}
        for k, c in enumerate(c for c in file.calls if (c.caller_class, c.caller_method) in ok)
    ]
    blocks, edges, names = [], [], []
    for k, (m, g) in enumerate(cfg.graphs(file, strict=not compat) if relations & {"blocks", "edges", "names"} else ()):
        blocks += [{"method_ord": k, "owner": m.owner, "method": m.name, "id": i, "kind": kind, "start_line": a, "end_line": b} for i, kind, a, b in g.blocks]
        edges += [{"method_ord": k, "edge_ord": n, "src": a, "dst": b, "kind": kind} for n, (a, b, kind) in enumerate(g.edges)]
        if not compat:
            for i, (first, last, loop) in g.spans.items():
                defs, uses = _names(file.tokens, first, last, loop)
                names.append({"method_ord": k, "id": i, "defs": defs, "uses": uses})
    statements = [
        {"method_ord": k, "ord": n, "depth": depth, "kind": x.kind, "start_line": x.start, "end_line": x.end}
        for k, m in enumerate(m for m in file.methods if m.body and "statements" in relations)
        for n, (depth, x) in enumerate(_flat(file.statements(m)))
    ]
    arguments = [{"call_ord": c["ord"], "line": c["line"], "name": a} for c in calls for a in c["delegates"]]
    creations = [{"class": c, "created_type": t} for c, t in dict.fromkeys(file.creations)]
    return {"types": types, "methods": methods, "fields": fields, "calls": calls, "creations": creations, "blocks": blocks, "edges": edges, "names": names, "statements": statements, "arguments": arguments, "routes": _routes(file) if "routes" in relations else []}


def parse(sources: DataFrame, compat: bool = True, file: str = "file", text: str = "text", relations: Iterable[str] | None = None) -> DataFrame:
    """One row per file with its facts as arrays; ``error`` tells why a file could not be read, its arrays are empty then.

    ``relations``: the arrays wanted, all by default; others are left out. Null texts are skipped. Texts in other languages give what happens to look like C#.
    """

    wanted = frozenset(_LISTS if relations is None else relations)
    lists = {k: v for k, v in _LISTS.items() if k in wanted}
    schema = "file string, error string" + "".join(f", {k} array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _STRUCTS[k].split(', '))}>>" for k in lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                rows, errors = [], []
                for t in part.column(1).to_pylist():
                    try:
                        rows.append(parse_text(t, compat, wanted))
                        errors.append(None)
                    except (RecursionError, IndexError, ValueError, TypeError) as e:
                        rows.append({k: [] for k in lists})
                        errors.append(f"{type(e).__name__}: {e}"[:200])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(errors, pa.string()), *(pa.array([r[k] for r in rows], kind) for k, kind in lists.items())], ["file", "error", *lists])

    return sources.select(F.col(file).alias("file"), F.col(text).alias("text")).where(F.col("text").isNotNull()).mapInArrow(run, schema)


def relation(parsed: DataFrame, name: str) -> DataFrame:
    """One of the arrays of ``parse`` as rows, with the file."""
    return parsed.select("file", F.inline(name))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of all ``*.cs`` below a folder, or of a single file whatever its extension."""
    reader = spark.read
    if not (path.endswith(".cs") or os.path.isfile(path)):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.cs")
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def facts_of(parsed: DataFrame, merge: str = "append") -> Facts:
    """The facts of a parsed project; see ``operators.facts`` for the merge policies.

    Sites are numbered by the order of file and call. Classes declared several times in one file are one there: flags
    add up and the last list of bases counts.
    """
    types = relation(parsed, "types")
    order = Window.partitionBy("file", "name").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    once = types.where("kind = 'class'").select(
        "file", "name", F.last("base_class").over(order).alias("base_class"), F.last("interfaces").over(order).alias("interfaces"),
        *(F.max(c).over(order).alias(c) for c in ("is_abstract", "is_sealed", "is_static")), F.max("ord").over(order).alias("at"),
    ).distinct()
    classes = merged_classes(once.drop("interfaces"), merge)
    kept = once if merge == "append" else once.join(classes.select("name", "file"), ["name", "file"], "left_semi")
    links = kept.select("name", "file", F.posexplode("interfaces").alias("pos", "iface")).groupBy(F.col("name").alias("class"), "iface").agg(F.min(F.struct("file", "pos")).alias("m")).select("class", "iface", F.col("m.pos").alias("ord"))
    faces = types.where("kind = 'interface'").groupBy("name").agg(F.min("file").alias("file"))
    methods = relation(parsed, "methods")
    if merge == "first":
        first = methods.groupBy("owner", "owner_kind").agg(F.min("file").alias("file"))
        methods = methods.join(first, ["owner", "owner_kind", "file"], "left_semi")
    known = methods.where("owner_kind = 'class'").select("owner", "method").distinct()
    raw = relation(parsed, "calls").withColumn("site_id", F.xxhash64("file", "ord"))
    mine = known.select(F.col("owner").alias("caller_class"), F.col("method").alias("delegate"))
    given = raw.select("site_id", "caller_class", F.explode("delegates").alias("delegate")).join(mine, ["caller_class", "delegate"], "left_semi").groupBy("site_id").agg(F.collect_list("delegate").alias("found"))
    calls = raw.drop("delegates").join(given, "site_id", "left").select(
        "site_id", "file", "caller_class", "caller_method", "callee", F.lit("").alias("callee_class"), "target_expr", "is_self_call", F.lit(False).alias("is_creation"), F.lit(None).cast("string").alias("created_type"), "line",
        F.coalesce("found", F.array().cast("array<string>")).alias("delegates"),
    )
    facts = Facts(
        classes=classes, interfaces=faces, class_iface=links,
        methods=methods.select("owner", "owner_kind", "ord", "method", "signature", "ret", "params", "is_static", "is_virtual", "is_abstract", "file", "line_start", "line_end"),
        calls=calls, creations=relation(parsed, "creations").select("class", "created_type").distinct(), fields=relation(parsed, "fields").drop("file"),
    )
    from ...operators.callgraph import bind_callees

    bound = bind_callees(facts)
    facts.calls = bound.withColumn("callee_class", F.col("bound")).drop("bound")
    return facts


def route_path(base: Column, sub: Column) -> Column:
    """``combine_paths`` as a column."""
    trimmed = [F.btrim(F.coalesce(c, F.lit("")), F.lit("/")) for c in (base, sub)]
    joined = F.concat_ws("/", *(F.nullif(t, F.lit("")) for t in trimmed))
    return F.when(F.startswith(F.coalesce(sub, F.lit("")), F.lit("/")), sub).otherwise(F.concat(F.lit("/"), joined))
