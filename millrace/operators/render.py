"""Results as text: DOT, JSON and tables. Each takes a small result that was collected, one method, one target or one report."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facts import Facts

# Colours of the drawings.
FILL = {"Entry": "green", "Exit": "red"}
EDGE_STYLE = {"control": "style=dashed color=red", "data": "style=dotted color=blue"}
CHANGE_FILL = {"added": "lightgreen", "removed": "lightcoral", "callers_changed": "lightyellow"}


def block_label(block_id: int, kind: str, start: int, end: int) -> str:
    return f"[{block_id}] {kind} (L{start}-L{end})"


def cfg_dot(blocks: Iterable[tuple], edges: Iterable[tuple]) -> str:
    """Blocks (id, kind, start, end) by id and edges (src, dst, kind) in the order they were made."""
    nodes = "".join(f'    {b[0]} [ label = "{block_label(*b)}" ]\n' for b in sorted(blocks))
    lines = "".join(f'    {a} -> {b} [ label = "{k}" ]\n' for a, b, k in edges)
    return f"digraph {{\n{nodes}{lines}}}\n"


def cfg_json(blocks: Iterable[tuple], edges: Iterable[tuple]) -> str:
    nodes = [{"id": i, "kind": k, "start_line": a, "end_line": b} for i, k, a, b in sorted(blocks)]
    return json.dumps({"nodes": nodes, "edges": [{"from": a, "to": b, "kind": k} for a, b, k in edges]}, indent=2)


def nav_down(rows: Iterable) -> str:
    """The edges down of ``Session.below`` with their numbers, and the options of an interface by letters."""
    out = []
    for n, r in enumerate(rows, 1):
        external = r.kind == "External"
        out.append(f"    [-] {r.callee} via {r.via}  (external)" if external else f"    [{n}] {r.callee} via {r.via} {r.target_class}".rstrip())
        if r.kind == "Interface":
            out.append(f"       INTERFACE: {r.iface}")
            out += [f"       [{n}{chr(ord('a') + k)}] {x}.{r.callee}  (c=0.70)" for k, x in enumerate(r.options)]
        elif r.kind == "Delegate":
            out.append("       DELEGATE HANDLER")
    return "\n".join(["  Down", *out]) if out else "  Down (none)"


def nav_up(rows: Iterable) -> str:
    """The edges up of ``Session.above`` with their numbers."""
    out = [f"    [u{n}] {r.caller_class}.{r.caller_method}{' (delegate)' if r.delegate else ''}" for n, r in enumerate(rows, 1)]
    return "\n".join(["  Up", *out]) if out else "  Up (none)"


def judgments(judged: dict[str, str]) -> str:
    return "\n".join(["  JUDGMENTS:", *(f"    {c} -> {j}" for c, j in sorted(judged.items()))])


def pdg_lines(blocks: Iterable[tuple], edges: Iterable[tuple], indent: str = "") -> str:
    """The statements of a dependence graph, to be put into a drawing: control dashed red, data dotted blue, flow solid black."""
    out = [f'{indent}n{i} [label="L{a}-{b}:{k}" style=filled fillcolor={FILL.get(k, "lightblue")}];' for i, k, a, b in sorted(blocks)]
    out += ["", *(f'{indent}n{a} -> n{b} [{EDGE_STYLE.get(k, "style=solid color=black")}];' for a, b, k in edges)]
    return "\n".join(out) + "\n"


def pdg_drawing(blocks: Iterable[tuple], edges: Iterable[tuple], title: str = "") -> str:
    """A dependence graph in colours, with a title."""
    head = f'  label="{title}";\n  labelloc=t;\n\n' if title else ""
    return f"digraph PDG {{\n  rankdir=TB;\n  node [shape=box style=rounded];\n\n{head}{pdg_lines(blocks, edges)}}}\n"


def pdg_dot(blocks: Iterable[tuple], edges: Iterable[tuple]) -> str:
    """A dependence graph with the kinds of its edges as labels."""
    out = ["digraph PDG {", *(f'  n{b[0]} [label="{block_label(*b)}"];' for b in sorted(blocks)), *(f'  n{a} -> n{b} [label="{k}"];' for a, b, k in edges)]
    return "\n".join([*out, "}"]) + "\n"


def impact_dot(nodes: Iterable[tuple[str, int]], edges: Iterable[tuple[str, str]], target: str) -> str:
    """Nodes (id, call sites it affects) with the target marked."""
    out = ["digraph impact {"]
    for name, n in sorted(nodes):
        style = "fillcolor=lightcoral, penwidth=2" if name == target else "fillcolor=lightblue"
        out.append(f'    "{name}" [label="{name} (affects {n} sites)", style=filled, {style}];')
    out += [f'    "{a}" -> "{b}";' for a, b in edges]
    return "\n".join([*out, "}"]) + "\n"


def diff_dot(changes: Iterable[tuple[str, str]], nodes: Iterable[str] = (), edges: Iterable[tuple[str, str]] = (), target: str | None = None) -> str:
    """Changes (key, kind), over the impact of a target if there is one."""
    kinds = dict(changes)
    out = ["digraph diff {"]
    for name in sorted({*kinds, *nodes}):
        if target is not None:
            fill = "lightcoral" if name == target else "lightyellow" if name in kinds else "lightblue"
        else:
            fill = CHANGE_FILL.get(kinds.get(name, ""), "lightblue")
        label = f"{name} {kinds[name].upper().replace('_', ' ')}" if name in kinds else name
        out.append(f'    "{name}" [label="{label}", style=filled, fillcolor={fill}];')
    out += [f'    "{a}" -> "{b}";' for a, b in edges]
    return "\n".join([*out, "}"]) + "\n"


def routes_text(rows: Iterable[tuple[str, str, str, str]]) -> str:
    """Routes (class, verb, path, handler), grouped by class; '' is '(top-level)'."""
    out, at = [], None
    for cls, verb, path, handler in rows:
        if cls != at:
            out.append(cls or "(top-level)")
            at = cls
        out.append(f"{verb:>6}  {path:<30}  {handler}")
    return "\n".join(out)


def routes_json(rows: Iterable[dict]) -> str:
    return json.dumps({"routes": list(rows)}, indent=2)


def snippet(text: str, first: int, last: int) -> str:
    """Lines first..last (from 1) with their numbers."""
    lines = text.split("\n")
    return "\n".join(f"│ {k:>4} {lines[k - 1]}" for k in range(max(1, first), min(last, len(lines)) + 1))


def code_lines(sources: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, line, code): the numbered lines of the spans (file, line_start, line_end), distributed."""
    lines = sources.join(spans, "file").select("file", "line_start", "line_end", F.posexplode(F.split("text", "\r?\n")).alias("pos", "code"))
    return lines.where((F.col("pos") + 1 >= F.col("line_start")) & (F.col("pos") + 1 <= F.col("line_end"))).select("file", (F.col("pos") + 1).alias("line"), "code").distinct()


def type_graph_json(facts: Facts) -> DataFrame:
    """(kind, name, json): classes with their interfaces, methods and fields, and interfaces with their methods, one row each."""
    of = lambda kind: facts.methods.where(F.col("owner_kind") == kind).groupBy(F.col("owner").alias("name")).agg(F.array_sort(F.collect_set(F.struct("ord", "method", "signature"))).alias("methods"))
    faces = facts.class_iface.groupBy(F.col("class").alias("name")).agg(F.transform(F.array_sort(F.collect_set(F.struct("ord", "iface"))), lambda x: x["iface"]).alias("interfaces"))
    fields = facts.fields.groupBy(F.col("owner").alias("name")).agg(F.array_sort(F.collect_set(F.struct("ord", F.col("name").alias("field"), "field_type", "is_static", "is_readonly"))).alias("fields"))
    classes = facts.classes.join(of("class"), "name", "left").join(faces, "name", "left").join(fields, "name", "left")
    one = F.to_json(F.struct("name", "base_class", "interfaces", "is_abstract", "is_sealed", "is_static", "file", "methods", "fields"))
    rows = classes.select(F.lit("class").alias("kind"), "name", one.alias("json"))
    return rows.unionByName(facts.interfaces.join(of("interface"), "name", "left").select(F.lit("interface").alias("kind"), "name", F.to_json(F.struct("name", "file", "methods")).alias("json")))


def label_column(block_id: Column, kind: Column, start: Column, end: Column) -> Column:
    return F.format_string("[%d] %s (L%d-L%d)", block_id, kind, start, end)


def cfg_dots(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, dot): the drawing of every file's graph, distributed; blocks by id, edges in the order they were made."""
    node = F.format_string('    %d [ label = "%s" ]', "id", label_column(F.col("id"), F.col("kind"), F.col("start_line"), F.col("end_line")))
    arrow = F.format_string('    %d -> %d [ label = "%s" ]', "src", "dst", "kind")
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), "\n")
    nodes = blocks.groupBy(F.col("file").alias("file")).agg(text(F.struct("id", node.alias("t"))).alias("nodes"))
    arrows = edges.groupBy(F.col("file").alias("file")).agg(text(F.struct("method_ord", "edge_ord", arrow.alias("t"))).alias("arrows"))
    return nodes.join(arrows, "file", "left").select("file", F.concat_ws("\n", F.lit("digraph {"), "nodes", "arrows", F.lit("}")).alias("dot"))


def call_tree_lines(tree: DataFrame) -> DataFrame:
    """(line): the rows of ``callgraph.call_tree`` in the order of a walk: callee, target, number of calls and where it leads."""
    via = F.when(F.col("via") != "", F.concat(F.lit(" via "), "via")).otherwise("")
    to = F.when(F.col("iface").isNotNull(), F.concat(F.lit(" == "), "iface", F.lit(" -> "), "class", F.lit("."), "callee")).when(F.col("class").isNotNull(), F.concat(F.lit(" -> "), "class", F.lit("."), "callee")).otherwise("")
    text = F.concat(F.repeat(F.lit("   "), F.col("level") - 1), F.lit("- "), "callee", via, F.format_string(" (%dx)", "calls"), to, F.when(F.col("cycle"), "  (cycle)").otherwise(""))
    step = F.array(F.concat_ws(".", "class", "callee"))
    return tree.orderBy(F.concat("path", step), "iface").select(text.alias("line"))


def route_report(routes: DataFrame) -> DataFrame:
    """(source, class, routes, listing): routes per class, each as 'VERB path handler' in the order of the file."""
    line = F.format_string("%6s  %-30s  %s", "http_method", "path", "handler")
    rows = routes.groupBy("source", "class").agg(F.count("*").alias("routes"), F.array_sort(F.collect_list(F.struct("file", "ord", line.alias("t")))).alias("rows"))
    return rows.select("source", "class", "routes", F.array_join(F.transform("rows", lambda x: x["t"]), "\n").alias("listing"))
