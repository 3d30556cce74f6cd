"""Commands over a tree of C# files: python -m millrace.cli COMMAND PATH ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections import defaultdict

from pyspark.sql import functions as F

from .operators import callgraph, graphs, impact, navigate, patterns, render, resolve
from .operators.facts import is_accessor
from .session import local_session, ship
from .sources.csharp import frontend


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("parse", "cfg", "pdg", "hammock", "resolve", "callgraph", "detect", "route", "traverse", "impact"):
        c = sub.add_parser(name)
        c.add_argument("path")
        if name in ("cfg", "pdg"):
            c.add_argument("--format", choices=["dot", "json"], default="dot")
        if name == "resolve":
            c.add_argument("--kind", choices=["di", "factory", "reflection", "cha", "all"], default="all")
        if name == "route":
            c.add_argument("--json", action="store_true")
        if name in ("callgraph", "traverse", "impact"):
            c.add_argument("--class", dest="cls", required=name != "callgraph")
        if name == "callgraph":
            c.add_argument("--depth", type=int, default=3)
            for flag in ("--outbound", "--inbound", "--trace"):
                c.add_argument(flag, action="store_true")
        if name == "impact":
            c.add_argument("--method", required=True)
    c = sub.add_parser("diffimpact")
    c.add_argument("v1")
    c.add_argument("v2")
    c.add_argument("--class", dest="cls")
    c.add_argument("--method")
    return p


def _table(df) -> str:
    """All rows, fetched a partition at a time."""
    rows = df.toLocalIterator()
    return "\n".join("  ".join("" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v) for v in r) for r in rows)


def _class_calls(facts, args) -> str:
    """Calls of every class that contains ``--class``: what it calls (as trees with --trace) and who calls its methods' names.

    Both directions unless one is asked for; where no class matches, a notice with the names there are.
    """
    names = facts.classes.where(F.contains(F.lower("name"), F.lit(args.cls.lower()))).select("name").distinct().cache()
    found = [r[0] for r in names.orderBy("name").collect()]
    if not found:
        return f"No class found matching '{args.cls}'\n" + _table(facts.classes.select(F.concat(F.lit("  "), "name")).orderBy("name"))
    own = facts.methods.where((F.col("owner_kind") == "class") & ~is_accessor(F.col("method"))).join(names.select(F.col("name").alias("owner")), "owner", "left_semi").select("owner", "method").distinct()
    out = []
    if args.outbound or not args.inbound:
        out.append("Outbound calls:")
        if args.trace:
            starts = facts.calls.select(F.col("caller_class").alias("owner"), F.col("caller_method").alias("method")).distinct().join(own, ["owner", "method"], "left_semi")
            for node in starts.orderBy("owner", "method").collect():
                out += [".".join(node), _table(render.call_tree_lines(callgraph.call_tree(facts, *node, depth=args.depth)))]
        else:
            view = callgraph.outbound(facts).join(names.select(F.col("name").alias("caller_class")), "caller_class", "left_semi")
            out.append(_table(view.orderBy("caller_class", "caller_method", "callee")))
    if args.inbound or not args.outbound:
        view = callgraph.inbound(facts).join(own.withColumnRenamed("method", "callee"), "callee").select("owner", "callee", "caller_class", "calls", "via")
        out += ["Inbound calls:", _table(view.orderBy("owner", "callee", "caller_class"))]
    return "\n".join(x for x in out if x)


def run(spark, args) -> str:
    """The text a command prints."""
    load = lambda path: frontend.parse(frontend.read_tree(spark, path)).cache()
    if args.command == "diffimpact":
        a, b = frontend.facts_of(load(args.v1)), frontend.facts_of(load(args.v2))
        target = f"{args.cls}.{args.method}" if args.cls and args.method else None
        changes, nodes, edges = impact.diff_impact(a, b, target)
        return render.diff_dot([(r.key, r.kind) for r in changes.collect()], [r.id for r in nodes.collect()], [tuple(r) for r in edges.collect()], target)
    parsed = load(args.path)
    if args.command in ("cfg", "pdg", "hammock"):
        if args.command == "pdg":  # data edges need the graphs of single methods
            parsed = frontend.parse(frontend.read_tree(spark, args.path), compat=False).cache()
        blocks, edges = frontend.relation(parsed, "blocks"), frontend.relation(parsed, "edges")
        if args.command == "hammock":
            return _table(graphs.regions(blocks, edges).orderBy("file", "method_ord", F.size("body"), "header"))
        nodes: dict = defaultdict(list)
        arrows: dict = defaultdict(list)
        # block ids start anew in every file and, with the graphs of single methods, in every method: one drawing each
        part = ["file", "method_ord"] if args.command == "pdg" else ["file"]
        for r in blocks.orderBy("file", "method_ord", "id").toLocalIterator():
            nodes[tuple(r[c] for c in part)].append((r.id, r.kind, r.start_line, r.end_line))
        drawn = graphs.dependence_graph(blocks, edges, compat=False, names=frontend.relation(parsed, "names")) if args.command == "pdg" else edges
        for r in drawn.orderBy("file", "method_ord", *(["src", "dst", "kind"] if args.command == "pdg" else ["edge_ord"])).toLocalIterator():
            arrows[tuple(r[c] for c in part)].append((r.src, r.dst, r.kind))
        if args.format == "json":
            found = [{**dict(zip(part, k)), **json.loads(render.cfg_json(nodes[k], arrows[k]))} for k in nodes]
            return render.cfg_json(*next(((nodes[k], arrows[k]) for k in nodes), ([], []))) if len(found) < 2 else json.dumps({"graphs": found}, indent=2)
        one = render.pdg_dot if args.command == "pdg" else render.cfg_dot
        return "\n".join((f"// {' '.join(map(str, k))}\n" if len(nodes) > 1 else "") + one(nodes[k], arrows[k]) for k in nodes)
    if args.command == "route":
        rows = frontend.relation(parsed, "routes").orderBy("source", "class", "file", "ord").collect()
        if args.json:
            return render.routes_json([{k: r[k] for k in ("http_method", "path", "class", "handler", "source")} for r in rows])
        return render.routes_text([(r["class"], r.http_method, r.path, r.handler) for r in rows])
    facts = frontend.facts_of(parsed, "first" if args.command in ("resolve", "detect", "callgraph") else "append")
    if args.command == "parse":
        return _table(render.type_graph_json(facts).orderBy("kind", "name").select("json"))
    if args.command == "resolve":
        return _table(resolve.top_callees(facts))
    if args.command == "detect":
        found = patterns.detect(facts)
        return _table(patterns.hits(found)) + "\n" + _table(found.orderBy("pattern", "class").select("pattern", "class", F.format_string("c=%.2f", "confidence"), "participants"))
    if args.command == "callgraph":
        if args.cls:
            return _class_calls(facts, args)
        view = callgraph.inbound(facts) if args.inbound else callgraph.outbound(facts) if args.outbound else callgraph.summary(facts)
        return _table(view.orderBy(*view.columns[:2]))
    if args.command == "impact":
        target = f"{args.cls}.{args.method}"
        nodes, edges = impact.impact(facts, target)
        return render.impact_dot([(r.id, r.direct) for r in nodes.collect()], [tuple(r) for r in edges.orderBy("caller", "callee").collect()], target)
    session = navigate.Session.begin(facts, args.cls)
    out = []
    for line in sys.stdin:
        out.append(session.step(line))
        if out[-1] in ("quit", "done"):
            break
        out += [render.nav_down(session.below()), render.nav_up(session.above())]
    if session.judged:
        out.append(render.judgments(session.judged))
    return "\n".join(out)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = local_session()
    ship(spark)
    try:
        print(run(spark, args))
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
