"""Graphs of single methods: dominators, control and data dependence, regions. Each method is one row of a batch, no exchange between methods."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Paths per node that the compatible post-dominator looks at.
PATHS = 100


def dominators(nodes: list[int], edges: list[tuple[int, int]], root: int) -> dict[int, set[int]]:
    """For each node reachable from ``root`` the nodes on all paths to it, itself included."""
    succ, pred = defaultdict(set), defaultdict(set)
    for a, b in edges:
        succ[a].add(b)
        pred[b].add(a)
    order, seen, stack = [], {root}, [(root, iter(sorted(succ[root])))]
    while stack:
        node, it = stack[-1]
        nxt = next((x for x in it if x not in seen), None)
        if nxt is None:
            order.append(node)
            stack.pop()
        else:
            seen.add(nxt)
            stack.append((nxt, iter(sorted(succ[nxt]))))
    order.reverse()
    dom: dict[int, set[int]] = {root: {root}}
    changed = True
    while changed:
        changed = False
        for n in order:
            if n == root:
                continue
            known = [dom[p] for p in pred[n] if p in dom]
            now = set.intersection(*known) | {n} if known else {n}
            if dom.get(n) != now:
                dom[n] = now
                changed = True
    return dom


def immediate(dom: dict[int, set[int]]) -> dict[int, int]:
    """The closest strict dominator of each node that has one: the one with the most dominators itself."""
    return {n: max(d - {n}, key=lambda x: (len(dom[x]), x)) for n, d in dom.items() if len(d) > 1}


def path_post_dominators(nodes: list[int], edges: list[tuple[int, int]], exit_: int) -> dict[int, int]:
    """Compatible rule: of the nodes common to up to ``PATHS`` simple paths to the exit, the one with fewest direct edges, the least id on ties."""
    succ = defaultdict(list)
    for a, b in edges:
        succ[a].append(b)
    found = {}
    for v in nodes:
        if v == exit_:
            continue
        paths: list[set[int]] = []
        stack = [(v, [v])]
        while stack and len(paths) < PATHS:
            at, trail = stack.pop()
            if at == exit_:
                paths.append(set(trail))
                continue
            stack += [(b, [*trail, b]) for b in reversed(succ[at]) if b not in trail]
        if paths:
            common = set.intersection(*paths) - {v}
            if common:
                found[v] = min(common, key=lambda c: (succ[v].count(c), c))
    return found


def control_dependence(nodes: list[int], edges: list[tuple[int, int]], entry: int, exit_: int, compat: bool = False) -> set[tuple[int, int]]:
    """(u, w): whether w runs is decided at u. Standard: w post-dominates a successor of u but not u itself."""
    found: set[tuple[int, int]] = set()
    succ = defaultdict(list)
    for a, b in edges:
        succ[a].append(b)
    up = path_post_dominators(nodes, edges, exit_) if compat else None
    pdom = dominators(nodes, [(b, a) for a, b in edges], exit_)
    ipdom = up if up is not None else immediate(pdom)
    for u in nodes:
        if len(succ[u]) < 2:
            continue
        for v in succ[u]:
            if v in (u, exit_) and compat:
                continue
            w, seen = v, set()
            while w is not None and w not in (entry, exit_) and w not in seen:
                above = w in _chain(ipdom, u) if compat else (w in pdom.get(u, set()) and w != u)
                if above:
                    break
                found.add((u, w))
                seen.add(w)
                w = ipdom.get(w)
    return found


def _chain(up: dict[int, int], v: int) -> set[int]:
    out: set[int] = set()
    while v in up and up[v] not in out:
        v = up[v]
        out.add(v)
    return out


def hammocks(nodes: list[int], edges: list[tuple[int, int]], entry: int, exit_: int) -> list[tuple[int, int, list[int]]]:
    """(header, footer, body): regions of several blocks entered only at the header and left only to the footer, smallest first."""
    dom, pdom = dominators(nodes, edges, entry), dominators(nodes, [(b, a) for a, b in edges], exit_)
    succ, pred = defaultdict(set), defaultdict(set)
    for a, b in edges:
        succ[a].add(b)
        pred[b].add(a)
    found = []
    inner = [n for n in nodes if n not in (entry, exit_)]
    for h in inner:
        for t in inner:
            if t == h or h not in dom.get(t, ()) or t not in pdom.get(h, ()):
                continue
            body, stack = {h}, [h]
            while stack:
                for b in succ[stack.pop()]:
                    if b != t and b not in body:
                        body.add(b)
                        stack.append(b)
            if len(body) <= 1 or any(pred[n] - body for n in body if n != h) or any(succ[n] - body - {t} for n in body):
                continue
            found.append((h, t, sorted(body)))
    return sorted(found, key=lambda x: len(x[2]))


def reaching_definitions(nodes: list[int], edges: list[tuple[int, int]], defs: dict[int, set[str]], uses: dict[int, set[str]]) -> set[tuple[int, int, str]]:
    """(d, u, name): the definition of name at d may be the one used at u."""
    pred = defaultdict(set)
    for a, b in edges:
        pred[b].add(a)
    out: dict[int, set[tuple[int, str]]] = {n: {(n, x) for x in defs.get(n, ())} for n in nodes}
    came: dict[int, set[tuple[int, str]]] = {n: set() for n in nodes}
    changed = True
    while changed:
        changed = False
        for n in nodes:
            now = set().union(*(out[p] for p in pred[n])) if pred[n] else set()
            if now != came[n]:
                came[n], changed = now, True
            after = {(d, x) for d, x in now if x not in defs.get(n, ())} | {(n, x) for x in defs.get(n, ())}
            if after != out[n]:
                out[n], changed = after, True
    return {(d, n, x) for n in nodes for d, x in came[n] if x in uses.get(n, ())}


def _grouped(blocks: DataFrame, edges: DataFrame, extra: list[str], kernel: Callable, schema: str) -> DataFrame:
    """Rows (file, method_ord, ...) of ``kernel(rows, edges)`` for each method.

    ``rows`` are tuples (id, kind, *extra) of the method's blocks, ``edges`` its pairs, both in order. Blocks and edges of
    a method meet in one row, by one shuffle, and a task goes through its rows in batches: what it holds at a time is some
    methods, however many files there are.
    """
    key = lambda: [F.col("file").alias("file"), F.col("method_ord").alias("method_ord")]
    row, pair = F.struct("id", "kind", *extra), F.struct("src", "dst")
    kinds = {c: blocks.select(row.alias("r")).schema["r"].dataType.simpleString() if c == "r" else edges.select(pair.alias("p")).schema["p"].dataType.simpleString() for c in "rp"}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    both = blocks.select(*key(), row.alias("r"), none("p")).unionByName(edges.select(*key(), none("r"), pair.alias("p")))
    methods = both.groupBy("file", "method_ord").agg(F.collect_list("r").alias("r"), F.collect_list("p").alias("p"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for f, o, rows, pairs in zip(*(b.column(k).to_pylist() for k in range(4))):
                found = kernel(sorted((tuple(r.values()) for r in rows), key=lambda r: (r[0], str(r[1:]))), sorted((p["src"], p["dst"]) for p in pairs))
                out += [(f, o, *r) for r in found]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return methods.select("file", "method_ord", "r", "p").mapInArrow(run, schema)


def _per_method(blocks: DataFrame, edges: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(nodes, edges, entry, exit)`` for each method; methods without an entry or exit give nothing."""

    def whole(rows: list, pairs: list) -> list:
        starts, ends = [r[0] for r in rows if r[1] == "Entry"], [r[0] for r in rows if r[1] == "Exit"]
        return kernel(sorted(r[0] for r in rows), pairs, min(starts), min(ends)) if starts and ends else []

    return _grouped(blocks, edges, [], whole, schema)


_KEY = "file string, method_ord int"


def dominator_pairs(blocks: DataFrame, edges: DataFrame, post: bool = False) -> DataFrame:
    """(file, method_ord, node, dominator, immediate): all dominators of each block, on reversed edges with ``post``."""

    def kernel(nodes, pairs, entry, exit_):
        dom = dominators(nodes, [(b, a) for a, b in pairs] if post else pairs, exit_ if post else entry)
        near = immediate(dom)
        return [(n, d, near.get(n) == d) for n, ds in dom.items() for d in sorted(ds)]

    return _per_method(blocks, edges, kernel, f"{_KEY}, node int, dominator int, immediate boolean")


def control_dependences(blocks: DataFrame, edges: DataFrame, compat: bool = False) -> DataFrame:
    """(file, method_ord, src, dst)."""
    return _per_method(blocks, edges, lambda n, e, a, z: sorted(control_dependence(n, e, a, z, compat)), f"{_KEY}, src int, dst int")


def regions(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, method_ord, header, footer, body)."""
    return _per_method(blocks, edges, hammocks, f"{_KEY}, header int, footer int, body array<int>")


def dependence_graph(blocks: DataFrame, edges: DataFrame, compat: bool = True, names: DataFrame | None = None) -> DataFrame:
    """(file, method_ord, src, dst, kind): the flow edges as 'cfg(Kind)', the control edges and, with ``names``, the data edges.

    ``names``: the relation of ``frontend.parse(compat=False)``, see ``data_dependences``; a pair with several names is one edge.
    """
    flow = edges.select("file", "method_ord", "src", "dst", F.concat(F.lit("cfg("), F.col("kind"), F.lit(")")).alias("kind"))
    out = flow.unionByName(control_dependences(blocks, edges, compat).withColumn("kind", F.lit("control")))
    if names is None:
        return out
    return out.unionByName(data_dependences(blocks, edges, names).select("file", "method_ord", "src", "dst").distinct().withColumn("kind", F.lit("data")))


def data_dependences(blocks: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, method_ord, src, dst, name): reaching definitions of local names.

    ``sources``: the relation names of ``frontend.parse(compat=False)``, the names that each block defines and uses in the
    whole of a simple statement, or in the whole head of a condition or loop. Where there are only texts (file, text), each
    block is read by its first line alone: a name is defined by ``name =`` or ``++``/``--``, and used wherever it stands.
    """
    named = sources.select("file", "method_ord", "id", "defs", "uses") if "defs" in sources.columns else _first_lines(blocks, sources)
    all_ = blocks.select("file", "method_ord", "id", "kind").join(named, ["file", "method_ord", "id"], "left")

    def kernel(rows: list, pairs: list) -> list:
        get = lambda k: {r[0]: set(r[k]) - {""} if r[k] is not None else set() for r in rows}
        return sorted(reaching_definitions(sorted(r[0] for r in rows), pairs, get(2), get(3)))

    return _grouped(all_, edges, ["defs", "uses"], kernel, f"{_KEY}, src int, dst int, name string")


def _first_lines(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, method_ord, id, defs, uses) by the first line of each block."""
    define = r"([A-Za-z_]\w*)\s*(?:[-+*/%&|^]|<<|>>|\?\?)?=(?![=>])|([A-Za-z_]\w*)\s*(?:\+\+|--)"
    lines = F.get(F.split("text", "\r?\n"), F.col("start_line") - 1)
    texts = blocks.where(~F.col("kind").isin("Entry", "Exit", "LoopExit")).join(sources.select("file", "text"), "file").select("file", "method_ord", "id", lines.alias("line"))
    return texts.select(
        "file", "method_ord", "id",
        F.array_union(F.regexp_extract_all("line", F.lit(define), F.lit(1)), F.regexp_extract_all("line", F.lit(define), F.lit(2))).alias("defs"), F.regexp_extract_all("line", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)).alias("uses"),
    )


def control_context(blocks: DataFrame, edges: DataFrame, lines: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(file, line, method_ord, id, conditions): the conditions and loop heads that lead to the block of a line, nearest last.

    ``lines``: (file, line). The block is the first of the file that holds the line; predecessors are followed until a
    condition, loop head or handler. With ``sources`` (file, text) they read 'when: if (TEXT) [Ln]' for a condition and
    'when: TEXT [Ln]' for the others, TEXT being the lines of the block; without, 'Kind [Ln]'.
    """
    stop = ("Condition", "LoopHeader", "Handler")
    at = F.concat(F.lit(" [L"), "start_line", F.lit("]"))
    if sources is None:
        blocks = blocks.withColumn("label", F.concat("kind", at))
    else:
        code = sources.select("file", F.split("text", "\r?\n").alias("code")).dropDuplicates(["file"])
        text = F.trim(F.array_join(F.slice("code", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), " "))
        label = F.concat(F.when(F.col("kind") == "Condition", F.concat(F.lit("when: if ("), text, F.lit(")"))).otherwise(F.concat(F.lit("when: "), text)), at)
        heads = blocks.where(F.col("kind").isin(*stop)).join(code, "file").select("file", "method_ord", "id", label.alias("label"))
        blocks = blocks.join(heads, ["file", "method_ord", "id"], "left")
    held = blocks.join(lines, "file").where((F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line")) & ~F.col("kind").isin("Entry", "Exit"))
    spot = held.groupBy("file", "line").agg(F.min_by(F.struct("method_ord", "id"), "id").alias("b")).select("file", "line", "b.method_ord", "b.id")
    keys = ["file", "method_ord"]
    rows = blocks.select(*keys, "id", "kind", "label", F.lit(None).cast("int").alias("line")).unionByName(spot.select(*keys, "id", F.lit("?").alias("kind"), F.lit("").alias("label"), "line"))

    def kernel(all_rows: list, pairs: list) -> list:
        kind = {r[0]: (r[1], r[2]) for r in all_rows if r[1] != "?"}
        pred = defaultdict(list)
        for a, z in pairs:
            pred[z].append(a)
        out = []
        for start, mark, _, line in all_rows:
            if mark != "?":
                continue
            seen, stack, found = {start}, list(pred[start]), []
            while stack:
                x = stack.pop()
                if x in seen:
                    continue
                seen.add(x)
                if kind[x][0] in stop:
                    found.append(kind[x][1])
                else:
                    stack += pred[x]
            out.append((int(line), start, found[::-1]))
        return out

    return _grouped(rows, edges, ["label", "line"], kernel, f"{_KEY}, line int, id int, conditions array<string>")


def data_context(arguments: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, call_ord, name, defined): for each identifier handed to a call the earliest line before it that assigns the name.

    ``arguments``: (file, call_ord, line, name) from the frontend; names that no line before assigns have no row.
    """
    lines = sources.select("file", F.posexplode(F.split("text", "\r?\n")).alias("pos", "code"))
    assigned = lines.select("file", (F.col("pos") + 1).alias("at"), F.explode(F.regexp_extract_all("code", F.lit(r"([A-Za-z_]\w*)\s*=(?![=>])"), F.lit(1))).alias("name"))
    earliest = assigned.groupBy("file", "name").agg(F.min("at").alias("defined"))
    return arguments.join(earliest, ["file", "name"]).where(F.col("defined") < F.col("line")).select("file", "call_ord", "name", "defined").distinct()
