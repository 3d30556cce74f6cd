"""Steps through a program: the edges down and up from a method, and a session that walks them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, stored
from .facts import Facts
from .types import compatible_methods, concrete_subtypes, direct_implementors, unique_methods

# Names of members that a walk does not start from.
SKIPPED = r"^(get_|set_|add_|remove_|\.ctor$)"


def start(facts: Facts, cls: str) -> list[tuple[str, str]]:
    """(class, method) nodes to begin with: the class of that name in any case, or the only one that contains it.

    Accessors and constructors are left out. Raises ValueError with up to 30 names where no or several classes fit.
    """
    low = F.lower(F.col("name"))
    rows = [r[0] for r in facts.classes.where(low == cls.lower()).select("name").orderBy("name").limit(1).collect()]
    if not rows:
        rows = [r[0] for r in facts.classes.where(F.contains(low, F.lit(cls.lower()))).select("name").orderBy("name").limit(30).collect()]
    if len(rows) != 1:
        known = rows or [r[0] for r in facts.classes.select("name").orderBy("name").limit(30).collect()]
        raise ValueError(f"{'several classes are' if rows else 'no class is'} like {cls}: {', '.join(known)}")
    name = rows[0]
    own = facts.methods.where((F.col("owner") == name) & (F.col("owner_kind") == "class") & ~F.rlike("method", F.lit(SKIPPED)) & (F.col("method") != name))
    return [(name, r[0]) for r in own.groupBy("method").agg(F.min(F.struct("file", "ord")).alias("at")).orderBy("at", "method").select("method").collect()]


def edge_kinds(facts: Facts) -> DataFrame:
    """(callee, iface, options): callees that an interface with concrete subtypes declares, the first by name, with those subtypes at 0.7."""
    subs = concrete_subtypes(facts).groupBy(F.col("name").alias("iface")).agg(F.array_sort(F.collect_list("class")).alias("options"))
    declared = facts.methods.where("owner_kind = 'interface'").select(F.col("owner").alias("iface"), F.col("method").alias("callee")).distinct()
    return declared.join(subs, "iface").groupBy("callee").agg(F.min_by(F.struct("iface", "options"), "iface").alias("x")).select("callee", "x.iface", "x.options")


def down(facts: Facts) -> DataFrame:
    """(class, method, idx, callee, target_class, kind, iface, options, via, line, sites): the edges down from every method.

    Sites are grouped by callee and its class. kind is Interface where an interface with implementors declares the
    callee, Direct where its class is known, External otherwise; an edge per delegate handed over follows as Delegate.
    """
    c = facts.calls.where("caller_class <> '' and caller_method <> ''")
    grouped = c.groupBy(F.col("caller_class").alias("class"), F.col("caller_method").alias("method"), "callee", "callee_class").agg(
        F.count("*").alias("sites"), F.min_by("target_expr", "site_id").alias("via"), F.min("line").alias("line")
    )
    known = facts.classes.select(F.col("name").alias("callee_class"), F.lit(True).alias("known")).distinct()
    rows = grouped.join(edge_kinds(facts), "callee", "left").join(known, "callee_class", "left")
    kind = F.when(F.col("iface").isNotNull(), "Interface").when(F.col("known"), "Direct").otherwise("External")
    calls = rows.select("class", "method", "callee", F.col("callee_class").alias("target_class"), kind.alias("kind"), "iface", "options", "via", "line", "sites")
    given = c.select(F.col("caller_class").alias("class"), F.col("caller_method").alias("method"), F.explode("delegates").alias("callee"), "line").groupBy("class", "method", "callee").agg(F.count("*").alias("sites"), F.min("line").alias("line"))
    own = facts.methods.where("owner_kind = 'class'").select(F.col("owner").alias("class"), F.col("method").alias("callee")).distinct()
    handed = given.join(own, ["class", "callee"], "left_semi").select(
        "class", "method", "callee", F.col("class").alias("target_class"), F.lit("Delegate").alias("kind"), F.lit(None).cast("string").alias("iface"), F.lit(None).cast("array<string>").alias("options"), F.lit("").alias("via"), "line", "sites"
    )
    return calls.unionByName(handed)


def down_interface(facts: Facts) -> DataFrame:
    """(iface, method, class): from an interface's method to the direct, concrete implementors that define it."""
    solid = facts.classes.where("not is_abstract and not is_static").select(F.col("name").alias("class"))
    defined = facts.methods.where("owner_kind = 'class'").select(F.col("owner").alias("class"), "method").distinct()
    declared = facts.methods.where("owner_kind = 'interface'").select(F.col("owner").alias("iface"), "method").distinct()
    return direct_implementors(facts).join(solid, "class", "left_semi").join(declared, "iface").join(defined, ["class", "method"], "left_semi").select("iface", "method", "class")


def matching_interfaces(facts: Facts) -> DataFrame:
    """(class, method, iface): the interfaces a class's method may be called through.

    All interfaces of the class where it defines the method itself; for a method it only inherits, those that declare it.
    """
    own = facts.methods.where("owner_kind = 'class'").select(F.col("owner").alias("class"), "method").distinct()
    links = facts.class_iface.select("class", "iface").distinct().join(facts.classes.select(F.col("name").alias("class")).distinct(), "class", "left_semi")
    known = facts.interfaces.select(F.col("name").alias("iface"))
    declared = facts.methods.where("owner_kind = 'interface'").select(F.col("owner").alias("iface"), "method").distinct().join(known, "iface", "left_semi")
    inherited = links.join(declared, "iface").join(own, ["class", "method"], "left_anti")
    return own.join(links, "class").select("class", "method", "iface").unionByName(inherited.select("class", "method", "iface"))


def up(facts: Facts) -> DataFrame:
    """(class, method, tier, delegate, caller_class, caller_method, sites): who calls each method, by the first tier that has anyone.

    Tiers: 0, for methods of interfaces, calls bound to the interface and, where just one class has the name, unresolved
    calls of it from elsewhere; 1 calls bound to the class, together with unresolved calls of the name where no other
    class has it; 2 for classes without interfaces, who hands the method over as a delegate; 3 calls through one of the
    class's interfaces, together with unresolved calls of the name from other classes, which leaves none for a tier 4;
    5 the class's first interface itself, without a site. Who hands the method over follows tiers 3 and 5 too, marked ``delegate``.
    A name that an interface has, or that a class lists among its interfaces, is an interface's.
    """
    node = ["class", "method"]
    listed = facts.class_iface.select(F.col("iface").alias("class"))
    faces = facts.interfaces.select(F.col("name").alias("class")).unionByName(listed).unionByName(facts.methods.where("owner_kind = 'interface'").select(F.col("owner").alias("class"))).distinct()
    nodes = facts.methods.where("owner_kind in ('class', 'interface')").select(F.col("owner").alias("class"), "method").distinct()
    declared, own = nodes.join(faces, "class", "left_semi"), nodes.join(faces, "class", "left_anti")
    c = facts.calls.select("caller_class", "caller_method", F.col("callee").alias("method"), "callee_class", "target_expr", F.coalesce("is_self_call", F.lit(False)).alias("self"), "delegates")
    calls = stored(c, "calls")
    c = calls.groupBy("caller_class", "caller_method", "method", "callee_class", "target_expr", "self").agg(F.count("*").alias("sites"))
    bound = c.where("callee_class <> ''").withColumnRenamed("callee_class", "class")
    free = c.where("callee_class = ''")
    loose = free.where("not self").join(facts.classes.select(F.col("name").alias("target_expr")), "target_expr", "left_anti")
    alone = unique_methods(facts)
    tier = lambda df, k: df.select(*node, F.lit(k).alias("tier"), F.lit(False).alias("delegate"), "caller_class", "caller_method", "sites")
    whole = lambda df: df.groupBy(*node, "tier", "delegate", "caller_class", "caller_method").agg(F.sum("sites").alias("sites"))

    guessed = declared.join(alone.select("method"), "method", "left_semi").join(free.where("not self"), "method").where("caller_class <> class")
    zero = whole(tier(declared.join(bound, node), 0).unionByName(tier(guessed, 0)))
    unique = own.join(alone.withColumnRenamed("owner", "class"), node, "left_semi").join(loose, "method")
    first = stored(whole(tier(own.join(bound, node), 1).unionByName(tier(unique, 1))), "first")
    rest = cut(own.join(first.select(*node).distinct(), node, "left_anti"))

    first_face = facts.class_iface.groupBy("class").agg(F.min_by("iface", F.struct(F.col("ord").isNull(), "ord", "iface")).alias("iface"))
    linked = rest.join(first_face, "class")
    through = rest.join(facts.class_iface.select("class", "iface").distinct(), "class").join(bound.withColumnRenamed("class", "iface"), ["iface", "method"])
    third = stored(whole(tier(through, 3).unionByName(tier(linked.join(free, "method").where("caller_class <> class"), 3))), "third")
    lonely = linked.join(third.select(*node).distinct(), node, "left_anti")
    fifth = tier(lonely.select(*node, F.col("iface").alias("caller_class"), F.col("method").alias("caller_method"), F.lit(0).cast("long").alias("sites")), 5)

    handed = calls.select("caller_class", "caller_method", F.explode(F.array_distinct("delegates")).alias("method")).where("caller_method <> method")
    handed = handed.groupBy("caller_class", "caller_method", "method").agg(F.count("*").alias("sites"))
    at = rest.join(linked.select(*node, F.lit(True).alias("linked")), node, "left").join(lonely.select(*node, F.lit(True).alias("lonely")), node, "left")
    at = at.select(*node, F.when(F.col("linked").isNull(), 2).when(F.col("lonely"), 5).otherwise(3).alias("tier"))
    given = at.join(handed, "method").select(*node, "tier", F.lit(True).alias("delegate"), "caller_class", "caller_method", "sites")

    return zero.unionByName(first).unionByName(third).unionByName(fifth).unionByName(given)


def up_by_class(edges: DataFrame) -> DataFrame:
    """(class, method, caller_class, first_method, methods): the edges up, one per calling class."""
    return edges.groupBy("class", "method", "caller_class").agg(F.min("caller_method").alias("first_method"), F.count_distinct("caller_method").alias("methods"))


def dispatch_sources(facts: Facts) -> DataFrame:
    """(class, method, source_class, source_method): methods of other classes that share a parameter type and call something no class has."""
    defined = facts.methods.where("owner_kind = 'class'").select(F.col("method").alias("callee")).distinct()
    outside = facts.calls.where("callee_class = ''").join(defined, "callee", "left_anti").select(F.col("caller_class").alias("b_owner"), F.col("caller_method").alias("b_method")).distinct()
    met = compatible_methods(facts).join(outside, ["b_owner", "b_method"], "left_semi")
    return met.select(F.col("a_owner").alias("class"), F.col("a_method").alias("method"), F.col("b_owner").alias("source_class"), F.col("b_method").alias("source_method"))


@dataclass
class Session:
    """A walk over the program: the current node, the queue, what was judged and where it came from."""

    facts: Facts
    current: tuple[str, str] | None = None
    queue: list[tuple[str, str]] = field(default_factory=list)
    judged: dict[str, str] = field(default_factory=dict)
    history: list[tuple[str, tuple[str, str] | None]] = field(default_factory=list)

    @classmethod
    def begin(cls, facts: Facts, name: str) -> Session:
        nodes = start(facts, name)
        return cls(facts, nodes[0] if nodes else None, nodes[1:])

    def below(self) -> list:
        return [] if self.current is None else down(self.facts).where((F.col("class") == self.current[0]) & (F.col("method") == self.current[1])).orderBy("callee", "target_class").collect()

    def above(self) -> list:
        return [] if self.current is None else up(self.facts).where((F.col("class") == self.current[0]) & (F.col("method") == self.current[1])).orderBy("delegate", "caller_class", "caller_method").collect()

    def _go(self, how: str, node: tuple[str, str]) -> None:
        self.history.append((how, self.current))
        self.current = node

    def _next(self) -> None:
        self.current = self.queue.pop(0) if self.queue else None

    def step(self, action: str) -> str:
        """Apply an action: 'q' quit, 'h' history, 'd' discard, 'c p|s|u' judge, '<n>[a]' down (option a), 'u<n>[a]' up."""
        kind, value = parse_action(action)
        if kind == "history":
            return "\n".join(f"{how} from {node[0]}.{node[1]}" for how, node in self.history if node)
        if kind == "discard":
            self.history.append(("discard", self.current))
            self._next()
        elif kind == "judge" and self.current:
            self.judged[self.current[0]] = value[0]
            self.history.append((f"judge {value[0]}", self.current))
            self._next()
        elif kind == "down":
            rows = self.below()
            if not 1 <= value[0] <= len(rows):
                return "no such edge"
            r = rows[value[0] - 1]
            target = r.target_class or r.iface or ""
            if r.kind == "Interface" and r.options:
                k = ord(value[1]) - ord("a") if value[1] else 0
                if k >= len(r.options):
                    return "no such option"
                target = r.options[k]
            self._go("down", (target, r.callee))
        elif kind == "up":
            rows = self.above()
            if not 1 <= value[0] <= len(rows):
                return "no such edge"
            self._go("up", (rows[value[0] - 1].caller_class, rows[value[0] - 1].caller_method))
        elif kind == "quit":
            return "quit"
        else:
            return "unknown action"
        return f"{self.current[0]}.{self.current[1]}" if self.current else "done"


def parse_action(text: str) -> tuple[str, tuple]:
    """The grammar of actions; ('unknown', ()) for anything else."""
    text = text.strip()
    simple = {"q": "quit", "h": "history", "d": "discard"}
    if text in simple:
        return simple[text], ()
    if m := re.fullmatch(r"c\s+([psu])", text):
        return "judge", ({"p": "pattern", "s": "suspicious", "u": "unclear"}[m[1]],)
    if m := re.fullmatch(r"(u?)(\d+)([a-z]?)", text):
        return ("up" if m[1] else "down"), (int(m[2]), m[3])
    return "unknown", ()


def bare_targets(facts: Facts) -> DataFrame:
    """(caller_class, callee, target_class): where a call that names no class leads: the first class by name with the method.

    The caller's own class counts for calls without a target only.
    """
    defined = facts.methods.where("owner_kind = 'class'").select("owner", F.col("method").alias("callee")).distinct()
    loose = facts.calls.where("callee_class = ''").select("caller_class", "callee", (F.col("target_expr") != "").alias("targeted")).distinct()
    met = loose.join(defined, "callee").where(~F.col("targeted") | (F.col("owner") != F.col("caller_class")))
    return met.groupBy("caller_class", "callee", "targeted").agg(F.min("owner").alias("target_class"))


def method_files(facts: Facts) -> DataFrame:
    """(owner, method, file): the file of a method, the first by name if it has several."""
    return facts.methods.where("file <> ''").groupBy("owner", "method").agg(F.min("file").alias("file"))


def contexts(facts: Facts, conditions: DataFrame, data: DataFrame | None = None) -> DataFrame:
    """(site_id, context): 'ctrl: [...]; data: [...]' of each call, halves without anything left out; '' where there is none.

    ``conditions`` from ``graphs.control_context`` by file and line, ``data`` from ``graphs.data_context`` by file and call,
    as 'name from Ln' in the order of the lines.
    """
    known = conditions.groupBy("file", "line").agg(F.first("conditions").alias("conditions"))
    text = F.when(F.size("conditions") > 0, F.concat(F.lit("ctrl: ["), F.array_join("conditions", ", "), F.lit("]")))
    rows = facts.calls.select("site_id", "file", "line").join(known, ["file", "line"], "left").select("site_id", text.alias("ctrl"))
    if data is None:
        return rows.select("site_id", F.coalesce("ctrl", F.lit("")).alias("context"))
    names = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("defined", "name"))), lambda x: F.concat(x["name"], F.lit(" from L"), x["defined"])), ", ")
    half = data.groupBy(F.xxhash64("file", "call_ord").alias("site_id")).agg(F.concat(F.lit("data: ["), names, F.lit("]")).alias("data"))
    return rows.join(half, "site_id", "left").select("site_id", F.concat_ws("; ", "ctrl", "data").alias("context"))
