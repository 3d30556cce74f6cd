"""Design patterns as rules over the facts: every detector gives (pattern, class, confidence, participants, evidence)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .facts import Facts, first_word, is_accessor, parameter_text
from .types import ancestors, concrete_subtypes

# Names the rules know.
COMMAND_NAMES = ["Execute", "Run", "Handle"]
ITERATORS = ["IEnumerable", "IEnumerator"]
OBSERVERS = ["IObservable", "IObserver"]
DI_KEYWORDS = [
    "AddScoped", "AddSingleton", "AddTransient", "AddDbContext", "AddDbContextPool", "AddAuthentication", "AddAuthorization", "AddControllers", "AddEndpointsApiExplorer", "AddSwaggerGen", "AddCors", "AddMvc", "AddSignalR", "AddGrpc",
]
HTTP_ATTRIBUTES = ["HttpGet", "HttpPost", "HttpPut", "HttpDelete", "HttpPatch", "HttpHead", "HttpOptions"]
MAP_CALLS = ["MapGet", "MapPost", "MapPut", "MapDelete", "MapPatch"]

_COLUMNS = ["pattern", "class", "confidence", "participants", "evidence"]


@dataclass
class Context:
    """What the rules read: methods with their return type, subtype counts, calls and creations per class.

    ``calls`` is None where no call graph is used. ``http`` and ``maps``: whether the source text has attributes of
    controllers and mapping calls. The type hierarchy is worked out when a rule first asks for it.
    """

    facts: Facts
    own: DataFrame
    face: DataFrame
    calls: DataFrame | None
    creations: DataFrame | None
    http: bool
    maps: bool

    def __post_init__(self) -> None:
        self.classes, self.interfaces, self.links, self.fields = self.facts.classes, self.facts.interfaces, self.facts.class_iface, self.facts.fields

    @cached_property
    def above(self) -> DataFrame:
        return stored(ancestors(self.facts), "above")

    @cached_property
    def subtypes(self) -> DataFrame:
        return stored(concrete_subtypes(self.facts, self.above), "subtypes")

    @cached_property
    def counts(self) -> DataFrame:
        """(owner, subs): how many concrete subtypes each type has."""
        return stored(self.subtypes.groupBy(F.col("name").alias("owner")).agg(F.count("*").alias("subs")), "counts")

    @cached_property
    def faces(self) -> DataFrame:
        """(owner, n, methods, one, one_ret): the methods of each interface that are no accessors."""
        real = self.face.where(~F.col("accessor"))
        return stored(real.groupBy("owner").agg(F.count("*").alias("n"), F.collect_list("method").alias("methods"), F.min("method").alias("one"), F.min("ret1").alias("one_ret")), "faces")

    @cached_property
    def direct(self) -> DataFrame:
        """(owner, n_direct, one_class): non-abstract classes that list the interface themselves."""
        solid = self.classes.where("not is_abstract").select(F.col("name").alias("class"))
        per = self.links.join(solid, "class", "left_semi").groupBy(F.col("iface").alias("owner"))
        return stored(per.agg(F.countDistinct("class").alias("n_direct"), F.min("class").alias("one_class")), "direct")


def context(facts: Facts, use_callgraph: bool = True, source_text: str = "") -> Context:
    methods = facts.methods.withColumn("ret1", first_word(F.col("signature"))).withColumn("accessor", is_accessor(F.col("method"))).withColumn("between", parameter_text(F.col("signature")))
    names = facts.interfaces.select(F.col("name").alias("owner"))
    return Context(
        facts=facts,
        own=methods.where("owner_kind = 'class'").join(facts.classes.select(F.col("name").alias("owner")), "owner", "left_semi"),
        face=methods.where("owner_kind = 'interface'").join(names, "owner", "left_semi"),
        calls=facts.calls if use_callgraph else None,
        creations=facts.creations if use_callgraph else None,
        http=any(f"[{a}]" in source_text or f"[{a}(" in source_text for a in HTTP_ATTRIBUTES),
        maps=any(f"{m}(" in source_text for m in MAP_CALLS),
    )


def _found(df: DataFrame, pattern: str | Column, confidence: float | Column, participants: Column | None = None, evidence: Column | None = None, cls: str = "owner") -> DataFrame:
    """Rows in the common form, participants and evidence in alphabetical order."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    empty = F.array().cast("array<string>")
    return df.select(
        lit(pattern).alias("pattern"), F.col(cls).alias("class"), lit(confidence).cast("double").alias("confidence"),
        F.array(F.col(cls)).alias("participants") if participants is None else participants.alias("participants"), (empty if evidence is None else F.array_sort(evidence)).alias("evidence"),
    )


def _open_types(c: Context) -> DataFrame:
    """Interfaces and abstract classes."""
    return c.interfaces.select("name").unionByName(c.classes.where("is_abstract").select("name")).distinct()


def singleton(c: Context) -> DataFrame:
    rows = c.own.where("is_static and ret1 = owner").groupBy("owner").agg(F.collect_list("method").alias("m"))
    return _found(rows, "Singleton", 0.9, evidence=F.col("m"))


def factory_method(c: Context) -> DataFrame:
    rows = c.own.where("ret1 <> 'void' and ret1 <> owner").join(_open_types(c).withColumnRenamed("name", "ret1"), "ret1", "left_semi")
    return _found(rows, "FactoryMethod", 0.85, F.array("owner", "ret1"), F.array(F.col("method")))


def abstract_factory(c: Context) -> DataFrame:
    rows = c.face.where("ret1 <> 'void'").join(c.interfaces.select(F.col("name").alias("ret1")).distinct(), "ret1", "left_semi").groupBy("owner").agg(F.collect_list("method").alias("m"))
    return _found(rows.where(F.size("m") >= 2), "AbstractFactory", 0.9, evidence=F.col("m"))


def builder(c: Context) -> DataFrame:
    solid = c.classes.where("not is_abstract").select(F.col("name").alias("owner"))
    fluent, other = "not is_static and ret1 = owner", "ret1 <> 'void' and ret1 <> owner"
    rows = c.own.join(solid, "owner", "left_semi").groupBy("owner").agg(
        F.count_if(F.expr(fluent)).alias("a"), F.count_if(F.expr(other)).alias("b"), F.collect_list(F.when(F.expr(f"({fluent}) or ({other})"), F.col("method"))).alias("m")
    )
    return _found(rows.where("a >= 2 and b >= 1"), "Builder", 0.85, evidence=F.col("m"))


def prototype(c: Context) -> DataFrame:
    rows = c.links.where("iface = 'ICloneable'").join(c.classes.select(F.col("name").alias("class")), "class", "left_semi").select(F.col("class").alias("owner")).distinct()
    return _found(rows, "Prototype", 0.95, evidence=F.array(F.lit("ICloneable")))


def composite(c: Context) -> DataFrame:
    abstract = c.classes.where("is_abstract")
    nested = abstract.select("name", "base_class").join(abstract.select(F.col("name").alias("base_class")), "base_class", "left_semi")
    barred = nested.select(F.col("name").alias("owner")).unionByName(abstract.where("base_class is not null").select(F.col("base_class").alias("owner"))).distinct()
    roots = c.own.join(abstract.select(F.col("name").alias("owner")), "owner", "left_semi").join(barred, "owner", "left_anti")
    methods = c.face.withColumn("kind", F.lit("interface")).unionByName(roots.withColumn("kind", F.lit("class")))
    rows = methods.where(~F.col("accessor")).groupBy("kind", "owner").agg(
        F.count("*").alias("n"), F.bool_or(F.expr("ret1 = owner")).alias("own"), F.bool_or(F.expr("ret1 = 'void'")).alias("void"), F.bool_or(F.expr("ret1 <> 'void'")).alias("other")
    )
    rows = rows.where("n >= 2 and (own or (n >= 3 and void and other))").join(c.counts, "owner").where("subs >= 2")
    return _found(rows, "Composite", F.when(F.col("own"), 0.85).otherwise(0.65), evidence=F.array(F.concat(F.lit("implementations: "), F.col("subs").cast("string"))))


def wrappers(c: Context) -> DataFrame:
    """Adapter, or Decorator where the interface leads to further interfaces or abstract classes."""
    wanted = c.face.select(F.col("owner").alias("iface"), "method", "ret1").distinct()
    links = c.links.join(c.interfaces.select(F.col("name").alias("iface")), "iface", "left_semi").join(c.classes.select(F.col("name").alias("class")), "class", "left_semi").select("class", "iface")
    has = c.own.select(F.col("owner").alias("class"), "method").distinct()
    pairs = links.join(wanted.select("iface", "method").distinct(), "iface")
    lacking = pairs.join(has, ["class", "method"], "left_anti").select("class", "iface").distinct()
    full = links.join(wanted.select("iface").distinct(), "iface", "left_semi").join(lacking, ["class", "iface"], "left_anti")
    built = c.own.where("method = owner").select(F.col("owner").alias("class"), F.explode(F.split("between", ",")).alias("p")).select("class", F.trim("p").alias("p")).distinct()
    takes = full.join(built, "class").where("p <> '' and p <> iface").join(c.classes.select(F.col("name").alias("p")), "p", "left_semi").select("class", "iface").distinct().withColumn("wraps", F.lit(True))
    more = full.join(has.where(~is_accessor(F.col("method")) & (F.col("method") != F.col("class"))), "class").join(wanted.select("iface", "method").distinct(), ["iface", "method"], "left_anti").select("class", "iface").distinct().withColumn("extra", F.lit(True))
    leads = wanted.join(_open_types(c).withColumnRenamed("name", "ret1"), "ret1", "left_semi").select("iface").distinct().withColumn("leads", F.lit(True))
    evidence = wanted.select("iface", "method").distinct().groupBy("iface").agg(F.collect_list("method").alias("m"))
    rows = full.join(takes, ["class", "iface"], "left").join(more, ["class", "iface"], "left").where("wraps or extra").join(leads, "iface", "left").join(evidence, "iface")
    return _found(rows, F.when(F.col("leads"), "Decorator").otherwise("Adapter"), 0.5, F.array("class", "iface"), F.col("m"), "class")


def decorator(c: Context) -> DataFrame:
    n = c.own.groupBy("owner").agg(F.count("*").alias("n"))
    abstract = c.classes.where("is_abstract")
    middle = abstract.select(F.col("name").alias("owner"), F.col("base_class").alias("base")).join(abstract.select(F.col("name").alias("base")), "base", "left_semi")
    subs = c.classes.where("not is_abstract and base_class is not null").groupBy(F.col("base_class").alias("owner")).agg(F.collect_list("name").alias("s"))
    rows = middle.join(n, "owner", "left").join(n.select(F.col("owner").alias("base"), F.col("n").alias("base_n")), "base", "left")
    rows = rows.where(F.coalesce("n", F.lit(0)) > F.coalesce("base_n", F.lit(0))).join(subs, "owner").where(F.size("s") >= 2)
    return _found(rows, "Decorator", 0.7, F.array("owner", "base"), F.col("s"))


def bridge(c: Context) -> DataFrame:
    first = c.links.groupBy("class").agg(F.min_by("iface", F.struct("ord", "iface")).alias("iface"))
    rows = c.classes.where("is_abstract").select(F.col("name").alias("class")).join(first, "class").join(c.interfaces.select(F.col("name").alias("iface")), "iface", "left_semi")
    rows = rows.withColumnRenamed("class", "owner").join(c.counts, "owner").where("subs >= 2")
    return _found(rows, "Bridge", 0.6, F.array("owner", "iface"), F.array(F.concat(F.lit("subclasses: "), F.col("subs").cast("string"))))


def flyweight(c: Context) -> DataFrame:
    cache = c.fields.where(F.col("is_static") & F.rlike("field_type", F.lit("Dictionary|Cache|Pool"))).select("owner").distinct().withColumn("cache", F.lit(True))
    made = c.own.groupBy("owner").agg(F.count_if(F.expr("is_static and ret1 = owner")).alias("s"), F.count_if(F.expr("not is_static and ret1 = owner")).alias("i"))
    rows = c.classes.select(F.col("name").alias("owner")).join(cache, "owner", "left").join(made, "owner", "left")
    confidence = F.when(F.col("cache") & (F.col("s") > 0), 0.85).when(F.col("cache"), 0.6).when(F.col("i") >= 2, 0.4)
    return _found(rows.withColumn("c", confidence).where("c is not null"), "Flyweight", F.col("c"))


def facade(c: Context) -> DataFrame:
    plain = c.classes.where("not is_abstract and not is_static").select(F.col("name").alias("owner")).join(c.links.select(F.col("class").alias("owner")), "owner", "left_anti")
    rows = c.own.join(plain, "owner", "left_semi").groupBy("owner").agg(F.collect_list("method").alias("m")).where(F.size("m") >= 4)
    return _found(rows, "Facade", 0.3, evidence=F.col("m"))


def _mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(owner, user): names that occur anywhere in a user's text, also within a longer identifier.

    Every end of an identifier meets the names with the same first letters, so no text is held against all names.
    """
    words = texts.select("user", F.explode(F.split("between", r"[^\p{L}\p{N}_]+")).alias("w")).where("w <> ''").distinct()
    for length, some in ((3, F.length("owner") >= 3), (1, F.length("owner") < 3)):
        ends = words.select("user", "w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("i")).select("user", "w", F.expr(f"substring(w, i, {length})").alias("k")).distinct()
        met = ends.join(names.where(some).withColumn("k", F.substring("owner", 1, length)), "k").where(F.contains("w", F.col("owner"))).select("owner", "user")
        found = met if length == 3 else found.unionByName(met)
    return found.distinct()


def strategy_command_state(c: Context) -> DataFrame:
    """One interface method M with at least two implementors; the call graph decides between the three."""
    few = c.faces.where("n = 1").join(c.counts, "owner").where("subs >= 2").select("owner", F.col("one").alias("m"))
    impl = stored(few.join(c.subtypes.select(F.col("name").alias("owner"), F.col("class").alias("impl")), "owner"), "implementors")
    one = impl.groupBy("owner", "m").agg(F.collect_list("impl").alias("sub_names"))
    used = _mentions(c.own.select(F.col("owner").alias("user"), "between"), one.select("owner"))
    outside = used.join(impl.select("owner", F.col("impl").alias("user")), ["owner", "user"], "left_anti").select("owner").distinct().withColumn("p", F.lit(True))
    named_ = F.col("m").isin(COMMAND_NAMES)
    rows = one.join(outside, "owner", "left")
    flag = lambda x: F.coalesce(F.col(x), F.lit(False))
    if c.calls is None:
        verdict = F.when(named_, F.struct(F.lit("Command"), F.lit(0.55))).when(flag("p"), F.struct(F.lit("Strategy"), F.lit(0.7))).otherwise(F.struct(F.lit("Strategy"), F.lit(0.9)))
    else:
        calls = c.calls.select("caller_class", F.col("callee").alias("m")).distinct()
        state = impl.join(calls, (impl.impl == calls.caller_class) & (impl.m == calls.m), "left_semi").select("owner").distinct().withColumn("s", F.lit(True))
        made = c.creations.select(F.col("class").alias("creator"), F.col("created_type").alias("impl")).distinct()
        creators = impl.join(made, "impl").where("creator <> impl")
        created = creators.select("owner").distinct().withColumn("c1", F.lit(True))
        invokes = creators.join(calls, (creators.creator == calls.caller_class) & (creators.m == calls.m), "left_semi").select("owner").distinct().withColumn("c2", F.lit(True))
        # a class other than some implementor calls M: with two implementors or more any caller is such a class
        callers = one.join(calls, "m", "left_semi").select("owner").distinct().withColumn("x", F.lit(True))
        for signal in (state, created, invokes, callers):
            rows = rows.join(signal, "owner", "left")
        pick = lambda kind, value: F.struct(F.lit(kind), F.lit(value))
        verdict = (
            F.when(flag("s"), pick("State", 0.75)).when(flag("c2"), pick("Command", 0.8)).when(named_ & flag("x"), pick("Command", 0.75)).when(named_, pick("Command", 0.55))
            .when(flag("p") & flag("x") & ~flag("c1"), pick("Strategy", 0.85)).when(flag("p"), pick("Strategy", 0.7)).when(flag("x") & ~flag("c1"), pick("Strategy", 0.75))
            .when(flag("c1"), pick("Command", 0.6)).otherwise(pick("Strategy", 0.9))
        )
    rows = rows.withColumn("v", verdict)
    return _found(rows, F.col("v.col1"), F.col("v.col2"), F.concat(F.array("owner"), F.array_sort("sub_names")), F.array(F.col("m")))


def observer(c: Context) -> DataFrame:
    speaks = c.face.where(~F.col("accessor")).groupBy("owner").agg(F.count("*").alias("n"), F.bool_or(F.contains(F.col("signature"), F.col("owner"))).alias("own"))
    typed = c.links.where(F.col("iface").isin(OBSERVERS)).join(c.classes.select(F.col("name").alias("class")), "class", "left_semi").groupBy(F.col("class").alias("owner")).agg(F.collect_list("iface").alias("i"))
    return _found(speaks.where("n >= 2 and own"), "Observer", 0.75, evidence=F.array(F.concat(F.lit("methods: "), F.col("n").cast("string")))).unionByName(_found(typed, "Observer", 0.9, evidence=F.col("i")))


def mediator(c: Context) -> DataFrame:
    rows = c.faces.where("n >= 2").join(c.direct.where("n_direct = 1"), "owner")
    if c.calls is not None:
        out = c.calls.where("callee_class <> '' and callee_class <> caller_class").select(F.col("caller_class").alias("one_class"), F.col("callee_class").alias("t")).distinct()
        out = out.join(c.interfaces.select(F.col("name").alias("t")), "t", "left_anti").join(c.links.select(F.col("class").alias("one_class"), F.col("iface").alias("t")), ["one_class", "t"], "left_anti")
        rows = rows.join(out.select("one_class").distinct(), "one_class", "left_semi")
    parts = c.own.where(~F.col("accessor") & (F.col("method") != F.col("owner"))).select("owner").distinct()
    n_classes, n_parts = c.classes.count(), parts.count()
    if n_classes - 1 < 2 and n_parts < 2:
        rows = rows.limit(0)
    return _found(rows, "Mediator", 0.6, evidence=F.col("methods"))


def dotnet_mediator(c: Context) -> DataFrame:
    """The first interface by name with one implementor, and the interfaces handled by several; else what the call graph shows of MediatR."""
    faces, direct, k = c.faces, c.direct, F.lit(1).alias("k")
    chief = faces.where("n >= 2").join(direct.where("n_direct = 1"), "owner").agg(F.min_by(F.struct("owner", "one_class"), "owner").alias("x")).select("x.owner", "x.one_class", k)
    chief = chief.where("owner is not null")
    spoken = c.links.select(F.col("class").alias("one_class"), F.col("iface").alias("h")).join(F.broadcast(chief.select("one_class")), "one_class", "left_semi")
    handled = faces.where("n = 1").join(direct.where("n_direct >= 2"), "owner").select(F.col("owner").alias("h")).join(spoken.select("h"), "h", "left_anti")
    listed = handled.agg(F.array_sort(F.collect_list("h")).alias("names")).select("names", k)
    first = stored(chief.join(listed, "k").where(F.size("names") >= 2), "mediator")
    rows = _found(first, "DotnetMediator", 0.85, F.concat(F.array("owner"), "names"), F.col("names"))
    if c.calls is None:
        return rows
    solid = c.classes.where("not is_abstract").select(F.col("name").alias("class"))
    handles = c.own.where("method = 'Handle'").select(F.col("owner").alias("class")).distinct()
    typed = c.links.join(solid, "class", "left_semi").join(handles, "class", "left_semi")
    held = lambda word: F.count_distinct(F.when(F.contains("iface", F.lit(word)), F.col("class")))
    n = typed.agg(held("Handler").alias("h"), held("Behavior").alias("b")).select("h", "b", k)
    said = c.calls.agg(F.count_if(F.col("callee").isin("Send", "Publish")).alias("s"), F.count_if(F.col("callee") == "AddMediatR").alias("a")).select("s", "a", k)
    graph = n.join(said, "k").where("h >= 2 and s >= 1").join(first.select("k"), "k", "left_anti").withColumn("owner", F.lit("MediatR"))
    evidence = F.array(F.concat(F.lit("handlers: "), F.col("h").cast("string")), F.concat(F.lit("sends: "), F.col("s").cast("string")))
    return rows.unionByName(_found(graph, "DotnetMediator", F.when((F.col("a") > 0) | (F.col("b") > 0), 0.85).otherwise(0.7), evidence=evidence))


def chain_of_responsibility(c: Context) -> DataFrame:
    rows = c.faces.where("n >= 2").join(c.counts, "owner").where("subs >= 2")
    return _found(rows, "ChainOfResponsibility", 0.5, evidence=F.array(F.concat(F.lit("implementations: "), F.col("subs").cast("string"))))


def handler(c: Context) -> DataFrame:
    rows = c.faces.where("n = 1").join(c.counts, "owner").where("subs >= 2").select("owner")
    return _found(rows.where(F.lit(rows.limit(2).count() >= 2)), "Handler", 0.7)


def template_method(c: Context) -> DataFrame:
    abstract = c.classes.where("is_abstract").select(F.col("name").alias("owner"))
    rows = c.own.join(abstract, "owner", "left_semi").groupBy("owner").agg(F.count_if(F.col("is_abstract")).alias("a"), F.count_if(F.expr("not is_abstract and not is_virtual and not accessor")).alias("b"))
    evidence = F.array(F.concat(F.lit("abstract: "), F.col("a").cast("string")), F.concat(F.lit("concrete: "), F.col("b").cast("string")))
    return _found(rows.where("a >= 1 and b >= 1"), "TemplateMethod", 0.75, evidence=evidence)


def visitor(c: Context) -> DataFrame:
    """Element interfaces with the first other interface of several methods, by name, as their visitor."""
    faces = c.faces
    element = faces.where("n = 1 and one_ret = 'void'").join(c.counts, "owner").where("subs >= 2").select(F.col("owner").alias("element"))
    least = [r[0] for r in faces.where("n >= 2").select("owner").orderBy("owner").limit(2).collect()]
    if not least:
        return _found(element.limit(0).withColumn("owner", F.col("element")), "Visitor", 0.7)
    pick = F.when(F.col("element") != least[0], F.lit(least[0])).otherwise(F.lit(least[1] if len(least) > 1 else None).cast("string"))
    rows = element.withColumn("owner", pick).where("owner is not null").join(faces.select("owner", "methods"), "owner")
    return _found(rows, "Visitor", 0.7, F.array("owner", "element"), F.col("methods"))


def iterator(c: Context) -> DataFrame:
    typed = c.links.where(F.col("iface").isin(ITERATORS)).join(c.classes.select(F.col("name").alias("class")), "class", "left_semi").groupBy(F.col("class").alias("owner")).agg(F.collect_list("iface").alias("i"))
    declared = c.interfaces.where(F.col("name").isin(ITERATORS)).select(F.col("name").alias("owner")).distinct()
    return _found(typed, "Iterator", 0.95, evidence=F.col("i")).unionByName(_found(declared, "Iterator", 0.9))


def memento(c: Context) -> DataFrame:
    solid = c.classes.where("not is_abstract and not is_static").select(F.col("name").alias("owner"))
    rows = c.own.join(solid, "owner", "left_semi").groupBy("owner").agg(F.collect_list("method").alias("m"), F.bool_and("accessor").alias("only"))
    return _found(rows.where((F.size("m") <= 6) & F.col("only")), "Memento", 0.4, evidence=F.col("m"))


def interpreter(c: Context) -> DataFrame:
    rows = c.faces.where("n = 1 and one_ret <> 'void'").join(c.counts, "owner").where("subs >= 2")
    return _found(rows, "Interpreter", 0.8, evidence=F.array(F.concat(F.lit("implementations: "), F.col("subs").cast("string")), F.concat(F.lit("method: "), F.col("one"))))


def di_container(c: Context) -> DataFrame:
    names = c.classes.where(F.expr("is_static or name = 'Program' or endswith(name, 'Startup') or endswith(name, 'Extension') or endswith(name, 'Extensions')")).select(F.col("name").alias("owner"))
    rows = c.own.join(names, "owner", "left_semi").select("owner", "signature", F.explode(F.array(*(F.lit(k) for k in DI_KEYWORDS))).alias("k")).where(F.contains("signature", F.col("k")))
    rest = F.expr("substring(signature, instr(signature, k))")
    arg = F.regexp_extract(rest, "<([^>]*)>", 1)
    rows = rows.groupBy("owner").agg(F.count("*").alias("n"), F.collect_list(F.when(arg != "", arg)).alias("e")).where("n >= 2")
    return _found(rows, "DiContainer", 0.9, evidence=F.col("e"))


def controller_api(c: Context) -> DataFrame:
    solid = c.classes.where("not is_abstract").select(F.col("name").alias("owner"))
    base = c.above.where(F.col("ancestor").isin("ControllerBase", "Controller")).select(F.col("class").alias("owner")).distinct().withColumn("base", F.lit(True))
    real = c.own.join(solid, "owner", "left_semi").where(~F.col("accessor") & (F.col("method") != F.col("owner")))
    rows = real.groupBy("owner").agg(F.count("*").alias("n"), F.count_if(F.col("between") != "").alias("with"), F.collect_list("method").alias("m")).where("n >= 2").join(base, "owner", "left")
    based = F.coalesce("base", F.lit(False))
    confidence = F.when(based, 0.98 if c.http else 0.95).when(F.lit(c.http), 0.9).when(F.expr("n >= 3 and 2 * with >= n"), 0.7)
    return _found(rows.withColumn("c", confidence).where("c is not null"), "ControllerApi", F.col("c"), evidence=F.col("m"))


def minimal_api(c: Context) -> DataFrame:
    names = c.classes.where("is_static or name = 'Program'").select(F.col("name").alias("owner"))
    rows = c.own.join(names, "owner", "left_semi").groupBy("owner").agg(F.bool_or(F.contains("between", F.lit("WebApplication"))).alias("app"), F.collect_list(F.when(F.col("method") != F.col("owner"), F.col("method"))).alias("m"))
    confidence = F.when(F.col("app"), 0.95 if c.maps else 0.8).when(F.lit(c.maps), 0.85)
    return _found(rows.where(F.size("m") > 0).withColumn("c", confidence).where("c is not null"), "MinimalApi", F.col("c"), evidence=F.col("m"))


DETECTORS = (
    singleton, factory_method, abstract_factory, builder, prototype, composite, wrappers, decorator, bridge, flyweight, facade, strategy_command_state, observer, mediator, dotnet_mediator,
    chain_of_responsibility, handler, template_method, visitor, iterator, memento, interpreter, di_container, controller_api, minimal_api,
)


def detect(facts: Facts, use_callgraph: bool = True, source_text: str = "") -> DataFrame:
    """All detectors over the facts, which are written once first, as is the hierarchy of types."""
    c = context(facts.settled(), use_callgraph, source_text)
    c.own, c.face = stored(c.own, "own"), stored(c.face, "face")
    found = [d(c) for d in DETECTORS]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def hits(matches: DataFrame) -> DataFrame:
    """(pattern, hits, best): matches per pattern."""
    return matches.groupBy("pattern").agg(F.count("*").alias("hits"), F.max("confidence").alias("best")).orderBy("pattern")
