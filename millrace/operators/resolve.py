"""Resolution of call sites to methods, with confidence scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .facts import Facts
from .pairs import paired
from .types import concrete_subtypes

# Scores of the kinds of confidence.
SCORES = {"Direct": 100, "ExplicitImpl": 95, "DiRegistration": 95, "CHA": 70, "MultiImpl": 60, "RTA": 50, "Reflection": 40, "DynamicString": 10, "Unknown": 0}
# Method names of factories, reflection and dependency injection.
FACTORY_METHODS = ["Create", "Build", "Make", "Resolve", "GetInstance"]
REFLECTION_METHODS = ["GetMethod", "GetProperty", "GetField", "CreateInstance"]
DI_ADD = ["AddScoped", "AddSingleton", "AddTransient"]
DI_GET = ["GetService", "GetRequiredService", "GetKeyedService"]


def score(confidence: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SCORES.items() for x in kv)), confidence), F.lit(0))


def label(confidence: Column) -> Column:
    """'Name(score)'."""
    return F.concat(confidence, F.lit("("), score(confidence).cast("string"), F.lit(")"))


def call_targets(facts: Facts) -> DataFrame:
    """(site_id, kind, class, method): what a call looks like.

    A creation and a call through a capitalised name are Static; a call of an interface's or an abstract class's method
    is Abstract, of another known class Virtual; the rest is Instance.
    """
    c = facts.calls
    abstract = facts.classes.where("is_abstract").select("name").unionByName(facts.interfaces.select("name")).distinct().withColumn("open", F.lit(True))
    known = facts.classes.select("name").distinct().withColumn("known", F.lit(True))
    x = c.join(abstract, c.callee_class == abstract.name, "left").drop("name").join(known, c.callee_class == known.name, "left").drop("name")
    kind = (
        F.when(F.coalesce("is_creation", F.lit(False)), "Static")
        .when(F.rlike("target_expr", F.lit(r"^\p{Lu}[\p{L}\p{N}_]*$")), "Static")
        .when(F.col("open"), "Abstract")
        .when(F.col("known"), "Virtual")
        .otherwise("Instance")
    )
    method = F.when(F.coalesce("is_creation", F.lit(False)), ".ctor").otherwise(F.col("callee"))
    cls = F.when(F.coalesce("is_creation", F.lit(False)), F.col("created_type")).when(kind == "Static", F.col("target_expr")).otherwise(F.col("callee_class"))
    return x.select("site_id", kind.alias("kind"), F.coalesce(cls, F.lit("")).alias("class"), method.alias("method"))


def _result(df: DataFrame, strategy: str, confidence: Column, owner: Column) -> DataFrame:
    return df.select("site_id", F.lit(strategy).alias("strategy"), confidence.alias("confidence"), owner.alias("owner"), F.col("method"))


def resolve_direct(targets: DataFrame) -> DataFrame:
    """Static and instance calls: one target, Direct."""
    return _result(targets.where(F.col("kind").isin("Static", "Instance")), "direct", F.lit("Direct"), F.col("class"))


def _distinct(targets: DataFrame) -> DataFrame:
    """(class, method) of targets, each once: what is resolved; sites are joined to the answer at the end."""
    return targets.select("class", "method").distinct()


def _implementations(facts: Facts, targets: DataFrame, subtypes: DataFrame) -> DataFrame:
    """(class, method, owner): the concrete classes that may stand for a called type and define the method."""
    defined = facts.methods.where("owner_kind = 'class'").select(F.col("owner"), "method").distinct()
    pairs = _distinct(targets).join(subtypes.select(F.col("name").alias("class"), F.col("class").alias("owner")), "class")
    return pairs.join(defined, ["owner", "method"], "left_semi").select("class", "method", "owner")


def _of_sites(targets: DataFrame, found: DataFrame) -> DataFrame:
    """The answers (class, method, ...) at every site that asks."""
    return targets.select("site_id", "class", "method").join(found, ["class", "method"])


def resolve_cha(facts: Facts, targets: DataFrame, subtypes: DataFrame) -> DataFrame:
    """Class hierarchy analysis: every definition in a concrete subtype of the called type."""
    asked = targets.where(F.col("kind").isin("Virtual", "Abstract"))
    return _result(_of_sites(asked, _implementations(facts, asked, subtypes)), "cha", F.lit("CHA"), F.col("owner"))


def resolve_rta(facts: Facts, targets: DataFrame, subtypes: DataFrame) -> DataFrame:
    """Rapid type analysis: of those, the classes that are created somewhere."""
    created = facts.creations.select(F.col("created_type").alias("owner")).distinct()
    asked = targets.where(F.col("kind").isin("Virtual", "Abstract"))
    return _result(_of_sites(asked, _implementations(facts, asked, subtypes).join(created, "owner", "left_semi")), "rta", F.lit("RTA"), F.col("owner"))


def _by_count(found: DataFrame, one: str, many: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("class", "method"))
    return found.withColumn("confidence", F.when(n == 1, one).otherwise(many))


def _open_targets(facts: Facts, targets: DataFrame) -> DataFrame:
    """Abstract targets, and static or virtual ones on an abstract class."""
    abstract = facts.classes.where("is_abstract").select(F.col("name").alias("class")).distinct().withColumn("on_abstract", F.lit(True))
    on_class = F.col("kind").isin("Static", "Virtual") & F.coalesce("on_abstract", F.lit(False))
    return targets.join(abstract, "class", "left").where((F.col("kind") == "Abstract") | on_class).select(*targets.columns)


def resolve_abstract(facts: Facts, targets: DataFrame, subtypes: DataFrame) -> DataFrame:
    """Targets that are open: every concrete subtype, whether it defines the method or inherits it."""
    chosen = _open_targets(facts, targets).select("site_id", "class", "method")
    n = F.count("*").over(Window.partitionBy("class"))
    found = subtypes.select(F.col("name").alias("class"), F.col("class").alias("owner")).withColumn("confidence", F.when(n == 1, "ExplicitImpl").otherwise("CHA"))
    return _result(paired(chosen, found, "class"), "abstract", F.col("confidence"), F.col("owner"))


def resolve_interface(facts: Facts, targets: DataFrame, subtypes: DataFrame) -> DataFrame:
    """Calls of interfaces: implementors that define the method; a single one is certain."""
    faces = facts.interfaces.select(F.col("name").alias("class"))
    asked = targets.where(F.col("kind").isin("Abstract", "Virtual")).join(faces, "class", "left_semi").select(*targets.columns)
    return _result(_of_sites(asked, _by_count(_implementations(facts, asked, subtypes), "ExplicitImpl", "MultiImpl")), "interface", F.col("confidence"), F.col("owner"))


def resolve_di(facts: Facts, targets: DataFrame, registrations: DataFrame) -> DataFrame:
    """Calls of types registered with a container: the registered implementations that exist as classes, at the best confidence registered."""
    known = facts.classes.select(F.col("name").alias("implementation_type"))
    real = registrations.join(known, "implementation_type", "left_semi").withColumn("score", score(F.col("confidence")))
    best = real.groupBy("interface_type").agg(F.max("score").alias("top"))
    named = F.create_map(*(F.lit(x) for k, v in reversed(SCORES.items()) for x in (v, k) if k != "ExplicitImpl"))
    found = real.join(best, "interface_type").select(F.col("interface_type").alias("class"), F.col("implementation_type").alias("owner"), F.try_element_at(named, F.col("top")).alias("confidence")).distinct()
    asked = targets.select("site_id", "class", "method").join(found.select("class").distinct(), "class", "left_semi").distinct()
    return _result(paired(asked, found, "class"), "di", F.col("confidence"), F.col("owner"))


def resolve_factory(targets: DataFrame) -> DataFrame:
    """Calls of factory methods: RTA without a target."""
    return _result(targets.where(F.col("kind").isin("Static", "Instance") & F.col("method").isin(FACTORY_METHODS)), "factory", F.lit("RTA"), F.lit(None).cast("string"))


def resolve_reflection(targets: DataFrame) -> DataFrame:
    """Static calls of reflection: the named type; only a string at run time names the method, which stays ''."""
    found = targets.where((F.col("kind") == "Static") & F.col("method").isin(REFLECTION_METHODS))
    return _result(found.withColumn("method", F.lit("")), "reflection", F.lit("DynamicString"), F.nullif("class", F.lit("")))


def resolve_dynamic(targets: DataFrame) -> DataFrame:
    """Anything, with no confidence."""
    return _result(targets, "dynamic", F.lit("Unknown"), F.lit(None).cast("string"))


def di_registrations(facts: Facts) -> DataFrame:
    """(interface_type, implementation_type, lifetime, confidence) from calls Add{Scoped,Singleton,Transient}<I, C>.

    With one type argument a class is registered for itself.
    """
    args = F.split(F.regexp_extract("callee", r"^Add(?:Scoped|Singleton|Transient)<(.+)>$", 1), r"\s*,\s*")
    life = F.regexp_extract("callee", r"^Add(Scoped|Singleton|Transient)<", 1)
    rows = facts.calls.where(F.rlike("callee", F.lit("^Add(Scoped|Singleton|Transient)<.+>$"))).select(F.get(args, F.lit(0)).alias("interface_type"), F.coalesce(F.get(args, F.lit(1)), F.get(args, F.lit(0))).alias("implementation_type"), life.alias("lifetime"))
    return rows.distinct().withColumn("confidence", F.lit("DiRegistration"))


def factories(facts: Facts) -> DataFrame:
    """(return_type, owner, method): methods that return an interface or an abstract class and are named as factories are."""
    open_ = facts.interfaces.select("name").unionByName(facts.classes.where("is_abstract").select("name")).distinct()
    named_ = facts.methods.where(F.rlike("method", F.lit("^(" + "|".join(FACTORY_METHODS) + ")")))
    return named_.join(open_, named_.ret == open_.name, "left_semi").select(F.col("ret").alias("return_type"), "owner", "method").distinct()


def resolutions(facts: Facts, registrations: DataFrame | None = None) -> DataFrame:
    """(site_id, strategy, confidence, score, owner, method): all strategies over all call sites."""
    targets, subtypes = call_targets(facts), concrete_subtypes(facts)
    found = [resolve_direct(targets), *(f(facts, targets, subtypes) for f in (resolve_cha, resolve_rta, resolve_abstract, resolve_interface)), resolve_factory(targets), resolve_reflection(targets), resolve_dynamic(targets)]
    if registrations is not None:
        found.append(resolve_di(facts, targets, registrations))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("score", score(F.col("confidence")))


def best(facts: Facts, registrations: DataFrame | None = None, subtypes: DataFrame | None = None) -> DataFrame:
    """(site_id, strategy, confidence, score, targets): per site the alternative of the highest score; the strategy last in the alphabet on ties.

    The same as the best of ``resolutions``, without its rows: every distinct target is resolved once, to numbers of
    classes, and the sites are joined to that; so no step has more rows than the sites, or the targets with their subtypes.
    """
    targets = call_targets(facts)
    subtypes = concrete_subtypes(facts) if subtypes is None else subtypes
    asked = stored(targets.groupBy("kind", "class", "method").agg(F.count("*").alias("sites")).drop("sites"), "targets")
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    defined = flag(facts.methods.where("owner_kind = 'class'").select("owner", "method"), "defined")
    created = flag(facts.creations.select(F.col("created_type").alias("owner")), "created")
    pairs = asked.where("kind <> 'Instance'").select("class", "method").distinct().join(subtypes.select(F.col("name").alias("class"), F.col("class").alias("owner")), "class")
    n = pairs.join(defined, ["owner", "method"], "left").join(created, "owner", "left").groupBy("class", "method").agg(
        F.count("*").alias("subs"), F.count_if("defined").alias("defs"), F.count_if(F.col("defined") & F.col("created")).alias("made")
    )
    rows = asked.join(n, ["class", "method"], "left").join(flag(facts.classes.where("is_abstract").select(F.col("name").alias("class")), "abstract"), "class", "left").join(flag(facts.interfaces.select(F.col("name").alias("class")), "face"), "class", "left")
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    num = lambda c: F.coalesce(F.col(c), F.lit(0))
    option = lambda when, strategy, confidence, count: F.when(when, F.struct(F.lit(strategy).alias("strategy"), confidence.alias("confidence"), count.cast("long").alias("targets")))
    sure = lambda c, other: F.when(F.col(c) == 1, F.lit("ExplicitImpl")).otherwise(F.lit(other))
    none = F.lit(0)
    options = [
        option(is_("Static", "Instance"), "direct", F.lit("Direct"), F.lit(1)),
        option(is_("Virtual", "Abstract") & (num("defs") > 0), "cha", F.lit("CHA"), num("defs")),
        option(is_("Virtual", "Abstract") & (num("made") > 0), "rta", F.lit("RTA"), num("made")),
        option((is_("Abstract") | (is_("Static", "Virtual") & F.col("abstract"))) & (num("subs") > 0), "abstract", sure("subs", "CHA"), num("subs")),
        option(is_("Abstract", "Virtual") & F.col("face") & (num("defs") > 0), "interface", sure("defs", "MultiImpl"), num("defs")),
        option(is_("Static", "Instance") & F.col("method").isin(FACTORY_METHODS), "factory", F.lit("RTA"), none),
        option(is_("Static") & F.col("method").isin(REFLECTION_METHODS), "reflection", F.lit("DynamicString"), F.when(F.col("class") == "", none).otherwise(F.lit(1))),
        option(F.lit(True), "dynamic", F.lit("Unknown"), none),
    ]
    if registrations is not None:
        di = resolve_di(facts, asked.withColumn("site_id", F.xxhash64("kind", "class", "method")), registrations).groupBy("site_id").agg(F.min("confidence").alias("di"), F.count("*").alias("di_n"))
        rows = rows.withColumn("site_id", F.xxhash64("kind", "class", "method")).join(di, "site_id", "left")
        options.append(option(F.col("di").isNotNull(), "di", F.col("di"), num("di_n")))
    scored = F.transform(F.filter(F.array(*options), lambda o: o.isNotNull()), lambda o: F.struct(score(o["confidence"]).alias("score"), o["strategy"].alias("strategy"), o["confidence"].alias("confidence"), o["targets"].alias("targets")))
    answers = rows.select("kind", "class", "method", F.array_max(scored).alias("b"))
    return targets.join(answers, ["kind", "class", "method"]).select("site_id", "b.strategy", "b.confidence", "b.score", "b.targets")


def top_callees(facts: Facts, n: int = 15) -> DataFrame:
    """(callee, calls): the methods called most; names break ties."""
    return facts.calls.groupBy("callee").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "callee").limit(n)


def creation_counts(facts: Facts) -> DataFrame:
    """(class, created_type, n): how often a class creates a type."""
    return facts.creations.groupBy("class", "created_type").agg(F.count("*").alias("n"))


def _type_argument(callee: Column) -> Column:
    """The first type argument of a callee's text, '' without any."""
    inside = F.regexp_extract(callee, r"^\w+<(.+)>$", 1)
    return F.btrim(F.regexp_extract(inside, r"^((?:[^,<>]|<[^<>]*>)*)", 1))


def di_calls(facts: Facts) -> DataFrame:
    """(site_id, kind, type, method): registrations (Static, on the first type argument) and lookups (DiResolved) of a container."""
    name = F.regexp_extract("callee", r"^(\w+)<", 1)
    rows = facts.calls.select("site_id", name.alias("method"), _type_argument(F.col("callee")).alias("type")).where("type <> ''")
    kind = F.when(F.col("method").isin(DI_ADD), "Static").when(F.col("method").isin(DI_GET), "DiResolved")
    return rows.withColumn("kind", kind).where("kind is not null").select("site_id", "kind", "type", "method")


def register(registrations: DataFrame, interface_type: str, implementation_type: str, lifetime: str = "Scoped", confidence: str = "DiRegistration") -> DataFrame:
    """The registrations with one more; the table of registrations is the container."""
    one = registrations.sparkSession.createDataFrame([(interface_type, implementation_type, lifetime, confidence)], "interface_type string, implementation_type string, lifetime string, confidence string")
    return registrations.select(*one.columns).unionByName(one)


def reflection_patterns(facts: Facts) -> DataFrame:
    """(site_id, type, method): calls of reflection on ``typeof(T)``."""
    kind = F.regexp_extract("target_expr", r"^typeof\(\s*([\w.<>, ]+?)\s*\)$", 1)
    return facts.calls.select("site_id", kind.alias("type"), F.col("callee").alias("method")).where((F.col("type") != "") & F.col("method").isin(REFLECTION_METHODS))
