"""The call graph: bindings, outbound and inbound calls, call trees and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .facts import Facts, is_accessor
from .pairs import paired
from .types import concrete_subtypes


def bind_callees(facts: Facts) -> DataFrame:
    """The calls with ``bound``: the class a call belongs to, judged from the call alone.

    A call of ``this`` or without a target belongs to the caller's class if that has the method, else to the first class
    by name that has it; a call through the name of a known class belongs to that; else ''.
    """
    defined = facts.methods.where("owner_kind = 'class'").select("owner", "method").distinct()
    mine = defined.select(F.col("owner").alias("caller_class"), F.col("method").alias("callee"), F.lit(True).alias("mine"))
    some = defined.groupBy(F.col("method").alias("callee")).agg(F.min("owner").alias("some"))
    known = facts.classes.select(F.col("name").alias("target_expr"), F.lit(True).alias("known")).distinct()
    rows = facts.calls.join(mine, ["caller_class", "callee"], "left").join(some, "callee", "left").join(known, "target_expr", "left")
    bare = F.coalesce("is_self_call", F.lit(False)) | (F.col("target_expr") == "")
    bound = F.when(bare, F.coalesce(F.when(F.col("mine"), F.col("caller_class")), F.col("some"), F.lit(""))).when(F.col("known"), F.col("target_expr")).otherwise("")
    return rows.withColumn("bound", bound).select(*facts.calls.columns, "bound")


def delegates(facts: Facts) -> DataFrame:
    """(site_id, delegate): identifier arguments that name a method of the caller's class."""
    given = facts.calls.select("site_id", "caller_class", F.explode("delegates").alias("delegate"))
    own = facts.methods.where("owner_kind = 'class'").select(F.col("owner").alias("caller_class"), F.col("method").alias("delegate")).distinct()
    return given.join(own, ["caller_class", "delegate"], "left_semi").select("site_id", "delegate").distinct()


def match_class(facts: Facts, part: str) -> DataFrame:
    """(name): classes whose name contains ``part`` in any case; all classes where none does."""
    hit = facts.classes.where(F.contains(F.lower("name"), F.lit(part.lower()))).select("name")
    return (hit if hit.limit(1).count() else facts.classes.select("name")).orderBy("name")


def outbound(facts: Facts) -> DataFrame:
    """(caller_class, caller_method, callee, calls, via): calls of each method by callee; via is the first call's target."""
    rows = facts.calls.where(~is_accessor(F.col("caller_method")))
    return rows.groupBy("caller_class", "caller_method", "callee").agg(F.count("*").alias("calls"), F.min_by("target_expr", "site_id").alias("via"))


def inbound(facts: Facts) -> DataFrame:
    """(callee, caller_class, calls, via): who calls a name, whatever its class; via only where there is a single call."""
    rows = facts.calls.groupBy("callee", "caller_class").agg(F.count("*").alias("calls"), F.min("target_expr").alias("via"))
    return rows.withColumn("via", F.when(F.col("calls") == 1, F.col("via")).otherwise(""))


def summary(facts: Facts, top: int = 5) -> DataFrame:
    """(caller_class, total, callee, calls, rank): the callees each class calls most; names break ties.

    Counts are taken per class and callee before any window, so a class with most of the calls costs no more.
    """
    per = facts.calls.groupBy("caller_class", "callee").agg(F.count("*").alias("calls"))
    total = per.groupBy("caller_class").agg(F.sum("calls").alias("total"))
    rank = F.row_number().over(Window.partitionBy("caller_class").orderBy(F.desc("calls"), "callee"))
    return per.withColumn("rank", rank).where(F.col("rank") <= top).join(total, "caller_class").select("caller_class", "total", "callee", "calls", "rank")


def dispatches(facts: Facts, subtypes: DataFrame | None = None) -> DataFrame:
    """(callee, iface, class): where a called name may lead through an interface: every concrete subtype of every interface that declares it."""
    subtypes = concrete_subtypes(facts) if subtypes is None else subtypes
    known = facts.interfaces.select(F.col("name").alias("iface"))
    declared = facts.methods.where("owner_kind = 'interface'").select(F.col("owner").alias("iface"), F.col("method").alias("callee")).distinct().join(known, "iface", "left_semi")
    return declared.join(subtypes.withColumnRenamed("name", "iface"), "iface").select("callee", "iface", "class")


def _steps(facts: Facts) -> DataFrame:
    """(caller_class, caller_method, callee, calls, via, plain): each callee of each method and, in ``plain``, where it leads if no interface declares it."""
    per = facts.calls.groupBy("caller_class", "caller_method", "callee").agg(F.count("*").alias("calls"), F.min_by("target_expr", "site_id").alias("via"))
    named = facts.classes.select(F.col("name").alias("via"), F.col("name").alias("target")).distinct()
    some = facts.methods.where("owner_kind = 'class'").groupBy(F.col("method").alias("callee")).agg(F.min("owner").alias("some"))
    rows = per.join(named, "via", "left").join(some, "callee", "left")
    return rows.select("caller_class", "caller_method", "callee", "calls", "via", F.coalesce("target", "some").alias("plain"))


def _leads(rows: DataFrame) -> DataFrame:
    """``_steps`` joined to ``dispatches`` (their class as ``impl``), with ``class`` in place of ``plain`` and ``impl``."""
    return rows.withColumn("class", F.when(F.col("iface").isNotNull(), F.col("impl")).otherwise(F.col("plain"))).drop("impl", "plain")


def call_hops(facts: Facts, subtypes: DataFrame | None = None) -> DataFrame:
    """(caller_class, caller_method, callee, calls, via, iface, class): each callee of each method and where it leads.

    A name that interfaces with concrete subtypes declare leads to all of these (``iface`` set), and nowhere else. Any
    other leads to the class that the call's target names, else to the first class by name that has the method, else
    nowhere (null). ``via`` is the target of the first call.
    """
    through = dispatches(facts, subtypes).withColumnRenamed("class", "impl")
    return _leads(paired(_steps(facts), through, "callee", "left")).select("caller_class", "caller_method", "callee", "calls", "via", "iface", "class")


def call_tree(facts: Facts, cls: str, method: str, depth: int = 3) -> DataFrame:
    """(level, path, callee, calls, via, iface, class, cycle): what a method calls, level by level, down to ``depth``.

    ``path`` holds the methods gone through as 'Class.Method', from the start to the caller; see ``call_hops`` for the
    rest. A step back to a method of the same class that the walk has been in since it came into the class is a cycle
    and not followed; a step into another class or through an interface starts anew, so ``depth`` is what ends the walk.
    Only callees of methods that the walk reaches are led through interfaces; what is stored grows with the calls and
    the tree, not with all pairs of calls and implementors.
    """
    spark = facts.calls.sparkSession
    steps, through = stored(_steps(facts), "steps"), stored(dispatches(facts).withColumnRenamed("class", "impl"), "dispatches")
    one = f"{cls}.{method}"
    front = spark.createDataFrame([(cls, method, [one], [one])], "caller_class string, caller_method string, path array<string>, seen array<string>")
    out = None
    step = F.concat_ws(".", "class", "callee")
    stays = F.col("iface").isNull() & (F.col("class") == F.col("caller_class"))
    for k in range(1, depth + 1):
        rows = _leads(steps.join(front, ["caller_class", "caller_method"]).join(through, "callee", "left"))
        rows = rows.withColumn("cycle", F.coalesce(stays & F.array_contains("seen", step), F.lit(False)))
        if k < depth:
            rows = stored(rows, "level")
        part = rows.select(F.lit(k).alias("level"), "path", "callee", "calls", "via", "iface", "class", "cycle")
        out = part if out is None else out.unionByName(part)
        front = rows.where("class is not null and not cycle").select(
            F.col("class").alias("caller_class"), F.col("callee").alias("caller_method"), F.concat("path", F.array(step)).alias("path"), F.when(stays, F.concat("seen", F.array(step))).otherwise(F.array(step)).alias("seen")
        )
    return out


def by_directory(facts: Facts) -> DataFrame:
    """(directory, files, calls, callees): calls by the first folder of the calling file."""
    return facts.calls.groupBy(F.substring_index("file", "/", 2).alias("directory")).agg(
        F.count_distinct("file").alias("files"), F.count("*").alias("calls"), F.count_distinct("callee").alias("callees")
    )


def directory_report(facts: Facts, top: int = 10) -> DataFrame:
    """(directory, callee, calls, rank): the ``top`` callees of each directory, creations as 'new X'; names break ties."""
    made = F.coalesce("is_creation", F.lit(False)) & F.col("created_type").isNotNull()
    name = F.when(made, F.concat(F.lit("new "), "created_type")).otherwise(F.col("callee"))
    per = facts.calls.groupBy(F.substring_index("file", "/", 2).alias("directory"), name.alias("callee")).agg(F.count("*").alias("calls"))
    rank = F.row_number().over(Window.partitionBy("directory").orderBy(F.desc("calls"), "callee"))
    return per.withColumn("rank", rank).where(F.col("rank") <= top)


def class_calls_method(facts: Facts, cls: str, method: str) -> bool:
    """Whether a class calls any method of that name."""
    return bool(facts.calls.where((F.col("caller_class") == cls) & (F.col("callee") == method)).limit(1).count())


def class_creates_type(facts: Facts, cls: str, created: str) -> bool:
    """Whether a class makes objects of a type."""
    return bool(facts.creations.where((F.col("class") == cls) & (F.col("created_type") == created)).limit(1).count())


def creation_count(facts: Facts, cls: str, created: str) -> int:
    """How often a class makes objects of a type."""
    return facts.creations.where((F.col("class") == cls) & (F.col("created_type") == created)).count()


def created_types(facts: Facts) -> DataFrame:
    """(class, created_type): the types each class makes objects of."""
    return facts.creations.select("class", "created_type").distinct()
