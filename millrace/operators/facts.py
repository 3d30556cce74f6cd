"""Program facts as relations: types, methods, calls, from tables or from the C# frontend."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import named, simple_name
from ..session import stored
from ..sources.tables import table


@dataclass
class Facts:
    """The relations every operator on programs reads.

    classes(name, base_class, is_abstract, is_sealed, is_static, file), interfaces(name, file),
    class_iface(class, iface, ord), methods(owner, owner_kind, ord, method, signature, ret, params, is_static,
    is_virtual, is_abstract, file, line_start, line_end), calls(site_id, file, caller_class, caller_method, callee,
    callee_class, target_expr, is_self_call, is_creation, created_type, line, delegates), creations(class,
    created_type), fields(owner, ord, name, field_type, is_static, is_readonly).

    Unknown texts are '' and never null, so that joins meet them; ``base_class`` and ``created_type`` are null for none.
    """

    classes: DataFrame
    interfaces: DataFrame
    class_iface: DataFrame
    methods: DataFrame
    calls: DataFrame
    creations: DataFrame
    fields: DataFrame

    def settled(self) -> Facts:
        """The same facts written once in the shared folder, for plans that read them often."""
        return replace(self, **{f.name: stored(getattr(self, f.name), f.name) for f in fields(self)})


def merged_classes(declarations: DataFrame, merge: str) -> DataFrame:
    """One row per class name from (name, base_class, flags, file, at): at breaks ties within a file.

    'first': the declaration of the first file, by name, wins. 'append': flags of the first, but the last base that is
    present.
    """
    first = Window.partitionBy("name").orderBy("file", "at")
    rows = declarations.withColumn("rn", F.row_number().over(first))
    if merge == "append":
        rows = rows.withColumn("base_class", F.last("base_class", ignorenulls=True).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.where("rn = 1").select("name", "base_class", "is_abstract", "is_sealed", "is_static", "file")


def from_tables(spark: SparkSession, folder: str, merge: str = "first", calls_where: str = "true") -> Facts:
    """Facts of the code tables in a folder, see ``from_frames``; there are no fields."""
    none = "owner string, ord int, name string, field_type string, is_static boolean, is_readonly boolean"
    return from_frames(lambda name: spark.createDataFrame([], none) if name == "fields" else table(spark, folder, name), merge, calls_where)


def from_frames(get: Callable[[str], DataFrame], merge: str = "first", calls_where: str = "true") -> Facts:
    """Facts of code tables, by name: classes, interfaces, class_iface, methods, calls, fields. Rows that came again count once; references are reduced to simple names.

    ``merge`` is the policy for a class declared more than once, see ``merged_classes``; methods and interface lists of
    all declarations are kept. ``calls_where``: a condition on the rows of calls, as for one version of a program.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    declared = get("classes").select(
        named(F.col("name")).alias("name"), named(F.col("base_class")).alias("base_class"), "is_abstract", "is_sealed", "is_static", text("file").alias("file"), F.col("class_id").alias("at")
    ).where(F.col("name").isNotNull()).distinct()
    interfaces = get("interfaces").select(named(F.col("name")).alias("name"), text("file").alias("file")).where(F.col("name").isNotNull())
    links = get("class_iface").select(named(F.col("class")).alias("class"), named(F.col("iface")).alias("iface"), "ord")
    methods = get("methods").select(
        named(F.col("owner")).alias("owner"), text("owner_kind").alias("owner_kind"), "ord", text("method").alias("method"), text("signature").alias("signature"), text("ret").alias("ret"),
        F.coalesce("params", F.array().cast("array<string>")).alias("params"), "is_static", "is_virtual", "is_abstract", text("file").alias("file"), "line_start", "line_end",
    ).where(F.col("owner").isNotNull()).distinct()
    calls = get("calls").where(calls_where).select(
        "site_id", text("file").alias("file"), F.coalesce(simple_name(F.col("caller_class")), F.lit("")).alias("caller_class"), text("caller_method").alias("caller_method"), text("callee").alias("callee"),
        F.coalesce(simple_name(F.col("callee_class")), F.lit("")).alias("callee_class"), text("target_expr").alias("target_expr"), "is_self_call", "is_creation", named(F.col("created_type")).alias("created_type"), "line",
        F.coalesce("delegates", F.array().cast("array<string>")).alias("delegates"),
    ).where(F.col("site_id").isNotNull()).dropDuplicates(["site_id"])
    return Facts(
        classes=merged_classes(declared, merge),
        interfaces=interfaces.groupBy("name").agg(F.min("file").alias("file")),
        class_iface=links.where(F.col("class").isNotNull() & F.col("iface").isNotNull()).groupBy("class", "iface").agg(F.min("ord").alias("ord")),
        methods=methods,
        calls=calls,
        creations=calls.where(F.col("is_creation") & F.col("created_type").isNotNull()).select(F.col("caller_class").alias("class"), "created_type"),
        fields=get("fields"),
    )


def first_word(signature: Column) -> Column:
    """The return type as the signature's first word, 'void' where there is none."""
    word = F.substring_index(F.ltrim(signature), " ", 1)
    return F.when(word == "", F.lit("void")).otherwise(word)


def parameter_text(signature: Column) -> Column:
    """What stands between the first '(' and the first ')' after it; '' without parentheses."""
    opened = F.instr(signature, "(")
    rest = F.substr(signature, opened + 1)
    return F.when(opened == 0, F.lit("")).otherwise(F.substring_index(rest, ")", 1))


def is_accessor(method: Column) -> Column:
    return F.startswith(method, F.lit("get_")) | F.startswith(method, F.lit("set_"))
