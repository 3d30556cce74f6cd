"""Simple type names, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blanks around a name.
BLANKS = " \t\r\n\u00a0"


def blank_free(name: Column) -> Column:
    """``name`` without any blanks (names hold none inside)."""
    return F.translate(name, BLANKS, "")


def simple_name(ref: Column) -> Column:
    """The simple name in a type reference: no namespace, ``global::``, type arguments, ``?`` or outer blanks.

    Null stays null; a reference without a name gives ''. Only substring functions, so it stays in generated code.
    """
    head = F.substring_index(ref, "<", 1)
    head = F.substring_index(F.substring_index(F.translate(head, "?" + BLANKS, ""), ".", -1), ":", -1)
    return head


def named(ref: Column) -> Column:
    """The simple name, or null where the reference names nothing."""
    return F.nullif(simple_name(ref), F.lit(""))
