"""JSON texts as variants, strictly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f) -> Column:
    """f of a value, which is evaluated once for a row, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def parse_json(text: Column) -> Column:
    """The variant of a text that is one JSON value, else null.

    The parser stops at the end of the first value; inside a list it has to meet the list's end.
    """
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return once(items, lambda x: F.when((F.size(x) == 1) & (F.trim(text) != ""), F.get(x, 0)))


def path(v: Column, where: str, kind: str = "variant") -> Column:
    """Value at a dotted path with list places, as 'a.b.0.c'; null where it ends early."""
    steps = "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in where.split("."))
    return F.try_variant_get(v, f"${steps}", kind)


def non_empty(v: Column) -> Column:
    """False for null, empty text, empty list and empty object; true for any other value."""

    def none(x: Column) -> Column:
        text = F.try_variant_get(x, "$", "string")
        return once(text, lambda t: t.isNull() | t.isin("", "[]", "{}"))

    return ~F.coalesce(once(v, lambda x: x.isNull() | none(x)), F.lit(True))


def strict_true(v: Column) -> Column:
    return F.coalesce((F.schema_of_variant(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean"), F.lit(False))


def member_set(v: Column) -> Column:
    """Distinct part ids of a list; null if any element is no id."""
    from .text import part_id

    ids = F.transform(F.try_variant_get(v, "$", "array<variant>"), part_id)
    return F.when(F.forall(ids, lambda x: x.isNotNull()), F.array_distinct(ids))


def object_level(v: Column) -> Column:
    """The ``object_level`` object of an annotation that wraps one, else the annotation itself."""
    inner = F.try_variant_get(v, "$.object_level", "variant")
    return F.when(F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False)), inner).otherwise(v)


def media_list(v: Column) -> Column:
    """Paths of a media field that is one path, a list, or a list of lists; null elements and empty paths are left out."""
    one = F.when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string")))
    listed = F.try_variant_get(v, "$", "array<variant>")

    def inner(x: Column) -> Column:
        few = F.when(F.schema_of_variant(x) == "STRING", F.array(F.try_variant_get(x, "$", "string")))
        return F.coalesce(few, F.try_variant_get(x, "$", "array<string>"), F.array().cast("array<string>"))

    flat = F.coalesce(one, F.flatten(F.transform(listed, inner)), F.array().cast("array<string>"))
    return F.filter(flat, lambda p: p.isNotNull() & (p != ""))
