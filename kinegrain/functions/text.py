"""Strings and JSON of annotations, prompts and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsonv import parse_json

# Tags around JSON in model answers, and spellings of tasks.
BEGIN_TAG, END_TAG = "===BEGIN_JSON===", "===END_JSON==="
FLOAT = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def tagged_json(text: Column) -> Column:
    """The JSON text between the tags that parses, else null."""
    found = F.regexp_extract(text, rf"(?s){BEGIN_TAG}\s*(.*?)\s*{END_TAG}", 1)
    return F.when(parse_json(found).isNotNull(), found)


def strip_fences(text: Column) -> Column:
    """Text without a ```json fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def outer_braces(text: Column) -> Column:
    """From the first { to the last }, if that parses as JSON."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(parse_json(found).isNotNull(), found)


def vector_text(text: Column) -> Column:
    """Exactly three numbers of a text as an array."""
    found = F.regexp_extract_all(text, F.lit(f"({FLOAT})"), F.lit(1))
    return F.when(F.size(found) == 3, F.transform(found, lambda x: x.try_cast("double")))


def first_number(text: Column) -> Column:
    """'7.8 g/cm^3' is 7.8."""
    return F.nullif(F.regexp_extract(text, f"({FLOAT})", 1), F.lit("")).try_cast("double")


def dimension_text(text: Column) -> Column:
    """'20*3*2 cm' is [20, 3, 2]."""
    head = F.split(F.trim(text), r"\s+")[0]
    return F.transform(F.split(head, r"\*"), lambda x: x.try_cast("double"))


def range_text(text: Column) -> Column:
    """'0-180 degrees' is [0, 180]; bounds may be signed."""
    low = F.regexp_extract(text, rf"^\s*({FLOAT})\s*(?:-|to|~)\s*({FLOAT})", 1)
    high = F.regexp_extract(text, rf"^\s*({FLOAT})\s*(?:-|to|~)\s*({FLOAT})", 2)
    return F.when(low != "", F.array(low.try_cast("double"), high.try_cast("double")))


def movement_group(text: Column) -> Column:
    """'3-1' is [1, 3]."""
    return F.array_sort(F.transform(F.split(text, "-"), lambda x: F.trim(x).try_cast("int")))


def material_head(text: Column) -> Column:
    """What stands before the first slash, folded; null if blank."""
    return F.nullif(F.replace(F.lower(F.trim(F.split_part(text, F.lit("/"), F.lit(1)))), F.lit("ß"), F.lit("ss")), F.lit(""))


def same_category(a: Column, b: Column) -> Column:
    fold = lambda x: F.replace(F.lower(F.trim(x)), F.lit("ß"), F.lit("ss"))
    return fold(a) == fold(b)


def part_id(v: Column) -> Column:
    """A variant as a part's id: whole numbers and non-blank strings."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    number = text.try_cast("double")
    whole = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & (number == F.floor(number))
    return F.when(whole, number.try_cast("long").cast("string")).when((kind == "STRING") & (F.trim(text) != ""), F.trim(text))


def sample_id(explicit: Column, kind: Column, entity: Column, label: Column, position: Column) -> Column:
    full = F.when(kind.isNotNull() & entity.isNotNull() & label.isNotNull(), F.concat_ws("-", kind, entity, label))
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), full, F.format_string("sample-%06d", position))


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def safe_filename(text: Column, default: str = "sample") -> Column:
    clean = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(default))


def media_path(path: Column, base: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def view_image(path: Column) -> Column:
    """The rendered view that belongs to a mesh or point file."""
    return F.regexp_replace(path, r"([^/]+?)(?:\.[^./]+)?$", "$1_ori_0.png")


def truth(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "yes", "1", "on", "y", "t")


def csv_items(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def version(text: Column, name: str = "Blender") -> Column:
    """Major, minor and patch number after a name."""
    return F.transform(F.array(*[F.regexp_extract(text, rf"{name} (\d+)\.(\d+)\.(\d+)", k) for k in (1, 2, 3)]), lambda x: x.try_cast("int"))


def fill_slots(template: Column, **values: Column) -> Column:
    """{{name}} replaced by a value, for every name."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value)
    return template


def count_of(text: Column, placeholder: str) -> Column:
    """How often a placeholder stands in a text."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(placeholder), F.lit("")))) / len(placeholder)).cast("long")


def clock(seconds: Column) -> Column:
    """Seconds as h:mm:ss."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON in the order of their names."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def edge_label(kind: Column, lo: Column, hi: Column, damping: Column) -> Column:
    return F.concat_ws("|", kind, F.concat_ws(",", lo.cast("string"), hi.cast("string")), damping.cast("string"))


def edge_fields(label: Column) -> Column:
    p = F.split(label, r"\|")
    r = F.split(F.get(p, 1), ",")
    return F.struct(
        F.get(p, 0).alias("kind"), F.get(r, 0).try_cast("double").alias("lo"), F.get(r, 1).try_cast("double").alias("hi"), F.get(p, 2).try_cast("double").alias("damping")
    )


def rounded_text(x: Column, places: int = 4) -> Column:
    return F.call_function("format_number", x, F.lit("0." + "0" * places))


def utc_text(at: Column) -> Column:
    """ISO-8601 text of a timestamp in UTC with microseconds, whatever the session's time zone."""
    utc = F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
