"""Columns about text and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN, LONGEST = r"[\p{L}\p{N}]+", 40


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits shorter than 40 bytes; none of a null text."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: F.octet_length(t) < LONGEST)


def lexical_text(content: Column, path: Column, symbols: Column, calls: Column) -> Column:
    """What the lexical index sees of a chunk: content, path, symbols and calls, joined by spaces."""
    return F.concat_ws(" ", content, path, F.array_join(symbols, " "), F.array_join(calls, " "))


def field(json: Column, name: str) -> Column:
    """A field of a JSON text, empty where missing."""
    return F.coalesce(F.get_json_object(json, f"$.{name}"), F.lit(""))


def split_list(text: Column) -> Column:
    """Trimmed parts of a comma list without the empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")


def utf8_lossy(data: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(data.cast("string"))


def with_prefix(text: Column, prefix: str) -> Column:
    """The text after a model's prefix, which is not repeated."""
    return F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text))


def summary(text: Column, most: int = 200) -> Column:
    """The first sentence or line of a text, cut at ``most`` characters: the summariser used where no model is given."""
    return F.substring(F.trim(F.regexp_extract(text, r"^\s*([^.!?\n]+[.!?]?)", 1)), 1, most)
