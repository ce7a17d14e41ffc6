"""Reading line items kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "struct<description:string,unit:string,qty:decimal(18,4),rate:decimal(18,4),cost_price:decimal(18,4)>"


def elements(text: Column) -> Column:
    """The elements of a JSON array as JSON texts; null where the text is no array, or has more than the array.

    Read as a field of an object, so that what follows the array makes the whole unreadable."""
    whole = F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "x array<string>", {"allowSingleQuotes": "false"})
    return whole["x"]


def items(text: Column) -> Column:
    """array<struct> of the elements that are objects; numbers may be texts, what can't be read is null. Never null."""
    objects = F.filter(F.coalesce(elements(text), F.array().cast("array<string>")), lambda x: F.ltrim(x).startswith("{"))
    field = lambda x, name: F.get_json_object(x, f"$.{name}")
    number = lambda x, name: F.replace(field(x, name), F.lit(","), F.lit("")).try_cast("decimal(18,4)").alias(name)
    return F.transform(objects, lambda x: F.struct(field(x, "description").alias("description"), field(x, "unit").alias("unit"), number(x, "qty"), number(x, "rate"), number(x, "cost_price")))


def to_text(array: Column) -> Column:
    return F.to_json(array)
