"""Column functions over page evidence: structured data, headings, indexability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import utrim

# First words of a question.
QUESTION_STARTERS = [
    "what", "how", "why", "when", "where", "who", "which", "is", "are", "can", "do", "does", "should",
    "چیست", "چی", "چه", "چگونه", "چطور", "چرا", "کی", "کجا", "کدام", "آیا", "چند",
]
# Structured data types that name an entity.
ENTITY_TYPES = ["Organization", "Article", "Product", "Person", "LocalBusiness", "NewsArticle", "BlogPosting"]
#: Levels of strings, arrays and graphs that are opened.
DEPTH = 16


def is_indexable(status: Column, robots_meta: Column, x_robots: Column) -> Column:
    """Status 200 and no noindex in the page or its header."""
    barred = F.lower(F.concat_ws(" ", robots_meta, x_robots)).contains("noindex")
    return F.coalesce((status == 200) & ~barred, F.lit(False))


def question_heading(headings: Column) -> Column:
    """Whether a heading asks: it ends with a question mark or begins with a question word."""

    def asks(text: Column) -> Column:
        clean = utrim(text)
        return clean.rlike("[?؟]$") | F.lower(F.substring_index(clean, " ", 1)).isin(QUESTION_STARTERS)

    return F.coalesce(F.exists(headings, lambda h: F.coalesce(asks(h["text"]), F.lit(False))), F.lit(False))


STRUCTURED = T.StructType().add("types", T.ArrayType(T.StringType())).add("dated", T.BooleanType()).add("valid", T.BooleanType())
_DATED = ("author", "datePublished", "dateModified")


def _typed(values: Column) -> Column:
    """Variants with their kinds: OBJECT, ARRAY, STRING, VOID or another type, BAD for what is no JSON."""
    return F.transform(values, lambda v: F.struct(v.alias("v"), F.coalesce(_kind(v), F.lit("BAD")).alias("kind")))


def _kind(value: Column) -> Column:
    return F.substring_index(F.schema_of_variant(value), "<", 1)


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, F.lit(path), kind)


def _inside(values: Column) -> Column:
    """What arrays, graphs and strings hold, one level down."""
    opened = lambda x: (
        F.when(x["kind"] == "ARRAY", _at(x["v"], "$", "array<variant>"))
        .when(x["kind"] == "STRING", F.array(F.try_parse_json(_at(x["v"], "$", "string"))))
        .when((x["kind"] == "OBJECT") & _at(x["v"], "$.@graph").isNotNull(), F.array(_at(x["v"], "$.@graph")))
        .otherwise(F.array().cast("array<variant>"))
    )
    return _typed(F.flatten(F.transform(values, opened)))


def _types(item: Column) -> Column:
    """Texts of an object's ``@type``, one or several."""
    found = _at(item["v"], "$.@type")
    text = lambda v: _at(v, "$", "string")
    many = F.transform(F.filter(_at(found, "$", "array<variant>"), lambda v: _kind(v) == "STRING"), text)
    return F.when(_kind(found) == "STRING", F.array(text(found))).when(_kind(found) == "ARRAY", many).otherwise(F.array().cast("array<string>"))


def _judged(levels: Column) -> Column:
    """The result over the values found; what is left in front lies too deep to be read."""
    objects = F.filter(levels["found"], lambda x: x["kind"] == "OBJECT")
    valid = ~F.exists(levels["found"], lambda x: ~x["kind"].isin("OBJECT", "ARRAY", "STRING")) & (F.size(levels["front"]) == 0)
    has = lambda x, name: F.coalesce(_kind(_at(x["v"], f"$.{name}")) != "VOID", F.lit(False))
    dated = F.exists(objects, lambda x: has(x, _DATED[0]) | has(x, _DATED[1]) | has(x, _DATED[2]))
    return F.struct(F.flatten(F.transform(objects, _types)).alias("types"), dated.alias("dated"), valid.alias("valid")).cast(STRUCTURED)


def structured_data(blocks: Column) -> Column:
    """Struct of all values of ``@type``, whether an object names an author or a date, and whether all blocks could be read.

    Blocks are variants; arrays, graphs and JSON inside strings are opened level
    by level, a block being the first of ``DEPTH`` levels.  Types come level by level.
    """
    own = F.coalesce(blocks, F.array().cast("array<string>"))
    first = _typed(F.transform(own, lambda b: F.try_parse_json(b)))
    start = F.struct(F.array().cast("array<struct<v:variant,kind:string>>").alias("found"), first.alias("front"))
    opened = lambda levels, _: F.struct(F.concat(levels["found"], levels["front"]).alias("found"), _inside(levels["front"]).alias("front"))
    return F.aggregate(F.sequence(F.lit(2), F.lit(DEPTH)), start, opened, _judged)


def schema_types(blocks: Column) -> Column:
    """Values of ``@type`` over all objects, one or several each."""
    return structured_data(blocks)["types"]


def is_json(block: Column) -> Column:
    return F.try_parse_json(block).isNotNull()


def has_type(types: Column, wanted: list[str]) -> Column:
    lowered = [w.lower() for w in wanted]
    return F.exists(types, lambda t: F.lower(t).isin(lowered))
