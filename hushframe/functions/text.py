"""Replacing entities in free text, restoring them, and reading answers out of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

TOKEN = r"tok_[a-z_]+_[0-9a-f]{32}"
ANSWER = StructType([StructField("technique", StringType()), StructField("severity", StringType()), StructField("actions", ArrayType(StringType())), StructField("relationships", ArrayType(StringType()))])


def pair(raw: Column, out: Column) -> Column:
    return F.struct(raw.alias("k"), out.alias("v"))


def by_length(pairs: Column) -> Column:
    """Pairs with a non-empty key, the longest key in bytes first; the first declared stays first among equals."""
    numbered = F.transform(F.filter(pairs, lambda r: F.coalesce(r["k"] != "", F.lit(False))), lambda r, i: F.struct((-F.octet_length(r["k"])).alias("n"), i.alias("i"), r["k"].alias("k"), r["v"].alias("v")))
    return F.transform(F.array_sort(numbered), lambda r: F.struct(r["k"].alias("k"), r["v"].alias("v")))


def replace_entities(text: Column, pairs: Column) -> Column:
    """One pass from left to right: at each place the longest key that stands there is replaced by its value, and what was put in is not looked at again. pairs: an array of pair()."""
    return replace_ordered(text, by_length(pairs))


def replace_ordered(text: Column, ordered: Column) -> Column:
    """replace_entities with pairs that are ordered already. Where several columns of a row are searched, order the pairs in a column of their own first."""
    pattern = F.array_join(F.transform(ordered, lambda r: F.concat(F.lit("\\Q"), F.replace(r["k"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), "|")
    between, met = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    put = F.zip_with(between, met, lambda b, m: F.concat(b, F.coalesce(F.get(F.filter(ordered, lambda r: r["k"] == m), F.lit(0))["v"], F.lit(""))))
    return F.when(F.size(ordered) == 0, text).otherwise(F.array_join(put, ""))


def restore(text: Column, pairs: Column) -> Column:
    """Tokens back to raw values: replaced one after the other, the longest token first, then by token. pairs: an array of (token, raw) as pair()."""
    ordered = F.array_sort(F.transform(pairs, lambda r: F.struct((-F.octet_length(r["k"])).alias("n"), r["k"].alias("k"), r["v"].alias("v"))))
    return F.aggregate(ordered, text, lambda t, r: F.replace(t, r["k"], r["v"]))


def tokens_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def answer(text: Column) -> Column:
    """An answer from a model's text: fences are taken off, then the whole is read as JSON, else what stands from the first { to the last }. Null unless all four fields are there."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?|```\z", ""))

    def read(t: Column) -> Column:
        found = F.from_json(t, ANSWER)
        return F.when(found["technique"].isNotNull() & found["severity"].isNotNull() & found["actions"].isNotNull() & found["relationships"].isNotNull(), found)

    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.coalesce(read(bare), read(F.when(inner != "", inner)))


def at_path(text: Column, path: str, kind: str = "string") -> Column:
    """A value inside JSON text, null where there is none."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def jaccard(a: Column, b: Column) -> Column:
    """Common through all elements; two empty sets are equal, so 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
