"""Column expressions: all JVM-side, no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Table-name prefixes of warehouse layers, tried in order.
LAYERS = (("ods_", "ods"), ("dwd_", "dwd"), ("d_", "dwd"), ("dws_", "dws"), ("ads_", "ads"), ("dim_", "dim"), ("tmp_", "tmp"), ("temp_", "tmp"))
CONFIDENCE = ("low", "medium", "high")


def layer_of(name: Column) -> Column:
    """Layer of a table name by its prefix, '' if none fits."""
    out = F.lit("")
    for prefix, layer in reversed(LAYERS):
        out = F.when(name.startswith(prefix), layer).otherwise(out)
    return out


def is_tmp(full_name: Column, layer: Column | None = None) -> Column:
    db, name = F.substring_index(full_name, ".", 1), F.substring_index(full_name, ".", -1)
    named = F.startswith(db, F.lit("tmp")) | name.startswith("tmp_") | name.startswith("temp_") | name.endswith("_tmp")
    return named if layer is None else named | (F.coalesce(layer, F.lit("")) == "tmp")


def masked(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text == "", "").otherwise(F.concat(F.substring(text, 1, 1), F.lit("***")))


def admission(name: Column, comment: Column, least: int = 4) -> Column:
    """Why a column's comment is not worth indexing; null admits it."""
    text = F.trim(F.coalesce(comment, F.lit("")))
    plain = lambda c: F.lower(F.translate(c, "_ -", ""))
    return F.when(text == "", "empty").when(F.char_length(text) < least, "too_short").when(plain(text) == plain(name), "no_increment")


def confidence_rank(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")).isin("", "high"), 2).when(value == "low", 0).otherwise(1)


def characters(text: Column) -> Column:
    return F.when(F.char_length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def similarity(a: Column, b: Column) -> Column:
    """200 * LCS / (length of both), the indel ratio in per cent; two empty strings are 100 alike. Both sides are short terms."""
    row = lambda prev, x: F.aggregate(
        F.sequence(F.lit(1), F.char_length(b)),
        F.array(F.lit(0)),
        lambda done, j: F.array_append(done, F.when(F.substring(b, j, F.lit(1)) == x, F.element_at(prev, j) + 1).otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(done, -1)))),
    )
    lcs = F.element_at(F.aggregate(characters(a), F.array_repeat(F.lit(0), F.char_length(b) + 1), row), -1)
    both = F.char_length(a) + F.char_length(b)
    some = (F.char_length(a) > 0) & (F.char_length(b) > 0)
    return F.when(both == 0, 100.0).when(~some, 0.0).otherwise(200.0 * lcs / both)


def grams(text: Column, n: int) -> Column:
    """All n-grams of characters, in order."""
    size = F.char_length(text) - (n - 1)
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def hashed_grams(text: Column) -> Column:
    """1-, 2- and 3-grams of the lower-cased text without white space."""
    plain = F.regexp_replace(F.lower(text), r"\s+", "")
    return F.concat(grams(plain, 1), grams(plain, 2), grams(plain, 3))


def bucket_of(gram: Column) -> Column:
    """Dimension and sign of a gram: the last byte of the first eight of its md5, and the parity of the byte before."""
    digest = F.md5(gram)
    return F.struct(F.conv(F.substring(digest, 15, 2), 16, 10).cast("int").alias("dim"), F.when(F.conv(F.substring(digest, 13, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1).alias("sign"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def squashed(text: Column) -> Column:
    """Upper case, white space and quoting gone: for comparing expression texts."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s`()]+", ""))
