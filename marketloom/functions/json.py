"""JSON helpers: tolerant parsing, tree flattening and content hashes."""
from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F


def parse_or(text: Column, schema: str, fallback: Column) -> Column:
    """Parse JSON by schema; the fallback where the text is not valid JSON."""
    return F.coalesce(F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema)), fallback)


def flatten_tree(df: DataFrame, keys: list[str], text: str, depth: int) -> DataFrame:
    """(keys, path, leaf) rows of JSON documents of any depth, scalars as text.

    One explode per level over VARIANT values; leaves found at a level leave the loop. The first ``depth``
    levels are planned without a look at the data; from then on a level is added while any value is nested.
    """
    level = df.select(*keys, F.lit("$").alias("path"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL")
    leaves = None
    for at in itertools.count():
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        here = level.where(~nested).select(*keys, "path", F.expr("CAST(v AS STRING)").alias("leaf"))
        leaves = here if leaves is None else leaves.unionByName(here)
        inner = level.where(nested)
        if at >= depth and inner.isEmpty():
            return leaves
        t = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("v").outer()).alias("e"))
        level = t.select(*[F.col(k) for k in keys], F.when(F.col("e.key").isNotNull(), F.concat("path", F.lit("."), F.col("e.key"))).otherwise(
            F.concat("path", F.lit("["), F.col("e.pos").cast("string"), F.lit("]"))).alias("path"), F.col("e.value").alias("v"))


def material_hash(df: DataFrame, keys: list[str], text: str, volatile: tuple[str, ...], depth: int) -> DataFrame:
    """sha256 of a document's sorted leaves without its volatile fields: equal content, equal hash."""
    name = F.regexp_extract("path", r"([^.\[\]]+)(\[\d+\])*$", 1)
    rows = flatten_tree(df, keys, text, depth).where(~name.isin(*volatile))
    line = F.concat_ws("=", "path", F.coalesce("leaf", F.lit("null")))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("hash"))
