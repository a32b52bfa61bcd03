"""Nested documents: any depth of objects and lists as rows of paths, by ``VARIANT``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels after which a document is taken for damaged.
DEEPEST = 64
COVER = "covr"


def leaves(df: DataFrame, ident: str, document: str) -> DataFrame:
    """``id, path, value``: every plain value of a JSON document with the names and places (from 0) that lead to it, separated by ``/``.

    ``/`` in a name is ``~1`` and ``~`` is ``~0``.  Objects named ``covr``, in any case, and all below go.  Byte wrappers
    (``b'...'``) of values and names are taken off.  Null values have a row; damaged documents and empty objects have none.
    A round opens one level of all documents, so there are as many rounds as levels.
    """
    spark = df.sparkSession
    unwrapped = lambda c: F.regexp_replace(c, r"(?s)^b(['\"])(.*)\1$", "$2")
    escaped = lambda c: F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    rows = df.select(F.col(ident).alias("id"), F.lit("").alias("path"), F.try_parse_json(document).alias("v")).where("v is not null")
    out = None
    for _ in range(DEEPEST):
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT<") | kind.startswith("ARRAY<")
        plain = rows.where(~nested).select("id", "path", unwrapped(F.try_variant_get("v", "$", "string")).alias("value"))
        out = plain if out is None else out.unionByName(plain)
        deeper = rows.where(nested)
        if deeper.isEmpty():
            return out
        opened = deeper.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        name = F.coalesce(unwrapped(F.col("key")), F.col("pos").cast("string"))
        rows = opened.where(F.lower(name) != COVER).select("id", F.concat_ws("/", F.nullif("path", F.lit("")), escaped(name)).alias("path"), F.col("value").alias("v"))
    raise ValueError(f"documents of more than {DEEPEST} levels")


def tag_maps(df: DataFrame, ident: str, document: str) -> DataFrame:
    """``id, tags``: the leaves of a document as one map of paths; where wrappers made two paths equal the greater value stays."""
    once = leaves(df, ident, document).groupBy("id", "path").agg(F.max("value").alias("value"))
    return once.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "value")))).alias("tags"))
