"""Write semantics on plain tables: upsert, snapshot replacement, scoped delete and reinsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], keep: str | None = None) -> DataFrame:
    """``existing`` with the rows of ``new`` put in their place; ``keep`` retains an old column's value.

    Of rows of ``new`` that repeat a key the greatest by its other columns is taken, so reruns agree.
    """
    rest = [c for c in new.columns if c not in keys and not new.schema[c].dataType.typeName() == "map"]
    if rest:
        ordered = len(rest) == len(new.columns) - len(keys)  # maps have no order
        new = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("taken")).select(*keys, "taken.*") if ordered else new.dropDuplicates(keys)
    if keep:
        old = existing.select(*keys, F.col(keep).alias("old_value"))
        new = new.join(old, keys, "left").withColumn(keep, F.coalesce("old_value", keep)).drop("old_value")
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*existing.columns))


def replace_scoped(existing: DataFrame, new: DataFrame, key: str, cites: str, processed: DataFrame) -> DataFrame:
    """Drop rows of ``existing`` that cite anything in ``processed`` (cite), then add ``new``."""
    hit = existing.select(key, F.explode(cites).alias("cite")).join(processed, "cite", "left_semi").select(key).distinct()
    return existing.join(hit, key, "left_anti").unionByName(new)


def removed_keys(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return existing.select(*keys).join(new.select(*keys), keys, "left_anti")
