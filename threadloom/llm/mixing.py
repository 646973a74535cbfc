"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Every source gets a target in words.  Its documents are put in a random but repeatable order
(md5 of id and text), range-partitioned by that key, and prefix sums of words over the ranges
say where the budget ends.  A source whose target exceeds its size is taken in whole epochs first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word: anything between ASCII white space
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Rows that one range of a source should hold on average
RANGE_ROWS = 2_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: tuple[int, int] = (3, 2), weights: tuple[int, ...] = WEIGHTS, most: int = 2) -> DataFrame:
    """From ``(src, source, source_size)`` the targets, by filling all sources to one level.

    Sources in code-point order (null last) weigh ``weights``, repeating; all targets sum to
    ``share`` of all words; none exceeds ``most`` times its source, the excess is reshared by
    weight.  That fixed point is a level L with target = min(cap, weight * L): a source is capped
    if filling everything to its own level does not use more than the budget.  One row per source.
    """
    up, down = share
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("below", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", (wide("below") * wide("weight") + wide("cap") * wide("rest")) * down <= wide("total") * wide("weight") * up)
        .withColumn("taken_caps", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole))
        .withColumn("open", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(whole))
    )
    left = (F.col("total") * up).cast("double") / F.lit(float(down)) - F.col("taken_caps").cast("double")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(left * F.col("weight") / F.col("open"))
    return filled.select("src", "source_size", target.alias("target"))


#: What ``mix`` adds
ADDED = ["mix_size", "mix_source_size", "mix_target", "mix_epochs", "mix_part"]


def mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", range_rows: int = RANGE_ROWS, **targets) -> DataFrame:
    """All rows of ``df`` with ``mix_size, mix_source_size, mix_target, mix_epochs, mix_part``.

    ``mix_epochs`` whole copies of the document are in the mix and then its first ``mix_part``
    words, which is the whole document, nothing, or at most one cut document per source.  Words
    taken of a source are floor(target) exactly.  Null, empty and blank texts have no words and are
    never taken, very long ones count whole; a null source is a source; repeated rows count each; an
    empty table gives no rows.  Columns of ``df`` keep their values whatever their names, but for
    those five.
    """
    own = [c for c in df.columns if c not in ADDED]
    digits = max(1, math.ceil(math.log(max(1, df.count() / range_rows), 16)))
    rows = df.select(
        *[F.col(f"`{c}`").alias(f"input{i}") for i, c in enumerate(own)],
        word_count(f"`{text}`").alias("size"),
        F.col(f"`{source}`").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`")), F.lit("n")).alias("src"),
        F.md5(F.concat_ws("|", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("binary")).alias("key"),
    ).withColumn("range", F.substring("key", 1, digits))
    ranges = rows.groupBy("src", "source", "range").agg(F.sum("size").alias("words")).withColumn("top", F.substring("range", 1, (digits + 1) // 2))
    # prefix sums of the ranges in two levels, so that no task sees all ranges of a source
    before = lambda *of: Window.partitionBy(*of).rowsBetween(Window.unboundedPreceding, -1)
    tops = ranges.groupBy("src", "source", "top").agg(F.sum("words").alias("top_words"))
    sizes = tops.groupBy("src", "source").agg(F.sum("top_words").alias("source_size"))
    tops = tops.select("src", "top", F.coalesce(F.sum("top_words").over(before("src").orderBy("top")), F.lit(0)).alias("top_before"))
    plan = (
        ranges.withColumn("inner_before", F.coalesce(F.sum("words").over(before("src", "top").orderBy("range")), F.lit(0)))
        .join(tops, ["src", "top"])
        .join(source_targets(sizes, **targets), "src")
        .select("src", "range", (F.col("top_before") + F.col("inner_before")).alias("before"), "source_size", "target")
    )
    inside = Window.partitionBy("src", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    cut = budget - F.col("epochs") * F.col("source_size") - (F.col("before") + F.col("run") - F.col("size"))
    placed = rows.drop("source").join(plan, ["src", "range"]).withColumn("run", F.sum("size").over(inside)).withColumn("epochs", epochs)
    part = F.greatest(F.lit(0).cast("long"), F.least("size", cut))
    return placed.select(*[F.col(f"input{i}").alias(c) for i, c in enumerate(own)], *[x.alias(c) for c, x in zip(ADDED, [F.col("size"), F.col("source_size"), F.col("target"), F.col("epochs"), part])])


def materialised(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: one row per copy of a document, a last copy cut where the budget ends."""
    own = [c for c in mixed.columns if c not in ADDED]
    copies = F.col("mix_epochs") + F.when(F.col("mix_part") > 0, 1).otherwise(0)
    rows = mixed.where(copies > 0).select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("input"), F.col(f"`{text}`").alias("text"), *ADDED, F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    some = (F.col("copy") == F.col("mix_epochs")) & (F.col("mix_part") < F.col("mix_size"))
    lead = r"regexp_extract(text, r'^[\x20\x09-\x0D]*', 0)"
    cut = F.expr(f"concat({lead}, array_join(slice(regexp_extract_all(text, r'({WORD}[\\x20\\x09-\\x0D]*)', 1), 1, cast(mix_part as int)), ''))")
    return rows.select(*[F.when(some, cut).otherwise(F.col("text")).alias(c) if c == text else F.col("input").getField(c).alias(c) for c in own])


#: The same mix for DuckDB
MIX_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS k
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source),
ranked AS (
  SELECT *, source_size * 2 AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sizes),
filled AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM ranked),
marked AS (SELECT *, (below::HUGEINT * weight + cap::HUGEINT * rest) * 2 <= total::HUGEINT * weight * 3 AS capped FROM filled),
aimed AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE
              ELSE ((total * 3)::DOUBLE / 2.0 - (sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE) * weight
                   / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()) END AS target
  FROM marked),
run AS (
  SELECT doc_id, source, size,
         sum(size) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before_
  FROM rows_)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END * size
        + greatest(0, least(size, floor(target) - CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END * source_size - before_)))::BIGINT AS taken
FROM run JOIN aimed ON run.source IS NOT DISTINCT FROM aimed.source
"""
