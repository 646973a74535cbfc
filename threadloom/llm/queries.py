"""Registered queries of this subpackage: thin wrappers that apply an operator to a whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bitsliced, bpe, jaccard, langid, leaks, licences, linededup, mixing, periodic, quality, sharding, spelling, suffixes
from .common import fold


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), quality.score(net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "leak.item_id", "leak.distance", "leak.similarity", "leak.word")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("ld_lines").cast("long").alias("n_lines"), F.col("ld_removed").cast("long").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.explode(licences.scan(licences.fit(docs))).alias("found"))
    return found.select("doc_id", "found.paragraph", "found.family", "found.probability", "found.similarity", "found.start", "found.end")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predicted(docs.select("doc_id", "text"), langid.fit(docs, whole=True))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.accepted").alias("accepted"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(bitsliced.usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), bitsliced.quantised(F.col("embedding")).alias("v"))
    return bitsliced.top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    docs = table(spark, sf_dir, "documents").withColumn("size", (F.length(text) + 16).cast("long")).withColumn("text_crc32", F.crc32(text))
    return sharding.shard(docs, 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("sd_bytes").alias("n_bytes"), F.col("sd_removed").alias("n_removed"), F.col("sd_spans").alias("n_spans"), F.sha2("sd_kept", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    taken = F.col("mix_epochs") * F.col("mix_size") + F.col("mix_part")
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    trip = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip(vocabulary).alias("trip")).select("doc_id", "trip.packed", "trip.decoded")
    n_tokens = F.expr("octet_length(packed) div 4").cast("long").alias("n_tokens")
    return trip.select("doc_id", n_tokens, F.sha2("packed", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten repeats words of its own from some place on."""
    docs = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    docs = docs.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    docs = docs.withColumn("n", F.when(F.size("w") > 0, F.size("w"))).withColumn("g", F.expr("h div 10"))
    docs = docs.withColumn("a", F.col("g") % F.col("n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return docs.select("doc_id", F.when(F.col("n").isNotNull(), F.concat_ws(" ", again)).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_periods(table(spark, sf_dir, "documents")).select("doc_id", periodic.periodic_runs().alias("found")).select("doc_id", "found.runs", "found.collapsed")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = found.withColumn("best", best).withColumn("listed", F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def mistyped(doc_id: str, word: str) -> str:
    """The word without one letter in one of 199 cases."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 199:
        return word
    return word[: h % len(word)] + word[h % len(word) + 1 :]


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.word_counts(table(spark, sf_dir, "documents"), key="doc_id", rewrite=mistyped)
    return spelling.variants(counts).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_top_k": bitsliced.TOP_K_SQL, "op9_mixing": mixing.MIX_SQL, "op12_periodic_runs": periodic.RUNS_SQL, "op13_spelling_variants": spelling.VARIANTS_SQL}
