"""Quality reports: counts, rates by class, agreement of clusterings, rank metrics, checks against targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Fewer rows than the first make a rate unreliable, fewer than the second weak
FEW, SOME = 10, 20


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Number of rows for each value of the keys; null is a value."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def global_counts(messages: DataFrame, **others: DataFrame) -> DataFrame:
    """One row: messages, noisy ones, threads, synthetic ids and the row counts of other tables."""
    out = messages.agg(
        F.count("*").alias("messages"),
        F.count_if("noise").alias("noise"),
        F.count_distinct("thread_id").alias("threads"),
        F.count_if(F.col("message_id").cast("string").startswith("synthetic:")).alias("synthetic"),
    )
    for name, rows in others.items():
        out = out.join(F.broadcast(rows.agg(F.count("*").alias(name))), how="cross")  # one row each
    return out


def top_values(rows: DataFrame, key: str, most: int = 25) -> DataFrame:
    """The ``most`` values of a column with the most rows, ties to smaller values."""
    return counts_by(rows.where(F.col(key).isNotNull()), key).orderBy(F.desc("n"), key).limit(most)


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges over all possible edges of the nodes, six places; zero below two nodes."""
    both = edges.agg(F.count("*").alias("edges")).join(F.broadcast(nodes.agg(F.count("*").alias("nodes"))), how="cross")
    possible = F.col("nodes") * (F.col("nodes") - 1) / 2
    return both.withColumn("density", F.round(F.coalesce(F.try_divide(F.col("edges"), possible), F.lit(0.0)), 6))


def many_identities(identities: DataFrame, more_than: int = 3, most: int = 10) -> DataFrame:
    """People with more than so many addresses (person_id, email)."""
    found = identities.groupBy("person_id").agg(F.count_distinct("email").alias("identities")).where(F.col("identities") > more_than)
    return found.orderBy(F.desc("identities"), "person_id").limit(most)


def duplicate_names(people: DataFrame) -> DataFrame:
    """Normalised names that several people have (person_id, name), with the sorted people."""
    named = people.select("person_id", F.lower(F.trim(F.regexp_replace("name", r"\s+", " "))).alias("name")).where("name <> ''").distinct()
    return named.groupBy("name").agg(F.sort_array(F.collect_set("person_id")).alias("people")).where(F.size("people") > 1)


def weight_by_role(edges: DataFrame) -> DataFrame:
    """Count, mean and sum of the edge weights of each role."""
    return edges.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 4).alias("mean_weight"), F.round(F.sum("weight"), 4).alias("total_weight"))


def rates(hits: Column, misses: Column) -> Column:
    return F.round(F.try_divide(hits, hits + misses), 6)


def reliability(n: Column) -> Column:
    """``low`` for few rows, ``weak`` for some, ``ok`` otherwise."""
    return F.when(n < FEW, "low").when(n < SOME, "weak").otherwise("ok")


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall and false-positive rate of ``predicted`` against ``truth``, and how far to trust them."""
    cell = lambda p, t: F.count_if((F.col("predicted") == p) & (F.col("truth") == t))
    out = rows.groupBy(*keys).agg(cell(True, True).alias("tp"), cell(True, False).alias("fp"), cell(False, True).alias("fn"), cell(False, False).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select("*", rates(tp, fp).alias("precision"), rates(tp, fn).alias("recall"), rates(fp, tn).alias("fpr"), reliability(tp + fp).alias("precision_trust"), reliability(tp + fn).alias("recall_trust"))


def class_rates(rows: DataFrame, classes: list[str]) -> DataFrame:
    """``confusion`` of each class of array columns ``predicted_tags`` and ``true_tags``."""
    each = rows.select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"), "predicted_tags", "true_tags")
    told = each.select("class", F.array_contains("predicted_tags", F.col("class")).alias("predicted"), F.array_contains("true_tags", F.col("class")).alias("truth"))
    return confusion(told, "class")


def false_rate(rows: DataFrame, flag: str, truth: str, key: str) -> DataFrame:
    """For each key the share of rows with ``flag`` among those whose ``truth`` is false."""
    clean = rows.where(~F.col(truth))
    return clean.groupBy(key).agg(F.count("*").alias("clean"), F.count_if(flag).alias("flagged")).withColumn("rate", F.round(F.col("flagged") / F.col("clean"), 6))


def checked(metrics: DataFrame, targets: dict[str, tuple[str, float, bool]]) -> DataFrame:
    """(metric, value) against targets: metric -> (``least`` or ``most``, bound, hard); missing metrics fail hard ones."""
    spark = metrics.sparkSession
    wanted = spark.createDataFrame([(k, d, b, h) for k, (d, b, h) in targets.items()], "metric string, direction string, bound double, hard boolean")
    met = F.when(F.col("direction") == "least", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    status = F.when(met, "pass").when(F.col("value").isNull() & ~F.col("hard"), "no_data").when(F.col("hard"), "fail").otherwise("miss")
    return F.broadcast(wanted).join(metrics, "metric", "left").withColumn("status", status)


def worst_of(statuses: DataFrame, order: list[str]) -> DataFrame:
    """The status of each key that comes last in ``order`` (key, status); unknown ones count as worst."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in order]), F.col("status")), F.lit(0)), F.lit(len(order) + 1))
    return statuses.groupBy("key").agg(F.max_by("status", rank).alias("overall"))


def rank_metrics(results: DataFrame) -> DataFrame:
    """Mean reciprocal rank and top-1 precision over cases (case_id, rank, relevant); cases without a hit count 0."""
    best = results.groupBy("case_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    gain = F.coalesce(1 / F.col("first"), F.lit(0.0))
    return best.agg(F.count("*").alias("cases"), F.round(F.avg(gain), 6).alias("mrr"), F.round(F.avg((F.coalesce("first", F.lit(0)) == 1).cast("double")), 6).alias("top1"))


def signatures(found: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items with the same clusters in both clusterings (item, cluster) as one row.

    Returns (sig, n, x, y) - the smallest item as the name, the number of items, their clusters in
    either - and the clusters (sig, cluster) of the names in each clustering.  Sets of clusters are
    told apart by two 64-bit sums of hashes each, so no set is gathered.  Repeated rows count once,
    rows with a null are left out, an item of one clustering alone has no clusters in the other.
    """

    def sums(rows: DataFrame, name: str) -> DataFrame:
        hashes = [F.bit_xor(F.xxhash64("cluster", F.lit(i))).alias(f"{name}{i}") for i in range(2)]
        return rows.groupBy("item").agg(F.count("*").alias(name), *hashes)

    found, gold = (rows.select("item", "cluster").where("item is not null and cluster is not null").distinct() for rows in (found, gold))
    items = sums(found, "x").join(sums(gold, "y"), "item", "full").na.fill(0)
    grouped = items.groupBy("x", "x0", "x1", "y", "y0", "y1").agg(F.count("*").alias("n"), F.min("item").alias("sig"))
    sigs = staged(grouped.select("sig", "n", "x", "y"), "signatures")
    named = lambda rows: rows.withColumnRenamed("item", "sig").join(sigs.select("sig"), "sig", "left_semi")
    return sigs, named(found), named(gold)


def signature_pairs(found: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signatures and the pairs (a, b, x, y) of different ones that share x and y clusters, x + y > 0."""
    from .relations import copresence

    sigs, of_found, of_gold = signatures(found, gold)
    shared = lambda rows, name: copresence(rows.select(F.col("cluster").alias("group_id"), F.col("sig").alias("member"))).withColumnRenamed("shared", name)
    return sigs, shared(of_found, "x").join(shared(of_gold, "y"), ["a", "b"], "full").na.fill(0, ["x", "y"])


def both_pairs(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(x, y, n): number of pairs of items that share x clusters of ``found`` and y of ``gold``, pairs of neither left out.

    Pairs of signatures are weighed with the numbers of their items, so a cluster of n alike items is
    one row and not n^2.
    """
    sigs, pairs = signature_pairs(found, gold)
    size = lambda c: sigs.select(F.col("sig").alias(c), F.col("n").alias(f"n_{c}"))
    across = pairs.join(size("a"), "a").join(size("b"), "b").select("x", "y", (F.col("n_a") * F.col("n_b")).alias("n"))
    within = sigs.where("n > 1").select("x", "y", F.expr("n * (n - 1) div 2").alias("n"))
    return across.unionByName(within).groupBy("x", "y").agg(F.sum("n").alias("n"))


def extended_bcubed(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Extended BCubed precision, recall and F1 of two overlapping clusterings (item, cluster).

    For each item the mean, over the items (itself too) that share a cluster with it, of the smaller
    number of shared clusters over its own side's; then the mean over all items.  An item without a
    cluster counts 0; no items give no scores but 0.
    """
    sigs, pairs = signature_pairs(found, gold)
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "x", "y"))
    ways = ways.unionByName(sigs.select(F.col("sig").alias("a"), F.col("sig").alias("b"), "x", "y"))
    met = ways.join(sigs.select(F.col("sig").alias("b"), "n"), "b")
    less = F.least("x", "y")
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.when(F.col(c) > 0, F.col("n") * less / F.col(c))), F.sum(F.when(F.col(c) > 0, F.col("n")))), F.lit(0.0))
    each = met.groupBy("a").agg(mean("x").alias("p"), mean("y").alias("r"))
    share = lambda c: F.coalesce(F.try_divide(F.sum(F.col("n") * F.col(c)), F.sum("n")), F.lit(0.0))
    out = sigs.join(each.withColumnRenamed("a", "sig"), "sig").agg(share("p").alias("p"), share("r").alias("r"))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return out.select(F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def pairwise_f1(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and F1 over the pairs of items that share a cluster."""
    cell = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    t = both_pairs(found, gold).agg(cell((F.col("x") > 0) & (F.col("y") > 0)).alias("tp"), cell(F.col("y") == 0).alias("fp"), cell(F.col("x") == 0).alias("fn"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return t.select("tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def omega_index(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Omega index: agreement on how many clusters each pair of items shares, corrected for chance.

    Fewer than two items, or agreement that chance alone would give in full, count as 1.
    """
    items = found.select("item").union(gold.select("item")).distinct().agg(F.count("*").alias("items"))
    table = both_pairs(found, gold)
    all_pairs = (F.col("items") * (F.col("items") - 1) / 2).cast("double")
    zero = F.col("all") - F.col("some")
    total = table.agg(F.sum("n").alias("some")).join(F.broadcast(items), how="cross").select(all_pairs.alias("all"), F.coalesce("some", F.lit(0)).alias("some"))
    same = table.agg(F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n"))), F.lit(0)).alias("same"))
    side = lambda c: table.where(F.col(c) > 0).groupBy(F.col(c).alias("k")).agg(F.sum("n").alias(c))
    hist = side("x").join(side("y"), "k", "full").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("cross"), F.coalesce(F.sum("x"), F.lit(0)).alias("xs"), F.coalesce(F.sum("y"), F.lit(0)).alias("ys"))
    row = total.join(F.broadcast(same), how="cross").join(F.broadcast(hist), how="cross")
    seen = F.try_divide(F.col("same") + zero, F.col("all"))
    by_chance = F.try_divide(F.col("cross") + (F.col("all") - F.col("xs")) * (F.col("all") - F.col("ys")), F.col("all") * F.col("all"))
    return row.select(F.round(F.coalesce(F.try_divide(seen - by_chance, 1 - by_chance), F.lit(1.0)), 6).alias("omega"))


def next_versions(packages: DataFrame) -> DataFrame:
    """The version after the last one of each lineage (lineage, version)."""
    return packages.groupBy("lineage").agg((F.max("version") + 1).alias("next_version"))


def recipient_state(revoked: Column, expires: Column, consumed: Column, now: Column) -> Column:
    """Revoked before expired before consumed before granted."""
    return F.when(revoked.isNotNull(), "revoked").when(expires <= now, "expired").when(consumed.isNotNull(), "consumed").otherwise("granted")


def stuck_jobs(jobs: DataFrame, limit_seconds: int) -> DataFrame:
    """One row: last start, and jobs still running that began more than ``limit_seconds`` before it."""
    last = jobs.agg(F.max("started").alias("last_started"))
    late = F.unix_timestamp("last_started") - F.unix_timestamp("started") > limit_seconds
    return jobs.join(F.broadcast(last), how="cross").groupBy("last_started").agg(F.count_if((F.col("status") == "running") & late).alias("stuck"), F.count_if(F.col("status") == "running").alias("running"))


def backfill_plan(texts: DataFrame, done: DataFrame, per_thousand: float = 0.000006) -> DataFrame:
    """One row: texts, those embedded with the same hash, those to embed, their tokens (characters // 4) and cost."""
    now = texts.select("message_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.length("text").alias("chars"))
    same = now.join(done.select("message_id", F.col("content_hash").alias("hash"), F.lit(True).alias("have")), ["message_id", "hash"], "left")
    todo = F.col("have").isNull()
    out = same.agg(F.count("*").alias("total"), F.count_if(~todo).alias("already"), F.count_if(todo).alias("to_embed"), F.coalesce(F.sum(F.when(todo, F.floor(F.col("chars") / 4))), F.lit(0)).alias("tokens"))
    return out.withColumn("cost", F.round(F.col("tokens") / 1000 * per_thousand, 8))
