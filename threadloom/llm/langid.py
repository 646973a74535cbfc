"""Language identification with interpolated Kneser-Ney character models.

Letter 4-grams are counted per language over all training rows in Spark, and so are the Kneser-Ney
continuation counts, discounts and back-off weights that follow from them.  The models (4-gram
probabilities down to single letters, with back-off weights) of all languages share sorted hash
arrays, so one lookup per character serves every language.  The language with the lowest mean
cross-entropy wins; how sure that is, and what to reject, is calibrated on rows kept aside.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import SLICE_BYTES, U64, fold, mix, slices, text_buffer

ORDER = 4
#: Numbers that a table of gram probabilities may hold to be sent to the tasks (32 MB); a larger one of a whole
#: model stays in Spark and is joined, that of a small model leaves its rarest grams to the back-off
TABLE_VALUES = 1 << 23
#: Calibration rows, and the share of right predictions that rejection may lose
CALIBRATION_ROWS, REJECT_SHARE = 1_500, 0.005
SPACE_CODE = 0x20
_TABLE: list[np.ndarray] = []


def letter_table() -> tuple[np.ndarray, np.ndarray]:
    """Code unit -> its lower-case letter, or the space for anything that is no letter or mark; whether it is a letter.

    Marks, such as the vowel signs of Indic scripts, stay in their words.
    """
    if not _TABLE:
        table, letter = np.full(0x10000, SPACE_CODE, np.uint16), np.zeros(0x10000, bool)
        for c in range(0x10000):
            letter[c] = chr(c).isalpha()
            if letter[c]:
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
            elif unicodedata.category(chr(c))[0] == "M":
                table[c] = c
        _TABLE.extend((table, letter))
    return _TABLE[0], _TABLE[1]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, each led by three spaces and closed by one, runs of other signs as one
    space; the texts' offsets; whether a text has a letter.  Signs beyond 16 bits are one letter class."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    except UnicodeDecodeError:
        texts = [raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:])]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    high = points > 0xFFFF
    table, is_letter = letter_table()
    low = np.where(high, 0, points)
    codes, real = table[low], is_letter[low]
    if high.any():
        real[high] = [chr(p).isalpha() for p in points[high]]
        codes[high] = np.where(real[high], 0xE000, SPACE_CODE)
    letter = codes != SPACE_CODE
    has = np.concatenate([[0], np.cumsum(real)])
    has = has[at[1:]] > has[at[:-1]]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after a letter
    keep[at[at < len(keep)]] = letter[at[at < len(keep)]]
    new = np.concatenate([[0], np.cumsum(keep)])[at]
    gaps = np.arange(len(offsets)) * ORDER
    out = np.full(new[-1] + gaps[-1], SPACE_CODE, np.uint16)
    out[np.flatnonzero(np.ones(new[-1], bool)) + np.repeat(gaps[:-1] + ORDER - 1, np.diff(new))] = codes[keep]
    return out, new + gaps, has


def grams(codes: np.ndarray) -> np.ndarray:
    """g[i]: codes[i:i+4] in one number."""
    c = codes.astype(U64)
    n = max(0, len(c) - ORDER + 1)
    return (c[:n] << U64(48)) | (c[1 : n + 1] << U64(32)) | (c[2 : n + 2] << U64(16)) | c[3 : n + 3]


def gram_counts(rows: DataFrame) -> DataFrame:
    """Counts of 4-grams: (lang, gram, n) over all rows of (lang, text), summed within tasks first."""

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def emit(lang: str) -> pa.RecordBatch:
            keys, n = merge(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs):
                data, offsets = text_buffer(batch.column("text").filter(pa.array(langs == lang)))
                for lo, hi in slices(offsets):
                    part = offsets[lo : hi + 1]
                    codes, at, has = letters(data[part[0] : part[-1]], part - part[0])
                    g = grams(codes)
                    inside = np.ones(len(g), bool)
                    for k in range(1, ORDER):
                        inside[at[1:-1] - k] = False  # windows across two texts
                    held.setdefault(lang, []).append(np.unique(g[inside], return_counts=True))
                    if sum(len(k) for k, _ in held[lang]) > 500_000:
                        held[lang] = [merge(held[lang])]
                        if len(held[lang][0][0]) > 400_000:
                            yield emit(lang)
        for lang in list(held):
            yield emit(lang)

    return rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class HashArray:
    """Keys as sorted 64-bit hashes with a first-level index on their leading bits."""

    def __init__(self, keys: np.ndarray):
        hashes = mix(keys)
        self.order = np.argsort(hashes)
        self.hashes = np.concatenate([hashes[self.order], [U64(0xFFFFFFFFFFFFFFFF)]])
        self.bits = max(1, len(keys).bit_length())
        self.first = np.searchsorted(self.hashes[:-1], np.arange(1 << self.bits, dtype=U64) << U64(64 - self.bits)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places in the sorted order, -1 where a key is missing."""
        h = mix(keys)
        at = self.first[(h >> U64(64 - self.bits)).astype(np.int64)]
        got = self.hashes[at]
        rest = np.flatnonzero(got < h)
        while len(rest):
            at[rest] += 1
            rest = rest[self.hashes[at[rest]] < h[rest]]
        last = len(self.hashes) - 1
        return np.where((self.hashes[at] == h) & (at < last), at, -1)


@dataclass
class Model:
    langs: list[str]
    tables: dict[int, tuple[HashArray, np.ndarray]]  # order -> log probabilities (entries, languages)
    backoff: dict[int, tuple[HashArray, np.ndarray]]  # order of the context -> log weights
    single: tuple[HashArray, np.ndarray]
    floor: np.ndarray
    sharpness: float = 4.0
    limits: np.ndarray | None = None
    rest: dict[int, tuple[DataFrame, DataFrame | None]] | None = None  # order -> (lang, gram, p), (lang, context, weight) where they stay in Spark


@dataclass
class Level:
    """One order of one language: discounted probabilities of grams, back-off weights of contexts."""

    grams: np.ndarray
    p: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


def fit_models(levels: dict[str, dict[int, Level]]) -> Model:
    """The models of all languages in common tables; order 1 has plain probabilities."""
    langs = sorted(levels)
    alphabet = np.unique(np.concatenate([levels[x][1].grams for x in langs]))
    floor = np.full(len(langs), np.log(1.0 / (len(alphabet) + 1) / 50))
    find, lower = HashArray(alphabet), np.zeros((len(alphabet), len(langs)))
    for j, lang in enumerate(langs):
        lower[np.searchsorted(alphabet, levels[lang][1].grams), j] = levels[lang][1].p
    lower = np.log(0.98 * lower + 0.02 / (len(alphabet) + 1))
    model = Model(langs, {}, {}, (find, lower[find.order].astype(np.float32)), floor)
    for k in range(2, ORDER + 1):
        union = np.unique(np.concatenate([levels[x][k].grams for x in langs]))
        contexts = np.unique(np.concatenate([union >> U64(16), *[levels[x][k].contexts for x in langs]]))
        p, weight = np.zeros((len(union), len(langs))), np.ones((len(contexts), len(langs)))
        for j, lang in enumerate(langs):
            own = levels[lang][k]
            weight[np.searchsorted(contexts, own.contexts), j] = own.weights
            p[np.searchsorted(union, own.grams), j] = own.p
        shorter = log_probabilities(model, union & U64((1 << (16 * (k - 1))) - 1), k - 1)
        p += weight[np.searchsorted(contexts, union >> U64(16))] * np.exp(shorter.astype(np.float64))
        find, ctx_find = HashArray(union), HashArray(contexts)
        model.tables[k] = (find, np.log(np.maximum(p, 1e-30))[find.order].astype(np.float32))
        model.backoff[k] = (ctx_find, np.log(np.maximum(weight, 1e-30))[ctx_find.order].astype(np.float32))
    return model


def log_probabilities(model: Model, g: np.ndarray, order: int = ORDER) -> np.ndarray:
    """(grams, languages) log probabilities of the last letter given the ones before it."""
    out = np.zeros((len(g), len(model.langs)), np.float32)
    todo, keys = np.arange(len(g)), g
    for k in range(order, 1, -1):
        find, logs = model.tables[k]
        at = find.find(keys)
        hit = at >= 0
        if k == order and hit.all():
            return logs[at]
        out[todo[hit]] += logs[at[hit]]
        todo, keys = todo[~hit], keys[~hit]
        ctx_find, weights = model.backoff[k]
        at = ctx_find.find(keys >> U64(16))
        out[todo[at >= 0]] += weights[at[at >= 0]]
        keys = keys & U64((1 << (16 * (k - 1))) - 1)
    at = model.single[0].find(keys)
    out[todo] += np.where((at >= 0)[:, None], model.single[1][at], model.floor)
    return out


def cross_entropies(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean cross-entropy per letter of each whole text under each language; whether it has letters."""
    out, has = np.zeros((len(offsets) - 1, len(model.langs))), np.zeros(len(offsets) - 1, bool)
    for lo, hi in slices(offsets, SLICE_BYTES >> 2):
        part = offsets[lo : hi + 1]
        codes, at, has[lo:hi] = letters(data[part[0] : part[-1]], part - part[0])
        logs = log_probabilities(model, grams(codes))
        ends = np.minimum(np.stack([at[:-1], at[1:] - (ORDER - 1)], 1).ravel(), len(logs) - 1)
        sums = np.add.reduceat(np.concatenate([logs, np.zeros((1, logs.shape[1]), np.float32)]).astype(np.float64), np.where(np.arange(len(ends)) % 2, np.append(at[1:] - (ORDER - 1), 0).repeat(2)[: len(ends)], ends), axis=0)[::2]
        out[lo:hi] = -sums / np.maximum(1, np.diff(at) - (ORDER - 1))[:, None]
    return out, has


def shares(model: Model, entropy: np.ndarray) -> np.ndarray:
    z = -model.sharpness * (entropy - entropy.min(axis=1, keepdims=True))
    return np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)


def calibrate(model: Model, entropy: np.ndarray, truth: np.ndarray) -> Model:
    """Set the sharpness of the score by likelihood and the rejection limit of each language.

    ``entropy`` has the cross-entropies of some texts under each model, ``truth`` their languages' numbers.
    """
    model.limits = np.full(len(model.langs), np.inf)
    if not len(truth):
        return model
    loss = {}
    for sharp in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
        model.sharpness = sharp
        loss[sharp] = -np.log(np.maximum(1e-12, shares(model, entropy)[np.arange(len(truth)), truth])).mean()
    model.sharpness = min(loss, key=loss.get)
    best = entropy.argmin(axis=1)
    for j in range(len(model.langs)):
        right = entropy[(best == j) & (truth == j), j]
        if len(right) >= 20:
            model.limits[j] = np.quantile(right, 1 - REJECT_SHARE) * 1.1
    return model


def entropies(model: Model, text: str | Column) -> Column:
    """Cross-entropies of a text under each model; null without letters."""

    @F.arrow_udf("array<double>")
    def language_entropies(column: pa.Array) -> pa.Array:
        entropy, has = cross_entropies(model, *text_buffer(column))
        return pa.array([x if h else None for x, h in zip(entropy, has)], pa.list_(pa.float64()))

    return language_entropies(text)


def kneser_ney(counts: DataFrame) -> dict[int, DataFrame]:
    """Order -> (lang, gram, n): the counts of 4-grams, below them the distinct letters to the left."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1))
        levels[k] = staged(levels[k + 1].groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n")), "grams")
    return levels


def most_frequent(rows: DataFrame, langs: int, n: str, values: int) -> DataFrame:
    """All rows if the table of ``values`` numbers has room, else the frequent ones of each language.

    A language is cut at a power of 2 ** 0.25, found from a histogram, so nothing is sorted.
    """
    room = max(1, values // langs**2)
    step = F.floor(F.log2(F.col(n)) * 4).cast("int")
    cuts = {}
    for r in rows.groupBy("lang", step.alias("step")).count().orderBy("lang", F.desc("step")).collect():  # at most 256 a language
        cut = cuts.setdefault(r["lang"], [0, r["step"], True])
        cut[2] = cut[2] and cut[0] + r["count"] <= room
        if cut[2]:
            cut[:2] = cut[0] + r["count"], r["step"]
    least = F.create_map(*[F.lit(x) for lang, cut in cuts.items() for x in (lang, cut[1])])
    return rows.where(step >= least[F.col("lang")]) if cuts else rows


def gram_sums(rows: DataFrame) -> DataFrame:
    """(id, gram, n): the 4-grams of each text (id, text), with how often they stand there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets, SLICE_BYTES >> 2):
                part = offsets[lo : hi + 1]
                codes, at, has = letters(data[part[0] : part[-1]], part - part[0])
                g, row = grams(codes), np.repeat(np.arange(hi - lo), np.diff(at))
                inside = (np.arange(len(g)) < (at[1:] - (ORDER - 1))[row[: len(g)]]) & has[row[: len(g)]]
                order = np.lexsort((g[inside], row[: len(g)][inside]))
                row, g = row[: len(g)][inside][order], g[inside][order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (g[1:] != g[:-1])])) if len(g) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(lo + row[first])), pa.array(g[first].view(np.int64)), pa.array(np.diff(np.append(first, len(g))).astype(np.int64))], ["id", "gram", "n"])

    return rows.select("id", "text").mapInArrow(count, f"id {rows.schema['id'].dataType.simpleString()}, gram long, n long")


def joined_entropies(model: Model, rows: DataFrame) -> DataFrame:
    """(id, e): what ``entropies`` gives, for the texts (id, text) with letters, by joins with all grams of all orders; ids are distinct."""
    spark = rows.sparkSession
    spread = staged(gram_sums(rows), "text-grams")
    langs = spark.createDataFrame([(x, i) for i, x in enumerate(model.langs)], "lang string, j int")
    each = spread.select("gram").distinct().join(F.broadcast(langs), how="cross")
    logs = each.withColumn("p", F.lit(0.0)).withColumn("left", F.lit(1.0))
    for k in range(ORDER, 0, -1):
        p, weights = model.rest[k]
        logs = logs.withColumn("own", F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1)) if k < ORDER else F.col("gram"))
        logs = logs.join(p.select("lang", F.col("gram").alias("own"), F.col("p").alias("p_own")), ["lang", "own"], "left")
        own = F.coalesce("p_own", F.lit(0.0))
        logs = logs.withColumn("p", F.col("p") + F.col("left") * (own if k > 1 else 0.98 * own + F.lit(float(np.exp(model.floor[0]) * 50 * 0.02)))).drop("p_own")
        if k > 1:
            logs = logs.withColumn("context", F.shiftrightunsigned("own", 16)).join(weights.select("lang", "context", "weight"), ["lang", "context"], "left")
            logs = logs.withColumn("left", F.col("left") * F.coalesce("weight", F.lit(1.0))).drop("weight", "context")
        logs = logs.drop("own")
    vectors = logs.groupBy("gram").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", F.log(F.greatest("p", F.lit(1e-30))).alias("log")))), lambda x: x["log"]).alias("logs"))  # a number a language
    met = spread.join(vectors, "gram").select("id", "n", F.posexplode("logs").alias("j", "log"))
    sums = met.groupBy("id", "j").agg((-F.sum(F.col("n") * F.col("log")) / F.sum("n")).alias("e"))
    return sums.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "e"))), lambda x: x["e"]).alias("e"))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", table_values: int = TABLE_VALUES, whole: bool = False) -> Model | None:
    """Count over all training rows (crc32 of the id modulo 4 is not 2, non-null language and text)
    and calibrate on rows kept aside.

    None if no row can be learned from.  Every language is learned, and all counts, continuation
    counts, discounts and back-off weights are those of all rows.  Where a table would hold more than
    ``table_values`` numbers (grams x languages), its rarest grams are left to the back-off; with
    ``whole`` no gram is: such tables stay in Spark, and texts meet them by joins (``predicted``).
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(doc_id, 4) != 2)).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    aside = (fold("id", 4) == 3) & (F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(16)) == 0)
    levels: dict[str, dict[int, Level]] = {}
    tables: dict[int, tuple[DataFrame, DataFrame | None]] = {}
    # languages of which every row would be kept aside are learned from these rows
    lonely = [r["lang"] for r in rows.groupBy("lang").agg(F.min(aside).alias("lonely")).where("lonely").collect()]  # a row a language
    counted = kneser_ney(staged(gram_counts(rows.where(~aside | F.col("lang").isin(lonely))), "grams"))
    langs = [r["lang"] for r in counted[1].select("lang").distinct().collect()]
    if not langs:
        return None
    room = max(1, table_values // len(langs))
    large = whole and any(x.select("gram").distinct().count() > room for x in counted.values())
    for k, grams in counted.items():
        ones = grams.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("long")).alias("one"), F.sum((F.col("n") == 2).cast("long")).alias("two"), F.sum("n").alias("all"))
        share = {r["lang"]: r["one"] / (r["one"] + 2 * r["two"]) if r["one"] and r["two"] else 0.5 for r in ones.collect()}
        d = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
        if k == 1:
            p = grams.join(F.broadcast(ones.select("lang", "all")), "lang").select("lang", "gram", (F.col("n") / F.col("all")).alias("p"))
            weights = None
        else:
            context = F.shiftrightunsigned("gram", 16)
            own = grams.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
            kept = grams if whole else most_frequent(grams, len(langs), "n", table_values)
            p = kept.withColumn("context", context).join(own, ["lang", "context"]).select("lang", "gram", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("all")).alias("p"))
            weights = (own if whole else most_frequent(own, len(langs), "all", table_values)).select("lang", "context", (d * F.col("kinds") / F.col("all")).alias("weight"))
        if large:
            tables[k] = staged(p, "p"), weights and staged(weights, "weights")
            continue
        weights = weights and weights.toPandas()  # within the room
        for x, part in p.toPandas().groupby("lang"):
            keys = part["gram"].to_numpy(np.int64).view(U64)
            order = np.argsort(keys)
            own_weights = np.zeros(0, U64), np.zeros(0)
            if weights is not None:
                w = weights[weights["lang"] == x]
                own_weights = w["context"].to_numpy(np.int64).view(U64), w["weight"].to_numpy()
            levels.setdefault(x, {})[k] = Level(keys[order], part["p"].to_numpy()[order], *own_weights)
    if large:
        alphabet = tables[1][0].select("gram").distinct().count()
        model = Model(sorted(langs), {}, {}, (HashArray(np.zeros(0, U64)), np.zeros((0, len(langs)))), np.full(len(langs), np.log(1.0 / (alphabet + 1) / 50)), rest=tables)
    else:
        model = fit_models(levels)
    held = rows.where(aside & F.col("lang").isin(model.langs) & ~F.col("lang").isin(lonely)).withColumn("turn", F.xxhash64(F.lit(12), "id", "text"))
    last = held.select("turn").orderBy("turn").limit(CALIBRATION_ROWS).agg(F.max("turn")).first()[0]
    if last is None:
        return calibrate(model, np.zeros((0, len(model.langs))), np.zeros(0, int))
    index = {x: i for i, x in enumerate(model.langs)}
    few = held.where(F.col("turn") <= last).limit(2 * CALIBRATION_ROWS)
    if model.rest is None:
        scored = few.select("lang", entropies(model, "text").alias("e")).where("e is not null").collect()  # numbers alone
    else:
        few = staged(few.withColumn("id", F.monotonically_increasing_id()), "calibration")
        scored = joined_entropies(model, few).join(few.select("id", "lang"), "id").select("lang", "e").collect()
    return calibrate(model, np.array([r["e"] for r in scored]).reshape(-1, len(model.langs)), np.array([index[r["lang"]] for r in scored], int))


def _choice(model: Model | None, entropy: np.ndarray, has: np.ndarray, reject: bool) -> pa.StructArray:
    n = len(has)
    lang, score, accepted = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
    if model is not None and n:
        best = entropy.argmin(axis=1)
        limits = model.limits if model.limits is not None else np.full(len(model.langs), np.inf)
        accepted = has & (entropy[np.arange(n), best] <= limits[best])
        use = accepted if reject else has
        lang[use] = np.array(model.langs, object)[best[use]]
        score[use] = shares(model, entropy)[np.arange(n), best][use]
    return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)], ["lang", "score", "accepted"])


def predict(model: Model | None, text: str = "text", reject: bool = False) -> Column:
    """Struct (lang, score, accepted) for a text column.

    ``und`` with score 0 if the text is null or has no letter (or there is no model).  ``accepted``
    is false where even the best model's cross-entropy is beyond its calibrated limit; with
    ``reject`` such texts become ``und`` too.  Ties go to the first language in code-point order.
    Very long texts count whole, rows that repeat are scored each, an empty table gives no rows.
    A model whose tables stay in Spark needs ``predicted``.
    """
    if model is not None and model.rest is not None:
        raise ValueError("the tables of this model are joined: use predicted()")

    @F.arrow_udf("struct<lang: string, score: double, accepted: boolean>")
    def language(column: pa.Array) -> pa.Array:
        if model is None or not len(column):
            return _choice(None, np.zeros((len(column), 0)), np.zeros(len(column), bool), reject)
        return _choice(model, *cross_entropies(model, *text_buffer(column)), reject)

    return language(text)


def predicted(docs: DataFrame, model: Model | None, text: str = "text", reject: bool = False) -> DataFrame:
    """``docs`` with the struct ``p`` of ``predict``; also for models whose tables stay in Spark."""
    if model is None or model.rest is None:
        return docs.withColumn("p", predict(model, text, reject))
    small = Model(model.langs, {}, {}, model.single, model.floor, model.sharpness, model.limits)  # no tables of Spark go to tasks

    @F.arrow_udf("struct<lang: string, score: double, accepted: boolean>")
    def chosen(column: pa.Array) -> pa.Array:
        has = np.array(column.is_valid())
        entropy = np.array([x if x is not None else [0.0] * len(small.langs) for x in column.to_pylist()]).reshape(-1, len(small.langs))
        return _choice(small, entropy, has, reject)

    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "texts")
    found = joined_entropies(model, rows.where(F.col(text).isNotNull()).select(F.col("_row").alias("id"), F.col(text).alias("text")))
    return rows.join(found.withColumnRenamed("id", "_row"), "_row", "left").withColumn("p", chosen("e")).drop("_row", "e")
