"""Full-text search with phrases, alternatives and exclusions over word positions.

A query is read as a web search: words are all wanted, ``"several words"`` stand next to each other,
``or`` separates alternatives, ``-`` excludes.  It becomes a table of literals; the words of the
literals meet the positions of the same words in the texts, and a literal holds where all its words
put its beginning at one place.  Those positions are shuffled once, by text; tasks match and rank
many texts at once, as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .groups import _spans

#: English stop words of the usual full-text configuration
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now"
).split()
WORD = r"[\p{L}\p{N}]+"
#: Fixed values of the rank: weight of a word of the text, limit of the sum of 1 / j^2, positions of a word that count,
#: farthest distance of two words that counts
WEIGHT, SERIES, POSITIONS, FARTHEST = 0.1, 1.64493406685, 255, 100
#: Positions of words of the query set that a task takes at once, and places of matched texts that it compares at once
HITS, PLACES = 200_000, 2_000_000

# The suffix rules of the English (Porter 2) stemmer, the longest suffix of a step first.
# R1 begins behind the first consonant after a vowel, R2 is the same within R1.
_R1 = "(?>gener|commun|arsen|[^aeiouy]*+[aeiouy]++[^aeiouy])"
_R2 = _R1 + "[^aeiouy]*+[aeiouy]++[^aeiouy]"
_SHORT = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = "inning outing canning herring earring proceed exceed succeed".split()
_STEP_2 = [
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"),
    ("iviti", "ive"), ("ousli", "ous"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()


def _cut(w: Column, n: int, put: str = "") -> Column:
    return F.concat(F.substring(w, F.lit(1), F.length(w) - n), F.lit(put))


def _suffixes(w: Column, rules: list[tuple[str, str]], region: str, special: dict[str, str]) -> Column:
    """The first rule whose suffix ends the word is the only one; it applies if the suffix lies in the region."""
    out = None
    for suffix, put in rules:
        fits = w.rlike(f"^{special.get(suffix, region + '.*')}{suffix}$")
        then = F.when(fits, _cut(w, len(suffix), put)).otherwise(w)
        ends = w.endswith(suffix)
        out = F.when(ends, then) if out is None else out.when(ends, then)
    return out.otherwise(w)


def stemmed(words: DataFrame, word: str = "word", to: str = "stem") -> DataFrame:
    """``words`` with the English stem of each lower-case word; words of one or two signs are their own stems."""
    w = F.col("_w")
    marked = F.regexp_replace(F.regexp_replace(F.col(word), "^y", "Y"), "([aeiouy])y", "$1Y")
    step = words.withColumn("_w", marked)
    plural = F.when(w.endswith("sses"), _cut(w, 2)).when(w.rlike("(ied|ies)$"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
    step = step.withColumn("_w", plural.when(w.rlike("(us|ss)$"), w).when(w.rlike("[aeiouy].+s$"), _cut(w, 1)).otherwise(w))
    step = step.withColumn("_kept", w.isin(_KEPT))
    bare = F.regexp_extract(w, "^(.*[aeiouy].*?)(?:ingly|edly|ing|ed)$", 1)
    step = step.withColumn("_bare", F.when(w.rlike("eed(ly)?$") | (bare == ""), F.lit(None)).otherwise(bare))
    b = F.col("_bare")
    again = F.when(b.rlike("(at|bl|iz)$"), F.concat(b, F.lit("e"))).when(b.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(b, 1))
    again = again.when(b.rlike(_SHORT) & ~b.rlike(f"^{_R1}."), F.concat(b, F.lit("e"))).otherwise(b)
    eed = F.when(w.rlike(f"^{_R1}.*eed(ly)?$"), F.regexp_replace(w, "eed(ly)?$", "ee")).otherwise(w)
    step = step.withColumn("_w", F.when(w.rlike("eed(ly)?$"), eed).when(b.isNotNull(), again).otherwise(w))
    step = step.withColumn("_w", F.regexp_replace(w, "^(.+[^aeiouy])[yY]$", "$1i"))
    step = step.withColumn("_w", _suffixes(w, _STEP_2, _R1, {"ogi": _R1 + ".*(?<=l)", "li": _R1 + ".*(?<=[cdeghkmnrt])"}))
    step = step.withColumn("_w", _suffixes(w, _STEP_3, _R1, {"ative": _R2 + ".*"}))
    step = step.withColumn("_w", _suffixes(w, [(s, "") for s in _STEP_4], _R2, {"ion": _R2 + ".*(?<=[st])"}))
    last = w.rlike(f"^{_R2}.*e$") | (w.rlike(f"^{_R1}.*e$") & ~_cut(w, 1).rlike(_SHORT))
    step = step.withColumn("_w", F.when(last | w.rlike(f"^{_R2}.*(?<=l)l$"), _cut(w, 1)).otherwise(w))
    whole = F.create_map(*[F.lit(x) for pair in _WHOLE.items() for x in pair])[F.col(word)]
    first = F.when(F.length(word) <= 2, F.col(word)).otherwise(whole)
    kept = F.when(F.col("_kept"), F.regexp_replace(F.col(word), "(.)s$", "$1"))
    return step.withColumn(to, F.coalesce(first, kept, F.lower("_w"))).drop("_w", "_bare", "_kept")


def literals(queries: DataFrame) -> DataFrame:
    """(query_id, alternative, literal, negated, at, word): the words of each literal of web queries (query_id, text).

    Quotes that are not closed end with the text; a word of several parts, as in ``mail-box``, is a
    phrase; ``or`` counts outside of quotes alone.  Words are in lower case, ``at`` is their place in
    the literal.
    """
    parts = F.regexp_extract_all(F.lower("text"), F.lit(r'-?"[^"]*"?|[^\s"]+'), F.lit(0))
    each = queries.select("query_id", F.posexplode(parts).alias("literal", "part"))
    alternative = F.sum((F.col("part") == "or").cast("int")).over(Window.partitionBy("query_id").orderBy("literal"))
    each = each.withColumn("alternative", alternative).where("part <> 'or'")
    words = F.regexp_extract_all(F.col("part"), F.lit(WORD), F.lit(0))
    return each.select("query_id", "alternative", "literal", F.col("part").startswith("-").alias("negated"), F.posexplode(words).alias("at", "word"))


def positions(docs: DataFrame) -> DataFrame:
    """(id, pos, word): every word of the texts (id, text) with its number."""
    return docs.select("id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("pos", "word"))


def web_search(docs: DataFrame, queries: DataFrame, k: int = 20, stop: list[str] = STOP, stems: bool = True) -> DataFrame:
    """(query_id, id, score, rank): the k texts (id, text, ts) with the highest rank for each query (query_id, text).

    Of equal ranks the later ``ts`` comes first, then the smaller id; without ``ts`` ids decide.  Stop
    words count as places and nothing more, and a query of nothing else finds nothing; an alternative
    of exclusions alone finds all texts without them.  With ``stems`` words count by their English
    stems.  Texts that are null or empty hold no words; a repeated id is one text of all its rows.
    """
    plain = docs.select("id", "text")
    asked = literals(queries).where(~F.col("word").isin(stop))
    asked = asked.withColumn("at", F.col("at") - F.min("at").over(Window.partitionBy("query_id", "literal")))
    words = positions(plain)
    if stems:
        # staged: filters on the stem would be pushed through all its steps and grow with each
        stem_of = staged(stemmed(words.select("word").unionByName(asked.select("word")).distinct(), "word", "term"), "stems")
        asked = asked.join(stem_of, "word")
        forms = stem_of.join(asked.select("term").distinct(), "term", "left_semi")
    else:
        asked = asked.withColumn("term", F.col("word"))
        forms = asked.select("word", "term").distinct()
    matcher = Matcher(asked.select("query_id", "alternative", "literal", "negated", "at", "term").toArrow())  # a stated set of queries
    codes = docs.sparkSession.createDataFrame([(t, i) for i, t in enumerate(matcher.terms)], "term string, code int")
    # words of the query set alone are shuffled, once, by text; what follows stays in the text's task
    found = words.join(F.broadcast(forms.join(F.broadcast(codes), "term").select("word", "code")), "word").select("id", "code", "pos")
    if len(matcher.others):  # texts without any of the words count as well
        found = found.unionByName(plain.select("id", F.lit(-1).alias("code"), F.lit(0).alias("pos")))
    kind = {c: t.dataType.simpleString() for c, t in (("id", plain.schema["id"]), ("query_id", queries.schema["query_id"]))}
    scored = found.repartition("id").sortWithinPartitions("id").mapInArrow(matcher.run, f"query_id {kind['query_id']}, id {kind['id']}, score double")
    scored = scored.withColumn("score", F.round("score", 6))
    later = [F.desc_nulls_last("ts")] if "ts" in docs.columns else []
    if later:
        scored = scored.join(docs.groupBy("id").agg(F.max("ts").alias("ts")), "id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *later, "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


class Matcher:
    """The literals (query_id, alternative, literal, negated, at, term) of a set of queries, as arrays.

    A query of one word or of alternatives adds up over its words the sums of 1 / j^2 over the first
    occurrences; one whose words are all wanted multiplies, over the pairs of places of different
    words, one minus a weight that falls with their distance.
    """

    def __init__(self, rows: pa.Table):
        term, query = rows["term"].combine_chunks(), rows["query_id"].combine_chunks()
        terms, self.query_ids = term.unique(), query.unique()
        self.terms = terms.to_pylist()
        t, q = pc.index_in(term, terms).to_numpy(zero_copy_only=False).astype(np.int64), pc.index_in(query, self.query_ids).to_numpy(zero_copy_only=False).astype(np.int64)
        alternative, literal, at = (rows[c].to_numpy().astype(np.int64) for c in ("alternative", "literal", "at"))
        negated = np.array(rows["negated"].to_pylist(), dtype=bool)
        n = len(self.terms)
        ways, alt = np.unique(np.stack([q, alternative]), axis=1, return_inverse=True)
        held, first, lit = np.unique(np.stack([alt.ravel(), literal]), axis=1, return_index=True, return_inverse=True)
        lit = lit.ravel()
        self.alt_query, self.lit_alt, self.lit_negated, self.lit_words = ways[0], held[0], negated[first], np.bincount(lit, minlength=len(first))
        self.wanted = np.bincount(self.lit_alt[~self.lit_negated], minlength=len(self.alt_query))
        self.others = np.flatnonzero(self.wanted == 0)
        single = self.lit_words[lit] == 1
        self.single, self.phrase = _Lists(t[single], n, lit[single]), _Lists(t[~single], n, lit[~single], at[~single])
        self.last = int(at.max(initial=0))
        own = np.unique(q * max(n, 1) + t)
        self.words = _Lists(own // max(n, 1), len(self.query_ids), own % max(n, 1))
        self.n_terms = self.words.size
        self.close = (np.bincount(self.alt_query, minlength=len(self.query_ids)) == 1) & (self.n_terms > 1)

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query_id, id, score) of the texts that match, from rows (id, code, pos) in the order of their ids."""
        most, held, n = max(1_000, HITS // (1 + len(self.others))), [], 0
        for batch in batches:
            while batch.num_rows:
                if n < most:
                    take = min(batch.num_rows, most - n)
                else:  # the rest of the last text
                    same = pc.is_valid(pc.index_in(batch["id"], value_set=held[-1]["id"].slice(held[-1].num_rows - 1))).to_numpy(zero_copy_only=False)
                    take = int(np.argmin(same)) if not same.all() else batch.num_rows
                if take:
                    held.append(batch.slice(0, take))
                    n, batch = n + take, batch.slice(take)
                else:
                    yield from self.matches(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            yield from self.matches(pa.Table.from_batches(held))

    def matches(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows["id"].combine_chunks().unique()
        d, t, p = pc.index_in(rows["id"], ids).to_numpy().astype(np.int64), rows["code"].to_numpy().astype(np.int64), rows["pos"].to_numpy().astype(np.int64)
        real, n_terms = t >= 0, max(1, len(self.terms))
        d, t, p = d[real], t[real], p[real]
        order = np.lexsort((p, t, d))
        d, t, p = d[order], t[order], p[order]
        far = int(p.max(initial=0)) + self.last + 1
        word, start, count = np.unique(d * n_terms + t, return_index=True, return_counts=True)
        # literals of one word, then of several, then the alternatives they hold in
        place, times = np.unique((d * n_terms + t) * far + p, return_counts=True)
        once = np.unique(place[times == 1] // far)
        lit, of = self.single.of(once % n_terms)
        n_lit, n_alt, n_query = len(self.lit_words), len(self.alt_query), len(self.query_ids)
        alone = (once // n_terms)[of] * n_lit + lit
        lit, at, of = self.phrase.of(t, True)
        begin, times = np.unique((d[of] * n_lit + lit) * far + p[of] - at + self.last, return_counts=True)
        begin = begin // far
        holds = np.unique(np.concatenate([alone, begin[times == self.lit_words[begin % n_lit]]]))
        lit = holds % n_lit
        met, of = np.unique(holds // n_lit * n_alt + self.lit_alt[lit], return_inverse=True)
        spoilt = np.bincount(of, self.lit_negated[lit], len(met)) > 0
        alt = met % n_alt
        fits = ~spoilt & (np.bincount(of, ~self.lit_negated[lit], len(met)) == self.wanted[alt]) & (self.wanted[alt] > 0)
        found = met[fits]
        if len(self.others):
            every = (np.arange(len(ids))[:, None] * n_alt + self.others[None, :]).ravel()
            found = np.concatenate([found, every[~np.isin(every, met[spoilt])]])
        pair = np.unique(found // n_alt * n_query + self.alt_query[found % n_alt])
        text, query = np.divmod(pair, n_query)
        score = self.scores(text, query, p, word, start, count, n_terms)
        if ids.null_count:
            score[text == pc.index_in(pa.nulls(1, ids.type), ids)[0].as_py()] = 0
        yield pa.RecordBatch.from_arrays([self.query_ids.take(pa.array(query)), ids.take(pa.array(text)), pa.array(score)], ["query_id", "id", "score"])

    def scores(self, text: np.ndarray, query: np.ndarray, p: np.ndarray, word: np.ndarray, start: np.ndarray, count: np.ndarray, n_terms: int) -> np.ndarray:
        """Ranks of texts for queries, from the places of the words of each text, which lie at ``start`` to ``start + count``."""
        term, of = self.words.of(query)
        slot = np.searchsorted(word, text[of] * n_terms + term)
        slot[slot == len(word)] = 0
        there = word[slot] == text[of] * n_terms + term if len(word) else np.zeros(len(slot), bool)
        term, of, slot = term[there], of[there], slot[there]
        series = np.append(0.0, np.cumsum(1.0 / np.arange(1, POSITIONS + 1) ** 2))
        often = ~self.close[query[of]]
        score = np.bincount(of[often], WEIGHT * series[np.minimum(count[slot[often]], POSITIONS)] / SERIES / self.n_terms[query[of[often]]], len(text)).astype(float)
        several = self.close[query[of]] & (np.bincount(of, minlength=len(text))[of] > 1)
        term, of, slot = term[several], of[several], slot[several]
        apart = np.arange(FARTHEST + 1)
        part = np.log1p(-WEIGHT * np.sqrt(1.0 / (1.005 + 0.05 * np.exp(apart / 1.5 - 2))))
        total, lo, ends = np.zeros(len(text)), 0, np.cumsum(count[slot])
        while lo < len(of):  # pieces of whole pairs of a text and a query
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PLACES)))
            hi = int(np.searchsorted(of, of[hi - 1], "right"))
            at, row = _spans(start[slot[lo:hi]], count[slot[lo:hi]])
            m, w, x = of[lo:hi][row], term[lo:hi][row], p[at]
            order = np.lexsort((x, m))
            m, w, x = m[order], w[order], x[order]
            left, step = np.arange(len(m)), 1
            while len(left):
                left = left[left + step < len(m)]
                left = left[(m[left] == m[left + step]) & (x[left + step] - x[left] <= FARTHEST)]
                unlike = left[w[left] != w[left + step]]
                np.add.at(total, m[unlike], part[x[unlike + step] - x[unlike]])
                step += 1
            lo = hi
        return score + 1 - np.exp(total)


class _Lists:
    """Values listed by key, keys from 0."""

    def __init__(self, key: np.ndarray, n: int, *values: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.values, self.size = [v[order] for v in values], np.bincount(key, minlength=n)
        self.start = np.cumsum(self.size) - self.size

    def of(self, key: np.ndarray, both: bool = False) -> tuple[np.ndarray, ...]:
        """The values of the keys in turn, and the place of the key of each."""
        at, row = _spans(self.start[key], self.size[key])
        return *(v[at] for v in self.values[: 2 if both else 1]), row
