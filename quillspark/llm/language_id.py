"""Language ID: one interpolated Kneser-Ney character model a language, in sorted hash arrays.

A model reads letters of one word at a time, lower-cased, with marks for its start and end. Counts
of ORDER-letter grams come from all labelled texts (each task counts words, then their grams, and
emits a row a gram; Spark sums them), those seen once too. Discounts, totals of contexts,
continuation counts of the lower orders and so all probabilities are worked out by Spark. The
driver writes the sorted weights, run by run, into two files that each executor fetches once and
its workers map into memory: for each order the sorted keys (a gram's own 64-bit code) with a
column a language, and the same for contexts with their back-off weights. So neither the driver's nor
a worker's memory grows with the number of grams.

The language of the lowest cross-entropy (bits a letter) is chosen. A text is rejected if it has no
letter, or if its cross-entropy lies too far above the mean of the chosen language's own texts:
beyond `reject_at` deviations for its length, or TOP_MARGIN times the deviation that one in a hundred of that language's
labelled texts exceeds, if that is more. Means, deviations and quantiles come from all labelled texts, each in models of that half of
the documents that it isn't in. A language without such a text has a limit of about seven bits.

Defined results: null, empty and letterless texts get `und`, score 0 and are rejected; rows with null
lang are not learned from; if nothing is labelled, all texts are `und`; ties go to the language
first in order; texts of any length are read whole; repeated rows are scored separately; an empty
table gives no rows; other columns are ignored by `identify` and kept by `drop_rejected`.
"""

from __future__ import annotations

import functools
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import labelled_fold, literal_rows, materialized, share_file, small_batches, staged, table

GRAM, CONTEXT = 0, 1
#: A language's limit is at least this many times the given quantile of its own texts' deviations.
TOP_MARGIN, TOP_QUANTILE = 1.25, 0.99
#: Four symbols of 16 bits make one 64-bit key without collisions; rarer planes share one symbol.
ORDER = 4
_START, _END, _BITS = 2, 3, np.uint64(16)
#: The score is how likely the language is beside the others for so many letters of the text's mean bits (a temperature: all letters count for the mean).
SCORE_LETTERS = 40
#: Words that a scorer remembers, scores at once, and takes from texts at once.
_CACHE, _AT_ONCE, _WORDS_AT_ONCE = 100_000, 20_000, 200_000


@functools.lru_cache(maxsize=1)
def _spaced() -> np.ndarray:
    """Each code point, or a space in place of those that are no letters: what a word of the pattern [^\\W\\d_]+ is made of."""
    every = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    return np.where([c.isalnum() and not c.isdecimal() for c in map(chr, range(len(every)))], every, np.uint32(0x20))


def letters_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    if not text:
        return []
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _spaced()[points].tobytes().decode("utf-32-le", "surrogatepass").split()


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each letter and word end, and the word it belongs to."""
    pad = chr(_START) * (ORDER - 1)
    symbols = np.frombuffer((pad + (chr(_END) + pad).join(words) + chr(_END)).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.minimum(symbols, 0xFFFF).astype(np.uint64)
    gram = np.zeros(len(symbols), np.uint64)
    for back in range(ORDER):
        gram[back:] |= symbols[:len(symbols) - back] << (_BITS * np.uint64(back))
    here = symbols != _START
    ends = symbols == _END
    word = np.cumsum(ends) - ends
    return gram[here], word[here]


def _half(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(2)).cast("int")


def count_grams(labelled: DataFrame) -> DataFrame:
    """lang, half (of the documents, by a hash of the id), gram, n over all rows with a lang and a text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[tuple[str, int], Counter] = {}
        held: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}

        def fold(lang: tuple[str, int]) -> None:
            seen = words[lang]
            if not seen:
                return
            gram, word = _grams(list(seen))
            times = np.fromiter(seen.values(), np.int64, len(seen))[word]
            old = held.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            keys, at = np.unique(np.concatenate((old[0], gram)), return_inverse=True)
            held[lang] = keys, np.bincount(at, np.concatenate((old[1], times)), len(keys)).astype(np.int64)
            seen.clear()

        for pdf in batches:
            for lang, half, text in zip(pdf["lang"], pdf["half"], pdf["text"]):
                seen = words.setdefault((lang, half), Counter())
                seen.update(letters_of(text))
                if len(seen) > 100_000:
                    fold((lang, half))
        for lang in words:
            fold(lang)
        for (lang, half), (keys, n) in held.items():
            yield pd.DataFrame({"lang": lang, "half": half, "gram": keys.view(np.int64), "n": n})

    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", _half(F.col("doc_id")).alias("half"), "text")
    return small_batches(rows).mapInPandas(count, "lang string, half int, gram long, n long").groupBy("lang", "half", "gram").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModels:
    """Two files that executors hold: sorted keys, and beside each a number a language; `sections` has the rows of each table.

    (order, GRAM): discounted probabilities of the grams. (order, CONTEXT): back-off weights of their contexts.
    """

    langs: list[str]
    keys: str
    values: str
    sections: dict[tuple[int, int], tuple[int, int]]
    floor: np.ndarray
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None  # variance a text, variance a letter
    top: np.ndarray | None = None  # deviations that a language's own texts seldom exceed

    def _find(self, order: int, kind: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys the table has, and their rows of values."""
        keys, values = _mapped(self.keys, self.values, len(self.langs))
        start, end = self.sections.get((order, kind), (0, 0))
        if start == end:
            return np.zeros(len(key), bool), values[:0]
        at = start + np.minimum(np.searchsorted(keys[start:end], key), end - start - 1)
        on = keys[at] == key
        return on, values[at[on]]

    def bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word by language, and the letters and word ends of each word."""
        gram, word = _grams(words)
        gram, place = np.unique(gram, return_inverse=True)  # words share most of their grams, and each is looked up once
        p = np.broadcast_to(self.floor, (len(gram), len(self.langs))).copy()
        for n in range(1, ORDER + 1):
            key = gram & np.uint64((1 << 16 * n) - 1)
            on, found = self._find(n, CONTEXT, (key >> _BITS).view(np.int64))
            p[on] *= found
            on, found = self._find(n, GRAM, key.view(np.int64))
            p[on] += found
        bits = -np.log2(p)
        out = np.stack([np.bincount(word, bits[place, k], len(words)) for k in range(len(self.langs))], 1)
        return out, np.bincount(word, minlength=len(words))

    def calibrate(self, scored: DataFrame) -> None:
        """From (lang, n letters, cross-entropy h in its language) of labelled texts: how far a language's own texts lie from its mean, by length.

        All rows count; quantiles are exact on values rounded first, so that a language's state is bounded.
        """
        of = lambda values: F.element_at(F.create_map(*[x for lang, v in zip(self.langs, values) for x in (F.lit(lang), F.lit(float(v)))]), F.col("lang"))
        own = lambda value: scored.withColumn("x", value).groupBy("lang")
        weighted = F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 9)
        n_langs = len(self.langs)
        self.mean, self.spread, self.top = np.zeros(n_langs), np.ones((n_langs, 2)), np.zeros(n_langs)
        for r in own(F.col("h")).agg(weighted.alias("mean")).collect():
            self.mean[self.langs.index(r.lang)] = r["mean"]
        off = F.col("h") - of(self.mean)
        a_letter = F.round(F.log2(F.greatest(off * off * F.col("n"), F.lit(1e-12))), 3)
        for r in own(off * off).agg(weighted.alias("a_text"), F.percentile(a_letter, 0.5).alias("median")).collect():
            self.spread[self.langs.index(r.lang)] = r["a_text"] + 1e-4, 2 ** r["median"] * 2.2  # the median of a squared normal deviate is 1/2.2
        deviations = off / F.sqrt(of(self.spread[:, 0]) + of(self.spread[:, 1]) / F.col("n"))
        for r in own(F.round(deviations, 2)).agg(F.percentile("x", TOP_QUANTILE).alias("top")).collect():
            self.top[self.langs.index(r.lang)] = r["top"]

    def _deviation(self, k, letters: np.ndarray) -> np.ndarray:
        return np.sqrt(self.spread[k, 0] + self.spread[k, 1] / np.maximum(letters, 1))

    def limit(self, k: np.ndarray, letters: np.ndarray, reject_at: float) -> np.ndarray:
        """The cross-entropy beyond which a text of so many letters isn't of language k."""
        return self.mean[k] + np.maximum(reject_at, TOP_MARGIN * self.top[k]) * self._deviation(k, letters)


class Scorer:
    """Cross-entropies of whole texts; the bits of up to _CACHE words are remembered."""

    def __init__(self, models: LanguageModels):
        self.models = models
        self._forget()

    def _forget(self) -> None:
        self.place: defaultdict[str, int] = defaultdict()
        self.place.default_factory = self.place.__len__
        self.bits, self.size = np.zeros((_CACHE, len(self.models.langs)), np.float32), np.zeros(_CACHE, np.int32)

    def _learn(self, new: list[str], first: int) -> None:
        """Bits of words not seen before, whose places begin at `first`."""
        upto = first + len(new)
        if upto > len(self.bits):
            more = upto - len(self.bits)
            self.bits, self.size = np.pad(self.bits, ((0, more), (0, 0))), np.pad(self.size, (0, more))
        clean = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in new]
        for at in range(0, len(clean), _AT_ONCE):
            some = clean[at:at + _AT_ONCE]
            bits, size = self.models.bits(some)
            empty = np.array([not w for w in some])
            bits[empty], size = 0, np.where(empty, 0, size)
            self.bits[first + at:first + at + len(some)], self.size[first + at:first + at + len(some)] = bits, size

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a letter by language, and letters (with word ends) of each text; 0 letters if it has none."""
        n_langs = len(self.models.langs)
        out, letters = np.zeros((len(texts), n_langs)), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            cut, total = [], 0
            while at + len(cut) < len(texts) and total < _WORDS_AT_ONCE:
                cut.append(letters_of(texts[at + len(cut)]))
                total += len(cut[-1])
            if len(self.place) > _CACHE:
                self._forget()
            before = len(self.place)
            rows = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64, total)
            if len(self.place) > before:
                self._learn(list(islice(self.place, before, None)), before)
            text = np.repeat(np.arange(len(cut)), [len(words) for words in cut])
            n = np.bincount(text, self.size[rows], len(cut))
            letters[at:at + len(cut)] = n
            for k in range(n_langs):
                out[at:at + len(cut), k] = np.bincount(text, self.bits[rows, k], len(cut)) / np.maximum(n, 1)
            at += len(cut)
        return out, letters


@functools.lru_cache(maxsize=2)
def _mapped(keys: str, values: str, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """The models' files, memory-mapped: all workers of an executor read the same pages."""
    return np.memmap(SparkFiles.get(keys), np.int64, "r").view(np.ndarray), np.memmap(SparkFiles.get(values), np.float32, "r").view(np.ndarray).reshape(-1, langs)


def _levels(counts: DataFrame) -> DataFrame:
    """model, lang, order, key, n: the counts of the highest order; below, in how many different ways a gram is preceded."""
    level = counts.select("model", "lang", F.col("gram").alias("key"), "n")
    out = level.withColumn("order", F.lit(ORDER))
    for order in range(ORDER - 1, 0, -1):
        level = level.groupBy("model", "lang", F.col("key").bitwiseAND(F.lit((1 << 16 * order) - 1)).alias("key")).agg(F.count("*").alias("n"))
        out = out.unionByName(level.withColumn("order", F.lit(order)))
    return out


def _weights(levels: DataFrame, discounts: DataFrame) -> DataFrame:
    """model, order, kind, key, k, value: discounted probabilities of grams and back-off weights of contexts; discounts: model, lang, order, k, d."""
    rows = levels.join(F.broadcast(discounts), ["model", "lang", "order"]).withColumn("context", F.shiftrightunsigned("key", 16))
    contexts = rows.groupBy("model", "k", "order", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.first("d").alias("d"))
    grams = rows.join(contexts.drop("d", "kinds"), ["model", "k", "order", "context"])
    return grams.select("model", "order", F.lit(GRAM).alias("kind"), "key", "k", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("value")).unionByName(
        contexts.select("model", "order", F.lit(CONTEXT).alias("kind"), F.col("context").alias("key"), "k", (F.col("d") * F.col("kinds") / F.col("total")).alias("value")))


def _blocks(weights: DataFrame, langs: int) -> DataFrame:
    """model, order, kind, low, keys, values: the tables in sorted runs, as bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (model, order, kind), part in pdf.groupby(["model", "order", "kind"], sort=False):
                values = np.stack(part["values"].to_numpy()).astype(np.float32)
                yield pd.DataFrame({"model": [model], "order": [order], "kind": [kind], "low": [part["key"].iloc[0]], "keys": [part["key"].to_numpy(np.int64).tobytes()], "values": [values.tobytes()]})

    by_lang = F.map_from_entries(F.collect_list(F.struct("k", "value")))
    value = lambda k: F.coalesce(F.element_at("by_lang", k), F.col("kind").cast("double"))  # noqa: E731  an unseen gram has 0, the weight of an unseen context is 1
    whole = weights.groupBy("model", "order", "kind", "key").agg(by_lang.alias("by_lang")).select(
        "model", "order", "kind", "key", F.array(*[value(F.lit(k)) for k in range(langs)]).alias("values"))
    place = ["model", "order", "kind", "key"]
    # written first, as the range partitioning reads its input twice
    ordered = materialized(whole, "language-values").repartitionByRange(*place).sortWithinPartitions(*place)
    return ordered.mapInPandas(pack, "model int, order int, kind int, low long, keys binary, values binary")


def _fit(counts: DataFrame) -> dict[int, LanguageModels]:
    """By model, from the counts (model, lang, gram, n) of ORDER-grams; the driver writes the weights of all models into two files, run by run."""
    spark = counts.sparkSession
    levels = materialized(_levels(counts), "language-levels")
    stats = levels.groupBy("model", "lang", "order").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.count("*").alias("kinds")).collect()
    if not stats:
        return {}
    langs = sorted({r.lang for r in stats})
    discounts = [(r.model, r.lang, r.order, langs.index(r.lang), min(0.95, max(0.1, r.n1 / (r.n1 + 2 * r.n2))) if r.n1 else 0.5) for r in stats]
    kinds = {(r.model, r.lang): r.kinds for r in stats if r.order == 1}
    blocks = materialized(_blocks(_weights(levels, literal_rows(spark, discounts, "model lang order k d")), len(langs)), "language-weights")
    # where each run belongs, from their heads; then the runs come as they are stored, a file's partition at a time
    heads = sorted((r.model, r.order, r.kind, r.low, r.n) for r in blocks.select("model", "order", "kind", "low", (F.length("keys") / 8).cast("long").alias("n")).collect())
    sections: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}
    place, at = {}, 0
    for model, order, kind, low, n in heads:
        place[model, order, kind, low] = at
        own = sections.setdefault(model, {})
        own[order, kind] = own.get((order, kind), (at, at))[0], at + n
        at += n
    with staged("language-keys") as keys, staged("language-values") as values:
        for r in blocks.toLocalIterator():
            first = place[r.model, r.order, r.kind, r.low]
            keys.seek(8 * first)
            keys.write(r["keys"])
            values.seek(4 * len(langs) * first)
            values.write(r["values"])
    files = share_file(spark, keys.name), share_file(spark, values.name)
    return {m: LanguageModels(langs, *files, own, np.array([1.0 / (kinds.get((m, x), 0) + 1) for x in langs])) for m, own in sections.items()}


def fit_models(labelled: DataFrame) -> LanguageModels | None:
    """Models of all languages of `labelled` (doc_id, text, lang); None if there is no labelled text with a letter.

    Limits come from all its texts, each in models of the half that it isn't in, as a text is no measure of models that have learned it.
    The three sets of models (of all, of half 0, of half 1) are fitted in one go.
    """
    counts = materialized(count_grams(labelled), "language-grams")
    both = F.array(F.lit(0), F.col("half") + 1)
    fitted = _fit(counts.select(F.explode(both).alias("model"), "lang", "gram", "n").groupBy("model", "lang", "gram").agg(F.sum("n").alias("n")))
    if not fitted:
        return None
    models = fitted[0]
    # of each half, the models of the other one and the languages that it knows
    others = {1 - m: fitted[m + 1] for m in (0, 1) if m + 1 in fitted}
    known = {half: set() for half in others}
    for r in counts.select("lang", "half").distinct().collect():
        known[1 - r.half].add(r.lang)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = {half: Scorer(other) for half, other in others.items()}
        for pdf in batches:
            for half, part in pdf.groupby("half", sort=False):
                part = part[part["lang"].isin(known.get(half, ()))]
                if len(part):
                    bits, n = scorers[half].entropies(list(part["text"]))
                    h = bits[np.arange(len(part)), [models.langs.index(x) for x in part["lang"]]]
                    yield pd.DataFrame({"lang": part["lang"].to_numpy(), "n": n, "h": h})[n > 0]

    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", _half(F.col("doc_id")).alias("half"), "text")
    models.calibrate(materialized(small_batches(usable).mapInPandas(score, "lang string, n long, h double"), "language-scored"))
    return models


def identify(documents: DataFrame, models: LanguageModels | None, reject_at: float = 5.0) -> DataFrame:
    """doc_id, lang_pred, score, bits (lowest cross-entropy), rejected: one row a document."""
    schema = "doc_id long, lang_pred string, score double, bits double, rejected boolean"
    if models is None:
        return documents.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(True).alias("rejected"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, langs = Scorer(models), np.array(models.langs, object)
        for pdf in batches:
            bits, n = scorer.entropies(list(pdf["text"]))
            best = bits.argmin(1) if len(pdf) else np.zeros(0, np.int64)
            low = bits[np.arange(len(pdf)), best]
            odds = np.exp2(-(bits - low[:, None]) * np.minimum(n, SCORE_LETTERS)[:, None])
            limit = models.limit(best, n, reject_at)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "lang_pred": np.where(n > 0, langs[best], "und"),
                "score": np.where(n > 0, 1 / odds.sum(1), 0.0), "bits": np.where(n > 0, low, np.nan), "rejected": (n == 0) | (low > limit)})

    return small_batches(documents.select("doc_id", "text")).mapInPandas(scan, schema)


def drop_rejected(documents: DataFrame, models: LanguageModels | None, reject_at: float = 5.0) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    if models is None:
        return documents.limit(0)

    @F.pandas_udf("boolean")
    def accepted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(models)
        for texts in batches:
            bits, n = scorer.entropies(list(texts))
            best = bits.argmin(1) if len(texts) else np.zeros(0, np.int64)
            yield pd.Series((n > 0) & (bits[np.arange(len(texts)), best] <= models.limit(best, n, reject_at)))

    return small_batches(documents).filter(accepted("text"))


def training_rows(documents: DataFrame) -> DataFrame:
    """Labelled documents outside the held-out third."""
    return documents.filter(labelled_fold(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = identify(documents, fit_models(training_rows(documents)))
    return found.select("doc_id", (labelled_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "bits", "rejected")
