"""Sparse TF-IDF vectors as long tables (key, term, weight), their cosine, overlaps and centroids.

The IDF of a pair of texts counts both texts' units; units never cross texts, so document
frequencies of the two sides are computed once and added after the join on the term.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from quillspark.functions import text as T
from quillspark.sources.tables import small_batches

BIGRAM_WEIGHT = 0.6


#: The term of the row that counts a text's units.
UNITS = ""
_TF = 1 << 40


_COUNTED = StructType().add("terms", ArrayType(StringType())).add("counts", ArrayType(LongType())).add("sums", ArrayType(DoubleType()))
_LOGS = [math.log(max(n, 1)) for n in range(4_096)]


def _log(n: int) -> float:
    return _LOGS[n] if n < len(_LOGS) else math.log(n)


def _counted(text: str | None, filled: bool, sums: bool) -> tuple[list[str], list[int], list[float] | None]:
    words, units = [], []
    for line in (text or "").split("\n"):
        mine = line[1:].split(" ") if len(line) > 1 else []
        words += mine
        if line.startswith("u"):
            units.append(mine)
    if not units and filled:
        units = [words]
    seen, held = Counter(words), Counter()
    seen.update(map("_".join, zip(words, words[1:])))
    for unit in units:
        held.update({*unit, *map("_".join, zip(unit, unit[1:]))})
    get = held.get
    counts = [n * _TF + get(t, 0) for t, n in seen.items()]
    return [UNITS, *seen], [len(units), *counts], _sums(seen, held) if sums else None


def _sums(seen: Counter, held: Counter) -> list[float]:
    sums = [0.0] * 4
    for term, n in seen.items():
        a, k = (_log(n) + 1) * (BIGRAM_WEIGHT if "_" in term else 1.0), held[term]
        if k:
            b = 1 - _log(k + 1)
            sums[0] += a * a
            sums[1] += a * a * b
            sums[2] += a * a * b * b
        else:
            sums[3] += a * a
    return sums


#: Characters of the texts whose terms are in memory at once: a text's terms take some 50 times its own size in Python.
PIECE = 1 << 19


def _pieces(batches: Iterator[tuple[pd.Series, pd.Series]], sums: bool) -> Iterator[pd.DataFrame]:
    """The counts of all texts in order, in frames of PIECE characters or of one longer text."""
    for lines, filled in batches:
        rows, size = [], 0
        for t, some in zip(lines, filled):
            if rows and size + len(t or "") > PIECE:
                yield pd.DataFrame(rows, columns=_COUNTED.names)
                rows, size = [], 0
            rows.append(_counted(t, bool(some), sums))
            size += len(t or "")
        yield pd.DataFrame(rows, columns=_COUNTED.names)


@F.pandas_udf(_COUNTED)
def counted_terms(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Of lines of words, "u" before those that are units: different words and neighbours (joined by _), and their counts."""
    yield from _pieces(batches, False)


@F.pandas_udf(_COUNTED)
def counted_terms_and_sums(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The same with four sums: of a^2, a^2 b and a^2 b^2 over the terms that are in a unit, and of a^2 over the others, where the term's weight in a pair of
    texts with U units together is a * (log(U + 1) + b) if only this text has it (a without b for the others).
    """
    yield from _pieces(batches, True)


def _is_unit(line: Column) -> Column:
    return F.length(F.when(T.is_bullet(line), T.strip_bullet(line)).otherwise(T.strip(line))) >= 15


def term_lines(text: Column) -> Column:
    """Content words of each line, "u" before those of units, "-" before the others."""
    return F.array_join(F.transform(T.lines(text), lambda x: F.concat(F.when(_is_unit(x), "u").otherwise("-"), F.array_join(T.content_tokens(x), " "))), "\n")


def packed_terms(texts: DataFrame, key: str, text: str = "text", sums: bool = False) -> DataFrame:
    """key, p: a text's terms, their counts (see `term_table`) and, if wanted, the sums that `shared_terms` needs; a row a text, no shuffle.

    Lines become their content words here; a row's words are counted where it is, in Arrow batches.
    """
    return small_batches(texts).select(key, (counted_terms_and_sums if sums else counted_terms)(term_lines(F.col(text)), T.strip(F.col(text)) != "").alias("p"))


def unit_total(texts: DataFrame, text: str = "text") -> DataFrame:
    """total: units of all texts, without counting their terms. One row."""
    units = F.size(F.filter(T.lines(F.col(text)), _is_unit))
    return texts.select(F.when(units > 0, units).when(T.strip(F.col(text)) != "", 1).otherwise(0).cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def term_table(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, counts: how often a content word or pair of neighbours occurs in a text, and in how many of its units. A key is a row.

    Units are lines of 15 characters or more, or the whole text if there is none. Both counts are in
    one number (see `tf` and `df`). The row of term UNITS has the number of units.
    """
    return _exploded(packed_terms(texts, key, text), [key]).select(key, "term", "counts")


def _exploded(packed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, counts, sums (only beside UNITS)."""
    # explode_outer, as Spark copies explode's expression into an inferred filter and computes it twice
    rows = packed.select(*keys, F.col("p.sums").alias("sums"), F.explode_outer(F.arrays_zip("p.terms", "p.counts")).alias("x")).filter("x is not null")
    return rows.select(*keys, "x.terms", "x.counts", "sums").toDF(*keys, "term", "counts", "sums").withColumn("sums", F.when(F.col("term") == UNITS, F.col("sums")))


def tf(counts: Column | str = "counts") -> Column:
    return F.shiftright(counts, 40)


def df(counts: Column | str = "counts") -> Column:
    return (F.col(counts) if isinstance(counts, str) else counts).bitwiseAND(F.lit(_TF - 1))


def document_frequencies(terms: DataFrame, total: DataFrame) -> DataFrame:
    """term, df, total: in how many units of all texts a term occurs, and how many units there are (`unit_total`)."""
    found = terms.filter(F.col("term") != UNITS).groupBy("term").agg(F.sum(df()).alias("df"))
    return found.filter("df > 0").crossJoin(F.broadcast(total))  # one row


def idf(df: Column, total: Column) -> Column:
    return F.log((total + 1) / (df + 1)) + 1


def raw_weight(tf: Column, idf_: Column, term: Column) -> Column:
    return (F.log(tf) + 1) * F.coalesce(idf_, F.lit(1.0)) * F.when(F.contains(term, F.lit("_")), F.lit(BIGRAM_WEIGHT)).otherwise(F.lit(1.0))


def normalised(weights: DataFrame, keys: list[str], weight: str = "w") -> DataFrame:
    """Weights divided by the root of their squares' sum, within the keys."""
    return weights.withColumn(weight, F.col(weight) / F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy(*keys))))


def tfidf(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, w: unit-length vectors, IDF over the units of all texts."""
    terms = term_table(texts, key, text)
    idfs = document_frequencies(terms, unit_total(texts, text)).select("term", idf(F.col("df"), F.col("total")).alias("idf"))
    rows = terms.filter(F.col("term") != UNITS).join(idfs, "term", "left")
    return normalised(rows.select(key, "term", raw_weight(tf(), F.col("idf"), F.col("term")).alias("w")), [key])


def second_terms(left: DataFrame, right: DataFrame, pairs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """a, b, term, wb as `pair_terms` gives them, of all the second side's terms, and `met`, whether the first side has the term.

    The second side's weights need of the first only its units and the terms that both have, so its other terms are neither dealt to pairs nor sorted.
    """
    none = F.lit(0).cast("long")
    counts = term_table(right, b, text)
    mine = pairs.select(a, b).join(term_table(left, a, text), a).select(a, b, "term", F.col("counts").alias("ca"), none.alias("cb"))
    mine = mine.join(counts.select(b, "term"), [b, "term"], "left_semi").select(a, b, "term", "ca", "cb")
    theirs = pairs.select(a, b).join(counts, b).select(a, b, "term", none.alias("ca"), F.col("counts").alias("cb"))
    both = mine.unionByName(theirs).repartition(a, b).groupBy(a, b, "term").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    pair, units = Window.partitionBy(a, b), df("ca") + df("cb")
    rows = both.withColumn("total", F.sum(F.when(F.col("term") == UNITS, units)).over(pair)).filter(F.col("term") != UNITS)
    rows = rows.select(a, b, "term", (F.col("ca") > 0).alias("met"), raw_weight(tf("cb"), F.when(units > 0, idf(units, F.col("total"))), F.col("term")).alias("wb"))
    return rows.withColumn("wb", F.col("wb") / F.sqrt(F.sum(F.col("wb") * F.col("wb")).over(pair)))


def pair_terms(left: DataFrame, right: DataFrame, pairs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """a, b, term, wa, wb: both sides' vectors of every pair (null where a side lacks the term), IDF from the units of that pair alone.

    Each side's terms go to its pairs; then all of a pair is in one place, and sums over it need no further shuffle.
    """
    none = F.lit(0).cast("long")
    mine = pairs.select(a, b).join(term_table(left, a, text), a).select(a, b, "term", F.col("counts").alias("ca"), none.alias("cb"))
    theirs = pairs.select(a, b).join(term_table(right, b, text), b).select(a, b, "term", none.alias("ca"), F.col("counts").alias("cb"))
    both = mine.unionByName(theirs).repartition(a, b).groupBy(a, b, "term").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    pair = Window.partitionBy(a, b)
    total = F.sum(F.when(F.col("term") == UNITS, df("ca") + df("cb"))).over(pair)
    counted = both.select(a, b, "term", tf("ca").alias("tfa"), tf("cb").alias("tfb"), (df("ca") + df("cb")).alias("df"), total.alias("total")).filter(F.col("term") != UNITS)
    known = F.when(F.col("df") > 0, idf(F.col("df"), F.col("total")))
    raw = counted.select(a, b, "term", *[F.when(F.col(f"tf{x}") > 0, raw_weight(F.col(f"tf{x}"), known, F.col("term"))).alias(f"w{x}") for x in "ab"])
    return raw.select(a, b, "term", *[(F.col(w) / F.sqrt(F.sum(F.col(w) * F.col(w)).over(pair))).alias(w) for w in ("wa", "wb")])


def shared_terms(left: DataFrame, right: DataFrame, pairs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """a, b, term, wa, wb as `pair_terms` gives them, of the terms that both texts have (and UNITS, without weights, for each pair).

    A term that one side alone has takes its document frequency from that side, so a side's squared length follows from four sums made once
    a text; only shared terms meet, and put the sums right. The second side's terms are not copied to its pairs.
    """
    mine = _exploded(pairs.select(a, b).join(packed_terms(left, a, text, True), a), [a, b]).select(a, b, "term", F.col("counts").alias("ca"), F.col("sums").alias("sa"))
    theirs = _exploded(packed_terms(right, b, text, True), [b]).select(b, "term", F.col("counts").alias("cb"), F.col("sums").alias("sb"))
    both = mine.join(theirs, [b, "term"]).repartition(a, b)
    pair, is_units = Window.partitionBy(a, b), F.col("term") == UNITS
    whole = lambda x: F.max(F.when(is_units, x)).over(pair)
    rows = both.select(a, b, "term", "ca", "cb", whole(F.col("sa")).alias("sa"), whole(F.col("sb")).alias("sb"), F.log(whole(df("ca") + df("cb")) + 1).alias("log_units"))
    weight = lambda n, k: (F.log(n) + 1) * F.when(F.contains("term", F.lit("_")), BIGRAM_WEIGHT).otherwise(1.0) * F.when(k > 0, F.col("log_units") + 1 - F.log(k + 1)).otherwise(1.0)
    out = {}
    for x in "ab":
        own, n = F.col(f"s{x}"), F.when(~is_units, tf(f"c{x}"))
        alone, met, log_units = weight(n, df(f"c{x}")), weight(n, df("ca") + df("cb")), F.col("log_units")
        squares = own[0] * log_units * log_units + 2 * own[1] * log_units + own[2] + own[3] + F.coalesce(F.sum(met * met - alone * alone).over(pair), F.lit(0.0))
        out[f"w{x}"] = met / F.sqrt(squares)
    return rows.select(a, b, "term", *[w.alias(name) for name, w in out.items()])


def cosines(terms: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of `pair_terms` or `shared_terms`: keys, similarity of every pair."""
    dots = terms.groupBy(*keys).agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))
    return pairs.join(dots, keys, "left").select(*keys, T.clamp(F.coalesce("s", F.lit(0.0))).alias("similarity"))


def overlapping_terms(terms: DataFrame, keys: list[str], limit: int = 12) -> DataFrame:
    """keys, rank, term, contribution (5 digits): what the pair shares most."""
    both = terms.filter("wa is not null and wb is not null").select(
        *keys, F.replace("term", F.lit("_"), F.lit(" ")).alias("term"), F.round(F.col("wa") * F.col("wb"), 5).alias("contribution"))
    w = Window.partitionBy(*keys).orderBy(F.desc("contribution"), "term")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def missing_terms(terms: DataFrame, keys: list[str], limit: int = 15) -> DataFrame:
    """Of `second_terms`: keys, rank, term: single words of the second side that the first lacks, by weight (6 digits)."""
    rows = terms.filter(~F.col("met")).filter(~F.contains("term", F.lit("_")) & (F.length("term") > 2)).withColumn("weight", F.round("wb", 6))
    w = Window.partitionBy(*keys).orderBy(F.desc("weight"), "term")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(*keys, "rank", "term", "weight")


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """group, term, w: sum of a group's vectors at unit length."""
    return normalised(vectors.groupBy(group, "term").agg(F.sum("w").alias("w")), [group])
