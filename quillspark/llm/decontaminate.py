"""Benchmark decontamination: a prefix-filtered join of documents with windows of benchmark items.

An item's windows are its runs of `window` words (one run if it is shorter). A window occurs in a
document only if its rarest word does, so that word is the window's necessary prefix: words are
ordered by their frequency over all documents, each window is filed under its rarest word, and a
document's words look up their windows. The place of the word in the window gives the only
position the window can have (positional bound), which has to lie inside the document (length
bound); what remains is compared word for word.

A benchmark whose whole text is at most `broadcast_chars` code points, counted first, is sent to
the tasks. A larger one is joined by shuffles: words with prefixes, then candidates with texts.

Defined results: null or wordless text has no words and is never contaminated; a null item has no
window; equal items each count; repeated rows are judged separately; texts of any length are
judged whole; an empty benchmark contaminates nothing, an empty table gives no rows; other columns
are ignored by `find_contamination` and kept by `drop_contaminated`.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import LOWER_TO_SPACE, materialized, small_batches, table

WINDOW = 13
_RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_TO_SPACE).split() if text else []


def word_frequencies(documents: DataFrame, vocabulary: set[bytes]) -> Counter:
    """In how many documents each word of a (bounded) vocabulary occurs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                found.update(vocabulary.intersection(words_of(text)))
        yield pd.DataFrame({"word": list(found), "n": list(found.values())}).astype({"word": object, "n": "int64"})

    rows = small_batches(documents.select("text")).mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Counter({bytes(r.word): r.n for r in rows.toLocalIterator()})


class PrefixIndex:
    """The windows of all items, each under its rarest word: (item, first word, place of the rarest word, size)."""

    def __init__(self, items: list[tuple[int, list[bytes]]], frequency: Counter, window: int = WINDOW):
        self.items = items
        self.under: dict[bytes, list[tuple[int, int, int]]] = {}
        for k, (_, words) in enumerate(items):
            size = min(window, len(words))
            rank = [(frequency[w], w) for w in words]
            for first in range(len(words) - size + 1) if size else ():
                rarest = min(range(first, first + size), key=rank.__getitem__)
                self.under.setdefault(words[rarest], []).append((k, first, rarest - first, size))

    def hits(self, words: list[bytes]) -> tuple[int, set[int]]:
        """Words inside an occurrence of a window, and the items (by place) whose windows occur."""
        under, items, n = self.under, self.items, len(words)
        marks, found = None, set()
        for p in [p for p, w in enumerate(words) if w in under]:
            for k, first, place, size in under[words[p]]:
                at = p - place
                if at >= 0 and at + size <= n and words[at:at + size] == items[k][1][first:first + size]:
                    if marks is None:
                        marks = bytearray(n)
                    marks[at:at + size] = b"\1" * size
                    found.add(k)
        return (marks.count(1) if marks else 0), found


def _item_digest(ids: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def _broadcast_index(documents: DataFrame, benchmark: DataFrame, window: int):
    items = [(r.item_id, words_of(r.text)) for r in benchmark.select("item_id", "text").collect()]
    index = PrefixIndex(items, word_frequencies(documents, {w for _, words in items for w in words}), window)
    return documents.sparkSession.sparkContext.broadcast(index)


def _is_contaminated(hit: int, words: int) -> bool:
    return hit > 0 and 20 * hit >= words


def _by_broadcast(documents: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    held = _broadcast_index(documents, benchmark, window)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = held.value
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                words = words_of(text)
                hit, found = index.hits(words)
                ids = {index.items[k][0] for k in found}
                rows.append((len(words), hit, len(ids), _item_digest(ids), _is_contaminated(hit, len(words))))
            out = pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return small_batches(documents.select("doc_id", "text")).mapInPandas(judge, _RESULT)


def _word_array(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def _keyed(documents: DataFrame) -> DataFrame:
    """A key for each row, whatever its doc_id, that stays when the rows are read again."""
    return materialized(documents.withColumn("__row", F.monotonically_increasing_id()), "decontaminate-rows")


def _by_shuffle(keyed: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """__row and the result of each row of `_keyed`."""
    docs = materialized(keyed.select("__row", "doc_id", F.coalesce(_word_array(F.col("text")), F.array().cast("array<string>")).alias("words")), "decontaminate-words")
    placed = docs.select("__row", F.size("words").alias("n"), F.posexplode("words").alias("p", "word"))
    size = F.least(F.lit(window), F.size("w"))
    windows = (
        benchmark.select("item_id", _word_array(F.col("text")).alias("w")).filter(F.size("w") > 0)
        .select("item_id", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("first"))
        .select("item_id", "size", F.slice("w", F.col("first"), F.col("size")).alias("run"), F.monotonically_increasing_id().alias("__w"))
    )
    windows = materialized(windows, "decontaminate-windows")
    wanted = windows.select(F.explode("run").alias("word")).distinct()
    frequency = placed.join(wanted, "word", "left_semi").groupBy("word").agg(F.count_distinct("__row").alias("df"))
    order = Window.partitionBy("__w").orderBy(F.coalesce("df", F.lit(0)), "word", "place")
    prefixes = (
        windows.select("__w", F.posexplode("run").alias("place", "word")).join(frequency, "word", "left")
        .withColumn("k", F.row_number().over(order)).filter("k = 1").select("__w", "place", "word")
        .join(windows.select("__w", "size"), "__w")
    )
    fits = (F.col("p") >= F.col("place")) & (F.col("p") - F.col("place") + F.col("size") <= F.col("n"))
    candidates = placed.join(prefixes, "word").filter(fits).select("__row", "__w", (F.col("p") - F.col("place")).alias("at"))
    confirmed = (
        candidates.join(windows, "__w").join(docs.select("__row", "words"), "__row")
        .filter(F.slice("words", F.col("at") + 1, F.col("size")) == F.col("run"))
        .select("__row", "item_id", "at", "size")
    )
    hits = confirmed.select("__row", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("p")).distinct().groupBy("__row").agg(F.count("*").alias("n_hit"))
    found = confirmed.select("__row", "item_id").distinct().groupBy("__row").agg(
        F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("ids"))
    n_words, n_hit = F.size("words").cast("long"), F.coalesce("n_hit", F.lit(0))
    return docs.join(hits, "__row", "left").join(found, "__row", "left").select(
        "__row", "doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * 20 >= n_words)).alias("contaminated"))


def _fits_broadcast(benchmark: DataFrame, broadcast_chars: int) -> bool:
    return (benchmark.agg(F.sum(F.length("text")).alias("n")).first().n or 0) <= broadcast_chars


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_chars: int = 4_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row a document."""
    if _fits_broadcast(benchmark, broadcast_chars):
        return _by_broadcast(documents, benchmark, window)
    return _by_shuffle(_keyed(documents.select("doc_id", "text")), benchmark, window).drop("__row")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_chars: int = 4_000_000) -> DataFrame:
    """The rows that are not contaminated, with all their columns; each is judged by its own text, whatever its doc_id."""
    if not _fits_broadcast(benchmark, broadcast_chars):
        keyed = _keyed(documents)
        bad = _by_shuffle(keyed, benchmark, window).filter("contaminated").select("__row")
        return keyed.join(bad, "__row", "left_anti").drop("__row")
    held = _broadcast_index(documents, benchmark, window)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            cut = [words_of(t) for t in texts]
            yield pd.Series([not _is_contaminated(held.value.hits(words)[0], len(words)) for words in cut], dtype=bool)

    return documents.filter(clean("text"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB SQL for op5: every run of 13 (or fewer) document words against every window.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
runs AS (SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM (SELECT rid, w, s.size, unnest(range(1, len(w) - s.size + 2)) AS i FROM d JOIN (SELECT DISTINCT size FROM windows) s ON len(d.w) >= s.size)),
hits AS (SELECT r.rid, r.i, r.size, x.item_id FROM runs r JOIN windows x ON r.size = x.size AND r.k = x.k),
marked AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN marked m ON d.rid = m.rid LEFT JOIN items i ON d.rid = i.rid
"""
