"""Periodic runs of words: maximal stretches that repeat with a smallest period, found by probing a harmonic grid.

A run of period p and length max(LEAST_WORDS, LEAST_TIMES * p) at least has so many equal words p apart that two neighbouring
points jp and (j+1)p of p's grid lie among them. So each period tests its own grid, n / p points, together n log n, as
arrays; neighbours that are both equal survive, and are extended to either side by array comparison in
growing chunks. Periods come in ascending order, so the first that finds a stretch is its smallest one. Grid points within a run already found are skipped:
if jp and (j+1)p lie in a run whose period divides p they would give that run again, and if (j+2)p does too, nothing else can be there, as two runs
that share as many words as both periods together have one period.

A document is one row and its words are numbers of its own; arrays of a grid have GRID_POINTS entries at most. Documents
do not meet: no shuffle.

Defined results: null, empty and blank texts have no words and no runs; texts of any length are read whole; runs may overlap, and of equal exponents the
smallest start, then the smallest period is the greatest; repeated rows are treated separately; an empty table gives no rows; `find_runs` and `collapse_runs`
keep other columns unless they have the names of their own.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import small_batches, table

LEAST_WORDS, LEAST_TIMES = 24, 3
GRID_POINTS = 1_000_000
#: Texts of fewer words share one grid.
SHORT = 4_096
_CHUNK, _LONGEST_CHUNK = 32, 65_536


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for identical ones."""
    place: defaultdict[bytes, int] = defaultdict()
    place.default_factory = place.__len__
    return np.fromiter(map(place.__getitem__, words), np.int64, len(words))


@functools.lru_cache(maxsize=1)
def _short_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """jp, p and (j+2)p < SHORT, by the last: a shorter text needs a first part of them."""
    at, period = map(np.concatenate, zip(*_grid_blocks(SHORT)))
    last = at + 2 * period
    order = np.argsort(last, kind="stable")
    return at[order], period[order], last[order]


def _grid_blocks(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All jp and p with p <= n / LEAST_TIMES and (j+2)p < n, some periods at a time, in ascending order."""
    last = n // LEAST_TIMES
    first = 1
    while first <= last:
        upto = min(last + 1, first + max(1, GRID_POINTS * first // n))  # no period of the block has more than n / first points
        periods = np.arange(first, upto)
        points = np.maximum((n - 1) // periods - 1, 0)
        period = np.repeat(periods, points)
        ends = np.cumsum(points)
        yield (np.arange(len(period)) - np.repeat(ends - points, points)) * period, period
        first = upto


def _survivors(words: np.ndarray, known: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """(period, jp) where the words at jp, (j+1)p and (j+2)p are the same and lie in no known run, in ascending order."""
    n = len(words)
    if n <= SHORT:
        at, period, last = _short_grid()
        fits = int(np.searchsorted(last, n))
        blocks = iter([(at[:fits], period[:fits])])
    else:
        blocks = _grid_blocks(n)
    for at, period in blocks:
        on = words[at] == words[at + period]
        at, period = at[on], period[on]
        for part in (1, 2, 4):  # all words between the two points repeat too: a few of them first
            probe = at + period // part
            on = words[probe] == words[probe + period]
            at, period = at[on], period[on]
        new = ~known(at, period)
        at, period = at[new], period[new]
        order = np.lexsort((at, period))
        yield from zip(period[order].tolist(), at[order].tolist())


def _upto(words: np.ndarray, at: int, p: int) -> int:
    """The first place from `at` on whose word differs from that p further, or the last possible one."""
    end, chunk = len(words) - p, _CHUNK
    while at < end:
        stop = min(end, at + chunk)
        differ = words[at:stop] != words[at + p:stop + p]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, chunk = stop, min(2 * chunk, _LONGEST_CHUNK)
    return end


def _downto(words: np.ndarray, at: int, p: int) -> int:
    """The least place from which on all words before `at` equal those p further."""
    chunk = _CHUNK
    while at > 0:
        start = max(0, at - chunk)
        differ = (words[start:at] != words[start + p:at + p])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return at - k
        at, chunk = start, min(2 * chunk, _LONGEST_CHUNK)
    return 0


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    if len(words) < LEAST_WORDS:
        return []
    found: dict[tuple[int, int], int] = {}
    # of the runs found, the one that goes on longest at each place: where it ends, and its period
    end, root = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)

    def known(at, p):
        return (at + 2 * p < end[at]) | (at + p < end[at]) & (p % root[at] == 0)

    period = checked = 0
    for p, at in _survivors(words, known):
        if p != period:
            period, checked = p, 0
        if at < checked or known(at, p):
            continue
        start, stop = _downto(words, at, p), _upto(words, at, p)
        checked = stop
        length = stop + p - start
        if length >= max(LEAST_WORDS, LEAST_TIMES * p) and (start, length) not in found:
            found[start, length] = p
            within = slice(start, start + length)
            root[within] = np.where(end[within] < start + length, p, root[within])
            np.maximum(end[within], start + length, out=end[within])
    return sorted((start, length, p) for (start, length), p in found.items())


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if each run keeps its first period only."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, p in runs:
        edges[start + p] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared as fractions."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find_runs(documents: DataFrame) -> DataFrame:
    """All columns plus runs: array of (start, length, period) in words, by start and period."""

    @F.pandas_udf("array<struct<start:long,length:long,period:long>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("start", "length", "period"), r)) for r in runs_of(numbered((t or "").encode("utf-8", "surrogatepass").split()))] for t in texts])

    return small_batches(documents).withColumn("runs", find("text"))


def collapse_runs(documents: DataFrame) -> DataFrame:
    """The documents with each run cut to its first period; texts without a run stay as they are. An n_chars column follows the text."""

    @F.pandas_udf("string")
    def collapse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                words = (t or "").encode("utf-8", "surrogatepass").split()
                runs = runs_of(numbered(words))
                out.append(b" ".join([words[i] for i in np.flatnonzero(collapsed(len(words), runs)).tolist()]).decode("utf-8", "surrogatepass") if runs else t)
            yield pd.Series(out, dtype=object)

    done = small_batches(documents).withColumn("text", collapse("text"))
    if "n_chars" in documents.columns:
        done = done.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return done


def planted(words: list[bytes], h: int | None) -> list[bytes]:
    """The query's words, h the crc32 of the id: in one of ten documents the words from some place on repeat with some period."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    def digest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for texts, hashes in batches:
            rows = []
            for text, h in zip(texts, hashes):
                words = planted((text or "").encode("utf-8", "surrogatepass").split(), None if pd.isna(h) else int(h))
                runs = runs_of(numbered(words))
                best = greatest(runs)
                kept = b" ".join([words[i] for i in np.flatnonzero(collapsed(len(words), runs)).tolist()] if runs else words)
                rows.append((len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(kept)))
            out = pd.DataFrame(rows, columns=["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])
            yield out.astype({c: "Int64" for c in ("start", "length", "period", "exponent_milli")})

    documents = small_batches(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", digest("text", F.crc32(F.col("doc_id").cast("string"))).alias("d")).select("doc_id", "d.*")
