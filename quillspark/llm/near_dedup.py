"""MinHash near-dedup with odd sketches: banded candidates, parity-bitmap estimates, exact confirmation.

A document is the set of its distinct five-word shingles. 1. Documents of the same words form a
class; the smallest id stands for it from here on. 2. 128 MinHash samples in 32 bands of four give
buckets; at a similarity of 0.75 a pair misses all bands once in 200,000. 3. Each bucket links its
members with its smallest id only. An odd sketch, the samples folded into 512 parity bits, estimates
a pair's similarity from the population count of an XOR; pairs estimated well below the threshold
(by 0.2, about five deviations) go, the others are confirmed on full sets. 4. Connected components
of the confirmed links. 5. Buckets that still hold several components are compared in blocks, sketch
against sketch, across components only; members with a near sketch elsewhere are compared on full
sets, again in blocks, through an inverted index, and one link comes out for each two components
that meet. So the components are those of all confirmed candidate pairs, though no bucket's pairs are
all emitted.

Hashes only propose: sets are counted and compared by the words themselves (`shingle_sets` numbers
the different words and shingles of the texts at hand), never by their hashes.

No key gets more rows than a task holds: the partners of one id are dealt in parts, buckets in blocks
of a bounded number of sketches or bytes of text, and joins on a bucket, a root or a digest have a written
table on each side, so that Spark splits a skewed one. Links, components and signatures stay in tables
of the shared folder; nothing of them is collected.

Defined results: null, empty and wordless texts have an empty set and link with nothing; texts of
fewer than five words are one shingle; texts of any length are read whole; a doc_id that comes
several times is one node of one component (rows are kept, each with its own n_shingles; if its texts differ, it links
as each of them does, and its rows without words follow those with words); an empty table gives no rows; other columns are ignored
by `near_duplicates` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialized, small_batches, table

WORDS = 5
SAMPLES, BANDS = 128, 32
BITS = 512
#: Links have 100 * intersection >= LEAST * union.
LEAST = 75
#: A pair is confirmed on full sets if its estimate is at most this far below the threshold.
SLACK = 0.20
#: Most partners of an id in a part, sketches in a block, and bytes of text in a block, compared in memory.
PART, BLOCK, BLOCK_BYTES = 500, 4_096, 2_000_000
#: Characters of texts whose shingles are numbered together.
_TOGETHER = 1_000_000
#: Bits of the filter that keeps texts of no candidate out of the shuffles.
FILTER_BITS = 1 << 23

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def normal_words(text: str | None) -> bytes:
    """The words, A-Z lower-cased, with single spaces."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b""


@dataclass
class ShingleSets:
    """The distinct shingles of some texts, by owner (place of the text): each one's number and hash.

    Equal numbers are equal words in equal order. Hashes are the same in every batch and only propose candidates.
    """

    owner: np.ndarray
    number: np.ndarray
    hash: np.ndarray

    def sizes(self, texts: int) -> np.ndarray:
        return np.bincount(self.owner, minlength=texts)


def hash_words(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)


def shingle_sets(normal: list[bytes]) -> ShingleSets:
    """Of texts as `normal_words` gives them. Shingles are told apart by the numbers of their words in a dictionary of the texts' words."""
    place: defaultdict[bytes, int] = defaultdict()
    place.default_factory = place.__len__
    cut = [t.split(b" ") if t else [] for t in normal]
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    every = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum())) + 1
    padded = np.where(sizes > 0, np.maximum(sizes, WORDS), 0)
    starts, from_ = np.cumsum(padded) - padded, np.cumsum(sizes) - sizes
    words = np.zeros(int(padded.sum()), np.int64)  # 0, behind texts of fewer than WORDS, is no word
    words[np.arange(len(every)) + np.repeat(starts - from_, sizes)] = every
    n = np.maximum(padded - WORDS + 1, 0)
    owner = np.repeat(np.arange(len(cut)), n)
    at = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(n) - n), n)
    of_word = np.concatenate((np.zeros(1, np.uint64), hash_words(place)))[words]
    hashes = np.full(len(at), _P)
    for i in range(WORDS):
        hashes = _mix(hashes ^ of_word[at + i]) + _P
    order = np.argsort(hashes)
    other = hashes[order[1:]] != hashes[order[:-1]]
    alike = np.flatnonzero(~other)
    if all((words[at[order[alike + 1]] + i] == words[at[order[alike]] + i]).all() for i in range(WORDS)):
        number = np.empty(len(at), np.int64)
        number[order] = np.concatenate((np.zeros(min(1, len(at)), np.int64), np.cumsum(other)))
    else:  # different shingles of one hash
        number = _numbered([words[at + i] for i in range(WORDS)])
    first = np.unique(owner * np.int64(number.max(initial=0) + 1) + number, return_index=True)[1]
    return ShingleSets(owner[first], number[first], hashes[first])


def _numbered(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each different row of the columns."""
    number = columns[0]
    for c in columns[1:]:
        number = np.unique(number * np.int64(c.max(initial=0) + 1) + c, return_inverse=True)[1]
    return number


@functools.lru_cache(maxsize=1)
def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    return rng.integers(0, 1 << 32, (SAMPLES, 1), np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, (SAMPLES, 1), np.uint32)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    a, b = _hash_family()
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 4_096):
        np.minimum(best, (a * short[i:i + 4_096] + b).min(1), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key a band, for the rows of `samples`."""
    rows = SAMPLES // BANDS
    part = samples.astype(np.uint64).reshape(len(samples), BANDS, rows)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _P, part.shape[:2])
    for r in range(rows):
        key = _mix(key ^ part[:, :, r]) * _P
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """BITS parity bits for each row of samples, in 64-bit words: each sample flips one bit."""
    at = _mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    flat = at.astype(np.int64) + np.arange(len(samples))[:, None] * BITS
    odd = (np.bincount(flat.ravel(), minlength=len(samples) * BITS) & 1).astype(np.uint8).reshape(len(samples), BITS)
    return np.packbits(odd, axis=1).view(np.int64)


def most_differing_bits(slack: float = SLACK) -> int:
    """The largest XOR population count of a pair whose estimated similarity may be a link's.

    With k samples in n bits, E[count] = n/2 (1 - exp(-4 k (1 - J) / n)).
    """
    apart = 1 - LEAST / 100 + slack
    return int(np.floor(BITS / 2 * (1 - np.exp(-4 * SAMPLES * apart / BITS))))


def _in_turn(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about _TOGETHER bytes, with the place of their first."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= _TOGETHER):
            size += len(texts[upto])
            upto += 1
        yield at, texts[at:upto]
        at = upto


def sign(documents: DataFrame) -> DataFrame:
    """doc_id, digest of the words, n_shingles, n_bytes, keys of the bands, odd sketch: one row a document."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, normal = pdf["doc_id"].to_numpy(), list(map(normal_words, pdf["text"]))
            for at, texts in _in_turn(normal):
                sets = shingle_sets(texts)
                sizes, hashes = sets.sizes(len(texts)), sets.hash
                ends = np.cumsum(sizes)
                samples = np.stack([min_hashes(hashes[e - n:e]) for e, n in zip(ends, sizes)])
                yield pd.DataFrame({
                    "doc_id": ids[at:at + len(texts)], "digest": [hashlib.blake2b(t, digest_size=16).digest() for t in texts], "n_shingles": sizes,
                    "n_bytes": np.fromiter(map(len, texts), np.int64, len(texts)), "keys": list(band_keys(samples)), "sketch": list(odd_sketches(samples))})

    return small_batches(documents.select("doc_id", "text")).mapInPandas(
        scan, "doc_id long, digest binary, n_shingles long, n_bytes long, keys array<long>, sketch array<long>")


def deal(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, n) in parts: rows (b, parts, salt, is_a, id), one for b in each part and one for each of its a.

    n bounds the partners that b has in one bucket, so a part has PART of them for each of b's bands at most.
    """
    sized = pairs.groupBy("a", "b").agg(F.ceil(F.max("n") / PART).cast("int").alias("parts"))
    mine = sized.select("b", "parts", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("salt"), F.lit(1).alias("is_a"), F.col("a").alias("id"))
    hubs = sized.select("b", "parts").distinct().select(
        "b", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("is_a"), F.col("b").alias("id"))
    return mine.unionByName(hubs)


def meet(dealt: DataFrame, own: DataFrame, linked: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """(a, b, parts) of those pairs of `deal` that `linked` marks among the rows of its parts, b's rows first; own: id and what to compare."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            part = rest[["b", "parts", "salt"]]
            last = (part == part.iloc[-1]).all(axis=1).to_numpy() if len(rest) else np.zeros(0, bool)
            yield found(rest[~last])
            rest = rest[last]
            if len(rest) > 2 * PART:  # b's rows stay for those to come
                yield found(rest)
                rest = rest[rest["is_a"] == 0]
        if rest is not None:
            yield found(rest)

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        hit = rows[linked(rows)] if len(rows) else rows
        return pd.DataFrame({"a": hit["id"], "b": hit["b"], "parts": hit["parts"]})

    rows = small_batches(dealt.join(own, "id"))
    return rows.repartition("b", "parts", "salt").sortWithinPartitions("b", "parts", "salt", "is_a").mapInPandas(check, "a long, b long, parts int")


def _parts_of(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of b's rows and of its partners' rows, part by part."""
    part = rows[["b", "parts", "salt"]].to_numpy()
    edges = np.flatnonzero((part[1:] != part[:-1]).any(1)) + 1
    is_a = rows["is_a"].to_numpy() == 1
    for places in np.split(np.arange(len(rows)), edges):
        yield places[~is_a[places]], places[is_a[places]]


def _near_sketches(rows: pd.DataFrame, cut: int) -> np.ndarray:
    words = np.stack(rows["sketch"].to_numpy()).astype(np.int64)
    out = np.zeros(len(rows), bool)
    for hubs, mine in _parts_of(rows):
        for h in hubs:
            # unsigned, as bitwise_count takes the absolute value of a signed number
            out[mine] |= np.bitwise_count((words[mine] ^ words[h]).view(np.uint64)).sum(1, dtype=np.int64) <= cut
    return out


def _same_sets(rows: pd.DataFrame) -> np.ndarray:
    """Which partners reach the threshold with one of b's texts, on full sets."""
    out, texts = np.zeros(len(rows), bool), rows["text"].to_numpy()
    for hubs, mine in _parts_of(rows):
        first = [normal_words(t) for t in texts[hubs]]
        for at, some in _in_turn([normal_words(t) for t in texts[mine]]):
            sets = shingle_sets(first + some)
            sizes, k = sets.sizes(len(first) + len(some)), len(first)
            for h in range(k):
                hub = np.zeros(int(sets.number.max(initial=0)) + 1, bool)
                hub[sets.number[sets.owner == h]] = True
                both = np.bincount(sets.owner, hub[sets.number], minlength=len(sizes))
                linked = (both > 0) & (100 * both >= LEAST * (sizes + sizes[h] - both))
                out[mine[at:at + len(some)]] |= linked[k:]
    return out


def thinned(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, ...) whose id may be among `ids`; every row whose id is stays, so a join after it is unchanged.

    The ids' hashes set bits of a map of FILTER_BITS, which as a table has FILTER_BITS / 64 rows at
    most whatever the input, and is broadcast. More ids make it let more rows through.
    """
    hashed = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (hashed % 64).cast("int"))
    table_ = ids.select(F.floor(hashed / 64).cast("int").alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = rows.withColumn("__word", F.floor(hashed / 64).cast("int")).join(F.broadcast(table_), "__word")
    return marked.filter(F.col("__bits").bitwiseAND(bit) != 0).drop("__word", "__bits")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """node, root (smallest node reachable) for every node of a link (a, b), by alternating large and small stars."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.filter("b < a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")) if large else both.groupBy("a").agg(F.min("b").alias("m"))
        least = materialized(least, f"{name}-least")  # a root has all its component's edges: both sides are tables, so that Spark splits it
        met = both.join(least, "a")
        if large:
            return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        moved = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialized(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    before, now = None, mark(edges)
    while now != before:
        edges = materialized(star(materialized(star(edges, True), name), False), name)
        before, now = now, mark(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (key, blocks, id, ...) of a bucket in its number of blocks; every two blocks of it meet in one group (key, i, j)."""
    return (
        rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")
    )


def _near_others(pdf: pd.DataFrame, cut: int) -> pd.DataFrame:
    """The members of two blocks whose sketch is near one of another component."""
    left, right = pdf[pdf["block"] == pdf["i"].iloc[0]], pdf[pdf["block"] == pdf["j"].iloc[0]]
    hit_left, hit_right = np.zeros(len(left), bool), np.zeros(len(right), bool)
    if len(left) and len(right):
        words, roots = np.stack(right["sketch"].to_numpy()).astype(np.int64), right["root"].to_numpy()
        for k, (root, sketch) in enumerate(zip(left["root"], left["sketch"])):
            # unsigned, as bitwise_count takes the absolute value of a signed number
            near = (np.bitwise_count((words ^ sketch).view(np.uint64)).sum(1, dtype=np.int64) <= cut) & (roots != root)
            hit_left[k] = near.any()
            hit_right |= near
    return pd.concat([left[hit_left], right[hit_right]])[["key", "id", "root", "n_bytes"]]


def _links_in_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between components of two blocks, one for each two components that meet, by exact intersections.

    The right block's shingles form an inverted index; a text of the left one counts its
    intersections with all of them at once.
    """
    left, right = pdf[pdf["block"] == pdf["i"].iloc[0]], pdf[pdf["block"] == pdf["j"].iloc[0]]
    found: list[tuple[int, int]] = []
    if len(left) and len(right) and pdf["root"].nunique() > 1:
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        sets = shingle_sets([normal_words(t) for t in (right["text"] if same else pd.concat([right["text"], left["text"]]))])
        n_right = len(right)
        sizes, ends = sets.sizes(n_right if same else n_right + len(left)), np.searchsorted(sets.owner, np.arange(n_right + len(left)), side="right")
        ids, roots = right["id"].to_numpy(), right["root"].to_numpy().copy()
        in_right = sets.owner < n_right
        order = np.argsort(sets.number[in_right], kind="stable")
        every, owner = sets.number[in_right][order], sets.owner[in_right][order]
        largest = pdf["root"].mode().iloc[0]
        mine = left["root"].to_numpy().copy()
        # a pair of different components has a member outside the largest; within one block that one is on the left
        rows = np.flatnonzero(mine != largest) if same else np.arange(len(left))
        left_ids = left["id"].to_numpy()
        for k in rows:
            if (roots == mine[k]).all():
                continue
            place = k if same else n_right + k
            own = sets.number[ends[place] - sizes[place]:ends[place]]
            lo, hi = np.searchsorted(every, own), np.searchsorted(every, own, side="right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=n_right)
            linked = (both > 0) & (100 * both >= LEAST * (len(own) + sizes[:n_right] - both))
            while (open_ := linked & (roots != mine[k])).any():
                hit = int(np.flatnonzero(open_)[0])
                found.append((left_ids[k], ids[hit]))
                old, new = roots[hit], mine[k]
                roots[roots == old], mine[mine == old] = new, new
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": pairs.max(1, initial=-(2**63)), "b": pairs.min(1, initial=2**63 - 1)})


def _across_components(members: DataFrame, signed: DataFrame, roots: DataFrame, texts_of: Callable[[DataFrame], DataFrame], cut: int) -> DataFrame | None:
    """Links (a, b) between different components that share a bucket; None if no bucket holds two."""
    rooted = materialized(
        members.filter("n > 2").join(roots, F.col("id") == F.col("node"), "left")
        .select("key", "id", F.coalesce("root", "id").alias("root")), "dedup-rooted")
    mixed = materialized(
        rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        .filter("lo <> hi").select("key", "blocks"), "dedup-mixed")
    if mixed.isEmpty():
        return None
    rest = _blocks(rooted.join(mixed, "key").join(signed.select("id", "sketch", "n_bytes"), "id"))
    near = materialized(rest.groupBy("key", "i", "j").applyInPandas(
        lambda pdf: _near_others(pdf, cut), "key long, id long, root long, n_bytes long").distinct(), "dedup-near")
    sizes = materialized(near.groupBy("key").agg(F.ceil(F.sum("n_bytes") / BLOCK_BYTES).cast("int").alias("blocks")), "dedup-sizes")
    dealt = _blocks(near.drop("n_bytes").join(sizes, "key").join(texts_of(near.select("id")), "id"))
    return materialized(dealt.groupBy("key", "i", "j").applyInPandas(_links_in_blocks, "a long, b long").distinct(), "dedup-links")


def near_duplicates(documents: DataFrame, slack: float = SLACK) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same words), component_id, kept: one row a document."""
    cut = most_differing_bits(slack)
    signed = materialized(sign(documents), "dedup-signatures")
    filled = signed.filter("n_shingles > 0")
    classes = materialized(
        filled.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.min_by(F.struct("keys", "sketch", "n_bytes"), "doc_id").alias("own")), "dedup-classes")
    one_each = classes.select(F.col("class_id").alias("id"), "own.*")
    placed = materialized(
        signed.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "class_id"), "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("class_id")), "doc_id").alias("class_id")), "dedup-placed")
    repeated = materialized(
        placed.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(F.when(F.col("n_shingles") > 0, F.col("class_id"))).alias("b"))
        .filter("rows > 1 AND b IS NOT NULL").drop("rows"), "dedup-repeated")
    # a doc_id with several texts ties their classes
    ties = placed.filter("n_shingles > 0").join(repeated, "doc_id").select(F.col("class_id").alias("a"), "b").filter("a <> b")

    banded = one_each.select("id", F.explode("keys").alias("key"))
    hubs = materialized(banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1"), "dedup-hubs")
    members = materialized(banded.join(hubs, "key"), "dedup-buckets")
    sketches = one_each.select("id", "sketch")
    pairs = members.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"), "n")
    near = materialized(meet(deal(pairs), sketches, lambda rows: _near_sketches(rows, cut)).distinct(), "dedup-near")
    texts = documents.select(F.col("doc_id").alias("id"), "text")
    dealt = materialized(deal(near.select("a", "b", (F.col("parts") * PART).alias("n"))), "dedup-pairs")
    unique = repeated.isEmpty()

    def texts_of(ids: DataFrame) -> DataFrame:
        found = thinned(texts, ids)
        return found if unique else found.distinct()  # an id repeated with the same text counts once

    links = materialized(meet(dealt, texts_of(dealt.select("id")), _same_sets).select("a", "b").unionByName(ties).distinct(), "dedup-links")
    roots = components(links, "dedup-stars")
    more = _across_components(members, one_each, roots, texts_of, cut)
    if more is not None and not more.isEmpty():
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(stars.unionByName(more), "dedup-stars")
    component = F.coalesce("root", "class_id")
    if not unique:  # rows without words follow their id's others
        own = repeated.select(F.col("doc_id").alias("__id"), "b")
        placed = placed.join(own, F.col("doc_id") == F.col("__id"), "left").withColumn("class_id", F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.coalesce("b", "class_id")))
    return placed.join(roots, F.col("class_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", "class_id", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest id, with all columns; all rows of a doc_id stay or go together."""
    bad = near_duplicates(documents).filter(~F.col("kept")).select("doc_id")
    return documents.join(bad, "doc_id", "left_anti")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
