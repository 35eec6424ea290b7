"""TF-IDF over the units of all texts without a row a term: best terms of each text, best terms of groups of texts.

Texts are cut into pieces of some megabytes. A piece sends each of its different terms once, in one message a bucket of terms; buckets add up document frequencies and
answer with numbers in the order of the message. So what is shuffled are packed arrays of a piece's different terms, and terms of one piece alone never leave it again.

A key is a row, as in `vectors.term_table`, whose terms, units and counts these are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.vectors import BIGRAM_WEIGHT, term_lines
from quillspark.sources.tables import materialized, small_batches

#: Characters of a piece's content words (or one longer text).
PIECE = 1 << 22
#: Words whose terms (less than twice as many) a bucket gets, about.
BUCKET = 2_000_000

_PIECES = "piece long, keys array<long>, groups array<string>, words binary, tokens binary, sizes binary, units binary, lines binary, n_units long, n_words long"
_MESSAGES = "bucket int, piece long, terms binary, df binary"
_ANSWERS = "bucket int, piece long, extra binary"
_SUMS = "bucket int, terms binary, w binary, groups array<string>, counts array<long>, rest array<double>"
_FOUND = "group string, term string, w double, squares double"


# ---------------------------------------------------------------- packed arrays

_ZSTD = pa.Codec("zstd", compression_level=6)


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def _loosened(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return _ZSTD.decompress(data[8:], n, asbytes=True) if n else b""


def _packed(values: np.ndarray) -> bytes:
    """Bytes of the same weight stand together, as most numbers are small."""
    return _squeezed(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_loosened(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _packed_strings(strings: pa.Array) -> bytes:
    """Their lengths and their bytes."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int32)[strings.offset:strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int32)
    sizes = _packed(np.diff(ends).astype(np.uint32))
    return len(sizes).to_bytes(8, "little") + sizes + _squeezed(data[ends[0]:ends[-1]].to_pybytes() if ends[-1] else b"")


def _unpacked_strings(data: bytes) -> pa.Array:
    n = 8 + int.from_bytes(data[:8], "little")
    ends = np.append(0, np.cumsum(_unpacked(data[8:n], np.uint32))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(_loosened(data[n:]))])


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


# ---------------------------------------------------------------- pieces

def _piece(number: int, rows: list[tuple]) -> dict:
    """Words of some texts as numbers; units are numbered through, -1: in none. Lines as `vectors.term_lines` gives them."""
    keys, groups, texts, filled = zip(*rows)
    lines = pc.split_pattern(pa.array(texts, pa.string()), "\n")
    n_lines, flat = np.diff(lines.offsets.to_numpy()), lines.flatten()
    is_unit = pc.starts_with(flat, "u").to_numpy(zero_copy_only=False)
    text_of = np.repeat(np.arange(len(rows)), n_lines)
    whole = (np.bincount(text_of[is_unit], minlength=len(rows)) == 0) & np.array(filled, bool)
    units = np.where(is_unit, np.cumsum(is_unit) - 1, -1)
    units = np.where(whole[text_of], int(is_unit.sum()) + text_of, units)  # a text without units is one
    words = pc.split_pattern(pc.utf8_slice_codeunits(flat, 1), " ")
    found = words.flatten()
    some = pc.not_equal(found, "").to_numpy(zero_copy_only=False)
    sizes = np.bincount(np.repeat(np.arange(len(flat)), np.diff(words.offsets.to_numpy()))[some], minlength=len(flat))
    coded = found.filter(pa.array(some)).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    return {"piece": number, "keys": list(keys), "groups": list(groups), "words": _packed_strings(coded.dictionary.take(pa.array(order))),
            "tokens": _packed(rank[coded.indices.to_numpy()]), "sizes": _packed(sizes.astype(np.uint32)), "units": _packed(units.astype(np.int32)),
            "lines": _packed(n_lines.astype(np.uint32)), "n_units": int(is_unit.sum() + whole.sum()), "n_words": len(coded)}


def _pieces(most: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for row in zip(batch["key"], batch["group"], batch["lines"], batch["filled"]):
                if rows and size + len(row[2]) > most:
                    yield pd.DataFrame([_piece(number, rows)])
                    rows, size, number = [], 0, number + 1
                rows.append(row)
                size += len(row[2])
        if rows:
            yield pd.DataFrame([_piece(number, rows)])

    return cut


class Terms:
    """Different terms of a piece (words, and pairs of neighbours within a text), in order of their words."""

    def __init__(self, row):
        self.words = _unpacked_strings(row["words"])
        tokens, sizes = _unpacked(row["tokens"], np.uint32).astype(np.int64), _unpacked(row["sizes"], np.uint32)
        n_lines = _unpacked(row["lines"], np.uint32)
        self.by = len(self.words) + 1
        text = np.repeat(np.repeat(np.arange(len(n_lines)), n_lines), sizes)
        unit = np.repeat(_unpacked(row["units"], np.int32).astype(np.int64), sizes)
        near = np.flatnonzero(text[1:] == text[:-1])
        # a word counts with 0 as its neighbour; each occurrence with its text and unit
        codes = np.concatenate((tokens * self.by, tokens[near] * self.by + tokens[near + 1] + 1))
        self.codes, place = np.unique(codes, return_inverse=True)
        self._place, self._text = place, np.concatenate((text, text[near]))
        self._unit = np.concatenate((unit, np.where(unit[near] == unit[near + 1], unit[near], -1)))
        self.first, self.second = np.divmod(self.codes, self.by)

    def buckets(self, n: int) -> np.ndarray:
        crc = np.array([zlib.crc32(w.encode()) for w in self.words.to_pylist()] + [0], np.uint64)
        mixed = crc[self.first] * np.uint64(0x9E3779B97F4A7C15) + crc[self.second - 1] * np.uint64(0xC2B2AE3D27D4EB4F)  # second 0: the last, 0
        return ((mixed >> np.uint64(33)) % np.uint64(n)).astype(np.int32)

    def frequencies(self) -> np.ndarray:
        """In how many units each term is."""
        inside = self._unit >= 0
        keys = _distinct(self._unit[inside] * len(self.codes) + self._place[inside])
        return np.bincount(keys % max(len(self.codes), 1), minlength=len(self.codes))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and count of each term of each text, by text."""
        keys, n = np.unique(self._text * len(self.codes) + self._place, return_counts=True)
        return *np.divmod(keys, max(len(self.codes), 1)), n

    def strings(self, places: np.ndarray) -> pa.Array:
        first, second = self.words.take(pa.array(self.first[places])), self.second[places]
        both = pc.binary_join_element_wise(first, self.words.take(pa.array(np.maximum(second - 1, 0))), "_")
        return pc.if_else(pa.array(second > 0), both, first)


def _parts(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has terms, with their places in order."""
    order = np.argsort(buckets, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(buckets[order])) + 1):
        if len(part):
            yield int(buckets[part[0]]), part


def _messages(n: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                terms = Terms(row)
                df = terms.frequencies().astype(np.uint32)
                yield pd.DataFrame([(b, row["piece"], _packed_strings(terms.strings(at)), _packed(df[at])) for b, at in _parts(terms.buckets(n))], columns=["bucket", "piece", "terms", "df"])

    return send


def _answers(messages: pd.DataFrame) -> pd.DataFrame:
    """For each term of a message 0, if no other piece has it, else 1 and its units in other pieces."""
    own = [_unpacked(x, np.uint32) for x in messages["df"]]
    coded = pa.concat_arrays([_unpacked_strings(x) for x in messages["terms"]]).dictionary_encode()
    places, df = coded.indices.to_numpy(), np.concatenate(own).astype(np.int64)
    total = np.bincount(places, weights=df).astype(np.int64)  # exact below 2^53
    extra = np.where(np.bincount(places)[places] > 1, total[places] - df + 1, 0)
    cut = np.split(extra, np.cumsum([len(x) for x in own])[:-1])
    return pd.DataFrame({"bucket": messages["bucket"], "piece": messages["piece"], "extra": [_packed(x) for x in cut]})


def _weights(row, answers: pd.DataFrame, buckets: int, total: int) -> tuple[Terms, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A piece's terms, whether other pieces have them, and text, term and weight of each term of each text, at unit length."""
    terms = Terms(row)
    extra, found = np.zeros(len(terms.codes), np.int64), dict(zip(answers["bucket"], answers["extra"]))
    for b, at in _parts(terms.buckets(buckets)):
        extra[at] = _unpacked(found[b], np.int64)
    df = terms.frequencies() + np.maximum(extra - 1, 0)
    factor = np.where(df > 0, np.log((total + 1.0) / (df + 1.0)) + 1, 1.0) * np.where(terms.second > 0, BIGRAM_WEIGHT, 1.0)
    text, term, n = terms.counts()
    w = (np.log(n) + 1) * factor[term]
    return terms, extra > 0, text, term, w / np.sqrt(np.bincount(text, weights=w * w))[text]


class Packed:
    """The pieces of `texts`, written to the shared folder, and the buckets' answers to them."""

    def __init__(self, texts: DataFrame, key: str, text: str = "text", group: str | None = None):
        lines = small_batches(texts).select(F.col(key).cast("long").alias("key"), F.col(group).alias("group") if group else F.lit(None).cast("string").alias("group"),
                                            term_lines(F.col(text)).alias("lines"), (T.strip(F.col(text)) != "").alias("filled"))
        self.pieces = materialized(lines.mapInPandas(_pieces(PIECE), _PIECES), "pieces")
        size = self.pieces.agg(F.coalesce(F.sum("n_units"), F.lit(0)).alias("units"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
        self.total, self.buckets = size.units, 1 + size.words // BUCKET
        self.answers = self.pieces.mapInPandas(_messages(self.buckets), _MESSAGES).groupBy("bucket").applyInPandas(_answers, _ANSWERS)

    def weighed(self, use, schema: str) -> DataFrame:
        """What `use` makes of each piece's `_weights`: rows of the schema."""
        buckets, total = self.buckets, self.total

        def weigh(pieces: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            row = pieces.iloc[0]
            return use(row, *_weights(row, answers, buckets, total))

        return self.pieces.groupBy("piece").cogroup(self.answers.groupBy("piece")).applyInPandas(weigh, schema)


# ---------------------------------------------------------------- best terms of texts

def _rounded(w: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero in binary, as SQL does (weights are positive)."""
    return np.floor(w * 10.0 ** digits + 0.5) / 10.0 ** digits


def best_terms(texts: DataFrame, key: str, most: int, digits: int = 6, text: str = "text") -> DataFrame:
    """key, rank, term, weight (rounded): of each text, by weight, then term."""
    def use(row, terms: Terms, shared, texts_, term, w) -> pd.DataFrame:
        weight = _rounded(w, digits)
        order = np.lexsort((-weight, texts_))
        starts = np.flatnonzero(np.diff(texts_, prepend=-1))
        last = np.minimum(starts + most, np.append(starts[1:], len(texts_))) - 1
        least = np.zeros(len(row["keys"]))
        least[texts_[starts]] = weight[order][last]
        at = np.flatnonzero(weight >= least[texts_])  # with all that tie with the last
        rows = pd.DataFrame({key: np.asarray(row["keys"])[texts_[at]], "text": texts_[at], "term": terms.strings(term[at]).to_pylist(), "weight": weight[at]})
        rows = rows.sort_values(["text", "weight", "term"], ascending=[True, False, True], kind="stable")
        rows["rank"] = rows.groupby("text").cumcount() + 1
        return rows.loc[rows["rank"] <= most, [key, "rank", "term", "weight"]]

    return Packed(texts, key, text).weighed(use, f"{key} long, rank long, term string, weight double")


# ---------------------------------------------------------------- best terms of groups

def _least(group: np.ndarray, w: np.ndarray, n: int, most: int) -> np.ndarray:
    """Of each group the most-th largest weight, 0 if it has fewer."""
    out, order = np.zeros(n), np.lexsort((-w, group))
    starts = np.searchsorted(group[order], np.arange(n + 1))
    has = np.flatnonzero(np.diff(starts) >= most)
    out[has] = w[order][starts[has] + most - 1]
    return out


def _sums(buckets: int, most: int, share: float):
    """A piece's sums by group and term. Terms of this piece alone that are below `share` of the group's most-th best here go only as sums of squares."""
    def use(row, terms: Terms, shared, text, term, w) -> pd.DataFrame:
        names = list(dict.fromkeys(row["groups"]))
        at = {g: i for i, g in enumerate(names)}
        number = np.array([at[g] for g in row["groups"]])
        keys, place = np.unique(number[text] * len(terms.codes) + term, return_inverse=True)
        group, term = np.divmod(keys, max(len(terms.codes), 1))
        w = np.bincount(place, weights=w, minlength=len(keys))
        goes = shared[term] | (w >= share * _least(group, w, len(names), most)[group])
        bucket, rows = terms.buckets(buckets)[term], []
        rest = np.bincount(bucket[~goes] * len(names) + group[~goes], weights=w[~goes] ** 2, minlength=buckets * len(names)).reshape(buckets, -1)
        for b, mine in _parts(bucket):  # by group and term in each
            sent = mine[goes[mine]]
            rows.append((b, _packed_strings(terms.strings(term[sent])), _packed(w[sent]), names, np.bincount(group[sent], minlength=len(names)), rest[b]))
        return pd.DataFrame(rows, columns=["bucket", "terms", "w", "groups", "counts", "rest"])

    return use


def _found(most: int, share: float):
    """A bucket's best terms of each group and its sums of squares."""
    def find(messages: pd.DataFrame) -> pd.DataFrame:
        names = list(dict.fromkeys(g for x in messages["groups"] for g in x))
        at = {g: i for i, g in enumerate(names)}
        group = np.concatenate([np.repeat([at[g] for g in x], n) for x, n in zip(messages["groups"], messages["counts"])]).astype(np.int64)
        coded = pa.concat_arrays([_unpacked_strings(x) for x in messages["terms"]]).dictionary_encode()
        size = max(len(coded.dictionary), 1)
        keys, place = np.unique(group * size + coded.indices.to_numpy(), return_inverse=True)
        w = np.bincount(place, weights=np.concatenate([_unpacked(x, np.float64) for x in messages["w"]]), minlength=len(keys))
        group, term = np.divmod(keys, size)
        squares = np.bincount(group, weights=w * w, minlength=len(names))
        for x, rest in zip(messages["groups"], messages["rest"]):
            np.add.at(squares, [at[g] for g in x], rest)
        best = np.flatnonzero(w >= share * _least(group, w, len(names), most)[group])
        none = [None] * len(names)
        return pd.DataFrame({"group": [names[g] for g in group[best]] + names, "term": coded.dictionary.take(pa.array(term[best])).to_pylist() + none,
                             "w": np.append(w[best], squares * 0), "squares": np.append(w[best] * 0, squares)})

    return find


def best_group_terms(texts: DataFrame, key: str, group: str, most: int, digits: int = 6, text: str = "text") -> DataFrame:
    """group, rank, term, weight (rounded): of the sum of each group's vectors at unit length, by weight, then term."""
    packed = Packed(texts, key, text, group)
    whole = Window.partitionBy("group")
    for share in (0.99, 0.0):
        sums = packed.weighed(_sums(packed.buckets, most, share), _SUMS)
        found = materialized(sums.groupBy("bucket").applyInPandas(_found(most, share), _FOUND), "best")
        rows = found.withColumn("w", F.col("w") / F.sqrt(F.sum("squares").over(whole))).filter("term is not null").withColumn("weight", F.round("w", digits))
        ranked = rows.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("weight"), "term")).cast("long")).filter(F.col("rank") <= most)
        # what was left out is below `share` of the last one found, so it may tie with it only if both round to the same digits
        least = ranked.filter(F.col("rank") == most).agg(F.min("w")).first()[0]
        if share == 0.0 or least is None or least * (1 - share) > 2 * 10.0 ** -digits:
            return ranked.select(F.col("group").alias(group), "rank", "term", "weight")
