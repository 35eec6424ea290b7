"""Byte-level BPE: a minimal acyclic transducer holds frequent words with their ids, the rest is merged.

The corpus is counted once (a mergeable heavy-hitter summary per task, summed by word); the most
frequent words, encoded with the public merge table, are compiled into a minimal acyclic automaton
whose arcs carry word counts, so that a path's sum is the word's place in one array of ids. Its
file (bounded by `lexicon_words`) goes to each executor once and is memory-mapped by all Python workers there.
The different chunks of some texts, if a task has not met them yet, walk the automaton together, a byte a step; those that it does not
accept are cut by the tokenizer's pattern and their pieces merged pair by pair in rank order, exactly.
The lexicon and a task's bounded table of chunks change speed only, never ids.

Defined results: null text is empty text and has no ids; special tokens' strings in a text become
their ids, as the tokenizers library does it; repeated rows are separate; texts of any length are
encoded whole; an empty table gives no rows; `encode_documents` keeps the caller's other columns
unless they have the names of its own.
"""

from __future__ import annotations

import functools
import hashlib
import json
import mmap
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import share_file, small_batches, staged, table

#: How byte-level BPE cuts text (fixed by the public tokenizer's own pattern).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space next to a space, at an end of the text or between chunks of other kinds.
_UNEVEN = re.compile(r"^\s| \s|\s |\s$")
#: A single space between visible characters always starts a new piece.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Longest word in the lexicon, in bytes.
LONGEST = 40
_NONE = np.int32(2**31 - 1)
#: Characters of the texts that are encoded together; their different chunks are looked up and merged in one go.
_TOGETHER = 1_000_000
#: Different chunks whose ids a task keeps.
HELD_CHUNKS = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(shifted)) for b in range(256)]


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all stretches, one after the other."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out


@dataclass
class Lists:
    """Many lists of numbers in one array."""

    starts: np.ndarray
    sizes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, values: np.ndarray | None = None) -> Lists:
        sizes = sizes.astype(np.int64)
        return cls(np.cumsum(sizes) - sizes, sizes, np.zeros(int(sizes.sum()), np.int32) if values is None else values)

    def take(self, which: np.ndarray) -> Lists:
        sizes = self.sizes[which]
        return Lists.of(sizes, self.values[_stretches(self.starts[which], sizes)])

    def joined(self, counts: np.ndarray) -> Lists:
        """So many of the lists in turn as one."""
        owner = np.repeat(np.arange(len(counts)), counts)
        return Lists.of(np.bincount(owner, self.sizes, len(counts)), self.values)

    def each(self) -> Iterator[np.ndarray]:
        for at, n in zip(self.starts.tolist(), self.sizes.tolist()):
            yield self.values[at:at + n]


def decimals(lists: Lists) -> Lists:
    """The lists' numbers as text (bytes), each with a comma behind it."""
    values = lists.values
    digits = np.ones(len(values), np.int64)
    for k in range(1, 10):
        digits += values >= 10 ** k
    out = Lists.of(digits + 1, np.full(int(digits.sum()) + len(values), ord(","), np.uint8))
    last, left = out.starts + digits - 1, values.copy()
    for k in range(int(digits.max(initial=0))):
        on = digits > k
        out.values[last[on] - k] = 48 + left[on] % 10
        left //= 10
    return out.joined(lists.sizes)


class MergeTable:
    """Ids and ranks of a byte-level BPE file; merges single words exactly."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.of_byte = [vocab[c] for c in letters]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for piece, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in piece)
        for piece, i in self.special.items():
            self.bytes_of[i] = piece.encode()
        self._byte_ids = np.array(self.of_byte, np.uint32)
        self._spelled = Lists.of(np.array([len(x) for x in self.bytes_of]), np.frombuffer(b"".join(self.bytes_of), np.uint8))
        pairs = sorted((a << 16 | b, rank) for (a, b), (rank, _) in self.pairs.items())
        self._keys, self._key_ranks = np.array([k for k, _ in pairs], np.uint32), np.array([r for _, r in pairs], np.int32)
        self._joined = np.zeros(len(spec["model"]["merges"]), np.uint32)
        for rank, new in self.pairs.values():
            self._joined[rank] = new
        self.find_pieces = regex.compile(PATTERN).findall
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one piece: of all adjacent pairs, the leftmost one of lowest rank is joined, again and again."""
        of_byte, get = self.of_byte, self.pairs.get
        ids = [of_byte[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        found = [get(p) for p in zip(ids, ids[1:])]
        while True:
            best, at = None, -1
            for i, f in enumerate(found):
                if f is not None and (best is None or f[0] < best[0]):
                    best, at = f, i
            if best is None:
                return ids
            ids[at:at + 2] = [best[1]]
            del found[at]
            if at < len(found):
                found[at] = get((ids[at], ids[at + 1]))
            if at:
                found[at - 1] = get((ids[at - 1], ids[at]))

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for long pieces, with a heap over a linked list, in n log n steps."""
        import heapq

        get, n = self.pairs.get, len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(f[0], i, ids[i], ids[i + 1], f[1]) for i in range(n - 1) if (f := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (f := get((ids[x], ids[y]))):
                    heapq.heappush(heap, (f[0], x, ids[x], ids[y], f[1]))
        return [x for x in ids if x >= 0]

    def merge_all(self, words: list[bytes]) -> Lists:
        """`merge` of many words at once: words of one length are the rows of a matrix, one pair a row is joined in each step."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if not len(rows):
                continue
            if lengths[rows[0]] > LONGEST or len(rows) < 8:
                done += [(rows[i:i + 1], np.array([self.merge(words[r])], np.int32)) for i, r in enumerate(rows.tolist())]
                continue
            place = rows
            raw = np.frombuffer(b"".join([words[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), -1)
            ids = self._byte_ids[raw]
            ranks = self._ranks(ids[:, :-1], ids[:, 1:])
            while True:
                if ids.shape[1] == 1:
                    going = np.zeros(len(ids), bool)
                else:
                    at = ranks.argmin(1)
                    best = ranks[np.arange(len(ids)), at]
                    going = best < _NONE
                if not going.all():
                    done.append((place[~going], ids[~going].astype(np.int32)))
                    if not going.any():
                        break
                    place, ids, ranks, at, best = place[going], ids[going], ranks[going], at[going], best[going]
                n, width = ids.shape
                line, cols = np.arange(n), np.arange(width - 1)
                ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
                ids[line, at] = self._joined[best]
                if width > 2:
                    cols = cols[:-1]
                    ranks = np.take_along_axis(ranks, cols + (cols >= at[:, None]), 1)
                    has = at > 0
                    ranks[line[has], at[has] - 1] = self._ranks(ids[line[has], at[has] - 1], ids[line[has], at[has]])
                    has = at < width - 2
                    ranks[line[has], at[has]] = self._ranks(ids[line[has], at[has]], ids[line[has], at[has] + 1])
        sizes = np.zeros(len(words), np.int64)
        for place, ids in done:
            sizes[place] = ids.shape[1]
        out = Lists.of(sizes)
        for place, ids in done:
            out.values[out.starts[place][:, None] + np.arange(ids.shape[1])] = ids
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << np.uint32(16) | right
        found = np.searchsorted(self._keys, key)
        found[found == len(self._keys)] = 0
        return np.where(self._keys[found] == key, self._key_ranks[found], _NONE)

    def spell(self, ids: Lists) -> Lists:
        """The bytes of each list of ids."""
        return self._spelled.take(ids.values).joined(ids.sizes)

    def encode_chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        for piece in self.find_pieces(chunk):
            out += self.merge(piece.encode())
        return out


# ---------------------------------------------------------------- the transducer

def build_transducer(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton of the words, with their ids, as one block of bytes."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list]] = []  # (final, arcs) of finished states; suffixes are shared

    def finish(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append((node[0], list(node[1])))
        return register[key]

    path, before = [[False, []]], b""  # unfinished nodes along the last word
    words = sorted(entries)
    for word in words:
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        while len(path) > same + 1:
            done = path.pop()
            path[-1][1].append((before[len(path) - 1], finish(done)))
        for _ in word[same:]:
            path.append([False, []])
        path[-1][0], before = True, word
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((before[len(path) - 1], finish(done)))
    root = finish(path[0])

    words_below = [0] * len(states)
    for s, (final, arcs) in enumerate(states):  # a state comes after all it leads to
        words_below[s] = final + sum(words_below[t] for _, t in arcs)
    keys, targets, skips, finals = array("I"), array("I"), array("I"), bytearray()  # arcs by state, then byte
    for s, (final, arcs) in enumerate(states):
        finals.append(final)
        skip = int(final)
        for label, t in arcs:
            keys.append(s << 8 | label)
            targets.append(t)
            skips.append(skip)
            skip += words_below[t]
    starts, ids = array("I"), array("I")
    for word in words:
        starts.append(len(ids))
        ids.extend(entries[word])
    starts.append(len(ids))
    head = array("I", [root, len(states), len(keys), len(words), len(ids)])
    return b"".join([*(a.tobytes() for a in (head, keys, targets, skips, starts, ids)), bytes(finals)])


class Transducer:
    """The block of `build_transducer`, in memory or in a memory-mapped file."""

    def __init__(self, block):
        self.root, n_states, n_arcs, n_words, n_ids = np.frombuffer(block, np.uint32, 5).tolist()
        at, parts = 20, []
        for size in (n_arcs, n_arcs, n_arcs, n_words + 1, n_ids):
            parts.append(np.frombuffer(block, np.uint32, size, at))
            at += 4 * size
        self.arcs, self.targets, self.skips, self.starts, self.ids = parts
        self.finals = np.frombuffer(block, np.uint8, n_states, at)

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        """Of a file; all workers of a node read the same pages."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, -1 if it is not held; all words walk the arcs together, a byte a step."""
        place = np.full(len(words), -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw, offset = np.frombuffer(b"".join(words) or b"\0", np.uint8), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        line = np.flatnonzero(sizes <= LONGEST)
        state, index = np.full(len(line), self.root, np.uint32), np.zeros(len(line), np.int64)
        for i in range(LONGEST + 1):
            over = sizes[line] == i
            if over.any():
                ended = line[over]
                place[ended] = np.where(self.finals[state[over]] == 1, index[over], -1)
                line, state, index = line[~over], state[~over], index[~over]
            if not len(line) or not len(self.arcs):
                break
            key = state << np.uint32(8) | raw[offset[line] + i]
            arc = np.searchsorted(self.arcs, key)
            arc[arc == len(self.arcs)] = 0
            on = self.arcs[arc] == key
            arc, line = arc[on], line[on]
            state, index = self.targets[arc], index[on] + self.skips[arc]
        return place

    def lists(self, places: np.ndarray) -> Lists:
        """The ids of held words by their places."""
        starts = self.starts[places].astype(np.int64)
        sizes = self.starts[places + 1] - starts
        return Lists.of(sizes, self.ids[_stretches(starts, sizes)].astype(np.int32))

    def get(self, word: bytes) -> list[int] | None:
        place = self.places([word])
        return None if place[0] < 0 else self.lists(place).values.tolist()


# ---------------------------------------------------------------- corpus counts

def heavy_words(texts: Iterable[str | None], most: int) -> Counter:
    """Misra-Gries summary of the chunks between spaces: each count is short by at most n / most."""
    counts: Counter = Counter()
    for text in texts:
        if text:
            counts.update(text.split(" "))
            if len(counts) > 8 * most:
                cut = sorted(counts.values(), reverse=True)[most]
                counts = Counter({w: c - cut for w, c in counts.items() if c > cut})
    return Counter(dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]))


def frequent_chunks(documents: DataFrame, most: int) -> list[str]:
    """The `most` most frequent chunks of all texts; what comes to the driver is bounded by `most`."""

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = heavy_words((t for pdf in batches for t in pdf["text"]), most)
        yield pd.DataFrame({"word": list(found), "n": [*found.values()]}, columns=["word", "n"]).astype({"word": object, "n": "int64"})

    top = (
        small_batches(documents.select("text")).mapInPandas(summary, "word string, n long")
        .filter((F.length("word") > 0) & (F.length("word") <= 40) & ~F.col("word").rlike(r"^\s|\s$"))
        .groupBy("word").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word").limit(most)
    )
    return [r.word for r in top.select("word").toLocalIterator()]


# ---------------------------------------------------------------- texts

class Encoder:
    """Encodes and decodes whole texts, so many together. The ids of up to HELD_CHUNKS different chunks stay for the next lot of the task; then it starts anew."""

    def __init__(self, table_: MergeTable, lexicon: Transducer | None):
        self.table, self.lexicon = table_, lexicon
        self._forget()

    def _forget(self) -> None:
        self.chunks, self.sizes, self.ids = _numbering(), array("q"), array("i")

    def _learn(self, new: list[str]) -> None:
        found = self._ids_of(new)
        self.sizes.frombytes(found.sizes.astype(np.int64).tobytes())
        self.ids.frombytes(found.values.astype(np.int32).tobytes())

    def _ids_of(self, chunks: list[str]) -> Lists:
        """Ids of different chunks: the lexicon's, if it accepts them, else merged from their pieces, all at once."""
        place = self.lexicon.places([c.encode("utf-8", "surrogatepass") for c in chunks]) if self.lexicon else np.full(len(chunks), -1)
        held, rest = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        pieces = _numbering()
        cut = list(map(self._pieces, [chunks[i] for i in rest.tolist()]))
        number = np.fromiter(map(pieces.__getitem__, chain.from_iterable(cut)), np.int64)
        merged = self._merged(list(pieces)).take(number).joined(np.fromiter(map(len, cut), np.int64, len(cut)))
        known = self.lexicon.lists(place[held]) if self.lexicon else Lists.of(np.zeros(0, np.int64))
        sizes = np.zeros(len(chunks), np.int64)
        sizes[held], sizes[rest] = known.sizes, merged.sizes
        out = Lists.of(sizes)
        for which, lists in ((held, known), (rest, merged)):
            out.values[_stretches(out.starts[which], lists.sizes)] = lists.values
        return out

    def _pieces(self, chunk: str) -> list[str]:
        """As the tokenizer's pattern cuts the chunk; plain letters are one piece."""
        word = chunk[1:] if chunk.startswith(" ") else chunk
        if word.isalpha() and word.isascii() or chunk in self.table.special:
            return [chunk]
        return self.table.find_pieces(chunk)

    def _merged(self, pieces: list[str]) -> Lists:
        special = self.table.special
        if not special.keys().isdisjoint(pieces):
            # a special token is one id; pieces of plain text never spell one
            plain = [p for p in pieces if p not in special]
            found = iter(self.table.merge_all([p.encode() for p in plain]).each())
            lists = [np.array([special[p]], np.int32) if p in special else next(found) for p in pieces]
            return Lists.of(np.array([len(x) for x in lists]), np.concatenate(lists))
        return self.table.merge_all([p.encode() for p in pieces])

    def cut(self, text: str) -> list[str]:
        """Chunks that are encoded independently of each other; special tokens stand alone."""
        special = self.table.cut_special
        if special and any(s in text for s in self.table.special):
            return [c for part in special.split(text) if part for c in ([part] if part in self.table.special else self._plain(part))]
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not text:
            return []
        if _UNEVEN.search(text):
            # cut only where one space stands between visible characters
            head, *rest = _CUT.split(text)
        else:
            head, *rest = text.split(" ")
        return [head, *[" " + p for p in rest]]

    def encode(self, texts: list[str]) -> Iterator[Lists]:
        """Ids of the texts in turn, about _TOGETHER characters at once."""
        done = 0
        while done < len(texts):
            size, upto = 0, done
            while upto < len(texts) and (upto == done or size + len(texts[upto]) <= _TOGETHER):
                size += len(texts[upto])
                upto += 1
            if len(self.chunks) > HELD_CHUNKS:
                self._forget()
            known = len(self.chunks)
            cut = list(map(self.cut, texts[done:upto]))
            counts = np.fromiter(map(len, cut), np.int64, len(cut))
            number = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
            del cut
            if len(self.chunks) > known:
                self._learn(list(islice(self.chunks, known, None)))
            yield Lists.of(np.array(self.sizes, np.int64), np.array(self.ids, np.int32)).take(number).joined(counts)
            done = upto


def _numbering() -> defaultdict[str, int]:
    """Gives each new key the next number."""
    out: defaultdict[str, int] = defaultdict()
    out.default_factory = out.__len__
    return out


def make_lexicon(documents: DataFrame, vocabulary: str, lexicon_words: int) -> bytes:
    table_ = MergeTable(vocabulary)
    words = [" " + w for w in frequent_chunks(documents, lexicon_words)]
    return build_transducer({w.encode(): table_.encode_chunk(w) for w in words if len(w.encode()) <= LONGEST})


def _lexicon_for(documents: DataFrame, vocabulary: str, lexicon_words: int, block: bytes | None) -> str:
    """The name of the automaton's file on the executors."""
    with staged("lexicon") as f:
        f.write(block if block is not None else make_lexicon(documents, vocabulary, lexicon_words))
    return share_file(documents.sparkSession, f.name)


def _encoder(vocabulary: str, name: str) -> Encoder:
    return Encoder(MergeTable(vocabulary), Transducer.mapped(SparkFiles.get(name)))


def encode_documents(documents: DataFrame, vocabulary: str | None = None, lexicon_words: int = 20_000, block: bytes | None = None) -> DataFrame:
    """All columns plus ids (array of int) and decoded (text from the ids)."""
    vocabulary = vocabulary or default_vocabulary()
    name = _lexicon_for(documents, vocabulary, lexicon_words, block)

    @F.pandas_udf("ids array<int>, decoded string")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary, name)
        for texts in batches:
            ids, decoded = [], []
            for some in encoder.encode([t or "" for t in texts]):
                ids += some.each()
                decoded += [x.tobytes().decode("utf-8", "replace") for x in encoder.table.spell(some).each()]
            yield pd.DataFrame({"ids": ids, "decoded": decoded})

    kept = [c for c in documents.columns if c not in ("ids", "decoded")]
    return small_batches(documents).select(*kept, encode("text").alias("__e")).select(*kept, "__e.ids", "__e.decoded")


def encode_digests(documents: DataFrame, vocabulary: str | None = None, lexicon_words: int = 20_000, block: bytes | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same encoding, digested where it is made."""
    vocabulary = vocabulary or default_vocabulary()
    name = _lexicon_for(documents, vocabulary, lexicon_words, block)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary, name)
        sha = hashlib.sha256
        for pdf in batches:
            sizes, of_ids, of_text = [], [], []
            for some in encoder.encode([t or "" for t in pdf["text"]]):
                sizes += some.sizes.tolist()
                of_ids += [sha(x[:-1]).hexdigest() for x in decimals(some).each()]
                of_text += [sha(x.tobytes().decode("utf-8", "replace").encode()).hexdigest() for x in encoder.table.spell(some).each()]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "n_tokens": np.array(sizes, np.int64), "ids_sha256": of_ids, "decoded_sha256": of_text})

    return small_batches(documents.select("doc_id", "text")).mapInPandas(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
