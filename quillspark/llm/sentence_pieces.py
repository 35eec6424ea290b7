"""SentencePiece (BPE) by a table of distinct chunks: each distinct marked word is segmented once, ids come back by position.

In the marked text every space is the marker U+2581, with one more in front. In a vocabulary whose pieces have
markers only at their start no piece crosses from a word to the next marker, so a run of markers with the word behind it is a chunk of its own; and a
character that is in no longer piece (line ends, rare scripts) is one too. `Pieces` checks the vocabulary and refuses others.

A task cuts its texts, some characters at a time, into chunks, numbers the different ones, segments those that its table doesn't
hold yet, and takes the ids of all positions from the table as arrays. The table starts anew when it has TABLE_CHUNKS
chunks, so memory is bounded; what it holds changes speed only, never ids. Documents do not meet: no shuffle.

Defined results: null text is empty text and has the begin and end ids only; names of control pieces in a text are plain characters; U+2581 in a text is
decoded as a space, as the library does it; texts of any length are encoded whole; ties between equal scores go to the leftmost pair; repeated rows are
separate; an empty table gives no rows; `encode_pieces` keeps the caller's other columns unless they have the names of its own.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bpe import Lists
from quillspark.llm.common import small_batches, table

MARK = "▁"
#: Distinct chunks that a task remembers, and characters that it cuts at once.
TABLE_CHUNKS, _TOGETHER = 200_000, 1_000_000
#: Kinds of pieces in a model file (fixed values of its format).
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Scores and ids of a BPE model file; segments single chunks exactly."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("a BPE model with byte fallback, a leading marker and no normalisation is needed")
        kinds = [p.type for p in model.pieces]
        if not {*kinds} <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("user-defined and unused pieces are not known here")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece has a marker behind another character")
        names = {p.piece: i for i, p in enumerate(model.pieces)}
        self.begin, self.end = names[trainer.bos_piece], names[trainer.eos_piece]
        self._single = {p: i for p, i in normal.items() if len(p) == 1}
        self._of_byte = [names[f"<0x{b:02X}>"] for b in range(256)]
        #: by the ids of two neighbours: (what joins first is least, the id of both together)
        self._pairs: dict[tuple[int, int], tuple[float, int]] = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = normal.get(piece[:cut]), normal.get(piece[cut:])
                if left is not None and right is not None:
                    self._pairs[left, right] = (-model.pieces[i].score, i)
        inner = {c for p in normal if len(p) > 1 for c in p} - {MARK}
        if not inner <= self._single.keys():
            raise ValueError("a character of a longer piece is no piece itself")
        word = "[" + "".join(map(re.escape, sorted(inner))) + "]"
        #: markers with the word behind them, a word behind something else, or a character that nothing joins
        self.cut = re.compile(f"{MARK}+{word}*|{word}+|.", re.DOTALL).findall
        spelled = [b""] * len(kinds)
        for p, i in normal.items():
            spelled[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self._of_byte):
            spelled[i] = bytes([b])
        self._spelled = Lists.of(np.array([len(x) for x in spelled]), np.frombuffer(b"".join(spelled), np.uint8))

    def segment(self, chunk: str) -> list[int]:
        """Ids of one chunk: of all neighbours, the leftmost pair of best score is joined, again and again."""
        ids: list[int] = []
        for c in chunk:
            i = self._single.get(c)
            if i is None:
                ids += [self._of_byte[b] for b in c.encode("utf-8", "surrogatepass")]
            else:
                ids.append(i)
        if len(ids) > 40:
            return self._segment_long(ids)
        get = self._pairs.get
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

    def _segment_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps: a heap of pairs over a linked list."""
        get, n = self._pairs.get, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(f[0], i, i + 1, ids[i], ids[i + 1], f[1]) for i in range(n - 1) if (f := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, j, a, b, both = heapq.heappop(heap)
            if ids[i] != a or ids[j] != b or after[i] != j:
                continue  # one of them has been joined since
            ids[i], ids[j], after[i] = both, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (f := get((ids[x], ids[y]))):
                    heapq.heappush(heap, (f[0], x, y, ids[x], ids[y], f[1]))
        return [x for x in ids if x >= 0]

    def spell(self, ids: Lists) -> Iterator[str]:
        """The text of each list of ids: the first marker goes, bytes that are no UTF-8 become U+FFFD."""
        for raw in self._spelled.take(ids.values).joined(ids.sizes).each():
            yield raw.tobytes().removeprefix(b" ").decode("utf-8", "replace")


class ChunkTable:
    """The distinct chunks seen so far with their ids."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.place: defaultdict[str, int] = defaultdict()
        self.place.default_factory = self.place.__len__
        self._sizes, self._ids = array("q"), array("i")

    def encode(self, texts: list[str]) -> Iterator[Lists]:
        """Ids of the texts in turn, without begin and end, about _TOGETHER characters at once."""
        done = 0
        while done < len(texts):
            size, upto = 0, done
            while upto < len(texts) and (upto == done or size + len(texts[upto]) <= _TOGETHER):
                size += len(texts[upto])
                upto += 1
            if len(self.place) > TABLE_CHUNKS:
                self._forget()
            known = len(self.place)
            cut = [self.pieces.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts[done:upto]]
            counts = np.fromiter(map(len, cut), np.int64, len(cut))
            position = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
            del cut
            for chunk in islice(self.place, known, None):
                ids = self.pieces.segment(chunk)
                self._sizes.append(len(ids))
                self._ids.extend(ids)
            held = Lists.of(np.array(self._sizes, np.int64), np.array(self._ids, np.int32))
            yield held.take(position).joined(counts)
            done = upto


@functools.lru_cache(maxsize=1)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_pieces(documents: DataFrame, model: str | None = None) -> DataFrame:
    """All columns plus ids (array of int, with begin and end) and decoded (text from the ids)."""
    path = model or default_model()

    @F.pandas_udf("ids array<int>, decoded string")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(path)
        held = ChunkTable(pieces)
        for texts in batches:
            ids, decoded = [], []
            for some in held.encode([t or "" for t in texts]):
                ids += [np.concatenate(([pieces.begin], x, [pieces.end])) for x in some.each()]
                decoded += pieces.spell(some)
            yield pd.DataFrame({"ids": ids, "decoded": decoded})

    kept = [c for c in documents.columns if c not in ("ids", "decoded")]
    return small_batches(documents).select(*kept, encode("text").alias("__e")).select(*kept, "__e.ids", "__e.decoded")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_model()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces, sha = _pieces(path), hashlib.sha256
        held = ChunkTable(pieces)
        begin, end = (int(i).to_bytes(4, "little") for i in (pieces.begin, pieces.end))
        for texts in batches:
            sizes, of_ids, of_text = [], [], []
            for some in held.encode([t or "" for t in texts]):
                sizes += (some.sizes + 2).tolist()
                of_ids += [sha(begin + x.astype("<u4").tobytes() + end).hexdigest() for x in some.each()]
                of_text += [sha(t.encode()).hexdigest() for t in pieces.spell(some)]
            yield pd.DataFrame({"n_tokens": np.array(sizes, np.int64), "ids_sha256": of_ids, "decoded_sha256": of_text})

    documents = small_batches(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
