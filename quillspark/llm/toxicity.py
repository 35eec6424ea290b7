"""Toxicity: words as bags of character n-grams, embeddings averaged into a linear softmax, trained jointly.

A token's bag holds its n-grams of 3 to 6 characters (with marks for its ends) and the token itself,
hashed into `buckets` rows of an embedding matrix; the mean of the rows goes through a linear
softmax over two classes. Labels belong to documents, so training is by multiple instances: a
toxic document's instances are the tokens that the model finds toxic (at first, those with an
n-gram that toxic documents have far more often), tokens of clean documents are the others; after
each round the choice is made again. Misspelt copies of the chosen tokens are added. A document is
scored by logistic curves over a soft maximum and the number of toxic tokens, fitted to training documents that the
embeddings have not seen.

The softmax is linear in the mean, so scoring keeps one number a bucket. At most `rows_a_class`
labelled documents a class are used, chosen by a hash of the id; from their clean documents training
takes at most `most_negative` different tokens, the most frequent quarter of them first and the rest at random.

A run of more than 64 characters without white space is read part by part between its punctuation,
and a part that is still longer (a script without spaces) as pieces of 20 characters, one from every
tenth, in training and in scoring; so all of it is read, and a word of at most 11 characters is
whole in some piece.

Defined results: null, empty and wordless texts score 0; texts of any length are scored whole;
without training documents of both classes all scores are 0; null labels are not learned from;
repeated rows are scored separately; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_sample, labelled_fold, small_batches, table

SIZES = (3, 4, 5, 6)
_EDGE_OPEN, _EDGE_CLOSE = 2, 3
_PRIME, _MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)
_CACHE = 300_000
_LONG, _PIECE, _STEP = 64, 20, 10
_JOINTS = re.compile("[" + re.escape("".join(sorted(set(string.punctuation) - set("@!$*")))) + "]+")  # what stands for a letter joins nothing
_AT_ONCE = 50_000  # words whose n-grams are in memory together


def tokens_of(text: str | None) -> list[str]:
    """Runs between white space; one of more than _LONG characters as its parts between punctuation, and those as overlapping pieces."""
    tokens = text.split() if text else []
    if max(map(len, tokens), default=0) <= _LONG:
        return tokens
    out = []
    for t in tokens:
        for part in [t] if len(t) <= _LONG else _JOINTS.split(t):
            out += [part] if len(part) <= _LONG else [part[i:i + _PIECE] for i in range(0, len(part) - _PIECE + _STEP, _STEP)]
    return out


def _clean(token: str) -> str:
    return token.strip(string.punctuation).lower()


def bags(words: list[str], buckets: int, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all n-grams of all words, sorted by word, and how many each word has."""
    marked = "".join(chr(_EDGE_OPEN) + w + chr(_EDGE_CLOSE) for w in words)
    symbols = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    opens = symbols == _EDGE_OPEN
    word = np.cumsum(opens) - 1
    at = np.arange(len(symbols)) - np.flatnonzero(opens)[word]  # place in the word
    ids, owner = [], []
    rolling = np.zeros(len(symbols), np.uint64)
    for n in range(1, max(sizes) + 1):
        if n <= len(symbols):
            rolling[n - 1:] += (symbols[:len(symbols) - n + 1] + np.uint64(n)) * _PRIME ** np.uint64(n)
        if n in sizes:
            on = at >= n - 1
            ids.append(rolling[on] * _MIX + np.uint64(n))
            owner.append(word[on])
    whole = np.add.reduceat((symbols + np.uint64(7)) * (_PRIME ** (at % 61).astype(np.uint64)), np.flatnonzero(opens))
    ids.append(whole * _MIX)
    owner.append(np.arange(len(words)))
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ((ids[order] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), np.bincount(owner, minlength=len(words))


def misspell(word: str, rnd: random.Random) -> str:
    """One slip: a letter dropped, doubled, swapped or written as a look-alike."""
    if len(word) < 4:
        return word
    i = rnd.randrange(1, len(word) - 1)
    kind = rnd.randrange(4)
    if kind == 0:
        return word[:i] + word[i + 1:]
    if kind == 1:
        return word[:i] + word[i] + word[i:]
    if kind == 2:
        return word[:i] + word[i + 1] + word[i] + word[i + 2:]
    alike = {"a": "@4", "e": "3", "i": "1!", "l": "1", "o": "0", "s": "5$", "t": "7"}
    spots = [j for j, c in enumerate(word) if c in alike]
    if not spots:
        return word[:i] + "*" + word[i + 1:]
    j = rnd.choice(spots)
    return word[:j] + rnd.choice(alike[word[j]]) + word[j + 1:]


@dataclass
class SubwordModel:
    """What is left of the trained network for scoring: the softmax margin of each bucket's embedding."""

    margin: np.ndarray
    bias: float
    curves: tuple[np.ndarray, ...] = ()  # intercepts and slopes of the logistic curves over `evidence_of`

    def logits(self, words: list[str]) -> np.ndarray:
        ids, sizes = bags(words, len(self.margin))
        ends = np.cumsum(sizes)
        total = np.concatenate(([0.0], np.cumsum(self.margin[ids], dtype=np.float64)))
        return (total[ends] - total[ends - sizes]) / sizes + self.bias


def _train(words: list[str], y: np.ndarray, weight: np.ndarray, buckets: int, dim: int, epochs: int, rate: float, seed: int) -> SubwordModel:
    """Embeddings and softmax together, by Adagrad over mini-batches."""
    rng = np.random.default_rng(seed)
    table_, soft, bias = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)), rng.normal(0, 0.3, (dim, 2)), np.zeros(2)
    seen, seen_soft, seen_bias = np.full(buckets, 1e-2), np.full((dim, 2), 1e-2), np.full(2, 1e-2)
    ids, sizes = bags(words, buckets)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(words)), max(1, len(words) // 256)):
            n = sizes[batch]
            rows = np.concatenate([np.arange(a, b) for a, b in zip(starts[batch], ends[batch])])
            at, owner = ids[rows], np.repeat(np.arange(len(batch)), n)
            first = np.concatenate(([0], np.cumsum(n)[:-1]))
            mean = np.add.reduceat(table_[at], first) / n[:, None]
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= weight[batch, None]
            back = (p @ soft.T) / n[:, None]
            g_soft, g_bias = mean.T @ p / len(batch), p.mean(0)
            seen_soft += g_soft ** 2
            seen_bias += g_bias ** 2
            soft -= rate * g_soft / np.sqrt(seen_soft)
            bias -= rate * g_bias / np.sqrt(seen_bias)
            grad = np.zeros((0, dim))
            keys, place = np.unique(at, return_inverse=True)
            grad = np.stack([np.bincount(place, back[owner, k], len(keys)) for k in range(dim)], 1)
            seen[keys] += (grad ** 2).mean(1)
            table_[keys] -= rate * grad / np.sqrt(seen[keys])[:, None]
    return SubwordModel(table_ @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))


def _gram_evidence(vocabulary: list[str], toxic: list[set[str]], clean: list[set[str]], buckets: int = 1 << 22) -> np.ndarray:
    """For each word, the highest share of toxic documents that one of its longest n-grams or itself has, less a margin that few sightings cannot reach."""
    ids, sizes = bags(vocabulary, buckets, SIZES[-1:])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place = {w: i for i, w in enumerate(vocabulary)}

    def documents_with(docs: list[set[str]]) -> np.ndarray:
        n = np.zeros(buckets, np.int64)
        for t in docs:
            at = np.concatenate([np.arange(starts[i], ends[i]) for i in sorted(place[w] for w in t)])
            n[np.unique(ids[at])] += 1
        return n

    scale = len(clean) / len(toxic)
    a, b = documents_with(toxic) * scale, documents_with(clean)
    share = (a - b) / (a + b + 5 * scale)
    return np.maximum.reduceat(share[ids], starts)


def fit_documents(docs: list[tuple[set[str], int]], buckets: int = 1 << 17, dim: int = 12, rounds: int = 2, epochs: int = 4, most_negative: int = 40_000, seed: int = 5) -> SubwordModel | None:
    """From the tokens and label (0 or 1) of each document; every fourth is kept for the curve."""
    # whatever order the rows came in; by label first, so that every fourth is a fair share of both
    docs = sorted((d for d in docs if d[0]), key=lambda d: (d[1], len(d[0]), sorted(d[0])[:5]))
    learn, curve = [d for i, d in enumerate(docs) if i % 4], docs[::4]
    toxic, clean = [t for t, y in learn if y], [t for t, y in learn if not y]
    if not toxic or not clean or len({y for _, y in curve}) < 2:
        return None
    in_toxic, in_clean = Counter(w for t in toxic for w in t), Counter(w for t in clean for w in t)
    vocabulary = sorted(set(in_clean).union(*toxic))
    evidence = dict(zip(vocabulary, _gram_evidence(vocabulary, toxic, clean)))
    strong = [[w for w in sorted(t) if evidence[w] >= 0.5] for t in toxic]
    picks = [s or [max(sorted(t), key=evidence.__getitem__)] for s, t in zip(strong, toxic)]
    rng = np.random.default_rng(seed)
    common = [w for w, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0]))[:most_negative // 4]]
    rest = sorted(set(in_clean) - set(common))
    negative = common + [rest[i] for i in rng.permutation(len(rest))[:most_negative - len(common)]]
    model = None
    for turn in range(rounds):
        rnd = random.Random(seed + turn)
        positive = sorted({w for p in picks for w in p if evidence[w] >= 0.3} or {w for p in picks for w in p})
        # a token counts once for each document of either class, up to 60; so a token that clean documents also have stays in doubt
        kept = [w for w in positive for _ in range(min(60, in_toxic[w]))]
        clash = [w for w in positive for _ in range(min(60, in_clean[w]))]
        slips = [misspell(w, rnd) for w in positive for _ in range(min(100, in_toxic[w]) if not in_clean[w] else 0)]
        slips = [w for w in slips if not in_clean[w]]
        sure = set(positive)
        others = [w for w in negative if w not in sure]
        words = kept + slips + clash + others
        y = np.array([1] * (len(kept) + len(slips)) + [0] * (len(clash) + len(others)))
        weight = np.ones(len(words))
        weight[:len(words) - len(others)] = max(1.0, len(others) / (4 * y.sum()))
        model = _train(words, y, weight, buckets, dim, epochs, 0.4, seed + turn)
        if turn + 1 < rounds:
            logit = dict(zip(vocabulary, model.logits(vocabulary)))
            picks = [[w for w in sorted(t) if logit[w] > 0 and evidence[w] >= 0.3] or [max(sorted(t), key=lambda w: logit[w] + 4 * evidence[w])] for t in toxic]
    logits = [model.logits(sorted(t)).tolist() for t, _ in curve]
    y = np.array([y for _, y in curve], float)
    x = np.array([(1.0, *evidence_of(z)) for z in logits])
    model.curves = _curve(x, y, [0, 1]), _curve(x, y, [0, 1, 2])
    return model


def _curve(x: np.ndarray, y: np.ndarray, used: list[int]) -> np.ndarray:
    """Logistic weights of the columns used; a column that would lower a score with more evidence is left out."""
    while True:
        part, w, ridge = x[:, used], np.zeros(len(used)), np.diag([0.01, *[0.1] * (len(used) - 1)])
        for _ in range(50):  # Newton
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            w += np.linalg.solve((part.T * (p * (1 - p) + 1e-6)) @ part + ridge, part.T @ (y - p) - ridge @ w)
        if len(used) == 1 or w[1:].min() >= 0:
            out = np.zeros(x.shape[1])
            out[used] = w
            return out
        del used[int(np.argmin(w[1:])) + 1]


def evidence_of(logits: Iterable[float], heat: float = 2.0) -> tuple[float, float]:
    """Soft maximum of a document's different token logits, and (logarithm) how many are positive."""
    near = [z for z in set(logits) if z > -8]
    return math.log(sum(math.exp(min(z, 40.0) / heat) for z in near) + math.exp(-8 / heat)), math.log1p(sum(z > 0 for z in near))


def document_score(logits: Iterable[float], curves: tuple) -> float:
    """One clear token or several doubtful ones: either curve may find a document toxic."""
    x = (1.0, *evidence_of(logits))
    z = max(sum(a * b for a, b in zip(curve, x)) for curve in curves)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_toxicity(documents: DataFrame, labels: DataFrame, rows_a_class: int = 2_500) -> SubwordModel | None:
    """From documents (doc_id, text) and labels (doc_id, toxic 0 or 1); the sample's ids are few enough to broadcast."""
    usable = labels.filter(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ids = bounded_sample(usable, "doc_id", rows_a_class, "toxic")
    some = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("toxic", "text")
    docs = [({w for w in map(_clean, set(tokens_of(r.text))) if w}, r.toxic) for r in some.toLocalIterator()]
    return fit_documents(docs)


class TokenScorer:
    """Logits of tokens, remembered, and from them the scores of documents."""

    def __init__(self, model: SubwordModel):
        self.model, self.known = model, {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, known = np.zeros(len(texts)), self.known
        curves = tuple(c.tolist() for c in self.model.curves)
        at = 0
        while at < len(texts):
            cut, total = [], 0
            while at + len(cut) < len(texts) and total < 400_000:
                cut.append(tokens_of(texts[at + len(cut)]))
                total += len(cut[-1])
            if len(known) > _CACHE:
                known.clear()
            new = [w for w in {w for tokens in cut for w in tokens} if w not in known]
            if new:
                clean = [_clean(w) for w in new]
                logit = np.concatenate([self.model.logits(clean[i:i + _AT_ONCE]) for i in range(0, len(clean), _AT_ONCE)])
                known.update(zip(new, np.where([bool(c) for c in clean], logit, -math.inf).tolist()))
            for i, tokens in enumerate(cut):
                logits = set(map(known.__getitem__, tokens))
                if max(logits, default=-math.inf) > -math.inf:
                    out[at + i] = document_score(logits, curves)
            at += len(cut)
        return out


def score_toxicity(documents: DataFrame, model: SubwordModel | None, toxic_from: float = 0.5) -> DataFrame:
    """doc_id, score, predicted: one row a document."""
    if model is None:
        return documents.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    held = documents.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = TokenScorer(held.value)
        for pdf in batches:
            score = scorer.scores(list(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": score, "predicted": (score >= toxic_from).astype(np.int32)})

    return small_batches(documents.select("doc_id", "text")).mapInPandas(scan, "doc_id long, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    train = table(spark, sf_dir, "labels").filter(labelled_fold(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")
    model = fit_toxicity(documents, train)
    return score_toxicity(documents, model).select(
        "doc_id", (labelled_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
