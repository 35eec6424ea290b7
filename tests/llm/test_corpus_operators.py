"""Filter audit, sentence pieces and periodic runs against SQL, the library and brute force; odd inputs for all."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import filter_audit, periodic_runs, sentence_pieces
from quillspark.llm.registry import QUERIES

ODD = [
    (1, None, None), (2, "", "s"), (3, " \n\t ", None), (4, "alpha beta gamma delta " * 20_000, "s"), (5, "same words here again now", "s"),
    (5, "same words here again now", "t"), (6, "same words here again now", "s"), (7, "#### $$$ 123", ""), (8, "naïve 日本語 🎉 text\x00\x1c ▁x", "s"),
    (9, "SHOUTED WORDS " + " ".join(f"w{i}" for i in range(250)), "s"), (None, "same words here again now", "s"), (0, "x " * 300, "t"), (10, "", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    for name in ("words", "part", "A", "n", "good", "digest", "first", "runs", "ids", "decoded", "n_chars"):
        df = df.withColumn(name, F.lit(1))
    return df


# ---------------------------------------------------------------- 11

def brute_audit(rows, labels):
    """Every document through every order."""
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    flags = []
    for doc_id, text, source in rows:
        text = text or ""
        words = text.encode().split()
        twin = any(doc_id is not None and i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        flags.append((source or "", doc_id, {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": twin}))
    out = {}
    for part in {p for p, _, _ in flags}:
        own = [(i, f) for p, i, f in flags if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone, stay = [x for x in left if x[1][name]], [x for x in left if not x[1][name]]
                fails = [f for _, f in own if f[name]]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(stay), len(gone), len(fails) - len(gone), sum(sum(f.values()) == 1 for f in fails), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name]
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row[-1] = shapley[order[step - 1]]
    return {k: tuple(v) for k, v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_of_odd_rows_equals_every_order(spark, odd):
    labels = [(1, 1, 0), (4, 1, 1), (5, 0, 1), (5, 1, None), (7, None, 1), (99, 1, 1), (None, 1, 1), (0, 1, 0)]
    found = filter_audit.audit_filters(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in found.filter("NOT whole").collect()}
    assert got == brute_audit(ODD, labels)
    assert all(name == order[step - 1] for order, step, name in found.select("filter_order", "step", "filter").distinct().toLocalIterator())
    total = {(r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in found.filter("whole").collect()}
    assert total == {k: tuple(map(sum, zip(*[v for (p, *rest), v in got.items() if tuple(rest) == k]))) for k in {k[1:] for k in got}}


def test_audit_of_empty_tables(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(odd.limit(0), none).count() == 0
    assert filter_audit.audit_filters(odd, none).filter("NOT whole").count() == 600 * len({s or "" for _, _, s in ODD})


def test_audit_sql_on_odd_rows(spark, odd, tmp_path):
    """The SQL states the same results, where ids are not null."""
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [r for r in ODD if "\x00" not in (r[1] or "")])
    con.execute("create table labels(doc_id bigint, quality int, toxic int)")
    con.executemany("insert into labels values (?, ?, ?)", [(4, 1, 1), (5, 0, 1), (5, 1, None)])
    want = {tuple(r) for r in con.execute(f"select part, filter_order, step, {', '.join(COUNTS)} from ({filter_audit.OP11_SQL})").fetchall()}
    found = filter_audit.audit_filters(odd.filter("doc_id IS NULL OR doc_id <> 8"), spark.createDataFrame([(4, 1, 1), (5, 0, 1), (5, 1, None)], "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in found.filter("NOT whole").select("part", "filter_order", "step", *COUNTS).collect()} == want


# ---------------------------------------------------------------- 12

@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())


def test_pieces_equal_library(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "TABLE_CHUNKS", 500)
    monkeypatch.setattr(sentence_pieces, "_TOGETHER", 2_000)
    pieces = sentence_pieces.Pieces(sentence_pieces.default_model())
    rnd = random.Random(5)
    alphabet = "ab e▁ \n\tthin日🎉é.,0'<s>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(90))) for _ in range(4_000)]
    texts += [t or "" for _, t, _ in ODD] + ["<s> hi </s> <0x0A> <unk>", "a" * 3_000, " " * 101 + "b" + " " * 37, "x▁▁y", "ab" * 700 + "c" * 41]
    at = 0
    for some in sentence_pieces.ChunkTable(pieces).encode(texts):
        for ids, text in zip(some.each(), pieces.spell(some)):
            want = library.encode(texts[at], add_bos=True, add_eos=True)
            assert [pieces.begin, *ids.tolist(), pieces.end] == want and text == library.decode(want), texts[at][:80]
            at += 1
    assert at == len(texts)


def test_pieces_of_whole_table_equal_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op12_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_odd_rows(odd, library):
    rows = sentence_pieces.encode_pieces(odd).collect()
    assert len(rows) == len(ODD) and "n_chars" in rows[0].asDict()
    for r in rows:
        assert r.ids == library.encode(r.text or "", add_bos=True, add_eos=True) and r.decoded == (r.text or "").replace("▁", " ")
    assert sentence_pieces.encode_pieces(odd.limit(0)).count() == 0


# ---------------------------------------------------------------- 13

def brute_runs(words):
    """All maximal stretches of each period, of which the smallest one counts."""
    out = []
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            stretch = words[i:j + p]
            if j > i and len(stretch) >= max(24, 3 * p) and not any(stretch[q:] == stretch[:-q] for q in range(1, p)):
                out.append((i, len(stretch), p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rnd):
    words = [rnd.randrange(rnd.choice([1, 2, 3, 10, 50])) for _ in range(rnd.randrange(200))]
    for _ in range(rnd.randrange(4)):
        if len(words) > 30:
            start, p = rnd.randrange(len(words)), rnd.randrange(1, 40)
            for i in range(start + p, rnd.randrange(start, len(words))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("short, points", [(4_096, 1_000_000), (0, 1_000_000), (0, 40)])
def test_runs_equal_brute_force(monkeypatch, short, points):
    monkeypatch.setattr(periodic_runs, "SHORT", short)
    monkeypatch.setattr(periodic_runs, "GRID_POINTS", points)
    periodic_runs._short_grid.cache_clear()
    rnd, n = random.Random(points + short), 0
    for _ in range(700):
        words = repetitive(rnd)
        want = brute_runs(words)
        assert periodic_runs.runs_of(np.array(words, np.int64)) == want, words
        n += len(want)
    assert n > 100
    periodic_runs._short_grid.cache_clear()


def test_runs_of_very_long_texts_are_fast():
    for words in (np.zeros(200_000, np.int64), np.resize(np.array([0] * 99 + [1]), 200_000)):
        assert periodic_runs.runs_of(words)[0][:2] == (0, 200_000) or len(periodic_runs.runs_of(words)) > 1


def test_greatest_run_breaks_ties_by_start():
    assert periodic_runs.greatest([(0, 40, 10), (5, 80, 20), (90, 39, 10)]) == (0, 40, 10) and periodic_runs.greatest([]) is None


def test_runs_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op13_periodic_runs"](spark, sf_dir).collect()
    assert len(rows) == len(texts) and sum(r.n_runs for r in rows) > 10
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        words = [w.decode() for w in texts[r.doc_id].encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1_500:
            continue  # the brute force is quadratic; longer texts are held against it above
        runs = brute_runs(words)
        dropped = {i for s, m, p in runs for i in range(s + p, s + m)}
        assert r.n_runs == len(runs) and r.runs_sha256 == sha("".join(f"{s},{m},{p}\n" for s, m, p in runs))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in dropped))
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best and r.exponent_milli == (best[1] * 1000 // best[2] if runs else None)


def test_runs_of_odd_rows(odd):
    rows = periodic_runs.find_runs(odd).collect()
    assert len(rows) == len(ODD) and "n_chars" in rows[0].asDict()
    by_id = {r.doc_id: [tuple(x) for x in r.runs] for r in rows}
    assert by_id[4] == [(0, 80_000, 4)] and by_id[0] == [(0, 300, 1)] and not by_id[1] and not by_id[5]
    texts = {r.doc_id: (r.text, r.n_chars) for r in periodic_runs.collapse_runs(odd).collect()}
    assert texts[4] == ("alpha beta gamma delta", 22) and texts[1][0] is None and texts[3][0] == " \n\t " and texts[0][0] == "x"
    assert periodic_runs.find_runs(odd.limit(0)).count() == 0 and periodic_runs.collapse_runs(odd.limit(0)).count() == 0
