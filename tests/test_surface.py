"""The scan for surface forms against a loop of regular expressions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.surface import SNIPPETS, SurfaceForms, form_pattern, snippet
from quillspark.operators import skills

FORMS = ["python", "go", "c", "c++", "c#", ".net", "react", "react native", "native", "node.js", "ci/cd", "ci", "scikit-learn", "a b", "b a", "a a", "a - b", "-x", "x-",
         "f# y", "i", "k s", "sql", "t-sql", "a-b"]
TOKENS = ["python", "Go", "c", "C++", "c#", ".net", "react", " ", "  ", "-", "\n", "native", "node", ".", "js", "ci", "/", "cd", "scikit", "learn", "a", "b", "x", "_", "1", "é", "ſ",
          "K", "İ", "ı", "S", "+", "#", "f", "y", "i", "k", "sql", "t"]
NAMED = [(f, f.upper() if i % 3 else f"n{i // 3}", "c") for i, f in enumerate(FORMS)]


def by_patterns(text):
    taken, out = bytearray(len(text)), {}
    for form, name, _ in sorted(NAMED, key=lambda f: -len(f[0])):
        for m in form_pattern(form).finditer(text):
            if not any(taken[m.start():m.end()]):
                taken[m.start():m.end()] = b"\x01" * len(m[0])
                n, found = out.get(name, (0, []))
                out[name] = n + 1, [*found, snippet(text, *m.span())][:SNIPPETS]
    return out


def test_scan_equals_patterns():
    trie, rnd = SurfaceForms(NAMED), random.Random(11)
    for _ in range(8_000):
        text = "".join(rnd.choice(TOKENS) for _ in range(rnd.randrange(25)))
        assert {name: (n, s) for name, _, n, s in trie.claims(text)} == by_patterns(text), text


@pytest.mark.parametrize("text, want", [
    ("Python/Go, Docker/Kubernetes", {"Python": 1, "Go": 1, "Docker": 1, "Kubernetes": 1}), ("react  native", {"React Native": 1}), ("react native and react", {"React Native": 1, "React": 1}),
    ("c++", {"C++": 1}), ("my_python_x", {}), ("pythonic c++11", {}), ("", {}), (None, {}),
])
def test_scan_of_texts(spark, text, want):
    contexts = spark.createDataFrame([(1, "skills", text)], "doc_id long, context string, text string")
    found = skills.scan(contexts, skills.surface_forms(skills.load_ontology(spark)))
    assert {r.name: r.n for r in found.collect()} == want


def test_snippets_are_of_occurrences_in_order(spark):
    text = "first python here. " + "x" * 60 + " second python here. " + "y" * 60 + " python third " + "z" * 60 + " python fourth"
    forms = skills.surface_forms(skills.load_ontology(spark))
    row = skills.scan(spark.createDataFrame([(1, "other", text)], "doc_id long, context string, text string"), forms).first()
    assert row.n == 4 and len(row.snippets) == 3
    assert "first" in row.snippets[0] and row.snippets[0].endswith("...") and "second" in row.snippets[1] and "third" in row.snippets[2]


def test_long_texts_take_time_in_proportion():
    text = "react native " * 200_000
    assert SurfaceForms(NAMED).claims(text)[0][2] == 200_000


def test_typos_give_way_to_exact_mentions(spark):
    forms = skills.surface_forms(skills.load_ontology(spark))
    rows = [(1, "skills", "Kubernets, Pythn"), (1, "experience", "ran Kubernetes"), (2, "summary", "Kubernets")]
    found = skills.extract_skills(spark.createDataFrame(rows, "doc_id long, context string, text string"), forms)
    got = {(r.doc_id, r.name): (r["count"], r.contexts, r.fuzzy) for r in found.collect()}
    assert got[1, "Kubernetes"] == (1, ["experience"], False) and got[1, "Python"] == (1, ["skills"], True) and got[2, "Kubernetes"] == (1, ["skills"], True)
    assert 'Matched from "kubernets"' in found.filter("doc_id = 2").select(F.col("evidence")[0]).first()[0]
