"""Top-k pairing against all pairs."""

from __future__ import annotations

import random

import pytest

from quillspark.operators.pairing import best_pairs

OWNED, ASKED = "doc_id long, name string, is_demonstrated boolean", "job_id long, skill string, required boolean, weight double"


def brute(owned, asked, most):
    credit, impact = {}, {}
    for d, s, shown in owned:
        credit[d, s] = max(credit.get((d, s), 0), 4 if shown else 3)
    for j, s, required, weight in asked:
        impact[j, s] = max(impact.get((j, s), 0), round(weight * 1000) * (2 if required else 1))
    scores = {}
    for (d, s), c in credit.items():
        for (j, t), i in impact.items():
            if s == t:
                scores[d, j] = scores.get((d, j), 0) + c * i
    out = set()
    for d in {d for d, _ in scores}:
        ranked = sorted(((v, j) for (e, j), v in scores.items() if e == d), key=lambda x: (-x[0], x[1]))
        out |= {(d, j, v, r) for r, (v, j) in enumerate(ranked[:most], 1)}
    return out


@pytest.mark.parametrize("seed, n_skills, most, part", [(1, 6, 3, 2_000), (2, 30, 5, 4), (3, 3, 4, 1), (4, 60, 2, 3)])
def test_best_pairs_equal_all_pairs(spark, seed, n_skills, most, part):
    rnd = random.Random(seed)
    skill = lambda: f"s{min(int(rnd.expovariate(4 / n_skills)), n_skills)}"  # noqa: E731  a few are everywhere
    owned = [(d, skill(), rnd.random() < 0.5) for d in range(60) for _ in range(rnd.randrange(9))]
    asked = [(j, skill(), rnd.random() < 0.6, rnd.choice([0.7, 0.85, 1.0])) for j in range(150) for _ in range(rnd.randrange(7))]
    asked += [(1_000 + j, s, True, 0.7) for j in range(40) for s in ("s0", "s1")]  # many that ask for the same
    got = best_pairs(spark.createDataFrame(owned, OWNED), spark.createDataFrame(asked, ASKED), "doc_id", "job_id", most, part)
    assert {tuple(r) for r in got.collect()} == brute(owned, asked, most)


def test_empty_sides(spark):
    some = spark.createDataFrame([(1, "s", True)], OWNED)
    assert best_pairs(some, spark.createDataFrame([], ASKED), "doc_id", "job_id").count() == 0
    assert best_pairs(some.limit(0), spark.createDataFrame([(1, "s", True, 0.7)], ASKED), "doc_id", "job_id").count() == 0
