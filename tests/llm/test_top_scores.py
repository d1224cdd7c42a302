"""Branch and bound against all products."""

import numpy as np
from pyspark.sql import functions as F

from freightdocs.llm import top_scores

SCHEMA = "vec_id long, embedding array<float>, rank int, score long, row int, block int"


def by_hand(rows, k=5):
    good = [(n, i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for n, (i, v) in enumerate(rows)
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for m, j, c in good if m != n and len(c) == len(q))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def rows_of(found):
    return sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in found.collect())


def test_awkward_vectors(spark, monkeypatch):
    r = np.random.default_rng(8)
    base = r.normal(size=(7, 20))
    rows = [(k, [float(np.float32(x)) for x in base[k % 7] + r.normal(size=20) * 0.3]) for k in range(1, 600)]
    rows += [(1000 + k, rows[49][1]) for k in range(300)]  # one vector, very often: ties go to the smaller id
    rows += [(50, rows[3][1]), (100, rows[99][1]), (None, rows[2][1]), (0, None), (2050, [None] + [1.0] * 19), (2051, [float("nan")] * 20),
             (2100, [float("inf")] + [0.0] * 19), (2150, [0.0] * 20), (3000, [1.0, 2.0]), (3001, [-3.0, 0.5]), (3050, []), (3100, [7.0])]
    frame = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SCHEMA)
    asked = F.col("vec_id") % 50 == 0
    assert rows_of(top_scores.top_scores(frame, asked)) == by_hand(rows)
    monkeypatch.setattr(top_scores, "BLOCK", 100)  # many blocks of both kinds
    monkeypatch.setattr(top_scores, "QUERIES", 7)
    assert rows_of(top_scores.top_scores(frame, asked, k=3)) == by_hand(rows, 3)
    assert top_scores.top_scores(frame.limit(0), asked).count() == 0
    assert top_scores.top_scores(frame.filter("vec_id = 3"), asked).count() == 0


def test_bounds_drop_candidates_but_no_result():
    r = np.random.default_rng(9)
    rows = np.floor(r.normal(size=(3000, 64)) * np.exp(-np.arange(64) / 8) * 256).astype(np.int64)
    v, mass = top_scores.upright(rows)
    ids = r.permutation(3000)
    for n in range(40):
        found, score = top_scores.searched(v, mass, ids, np.arange(3000), rows[n], n, top_scores.LOWEST, 5)
        want = sorted((-int(rows[n] @ rows[m]), int(ids[m])) for m in range(3000) if m != n)[:5]
        assert list(zip((-score).tolist(), found.tolist(), strict=True)) == want
        again, _ = top_scores.searched(v, mass, ids, np.arange(3000), rows[n], n, int(score[-1]), 5)
        assert again.tolist() == found.tolist()  # candidates at the bound itself stay
