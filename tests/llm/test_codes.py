"""Orchard search against all distances, and the codes of awkward vectors against plain k-means."""

import hashlib
from collections import defaultdict

import numpy as np

from freightdocs.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int, width int"


def nearest(parts, entries):
    square = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return square.argmin(axis=1), square.min(axis=1)  # argmin takes the lower index


def by_hand(rows, parts=16, entries=64, rounds=2):
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, total = [], defaultdict(int)
    for width in {len(v) for _, v, _ in good}:
        own = [r for r in good if len(r[1]) == width]
        x = np.array([v for _, v, _ in own], np.int64).reshape(len(own), width)
        seeds = [v for _, v, _ in sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
        cuts = [k * width // parts for k in range(parts + 1)]
        books = [np.array(seeds, np.int64).reshape(len(seeds), width)[:, i:j].copy() for i, j in zip(cuts, cuts[1:], strict=False)]
        for _ in range(rounds):
            for p, book in enumerate(books):
                part = x[:, cuts[p]:cuts[p + 1]]
                code, _ = nearest(part, book)
                for e in set(code.tolist()):
                    book[e] = part[code == e].sum(axis=0) // (code == e).sum()
        found = [nearest(x[:, cuts[p]:cuts[p + 1]], b) for p, b in enumerate(books)]
        sha = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel()).encode()).hexdigest()
        for k, (i, _, label) in enumerate(own):
            error = int(sum(s[k] for _, s in found))
            out.append((i, "".join(f"{c[k]:02x}" for c, _ in found), error, label, sha))
            total[label] += error
    return sorted((str(i), c, e, total[label], sha) for i, c, e, label, sha in out)


def test_orchard_search_finds_the_nearest_entry():
    r = np.random.default_rng(3)
    for spread in (3, 40, 4000):  # many ties, few ties, hardly any
        for k in (1, 2, 64, 200):
            entries = r.integers(-spread, spread, (k, 4))
            entries[k // 2] = entries[0]
            parts = np.concatenate([r.integers(-spread, spread, (500, 4)), entries])
            code, square = codes.Orchard(entries).nearest(parts)
            want, far = nearest(parts, entries)
            assert (code == want).all() and (square == far).all()


def test_awkward_vectors(spark):
    r = np.random.default_rng(4)
    rows = [(k, [float(np.float32(x)) for x in r.normal(size=32)], [None, 1, 2, 2, 2][k % 5]) for k in range(20, 220)]
    rows += [(500, rows[3][1], 7), (501, rows[3][1], None), (22, rows[9][1], 1), (None, rows[8][1], 1), (1, None, 1), (2, [None] + [0.0] * 31, 1),
             (3, [float("nan")] + [0.0] * 31, 2), (4, [float("-inf")] + [0.0] * 31, 2), (5, [0.0] * 32, 3), (6, [], 3), (7, [1.5, -0.001, 2.0], None)]
    frame = spark.createDataFrame([(i, v, label, "x", 1, 1) for i, v, label in rows], SCHEMA)
    found = codes.compressed(frame).collect()
    assert sorted((str(x.vec_id), x.code, x.error, x.label_error, x.codebooks_sha256) for x in found) == by_hand(rows)
    few = codes.compressed(frame.filter("vec_id < 30"), entries=256, rounds=3)
    own = [x for x in rows if x[0] is not None and x[0] < 30]
    assert sorted((str(x.vec_id), x.code, x.error, x.label_error, x.codebooks_sha256) for x in few.collect()) == by_hand(own, entries=256, rounds=3)
    assert codes.compressed(frame.limit(0)).count() == 0
