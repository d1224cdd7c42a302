"""Altered notices, whatever stands in the other texts, against a brute-force version."""

import random
import re

from freightdocs.llm import licenses


def accepted(text):
    words = [w for w in re.split(licenses.SPLIT, text.lower()) if w]
    out = set()
    for label, wording, phrase in licenses.TEMPLATES:
        t = wording.split()
        for offset in range(-len(t), len(words)):
            own = [words[offset + i] if 0 <= offset + i < len(words) else None for i in range(len(t))]
            share = sum(a == b for a, b in zip(own, t, strict=True)) / len(t)
            if share >= licenses.SHARE and f" {phrase} " in f" {' '.join(w for w in own if w)} ":
                out.add((label, share))
    return out


def test_shortened_and_altered_notices(spark):
    r = random.Random(3)
    by = {label: t.split() for label, t, _ in reversed(licenses.TEMPLATES)}
    texts = [" ".join(by[x]) for x in ("mit", "bsd") for _ in range(10)]
    texts += [" ".join(["intro", *by[x][:n], "and", "so", "on"]) for x, n in (("mit", 19), ("bsd", 14)) for _ in range(90)]
    for _, t, _ in licenses.TEMPLATES:
        for k in range(20):
            words = [w if r.random() > k / 40 else r.choice(["other", "the", "license", ""]) for w in t.split()]
            texts.append(" ".join(["the", "words"] * r.randrange(3) + words[r.randrange(3) if k % 4 == 0 else 0 :] + ["of"] * r.randrange(3)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: {(a.label, a.share) for a in x.accepted or []} for x in licenses.scan(frame).collect()}
    assert found == {i: accepted(t) for i, t in enumerate(texts)}
    assert all(found[i] for i in range(200))
