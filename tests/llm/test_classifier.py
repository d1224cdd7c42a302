"""Held-out accuracy on the labelled documents, and awkward rows."""

import zlib

import numpy as np
from fixtures import empty, table

from freightdocs.llm import classifier
from freightdocs.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = QUERIES["op7_quality_classifier"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    rows = [(r.score, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, q in rows if q == k] for k in (1, 0))
    assert len(found) == 1000 and np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good]) > 0.9


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (12, 0), (None, 1), (11, None), (13, 7)], "doc_id long, quality int")
    found = classifier.scored(table(spark), labels).collect()
    assert len(found) == table(spark).count() and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (4, 5, 6)}) == 1
    assert {r.score for r in classifier.scored(table(spark), labels.limit(0)).collect()} == {0.5}
    assert classifier.scored(empty(spark), labels).count() == 0
