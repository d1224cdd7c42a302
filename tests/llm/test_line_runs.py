"""All repeated runs of two or more lines, against a brute-force version."""

from collections import Counter

from fixtures import table
from pyspark.sql import functions as F

from freightdocs.llm import line_chunks
from freightdocs.llm.queries import QUERIES


def without_runs(texts):
    """Lines that stand in two neighbouring lines with a word, which stood before with no line in common, go."""
    seen, out = {}, {}
    for i, tag, t in sorted({(-(2**63) if i is None else i, tag, t) for i, tag, t in texts if t is not None}):
        lines, gone = t.split("\n"), set()
        full = [k for k, x in enumerate(lines) if x.strip(" \t\r\v\f")]
        for s, e in zip(full, full[1:]):
            first = seen.setdefault("\n".join(lines[s : e + 1]), (i, tag, s, e))
            if first[:2] != (i, tag) or s > first[3]:
                gone.update(range(s, e + 1))
        out[(i, tag)] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return Counter((i, None if t is None else out[(-(2**63) if i is None else i, tag)]) for i, tag, t in texts)


def test_repeated_runs(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for frame, found in ((table(spark), line_chunks.deduplicated(table(spark), line_chunks.line_pairs)), (docs, QUERIES["op3_line_dedup"](spark, sf))):
        texts = [tuple(r) for r in frame.select("doc_id", F.xxhash64("text"), "text").collect()]
        assert Counter((r.doc_id, r.text) for r in found.select("doc_id", "text").collect()) == without_runs(texts)


def test_short_blocks_and_copies(spark):
    texts = [(k, f"a{k}\nb{k}\nsame one\n\nsame two\nc{k}\nd{k}") for k in range(20)]
    texts += [(50, "x1\nx2\nx3"), (51, "x1\nx2\nx3"), (60, "y\ny\ny\ny\ny"), (61, "z\nsame one\nsame two")]
    found = {r.doc_id: (r.text, r.n_lines, r.cut_lines, r.cut_chunks) for r in line_chunks.deduplicated(
        spark.createDataFrame(texts, "doc_id long, text string"), line_chunks.line_pairs).collect()}
    assert found[0][0] == texts[0][1] and all(found[k] == (f"a{k}\nb{k}\nc{k}\nd{k}", 7, 3, 1) for k in range(1, 20))
    assert found[50][0] == "x1\nx2\nx3" and found[51] == ("", 3, 3, 1)
    assert found[60] == ("y\ny", 5, 3, 1) and found[61][0] == texts[-1][1]
