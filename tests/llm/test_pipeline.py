"""Each stage of the pipeline on what the one before kept, against brute force."""

from collections import Counter

import pytest
from fixtures import empty, table
from pyspark.sql import functions as F
from test_contracts import check_packing, groups, packed, rules, spans
from test_line_runs import without_runs

import __spark_entry__ as entry
import corpus_pipeline
from freightdocs.llm import secrets
from freightdocs.llm.common import written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], SF), name.replace(" ", "-")))
    return docs


def test_quality(spark, steps):
    verdict = {r.doc_id: r.kept for r in entry.queries()["op9_quality_rules"](spark, SF).collect()}
    assert {r.doc_id for r in steps[1].collect()} == {i for i, k in verdict.items() if k}
    assert not any(rules(r.text)[-1] for r in steps[1].collect())


def test_lines(steps):
    want = without_runs([tuple(r) for r in steps[1].select("doc_id", F.xxhash64("text"), "text").collect()])
    assert Counter((r.doc_id, r.text) for r in steps[2].collect()) == Counter({(i, t): n for (i, t), n in want.items() if t.split()})
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_near_copies(steps):
    want = groups([(r.doc_id, r.text) for r in steps[2].collect()], 5, 80, 100)
    assert Counter(r.doc_id for r in steps[3].collect()) == Counter(i for i, _, _, kept in want if kept)


def test_secrets(steps):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in (steps[3], steps[4]))
    assert before.keys() == after.keys()
    assert all((t == after[i]) or spans(t) for i, t in before.items())
    assert all(not spans(t) or spans(t) != spans(before[i]) for i, t in after.items())


def test_packing(steps):
    found = steps[5].collect()
    check_packing(found, [(r.doc_id, r.text) for r in steps[4].collect()])


def test_columns_and_run(spark, steps):
    assert all(s.dtypes == steps[0].dtypes for s in steps[1:5])
    assert entry.queries()["pipeline"](spark, SF).count() == steps[5].count()


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_awkward_tables(spark, kind):
    docs = (table if kind == "awkward" else empty)(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, "/root/testdata/sf0.001"), name.replace(" ", "-"))
        assert docs.columns == columns or name == "best-fit packing"
    ids = {r.doc_id for r in docs.collect()}
    assert not ids if kind == "empty" else not ids & {4, 5, 6, 7, 8, 9}
    assert secrets.KINDS and packed
