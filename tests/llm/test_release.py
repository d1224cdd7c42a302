"""Steps without a use for the cache of words give it up in their Python workers."""

from fixtures import table
from pyspark.sql import functions as F

from freightdocs.llm import common, line_chunks, minhash, packing, quality_rules
from freightdocs.llm.common import tokenizer_path

MODEL = tokenizer_path("word_bpe_49k.json")


def test_words_are_given_up():
    first = packing.words_of(MODEL, 100)
    assert packing.words_of(MODEL, 100) is first
    common.release()
    assert packing.words_of.cache_info().currsize == 0 and packing.words_of(MODEL, 100) is not first


def test_other_steps_release(spark):
    docs = table(spark).coalesce(1)

    def held():
        def run(batches):
            for b in batches:
                yield b.assign(n=packing.words_of.cache_info().currsize)[["n"]]
        return sum(r.n for r in spark.range(64).repartition(16).mapInPandas(run, "n long").collect())

    steps = {"shingles": lambda: minhash.shingled(table(spark).repartition(16), 3).collect(),
             "lines": lambda: line_chunks.repeated_chunks(table(spark).repartition(16)).collect(),
             "measures": lambda: table(spark).repartition(16).select(quality_rules.measures(F.col("text"), quality_rules.np.zeros(quality_rules.BUCKETS))).collect()}
    for name, step in steps.items():
        packing.pieces(docs.repartition(16), MODEL).collect()
        before = held()
        for _ in range(4):
            step()
        assert held() < before or not before, name
