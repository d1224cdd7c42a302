"""The cache of words keeps to its size, and a small one gives the same pieces."""

import corpus_pipeline
from fixtures import table

from freightdocs.llm import packing
from freightdocs.llm.common import tokenizer_path

MODEL = tokenizer_path("word_bpe_49k.json")


def test_generations_hold_what_was_asked_for():
    small, large = packing.Words(MODEL, 100), packing.Words(MODEL)
    for k in range(60):
        words = {f"{c}{k}x." for c in "abcdefghij"}
        found, known = small.of(words), large.of(words)
        assert {w: found[w] for w in words} == {w: known[w] for w in words}
        assert len(small.young) <= 100 + 2 * len(words) and len(small.old) <= 100 + 2 * len(words)
    assert len(large.young) >= 600


def test_small_cache_gives_the_same_pieces(spark):
    def shown(cache):
        return sorted(map(str, packing.pieces(table(spark), MODEL, keep_ids=True, cache=cache).drop("part", "rank").collect()))

    assert shown(50) == shown(packing.CACHE)


def test_pipeline_leaves_memory_to_its_other_stages(monkeypatch):
    asked = []
    monkeypatch.setattr(packing, "pack", lambda *args, **named: asked.append(named))
    corpus_pipeline.pack(None, None, "")
    assert asked == [{"keep_ids": True, "cache": corpus_pipeline.CACHE}] and corpus_pipeline.CACHE <= packing.CACHE // 5
