"""Best-fit packing of token pieces into sequences of a fixed capacity.

Packing needs only lengths, of which there are at most ``capacity`` different ones, so the plan is made from counts per
length, whatever the number of documents. Pieces over a third of the capacity go at most two to a bin: each, from the
longest, takes the longest other one that still fits (equal pairs in one step). Shorter pieces, from the longest, go into
the smallest gap that holds them, as many equal ones and into as many equal bins at once as there are; what finds no gap
opens bins. The plan gives for each length and each range of ranks the bins and offsets; pieces get their rank within
their length from counts per written partition, so no task sees all pieces of one length.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightdocs.llm.common import KEPT, narrow, small_batches, written

CAPACITY = 4096
END_ID = 1
#: Distinct words in one generation of a Python worker's cache.
CACHE = 500_000


class Plan:
    """Bins for ``counts[length]`` pieces: rows ``(length, first rank, ranks, pieces in a bin, first bin, offset)``."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.rows = capacity, dict(counts), []
        self.used: dict[int, int] = defaultdict(int)
        self.bins = 0
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs (first bin, bins)
        self.sizes: list[int] = []  # sorted gaps that have runs
        large = sorted(x for x in counts if 3 * x > capacity)
        while large:
            x = large[-1]
            if not self.left[x]:
                large.pop()
                continue
            at = bisect_left(large, capacity - x + 1) - 1
            while at >= 0 and not self.left[large[at]]:
                large.pop(at)
                at -= 1
            if at >= 0 and large[at] == x and self.left[x] == 1:
                at -= 1
                while at >= 0 and not self.left[large[at]]:
                    large.pop(at)
                    at -= 1
            y = large[at] if at >= 0 else 0
            n = self.left[x] if not y else self.left[x] // 2 if x == y else min(self.left[x], self.left[y])
            start = self.bins
            self.bins += n
            self.place(x, n, 1, start, 0)
            if y:
                self.place(y, n, 1, start, x)
            self.free(capacity - x - y, start, n)
        for x in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
            while self.left[x]:
                at = bisect_left(self.sizes, x)
                if at == len(self.sizes):
                    each = capacity // x
                    n = max(1, self.left[x] // each)
                    self.free(capacity, self.bins, n)
                    self.bins += n
                    continue
                gap = self.sizes[at]
                start, n = self.gaps[gap].pop()
                if not self.gaps[gap]:
                    self.sizes.pop(at)
                each = min(gap // x, self.left[x])
                whole = min(n, self.left[x] // each)
                self.place(x, whole, each, start, capacity - gap)
                self.free(gap - each * x, start, whole)
                if whole < n:
                    self.free(gap, start + whole, n - whole)

    def place(self, x: int, bins: int, each: int, start: int, offset: int) -> None:
        self.rows.append((x, self.used[x], bins * each, each, start, offset))
        self.used[x] += bins * each
        self.left[x] -= bins * each

    def free(self, gap: int, start: int, n: int) -> None:
        if gap and n:
            if not self.gaps[gap]:
                insort(self.sizes, gap)
            self.gaps[gap].append((start, n))


#: Signs that the tokenizer parts from letters before them.
SIGNS = '.,!?;:*$%&#|"()-'


def split_word(word: str) -> tuple[str, ...]:
    """The letters of a word and the signs behind them, which are encoded apart; other words stay whole.

    The tokenizer ignores case, so words of ASCII letters are shared by their lower case.
    """
    if word.isalpha():
        return (word.lower() if word.isascii() else word,)
    core = word.rstrip(SIGNS)
    if not core.isalpha():
        return (word,)
    low = core.lower() if core.isascii() else core
    return low, word[len(core):]


class Words:
    """Ids of words, as bytes, in a bounded cache of two generations that a Python worker keeps from task to task."""

    def __init__(self, tokenizer: str, most: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer)
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, words: set[str]) -> dict[str, bytes]:
        """A table that holds all of ``words``."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        parts = {}
        for w in words.difference(young):
            known = old.get(w)
            if known is None:
                parts[w] = split_word(w)
            else:
                young[w] = known
        new = list({p for two in parts.values() for p in two if p not in young})
        for k in range(0, len(new), 10_000):
            own = new[k : k + 10_000]
            young.update(zip(own, (array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(own, add_special_tokens=False)), strict=True))
        young.update((w, b"".join(young[p] for p in two)) for w, two in parts.items() if len(two) > 1 or two[0] != w)
        return young


@lru_cache(maxsize=1)
def words_of(tokenizer: str, most: int = CACHE) -> Words:
    return Words(tokenizer, most)


def give_up_words() -> bool:
    held = words_of.cache_info().currsize > 0
    words_of.cache_clear()
    return held


KEPT.append(give_up_words)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Tokenize and cut: one row per piece with its length, CRC and rank among the pieces of its length in this partition.

    A document is its ids and then ``END_ID``; only longer ones are cut. White space never joins two tokens of this
    tokenizer, so each distinct word is encoded once for as long as it stays in the cache of its worker, of which a
    generation holds about ``cache`` words: where other steps run in the same workers, a smaller one leaves them memory.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = words_of(tokenizer, cache)
        rank: dict[int, int] = defaultdict(int)
        part, end = TaskContext.get().partitionId(), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows = []
            split = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in b["text"]]
            ids = known.of(set().union(*split))
            for doc, own in zip(b["doc_id"], split, strict=True):
                data = b"".join(map(ids.__getitem__, own)) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at : at + 4 * capacity]
                    n = len(piece) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(piece), part, rank[n], np.frombuffer(piece, "<u4").astype(np.int64) if keep_ids else None))
                    rank[n] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return narrow(docs, "doc_id", "text").mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long, ids array<long>")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False,
         cache: int = CACHE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, with ``keep_ids``, ``ids`` of every piece.

    Each row of ``docs`` is a document, also if its id is null or repeated. Null and empty texts are the end id alone. Ties
    between equal lengths go by place in the table. An empty table gives an empty table; other columns are left out.
    """
    cut = written(pieces(docs, tokenizer, capacity, keep_ids, cache), "pack-pieces")
    counts = written(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "pack-counts")
    # at most one row for each length comes to the driver
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 6)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        low, high = np.searchsorted(rows[:, 0], size), np.searchsorted(rows[:, 0], size, side="right")
        at = np.empty(len(size), np.int64)
        for x in np.unique(size):
            own = size == x
            i, j = low[own][0], high[own][0]
            at[own] = i + np.searchsorted(rows[i:j, 1], r[own], side="right") - 1
        inside, each = r - rows[at, 1], rows[at, 3]
        return pd.DataFrame({"sequence_id": rows[at, 4] + inside // each, "offset": rows[at, 5] + inside % each * size})

    # counts per partition grow with the input, so they are not broadcast
    placed = cut.join(base.hint("merge"), ["part", "length"]).withColumn("at", slot(F.col("length"), F.col("base") + F.col("rank")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *["ids"] * keep_ids)
