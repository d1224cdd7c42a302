"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated output.

Every token (a run of letters, digits or signs) is hashed into ``WORDS`` slots. A slot has a fixed sparse index vector of
signs; its context vector is the sum of the index vectors of the tokens around its occurrences in all texts. The context
vectors, centred and scaled to length 1, are the word vectors. A document is pooled into the mean and the spread of its
word vectors, how far they repeat, and its length. A network of two layers is fitted in numpy to at most ``SAMPLE``
labelled documents, and its logit is divided by a temperature that is fitted on documents it was not trained on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightdocs.llm.common import narrow, small_batches

#: Slots, length of a vector, signs in an index vector, neighbours on each side.
WORDS, DIM, SIGNS, REACH = 16384, 64, 4, 2
#: Most labelled documents that the network is fitted to.
SAMPLE = 20_000
HIDDEN, ROUNDS, BATCH, RATE, DECAY = 48, 40, 256, 2e-3, 1e-4
THRESHOLD = 0.7
#: The sum of context vectors travels in this many parts, and over this many groups of partitions first.
SLABS, GROUPS = 16, 64

TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


def slots(text: str | None) -> np.ndarray:
    found = TOKEN.findall((text or "").encode("utf-8", "surrogatepass"))
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)) % np.uint64(WORDS)).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(0, DIM, (WORDS, SIGNS)), rng.integers(0, 2, (WORDS, SIGNS)) * 2 - 1


def contexts(texts: list[np.ndarray], places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sums of neighbours' index vectors, flat over slots and dimensions; texts do not see each other."""
    gap = np.full(REACH, -1)
    row = np.concatenate([x for t in texts for x in (t, gap)])
    total = np.zeros(WORDS * DIM, np.int64)
    for start in range(0, len(row), 500_000):
        part = row[start : start + 500_000 + REACH]
        for d in range(1, REACH + 1):
            a, b = part[:-d], part[d:]
            last = min(len(a), 500_000)
            a, b = a[:last], b[:last]
            near = (a >= 0) & (b >= 0)
            for x, y in ((a[near], b[near]), (b[near], a[near])):
                total += np.bincount((x[:, None] * DIM + places[y]).ravel(), signs[y].ravel(), WORDS * DIM).astype(np.int64)
    return total


def context_sums(docs: DataFrame) -> np.ndarray:
    """Context vectors over all texts: a matrix of fixed size, summed over partitions in two steps."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, signs = index_vectors()
        total = np.zeros(WORDS * DIM, np.int64)
        for b in batches:
            texts = [slots(t) for t in b["text"]]
            if texts:
                total += contexts(texts, places, signs)
        group = TaskContext.get().partitionId() % GROUPS
        yield pd.DataFrame({"slab": range(SLABS), "grp": group, "sums": [x.tobytes() for x in np.split(total, SLABS)]})

    def added(b: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(WORDS * DIM // SLABS, np.int64)
        for x in b["sums"]:
            total += np.frombuffer(x, np.int64)
        return pd.DataFrame({"slab": [int(b["slab"].iloc[0])], "grp": [int(b["grp"].iloc[0])], "sums": [total.tobytes()]})

    kind = "slab int, grp int, sums binary"
    sums = narrow(docs, "text").filter("text IS NOT NULL").mapInPandas(run, kind)
    sums = sums.groupBy("slab", "grp").applyInPandas(added, kind).withColumn("grp", F.lit(0)).groupBy("slab").applyInPandas(added, kind)
    found = sorted(sums.select("slab", "sums").collect())
    if not found:
        return np.zeros((WORDS, DIM))
    return np.concatenate([np.frombuffer(x, np.int64) for _, x in found]).reshape(WORDS, DIM).astype(float)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    used = np.abs(sums).sum(axis=1) > 0
    vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    if used.any():
        vectors = (vectors - vectors[used].mean(axis=0)) * used[:, None]
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Features of a document; all zero without tokens."""
    own = slots(text)
    if not len(own):
        return np.zeros(2 * DIM + 3, np.float32)
    kinds, n = np.unique(own, return_counts=True)
    weight = (n / len(own)).astype(np.float32)
    mean = weight @ vectors[kinds]
    spread = np.sqrt(np.maximum(weight @ vectors[kinds] ** 2 - mean**2, 0))
    return np.concatenate([mean, spread, [np.log1p(len(own)) / 10, len(kinds) / len(own), np.linalg.norm(mean)]]).astype(np.float32)


class Network:
    """Two layers, ``tanh`` between them, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(3)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        w = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        held = np.arange(len(z)) % 5 == 0
        train = np.flatnonzero(~held) if held.sum() < len(z) else np.arange(len(z))
        for _ in range(ROUNDS):
            for rows in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
                h = np.tanh(z[rows] @ w[0] + w[1])
                off = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[rows]) / len(rows)
                back = np.outer(off, w[2]) * (1 - h * h)
                grads = [z[rows].T @ back + DECAY * w[0], back.sum(axis=0), h.T @ off + DECAY * w[2], off.sum(keepdims=True)]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.w, self.temperature = w, 1.0
        logit, truth = self.logits(x[held]), y[held]
        choices = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, -(2 * truth - 1) * logit / c).mean() for c in choices] if len(truth) else [0.0]
        self.temperature = float(choices[int(np.argmin(loss))]) if len(truth) else 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> Network | None:
    """The network, from at most ``SAMPLE`` labelled rows that are not held out, chosen by a hash of the id."""
    labelled = narrow(labels, "doc_id", "quality").filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    labelled = labelled.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = narrow(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most SAMPLE rows of two numbers

    @F.pandas_udf("binary")
    def pool(text: pd.Series) -> pd.Series:
        return text.map(lambda t: pooled(t, vectors).tobytes())

    found = rows.select("doc_id", "quality", pool("text").alias("x")).collect()
    found = sorted(found, key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"]).encode()), r["x"]))[: 2 * SAMPLE]
    if not found:
        return None
    return Network(np.stack([np.frombuffer(r["x"], np.float32) for r in found]).astype(float), np.array([float(r["quality"]) for r in found]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text, ..)``.

    Only the text goes into a score. Null and empty texts are scored from zero features. A null id is not held out. Labels
    with a null or other value than 0 and 1 are not learned from, for a repeated id the larger one counts; without any, each
    score is 0.5. Rows that repeat are scored alike. An empty table gives an empty table; other columns are left out.
    """
    small_batches(docs.sparkSession)
    vectors = word_vectors(context_sums(docs))
    network = fitted(docs, labels, vectors)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        if network is None:
            return pd.Series(np.full(len(text), 0.5))
        # row by row, so that a text's score does not depend on the batch that it comes in
        return pd.Series([float(network.scores(pooled(t, vectors)[None].astype(float))[0]) for t in text])

    out = narrow(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
