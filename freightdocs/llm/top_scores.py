"""Exact nearest vectors by inner product: columnar branch and bound.

Vectors are dealt into blocks that are stored upright, one row of numbers per dimension. A query goes through a block some
dimensions at a time, those that hold most of its length first. After each step a candidate's score lies within ``length of
the query's rest * length of the candidate's rest`` of what is summed up; whatever cannot reach the best ``k`` any more is
dropped, and the vectors that are left are moved together before the next step. Only survivors of all dimensions have scores.

Each query first meets its own block; its ``k``-th score there bounds the search in all other blocks, which therefore put out
few rows. Spark joins blocks of candidates with blocks of queries and keeps the best of the blocks' results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightdocs.llm.codes import finite, whole_numbers
from freightdocs.llm.common import narrow, written

#: Vectors in a block of candidates and in one of queries, at most about; small tables have smaller blocks, for more tasks.
BLOCK, QUERIES = 8192, 2048
#: Dimensions of one step.
STEP = 8
#: Tasks that pairs of blocks are dealt to, at most.
MOST_TASKS = 100_000
LOWEST = np.iinfo(np.int64).min


def upright(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps x dimensions x vectors, filled up with zeros, and the squared length of each vector in each step."""
    steps = max(1, -(-rows.shape[1] // STEP))
    v = np.zeros((steps * STEP, len(rows)), np.int64)
    v[: rows.shape[1]] = rows.T
    v = v.reshape(steps, STEP, len(rows))
    return v, (v * v).sum(axis=1)


def ranked(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        own = np.flatnonzero(score >= least)
    else:
        own = np.arange(len(score))
    return own[np.lexsort((ids[own], -score[own]))][:k]


def searched(v: np.ndarray, mass: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own_row: int, least: int, k: int):
    """``(ids, scores)`` of the best ``k`` candidates for one query that score at least ``least``; its own row is none."""
    steps = len(v)
    q = np.zeros(steps * STEP, np.int64)
    q[: len(query)] = query
    q = q.reshape(steps, STEP)
    q_mass = (q * q).sum(axis=1)
    order = np.argsort(-q_mass, kind="stable")
    live = np.flatnonzero(rows != own_row)
    whole = len(live) == len(rows)
    score, rest = np.zeros(len(live), np.int64), mass.sum(axis=0)[live]
    q_rest = int(q_mass.sum())
    for s in order:
        score += q[s] @ (v[s] if whole else v[s][:, live])
        rest -= mass[s] if whole else mass[s, live]
        q_rest -= int(q_mass[s])
        # rounded up: a bound may be too wide, never too narrow
        room = np.ceil(np.sqrt(float(q_rest) * rest.astype(np.float64)) * (1 + 1e-9)).astype(np.int64) if q_rest else 0
        low = score - room
        if len(low) > k:
            least = max(least, int(np.partition(low, len(low) - k)[len(low) - k]))
        keep = score + room >= least
        if not keep.all():
            live, score, rest = live[keep], score[keep], rest[keep]
            whole = False
        if not len(live):
            break
    best = ranked(score, ids[live], k)
    return ids[live[best]], score[best]


def top_scores(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` (over ``vec_id``) names the ``k`` best other rows.

    Components count as ``floor(256 * x)``, scores are exact integers, ties go to the smaller ``vec_id``. Null vectors, those
    with a null or non-finite component and rows without an id take no part. Vectors meet those of their own length only.
    Rows that repeat an id are rows of their own: each is a candidate for the other, and both as queries have their lists
    (two rows for each rank). Fewer than ``k`` other rows give shorter lists, an empty table an empty one; other columns are
    left out. Blocks are dealt by row, so neither repeated ids nor repeated vectors gather anywhere.
    """
    rows = narrow(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), finite(F.col("embedding")).alias("v"))
    rows = rows.filter("v IS NOT NULL AND vec_id IS NOT NULL").select(
        "vec_id", whole_numbers(F.col("v")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows.withColumn("dim", F.size("v")), "top-vectors")
    count, asked = rows.agg(F.count("*"), F.count_if("asked")).first()
    blocks, parts = max(-(-count // BLOCK), min(16, -(-count // 256)), 1), max(1, -(-asked // QUERIES))

    def block_of(n: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    def packed(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("row")
        v = np.array(b["v"].to_list(), "<i4").reshape(len(b), int(key[0]))
        least = b["least"].to_numpy(np.int64) if "least" in b else np.where(b["asked"], 1, 0).astype(np.int64)
        return pd.DataFrame([(*map(int, key), *(x.astype("<i8").tobytes() for x in (b["vec_id"].to_numpy(), b["row"].to_numpy(), least)), v.tobytes())],
                            columns=["dim", "block", "ids", "rows", "least", "v"])

    shape = "dim int, block int, ids binary, rows binary, least binary, v binary"
    candidates = written(rows.withColumn("block", block_of(blocks)).groupBy("dim", "block").applyInPandas(packed, shape), "top-blocks")

    def unpacked(dim: int, ids: bytes, own: bytes, least: bytes, v: bytes):
        return *(np.frombuffer(x, "<i8") for x in (ids, own, least)), np.frombuffer(v, "<i4").reshape(-1, dim).astype(np.int64) if dim else np.zeros((len(ids) // 8, 0), np.int64)

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids, own, is_asked, v = unpacked(r.dim, r.ids, r.rows, r.least, r.v)
                steps, mass = upright(v)
                found = []
                for n in np.flatnonzero(is_asked):
                    _, score = searched(steps, mass, ids, own, v[n], own[n], LOWEST, k)
                    found.append((own[n], int(score[-1]) if len(score) == k else LOWEST))
                yield pd.DataFrame(found, columns=["row", "least"]).astype("int64")

    # a block's queries are among its own rows, so nothing is joined for the first bounds
    bounds = candidates.mapInPandas(at_home, "row long, least long")
    queries = rows.filter("asked").select("dim", "vec_id", "row", "v").join(bounds, "row").withColumn("block", block_of(parts))
    queries = queries.groupBy("dim", "block").applyInPandas(packed, shape)
    queries = written(queries.select("dim", F.col("block").alias("part"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "least", "v")]), "top-queries")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids, own, _, v = unpacked(r.dim, r.ids, r.rows, r.least, r.v)
                q_ids, q_own, least, q = unpacked(r.dim, r.q_ids, r.q_rows, r.q_least, r.q_v)
                steps, mass = upright(v)
                found = [(n, *searched(steps, mass, ids, own, q[n], q_own[n], least[n], k)) for n in range(len(q))]
                n = np.repeat([x[0] for x in found], [len(x[1]) for x in found]).astype(np.int64)
                yield pd.DataFrame({"query_row": q_own[n], "query_id": q_ids[n], "vec_id": np.concatenate([x[1] for x in found]),
                                    "score": np.concatenate([x[2] for x in found])})

    # one key for each pair of blocks: every task gets its own blocks of both sides, by a shuffle of bounded rows
    tasks = min(blocks * parts, MOST_TASKS)
    key = ("dim", "block", "part")
    left = candidates.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(tasks, *key)
    right = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).repartition(tasks, *key)
    found = left.join(right, list(key)).mapInPandas(meet, "query_row long, query_id long, vec_id long, score long")
    # the limit by rank is applied in each task before the shuffle
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
