"""Compression of vectors to short codes: product quantisation whose nearest entries are found by Orchard search.

Vectors become integers, ``floor(256 * x)``, and are cut into equal parts; each part position has a codebook. For each entry
of a codebook the other entries are listed by their distance from it. The search for a part starts at one entry and walks
down its list; an entry that is nearer takes over with its own list, entries seen before are passed over, and a list ends
where its next entry is over twice as far from the present one as the part is: no entry behind it can be nearer.

Rounds are sums over rows: a task adds up its rows for each entry, Spark adds these up, and only the sums of the entries, a
number that the parameters fix, come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightdocs.llm.common import narrow, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components stay below this, so that sums of squares stay far within 64 bits.
LIMIT = 1 << 24
#: Parts that are searched at once.
ROWS = 65_536


def whole_numbers(vector, scale: int = SCALE):
    """``floor(scale * x)`` of each component, as Spark columns; an error where a number is too large for exact sums."""
    def number(x):
        y = F.floor(x.cast("double") * scale)
        return F.when((y < LIMIT) & (y > -LIMIT), y.cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LIMIT}")).cast("int"))
    return F.transform(vector, number)


def finite(vector):
    """The vector where it is there and all of its components are finite numbers, else null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, vector)


class Orchard:
    """One codebook with its neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        gap = self.entries[:, None, :] - self.entries[None, :, :]
        square = (gap * gap).sum(axis=2)
        self.order = np.argsort(square, axis=1, kind="stable")
        self.far = np.take_along_axis(square, self.order, axis=1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row; ties go to the lower index.

        All rows walk side by side. Squared distances turn "twice as far" into four times; an entry as near as the present
        one can be exactly that far, so a list is walked up to and including this distance.
        """
        n, k = len(parts), len(self.entries)
        gap = parts - self.entries[0]
        here, near = np.zeros(n, np.int64), (gap * gap).sum(axis=1)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        at = np.zeros(n, np.int64)
        live = np.arange(n)
        while len(live):
            own, place = here[live], at[live]
            go = (place < k) & (self.far[own, np.minimum(place, k - 1)] <= 4 * near[live])
            live, own, place = live[go], own[go], place[go]
            other = self.order[own, place]
            at[live] = place + 1
            new = ~seen[live, other]
            rows, other = live[new], other[new]
            seen[rows, other] = True
            gap = parts[rows] - self.entries[other]
            square = (gap * gap).sum(axis=1)
            better = (square < near[rows]) | ((square == near[rows]) & (other < here[rows]))
            rows = rows[better]
            here[rows], near[rows], at[rows] = other[better], square[better], 0
        return here, near


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """Where the consecutive parts of a vector begin and end; equal if ``parts`` divides ``width``."""
    at = [k * width // parts for k in range(parts + 1)]
    return list(zip(at, at[1:], strict=False))


def searched(books: list[Orchard], stacked: np.ndarray, spans: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for p, ((i, j), book) in enumerate(zip(spans, books, strict=True)):
        found = [book.nearest(stacked[k : k + ROWS, i:j]) for k in range(0, len(stacked), ROWS)]
        yield p, np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def stack(vectors: pd.Series, width: int) -> np.ndarray:
    return np.concatenate(vectors.to_list()).astype(np.int64).reshape(-1, width) if width and len(vectors) else np.zeros((len(vectors), width), np.int64)


def trained(vectors: DataFrame, width: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """Codebooks of ``vectors(vec_id, v)``, all of one width: ``rounds`` of nearest entries and floored means."""
    spans = cuts(width, parts)
    # the rows with the smallest ids, at most ``entries`` of them
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), width)
    books = [start[:, i:j] for i, j in spans]
    widest = max(j - i for i, j in spans)
    names = [f"s{k}" for k in range(widest)]

    for _ in range(rounds):
        def run(batches: Iterator[pd.DataFrame], books=books) -> Iterator[pd.DataFrame]:
            search = [Orchard(b) for b in books]
            total, n = np.zeros((parts, len(seeds), widest), np.int64), np.zeros((parts, len(seeds)), np.int64)
            for b in batches:
                stacked = stack(b["v"], width)
                for p, code, _ in searched(search, stacked, spans):
                    i, j = spans[p]
                    np.add.at(total[p, :, : j - i], code, stacked[:, i:j])
                    n[p] += np.bincount(code, minlength=len(seeds))
            p, e = np.nonzero(n)
            yield pd.DataFrame({"part": p, "entry": e, "n": n[p, e], **{c: total[p, e, k] for k, c in enumerate(names)}})

        sums = vectors.select("v").mapInPandas(run, ", ".join(["part int, entry int, n long", *[f"{c} long" for c in names]]))
        books = [b.copy() for b in books]
        # one row for each entry that is used
        for r in sums.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():
            i, j = spans[r["part"]]
            books[r["part"]][r["entry"]] = [r[c] // r["n"] for c in names[: j - i]]  # down, also below zero
    return books


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector in ``vectors(vec_id, embedding, label, ..)``.

    Null vectors and those with a null or non-finite component are left out. Vectors of one length share codebooks (one
    length in an ordinary table; each further one has codebooks of its own); where ``parts`` does not divide the length, parts differ
    by one component, and parts of an empty vector are entry 0 at no distance. Rows without an id come last among the first
    entries; rows that repeat an id, a vector or both are coded one by one. Null labels are one label. An empty table gives
    an empty table; other columns are left out. At most 256 entries fit two hex digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    rows = narrow(vectors, "vec_id", "embedding", "label").select("vec_id", "label", finite(F.col("embedding")).alias("v"))
    rows = written(rows.filter("v IS NOT NULL").select("vec_id", "label", whole_numbers(F.col("v")).alias("v"), F.size("v").alias("width")), "code-vectors")
    def coded(width: int) -> DataFrame:
        own = rows.filter(F.col("width") == width).select("vec_id", "label", "v")
        books = trained(own.select("vec_id", "v"), width, parts, entries, rounds)
        digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
        spans = cuts(width, parts)

        @F.pandas_udf("code string, error long")
        def found(v: pd.Series) -> pd.DataFrame:
            code, error = np.zeros((len(v), parts), np.uint8), np.zeros(len(v), np.int64)
            for p, entry, square in searched([Orchard(b) for b in books], stack(v, width), spans):
                code[:, p] = entry
                error += square
            return pd.DataFrame({"code": [c.tobytes().hex() for c in code], "error": error})

        return own.select("vec_id", "label", found("v").alias("found")).select(
            "vec_id", "label", "found.code", "found.error", F.lit(digest).alias("codebooks_sha256"))

    widths = [r["width"] for r in rows.select("width").distinct().collect()]
    found = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256")).limit(0)
    for width in sorted(widths):
        found = found.unionByName(coded(width))
    found = written(found, "codes")
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = found.join(by_label, found["label"].eqNullSafe(by_label["_label"]))
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
