"""Near-duplicate texts by an inverted join on signature coordinates.

Each text becomes the set of its word windows and a signature of ``COORDINATES`` minima. A coordinate with its value is a
posting key. Two texts link only if at least ``least_matches`` coordinates agree, so

* keys are ordered by how many texts hold them. Keys of one text are worth nothing; a text with too few others is out;
* by the prefix rule two matching texts share a key among the first ``COORDINATES - t + 1`` of each, the rarest: only
  these are posted, so frequent passages make no long lists unless whole texts are alike;
* each list is first joined with its smallest text only (linear in the list). Links that hold on the full sets give
  components, and the merge then skips what is in one component: a list goes on only if it still holds two of them;
* such lists are cut into blocks and compared block by block inside tasks; each pair is looked at in the first list that
  it shares. A block pair puts out partner lists of the texts it cannot rule out, gets the full sets of these alone, and
  puts out a spanning forest of the links that hold.

The threshold misses a link at exactly the given similarity with a probability under 1e-9; what is linked is always
confirmed on full sets, of 64-bit window codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightdocs.llm.common import least_matches, narrow, release, shingle_set, shuffled, small_batches, written
from freightdocs.llm.components import components

COORDINATES = 64
BLOCK = 512


def _factors() -> np.ndarray:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(codes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest of ``factor * code`` per factor, top 32 bits, in slices of bounded memory."""
    step = max(1, 2_000_000 // len(factors))
    low = np.min([np.multiply.outer(codes[i : i + step], factors).min(axis=0) for i in range(0, len(codes), step)], axis=0)
    return (low >> np.uint64(32)).astype(np.uint32)


def shingled(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, sig`` of every row; key and signature are null for a text without words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        factors = _factors()
        for b in batches:
            sets = [shingle_set(t, size) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"),
                "n_shingles": [len(s) for s in sets],
                "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "sig": [minima(s, factors).tobytes() if len(s) else None for s in sets],
            })

    return narrow(docs, "doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def _postings(reps: DataFrame, least: int) -> DataFrame:
    """``token, rep`` for the rarest keys of each text that can match another one at all."""
    @F.pandas_udf("array<long>")
    def tokens(sig: pd.Series) -> pd.Series:
        at = np.arange(COORDINATES, dtype=np.int64) << 32
        return sig.map(lambda s: np.frombuffer(s, np.uint32).astype(np.int64) + at)

    every = reps.select("rep", F.explode(tokens("sig")).alias("token"))
    common = every.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    shared = every.join(shuffled(common), "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("keys"))
    shared = shared.filter(F.size("keys") >= least)
    # the keys of one text alone come first in the order and fill the prefix
    prefix = F.slice("keys", 1, F.greatest(F.lit(0), F.size("keys") - F.lit(least - 1)))
    return shared.select("rep", F.explode(prefix).alias("key")).select("rep", "key.held", "key.token")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets have ``den * intersection >= num * union``."""
    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        kept: dict[str, np.ndarray] = {}

        def of(t: str) -> np.ndarray:
            if t not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[t] = shingle_set(t, size)
            return kept[t]

        out = []
        for s, t in zip(x, y, strict=True):
            out.append(_alike(of(s), of(t), num, den))
        return pd.Series(out)

    with_a = pairs.join(shuffled(texts.select(F.col("rep").alias("a"), F.col("text").alias("x"))), "a")
    with_b = with_a.join(shuffled(texts.select(F.col("rep").alias("b"), F.col("text").alias("y"))), "b")
    return with_b.filter(alike("x", "y")).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs(doc_id, text, ..)``.

    Texts link if ``den * intersection >= num * union`` of their sets of ``size``-word windows (lower-cased A-Z; a shorter
    text is one window). ``component_id`` is the smallest id that links can reach. Null, empty and blank texts have an empty
    set and link with nothing. A row without an id links with nothing and is kept with a null component. Rows that repeat an
    id count as one node; equal texts are one class, represented by its smallest id, and are never compared with each other.
    An empty table gives an empty table; other columns are ignored.
    """
    least = least_matches(COORDINATES, num / den)
    rows = written(shingled(docs, size), "minhash-rows")
    usable = rows.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    reps = usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    reps = written(reps, "minhash-classes")
    posts = written(_postings(reps.select("rep", "sig"), least), "minhash-postings")

    # the texts of what is posted, the only ones that are needed again
    posted = posts.select("rep").distinct()
    texts = narrow(docs, "doc_id", "text").filter("text IS NOT NULL").withColumnRenamed("doc_id", "rep")
    texts = written(texts.join(posted, "rep", "left_semi"), "minhash-texts")
    marks = written(reps.select("rep", "sig").join(posted, "rep", "left_semi"), "minhash-marks")

    @F.pandas_udf("boolean")
    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = (np.frombuffer(b"".join(s), np.uint32).reshape(len(s), COORDINATES) for s in (x, y))
        return pd.Series((p == q).sum(axis=1) >= least)

    heads = posts.groupBy("token").agg(F.min("rep").alias("a"))
    pairs = posts.join(shuffled(heads), "token").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    pairs = pairs.join(marks.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a")
    pairs = pairs.join(marks.select(F.col("rep").alias("b"), F.col("sig").alias("y")), "b")
    pairs = written(pairs.filter(close("x", "y")).select("a", "b").distinct(), "minhash-pairs")
    first = written(_confirmed(pairs, texts, size, num, den), "minhash-links")
    part = components(first, "minhash-first")

    # lists that still hold more than one component, block by block
    marked = posts.join(part.withColumnRenamed("node", "rep"), "rep", "left").select(
        "token", "held", "rep", F.coalesce("component", "rep").alias("part"))
    open_lists = marked.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n")) \
        .filter("p <> q").select("token", "n")
    open_posts = written(marked.join(shuffled(open_lists), "token"), "minhash-open")
    rest = written(_partners(open_posts, marks, least), "minhash-partners")
    second = _confirmed_in_tiles(rest, texts, size, num, den)
    part = components(first.unionByName(second), "minhash-all")

    # from classes back to all rows
    of_class = reps.select("set_key", "rep").join(shuffled(part.withColumnRenamed("node", "rep")), "rep", "left") \
        .select("set_key", F.coalesce("component", "rep").alias("component_id"))
    nodes = usable.select("doc_id", "set_key").join(shuffled(of_class), "set_key").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(shuffled(nodes), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _whole_tiles(batches: Iterator[pd.DataFrame], tile: list[str]) -> Iterator[pd.DataFrame]:
    """Tiles one by one from batches of rows that are sorted by tile; a tile may go over several batches."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        new = (b[tile] != b[tile].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        if held and (b[tile].iloc[0] == held[-1][tile].iloc[-1]).all():
            new = new[1:]
        start = 0
        for at in new:
            if at > start:
                held.append(b.iloc[start:at])
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            start = at
        held.append(b.iloc[start:])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


TILE = ["token", "i", "j"]


def _by_tile(rows: DataFrame) -> DataFrame:
    """Most tiles hold a few rows, so they are read in sorted runs instead of one call for each."""
    return rows.repartition(*TILE).sortWithinPartitions(*TILE, "rep")


def _partners(posts: DataFrame, marks: DataFrame, least: int) -> DataFrame:
    """``token, i, j, rep, part, partners``: for each text of a tile the later ones that it may link with.

    A list of n texts is cut into ``ceil(n / BLOCK)`` blocks by a hash of the id; every two of them meet in a task, which
    holds about two blocks. Only texts with a partner, or that are one, are put out.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = posts.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("token", "rep", "part", "own", other.alias("other"))
    rows = rows.select("token", "rep", "part", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    prefix = posts.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("keys")) \
        .select("rep", F.transform("keys", lambda k: k["token"]).alias("keys"))
    rows = rows.join(shuffled(marks.join(shuffled(prefix), "rep")), "rep")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole_tiles(batches, TILE):
            token, i, j = (int(b[c].iloc[0]) for c in TILE)
            sig = np.frombuffer(b"".join(b["sig"]), np.uint32).reshape(len(b), COORDINATES)
            rep, part, own = (b[c].to_numpy() for c in ("rep", "part", "own"))
            keys = [k.tolist() for k in b["keys"]]
            before = [set(k[: k.index(token)]) for k in keys]
            found: dict[int, list[int]] = {}
            for x in range(len(b) - 1):
                meet = part[x + 1 :] != part[x]
                if i != j:
                    meet &= own[x + 1 :] != own[x]
                at = np.flatnonzero(meet) + x + 1
                at = at[(sig[at] == sig[x]).sum(axis=1) >= least]
                mine = [int(rep[y]) for y in at if rep[y] != rep[x] and before[x].isdisjoint(before[y])]
                if mine:
                    found.setdefault(int(rep[x]), []).extend(mine)
                    for y in mine:
                        found.setdefault(y, [])
            if found:
                of = dict(zip(rep.tolist(), part.tolist(), strict=True))
                yield pd.DataFrame([(token, i, j, r, of[r], p) for r, p in found.items()], columns=["token", "i", "j", "rep", "part", "partners"])

    return _by_tile(rows).mapInPandas(run, "token long, i int, j int, rep long, part long, partners array<long>")


def _confirmed_in_tiles(rest: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links ``a, b`` among partners on full sets; pairs that links of the same tile already connect are skipped."""
    @F.pandas_udf("binary")
    def codes(text: pd.Series) -> pd.Series:
        return text.map(lambda t: shingle_set(t, size).tobytes())

    needed = texts.join(rest.select("rep").distinct(), "rep", "left_semi")
    rows = rest.join(shuffled(needed.select("rep", codes("text").alias("codes"))), "rep")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole_tiles(batches, TILE):
            sets: dict[int, list[np.ndarray]] = {}
            for r, c in zip(b["rep"], b["codes"], strict=True):
                sets.setdefault(int(r), []).append(np.frombuffer(c, np.uint64))
            top = {int(p): int(p) for p in b["part"]}
            of = dict(zip(map(int, b["rep"]), map(int, b["part"]), strict=True))

            def root(x: int, top: dict = top) -> int:
                while top[x] != x:
                    top[x] = top[top[x]]
                    x = top[x]
                return x

            links = []
            for r, partners in zip(b["rep"], b["partners"], strict=True):
                for y in map(int, partners):
                    p, q = root(of[int(r)]), root(of[y])
                    if p != q and any(_alike(s, t, num, den) for s in sets[int(r)] for t in sets[y]):
                        top[p] = q
                        links.append((int(r), y))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return _by_tile(rows).mapInPandas(run, "a long, b long")


def _alike(p: np.ndarray, q: np.ndarray, num: int, den: int) -> bool:
    small, large = min(len(p), len(q)), max(len(p), len(q))
    if den * small < num * large:
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return den * both >= num * (small + large - both)


def representatives(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is the smallest of its group.

    Rows that repeat an id are one document: the one with the smallest text stays. Rows without an id all stay.
    """
    kept = near_duplicates(docs, size, num, den).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = docs.select("doc_id", F.struct(F.col("text"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__row"))
    one = rows.join(shuffled(kept), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("__row").alias("__row"))
    back = [F.col(f"__row.`{c}`") for c in docs.columns]
    return one.select(*back).unionByName(docs.filter("doc_id IS NULL"))
