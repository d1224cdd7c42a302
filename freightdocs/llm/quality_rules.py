"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target to the raw corpus, and plain counts.

Every text is read as hashed words and word pairs. Their counts over all texts, and over the texts that are marked as good,
give two multinomials of ``BUCKETS`` outcomes (add-one smoothed). A text's score is the mean log ratio of the two over its
n-grams, so it does not depend on the length; it is compared with one threshold, without any draw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightdocs.llm.common import ascii_words, narrow, release, small_batches, window_codes, word_codes

BUCKETS = 16384
#: Mean log ratio for one n-gram under which a text is rejected.
MIN_SCORE = -0.07
MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
            "score double, kept boolean")


def ngram_buckets(codes: np.ndarray) -> np.ndarray:
    pairs = window_codes(codes, 2)
    return (np.concatenate([window_codes(codes, 1), pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """N-gram counts of all texts. A task sends at most ``BUCKETS`` rows, and so does the grouped sum."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            found = [ngram_buckets(word_codes(ascii_words(t, lower=False))) for t in b["text"]]
            total += np.bincount(np.concatenate(found), minlength=BUCKETS) if found else 0
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    sums = narrow(docs, "text").filter("text IS NOT NULL").mapInPandas(run, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in sums.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def log_ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Log ratio for each bucket; ``trusted(doc_id)`` names the texts of the target. Zero where there are none."""
    small_batches(docs.sparkSession)
    # the trusted ids grow with the input, so they are not broadcast at any size
    good = narrow(docs, "doc_id", "text").join(narrow(trusted, "doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    target, raw = bucket_counts(good), bucket_counts(docs)
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def repeated_words(codes: np.ndarray, size: int = 8) -> int:
    """Words inside ``size``-word windows that occur twice or more, the first occurrence included."""
    windows = window_codes(codes, size)
    if len(windows) < 2:
        return 0
    _, at, n = np.unique(windows, return_inverse=True, return_counts=True)
    edge = np.zeros(len(codes) + 1, np.int64)
    starts = np.flatnonzero(n[at] > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def measure(text: str | None, ratios: np.ndarray, min_score: float) -> tuple:
    text = text or ""
    codes = word_codes(ascii_words(text, lower=False))
    n, repeat = len(codes), repeated_words(codes)
    failed = n < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * n
    score = float(ratios[ngram_buckets(codes)].mean()) if n else 0.0
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeat, failed, score,
            not failed and score >= min_score)


def measures(text: Column, ratios: np.ndarray, min_score: float = MIN_SCORE) -> Column:
    """The struct ``MEASURES`` of a text. A null text counts as empty: no words, score 0, ``base_failed``."""
    names = [x.split()[0] for x in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def run(texts: pd.Series) -> pd.DataFrame:
        release()
        return pd.DataFrame([measure(t, ratios, min_score) for t in texts], columns=names)

    return run(text)


def score_documents(docs: DataFrame, trusted: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``doc_id`` and the measures of every row; repeated rows and null ids are measured like others; other columns are left out."""
    found = narrow(docs, "doc_id", "text").select("doc_id", measures(F.col("text"), log_ratios(docs, trusted), min_score).alias("m"))
    return found.select("doc_id", "m.*")


def passing(docs: DataFrame, trusted: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that pass."""
    return docs.filter(measures(F.col("text"), log_ratios(docs, trusted), min_score)["kept"])


def trusted_rows(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("quality") == 1).select("doc_id")
