"""Alignment of two tokenizers over a corpus, each distinct text once.

Rows are grouped by their full text, so that every distinct text is encoded and aligned in one place and its pair counts
weigh as often as the text occurs. Both tokenizers cut the same bytes; where a token of each ends, a group ends, and the two
tokens that end there are linked. Of two linked tokens one is always a suffix of the other, so the possible pairs follow from
the vocabularies alone (``Vocabulary.pairs``): their table, and therefore what is broadcast and what comes back to the driver,
has a size that no corpus changes. Measures of a text go back to its rows by the SHA-256 of the text.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightdocs.llm.common import narrow, small_batches, written

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: Characters of the texts that a task encodes at once.
CHARACTERS = 4_000_000


def byte_of_character() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for themselves, the others, in order, follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Fixed value: how byte-level BPE models of this kind cut a text before they merge.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def rank_encoder(a_path: str, token_bytes: list[bytes]):
    """The same model for ``tiktoken``, which is several times as fast; None if its ids are not in the order of its merges."""
    import tiktoken

    with open(a_path, encoding="utf-8") as f:
        own = json.load(f)
    vocab, merges = own["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in own["model"]["merges"]]
    made = [vocab[x + y] for x, y in merges]
    plain = own["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or own.get("normalizer") or made != list(range(256, len(token_bytes))):
        return None
    return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks={t: i for i, t in enumerate(token_bytes)}, special_tokens={})


def spells(data: np.ndarray, ids: np.ndarray, length: np.ndarray, start: np.ndarray, flat: np.ndarray) -> bool:
    """Whether the bytes of the tokens ``ids`` are ``data``; a token's bytes begin at ``start`` in ``flat``."""
    own = length[ids]
    if own.sum() != len(data):
        return False
    shift = start[ids] - (np.cumsum(own) - own)
    return np.array_equal(flat[np.arange(len(data)) + np.repeat(shift, own)], data)


class Vocabulary:
    """Both models and the bytes of each of their ids. One per Python worker, see ``vocabulary``."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        code = byte_of_character()
        names = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(names.values()))
        for name, i in names.items():
            self.a_bytes[i] = bytes(code[c] for c in name) if all(c in code for c in name) else name.encode()
        self.ranks = rank_encoder(a_path, self.a_bytes)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_start, self.b_start = (np.cumsum(n) - n for n in (self.a_length, self.b_length))
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(t), np.uint8) for t in (self.a_bytes, self.b_bytes))
        # decimal ids with what may stand behind them: within a side, at its end
        self.names = np.array([f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for i in range(n)], "S8")

    @cached_property
    def pairs(self) -> np.ndarray:
        """Sorted codes ``a << 32 | b`` of all id pairs of which one token's bytes end with the other's: all that can ever be linked."""
        by_bytes: tuple[dict[bytes, list[int]], ...] = (defaultdict(list), defaultdict(list))
        for table, tokens in zip(by_bytes, (self.a_bytes, self.b_bytes), strict=True):
            for i, token in enumerate(tokens):
                table[token].append(i)
        found = []
        for b, token in enumerate(self.b_bytes):
            found += [a << 32 | b for k in range(len(token)) for a in by_bytes[0].get(token[k:], ())]
        for a, token in enumerate(self.a_bytes):
            found += [a << 32 | b for k in range(1, len(token)) for b in by_bytes[1].get(token[k:], ())]
        return np.unique(np.array(found, np.int64))

    def encode_a(self, text: str) -> list[int]:
        try:
            if self.ranks:
                return self.ranks.encode_ordinary(text)
        except BaseException as failed:  # its pattern engine gives up on blanks by the million, with an error of its own
            if not type(failed).__name__ == "PanicException":
                raise
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both models; none where the joined bytes of one are not a space and the text."""
        left = [self.encode_a(" " + t) for t in texts]
        right = self.b.encode(texts, num_threads=1)
        out = []
        for text, x, y in zip(texts, left, right, strict=True):
            data = np.frombuffer((" " + text).encode(), np.uint8)
            x, y = np.array(x, np.int64), np.array(y, np.int64)
            if not text or not spells(data, x, self.a_length, self.a_start, self.a_flat) or not spells(data, y, self.b_length, self.b_start, self.b_flat):
                x = y = np.empty(0, np.int64)
            out.append((x, y))
        return out

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, str]:
        """Number of groups, the linked pairs as places in ``pairs``, the hash of the groups."""
        if not len(a):
            return 0, np.empty(0, np.int64), ""
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        near = np.searchsorted(b_end, a_end)  # both end with the text, so there is an end of b at or behind each of a
        i = np.flatnonzero(b_end[near] == a_end)
        j = near[i]
        linked = np.searchsorted(self.pairs, a[i] << 32 | b[j])
        # each side of a group behind what stands before it: a's tokens behind b's of earlier groups, b's behind a's of their own group too
        a_group, b_group = (np.searchsorted(ends, np.arange(n)) for ends, n in ((i, len(a)), (j, len(b))))
        a_before, b_before = np.concatenate([[0], i + 1]), np.concatenate([[0], j + 1])
        token = np.empty(len(a) + len(b), np.int64)
        a_code, b_code = a.copy(), b + 2 * len(self.a_bytes)
        a_code[i] += len(self.a_bytes)
        b_code[j] += len(self.b_bytes)
        token[np.arange(len(a)) + b_before[a_group]] = a_code
        token[np.arange(len(b)) + a_before[b_group + 1]] = b_code
        listed = self.names[token].tobytes().translate(None, b"\0")
        return len(i), linked, hashlib.sha256(listed[:-1]).hexdigest()


@lru_cache(maxsize=2)
def vocabulary(a_path: str, b_path: str) -> Vocabulary:
    return Vocabulary(a_path, b_path)


def aligned_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per distinct text with tokens: ``key, copies, n_a, n_b, n_groups, groups_sha256, linked`` (int32 places in ``pairs``)."""
    small_batches(docs.sparkSession)
    texts = narrow(docs, "text").filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc = vocabulary(a_path, b_path)
        for b in batches:
            rows = []
            weight = np.cumsum([len(t) for t in b["text"]]) // CHARACTERS
            for _, part in b.groupby(weight, sort=False):
                own = part["text"].tolist()
                for text, copies, (x, y) in zip(own, part["copies"], voc.encode(own), strict=True):
                    n, linked, sha = voc.align(x, y)
                    rows.append((hashlib.sha256(text.encode()).digest(), copies, len(x), len(y), n, sha, linked.astype("<i4").tobytes()))
            yield pd.DataFrame(rows, columns=["key", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "linked"])

    return written(texts.mapInPandas(
        run, "key binary, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, linked binary"), "aligned-texts")


def pair_counts(aligned: DataFrame, n_pairs: int) -> DataFrame:
    """``(place, n)``: how many links of the whole corpus hold each pair; texts weigh as often as they occur."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_pairs, np.int64)
        for b in batches:
            for copies, linked in zip(b["copies"], b["linked"], strict=True):
                place, n = np.unique(np.frombuffer(linked, "<i4"), return_counts=True)
                total[place] += copies * n
        place = np.flatnonzero(total)
        yield pd.DataFrame({"place": place, "n": total[place]})

    return aligned.select("copies", "linked").mapInPandas(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs(doc_id, text, ..)``.

    ``a_path`` is a byte-level BPE for ``tokenizers``, which encodes a space and the text, ``b_path`` a sentencepiece model
    that adds this space itself. Null and empty texts, and those that one model doesn't keep byte for byte, have no tokens:
    zeros and an empty hash. Long texts are encoded whole. Rows with equal texts count as often as there are of them and get
    the same measures; ids may be null or repeated. An empty table gives an empty table; other columns are left out.
    """
    texts = aligned_texts(docs, a_path, b_path)
    pairs = vocabulary(a_path, b_path).pairs
    counts = np.zeros(len(pairs), np.int64)
    found = pair_counts(texts, len(pairs)).toArrow()  # at most one row for each possible pair of the vocabularies
    counts[found["place"].to_numpy()] = found["n"].to_numpy()
    best = np.zeros(1 + int((pairs & 0xFFFFFFFF).max()), np.int64)
    np.maximum.at(best, pairs & 0xFFFFFFFF, counts)
    table = docs.sparkSession.sparkContext.broadcast((counts, (counts > 0) & (counts == best[pairs & 0xFFFFFFFF])))

    @F.pandas_udf("n_best long, count_sum long")
    def measured(linked: pd.Series) -> pd.DataFrame:
        count, highest = table.value
        own = [np.frombuffer(x, "<i4") for x in linked]
        return pd.DataFrame({"n_best": [int(highest[x].sum()) for x in own], "count_sum": [int(count[x].sum()) for x in own]})

    ready = texts.withColumn("own", measured("linked")).select(
        "key", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "own.n_best", "own.count_sum", "groups_sha256")
    rows = narrow(docs, "doc_id", "text").select("doc_id", F.unhex(F.sha2(F.col("text"), 256)).alias("key"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in MEASURES]
    return rows.join(ready, "key", "left").select("doc_id", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def pair_table(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The pairs themselves: ``a_id, b_id, a_token, b_token, n`` (tokens as bytes) of every pair that is linked somewhere."""
    pairs = vocabulary(a_path, b_path).pairs
    n = len(pairs)

    @F.pandas_udf("a_id long, b_id long, a_token binary, b_token binary")
    def named(place: pd.Series) -> pd.DataFrame:
        voc = vocabulary(a_path, b_path)
        code = voc.pairs[place.to_numpy()]
        a, b = code >> 32, code & 0xFFFFFFFF
        return pd.DataFrame({"a_id": a, "b_id": b, "a_token": [voc.a_bytes[i] for i in a], "b_token": [voc.b_bytes[i] for i in b]})

    return pair_counts(aligned_texts(docs, a_path, b_path), n).withColumn("pair", named("place")).select("pair.*", "n")
