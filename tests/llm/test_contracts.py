"""Each operator's digest against a brute-force version, on awkward rows and on whole small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import empty, rows, table
from pyspark.sql import functions as F

from freightdocs.llm import licenses, line_chunks, minhash, packing, quality_rules, secrets
from freightdocs.llm.common import least_matches, tokenizer_path
from freightdocs.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def counted(found, columns):
    return Counter(tuple(r[c] for c in columns) for r in found)


def packed(texts, capacity=4096):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for i, t in texts:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            yield i, k, s, len(part), zlib.crc32(part.tobytes())


def check_packing(found, texts, capacity=4096):
    assert counted(found, ("doc_id", "piece", "start", "length", "ids_crc32")) == Counter(packed(texts, capacity))
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in found)
    assert len(bins) <= 1.02 * total / capacity + 1


def test_packing(spark, docs):
    check_packing(QUERIES["op1_best_fit_packing"](spark, SF).collect(), docs)
    few = [(i, t) for i, t, *_ in rows()]
    check_packing(packing.pack(table(spark), tokenizer_path("word_bpe_49k.json")).collect(), few)
    small = packing.pack(table(spark), tokenizer_path("word_bpe_49k.json"), capacity=64, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in small)
    assert counted(small, ("doc_id", "piece", "start", "length", "ids_crc32")) == Counter(packed(few, 64))
    assert packing.pack(empty(spark), tokenizer_path("word_bpe_49k.json")).count() == 0


def groups(texts, size, num, den):
    sets = []
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + min(size, len(w))]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    low = {i: i for i, _ in sets if i is not None}
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and None not in (a, b)
             and den * len(s & t) >= num * len(s | t)]
    for _ in low:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return Counter((i, len(s), low.get(i), i is None or low[i] == i) for i, s in sets)


@pytest.mark.parametrize(("size", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_near_duplicates(spark, docs, size, num, den):
    columns = ("doc_id", "n_shingles", "component_id", "kept")
    for frame, texts in ((table(spark), [(i, t) for i, t, *_ in rows()]), (spark.createDataFrame(docs, "doc_id long, text string"), docs)):
        assert counted(minhash.near_duplicates(frame, size, num, den).collect(), columns) == groups(texts, size, num, den)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert least_matches(64, 0.85) < 54


def test_near_duplicates_without_a_hub(spark, monkeypatch):
    """A chain and a ring of edits: links that the first pass, with the smallest id of a list alone, does not find."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(60):
        own = list(words)
        for j in range(k + 1):
            own[(7 * j) % 400] = f"e{j}"
        texts.append((1000 - k, " ".join(own)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert counted(minhash.near_duplicates(frame, 3, 85, 100).collect(), ("doc_id", "n_shingles", "component_id", "kept")) == groups(texts, 3, 85, 100)


def one_of_each(spark):
    kept = minhash.representatives(table(spark))
    return [r.doc_id for r in kept.collect()]


def test_representatives(spark):
    kept = one_of_each(spark)
    assert sorted(i for i in kept if i in (1, 2, 3, 7, 8, 15)) == [1, 7, 15] and kept.count(None) == 2
    assert minhash.representatives(table(spark)).columns == table(spark).columns


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
KINDS = (("assign", ASSIGN, 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32))


def spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, g, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


def test_secrets(spark, docs):
    few = [(i, t) for i, t, *_ in rows()]
    for frame, texts in ((table(spark), few), (spark.createDataFrame(docs, "doc_id long, text string"), docs)):
        found = secrets.scan(frame).select("doc_id", secrets.listed(F.col("base")).alias("base"), secrets.listed(F.col("spans")).alias("spans")).collect()
        want = [(i, ",".join(f"{k}:{s}:{e}" for k, s, e in spans(t))) for i, t in texts]
        assert counted(found, ("doc_id", "base")) == Counter(want)
        assert all(set(r.base.split(",")) <= set(r.spans.split(",")) | {""} for r in found)
    digest = {r.doc_id: r for r in QUERIES["op8_secret_scan"](spark, SF).collect()}
    for i, t in docs:
        base = spans(t)
        assert digest[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert (digest[i].n_assign, digest[i].n_access, digest[i].n_hex) == tuple(sum(b[0] == k for b in base) for k in ("assign", "access", "hex"))
    extra = {r.doc_id: r.spans for r in secrets.scan(table(spark)).select("doc_id", secrets.listed(F.col("spans")).alias("spans")).collect()}
    assert extra[22] == "random:4:36" and extra[12] == ""
    hidden = {r.doc_id: r.text for r in secrets.redacted(table(spark)).collect()}
    assert hidden[22].startswith("key [random] end Good") and hidden[4] is None and hidden[1] == dict(few)[1]
    assert secrets.scan(empty(spark)).count() == 0


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    again = len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)})
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, again, len(w) < 20 or 100 * again > 30 * len(w))


def test_quality_rules(spark, docs):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = QUERIES["op9_quality_rules"](spark, SF).collect()
    assert counted(found, columns) == Counter((i, *rules(t)) for i, t in docs)
    good = spark.createDataFrame([(1,), (3,), (None,)], "doc_id long")
    few = quality_rules.score_documents(table(spark), good).collect()
    assert counted(few, columns) == Counter((i, *rules(t)) for i, t, *_ in rows())
    assert quality_rules.score_documents(empty(spark), good).count() == 0
    assert {r.score for r in quality_rules.score_documents(table(spark), good.limit(0)).collect()} == {0.0}
    # the score by hand
    ratios = quality_rules.log_ratios(table(spark), good)
    grams = Counter()
    target = Counter()
    for i, t, *_ in rows():
        own = quality_rules.ngram_buckets(quality_rules.word_codes(quality_rules.ascii_words(t, False))).tolist()
        grams.update(own)
        target.update(own if i in (1, 3) else [])
    n, m, b = sum(grams.values()), sum(target.values()), quality_rules.BUCKETS
    assert all(abs(ratios[k] - np.log((target[k] + 1) / (m + b) / ((grams[k] + 1) / (n + b)))) < 1e-9 for k in range(0, b, 97))
    assert set(quality_rules.passing(table(spark), good).columns) == set(table(spark).columns)


def test_quality_rules_keep_good_texts(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    found = [r for r in QUERIES["op9_quality_rules"](spark, "/root/testdata/sf0.01").collect() if not r.base_failed and r.doc_id in labels]
    good, bad = ([r.kept for r in found if labels[r.doc_id] == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2


def licensed(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = [(k, label) for label, p in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    places = [k for k, _ in at]
    return (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))


def test_licenses(spark, docs):
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    found = QUERIES["op10_license_scan"](spark, SF).collect()
    assert counted(found, columns) == Counter((i, *licensed(t)) for i, t in docs)
    few = licenses.digest(licenses.scan(table(spark))).collect()
    assert counted(few, columns) == Counter((i, *licensed(t)) for i, t, *_ in rows())
    by = {r.doc_id: r for r in few}
    assert by[18].labels == "mit" and by[18].base_labels == "" and 0.6 <= by[18].score <= 1 and by[1].score == 0
    whole = [(k, f"intro words {t} and more") for k, (_, t, _) in enumerate(licenses.TEMPLATES)] + [(k, "the code of it is by you") for k in range(100, 200)]
    got = {r.doc_id: r.labels.split(",") for r in licenses.digest(licenses.scan(spark.createDataFrame(whole, "doc_id long, text string"))).collect()}
    assert all(licenses.TEMPLATES[k][0] in v for k, v in got.items() if k < 100) and not any(any(v) for k, v in got.items() if k >= 100)
    assert licenses.scan(empty(spark)).count() == 0


def cut_lines(texts):
    """Line chunks by brute force: an equal chunk that stands before, by id, text hash and place, goes."""
    order = sorted({(-(2**63) if i is None else i, tag, t) for i, tag, t in texts if t is not None})
    seen, out = {}, {}
    for i, tag, t in order:
        lines, gone = t.split("\n"), []
        for s, e, body in line_chunks.chunks(t):
            if body in seen:
                gone.append((s, e))
            seen.setdefault(body, (i, tag, s))
        for s, e in reversed(gone):
            del lines[s:e]
        out[(i, tag)] = "\n".join(lines)
    return Counter((i, None if t is None else out[(-(2**63) if i is None else i, tag)]) for i, tag, t in texts)


def test_line_dedup(spark):
    for frame in (table(spark), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        texts = [tuple(r) for r in frame.select("doc_id", F.xxhash64("text"), "text").collect()]
        found = line_chunks.deduplicated(frame, line_chunks.chunks)
        assert counted(found.select("doc_id", "text").collect(), ("doc_id", "text")) == cut_lines(texts)
    assert found.filter("cut_chunks > 0").count() > 0
    few = line_chunks.deduplicated(table(spark))
    assert few.columns == [c for c in table(spark).columns if c != "n_lines"] + ["n_lines", "cut_lines", "cut_chunks"]
    assert {r._id for r in few.collect()} == {"y"}
    assert line_chunks.deduplicated(empty(spark)).count() == 0


def test_line_boundaries_resist_shifts():
    lines = [f"line {i * 7919 % 1000}".encode() for i in range(400)]
    ends = {len(lines) - e for e in line_chunks.boundaries(lines)}
    moved = {len(lines) + 3 - e for e in line_chunks.boundaries([b"new", b"lines", b"here", *lines])}
    assert len(ends & moved) > 0.9 * len(ends)
