"""Two tokenizers against a plain alignment token by token."""

import hashlib
from collections import Counter
from functools import lru_cache

from fixtures import empty, rows, table

from freightdocs.llm import alignment
from freightdocs.llm.common import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@lru_cache
def models():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def tokens(text):
    """``[(id, bytes)]`` of both models for one text."""
    a, b = models()
    code = alignment.byte_of_character()
    left = a.encode(" " + text, add_special_tokens=False)
    right = b.encode(text)
    pieces = [b.id_to_piece(i) for i in right]
    return ([(i, bytes(code[c] for c in t)) for i, t in zip(left.ids, left.tokens, strict=True)],
            [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in zip(right, pieces, strict=True)])


def by_hand(texts):
    found = []
    for i, text in texts:
        a, b = tokens(text) if text else ([], [])
        data = b"" if not text else (" " + text).encode()
        if b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
            a, b = [], []
        ends, at = {}, 0
        for k, (x, t) in enumerate(b):
            at += len(t)
            ends[at] = k
        links, groups, at, p, q = [], [], 0, 0, 0
        for k, (x, t) in enumerate(a):
            at += len(t)
            if at in ends:
                links.append((x, b[ends[at]][0]))
                groups.append(",".join(str(y) for y, _ in a[p:k + 1]) + "|" + ",".join(str(y) for y, _ in b[q:ends[at] + 1]))
                p, q = k + 1, ends[at] + 1
        found.append((i, a, b, groups, links))
    counts = Counter(x for *_, links in found for x in links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return sorted((str(i), len(a), len(b), len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, links in found), counts


def digest(found):
    return sorted((str(x.doc_id), x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256) for x in found.collect())


def test_awkward_texts(spark):
    own = [(i, t, *rest) for i, t, *rest in rows() if i not in (12,)]
    own += [(300, "<|endoftext|> is <s>text</s> and <unk> <0x41> ▁x", *own[0][2:]), (301, "two  blanks\t\ttabs \n\n lines\r\n ", *own[0][2:]),
            (302, " led by a blank", *own[0][2:]), (303, "　 \x00 é ﬁ ½ 👩‍👩‍👧", *own[0][2:]), (304, "the the the", *own[0][2:])]
    frame = table(spark, own)
    want, counts = by_hand([(i, t) for i, t, *_ in own])
    assert digest(alignment.aligned(frame, A, B)) == want
    found = {(r.a_id, r.b_id): r.n for r in alignment.pair_table(frame, A, B).collect()}
    assert found == dict(counts)
    assert alignment.aligned(empty(spark), A, B).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, _ = by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert digest(alignment.aligned(docs, A, B)) == want


def test_linked_pairs_are_bounded_by_the_vocabularies():
    voc = alignment.vocabulary(A, B)
    assert len(voc.pairs) < sum(map(len, voc.a_bytes)) * 2 + sum(map(len, voc.b_bytes))
    text = "naïve über 123 你好"
    (a, b), = voc.encode([text])
    n, linked, _ = voc.align(a, b)
    assert n == len(linked) and (voc.pairs[linked] >> 32 == a[[i for i in range(len(a)) if voc.a_length[a].cumsum()[i] in voc.b_length[b].cumsum()]]).all()


def test_both_encoders_of_the_first_model_agree_on_every_character():
    voc, (a, _) = alignment.vocabulary(A, B), models()
    assert voc.ranks is not None
    characters = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    for k in range(0, len(characters), 5000):
        text = " " + "".join(f"a{c}1{c}{c} .{c}x  {c}\n{c}" for c in characters[k:k + 5000])
        assert voc.ranks.encode_ordinary(text) == a.encode(text, add_special_tokens=False).ids
    for text in ("x" * 300_000, " " * 3_000_000 + "x", "\n \t" * 500_000 + "!", "don't we'LL" * 1000):
        assert voc.encode_a(text) == a.encode(text, add_special_tokens=False).ids
