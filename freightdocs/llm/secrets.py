"""Secret scan: fixed patterns, and a battery of randomness tests on long tokens. Column expressions only.

Candidates of the battery are runs of 20 or more encoding characters in what the pattern hits leave, and of runs with
separators also the parts of 20 or more characters between ``/`` and ``+``, between ``_`` and ``-``, and between any of them. From its characters a token
gets the smallest alphabet that an encoder would use (hex, base32, base36, base62, base64 or its URL form); tokens that lack
a digit or a letter, or mixed case where the alphabet has both, have none and are ordinary text. The null hypothesis is that
a token's symbols are uniform and independent; three tests of it are made:

* chi-squared of the symbol counts against a uniform alphabet, two-sided (cube-root normal approximation);
* the number of runs above and below the middle of the alphabet, two-sided;
* the lag-1 serial correlation, two-sided;

and combined by Fisher's method. The tokens shown to be not random are found by the Benjamini-Hochberg rule over all
tokens of the input, weighted by length, since longer tokens carry more evidence: p / weight is held against one cut, so
that of the tokens cleared as ordinary at most the share ``RATE`` is expected to be random. Tokens not cleared are spans.
The cut is found on a histogram of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds in their order, patterns and least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
FIELDS = ("start", "end", "rank", "kind", "word")
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
PARTS = tuple(f"(?<![{c}])[{c}]{{20,}}" for c in ("A-Za-z0-9", "A-Za-z0-9_-", "A-Za-z0-9+/"))
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the smallest alphabet up: what a token's body must match, and the alphabet in the order of its values.
ENCODINGS = (
    (r"^(?=.*[a-f])(?=.*[0-9])[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^(?=.*[A-F])(?=.*[0-9])[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^(?=.*[A-Z])(?=.*[2-7])[A-Z2-7]+$", UPPER + "234567"),
    (r"^(?=.*[a-z])(?=.*[0-9])[a-z0-9]+$", DIGITS + LOWER),
    (r"^(?=.*[A-Z])(?=.*[0-9])[A-Z0-9]+$", DIGITS + UPPER),
    (r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    (r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    (r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
RATE = 0.01
#: Length at which a token has weight 1.
PLAIN_LENGTH = 32.0
#: Bins of the p histogram: 64 for each power of ten, down to 1e-40.
BINS, DEEPEST = 64, 40


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hits(text: Column, pattern: str, kind: str, body: int = 0, least: int = 1) -> Column:
    """``array<struct<start, end, rank, kind, word>>`` of leftmost matches whose group ``body`` has ``least`` characters.

    What lies between matches and the matches themselves give the places; lengths are in code points. Texts without a match
    stop at the first search.
    """
    rank = KINDS.index(kind)
    one = "struct<start:int,end:int,rank:int,kind:string,word:string>"
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = found if body == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(body))
    parts = F.arrays_zip(between.alias("gap"), found.alias("word"), groups.alias("body"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{one}>").alias("out"))

    def add(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["gap"])
        end = begin + F.coalesce(F.length(p["word"]), F.lit(0))
        hit = F.struct(begin.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), p["word"].alias("word"))
        good = p["word"].isNotNull() & (F.length(p["body"]) >= least)
        return F.struct(end.alias("at"), F.when(good, F.concat(state["out"], F.array(hit))).otherwise(state["out"]).alias("out"))

    spans = F.aggregate(parts, start, add, lambda s: s["out"])
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), spans).otherwise(F.array().cast(f"array<{one}>"))


def base_spans(text: Column) -> Column:
    """Hits of the three patterns by start, then kind in the order of ``KINDS``."""
    return F.array_sort(F.concat(hits(text, ASSIGN, "assign", 2, 8), hits(text, ACCESS, "access"), hits(text, HEX, "hex")))


def total(of: Column) -> Column:
    return F.aggregate(of, F.lit(0.0), lambda s, x: s + x)


def two_sided(z: Column) -> Column:
    """Normal tail of both sides (logistic approximation), at least 1e-40."""
    return F.greatest(F.lit(2.0) / (1.0 + F.exp(1.5976 * F.abs(z) + 0.070566 * F.pow(F.abs(z), F.lit(3.0)))), F.lit(1e-40))


def _battery(values: Column, m: Column) -> Column:
    """Fisher's combination of the three tests for symbol values below ``m``. Each part is computed once."""
    n = F.size(values).cast("double")

    counts = F.transform(F.array_distinct(values), lambda v: F.pow(F.size(F.filter(values, lambda x: x == v)).cast("double"), 2))

    def uneven(chi: Column) -> Column:
        return (F.pow(F.greatest(chi, F.lit(1e-9)) / (m - 1), F.lit(1.0 / 3)) - 1 + 2 / (9 * (m - 1))) / F.sqrt(2 / (9 * (m - 1)))

    pairs = F.sequence(F.lit(0), F.size(values) - 2)

    def broken(mean: Column, runs: Column) -> Column:
        var = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.0))
        return F.when(mean > 2, (runs - mean) / F.sqrt(var)).otherwise(F.sqrt(n))

    def run_test(high: Column) -> Column:
        runs = 1 + total(F.transform(pairs, lambda i: (high[i] != high[i + 1]).cast("double")))
        return let(total(high), lambda n1: let(2 * n1 * (n - n1) / n + 1, lambda mean: broken(mean, runs)))

    def serial_test(dev: Column) -> Column:
        serial = total(F.transform(pairs, lambda i: dev[i] * dev[i + 1]))
        return let(total(F.transform(dev, lambda d: d * d)),
                   lambda spread: F.when(spread > 0, (serial / spread + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n)))

    def centred(middle: Column) -> Column:
        return let(F.transform(values, lambda v: v - middle), serial_test)

    tests = F.array(let(total(counts) * m / n - n, uneven), let(F.transform(values, lambda v: (v >= m / 2).cast("double")), run_test),
                    let(total(F.transform(values, lambda v: v.cast("double"))) / n, centred))
    half = total(F.transform(tests, lambda z: -F.log(two_sided(z))))
    return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))


def randomness(word: Column) -> Column:
    """The p-value of "random" for a token; null if no encoding fits."""
    def of(body: Column) -> Column:
        alphabet = F.lit(None).cast("string")
        for pattern, symbols in reversed(ENCODINGS):
            alphabet = F.when(body.rlike(pattern), F.lit(symbols)).otherwise(alphabet)
        return let(alphabet, lambda a: F.when(a.isNotNull(), tested(body, a)))

    def tested(body: Column, alphabet: Column) -> Column:
        values = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1)
        return let(values, lambda v: _battery(v, F.length(alphabet).cast("double")))

    return let(F.regexp_replace(word, "=+$", ""), of)


def weighted(p: Column, word: Column) -> Column:
    """p over the token's weight, its length relative to ``PLAIN_LENGTH``."""
    return F.least(F.lit(1.0), p * PLAIN_LENGTH / F.length(word))


def blanked(text: Column, spans: Column) -> Column:
    """The text with as many spaces in place of each span."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        begin, end = F.greatest(state["at"], s["start"]), F.greatest(state["at"], s["end"])
        return F.struct(end.alias("at"), F.concat(
            state["out"], F.substring(text, state["at"] + 1, begin - state["at"]), F.repeat(F.lit(" "), end - begin)).alias("out"))

    covered = F.aggregate(spans, start, add, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    return F.when(F.size(spans) > 0, covered).otherwise(text)


def candidates(text: Column) -> Column:
    """Long tokens, and long parts of those with separators."""
    def with_parts(tokens: Column) -> Column:
        split = F.filter(tokens, lambda t: t["word"].rlike("[+/_-]"))
        parts = F.concat(*[hits(text, p, "random") for p in PARTS])
        inside = F.filter(parts, lambda p: F.exists(split, lambda t: (t["start"] <= p["start"]) & (p["end"] <= t["end"])))
        return F.when(F.size(split) > 0, F.array_union(tokens, inside)).otherwise(tokens)
    return let(hits(text, TOKEN, "random"), with_parts)


def scored_tokens(text: Column, base: Column) -> Column:
    """Long tokens and parts outside pattern hits, with their p-value."""
    free = let(blanked(text, base), candidates)
    scored = F.transform(free, lambda t: F.struct(*[t[c].alias(c) for c in FIELDS], randomness(t["word"]).alias("p")))
    return F.filter(scored, lambda t: t["p"].isNotNull())


def clearing_cut(docs: DataFrame, rate: float = RATE) -> float:
    """The weighted p up to which tokens of ``docs`` are cleared as ordinary text; one number, from at most 2,561 rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = docs.select(F.explode(let(base_spans(text), lambda base: scored_tokens(text, base))).alias("t"))
    p = F.greatest(weighted(F.col("t.p"), F.col("t.word")), F.lit(10.0**-DEEPEST))
    bins = tokens.select(F.floor(-F.log10(p) * BINS).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    smaller = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = bins.select("bin", F.sum("n").over(smaller).alias("found"), F.sum("n").over(total).alias("all"))
    passing = steps.filter(F.pow(F.lit(10.0), -F.col("bin") / BINS) * F.col("all") <= rate * F.col("found"))
    low = passing.agg(F.min("bin")).first()[0]
    return 0.0 if low is None else 10.0 ** (-low / BINS)


def found_in(text: Column, cut: float) -> Column:
    """``struct<base, spans>``: pattern hits, and these with the tokens not cleared; by start, then kind."""
    def both(base: Column) -> Column:
        extra = F.filter(scored_tokens(text, base), lambda t: weighted(t["p"], t["word"]) > cut)
        extra = F.transform(extra, lambda t: F.struct(*[t[c].alias(c) for c in FIELDS]))
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, extra)).alias("spans"))
    return let(base_spans(text), both)


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """All columns of ``docs`` and ``base``, ``spans``: arrays of ``struct<start, end, rank, kind, word>``.

    Null and empty texts have none. Repeated rows count as often as they stand there when the cut is found. Columns of
    ``docs`` named ``base`` or ``spans`` give way. An empty table gives an empty table.
    """
    cut = clearing_cut(docs, rate)
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("base", "spans")]
    found = docs.select(*keep, found_in(F.coalesce(F.col("text"), F.lit("")), cut).alias("__found"))
    return found.select(*keep, "__found.base", "__found.spans")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """All columns of ``docs`` with every span of ``text`` replaced by ``[kind]``; overlapping spans go as one. Null stays null."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def cover(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def add(state: Column, s: Column) -> Column:
            piece = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), s["kind"], F.lit("]"))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                            F.when(s["start"] >= state["at"], F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"))

        covered = F.aggregate(spans, start, add, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, s["at"] + 1)))
        return F.when(F.size(spans) > 0, covered).otherwise(F.col("text"))

    return docs.withColumn("text", let(found_in(text, clearing_cut(docs, rate))["spans"], cover))
