"""A quality classifier without hand-made labels.

Several heuristic labellers look at each text and call it good or bad or say
nothing. They overlap: each kind of defect is seen by two or more. Expectation
maximisation over the counts of their vote patterns, a bounded table for all
documents, estimates how likely each labeller votes how on good and on bad
texts, and from that the posterior of each pattern. A linear scorer over hashed
words and text shapes is then trained on a bounded sample towards the posteriors,
and scores every document.

Abuse is seen where there are labels of toxic documents: by one labeller per
language, whose words are those that the labelled documents of the language
have far more often in toxic ones, and one that asks for two of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import batch_of, stored, utf8, worker_state

# The symbols that prose has few of.
_NO_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>~^"))
_NO_CAPITALS, _NO_SMALL = bytes(set(range(256)) - set(range(65, 91))), bytes(set(range(256)) - set(range(97, 123)))
_WORD = re.compile(rb"[a-z\x80-\xff]+")

#: Bins of the scorer's weights, about how many rows of either kind it is trained on, and the most bins of one of them
#: (of a text with more different words, those with the smallest hashes).
DIM, SAMPLE, ROW_BINS = 1 << 16, 10_000, 1000
_CACHE_WORDS = 300_000
#: A word of abuse is in at least so many toxic documents of its language, and so many times as frequent there as in clean ones.
SUPPORT, RATIO = 3, 30
#: Learned words are broadcast; more than so many are an error.
MOST_WORDS = 500_000
#: Bits of the filter that keeps most texts without a label out of the shuffle.
FILTER_BITS = 1 << 26


@dataclass
class Shape:
    words: int
    symbols: float  # per byte
    marked: float  # words with a symbol, per word
    distinct: float  # different words per word
    run: int  # the longest run of one word
    capitals: float  # of ASCII letters
    shouts: float  # exclamation marks per word
    bars: float  # | per word
    ends: float  # words that end a sentence, per word
    learned: int = 0  # different words of the language's learned lexicon


def shape_of(text: bytes, lexicon: frozenset[bytes] = frozenset()) -> tuple[Shape, set[bytes]]:
    """The figures of a text that labellers see, and its different words."""
    words = text.split()
    n = max(1, len(words))
    low = text.lower()
    plain = set(_WORD.findall(low))
    symbols = len(text.translate(None, _NO_SYMBOLS))
    big, small = len(text.translate(None, _NO_CAPITALS)), len(text.translate(None, _NO_SMALL))
    run = longest = 1
    if any(map(eq, words, words[1:])):
        for a, b in zip(words, words[1:]):
            run = run + 1 if a == b else 1
            longest = max(longest, run)
    marked = sum(1 for w in words if w.translate(None, _NO_SYMBOLS)) if symbols else 0
    ends = text.count(b". ") + text.count(b".\n") + text.count(b"? ") + text.count(b"! ") + text.rstrip().endswith((b".", b"?", b"!"))
    return Shape(len(words), symbols / max(1, len(text)), marked / n, len(set(words)) / n, longest, big / max(1, big + small), text.count(b"!") / n, text.count(b"|") / n, ends / n, len(plain & lexicon)), plain


def votes(s: Shape) -> tuple[int, ...]:
    """The labellers' votes, 0 bad, 1 none, 2 good."""
    clean = s.marked < 0.02 and s.bars == 0 and s.capitals < 0.3 and s.shouts < 0.1 and not s.learned
    varied = s.words < 10 or (s.distinct > 0.25 and s.run < 5)
    bad = lambda x: 0 if x else 1
    return (
        bad(s.symbols > 0.02), bad(s.marked > 0.15),
        bad(s.words >= 10 and s.distinct < 0.2), bad(s.run >= 5),
        bad(s.capitals > 0.5), bad(s.shouts > 0.3),
        bad(s.bars > 0.1), bad(s.words >= 20 and s.ends < 0.005),
        bad(s.learned > 1),
        2 if clean and varied and (s.words < 10 or 0.01 < s.ends < 0.6) else 1, 2 if clean and varied and s.words >= 20 else 1,
    )


LABELLERS = 11
PATTERNS = 3**LABELLERS


def pattern_of(v: tuple[int, ...]) -> int:
    out = 0
    for x in v:
        out = 3 * out + x
    return out


def toxic_words(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, frozenset[bytes]]:
    """The words of each language (null counts as an empty text) that tell toxic documents, from all that ``labels`` (doc_id, toxic) tells of.

    A word is in at least SUPPORT toxic documents, RATIO times as frequent in
    toxic ones as in clean ones, and too frequent there for chance: by Chernoff's
    bound less than one word of the language would be. Equal texts of a language
    count once, as toxic if one of them is.
    """
    known = labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    cell, bit = F.shiftright(place, 6).alias("cell"), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(doc_id), {FILTER_BITS}) % 64 AS INT))")
    marks = known.where("doc_id is not null").groupBy(cell).agg(F.bit_or(bit).alias("marks"))
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce(utf8(text_col), F.lit(b"")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("lang", "text")).withColumn("cell", cell)
    rows = rows.join(F.broadcast(marks), "cell").where(F.col("marks").bitwiseAND(bit) != 0).drop("cell", "marks")
    # labels go to texts by their hashes, so that equal texts meet where the labels reach them and texts are exchanged once
    known = rows.select("doc_id", "h").join(known.hint("merge"), "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"))
    rows = rows.drop("doc_id").join(known.hint("merge"), "h").groupBy("h", "lang", "text").agg(F.max("toxic").alias("toxic")).select("lang", "text", "toxic")
    schema = "lang string, word binary, toxic long, clean long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, bytes], list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = batch_of([(*k, *n) for k, n in found.items()], schema)
            found.clear()
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                for language, text, toxic in zip(*(c[i : i + 512].to_pylist() for c in batch.columns)):
                    for w in {b"", *_WORD.findall(text.lower())}:  # the empty word counts documents
                        found.setdefault((language, w), [0, 0])[0 if toxic else 1] += 1
                if len(found) > _CACHE_WORDS:
                    yield flush()
        yield flush()

    words = rows.mapInArrow(count, schema).groupBy("lang", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    words = stored(words.where((F.col("toxic") + F.col("clean") >= SUPPORT) | (F.col("word") == b"")), "words")
    totals = words.groupBy("lang").agg(F.max(F.when(F.col("word") == b"", F.col("toxic"))).alias("n_toxic"), F.max(F.when(F.col("word") == b"", F.col("clean"))).alias("n_clean"), F.count("*").alias("n_words"))
    share, n = F.col("n_toxic") / (F.col("n_toxic") + F.col("n_clean")), F.col("toxic") + F.col("clean")
    q = F.col("toxic") / n
    evidence = n * (q * F.ln(q / share) + F.when(q < 1, (1 - q) * F.ln((1 - q) / (1 - share))).otherwise(0.0))
    far = (F.col("toxic") >= SUPPORT) & (q > share) & (F.col("toxic") * F.col("n_clean") >= RATIO * F.col("clean") * F.col("n_toxic"))
    picked = words.where(F.col("word") != b"").join(F.broadcast(totals), "lang").where(far & (evidence > F.ln("n_words"))).select("lang", "word")
    rows_ = picked.limit(MOST_WORDS + 1).collect()
    if len(rows_) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words tell toxic documents")
    out: dict[str, set[bytes]] = {}
    for r in rows_:
        out.setdefault(r.lang, set()).add(bytes(r.word))
    return {language: frozenset(out[language]) for language in sorted(out)}


def posteriors(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """The probability that a text with this pattern of votes is bad, by EM for
    labellers that are independent given the class; starts from "any bad vote".
    A pattern of k * PATTERNS more has a bad vote of the k-th language's labeller."""
    if not counts:
        return {}
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], np.float64)
    languages = range(1, max(codes) // PATTERNS + 1)
    v = np.array([[*(c // 3**k % 3 for k in reversed(range(LABELLERS))), *(0 if c // PATTERNS == k else 1 for k in languages)] for c in codes])
    bad = np.where((v == 0).any(axis=1), 0.95, 0.05)
    for _ in range(rounds):
        logs = []
        for p in (1 - bad, bad):
            w = n * p
            logs.append(np.log((w.sum() + 1) / (n.sum() + 2)) + sum(np.log((np.array([w[v[:, j] == x].sum() for x in range(3)]) + 0.5) / (w.sum() + 1.5))[v[:, j]] for j in range(v.shape[1])))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - bad).max() < 1e-6:
            break
        bad = new
    return dict(zip(codes, bad.tolist()))


class Features:
    """Bins of a text's words and shapes; a worker remembers those of words it has met."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def of(self, s: Shape, words: set[bytes]) -> np.ndarray:
        cache = self.cache
        if len(cache) > _CACHE_WORDS:
            cache.clear()
        for w in words.difference(cache):
            cache[w] = xxhash.xxh32_intdigest(w) % (DIM - 256) + 256
        level = lambda x, *limits: sum(x > t for t in limits)
        shape = (
            level(s.symbols, 0.002, 0.01, 0.03, 0.1), 8 + level(s.marked, 0.01, 0.05, 0.15, 0.5), 16 + level(s.distinct, 0.1, 0.2, 0.3, 0.5, 0.7) + 8 * (s.words >= 10), 32 + level(s.run, 2, 4, 8),
            40 + level(s.capitals, 0.1, 0.3, 0.5, 0.8), 48 + level(s.shouts, 0.05, 0.3), 56 + level(s.bars, 0, 0.1, 0.5), 64 + level(s.ends, 0.005, 0.02, 0.1, 0.3, 0.6), 72 + level(s.learned, 0, 1, 3),
            80 + level(s.words, 4, 9, 19, 49, 199), 88,
        )
        return np.array([*shape, *map(cache.__getitem__, words)], np.int32)


def train(rows: list[tuple[np.ndarray, float]], epochs: int = 40, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic model towards soft labels; a row's words share one unit of input, its shapes have one each."""
    if not rows:
        return np.zeros(DIM)
    at = np.concatenate([f for f, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    y = np.array([p for _, p in rows])
    x = _inputs(at, row, len(rows))
    w, seen = np.zeros(DIM), np.full(DIM, 1e-6)
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at] * x, len(rows)), -30, 30)))
        g = np.bincount(at, (p - y)[row] * x, DIM) / len(rows) + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def _inputs(at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    words = np.bincount(row, at >= 256, n)
    return np.where(at >= 256, 4 / np.sqrt(np.maximum(words, 16))[row], 1.0)


def _pass(docs: DataFrame, make, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = worker_state("weak_quality", Features)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                yield batch_of(make(features, *(c[i : i + 512].to_pylist() for c in batch.columns)), schema)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", labels: DataFrame | None = None, lang_col: str = "lang") -> DataFrame:
    """doc_id, p_bad (what the labellers' votes say), score (the scorer's probability
    of a good text), kept (score of at least ``threshold``) of every document.

    A null text counts as empty; empty texts are bad for no labeller and get what
    the scorer says of no words. Repeated rows and null ids are judged as any
    other; an empty table gives no rows; other columns are left out. With
    ``labels`` (doc_id, toxic), words of abuse are learned for each language.
    """
    context = docs.sparkSession.sparkContext
    found = {} if labels is None else toxic_words(docs, labels, id_col, text_col, lang_col)
    lexicons = context.broadcast({language: (k * PATTERNS, words) for k, (language, words) in enumerate(found.items(), 1)})
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if found else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(utf8(text_col), F.lit(b"")).alias("text"), lang.alias("lang"))

    def judged(text: bytes, language: str) -> tuple[Shape, set[bytes], int]:
        place, lexicon = lexicons.value.get(language, (0, frozenset()))
        s, words = shape_of(text, lexicon)
        return s, words, pattern_of(votes(s)) + (place if s.learned else 0)

    patterns = _pass(rows, lambda _, ids, texts, langs: [(judged(*x)[2], xxhash.xxh3_64_intdigest(x[0]) - (1 << 63)) for x in zip(texts, langs)], "pattern long, text long")
    # PATTERNS rows at most for texts without a language's word, and as many again for each language that has words
    figures = patterns.groupBy("pattern").agg(F.count("*").alias("n"), F.approx_count_distinct("text").alias("texts")).collect()
    counts = {r.pattern: r.n for r in figures}
    bad = context.broadcast(posteriors(counts))
    # copies are drawn together, so the rates are of different texts: what is copied most is not drawn less for it
    texts = {kind: sum(r.texts for r in figures if (bad.value[r.pattern] > 0.5) == kind) for kind in (True, False)}
    share = {kind: min(1.0, sample / max(1, n)) for kind, n in texts.items()}

    def sampled(features: Features, ids, texts, langs) -> list[tuple]:
        out = []
        for text, language in zip(texts, langs):
            draw = xxhash.xxh3_64_intdigest(text) / (1 << 64)
            if draw < max(share.values()):
                s, words, pattern = judged(text, language)
                p = bad.value[pattern]
                if draw < share[p > 0.5]:
                    f = features.of(s, words)
                    n_shape = int((f < 256).sum())
                    out.append((np.concatenate((f[:n_shape], np.sort(f[n_shape:])[:ROW_BINS])).astype(np.int32).tobytes(), p))
        return out

    # about ``sample`` rows of either kind, of at most 4 * ROW_BINS bytes each; copies are one
    chosen = _pass(rows, sampled, "features binary, p double").dropDuplicates(["features"]).limit(3 * sample).collect()
    weights = context.broadcast(train([(np.frombuffer(f, np.int32), p) for f, p in sorted((bytes(r.features), r.p) for r in chosen)]))

    def score(features: Features, ids, texts, langs) -> list[tuple]:
        shapes = [judged(*x) for x in zip(texts, langs)]
        each = [features.of(s, words) for s, words, _ in shapes]
        at, row = np.concatenate(each), np.repeat(np.arange(len(each)), [len(f) for f in each])
        z = np.bincount(row, weights.value[at] * _inputs(at, row, len(each)), len(each))
        good = 1 / (1 + np.exp(np.clip(z, -30, 30)))
        return [(d, bad.value.get(pattern, 0.5), g, g >= threshold) for d, (_, _, pattern), g in zip(ids, shapes, good.tolist())]

    return _pass(rows, score, "doc_id long, p_bad double, score double, kept boolean")
