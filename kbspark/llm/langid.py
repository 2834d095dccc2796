"""Language identification by the nearest of several centroids per language.

A text is the counts of its letters' byte trigrams, hashed into ``DIM`` bins,
damped, weighted by inverse document frequency and normalised. Each language
has a few spherical k-means centroids; a text gets the language of the centroid
with the highest cosine, and is rejected if even that is too far away: its
cosine is less than a set part of a low quantile of those that the sample's
texts of that language and about that length have to their own centroids.

Document frequencies count all training rows. The clusters are fitted on a
bounded sample, about ``sample`` different texts per language, and one language
is one task. The model has a fixed size per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import batch_of, stored, utf8, worker_state

DIM = 1 << 13
#: Values of lang beyond which fitting is refused, as no worker could hold the model: a language takes 128 KB.
MOST_LANGUAGES = 4096
#: The sample of a language is cut by length into at most LENGTHS classes of at least CLASS_TEXTS texts (one class of all if
#: there are fewer), and LOW of a class's cosines, at least one, may be outliers.
LENGTHS, CLASS_TEXTS, LOW = 8, 50, 0.01
#: Bytes to what a trigram sees: letters in lower case and everything beyond ASCII; the rest is a blank.
LETTER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = regex.compile(rb"[A-Za-z]")
_BLANKS = regex.compile(rb"  +")


def has_letter(text: bytes | None) -> bool:
    return text is not None and (_ASCII_LETTER.search(text) is not None or _LETTER.search(text.decode()) is not None)


def trigram_counts(text: bytes) -> np.ndarray:
    """Counts of the byte trigrams of ``text`` in DIM bins; runs of other bytes than letters are one blank."""
    b = np.frombuffer(_BLANKS.sub(b" ", b" " + text.translate(LETTER_BYTES) + b" "), np.uint8).astype(np.uint32)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(32 - 13), minlength=DIM)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of damped counts times idf, of length 1 (0 for a row of zeros); in the place of ``counts``."""
    x = np.log1p(counts, out=counts)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return x


def counted(texts: list[bytes]) -> np.ndarray:
    """The trigram counts of texts, a row each."""
    out = np.empty((len(texts), DIM), np.float32)
    for row, t in zip(out, texts):
        row[:] = trigram_counts(t)
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row per cluster, of length 1
    owner: np.ndarray  # index into languages of each centroid's language
    longest: np.ndarray  # trigrams of the longest text of each class but the last, a row per language (inf if there are fewer classes)
    least: np.ndarray  # cosine under which a text is too far from all of them, by language and class

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text; ``und`` without a letter."""
        out = [("und", 0.0, True)] * len(texts)
        some = [i for i, t in enumerate(texts) if has_letter(t)]
        if not self.languages or not some:
            return out
        counts = counted([texts[i] for i in some])
        n = counts.sum(axis=1)
        x = vectors(counts, self.idf)
        cosine = x @ self.centroids.T
        best = cosine.argmax(axis=1)
        language = self.owner[best]
        least = self.least[language, (n[:, None] > self.longest[language]).sum(axis=1)]
        for i, k, c, low in zip(some, language.tolist(), cosine[np.arange(len(some)), best].tolist(), least.tolist()):
            out[i] = (self.languages[k], min(max(c, 0.0), 1.0), c < low)
        return out


def limits(n: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest text of each class of lengths but the last, and a low quantile of the cosines of each class."""
    order = np.argsort(n, kind="stable")
    parts = np.array_split(order, min(LENGTHS, max(1, len(n) // CLASS_TEXTS)))
    low = np.zeros(LENGTHS)
    for j, p in enumerate(parts):
        low[j] = np.quantile(cosine[p], LOW, method="higher")
    longest = np.full(LENGTHS - 1, np.inf)
    longest[: len(parts) - 1] = [n[p].max() for p in parts[:-1]]
    return longest, low


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with farthest-first seeds: up to ``k`` rows of length 1."""
    seeds = [x.mean(axis=0)]
    seeds[0] = seeds[0] / max(np.linalg.norm(seeds[0]), 1e-12)
    near = x @ seeds[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[int(near.argmin())])
        near = np.maximum(near, x @ seeds[-1])
    c = np.stack(seeds)
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[of == j].sum(axis=0) if (of == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all ``rows`` (text) each bin occurs, and their number; DIM
    + 1 sums are gathered."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("langid")
        df = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                for text in batch.column(0)[i : i + 512].to_pylist():
                    if has_letter(text):
                        df[:DIM] += trigram_counts(text) > 0
                        df[DIM] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1), pa.int64()), pa.array(df)], names=["bin", "n"])

    sums = np.zeros(DIM + 1, np.int64)
    for r in rows.mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        sums[r.bin] = r.n
    return sums[:DIM], int(sums[DIM])


def fit(training: DataFrame, sample: int = 1000, clusters: int = 4, slack: float = 0.25) -> Model:
    """A model of ``training`` (text as bytes, lang); rows without lang or letters teach nothing.

    More than MOST_LANGUAGES values of lang are an error. Texts are accepted down to ``slack`` times the low quantile of the cosines of
    their language and class of length in the sample.
    """
    rows = training.where(F.col("lang").isNotNull())
    df, n = document_frequencies(rows.select("text"))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # copies are one text: a language is drawn by how many different ones it has
    place = F.xxhash64("text")
    with_letters = rows.where(F.col("text").cast("string").rlike(r"\p{L}"))
    sizes = stored(with_letters.groupBy("lang").agg(F.approx_count_distinct(place, 0.02).alias("n")), "languages")
    if sizes.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different values of lang")
    share = F.least(F.lit(1.0), sample / F.col("n"))
    drawn = with_letters.join(F.broadcast(sizes), "lang").where(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30))
    schema = "lang string, longest array<double>, least array<double>, centroids binary"

    def learn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        worker_state("langid")
        texts = [t for t in map(bytes, pdf["text"]) if has_letter(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "longest": [], "least": [], "centroids": []})
        counts = counted(texts)
        n = counts.sum(axis=1)
        x = vectors(counts, idf)
        c = cluster(x, clusters)
        longest, low = limits(n, (x @ c.T).max(axis=1))
        return pd.DataFrame({"lang": [key[0]], "longest": [longest.tolist()], "least": [(low * slack).tolist()], "centroids": [c.tobytes()]})

    drawn = drawn.select("lang", "text").distinct()
    found = sorted(drawn.groupBy("lang").applyInPandas(learn, schema).collect(), key=lambda r: r.lang)  # a row per language
    each = [np.frombuffer(r.centroids, np.float32).reshape(-1, DIM) for r in found]
    if not found:
        each = [np.zeros((0, DIM), np.float32)]
    owner = np.repeat(np.arange(len(found)), [len(c) for c in each[: len(found)]])
    longest, least = (np.array([r[c] for r in found], np.float64).reshape(len(found), k) for c, k in (("longest", LENGTHS - 1), ("least", LENGTHS)))
    return Model([r.lang for r in found], idf, np.concatenate(each), owner, longest, least)


def _held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_on_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """Learn from the rows whose crc32 of the id as text isn't divisible by 5; a null id counts as an empty text."""
    rows = docs.where(~_held_out(id_col)).select(utf8(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return fit(rows.where(F.col("text").isNotNull()), **options)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score, rejected.

    A null text and one without a letter is ``und`` with score 0 and rejected;
    so is every text if nothing was learned. Equal cosines go to the language
    first in order. Only the text counts; other columns are left out.
    """
    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("langid")
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                ids, held, texts = (c[i : i + 128].to_pylist() for c in batch.columns)
                yield batch_of([(d, h, *p) for d, h, p in zip(ids, held, shared.value.predict(texts))], schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _held_out(id_col).alias("held_out"), utf8(text_col).alias("text")).mapInArrow(judge, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with all their columns, without those that the model rejects."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("langid")
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                texts = [None if t is None else t.encode() for t in part.column(at).to_pylist()]
                yield part.filter(pa.array([not rejected for _, _, rejected in shared.value.predict(texts)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
