"""Operator 9: language identification by nearest of several centroids a language.

A text is a vector of hashed character n-grams (one to three letters, words
padded by a blank), weighted by TF-IDF and normalised.  Document frequencies
are counted over all labelled training documents; each language's centroids
are the means of a spherical k-means over a bounded sample of its documents.
The prediction is the language of the centroid of the largest cosine; a text
farther from it than nearly all of that language's sample is marked rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

DIMS = 1 << 13
CENTROIDS = 4
#: Sampled training documents of each language, and of all languages together.
SAMPLE_EACH, SAMPLE_ALL = 400, 4_000
#: Share of a language's sample that lies within its rejection distance.
WITHIN = 0.995
_ROWS = 256

_LETTER = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x10000)])


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, count) of the n-grams of a whole text; empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # Characters beyond the first plane count as letters if they are not ASCII marks.
    letters = np.where(_LETTER[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF), codes, 32).astype(np.uint32)
    if not (letters != 32).any():
        return np.empty(0, np.int64), np.empty(0, np.float32)
    letters = np.concatenate([[32], letters, [32]]).astype(np.uint32)
    letters = letters[np.r_[True, (letters[1:] != 32) | (letters[:-1] != 32)]]
    one = letters * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(31) + one[1:]
    three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(31) + one[2:]
    hashes = np.concatenate([one[1:-1], two, three])
    hashes = (hashes ^ (hashes >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    counts = np.bincount((hashes >> np.uint32(32 - 13)).astype(np.int64), minlength=DIMS)
    dims = np.flatnonzero(counts)
    return dims, counts[dims].astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Weights, centroids (columns), their languages and the least cosine that each accepts."""

    weights: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def vectors(self, grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return weighted(grams, self.weights)


def weighted(grams: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(grams), DIMS), dtype=np.float32)
    for row, (dims, counts) in enumerate(grams):
        out[row, dims] = np.log1p(counts) * weights[dims]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norms, 1e-12)


def cluster(vectors: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit means of a spherical k-means, seeded by farthest points."""
    k = min(k, len(vectors))
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(vectors)))]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < k:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    means = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ means.T).argmax(axis=1)
        new = np.stack([vectors[own == j].mean(axis=0) if (own == j).any() else means[j] for j in range(k)])
        means = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    return means


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dimension, documents with it) of a task's documents; dimension -1 counts them all."""
    seen = np.zeros(DIMS, dtype=np.int64)
    total = 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            dims, _ = gram_counts(text)
            seen[dims] += 1
            total += bool(len(dims))
    dims = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, dims]), pa.array(np.r_[total, seen[dims]])], names=["dim", "n"])


def _sample_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [gram_counts(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array([d.astype(np.uint16).tobytes() for d, _ in grams], pa.binary()), pa.array([c.astype(np.float32).tobytes() for _, c in grams], pa.binary())],
            names=["lang", "dims", "counts"],
        )


def fit_languages(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_each: int = SAMPLE_EACH, sample_all: int = SAMPLE_ALL, centroids: int = CENTROIDS) -> Model | None:
    """Learn from labelled rows; None if no row has both a language and a letter."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    seen = {r["dim"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    total = seen.pop(-1, 0)
    if not total:
        return None
    weights = np.zeros(DIMS, dtype=np.float32)
    for dim, n in seen.items():
        weights[dim] = np.log((1 + total) / (1 + n)) + 1
    hashed = rows.select("lang", "text", F.xxhash64("lang", "text").alias("draw"))
    # About how many distinct texts each language has: copies of one text must not push a language out.
    counts = Scratch(rows.sparkSession, "language-id").keep(hashed.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")), "counts")
    languages = counts.count()
    each = max(1, min(sample_each, sample_all // max(1, languages)))
    # Drawn by a 64-bit hash of the text: some more than ``each`` distinct texts a language, then the ``each`` of the least hashes.
    drawn = F.col("draw") <= F.least(F.lit(1.0), F.lit(4.0 * each) / F.col("n")) * F.lit(2.0**64) - F.lit(2.0**63)
    sampled = hashed.join(counts.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of")).where(drawn).select("lang", "text", "draw").dropDuplicates(["lang", "draw"])
    least = Window.partitionBy("lang").orderBy("draw")
    picked = sampled.withColumn("place", F.row_number().over(least)).where(F.col("place") <= each).select("lang", "text")
    found = picked.mapInArrow(_sample_grams, "lang string, dims binary, counts binary").collect()
    by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], bytes(r["dims"]), bytes(r["counts"]))):
        if r["dims"]:
            by_lang.setdefault(r["lang"], []).append((np.frombuffer(r["dims"], dtype=np.uint16).astype(np.int64), np.frombuffer(r["counts"], dtype=np.float32)))
    means, names, least = [], [], []
    for lang, grams in by_lang.items():
        vectors = weighted(grams, weights)
        own = cluster(vectors, centroids)
        means.append(own)
        names += [lang] * len(own)
        least += [float(np.quantile((vectors @ own.T).max(axis=1), 1 - WITHIN))] * len(own)
    if not names:
        return None
    return Model(weights, np.concatenate(means).T.astype(np.float32), names, np.array(least))


def _predicted(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            langs, scores, far = [], [], []
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), _ROWS):
                part = texts[at : at + _ROWS]
                able = [model is not None and has_letter(t) for t in part]
                cosines = iter(model.vectors([gram_counts(t) for t, ok in zip(part, able, strict=True) if ok]) @ model.centroids if any(able) else ())
                for ok in able:
                    row = next(cosines) if ok else None
                    best = int(row.argmax()) if ok else 0
                    langs.append(model.languages[best] if ok else "und")
                    scores.append(float(min(1.0, max(0.0, row[best]))) if ok else 0.0)
                    far.append(bool(row[best] < model.least[best]) if ok else True)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    return rows


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: its id's CRC-32 leaves 1 when divided by three."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_language(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict every text's language from labelled rows of the same table.

    Returns one row per input row: ``id_col``, ``held_out`` (not learnt from),
    ``lang_pred`` (a learnt language; ``und`` without letters or where nothing
    could be learnt), ``score`` (cosine to the nearest centroid, 0 to 1) and
    ``rejected`` (farther than that language's texts usually are).

    Null and empty texts are ``und`` with score 0; rows without language or id
    are predicted but not learnt from; rows may repeat; other columns are
    ignored; an empty table gives an empty result.
    """
    if model is None:
        model = fit_languages(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean"
    return rows.mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(model)), schema).withColumnRenamed("id", id_col)
