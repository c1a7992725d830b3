"""Operator 5: benchmark decontamination by a prefix-filtered set join.

Each benchmark item gives windows of ``window`` words (a shorter item is one
window).  A window is the set of its short word shingles; a document holds the
window only if it holds all of them, so of the window's shingles, ordered by
rarity (document frequency over the whole corpus, counted first), only the
rarest one is needed as prefix token.  Where a document has that shingle, its
place fixes where the window would have to start (positional bound) and end
(length bound); what is left is compared word by word.

The item index is broadcast in blocks of at most ``BLOCK_BYTES`` of item text:
a larger benchmark takes further passes, not more memory.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch
from .textkeys import hashed_texts, windows

#: Words in a prefix shingle; windows of fewer words are one shingle.
SHINGLE = 3
#: Item text that one broadcast index is built from; a window of it takes some 600 bytes, so an index about 100 MB.
BLOCK_BYTES = 1 << 20
_SIEVE = 1 << 20

#: Bytes to bytes: A-Z folded, what no word may hold to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def fold_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z folded."""
    return text.translate(_FOLD).split() if text else []


def item_windows(items: list[tuple[str | None, bytes | None]], window: int) -> dict[tuple[bytes, ...], set[str | None]]:
    """Each distinct window with the ids of the items that have it."""
    out: dict[tuple[bytes, ...], set[str | None]] = defaultdict(set)
    for item, text in items:
        words = fold_words(text)
        for start in range(max(1, len(words) - window + 1)) if words else ():
            out[tuple(words[start : start + window])].add(item)
    return out


class _Sieve:
    """Membership of 64-bit hashes in a sorted array, most strangers thrown out by one look."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.bits = np.zeros(_SIEVE, dtype=bool)
        self.bits[self._low(values)] = True

    @staticmethod
    def _low(values: np.ndarray) -> np.ndarray:
        return (values & np.uint64(_SIEVE - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in hashes, places in values) of the members."""
        at = np.flatnonzero(self.bits[self._low(hashes)])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        where = np.searchsorted(self.values, hashes[at])
        where[where == len(self.values)] = 0
        same = self.values[where] == hashes[at]
        return at[same], where[same]


class ItemIndex:
    """Windows of a block of items with the shingles that may stand for them."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int) -> None:
        found = item_windows(items, window)
        self.windows = list(found)
        self.items = [sorted(x for x in ids if x is not None) for ids in found.values()]
        self.shingles = [windows(h, min(SHINGLE, len(h))) for h in hashed_texts([b" ".join(w) for w in self.windows])]
        self.sieves: dict[int, _Sieve] = {}
        for size in {min(SHINGLE, len(w)) for w in self.windows}:
            of = [s for s, w in zip(self.shingles, self.windows, strict=True) if min(SHINGLE, len(w)) == size]
            self.sieves[size] = _Sieve(np.unique(np.concatenate(of)))
        self.prefix: dict[int, tuple[_Sieve, list[list[tuple[int, int]]]]] = {}

    def order(self, frequency: dict[tuple[int, int], int]) -> None:
        """Choose each window's rarest shingle by (size, shingle) counts; ties by hash."""
        chosen: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for number, shingles in enumerate(self.shingles):
            size = min(SHINGLE, len(self.windows[number]))
            _, token, offset = min((frequency.get((size, t), 0), t, i) for i, t in enumerate(shingles.tolist()))
            if frequency.get((size, token), 0):
                chosen[size][token].append((number, offset))
        for size, tokens in chosen.items():
            values = np.array(sorted(tokens), dtype=np.uint64)
            self.prefix[size] = _Sieve(values), [tokens[t] for t in values.tolist()]

    def matches(self, text: bytes, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window number, first word) of every occurrence; ``text`` is folded and split only if need be."""
        words: list[bytes] = []
        for size, (sieve, postings) in self.prefix.items():
            for place, token in zip(*(x.tolist() for x in sieve.find(windows(hashes, size))), strict=True):
                words = words or text.split()
                for number, offset in postings[token]:
                    wanted, start = self.windows[number], place - offset
                    if start >= 0 and start + len(wanted) <= len(words) and tuple(words[start : start + len(wanted)]) == wanted:
                        yield number, start


def _frequencies(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        counts = {size: np.zeros(len(s.values), dtype=np.int64) for size, s in index.sieves.items()}
        for batch in batches:
            for hashes in hashed_texts([t.translate(_FOLD) if t else None for t in batch.column("text").to_pylist()]):
                for size, sieve in index.sieves.items():
                    counts[size][np.unique(sieve.find(windows(hashes, size))[1])] += 1
        for size, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, dtype=np.int64)), pa.array(index.sieves[size].values[at].view(np.int64)), pa.array(n[at])], names=["size", "token", "n"])

    return rows


def _hits(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        for batch in batches:
            n_words, spans, items = [], [], []
            texts = [t.translate(_FOLD) if t else b"" for t in batch.column("text").to_pylist()]
            for text, hashes in zip(texts, hashed_texts(texts), strict=True):
                hit, found = np.zeros(len(hashes), dtype=bool), set()
                for number, start in index.matches(text, hashes):
                    hit[start : start + len(index.windows[number])] = True
                    found.update(index.items[number])
                edges = np.flatnonzero(np.diff(np.r_[False, hit, False])).tolist()
                n_words.append(len(hashes))
                spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                items.append(sorted(found))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "n_words", "spans", "items"])

    return rows


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """Where benchmark windows occur in documents.

    Returns one row per input row: ``id_col``, ``n_words``, ``n_hit`` (words in
    an occurrence), ``spans`` (runs of such words, end exclusive), ``items``
    (ids of the items with occurring windows, as sorted strings) and
    ``contaminated`` (n_hit > 0).

    Null or word-less texts and items have no words and match nothing; repeated
    item ids are one item; an item without id is matched but not listed.  Ids
    of documents may be null or repeated; other columns are ignored; without
    documents or without items the result has no rows or no hits.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").cast("binary").alias("text"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    out = None
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).select("item", "text").collect()
        index = ItemIndex([(r["item"], None if r["text"] is None else bytes(r["text"])) for r in rows], window)
        counted = texts.select("text").mapInArrow(_frequencies(spark.sparkContext.broadcast(index)), "size long, token long, n long")
        counted = counted.groupBy("size", "token").agg(F.sum("n").alias("n")).collect()
        index.order({(r["size"], r["token"] % (1 << 64)): r["n"] for r in counted})
        found = _hits(spark.sparkContext.broadcast(index))
        columns = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
        if blocks == 1:
            out = texts.mapInArrow(found, f"id {id_type}, {columns}")
            break
        keyed = texts.select("id", F.xxhash64("id", "text").alias("key"), "text")
        part = keyed.mapInArrow(found, f"id {id_type}, key long, {columns}").where("size(items) > 0 or size(spans) > 0")
        out = part if out is None else out.union(part)
    if blocks > 1:
        out = _merged(texts, out, Scratch(spark, "decontaminate"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"))


def _merged(texts: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """Hits of several blocks of items as one row per document."""
    parts = scratch.keep(parts, "parts")
    held = parts.groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    # Overlapping or touching runs, sorted by start, become one.
    join = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    held = held.select("key", join.alias("spans"), "items")
    keyed = texts.select("id", F.xxhash64("id", "text").alias("key"), "text")
    counted = keyed.mapInArrow(_word_counts, f"id {texts.schema['id'].dataType.simpleString()}, key long, n_words long")
    joined = counted.join(held, "key", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans")
    return joined.select("id", "n_words", spans, F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(fold_words(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(n, pa.int64())], names=["id", "key", "n_words"])


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT item_id, list_slice(ws, i, i + 9) AS ws FROM bi),
x AS (SELECT DISTINCT item_id, array_to_string(ws, ' ') AS k, len(ws) AS n FROM win),
di AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
c AS (SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS k
  FROM di JOIN (SELECT DISTINCT n FROM x) ON i + n - 1 <= len(ws)),
h AS (SELECT c.doc_id, c.i, c.n, x.item_id FROM c JOIN x ON c.k = x.k AND c.n = x.n),
covered AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
