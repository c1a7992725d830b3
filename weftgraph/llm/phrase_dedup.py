"""Operator 6: removal of repeated passages by sharded Aho-Corasick automata.

A window is ``window`` consecutive words of one document.  Of its runs of
``GRAM`` words the one with the least hash (the leftmost, if equal) is its
anchor; equal windows have equal anchors, so windows are compared only within
an anchor's group.  Three steps, each over all documents:

1. Anchors that stand in two places or more.  A task that has seen an anchor
   twice knows; it sends one witness per anchor and batch for the others.
2. The stretch of text around each recurring anchor, dealt out by anchor.
   There one witness of each window met twice confirms it.  Runs of witnessed
   windows that always occur together are the passages; they are compiled into
   automata, a shard of anchors each, over the shard's own word numbers, and
   every stretch of every document is streamed through its shard's automaton,
   which locates the occurrences.
3. The occurrences go back to their documents, whose covered words go.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, shuffle_partitions
from .textkeys import blank_words, hashed_texts, long_windows, placed_texts

GRAM = 16
#: Stretches that one automaton is compiled from, unless one anchor has more.
SHARD = 20_000
_PLACE_BITS = np.uint64(30)
_PLACE = np.uint64((1 << 30) - 1)


def _anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place) of each anchor, and the number of the first window that has it."""
    grams = long_windows(hashes, GRAM)
    n = len(hashes) - window + 1
    if n <= 0:
        return grams[:0], np.empty(0, np.int64), np.empty(0, np.int64)
    least = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    spans, width, span = {1: least}, 1, window - GRAM + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
        spans[width] = least
    top = spans[width]
    least = np.minimum(top[:n], top[span - width : span - width + n])
    place = (least & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return grams[place[first]], place[first], first


def _postings(window: int, buckets: int):
    """Rows (bucket, kind, keys, places, anchors): kind 0 known to recur, 1 to be asked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, anchors = [], [], []
            for key, hashes in zip(batch.column("key").to_pylist(), hashed_texts(batch.column("text").to_pylist()), strict=True):
                anchor, place, _ = _anchors(hashes, window)
                keys.append(np.full(len(place), key, dtype=np.int64))
                places.append(place.astype(np.uint32))
                anchors.append(anchor)
            if not keys:
                continue
            key, place, anchor = map(np.concatenate, (keys, places, anchors))
            _, first, inverse, counts = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
            known = counts[inverse] > 1
            out = {"bucket": [], "kind": [], "keys": [], "places": [], "anchors": []}

            def add(bucket: int, kind: int, pick: np.ndarray) -> None:
                for name, value in zip(out, (bucket, kind, key[pick].tobytes(), place[pick].tobytes(), b"" if kind == 0 else anchor[pick].tobytes()), strict=True):
                    out[name].append(value)

            if known.any():
                add(int(key[0]) % buckets, 0, np.flatnonzero(known))
            bucket = (anchor[first] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                add(int(b), 1, first[order[cuts[b] : cuts[b + 1]]])
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(out, types, strict=True)], names=list(out))

    return rows


def _by_key(key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    blobs = [place[a:b].tobytes() for a, b in zip(starts, np.r_[starts, len(key)][1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(key[starts]), pa.array(blobs, pa.binary())], names=["key", "places"])


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket to (key, places) of anchors met in two batches or more."""

    def met(held: list[tuple]) -> pa.RecordBatch:
        key, place, anchor = (np.concatenate([np.frombuffer(h[i], dtype=t) for h in held]) for i, t in enumerate((np.int64, np.uint32, np.uint64)))
        _, inverse, counts = np.unique(anchor, return_inverse=True, return_counts=True)
        pick = counts[inverse] > 1
        return _by_key(key[pick], place[pick])

    now, held = None, []
    for batch in batches:
        for bucket, kind, keys, places, anchors in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "keys", "places", "anchors")), strict=True):
            if kind == 0:
                yield _by_key(np.frombuffer(keys, dtype=np.int64), np.frombuffer(places, dtype=np.uint32))
                continue
            if bucket != now:
                if held:
                    yield met(held)
                now, held = bucket, []
            held.append((keys, places, anchors))
    if held:
        yield met(held)


def _stretches(window: int):
    """(anchor, words, keys, starts): the text of all windows of a recurring anchor, equal ones of a batch folded."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded: dict[tuple[int, bytes], list[list[int]]] = defaultdict(lambda: [[], []])
            texts = batch.column("text").to_pylist()
            keys = zip(*(batch.column(c).to_pylist() for c in ("key", "places")), strict=True)
            for text, (key, blobs), (hashes, starts, ends) in zip(texts, keys, placed_texts(texts), strict=True):
                anchor, place, first = _anchors(hashes, window)
                end = np.r_[first[1:], len(hashes) - window + 1] + window - 1
                wanted = np.concatenate([np.frombuffer(b, dtype=np.uint32) for b in blobs])
                pick = np.flatnonzero(np.isin(place, wanted))
                spans = zip(anchor[pick].view(np.int64).tolist(), first[pick].tolist(), starts[first[pick]].tolist(), ends[end[pick] - 1].tolist(), strict=True)
                for a, word, s, e in spans:
                    held = folded[a, text[s:e]]
                    held[0].append(key)
                    held[1].append(word)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a for a, _ in folded], pa.int64()),
                    pa.array([w for _, w in folded], pa.binary()),
                    pa.array([np.array(k, dtype=np.int64).tobytes() for k, _ in folded.values()], pa.binary()),
                    pa.array([np.array(s, dtype=np.uint32).tobytes() for _, s in folded.values()], pa.binary()),
                ],
                names=["anchor", "words", "keys", "starts"],
            )

    return rows


def compile_passages(passages: set[tuple[int, ...]]) -> ahocorasick.Automaton:
    """An automaton over word numbers that reports the length of each passage met."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for words in passages:
        automaton.add_word(words, len(words))
    automaton.make_automaton()
    return automaton


def _runs_of(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, marks, False]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _witnesses(hashes: list[np.ndarray], weights: list[int], window: int) -> list[list[tuple[int, int]]]:
    """Of each stretch the runs of words to compile: windows that recur and are met here first.

    A run goes on as long as its windows always occur together, so it occurs
    whole wherever any window of it does.
    """
    cuts = np.cumsum([0, *map(len, hashes)])
    _, first, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    weight = np.repeat(weights, np.diff(cuts))
    count = np.bincount(number, weights=weight)
    # Steps from a window to the next one of the same stretch.
    inner = np.ones(len(number), dtype=bool)
    inner[cuts[1:] - 1] = False
    at = np.flatnonzero(inner)
    steps, of = np.unique(number[at] * len(count) + number[at + 1], return_inverse=True)
    together = np.zeros(len(number), dtype=bool)
    together[at] = np.bincount(of, weights=weight[at], minlength=len(steps))[of] == count[number[at]]
    together[at] &= count[number[at]] == count[number[at + 1]]
    witness = np.zeros(len(number), dtype=bool)
    witness[first[count > 1]] = True
    out = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        runs: list[tuple[int, int]] = []
        for k in np.flatnonzero(witness[a:b]).tolist():
            if runs and runs[-1][1] == k + window - 1 and together[a + k - 1]:
                runs[-1] = (runs[-1][0], k + window)
            else:
                runs.append((k, k + window))
        out.append(runs)
    return out


def _locate(window: int, rows: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch | None:
    """Confirm, compile and stream one shard of stretches; (key, spans) of what is covered."""
    distinct: dict[bytes, list[tuple[bytes, bytes]]] = defaultdict(list)
    for words, keys, starts in rows:
        distinct[words].append((keys, starts))
    hashes = list(hashed_texts(list(distinct)))
    runs = _witnesses([long_windows(h, window) for h in hashes], [sum(len(k) // 8 for k, _ in held) for held in distinct.values()], window)
    if not any(runs):
        return None
    # The automaton's letters have 32 bits: the shard's words get numbers.
    _, number = np.unique(np.concatenate(hashes), return_inverse=True)
    cuts = np.cumsum([0, *map(len, hashes)]).tolist()
    letters = [tuple(number[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)]
    automaton = compile_passages({words[a:b] for words, spans in zip(letters, runs, strict=True) for a, b in spans})
    out_keys, out_spans = [], []
    for words, occurrences in zip(letters, distinct.values(), strict=True):
        covered = np.zeros(len(words), dtype=bool)
        for end, length in automaton.iter(words):
            covered[end - length + 1 : end + 1] = True
        spans = np.array(_runs_of(covered), dtype=np.uint32)
        if not len(spans):
            continue
        for keys, starts in occurrences:
            for key, start in zip(np.frombuffer(keys, dtype=np.int64).tolist(), np.frombuffer(starts, dtype=np.uint32), strict=True):
                out_keys.append(key)
                out_spans.append((spans + start).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out_keys, pa.int64()), pa.array(out_spans, pa.binary())], names=["key", "spans"])


def _occurrences(window: int):
    """Rows sorted by anchor to (key, spans), a shard at a time, cut between anchors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for anchor, words, keys, starts in zip(*(batch.column(c).to_pylist() for c in ("anchor", "words", "keys", "starts")), strict=True):
                if len(held) >= SHARD and anchor != last:
                    if (out := _locate(window, held)) is not None:
                        yield out
                    held = []
                held.append((words, keys, starts))
                last = anchor
        if held and (out := _locate(window, held)) is not None:
            yield out

    return rows


_RESULT = "n_words long, n_removed long, kept binary, spans array<struct<start:long,end:long>>"


def _removed(keep_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept_texts, all_spans = [], [], [], []
            for text, blobs in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = blank_words(text)
                covered = np.zeros(len(words), dtype=bool)
                for blob in blobs or ():
                    for start, end in np.frombuffer(blob, dtype=np.uint32).reshape(-1, 2).tolist():
                        covered[start:end] = True
                runs = _runs_of(covered)
                kept, at = [], 0
                for start, end in runs:
                    kept += words[at:start]
                    at = end
                kept_text = b" ".join(kept + words[at:])
                n_words.append(len(words))
                n_removed.append(int(covered.sum()))
                kept_texts.append(kept_text if keep_text else hashlib.sha256(kept_text).hexdigest().encode())
                all_spans.append([{"start": a, "end": b} for a, b in runs])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_texts, pa.binary()), pa.array(all_spans, span)],
                names=["id", "n_words", "n_removed", "kept", "spans"],
            )

    return rows


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, digest: bool = False) -> DataFrame:
    """Remove each word that lies in a window whose words also start anywhere else.

    Returns one row per input row: ``id_col``, ``n_words``, ``n_removed``,
    ``kept_text`` (the kept words joined by a space; with ``digest`` instead
    ``kept_sha256`` of it) and ``spans`` (the removed runs of words, end
    exclusive).  Windows are judged on the input: every occurrence goes, the
    first included, also of repeated rows.

    Null and empty texts have no words; ids may be null or repeated; other
    columns are ignored; an empty table gives an empty result.  ``window`` is
    at least ``GRAM`` words.
    """
    if window < GRAM:
        raise ValueError(f"window must be {GRAM} words or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrase-dedup")
    parts = shuffle_partitions(spark)
    id_type = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    texts = texts.select("id", F.xxhash64("id", "text").alias("key"), "text")

    asked = texts.select("key", "text").mapInArrow(_postings(window, parts), "bucket long, kind long, keys binary, places binary, anchors binary")
    asked = asked.repartition(parts, "bucket").sortWithinPartitions("bucket")
    places = asked.mapInArrow(_recurring, "key long, places binary").groupBy("key").agg(F.collect_list("places").alias("places"))
    places = scratch.keep(places, "places")

    stretches = texts.join(places, "key").select("key", "text", "places").mapInArrow(_stretches(window), "anchor long, words binary, keys binary, starts binary")
    stretches = stretches.repartition(parts, "anchor").sortWithinPartitions("anchor")
    spans = stretches.mapInArrow(_occurrences(window), "key long, spans binary")
    spans = scratch.keep(spans.groupBy("key").agg(F.array_distinct(F.collect_list("spans")).alias("spans")), "spans")

    found = texts.join(spans, "key", "left").select("id", "text", "spans")
    schema = f"id {id_type.simpleString()}, {_RESULT}"
    out = found.mapInArrow(_removed(not digest), schema)
    kept = F.col("kept").cast("string").alias("kept_sha256" if digest else "kept_text")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", kept, "spans")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35),
k AS (SELECT doc_id, i, sha256(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h FROM p),
m AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM k JOIN m USING (h)),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d WHERE len(ws) > 0),
t AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.j) FILTER (g.j IS NULL) AS kept, count(g.j) AS gone FROM w LEFT JOIN g ON w.doc_id = g.doc_id AND w.j = g.j GROUP BY w.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
