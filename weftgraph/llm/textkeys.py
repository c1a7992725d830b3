"""Words, word hashes and shingle sets of whole texts, as numpy arrays.

Hashes are 64 bits wide and made from the words' bytes alone, so every task
and every run gives a word the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Odd multipliers of the polynomial over word hashes and of its final mixing.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
MIX_TOO = np.uint64(0x94D049BB133111EB)
#: Bytes of text that are hashed at a time; bounds the arrays made on the way, whatever a batch holds.
AT_ONCE = 1 << 21
#: Words over this many bytes are hashed one by one.
LONG_WORD = 256

EMPTY = np.empty(0, dtype=np.uint64)


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def blank_words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text; ``lower`` folds A-Z only."""
    if not text:
        return []
    return (text.lower() if lower else text).split()


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of the texts, number of words before each text and in all).

    A word's hash takes eight bytes at a time, so equal words have equal hashes
    in every task and run.
    """
    hashes, cuts, _, _ = placed_words(texts)
    return hashes, cuts


def placed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``hashed_words``, and where each word starts and ends, in bytes of its text."""
    held = [t or b"" for t in texts]
    # A blank before each text parts it from the one before; the padding lets the last words be read whole.
    joined = b" " + b" ".join(held) + b" " * 17
    data = np.frombuffer(joined, dtype=np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    places = np.cumsum([0, *(len(t) + 1 for t in held)]) + 1
    cuts = np.searchsorted(starts, places)
    hashes = _hash_spans(joined, data, starts, ends - starts)
    before = np.repeat(places[:-1], np.diff(cuts))
    return hashes, cuts, starts - before, ends - before


def _hash_spans(joined: bytes, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    eights = data[: len(data) // 8 * 8].view("<u8")
    out = lengths.astype(np.uint64) * STEP
    pick, at, left = None, starts, np.minimum(lengths, LONG_WORD)
    while len(at):
        # Eight bytes from any place: the rest of one aligned word and the start of the next.
        word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        value = (eights[word] >> shift) | ((eights[np.minimum(word + 1, len(eights) - 1)] << np.uint64(1)) << (np.uint64(63) - shift))
        value &= _FIRST_BYTES[np.minimum(left, 8)]
        if pick is None:
            out = scrambled(out ^ value)
        else:
            out[pick] = scrambled(out[pick] ^ value)
        more = np.flatnonzero(left > 8)
        pick = more if pick is None else pick[more]
        at, left = at[more] + 8, left[more] - 8
    for k in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : starts[k] + lengths[k]])
    return out


def scrambled(values: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values whose every bit depends on all bits."""
    values = (values ^ (values >> np.uint64(30))) * MIX
    values = (values ^ (values >> np.uint64(27))) * MIX_TOO
    return values ^ (values >> np.uint64(31))


def slices(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of ``AT_ONCE`` bytes or a single longer one."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or b"") + 1
        if i > start and size + n > AT_ONCE:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def hashed_texts(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text in turn."""
    for start, end in slices(texts):
        hashes, cuts = hashed_words(texts[start:end])
        yield from (hashes[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False))


def placed_texts(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word hashes, first byte of each word, end of each word) of each text in turn."""
    for start, end in slices(texts):
        hashes, cuts, starts, ends = placed_words(texts[start:end])
        yield from ((hashes[a:b], starts[a:b], ends[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of words without blanks."""
    return hashed_words([b" ".join(words)])[0]


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * MIX
    return values ^ (values >> np.uint64(29))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each run of ``size`` words, by its first word's place."""
    n = len(hashes) - size + 1
    if n <= 0:
        return EMPTY
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= STEP
        out += hashes[j : j + n]
    return mixed(out)


def long_windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """As ``windows``, in about log2(size) passes: spans of powers of two are joined."""
    n = len(hashes) - size + 1
    if n <= 0:
        return EMPTY
    spans, width = {1: hashes}, 1
    while width * 2 <= size:
        last = spans[width]
        spans[width * 2] = mixed(last[:-width] * STEP + last[width:])
        width *= 2
    out, at = None, 0
    while width:
        if size & width:
            part = spans[width][at : at + n]
            out = part.copy() if out is None else mixed(out * STEP + part)
            at += width
        width >>= 1
    return out


def shingle_sets(texts: list[bytes | None], size: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each lower-cased text in turn.

    A text with fewer words is one shingle; one without words has none.
    """
    for start, end in slices(texts):
        hashes, cuts = hashed_words([t.lower() if t else b"" for t in texts[start:end]])
        spans = windows(hashes, size)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            if b - a >= size:
                own = np.sort(spans[a : b - size + 1])
                yield own[np.r_[True, own[1:] != own[:-1]]]
            else:
                yield _short(hashes[a:b])


def _short(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return EMPTY
    whole = hashes[:1] + np.uint64(len(hashes))
    for value in hashes[1:]:
        whole = whole * STEP + value
    return mixed(whole)


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """As ``shingle_sets``, of one text."""
    return next(shingle_sets([text], size))


def least_overlap(n: int, m: int, percent: int) -> int:
    """Smallest common size at which sets of n and m reach the similarity."""
    return -(-percent * (n + m) // (100 + percent))
