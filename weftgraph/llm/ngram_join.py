"""Operator 1: exact n-gram Jaccard self-join by T-occurrence search.

A document is the set of its distinct word shingles; equal sets are folded
into one first, so what is joined are sets, each with a number of its own.
Under any order of shingles that all sets share, two sets of similarity p %
have a shingle in common among the first n - ceil(p n / 100) + 1 of each, the
prefix.  The order here is by hash, with the shingles that tasks meet most
often among all documents moved to the end.

Of a similar pair, the smaller set has one of the shared shingles even within
its first n - ceil(2 p n / (100 + p)) + 1.  A shingle's list keeps the sets that
have a partner in it by these places and by set size; they belong to the block
named by the least of them, so every similar pair meets in a block.  Strangers
meet there too, by a shingle that both happen to have, and the more the larger
the corpus is.  Most are told apart by parities, one bit for each cell that an
odd number of a set's shingles falls into: sets differ in no fewer shingles
than bits.  Blocks fall into the groups that this bound leaves connected, and
these into those that prefixes leave connected: up to the end of the shorter
prefix it is known how many shingles a pair shares and how many each has left,
which bounds the overlap.  Sets that are left alone go, and only the others'
texts are read again and searched by DivideSkip (``tsearch``).

Blocks larger than ``BLOCK`` are cut by set size, and if still too large lose
the members that parities leave no partner and are split by hash; what the parts find is contracted, the parts' leaders are searched
again, and only if a block still has several components are the members
outside its largest one searched against all parts.  So a group of near copies
of any size costs one look per copy, and no pair is lost.

Joins that carry prefixes or texts are merge joins whatever their size, so
plans are alike for small and large tables and nothing of them is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitfilter import may_match
from .components import connected_components
from .storage import Scratch, shuffle_partitions
from .textkeys import AT_ONCE, EMPTY, least_overlap, shingle_sets
from .tsearch import block_links

#: Members of a block, or of a part of it, that one search holds in memory.
BLOCK = 512
#: Entries at most of the broadcast table of frequent shingles (under 1 MB).
FREQUENT = 1 << 16
#: A shingle met fewer times, by tasks that hold it twice, is never called frequent.
SELDOM = 32
#: Shingle postings that one bucket is meant to hold.
BUCKET = 500_000
#: Prefix tokens that a task gathers before it looks for repeated ones.
GATHERED = 2_000_000
ROUNDS = 40
#: Copies of the members that the exhaustive step may send without a round of leaders before it.
REPEAT = 8
#: Set keys that a task remembers to leave out prefixes of copies.
KEYS = 200_000
#: Postings longer than this are counted by a matrix product, others pair by pair.
DENSE = 16

_OFTEN = np.uint64(1 << 63)


def _ordered(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Places of tokens in the order of all shingles: by hash, the frequent ones last."""
    places = tokens >> np.uint64(1)
    if len(frequent):
        at = np.searchsorted(frequent, tokens)
        at[at == len(frequent)] = 0
        places[frequent[at] == tokens] |= _OFTEN
        places.sort()
    return places


def _prefix(tokens: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    n = len(tokens)
    return _ordered(tokens, frequent)[: n + 1 + (-percent * n) // 100] if n else EMPTY


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def _set_key(tokens: np.ndarray) -> tuple[int, int]:
    key = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (key >> 64) - (1 << 63), (key & (1 << 64) - 1) - (1 << 63)


def _parities(tokens: np.ndarray) -> bytes:
    """One bit for each cell that an odd number of tokens falls into, three quarters as many cells as tokens or more.

    The exclusive or of two sets' bits has a bit at most for each token that
    only one of them holds; cells are a power of two, so halves laid upon each
    other give the bits of half as many cells.
    """
    cells = max(64, 1 << (3 * len(tokens) // 4 - 1).bit_length())
    held = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8)
    return np.packbits(held & 1, bitorder="little").tobytes()


def _often_met(size: int, percent: int):
    """(token, count) of prefix tokens, in hash order, that stand in two of the texts a task has gathered or more."""

    def repeated(parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.sort(np.concatenate(parts))
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        counts = np.diff(np.r_[starts, len(tokens)])
        again = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(_signed(tokens[starts[again]])), pa.array(counts[again].astype(np.int64))], names=["token", "count"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for tokens in shingle_sets(batch.column("text").to_pylist(), size):
                if len(tokens):
                    parts.append(tokens[: len(tokens) + 1 + (-percent * len(tokens)) // 100].copy())
                    held += len(parts[-1])
                if held >= GATHERED:
                    yield repeated(parts)
                    parts, held = [], 0
        if parts:
            yield repeated(parts)

    return rows


def _prefix_rows(size: int, percent: int, frequent: np.ndarray):
    """(id, n, h1, h2, prefix, bits): size and key of each text's set; prefix and parities only where the task meets the set first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in batches:
            n, h1, h2, prefix, bits = [], [], [], [], []
            for named, tokens in zip(batch.column("id").is_valid().to_pylist(), shingle_sets(batch.column("text").to_pylist(), size), strict=True):
                key = _set_key(tokens)
                n.append(len(tokens))
                h1.append(key[0])
                h2.append(key[1])
                fresh = named and len(tokens) > 0 and key not in met
                prefix.append(_prefix(tokens, percent, frequent).tobytes() if fresh else None)
                bits.append(_parities(tokens) if fresh else None)
                if fresh:
                    if len(met) >= KEYS:
                        met.clear()
                    met.add(key)
            columns = [pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "n", "h1", "h2", "prefix", "bits"])

    return rows


#: Marks a posting whose place makes its set the smaller one of a pair, beside the set's size.
_EARLY = np.uint32(1 << 31)


def _prefixes(batch: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All prefix tokens of a batch, the set of each, and its size with the mark of early places."""
    parts = [np.frombuffer(p, dtype=np.uint64) for p in batch.column("prefix").to_pylist()]
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    n = np.minimum(batch.column("n").to_numpy(zero_copy_only=False), (1 << 31) - 1)
    owners = np.repeat(batch.column("vertex").to_numpy(zero_copy_only=False), lengths)
    sizes = np.repeat(n.astype(np.uint32), lengths)
    place = np.arange(len(owners)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sizes[place < np.repeat(n + 1 + (-2 * percent * n) // (100 + percent), lengths)] |= _EARLY
    return (np.concatenate(parts) if parts else EMPTY), owners, sizes


def _partnered(keys: np.ndarray, members: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, member) of the sets that have a partner in their token's list; a block is named by its least member.

    A partner pair is an early posting and another one of a set as large or
    larger, as far as the similarity allows.
    """
    n, early = (sizes & ~_EARLY).astype(np.int64), sizes >= _EARLY
    order = np.lexsort((~early, n, keys))
    keys, members, n, early = keys[order], members[order], n[order], early[order]
    if not len(keys):
        return members, members
    follows = keys[1:] == keys[:-1]
    # The last early posting before each one.
    at = np.where(early, np.arange(len(keys)), -1)
    before = np.r_[-1, np.maximum.accumulate(at)[:-1]]
    had = (before >= 0) & (keys[before] == keys) & (100 * n[before] >= percent * n)
    has = np.r_[early[:-1] & follows & (100 * n[:-1] >= percent * n[1:]), False]
    keys, members = keys[had | has], members[had | has]
    order = np.lexsort((members, keys))
    keys, members = keys[order], members[order]
    head = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, dtype=bool)
    block = members[head][np.cumsum(head) - 1]
    order = np.lexsort((members, block))
    block, members = block[order], members[order]
    new = np.r_[True, (block[1:] != block[:-1]) | (members[1:] != members[:-1])] if len(block) else head
    return block[new], members[new]


def _dealt(buckets: int, percent: int):
    """Prefixes to one blob of (token, set) postings for each batch and bucket, without frequent tokens.

    A bucket's tokens are told apart by 32 bits more; a rare mistake only puts
    strangers into one block.  Sets are given as distances from the batch's
    least one where they are near.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, owners, sizes = _prefixes(batch, percent)
            rare = tokens < _OFTEN
            tokens, owners, sizes = tokens[rare], owners[rare], sizes[rare]
            if not len(tokens):
                continue
            base = int(owners.min())
            near = int(owners.max()) - base < 1 << 32
            bucket = ((tokens >> np.uint64(11)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            owners, bucket, sizes = owners[order], bucket[order], sizes[order]
            fragments = (tokens[order] >> np.uint64(31)).astype(np.uint32)
            if near:
                owners = (owners - base).astype(np.uint32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            ids = np.flatnonzero(np.diff(cuts)).tolist()
            keys = [fragments[cuts[b] : cuts[b + 1]].tobytes() for b in ids]
            members = [owners[cuts[b] : cuts[b + 1]].tobytes() for b in ids]
            widths = [sizes[cuts[b] : cuts[b + 1]].tobytes() for b in ids]
            columns = [pa.array(ids, pa.int64()), pa.array([base if near else None] * len(ids), pa.int64()), *(pa.array(c, pa.binary()) for c in (keys, members, widths))]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "base", "tokens", "vertices", "sizes"])

    return rows


def _often_held(percent: int):
    """(token, member) of the frequent tokens in prefixes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, owners, _ = _prefixes(batch, percent)
            often = tokens >= _OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(_signed(tokens[often])), pa.array(owners[often])], names=["token", "member"])

    return rows


def _members(percent: int):
    """Blobs sorted by bucket to distinct (block, member)."""

    def found(held: list[tuple]) -> pa.RecordBatch:
        keys = np.concatenate([np.frombuffer(t, dtype=np.uint32) for _, t, _, _ in held])
        members = np.concatenate([np.frombuffer(v, dtype=np.int64) if base is None else np.frombuffer(v, dtype=np.uint32).astype(np.int64) + base for base, _, v, _ in held])
        sizes = np.concatenate([np.frombuffer(w, dtype=np.uint32) for *_, w in held])
        block, member = _partnered(keys, members, sizes, percent)
        return pa.RecordBatch.from_arrays([pa.array(block), pa.array(member)], names=["block", "member"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, *posting in zip(*(batch.column(c).to_pylist() for c in ("bucket", "base", "tokens", "vertices", "sizes")), strict=True):
                if bucket != now:
                    if held:
                        yield found(held)
                    now, held = bucket, []
                held.append(tuple(posting))
        if held:
            yield found(held)

    return rows


def _group_name(members: np.ndarray) -> int:
    """Equal groups of different blocks get one name; members are sorted."""
    return xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)


def close_pairs(blocks: np.ndarray, sizes: np.ndarray, bits: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block, rows sorted by it, whose parities leave them a chance; all pairs of a batch in a few steps.

    Sets of n and m that differ in d tokens share (n + m - d) / 2, and d is no
    less than the number of bits in which they differ.
    """
    m = len(blocks)
    widths = np.array([len(b) // 8 for b in bits], dtype=np.int64)
    rows = {}
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        held = np.frombuffer(b"".join(bits[i] for i in at.tolist()), dtype=np.uint64).reshape(len(at), width)
        place = np.full(m, -1)
        place[at] = np.arange(len(at))
        rows[width] = (place, held)
    found = []
    for step in range(1, m):
        left = np.flatnonzero(blocks[step:] == blocks[:-step])
        if not len(left):
            break
        right = left + step
        few, many = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
        fits = 100 * few >= percent * many
        left, right = left[fits], right[fits]
        most = (sizes[left] + sizes[right]) - 2 * least_overlap(sizes[left], sizes[right], percent)
        both = np.minimum(widths[left], widths[right]) << 32 | np.maximum(widths[left], widths[right])
        for kind in np.unique(both).tolist():
            low, high = kind >> 32, kind & (1 << 32) - 1
            these = np.flatnonzero(both == kind)
            for start in range(0, len(these), max(1, AT_ONCE // (8 * high))):
                part = these[start : start + max(1, AT_ONCE // (8 * high))]
                x, y = left[part], right[part]
                swap = widths[x] > widths[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                folded = np.bitwise_xor.reduce(rows[high][1][rows[high][0][y]].reshape(len(part), high // low, low), axis=1)
                near = np.bitwise_count(rows[low][1][rows[low][0][x]] ^ folded).sum(axis=1, dtype=np.int64) <= most[part]
                found.append(np.stack([x[near], y[near]]))
    pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.int64)
    return pairs[0], pairs[1]


def _close(percent: int):
    """Rows sorted by block to (block, member) of the groups that hold together by pairs that parities leave a chance."""

    def close(batch: pa.Table) -> pa.RecordBatch:
        blocks, vertices = batch.column("block").to_numpy(), batch.column("vertex").to_numpy()
        x, y = close_pairs(blocks, batch.column("n").to_numpy(), batch.column("bits").to_pylist(), percent)
        group, before = np.arange(len(blocks)), None
        while before is None or (group != before).any():
            before = group.copy()
            least = np.minimum(group[x], group[y])
            np.minimum.at(group, before[x], least)
            np.minimum.at(group, before[y], least)
            group = group[group]
        held = np.unique(np.concatenate([x, y]))
        held = held[np.lexsort((vertices[held], group[held]))]
        cuts = np.flatnonzero(np.r_[True, group[held][1:] != group[held][:-1], True]) if len(held) else np.zeros(1, dtype=np.int64)
        names = [_group_name(vertices[held[a:b]]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, dtype=np.int64), np.diff(cuts))), pa.array(vertices[held])], names=["block", "member"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cut = int(np.searchsorted(blocks, blocks[-1])) if len(blocks) else 0
            if cut or (rest and len(blocks) and rest[-1].column("block")[0].as_py() != blocks[0]):
                yield close(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
                rest = []
            if len(blocks):
                rest.append(batch.slice(cut))
        if rest:
            yield close(pa.Table.from_batches(rest))

    return rows


def _shared_counts(prefixes: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two prefixes share; no fewer where tokens cut short are alike within a prefix."""
    m = len(prefixes)
    owners = np.repeat(np.arange(m), [len(p) for p in prefixes])
    tokens = np.concatenate(prefixes)
    order = np.argsort(tokens, kind="stable")
    owners, tokens = owners[order], tokens[order]
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    lengths = np.diff(np.r_[starts, len(tokens)])
    counts = np.zeros(m * m, dtype=np.int64)
    for n in np.unique(lengths[(lengths > 1) & (lengths <= DENSE)]).tolist():
        lists = owners[starts[lengths == n][:, None] + np.arange(n)]
        for x in range(n):
            for y in range(x + 1, n):
                counts += np.bincount(lists[:, x] * m + lists[:, y], minlength=m * m)
    counts = counts.reshape(m, m)
    counts += counts.T
    long = np.flatnonzero(lengths > DENSE)
    for at in range(0, len(long), 1024):
        part = long[at : at + 1024]
        held = np.zeros((m, len(part)), dtype=np.float32)
        for column, k in enumerate(part.tolist()):
            np.add.at(held[:, column], owners[starts[k] : starts[k] + lengths[k]], 1)
        counts += (held @ held.T).astype(np.int64)
    return counts


def possible_groups(sizes: np.ndarray, prefixes: list[np.ndarray], percent: int) -> list[list[int]]:
    """Groups of two sets or more that hold together by pairs whose prefixes leave them a chance.

    Of a pair it is known up to the end of the prefix that ends first how many
    tokens each has and how many are shared; beyond it they share at most what
    the one that has less left has.
    """
    m = len(sizes)
    shared = _shared_counts(prefixes)
    last = np.array([p[-1] for p in prefixes], dtype=prefixes[0].dtype)
    # up_to[i, j]: tokens of i's prefix before the end of j's.  Tokens may be cut short: those at the very end are left open.
    up_to = np.stack([np.searchsorted(p, last, side="left") for p in prefixes])
    left = sizes[:, None] - up_to
    need = -(-percent * (sizes[:, None] + sizes[None, :]) // (100 + percent))
    able = (shared > 0) & (shared + np.minimum(left, left.T) >= need)
    np.fill_diagonal(able, False)
    group = np.full(m, -1)
    out = []
    for start in np.flatnonzero(able.any(axis=1)).tolist():
        if group[start] >= 0:
            continue
        inside, fresh = np.zeros(m, dtype=bool), np.array([start])
        while len(fresh):
            inside[fresh] = True
            fresh = np.flatnonzero(able[fresh].any(axis=0) & ~inside)
        group[inside] = len(out)
        out.append(np.flatnonzero(inside).tolist())
    return out


def _possible(percent: int):
    """Rows sorted by block to (block, member, size) of its groups; equal groups of different blocks get one name."""

    def groups(held: list[tuple]) -> Iterator[tuple[int, list[int]]]:
        vertices, n, blobs = zip(*held, strict=True)
        prefixes = [np.frombuffer(b, dtype=np.uint64) for b in blobs]
        for group in possible_groups(np.array(n, dtype=np.int64), prefixes, percent):
            members = sorted(vertices[i] for i in group)
            yield _group_name(np.array(members, dtype=np.int64)), members

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        out: list[list[int]] = [[], [], []]

        def close() -> None:
            if len(held) > 1:
                for name, members in groups(held):
                    for column, values in zip(out, ([name] * len(members), members, [len(members)] * len(members)), strict=True):
                        column += values

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["block", "member", "size"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                for block, vertex, n, prefix in zip(*(part.column(c).to_pylist() for c in ("block", "vertex", "n", "prefix")), strict=True):
                    if block != now:
                        close()
                        now, held = block, []
                    held.append((vertex, n, prefix))
            yield made()
        close()
        yield made()

    return rows


def _of_set(size: int):
    """Rows whose text has the set that the row names: an id may be repeated with other texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("vertex", "h1", "h2")), strict=True)
            fresh = []
            for tokens, (vertex, h1, h2) in zip(shingle_sets(batch.column("text").to_pylist(), size), keys, strict=True):
                fresh.append(vertex not in met and _set_key(tokens) == (h1, h2))
                if fresh[-1]:
                    if len(met) >= KEYS:
                        met.clear()
                    met.add(vertex)
            yield batch.filter(pa.array(fresh, pa.bool_())).select(["vertex", "text"])

    return rows


def _able(sets: list[np.ndarray], percent: int) -> tuple[list[int], list[np.ndarray]]:
    """Members that share enough tokens with the others to match any, and those tokens of each."""
    sizes = np.array([len(s) for s in sets])
    least = -(-percent * sizes // 100)
    able = np.flatnonzero(sizes > 0)
    while len(able):
        owner = np.repeat(np.arange(len(able)), [len(sets[i]) for i in able])
        tokens = np.concatenate([sets[i] for i in able])
        _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = counts[inverse] > 1
        has = np.bincount(owner[shared], minlength=len(able))
        for k, i in enumerate(np.split(tokens[shared], np.cumsum(has)[:-1])):
            sets[able[k]] = i
        enough = has >= least[able]
        if enough.all():
            break
        able = able[enough]
    return able.tolist(), sets


def _stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same components with every vertex linked to its least one."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in list(up) if root(x) != x]


def _block_search(size: int, percent: int):
    """Rows sorted by (block, part) to links (a, b); label: the component so far, asked: null, or whether to search for the row."""

    def links(vertices: list[int], texts: list[bytes], labels: list[int], asked: list) -> list[tuple[int, int]]:
        sets = list(shingle_sets(texts, size))
        sizes = [len(s) for s in sets]
        able, sets = _able(sets, percent)
        # Short sets first: a leader is then no longer than its followers.
        order = sorted(able, key=lambda i: (sizes[i], vertices[i]))
        if len(order) < 2:
            return []
        queries = None if asked[0] is None else [bool(asked[i]) for i in order]
        found = block_links([sets[i] for i in order], [sizes[i] for i in order], [labels[i] for i in order], queries, percent)
        return _stars([(vertices[order[x]], vertices[order[y]]) for x, y in found])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            found = links(*map(list, zip(*held, strict=True)))
            if not found:
                return None
            a, b = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            names = ("block", "part", "vertex", "text", "label", "asked")
            for block, part, vertex, text, label, asked in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (block, part) != now:
                    if (made := out()) is not None:
                        yield made
                    now, held = (block, part), []
                held.append((vertex, text, label, asked))
        if (made := out()) is not None:
            yield made

    return rows


def _partners(percent: int):
    """Rows sorted by (block, part) to (block, member, met) of those that are asked: whether parities leave them a partner in the part.

    Null in `asked`: every row is asked about all others.  One that was met by
    an earlier row needs no look of its own, so near copies cost few.
    """

    def met(n: np.ndarray, bits: list[bytes], asked: list) -> tuple[np.ndarray, np.ndarray]:
        every = asked[0] is None
        queries = np.arange(len(n)) if every else np.flatnonzero(np.array(asked))
        others = queries if every else np.flatnonzero(~np.array(asked))
        widths = np.array([len(b) // 8 for b in bits], dtype=np.int64)
        words = [np.frombuffer(b, dtype=np.uint64) for b in bits]
        held = {(w, w): np.stack([words[i] for i in others[widths[others] == w].tolist()]) for w in np.unique(widths[others]).tolist()}
        places = {w: others[widths[others] == w] for w, _ in held}
        out = np.zeros(len(n), dtype=bool)
        for x in queries.tolist():
            if out[x]:
                continue
            for w, at in places.items():
                low = min(w, len(words[x]))
                if (w, low) not in held:
                    held[w, low] = np.bitwise_xor.reduce(held[w, w].reshape(len(at), w // low, low), axis=1)
                own = np.bitwise_xor.reduce(words[x].reshape(-1, low), axis=0)
                differ = np.bitwise_count(held[w, low] ^ own).sum(axis=1, dtype=np.int64)
                near = differ <= n[x] + n[at] - 2 * least_overlap(int(n[x]), n[at], percent)
                near &= 100 * np.minimum(n[x], n[at]) >= percent * np.maximum(n[x], n[at])
                if every:
                    near &= at != x
                    out[at[near]] = True
                if near.any():
                    out[x] = True
                    if not every:
                        break
        return queries, out[queries]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def made() -> pa.RecordBatch:
            vertices, n, bits, asked = map(list, zip(*held, strict=True))
            queries, found = met(np.array(n, dtype=np.int64), bits, asked)
            members = np.array(vertices, dtype=np.int64)[queries]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(members), now[0], dtype=np.int64)), pa.array(members), pa.array(found)], names=["block", "member", "met"])

        for batch in batches:
            names = ("block", "part", "vertex", "n", "bits", "asked")
            for block, part, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (block, part) != now:
                    if held:
                        yield made()
                    now, held = (block, part), []
                held.append(row)
        if held:
            yield made()

    return rows


def _thinned(large: DataFrame, bits: DataFrame, percent: int, parts: int, scratch: Scratch) -> DataFrame:
    """Blocks without the members whose parities leave them no partner: looked for in the member's own part of the block, then in all others."""
    count = F.ceil(F.col("size") / (4 * BLOCK))
    dealt = large.select("block", F.col("member").alias("vertex"), "size", F.pmod(F.xxhash64("member"), count).alias("part"))
    held = scratch.keep(dealt.join(may_match(bits, "vertex", dealt).hint("merge"), "vertex"), "dealt")
    partners = lambda rows, name: scratch.keep(
        _sorted_by(rows.select("block", "part", "vertex", "n", "bits", "asked"), parts, "block", "part").mapInArrow(_partners(percent), "block long, member long, met boolean"), name
    )
    met = partners(held.withColumn("asked", F.lit(None).cast("boolean")), "met")
    alone = met.where("not met").select("block", F.col("member").alias("vertex"))
    asked = held.where(count > 1).join(alone, ["block", "vertex"], "left_semi")
    kept = met.where("met").select("block", "member")
    if not asked.isEmpty():
        others = asked.withColumn("own", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).where("part <> own").drop("own")
        there = held.join(alone.select("block").distinct(), "block", "left_semi").select(*others.columns)
        again = partners(others.withColumn("asked", F.lit(True)).unionByName(there.withColumn("asked", F.lit(False))), "met-elsewhere")
        kept = kept.unionByName(again.where("met").select("block", "member").distinct())
    sizes = kept.groupBy("block").agg(F.count("*").alias("size")).where("size > 1")
    return kept.join(sizes, "block").select(*large.columns)


def _cut(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(block, member, size): blocks cut into blocks of two neighbouring bands of set sizes each.

    Bands are as wide as the similarity lets two sizes differ, so a fitting
    one lies in the same or the next band.
    """
    width = math.log(max(1.01, 100 / percent)) * 1.0001
    banded = members.join(sets.select(F.col("vertex").alias("member"), F.floor(F.log("n") / width).cast("int").alias("band")), "member")
    cut = banded.select("block", "member", "band", F.explode(F.array(F.col("band") - 1, "band")).alias("lower"))
    sizes = cut.groupBy("block", "lower").agg(F.count("*").alias("size"), F.min("band").alias("least"))
    # A block without members of its lower band says nothing that the next one doesn't.
    sizes = sizes.where((F.col("size") > 1) & (F.col("least") == F.col("lower"))).drop("least")
    return cut.join(sizes, ["block", "lower"]).select(F.xxhash64("block", "lower").alias("block"), "member", "size")


def _sorted_by(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    return df.repartition(parts, *keys).sortWithinPartitions(*keys)


def _frequent(counts: DataFrame) -> np.ndarray:
    """Sorted tokens of the largest counts, ``FREQUENT`` at most."""
    total, bound = 0, SELDOM
    steps = counts.groupBy(F.floor(F.log2("count") * 2).alias("step")).agg(F.count("*").alias("tokens")).collect()
    for step in sorted(steps, key=lambda r: -r["step"]):
        total += step["tokens"]
        if total > FREQUENT:
            bound = 2 ** ((step["step"] + 1) / 2)
            break
    rows = counts.where(F.col("count") >= bound).limit(FREQUENT).select("token").collect()
    return np.array(sorted(r["token"] % (1 << 64) for r in rows), dtype=np.uint64)


def _needed_texts(texts: DataFrame, wanted: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """(vertex, text) of the wanted (id, vertex, h1, h2); a row that is repeated may come once for each task."""
    held = may_match(texts.where("id is not null"), "id", wanted)
    return scratch.keep(held.join(wanted.hint("merge"), "id").select("vertex", "h1", "h2", "text").mapInArrow(_of_set(size), "vertex long, text binary"), "texts")


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """Link every two documents whose shingle sets reach the similarity.

    Returns one row per input row: ``id_col``, ``n_shingles`` (size of its set)
    and ``component_id`` (least id reachable through links, itself included).

    Null or word-less texts have size 0 and are linked with nothing.  Rows with
    a null id keep their size and get a null component.  Rows that repeat an id
    are one document with all their texts: they share its component.  Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    parts = shuffle_partitions(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    counts = texts.where("id is not null").select("text").mapInArrow(_often_met(size, percent), "token long, count long")
    counts = scratch.keep(counts.groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= SELDOM), "counts")
    frequent = _frequent(counts)

    rows = scratch.keep(texts.mapInArrow(_prefix_rows(size, percent, frequent), f"id {id_type}, n long, h1 long, h2 long, prefix binary, bits binary"), "rows")
    sets = rows.where("id is not null and n > 0").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("n").alias("n"), F.first("prefix", ignorenulls=True).alias("prefix"), F.first("bits", ignorenulls=True).alias("bits"))
    sets = scratch.keep(sets.withColumn("vertex", F.monotonically_increasing_id()), "sets")
    scratch.drop("counts")

    postings = sets.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    buckets = max(parts, int(postings // BUCKET))
    prefixes = sets.select("vertex", "n", "prefix")
    dealt = prefixes.mapInArrow(_dealt(buckets, percent), "bucket long, base long, tokens binary, vertices binary, sizes binary")
    members = _sorted_by(dealt, buckets, "bucket").mapInArrow(_members(percent), "block long, member long")
    if len(frequent):
        often = scratch.keep(prefixes.mapInArrow(_often_held(percent), "token long, member long"), "often")
        named = often.groupBy("token").agg(F.min("member").alias("block"), F.count("*").alias("n")).where("n > 1")
        # At most FREQUENT rows.
        members = members.union(often.join(F.broadcast(named), "token").select("block", "member"))
    members = scratch.keep(members.distinct(), "members")
    scratch.drop("often")
    large = scratch.keep(members.groupBy("block").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("block"), "large")
    split = not large.isEmpty()
    if split:
        cut = scratch.keep(_cut(members.join(large, "block", "left_semi"), sets, percent), "cut")
        members = members.join(large, "block", "left_anti").unionByName(cut.where(F.col("size") <= BLOCK).select("block", "member"))

    # The parities first: they are a fraction of the prefixes and leave few strangers in a block.
    held = members.withColumnRenamed("member", "vertex").join(sets.select("vertex", "n", "bits").hint("merge"), "vertex").select("block", "vertex", "n", "bits")
    close = _sorted_by(held, max(parts, buckets), "block").mapInArrow(_close(percent), "block long, member long").distinct()
    close = scratch.keep(close.withColumnRenamed("member", "vertex"), "close")
    small = close.join(may_match(prefixes, "vertex", close).hint("merge"), "vertex").select("block", "vertex", "n", "prefix")
    possible = _sorted_by(small, max(parts, buckets), "block").mapInArrow(_possible(percent), "block long, member long, size long").distinct()
    if split:
        thinned = _thinned(cut.where(F.col("size") > BLOCK), sets.select("vertex", "n", "bits"), percent, max(parts, buckets), scratch)
        possible = possible.unionByName(thinned.select(*possible.columns))
    members = scratch.keep(possible, "possible")
    scratch.drop("members", "large", "cut", "close", "dealt", "met", "met-elsewhere")

    wanted = sets.join(members.select(F.col("member").alias("vertex")), "vertex", "left_semi").select("vertex", "h1", "h2", F.col("least").alias("id"))
    texts_of = _needed_texts(texts, scratch.keep(wanted, "wanted"), size, scratch)
    scratch.drop("wanted")
    split = split and not members.where(F.col("size") > BLOCK).isEmpty()
    searched = _block_search(size, percent)

    def search(rows: DataFrame, name: str, few: bool = True) -> DataFrame:
        held = may_match(texts_of, "vertex", rows) if few else texts_of
        full = rows.join(held.hint("merge"), "vertex").select("block", "part", "vertex", "text", "label", "asked")
        return scratch.keep(_sorted_by(full, max(parts, buckets), "block", "part").mapInArrow(searched, "a long, b long"), name)

    part = F.pmod(F.xxhash64("member"), F.ceil(F.col("size") / BLOCK))
    links = search(
        members.select("block", part.alias("part"), F.col("member").alias("vertex"), F.col("member").alias("label"), F.lit(None).cast("boolean").alias("asked")), "links", few=False
    )
    roots = connected_components(links, scratch, "roots")
    for turn in range(ROUNDS + 1) if split else ():
        # Blocks that were split: what is not yet in one component.
        labelled = members.where(F.col("size") > BLOCK).join(roots.withColumnRenamed("vertex", "member"), "member", "left").select("block", "member", F.coalesce("root", "member").alias("label"), part.alias("part"))
        open_blocks = labelled.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        labelled = scratch.keep(labelled.join(open_blocks.select("block"), "block"), f"open-{turn}")
        if labelled.isEmpty():
            break
        by_label = labelled.groupBy("block", "label").agg(F.count("*").alias("n"))
        largest = by_label.groupBy("block").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("size"))
        largest = largest.select("block", F.col("top.label").alias("largest"), F.col("top.n").alias("n"), "size")
        sent, held = largest.agg(F.sum((F.col("size") - F.col("n")) * F.ceil(F.col("size") / BLOCK)), F.sum("size")).first()
        if turn < ROUNDS and sent > REPEAT * held:
            # Too many rows to ask of all parts: let the parts' leaders join components first.
            leaders = labelled.groupBy("block", "part", "label").agg(F.min("member").alias("member"))
            sizes = leaders.groupBy("block").agg(F.count("*").alias("size"))
            leaders = leaders.drop("part").join(sizes, "block").select("block", part.alias("part"), F.col("member").alias("vertex"), "label", F.lit(None).cast("boolean").alias("asked"))
            found = search(leaders, f"leaders-{turn}")
            links = scratch.keep(links.union(found), f"links-{turn}")
            before, roots = roots, connected_components(links, scratch, f"roots-{turn}")
            if before.count() != roots.count() or before.exceptAll(roots).limit(1).count():
                continue
        # The members outside each block's largest component are asked of all parts.
        rest = labelled.join(largest.drop("n"), "block").where("label <> largest")
        wide = rest.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / BLOCK) - 1)).alias("part"), F.col("member").alias("vertex"), "label", F.lit(True).alias("asked"))
        all_rows = labelled.select("block", "part", F.col("member").alias("vertex"), "label", F.lit(False).alias("asked"))
        rest_rows = wide.join(all_rows.select("block", "part", "vertex"), ["block", "part", "vertex"], "left_anti")
        home = all_rows.join(rest.select("block", F.col("member").alias("vertex"), F.lit(True).alias("own")), ["block", "vertex"], "left").select("block", "part", "vertex", "label", F.coalesce("own", F.lit(False)).alias("asked"))
        found = search(home.union(rest_rows), f"rest-{turn}")
        roots = connected_components(scratch.keep(links.union(found), f"all-links-{turn}"), scratch, f"all-roots-{turn}")
        break

    # An id whose rows have different sets ties those sets together.
    named = rows.where("id is not null and n > 0").select("id", "h1", "h2")
    ties = named.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high")).where("low <> high")
    ties = scratch.keep(ties, "ties")
    vertices = sets.select("h1", "h2", "vertex")
    if not ties.isEmpty():
        lows = ties.select("id", F.col("low.h1").alias("h1"), F.col("low.h2").alias("h2")).join(vertices, ["h1", "h2"]).select("id", F.col("vertex").alias("b"))
        tied = named.join(lows, "id").join(vertices, ["h1", "h2"]).select(F.col("vertex").alias("a"), "b").distinct()
        roots = connected_components(roots.select(F.col("vertex").alias("a"), F.col("root").alias("b")).union(tied), scratch, "tied-roots")
    # Components of several sets: the least id of all their sets.
    joined = scratch.keep(roots.union(roots.select(F.col("root").alias("vertex"), "root")).distinct().join(sets.select("vertex", "least"), "vertex"), "joined")
    least = joined.groupBy("root").agg(F.min("least").alias("together"))
    components = sets.select("h1", "h2", "vertex", "least").join(joined.select("vertex", "root").join(least, "root").select("vertex", "together"), "vertex", "left")
    components = components.select("h1", "h2", F.coalesce("together", "least").alias("component"))
    out = rows.select("id", "n", "h1", "h2").join(components, ["h1", "h2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS sh FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.least AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS least FROM r GROUP BY a) m ON m.a = d.doc_id
"""
