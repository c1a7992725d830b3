"""Operator 10: packing token pieces into sequences by a configuration program.

Only the histogram of piece lengths (at most ``capacity`` counts, whatever the
corpus) reaches the driver.  The covering program "fewest sequences whose
configurations cover every length's count" is solved by multiplicative
weights: each length has a weight that falls by a factor as its pieces are
covered, and one dynamic program over the capacity prices, for every length at
once, the configuration of the largest total weight that holds it.  Those that
fill a sequence exactly (or, once there are none, nearly) are taken up, each by
at most a share of its scarcest length, so that lengths run out together.  Amounts are rounded down to whole
sequences; what is left over at the end, a few hundredths, is repaired by best
fit.  Any weights bound the program's value from below; the best bound met is
reported with the plan.

The plan is a list of configurations with multiplicities.  Each piece finds
its own place in it from its rank among the pieces of its length; ranks are
made of per-bucket counts, so no task holds a whole length class.  Pieces that
fill a sequence alone need no rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch
from .tokens import tokenizer

CAPACITY = 2048
#: Pricing rounds at most, and the share of a length that one configuration of a round may cover.
ROUNDS = 400
STEP = 0.25
#: Share of a sequence that the program's configurations may leave empty; what needs more is left to repair.
SLACK = 1 / 16
#: How fast the weight of a covered length falls.
RATE = 0.1
#: Hash buckets that a length's pieces are ranked in; bounds the broadcast table of counts to this many rows a length.
BUCKETS = 256


@dataclass(frozen=True)
class Group:
    """``count`` sequences that all hold ``parts``: ((length, pieces of it), ...)."""

    parts: tuple[tuple[int, int], ...]
    count: int


@dataclass(frozen=True)
class Plan:
    """Groups of sequences; how many of them the program and the repair laid, and what no packing can go below."""

    groups: list[Group]
    by_program: int
    by_repair: int
    bound: float


def price(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming, repeats allowed: for each room the largest total weight and the length to take first (-1: leave one place empty)."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, dtype=np.int64)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        best[room] = best[room - 1]
        gains = best[room - lengths[: ends[room]]] + weights[: ends[room]]
        k = int(gains.argmax())
        if gains[k] > best[room]:
            best[room], choice[room] = gains[k], k
    return best, choice


def configuration(lengths: np.ndarray, choice: np.ndarray, room: int) -> Counter:
    """The priced configuration of a room: how often it takes each length, by the length's place."""
    taken: Counter = Counter()
    while room > 0:
        k = int(choice[room])
        if k < 0:
            room -= 1
        else:
            taken[k] += 1
            room -= int(lengths[k])
    return taken


def cover(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> tuple[list[Group], dict[int, int], float]:
    """(sequences laid by the program, counts left for repair, lower bound of the program's value)."""
    lengths = np.array(sorted(counts), dtype=np.int64)
    total = np.array([counts[n] for n in lengths.tolist()], dtype=np.int64)
    left = total.copy()
    # At equal cover a length weighs as much as the room it takes, long ones a little more: short ones can wait.
    weights = lengths / capacity * np.exp(RATE * lengths / capacity)
    laid, bound, slack = Counter(), 0.0, 0
    for _ in range(rounds):
        open_ = np.flatnonzero(left)
        if not len(open_):
            break
        here, own = lengths[open_], weights[open_]
        best, choice = price(here, own, capacity)
        if len(open_) == len(lengths):
            # No configuration weighs more than the best one, so each sequence covers at most that much.
            bound = max(bound, float((total * weights).sum() / best[capacity]))
        before = left.copy()
        for k in np.argsort(-(own + best[capacity - here]), kind="stable").tolist():
            if not left[open_[k]]:
                continue
            parts = configuration(here, choice, capacity - int(here[k]))
            parts[k] += 1
            at, of = open_[list(parts)], np.array(list(parts.values()))
            if (lengths[at] * of).sum() < capacity - slack:
                continue
            amount = min(int((left[at] // of).min()), max(1, int((STEP * total[at] / of).min())))
            if amount:
                left[at] -= amount * of
                laid[tuple(sorted(zip(lengths[at].tolist(), of.tolist(), strict=True), reverse=True))] += amount
        if (before == left).all():
            slack = 2 * slack + 1
            if slack > SLACK * capacity:
                break
        # The lengths' weights fall with what was covered; all are scaled alike to keep their sum.
        fall = np.exp(-RATE * lengths / capacity * ((before - left) / total))
        weights = weights * fall * (weights.sum() / (weights * fall).sum())
    return [Group(parts, n) for parts, n in laid.items()], {int(n): int(c) for n, c in zip(lengths, left, strict=True) if c}, bound


def best_fit(counts: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing on a histogram; equal sequences are handled together."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[Counter, int]]] = {}
    closed: list[tuple[Counter, int]] = []

    def put(room: int, parts: Counter, count: int) -> None:
        if count <= 0:
            return
        if room == 0:
            closed.append((parts, count))
            return
        if not groups.get(room):
            insort(rooms, room)
            groups[room] = []
        groups[room].append((parts, count))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                parts, count = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room, parts, count = capacity, Counter(), n
            each = room // length
            full = min(count, n // each)
            put(room - each * length, parts + Counter({length: each}), full)
            n -= full * each
            used = full
            if n and n < each and used < count:
                put(room - n * length, parts + Counter({length: n}), 1)
                n, used = 0, used + 1
            if parts:
                put(room, parts, count - used)
    closed += [x for held in groups.values() for x in held]
    return [Group(tuple(sorted(parts.items(), reverse=True)), count) for parts, count in closed]


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Sequences that hold every piece of the histogram exactly once."""
    counts = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("piece lengths must be from 1 to the capacity")
    if not counts:
        return Plan([], 0, 0, 0.0)
    program, left, bound = cover(counts, capacity, rounds)
    repair = best_fit(left, capacity)
    sizes = sum(n * c for n, c in counts.items()) / capacity
    return Plan(program + repair, sum(g.count for g in program), sum(g.count for g in repair), max(bound, sizes))


def segments(groups: list[Group]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, pieces in a sequence, first sequence, offset), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for group in groups:
        offset = 0
        for length, each in group.parts:
            out.setdefault(length, []).append((ranks[length], each, sequence, offset))
            ranks[length] += each * group.count
            offset += each * length
        sequence += group.count
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def _pieces(path: str, capacity: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).ids
        for batch in batches:
            ids, number, starts, lengths, sums, texts = [], [], [], [], [], batch.column("text").to_pylist()
            for doc, text in enumerate(texts):
                packed = encode(text or "") + b"\0\0\0\0"
                for piece, start in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[start : start + 4 * capacity]
                    ids.append(doc)
                    number.append(piece)
                    starts.append(start // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(ids, pa.int32())), *(pa.array(x, pa.int64()) for x in (number, starts, lengths, sums))],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    return rows


def _placed(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                pick, rows_of = np.flatnonzero(length == n), table[n]
                row = rows_of[np.searchsorted(rows_of[:, 0], rank[pick], side="right") - 1]
                within = rank[pick] - row[:, 0]
                sequence[pick] = row[:, 2] + within // row[:, 1]
                offset[pick] = row[:, 3] + within % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Tokenize, cut into pieces of ``capacity`` at most and pack the pieces.

    A document is its token ids and a closing id 0.  Returns one row per piece:
    ``id_col``, ``piece`` (from 0), ``start`` (ids of the document before it),
    ``length``, ``ids_crc32`` (of the packed little-endian 32-bit ids),
    ``sequence_id`` and ``offset``.  Within a sequence the pieces leave no gap.

    Null and empty texts are the closing id alone; ids may be null and rows may
    repeat (each is packed); other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    columns = f"id {id_type}, piece long, start long, length long, ids_crc32 long"
    pieces = scratch.keep(texts.mapInArrow(_pieces(tokenizer_path, capacity), columns), "pieces")
    bucket = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(BUCKETS))
    # Pieces of a whole sequence are alone in it: any number does that no planned sequence has.
    alone = pieces.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pieces = pieces.where(F.col("length") < capacity).withColumn("bucket", bucket)
    # Per length and bucket, how many pieces lie before: the plan needs one rank per piece.
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = scratch.keep(counts, "counts")
    groups = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity, rounds).groups
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own)).join(counts, ["length", "bucket"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    placed = ranked.mapInArrow(_placed(spark.sparkContext.broadcast(segments(groups))), columns + ", sequence_id long, offset long")
    return placed.unionByName(alone).withColumnRenamed("id", id_col)
