"""Operator 3: secret scanning by patterns and a character convolutional network.

Patterns give the base findings.  Every candidate string (a long unbroken run
of key characters) is also scored with its surroundings by a small network:
character-class embedding, one convolution, maximum over places, a logistic
output.  It sees ``INSIDE`` characters at a time: a longer candidate is read in
overlapping pieces, and its score is the largest of theirs.  It is trained on
the driver on a bounded sample of labelled pieces: those that hold (a part of)
a base finding against those that no finding touches.  Each is also shown
without its surroundings, so that what a secret looks like is learnt apart from
the words that announce it, and secrets announced otherwise are found.  A
held-out part calibrates the score (Platt) and sets the threshold, the highest
at which the required share of its findings is still found.  Candidates over it that
no base finding touches are added as findings of kind ``model``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .storage import Scratch

KINDS = ("assign", "access", "hex", "model")
#: Fixed patterns of the base findings; positions are code points.
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

#: A candidate: a whole run of key characters at least this long.
LEAST_CANDIDATE = 16
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % LEAST_CANDIDATE)
BEFORE, INSIDE, AFTER = 20, 64, 12
WIDTH = BEFORE + INSIDE + AFTER
#: Steps between pieces of a candidate over ``INSIDE``; pieces scored at once.
STRIDE = 32
AT_ONCE = 8_192

#: Documents that the training sample's harmless pieces are drawn from (those with findings: all), and labelled pieces kept of each kind.
SAMPLE_DOCS = 20_000
SAMPLE_EACH = 1_500
RECALL = 0.98
EMBED, SPAN, FILTERS = 6, 5, 16

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base findings, by start, then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out


def scan(text: str | None) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base findings and candidates; hexadecimal runs lie inside candidates only."""
    if not text:
        return [], []
    spans = base_spans(text)
    candidates = [m.span() for m in CANDIDATE.finditer(text)]
    for start, end in candidates:
        if end - start >= LEAST_HEX:
            spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text, start, end)]
    return sorted(spans), candidates


def _classes() -> np.ndarray:
    """Class of each code point below 128: letters of either case by kind, digits, marks; 0 is padding."""
    table = np.full(129, 1, dtype=np.int64)
    groups = ["aeiou", "bcdf", "ghjklmn", "pqrstvwxyz", "AEIOU", "BCDF", "GHJKLMN", "PQRSTVWXYZ", "01234", "56789", " ", "\t\r\n", "=", ":", "\"'", "/", "_-", "+.", ",;()[]{}<>"]
    for k, chars in enumerate(groups):
        for c in chars:
            table[ord(c)] = k + 2
    table[128] = len(groups) + 2
    return table


_CLASS = _classes()
CLASSES = int(_CLASS.max()) + 1


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """Extents that cover a candidate, none over ``INSIDE``; neighbours overlap by half at least."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(at, at + INSIDE) for at in (*range(start, end - INSIDE, STRIDE), end - INSIDE)]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character classes of a piece of a candidate and its surroundings."""
    out = np.zeros(WIDTH, dtype=np.uint8)

    def put(at: int, part: str) -> None:
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out[at : at + len(codes)] = _CLASS[np.minimum(codes, 128)]

    before = text[max(0, start - BEFORE) : start]
    put(BEFORE - len(before), before)
    put(BEFORE, text[start:end])
    put(BEFORE + INSIDE, text[end : end + AFTER])
    return out


@dataclass
class Network:
    """Weights of the network, its calibration and its threshold."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    platt: tuple[float, float] = (1.0, 0.0)
    threshold: float = 1.0
    #: Shares of the held-out findings that are found, and of the other held-out pieces that are found too.
    recall: float = 0.0
    false_alarms: float = 0.0

    def _columns(self, codes: np.ndarray) -> np.ndarray:
        seen = self.embed[codes]
        return np.concatenate([seen[:, j : WIDTH - SPAN + 1 + j] for j in range(SPAN)], axis=2)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [np.maximum(self._columns(codes[i : i + 512]) @ self.kernel + self.bias, 0).max(axis=1) @ self.out for i in range(0, len(codes), 512)]
        return np.concatenate(parts) + self.shift if parts else np.empty(0)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.logits(codes) + b, -40, 40)))


def train(codes: np.ndarray, labels: np.ndarray, recall: float = RECALL, steps: int = 1_500, seed: int = 7) -> Network:
    """Fit by Adam on three quarters, with and without surroundings, calibrate and set the threshold on the rest.

    The threshold is the highest that keeps the recall, however low that is.
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (CLASSES, EMBED)), rng.normal(0, 0.3, (SPAN * EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, FILTERS), 0.0)
    order = rng.permutation(len(codes))
    # Every fourth of each kind is held out.
    held = np.concatenate([order[labels[order] == k][::4] for k in (0, 1)])
    fit = np.setdiff1d(order, held)
    bare = codes[fit].copy()
    bare[:, :BEFORE] = bare[:, BEFORE + INSIDE :] = 0
    codes, labels, fit = np.concatenate([codes, bare]), np.concatenate([labels, labels[fit]]), np.concatenate([fit, len(codes) + np.arange(len(fit))])
    state = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in ("embed", "kernel", "bias", "out")}
    step = 0
    while step < steps:
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            step += 1
            x, y = codes[at], labels[at].astype(float)
            columns = net._columns(x)
            hidden = columns @ net.kernel + net.bias
            best = hidden.argmax(axis=1)
            top = np.take_along_axis(hidden, best[:, None, :], axis=1)[:, 0, :]
            pooled = np.maximum(top, 0)
            gap = (1 / (1 + np.exp(-np.clip(pooled @ net.out + net.shift, -40, 40))) - y) / len(at)
            d_top = gap[:, None] * net.out * (top > 0)
            chosen = np.take_along_axis(columns[:, :, :, None], best[:, None, None, :], axis=1)[:, 0]
            grads = {"out": pooled.T @ gap, "bias": d_top.sum(axis=0), "kernel": np.einsum("nkf,nf->kf", chosen, d_top), "embed": np.zeros_like(net.embed)}
            back = np.einsum("kf,nf->nfk", net.kernel, d_top).reshape(len(at), FILTERS, SPAN, EMBED)
            for j in range(SPAN):
                np.add.at(grads["embed"], np.take_along_axis(x, best + j, axis=1), back[:, :, j])
            for n, g in grads.items():
                m, v = state[n]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                setattr(net, n, getattr(net, n) - 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
            net.shift -= 0.01 * gap.sum()
    logits, y = net.logits(codes[held]), labels[held].astype(float)
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -40, 40)))
        a, b = a - 0.1 * float(((p - y) * logits).mean()), b - 0.1 * float((p - y).mean())
    net.platt = (max(a, 1e-3), b)
    found = np.sort(net.probabilities(codes[held][y == 1]))
    net.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 1.0
    over = net.probabilities(codes[held]) >= net.threshold
    net.recall, net.false_alarms = float(over[y == 1].mean()) if len(found) else 0.0, float(over[y == 0].mean()) if (y == 0).any() else 0.0
    return net


def labelled_pieces(text: str | None, harmless: bool = True) -> Iterator[tuple[bool, bytes]]:
    """(label, codes) of the pieces of every candidate; without ``harmless`` of those with findings only.

    A piece that a finding only reaches into, by less than its first
    ``LEAST_CANDIDATE`` characters, is neither.
    """
    spans, candidates = scan(text)
    if not spans and not harmless:
        return
    for start, end in candidates:
        near = [(s, e) for s, _, e in spans if s < end and start < e]
        for s, e in pieces(start, end):
            shares = [(min(e, y) - max(s, x), min(y - x, min(y, end) - max(x, start), LEAST_CANDIDATE)) for x, y in near]
            label = any(share >= least for share, least in shares)
            if label or harmless and not any(share > 0 for share, _ in shares):
                yield label, encode(text, s, e).tobytes()


def _labelled(each: int):
    """(label, key, code bytes): of each label the ``each`` pieces of the least keys.

    Pieces with findings are taken from all rows, others from the rows marked
    as sampled.
    """

    def least(codes: dict[bytes, int]) -> dict[bytes, int]:
        return dict(sorted(codes.items(), key=lambda x: (x[1], x[0]))[:each])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bool, dict[bytes, int]] = {False: {}, True: {}}
        for batch in batches:
            for sampled, text in zip(batch.column("sampled").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for label, code in labelled_pieces(text, sampled):
                    kept[label][code] = xxhash.xxh64_intdigest(code) >> 1
                    if len(kept[label]) > 4 * each:
                        kept[label] = least(kept[label])
        for label, codes in kept.items():
            codes = least(codes)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(codes), pa.bool_()), pa.array(list(codes.values()), pa.int64()), pa.array(list(codes), pa.binary())], names=["label", "key", "codes"])

    return rows


def fit_network(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_each: int = SAMPLE_EACH, recall: float = RECALL) -> Network | None:
    """Train on labelled pieces of candidates, ``sample_each`` of each label at most.

    Those with findings are drawn from all documents, the others from about
    ``sample_docs`` documents.  None if the documents have no 8 different ones
    of each label.
    """
    share = min(1.0, sample_docs / max(1, docs.count()))
    sampled = F.xxhash64(F.col(id_col), F.col(text_col)) <= F.lit(share * 2.0**64 - 2.0**63)
    texts = docs.select(sampled.alias("sampled"), F.col(text_col).cast("string").alias("text"))
    labelled = Scratch(docs.sparkSession, "secret-sample").keep(texts.mapInArrow(_labelled(sample_each), "label boolean, key long, codes binary"), "labelled").distinct()
    # The keys up to which each label has enough pieces, to a step of the histogram.
    step = F.shiftright("key", 50)
    counts = labelled.groupBy("label", step.alias("step")).agg(F.count("*").alias("n")).collect()
    parts = []
    for k in (False, True):
        total, last = 0, -1
        for r in sorted((r for r in counts if r["label"] == k), key=lambda r: r["step"]):
            if total < sample_each:
                total, last = total + r["n"], r["step"]
        drawn = labelled.where((F.col("label") == F.lit(k)) & (step <= last)).collect()
        parts.append(sorted(drawn, key=lambda r: (r["key"], r["codes"]))[:sample_each])
    if not all(len(p) >= 8 for p in parts):
        return None
    rows = parts[0] + parts[1]
    return train(np.stack([np.frombuffer(r["codes"], dtype=np.uint8) for r in rows]).astype(np.int64), np.array([r["label"] for r in rows], dtype=np.int64), recall)


def _scanned(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network | None = shared.value
        for batch in batches:
            found: list[list[Span]] = []
            asked, codes, score = [], [], {}

            def flush(codes=codes, asked=asked, score=score):
                if codes:
                    for candidate, p in zip(asked, net.probabilities(np.stack(codes)).tolist(), strict=True):
                        score[candidate] = max(p, score.get(candidate, 0.0))
                codes.clear()
                asked.clear()

            for row, text in enumerate(batch.column("text").to_pylist()):
                spans, candidates = scan(text)
                found.append(spans)
                for start, end in candidates if net else ():
                    for s, e in pieces(start, end):
                        asked.append((row, start, end))
                        codes.append(encode(text, s, e))
                        if len(codes) == AT_ONCE:
                            flush()
            flush()
            for (row, start, end), p in score.items():
                if p >= net.threshold and not any(s < end and start < e for s, _, e in found[row]):
                    found[row].append((start, 3, end))
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(row)] for row in found]
            span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(spans, span)], names=[*batch.schema.names, "spans"])

    return rows


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_cols: list[str] | None = None, network: Network | None = None, fit: bool = True, **bounds) -> DataFrame:
    """Find secrets in every whole text.

    Returns one row per input row: ``row`` (a struct of ``keep_cols``, or of
    the id), ``text``, ``modelled`` (whether a network took part) and
    ``spans``, the findings (kind, start, end; code
    points, end exclusive) by start, then kind: ``assign``, ``access`` and
    ``hex`` by pattern, ``model`` by the network alone.  Findings of different
    patterns may overlap.  ``network`` is used if given, else one is fitted;
    with ``fit=False``, or where a corpus has too few findings to learn from,
    the patterns stand alone.

    Null and empty texts have no findings; ids may be null or repeated; other
    columns are carried or ignored; an empty table gives an empty result.
    """
    if network is None and fit:
        network = fit_network(docs, id_col, text_col, **bounds)
    carried = F.struct(*(F.col(f"`{c}`") for c in (keep_cols or [id_col]))).alias("row")
    rows = docs.select(carried, F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("modelled", F.lit(network is not None))
    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([*rows.schema.fields, StructField("spans", ArrayType(span))])
    return rows.mapInArrow(_scanned(docs.sparkSession.sparkContext.broadcast(network)), schema)
