"""Operator 8: WARC archives, written and read back by verified record chains.

Archives are written by Spark's own text writer, plain, so that they can be
split: a record is one row, the two line ends after it are the line separator,
and any store Spark writes to will do.  Of equal payloads the one with the
least id is a response record, the others revisit it.  Which payloads are
equal is settled on narrow rows; a filter of fixed size then tells the pages
whose payload may occur again, and only those are shuffled.

Reading: Spark splits archives by byte ranges and lines end where a record's
magic bytes do, so each task meets the places of its range where a record
could start.  It emits every such candidate with its successor, the place
after its declared length.  Within a range the pointers are jumped in memory,
over ranges by joins of the offsets alone, from each file's start on; only
candidates that are reached are records.  Magic bytes inside a payload are
not, unless a record ends right before them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bitfilter import filter_bits
from .storage import Scratch

MAGIC = b"WARC/1.0\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"
#: Records of one archive at most.
FILE_RECORDS = 50_000
#: Bits of the broadcast filter of payloads that occur again (2 MB, whatever the input).
FILTER_BITS = 1 << 24
#: Rounds of pointer jumping over ranges: files of 2**40 ranges at most.
ROUNDS = 40


def digest_of(body: bytes) -> str:
    """Bare upper-case base-32 SHA-1."""
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def _bit(digest: str) -> int:
    return int.from_bytes(base64.b32decode(digest)[:4], "little") % FILTER_BITS


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = batch.column("body").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(digest_of, bodies), pa.string()), pa.array(map(len, bodies), pa.int64())], names=["id", "digest", "bytes"])


def _marked(bits: np.ndarray):
    """Rows with their digest and whether their payload may occur again."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            digests = [digest_of(b) for b in bodies]
            again = [bool(bits[_bit(d) >> 3] >> (_bit(d) & 7) & 1) for d in digests]
            more = [pa.array(digests, pa.string()), pa.array(map(len, bodies), pa.int64()), pa.array(again, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "digest", "bytes", "again"])

    return rows


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct bytes of the filter that digests set, as (place, byte)."""
    for batch in batches:
        at = np.unique(np.array([_bit(d) for d in batch.column("digest").to_pylist()], dtype=np.int64))
        place, first = np.unique(at >> 3, return_index=True)
        values = np.bitwise_or.reduceat(np.left_shift(1, at & 7), first) if len(at) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(values.astype(np.int64))], names=["place", "byte"])


def plan_records(pages: DataFrame, id_col: str, url_col: str, body_col: str, least_bytes: int) -> DataFrame:
    """(id, url, body, digest, bytes, type, refers_to) of each row."""
    scratch = Scratch(pages.sparkSession, "warc-plan")
    body = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    id_type = rows.schema["id"].dataType.simpleString()
    narrow = scratch.keep(rows.select("id", "body").mapInArrow(_narrow, f"id {id_type}, digest string, bytes long"), "narrow").where(F.col("bytes") >= least_bytes)
    groups = narrow.groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # How often the first one's row is repeated: only one of them is the response.
    heads = narrow.withColumnRenamed("id", "first").join(groups, ["digest", "bytes", "first"]).groupBy("digest", "bytes", "first").agg(F.count("*").alias("heads"))
    groups = scratch.keep(groups.join(heads, ["digest", "bytes", "first"], "left"), "groups")
    bits = filter_bits(groups.select("digest").mapInArrow(_places, "place long, byte long"), FILTER_BITS)
    marked = rows.mapInArrow(_marked(bits), f"id {id_type}, url string, body binary, digest string, bytes long, again boolean")
    columns = lambda kind: ["id", "url", "body", "digest", "bytes", kind.alias("type"), F.when(kind == "revisit", F.col("first")).alias("refers_to")]
    alone = marked.where("not again").withColumn("first", F.lit(None).cast(id_type)).select(*columns(F.lit("response")))
    grouped = marked.where("again").join(groups, ["digest", "bytes"], "left")
    head = F.col("first").isNull() | F.coalesce(F.col("id") == F.col("first"), F.lit(False))
    out = alone.unionByName(grouped.where(~head | F.col("heads").isNull() | (F.col("heads") == 1)).select(*columns(F.when(head, "response").otherwise("revisit"))))
    if not groups.where("heads > 1").isEmpty():
        among = Window.partitionBy("digest", "bytes").orderBy("url")
        repeated = grouped.where(head & (F.col("heads") > 1)).withColumn("place", F.row_number().over(among))
        out = out.unionByName(repeated.select(*columns(F.when(F.col("place") == 1, "response").otherwise("revisit"))))
    return out


def record_text() -> F.Column:
    """A planned row as one record without its closing line ends."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(F.col(c).cast("string")), F.lit("")), F.lit(">"))
    safe_url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    response = F.col("type") == "response"
    block = F.concat(F.lit(HTTP), F.when(response, F.col("body").cast("string")).otherwise(F.lit("")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.col("type")),
        line("WARC-Record-ID", urn("id")),
        F.coalesce(line("WARC-Target-URI", safe_url), F.lit("")),
        line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(response, F.lit("")).otherwise(
            F.concat(line("WARC-Refers-To", urn("refers_to")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), line("X-Payload-Length", F.col("bytes").cast("string")))
        ),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> None:
    """Write one record per row into plain archives of ``FILE_RECORDS`` records at most."""
    records = plan_records(pages, id_col, url_col, body_col, least_bytes).select(record_text().alias("value"))
    records.write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")
#: What a candidate is read to: its place in the range, its successor, and the record it would be.
_FIELDS = {"file": pa.string(), "block": pa.int64(), "at": pa.int64(), "next": pa.int64(), "total": pa.int64(), "whole": pa.bool_(), "page_id": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "sound": pa.bool_(), "payload": pa.binary()}
_SCHEMA = "file string, block long, at long, next long, total long, whole boolean, page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, sound boolean, payload binary"


def _id_of(urn: bytes | None) -> str | None:
    return unquote_plus((urn or b"").decode().removeprefix("<urn:page:").removesuffix(">")) or None


def parsed(record: bytes, head: int, payloads: bool) -> dict:
    """The fields of a record without its magic bytes, whose header ends at ``head``."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in record[:head].split(b"\r\n"))}
    kind, block = fields.get(b"warc-type", b"").decode("utf-8", "replace"), record[head + 4 :]
    body = block.partition(b"\r\n\r\n")[2] if b"application/http" in fields.get(b"content-type", b"") else block
    digest, claimed = digest_of(body), fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
    response = kind == "response"
    length = fields.get(b"x-payload-length", b"")
    return {
        "page_id": _id_of(fields.get(b"warc-record-id")),
        "url": (fields.get(b"warc-target-uri") or b"").decode("utf-8", "replace") or None,
        "payload_bytes": len(body) if response else int(length) if length.isdigit() else 0,
        "payload_digest": digest if response else claimed,
        "record_type": kind,
        "refers_to": _id_of(fields.get(b"warc-refers-to")) if kind == "revisit" else None,
        "sound": not response or claimed in ("", digest),
        "payload": body if response and payloads else None,
    }


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _FIELDS.items()], names=list(_FIELDS))


def _candidates(payloads: bool):
    """Lines of byte ranges to candidates, and one row a range with the bytes of its lines."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, out = None, 0, []
        waiting: list[tuple[dict, list[bytes], int, int, int]] = []

        def close() -> None:
            # What goes on beyond the range is read whole later, if it is reached.
            out.extend(row | {"whole": False} for row, *_ in waiting)
            waiting.clear()
            if now is not None:
                out.append({"file": now[0], "block": now[1], "total": at})

        for batch in batches:
            for value, file, block in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block")), strict=True):
                if (file, block) != now:
                    close()
                    now, at = (file, block), 0
                first = at == 0 and block == 0
                still = []
                for row, parts, have, head, need in waiting:
                    parts += (MAGIC, value)
                    have += len(MAGIC) + len(value)
                    if have >= need:
                        out.append(row | {"whole": True} | parsed(b"".join(parts)[:need], head, payloads))
                    else:
                        still.append((row, parts, have, head, need))
                waiting = still
                head = -1 if first else value.find(b"\r\n\r\n")
                length = _LENGTH.search(value, 0, head + 1) if head >= 0 else None
                if length:
                    need = head + 4 + int(length[1])
                    row = {"file": file, "block": block, "at": at - len(MAGIC), "next": at + need + len(END)}
                    if len(value) >= need:
                        out.append(row | {"whole": True} | parsed(value[:need], head, payloads))
                    else:
                        waiting.append((row, [value], len(value), head, need))
                at += len(value) + len(MAGIC)
            yield _batch(out)
            out = []
        close()
        yield _batch(out)

    return rows


def reached(at: np.ndarray, successor: np.ndarray, entry: int) -> np.ndarray:
    """Which of the sorted candidates a chain from ``entry`` meets, by pointer jumping."""
    n = len(at)
    jump = np.searchsorted(at, successor)
    # The last place is where every chain that meets no candidate of the range ends.
    jump[(jump == n) | (at[np.minimum(jump, n - 1)] != successor)] = n
    jump = np.append(jump, n)
    seen = np.zeros(n + 1, dtype=bool)
    first = int(np.searchsorted(at, entry))
    seen[first if first < n and at[first] == entry else n] = True
    for _ in range(n.bit_length()):
        seen[jump[seen]] = True
        jump = jump[jump]
    return seen[:n]


def exits(at: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Where each candidate's chain leaves the range."""
    n = len(at)
    jump = np.searchsorted(at, successor)
    inside = (jump < n) & (at[np.minimum(jump, n - 1)] == successor)
    jump = np.where(inside, jump, np.arange(n))
    for _ in range(n.bit_length()):
        jump = jump[jump]
    return successor[jump]


def _links(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, places, successors) of each range, sorted, in bytes of its file."""
    for i, (base, links) in enumerate(zip(batch.column("base").to_pylist(), batch.column("links").to_pylist(), strict=True)):
        pairs = np.array([(x["at"], x["next"]) for x in links], dtype=np.int64).reshape(-1, 2) + base
        yield i, pairs[:, 0], pairs[:, 1]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, at, next): each candidate with the place where its chain leaves the range."""
    for batch in batches:
        for i, at, successor in _links(batch):
            file, block = batch.column("file")[i], batch.column("block")[i]
            yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(at), pa.string()), pa.array([block.as_py()] * len(at), pa.int64()), pa.array(at), pa.array(exits(at, successor))], names=["file", "block", "at", "next"])


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, at, base) of the candidates that the chain from the range's entry meets; places within the range."""
    for batch in batches:
        entries = batch.column("entry").to_pylist()
        for i, at, successor in _links(batch):
            file, block, base = (batch.column(c)[i].as_py() for c in ("file", "block", "base"))
            met = at[reached(at, successor, entries[i])] - base
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(met), pa.string()), pa.array([block] * len(met), pa.int64()), pa.array(met), pa.array([base] * len(met), pa.int64())], names=["file", "block", "at", "base"])


def _chained(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, block, at, base) of the candidates that can be reached from their file's start."""
    base = F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    totals = found.where("total is not null").select("file", "block", "total")
    bases = totals.select("file", "block", base, F.count("*").over(Window.partitionBy("file")).alias("ranges"))
    links = found.where("total is null").groupBy("file", "block").agg(F.sort_array(F.collect_list(F.struct("at", "next"))).alias("links"))
    ranges = scratch.keep(links.join(bases, ["file", "block"]), "ranges")
    entries = ranges.select("file", "block").where("block = 0").withColumn("entry", F.lit(0).cast("long"))
    several = ranges.where("ranges > 1")
    if not several.isEmpty():
        # Chains that go over several ranges: jump from range to range, twice as far each round.
        jumps = scratch.keep(several.select("file", "block", "base", "links").mapInArrow(_contracted, "file string, block long, at long, next long"), "jumps-0")
        places = jumps.select("file", "block", "at")
        met = scratch.keep(places.where("at = 0"), "met-0")
        for turn in range(1, ROUNDS + 1):
            ahead = met.select("file", "at").join(jumps.select("file", "at", "next"), ["file", "at"]).select("file", F.col("next").alias("at"))
            more = scratch.keep(met.union(places.join(ahead, ["file", "at"]).select("file", "block", "at")).distinct(), f"met-{turn}")
            if more.count() == met.count():
                break
            met, far = more, jumps.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
            jumps = scratch.keep(jumps.join(far, ["file", "next"], "left").select("file", "block", "at", F.coalesce("far", "next").alias("next")), f"jumps-{turn}")
        else:
            raise RuntimeError(f"record chains did not end in {ROUNDS} rounds")
        entries = entries.join(several.select("file").distinct(), "file", "left_anti").unionByName(met.select("file", "block", F.col("at").alias("entry")))
    return ranges.join(entries, ["file", "block"]).select("file", "block", "base", "links", "entry").mapInArrow(_followed, "file string, block long, at long, base long")


def _assembled(payloads: bool):
    """The lines of each record that goes over ranges, in order, to the record."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for need, lines in zip(batch.column("need").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                record = MAGIC.join(x["value"] for x in lines)
                if len(record) >= need:  # else the file ends before the record does
                    out.append({"whole": True} | parsed(record[:need], record.find(b"\r\n\r\n"), payloads))
            yield _batch(out)

    return rows


def _places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their places in the range."""
    now, at = None, 0
    for batch in batches:
        places = []
        for size, file, block in zip(batch.column("size").to_pylist(), batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if (file, block) != now:
                now, at = (file, block), 0
            places.append(at)
            at += size + len(MAGIC)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("value", "file", "block")), pa.array(places, pa.int64())], names=["value", "file", "block", "at"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic bytes, with its file and byte range, in order."""
    text = spark.read.option("pathGlobFilter", "*.{gz,warc,txt}").option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives under ``path`` (plain, read in byte ranges, or gzipped, a stream each).

    Returns ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``,
    ``record_type``, ``refers_to`` and, unless left out, ``payload``.  A file
    that doesn't start with a record has none; bytes that no chain of records
    reaches are ignored; a record that is cut off is none.  A payload that
    doesn't match its record's digest is an error.
    """
    scratch = Scratch(spark, "warc-read")
    lines = _lines(spark, path)
    found = scratch.keep(lines.mapInArrow(_candidates(payloads), _SCHEMA), "candidates")
    chain = scratch.keep(_chained(found, scratch), "chain")
    records = found.where("total is null").join(chain, ["file", "block", "at"])
    whole, cut = records.where("whole"), records.where("not whole")
    if not cut.isEmpty():
        # Records over several ranges: their lines are brought together.
        bases = found.where("total is not null").select("file", "block", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        start = (F.col("base") + F.col("at") + len(MAGIC)).alias("start")
        wanted = scratch.keep(cut.select("file", start, (F.col("next") - F.col("at") - len(MAGIC) - len(END)).alias("need")), "wanted")
        sized = lines.select("value", F.octet_length("value").alias("size"), "file", "block").mapInArrow(_places_of, "value binary, file string, block long, at long")
        placed = sized.join(bases, ["file", "block"]).select("value", "file", (F.col("base") + F.col("at")).alias("place"))
        held = placed.join(wanted, "file").where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("need")))
        joined = held.groupBy("file", "start", "need").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("lines"))
        whole = whole.select(*_FIELDS).unionByName(joined.mapInArrow(_assembled(payloads), _SCHEMA))
    fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]
    sound = F.when(F.col("sound"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a payload does not match its digest: record "), F.coalesce("page_id", F.lit("without id")))))
    return whole.withColumn("payload_digest", sound).select(*fields)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all rows as WARC records into the shared folder and read them back.

    Returns one row per input row with the columns of ``read_warc`` without
    payloads; ids come back in the type they had.  A null body is an empty
    payload; empty payloads are equal to each other; rows without id are
    written and come back without id; of repeated rows one is the response;
    other columns are ignored; an empty table gives an empty result.  Payloads
    under ``least_bytes`` are all responses.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write_warc(pages, scratch.path("archives"), id_col, url_col, body_col, least_bytes)
    id_type = pages.schema[id_col].dataType
    back = read_warc(spark, scratch.path("archives"), payloads=False)
    return back.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS hex, min(page_id) OVER (PARTITION BY t) AS first FROM p),
n AS (SELECT page_id, unnest(range(4)) AS k, hex FROM h),
q AS (SELECT page_id, k, ('0x' || substr(hex, 1 + 10 * k, 10))::BIGINT AS v FROM n),
c AS (SELECT page_id, 8 * k + j AS pos, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> (35 - 5 * j)) & 31)::INT, 1) AS c FROM q, (SELECT unnest(range(8)) AS j)),
d AS (SELECT page_id, string_agg(c, '' ORDER BY pos) AS payload_digest FROM c GROUP BY page_id)
SELECT h.page_id, payload_bytes, payload_digest, CASE WHEN h.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN h.page_id = first THEN NULL ELSE first END AS refers_to
FROM h JOIN d ON h.page_id = d.page_id
"""
