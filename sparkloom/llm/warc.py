"""WARC archives, index first.

Writing: each task writes its records, every one a gzip member of its own, to new files in the shared folder and
returns an index row per record: archive, offset, length, URL, digest, kind. The index is a table of its own; files
of lost or repeated attempts are in no index and are never read.

Reading: the index is filtered to the records that are wanted, sorted by archive and offset, and neighbouring byte
ranges are read at once (gaps up to `gap` bytes, reads up to `most` bytes). Each payload's SHA-1 is checked.

Of records with equal payloads of at least `min_bytes` bytes, the one with the largest id is a response and the
others are revisits of it, without payload but with the HTTP header of the whole; smaller payloads are all responses.

Cases: a null payload counts as empty; a null URL leaves its header out, line breaks in a URL are escaped; null ids
are below all others and, where a payload has only such, all its records are responses; repeated rows of the
largest id are all responses; an empty table gives an empty index. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, salted_lookup, stored

INDEX = "archive string, offset long, length long, url string, digest string, record_type string, page_id long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
NAME = "urn:sparkloom:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The tables hold no time of capture.
DATE = "1970-01-01T00:00:00Z"


def base32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def _name(i: int | None) -> str:
    return f"<{NAME}{'null' if i is None else i}>"


def _id(name: str) -> int | None:
    tail = name.strip("<>").removeprefix(NAME)
    return None if tail == "null" else int(tail)


def _url(u: str) -> str:
    return u.replace("\r", "%0D").replace("\n", "%0A")


def record(i: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, refers_url: str | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(i)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_url(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers)}", f"WARC-Refers-To-Date: {DATE}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_url(refers_url)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_record(data: bytes) -> dict:
    """What a record says: its headers, the HTTP content length, and the payload (None for a revisit)."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = h["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload doesn't match its digest")
    return {
        "page_id": _id(h["WARC-Record-ID"]),
        "url": h.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": h["WARC-Type"],
        "refers_to": _id(h["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def with_kinds(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """_id, _url, _payload, _sha1 (hex), and _leader, _leader_url of records that revisit another."""
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(payload_col), F.lit("")).alias("_payload"))
    rows = rows.withColumn("_sha1", F.sha1(F.encode("_payload", "UTF-8")))
    many = rows.where(F.octet_length("_payload") >= min_bytes).groupBy("_sha1").agg(F.max(F.struct("_id", "_url")).alias("m"), F.count("*").alias("n")).where("n > 1")
    leaders = stored(many.select("_sha1", F.col("m._id").alias("_leader"), F.col("m._url").alias("_leader_url")), "leaders")
    few = leaders.count() <= 100_000
    joined = rows.join(F.broadcast(leaders), "_sha1", "left") if few else salted_lookup(rows, leaders, "_sha1", F.col("_id"))
    own = F.col("_leader").isNull() | F.col("_id").eqNullSafe(F.col("_leader"))
    return joined.withColumns({"_leader_url": F.when(~own, F.col("_leader_url")), "_leader": F.when(~own, F.col("_leader"))})


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, archive_bytes: int = 256 << 20) -> DataFrame:
    """Archives of at most about archive_bytes below root (a URI that driver and executors share); returns their index, stored."""

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        sink, archive, at = None, "", 0
        try:
            for b in batches:
                rows: list[tuple] = []
                for r in b.to_pylist():
                    if sink is None or at >= archive_bytes:
                        if sink is not None:
                            sink.close()
                        archive, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        sink = store.open_output_stream(f"{folder}/{archive}", compression=None)
                    digest = base32(r["_sha1"])
                    revisit = r["_leader"] is not None
                    data = record(r["_id"], r["_url"], r["_payload"].encode(), digest, r["_leader"], r["_leader_url"], revisit)
                    sink.write(data)
                    rows.append((archive, at, len(data), r["_url"], digest, "revisit" if revisit else "response", r["_id"]))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, _INDEX_TYPES)], names=_INDEX_NAMES)
        finally:
            # index rows count only once the task has ended, so after this
            if sink is not None:
                sink.close()

    kinds = with_kinds(pages, id_col, url_col, payload_col, min_bytes)
    return stored(kinds.select("_id", "_url", "_payload", "_sha1", "_leader", "_leader_url").mapInArrow(archived, INDEX), "warc-index")


_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_INDEX_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in INDEX.split(", ")]
_RECORD_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_RECORD_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in RECORD.split(", ")]


def ranges(spans: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int]]:
    """(start, end, number of spans) of the reads that cover sorted (offset, length) spans."""
    out: list[list[int]] = []
    for offset, length in spans:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], offset + length)
            out[-1][2] += 1
        else:
            out.append([offset, offset + length, 1])
    return [tuple(x) for x in out]


def read(index: DataFrame, root: str, payloads: bool = True, gap: int = 64 << 10, most: int = 8 << 20, task_bytes: int = 16 << 20) -> DataFrame:
    """The records that `index` (all of write()'s rows, or some) points to. Each task reads about task_bytes of archives:
    the number of tasks goes by the records' lengths, not by the size of the index."""
    names = _RECORD_NAMES if payloads else _RECORD_NAMES[:-1]
    types = _RECORD_TYPES[: len(names)]

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        for b in batches:
            rows = b.to_pylist()
            at = 0
            while at < len(rows):
                archive = rows[at]["archive"]
                to = at
                while to < len(rows) and rows[to]["archive"] == archive:
                    to += 1
                own = rows[at:to]
                at = to
                with store.open_input_file(f"{folder}/{archive}") as f:
                    k = 0
                    for start, end, n in ranges([(r["offset"], r["length"]) for r in own], gap, most):
                        data = f.read_at(end - start, start)
                        found = [parse_record(data[r["offset"] - start : r["offset"] - start + r["length"]]) for r in own[k : k + n]]
                        k += n
                        for x in found:
                            if x["payload"] is not None:
                                x["payload"] = x["payload"].decode()
                        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in zip(names, types)], names=names)

    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // task_bytes))
    dealt = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(fetched, RECORD if payloads else RECORD.rsplit(", ", 1)[0])


def resolved(records: DataFrame) -> DataFrame:
    """records with the payload of each revisit taken from its response."""
    originals = records.where("record_type = 'response' and payload_bytes > 0").groupBy("payload_digest").agg(F.first("payload").alias("_p"))
    full = salted_lookup(records, originals, "payload_digest", F.col("page_id"))
    return full.withColumn("payload", F.coalesce("payload", "_p", F.lit(""))).select(*records.columns)


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back: a row per record, without payloads."""
    root = fresh_path(pages.sparkSession, "warc")
    index = write(pages, root, min_bytes=min_bytes)
    return read(index, root, payloads=False).drop("url")
