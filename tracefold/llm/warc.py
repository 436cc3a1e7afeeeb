"""Deterministic sharded WARC writer and its reader.

Pages are dealt to shards by ranges of ``page_id``: the bytes of slices of the id range are summed, slices with too many
are cut finer, and a shard is a run of slices of about ``SHARD_BYTES``.  The limits follow from the table alone, so a rerun writes the same
files.  In each shard records are sorted and written to a file under a temporary name, rolled when its compressed size
passes ``ROLL_BYTES``; a manifest - the list of the files with their sizes and digests - is written last, and only files
that a manifest of the committed attempt names are moved to their final names.  A lost executor leaves a temporary file
that nothing names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import discard, freed, materialize, shared_dir
from tracefold.llm.groups import arrow

MIN_REVISIT = 1000
SLICES = 65_536
SHARD_BYTES, ROLL_BYTES = 64 << 20, 16 << 20
#: Compressed bytes that the reader unpacks at once.
PIECE = 16 << 10
#: Tasks that write; beyond so many shards each task writes several, one after the other.
MOST_TASKS = 20_000
#: Fixed value: records carry this date, so that files depend on the table alone.
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "shard int, file string, temporary string, bytes bigint, records bigint, sha256 string"


def file_system(uri: str):
    """A file system and a path in it, for any store that Arrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record, as a gzip member of its own: headers and digests are made anew."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (b"" if refers_to is not None else payload)
    rid = lambda x: f"<urn:page:{'null' if x is None else x}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {rid(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {rid(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: {base32(digest)}", f"WARC-Block-Digest: {base32(hashlib.sha1(block).hexdigest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def shard_starts(slim: DataFrame, lo: int, hi: int, total: int) -> np.ndarray:
    """The first place of each shard, shards of about ``SHARD_BYTES`` (more only where one place has more).

    Bytes are summed over slices of the range; slices with too many are cut finer, in proportion, until none is left, so one
    far id costs no resolution elsewhere.  The driver holds some multiples of ``SLICES`` sums, whatever the input."""
    width = (hi - lo) // SLICES + 1
    starts = [lo + i * width for i in range((hi - lo) // width + 1)]
    while True:
        begins, n = np.array(starts, np.int64), len(starts)

        def fn(batch):
            at = np.searchsorted(begins, batch.column("place").to_numpy(), side="right") - 1
            sums = np.bincount(at, batch.column("size").to_numpy() + 400.0, n)
            some = np.flatnonzero(sums)
            yield [some, sums[some].astype(np.int64)]

        with freed(slim.sparkSession):
            sums = dict(map(tuple, arrow(slim.select("place", "size"), fn, "slice bigint, s bigint").groupBy("slice").agg(F.sum("s")).collect()))
        fine, ends = [], [*starts[1:], hi + 1]
        for i, (a, b) in enumerate(zip(starts, ends)):
            parts = min(b - a, -(-sums.get(i, 0) * SLICES // total)) if sums.get(i, 0) > max(SHARD_BYTES, 4 * total // SLICES) else 1
            fine += [a + (b - a) * k // parts for k in range(parts)]
        if len(fine) == n:
            break
        starts = fine
    out, filled = [lo], 0
    for i, a in enumerate(starts):
        if filled and filled + sums.get(i, 0) > SHARD_BYTES:
            out.append(a)
            filled = 0
        filled += sums.get(i, 0)
    return np.array(out, np.int64)


def planned(pages: DataFrame) -> DataFrame:
    """Pages with size, digest and the record they revisit, and the shard they go to; partition ``i`` of the result has
    the shards that are ``i`` modulo the number of partitions.  A row without an id takes a place by its digest."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha1("payload"))
    slim = materialize(rows.select("page_id", "size", "digest"), "pages")
    heads = slim.where(F.col("size") >= MIN_REVISIT).groupBy("digest", "size").agg(F.max("page_id").alias("head"), F.count("*").alias("k")).where("k > 1 and head is not null")
    heads = materialize(heads.drop("k"), "heads")
    with freed(slim.sparkSession):
        lo, hi, total = (x or 0 for x in slim.agg(F.min("page_id"), F.max("page_id"), F.sum(F.col("size") + 400)).first())
    spread = F.pmod(F.xxhash64("digest"), F.lit(min(hi - lo, (1 << 62)) + 1)) + F.lit(lo)
    place = F.coalesce("page_id", spread)
    starts = shard_starts(slim.withColumn("place", place), lo, hi, max(total, 1))
    discard(slim)

    def shard(places: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, places.to_numpy(np.int64), side="right").astype(np.int32) - 1)

    rows = rows.withColumn("shard", F.pandas_udf(shard, "int")(place))
    rows = rows.join(heads, ["digest", "size"], "left")
    rows = rows.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("head")), F.col("head"))).drop("head")
    # A shard for each task, not hashed: two shards never meet in a task while another has none.
    parts = min(len(starts), MOST_TASKS)
    return rows.repartitionById(parts, F.pmod("shard", F.lit(parts)))


def write(pages: DataFrame, target: str) -> DataFrame:
    """Write ``pages`` as WARC files under ``target`` (a folder all executors share) and return the manifest."""
    rows = planned(pages).sortWithinPartitions("shard", "page_id", "digest", "url")
    attempt = uuid.uuid4().hex

    def run(batches):
        files, folder = file_system(target)
        files.create_dir(f"{folder}/_temporary", recursive=True)
        done, now, part, buffer, n = [], None, 0, io.BytesIO(), 0

        def roll():
            nonlocal buffer, n, part
            if n:
                data = buffer.getvalue()
                temporary = f"_temporary/{attempt}-{uuid.uuid4().hex}"
                with files.open_output_stream(f"{folder}/{temporary}", compression=None) as f:
                    f.write(data)
                done.append((now, f"pages-{now:06d}-{part:04d}.warc.gz", temporary, len(data), n, hashlib.sha256(data).hexdigest()))
                part += 1
            buffer, n = io.BytesIO(), 0

        for batch in batches:
            names = ("shard", "page_id", "url", "payload", "size", "digest", "refers_to")
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                if shard != now:
                    roll()
                    now, part = shard, 0
                buffer.write(record(*row))
                n += 1
                if buffer.tell() >= ROLL_BYTES:
                    roll()
        roll()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], [x.split()[0] for x in MANIFEST.split(", ")])

    made = materialize(rows.select("shard", "page_id", "url", "payload", "size", "digest", "refers_to").mapInArrow(run, MANIFEST), "manifest")

    def commit(batch):
        files, folder = file_system(target)
        for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("file").to_pylist()):
            from pyarrow import fs

            if files.get_file_info(f"{folder}/{temporary}").type == fs.FileType.File:
                files.move(f"{folder}/{temporary}", f"{folder}/{name}")
        yield [batch.column(i) for i in range(6)]

    moved = materialize(arrow(made, commit, MANIFEST), "manifest")
    # One line for each file, not for each page.
    lines = [json.dumps({"file": r.file, "bytes": r.bytes, "records": r.records, "sha256": r.sha256}) for r in moved.orderBy("file").toLocalIterator()]
    files, folder = file_system(target)
    files.create_dir(folder, recursive=True)
    files.delete_dir(f"{folder}/_temporary") if lines else None
    with files.open_output_stream(f"{folder}/MANIFEST.tmp", compression=None) as f:
        f.write("\n".join(lines).encode())
    files.move(f"{folder}/MANIFEST.tmp", f"{folder}/MANIFEST")
    return moved


def members(data: bytes):
    """Records of a file: ``(headers, block)``, each a gzip member.

    The file is fed in pieces, so that what follows a member is never copied as a whole."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof and at < len(view):
            piece = view[at : at + PIECE]
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def page_of(rid: str | None) -> int | None:
    found = rid.removeprefix("<urn:page:").removesuffix(">") if rid else "null"
    return None if found == "null" else int(found)


def read(target: str, manifest: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of the files that a manifest names.

    Digests are checked: of the file, of each block, and of each payload that is there."""

    def fn(batch):
        files, folder = file_system(target)
        for name, size, sha in zip(batch.column("file").to_pylist(), batch.column("bytes").to_pylist(), batch.column("sha256").to_pylist()):
            with files.open_input_stream(f"{folder}/{name}", compression=None) as f:
                data = f.read()
            if len(data) != size or hashlib.sha256(data).hexdigest() != sha:
                raise ValueError(f"{name} is damaged")
            out = []
            for headers, block in members(data):
                http, _, payload = block.partition(b"\r\n\r\n")
                length = int(http.decode().rsplit("Content-Length: ", 1)[1])
                digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                whole = headers["WARC-Type"] == "response"
                if base32(hashlib.sha1(block).hexdigest()) != headers["WARC-Block-Digest"] or whole and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"a record of {name} is damaged")
                out.append((page_of(headers["WARC-Record-ID"]), length, digest, headers["WARC-Type"], page_of(headers.get("WARC-Refers-To"))))
            yield list(zip(*out))

    spread = manifest.select("file", "bytes", "sha256").repartition("file")
    return arrow(spread, fn, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame, target: str | None = None) -> DataFrame:
    """Write the pages to ``target`` (a new shared folder by default) and read the archives back.

    A null html is an empty payload; null urls are left out of the record.  Of equal payloads of at least 1000 bytes
    the record with the largest id is the response and others revisit it (rows that repeat that id too are responses;
    rows without an id revisit it; payloads of which no row has an id are all responses).  Other columns are not read;
    an empty table gives no records."""
    target = target or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(target, write(pages, target))
