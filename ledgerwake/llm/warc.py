"""WARC archives of pages: writing, normalising a monolithic gzip stream, and reading back by an offset index.

pages -> records (response, or revisit of the smallest page_id with the same payload) -> monolithic archives, each one gzip
stream -> normalised archives, each record a gzip member of its own, with a sidecar index of offsets -> records read back by
seeking. Archives are files in the shared folder, written by one task each under a name that no other attempt of that task
uses; the tables of their paths are written before anything reads them, so that a lost executor's half-written files are
never looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, written

#: zlib's number for a gzip stream
_GZIP = 31
_CHUNK = 1 << 20
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _head(first: str, fields: dict[str, object]) -> bytes:
    """A first line and header fields; line ends in a value would break the block and become blanks."""
    lines = [first, *(f"{k}: {' '.join(str(v).split())}" for k, v in fields.items() if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head alone, whose Content-Length still tells the full payload's size."""
    http = _head("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload)})
    block = http if revisit else http + payload
    head = _head("WARC/1.1", {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-Id": page_id,
        "WARC-Profile": _PROFILE if revisit else None, "WARC-Refers-To": record_id(refers_to) if revisit else None, "X-Refers-To-Page-Id": refers_to,
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    })
    return head + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    """Header fields after the first line, names in lower case. Blanks around a value don't count, a line that begins with one continues the value before it, and of a repeated name the first counts."""
    fields, last = {}, None
    for line in head.decode(errors="replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and last is not None:
            fields[last] = f"{fields[last]} {line.strip()}".strip()
        elif colon and (last := name.strip().lower()) not in fields:
            fields[last] = value.strip()
        else:
            last = None
    return fields


def parse_record(record: bytes) -> dict:
    """The row of RECORDS of one whole record, with record_id and target_uri (null where it has none).

    The payload of an HTTP message is what follows its head, as stored; of any other block (warcinfo, metadata, a resource) it is
    the block. A revisit holds no payload: its size and digest are those that it tells, null where it tells none. page_id and
    refers_to are those of records written here; others have none.
    """
    head, _, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {head[:40]!r}")
    fields = _fields(head)
    payload, http = rest[: int(fields["content-length"])], {}
    if fields.get("content-type", "").lower().startswith("application/http"):
        message, _, payload = payload.partition(b"\r\n\r\n")
        http = _fields(message)
    number = lambda of, name: int(of[name]) if of.get(name, "").isdecimal() else None
    kind = fields["warc-type"].lower()
    told = fields.get("warc-payload-digest")
    return {
        "page_id": _page(fields, "x-page-id"), "payload_bytes": number(http, "content-length") if kind == "revisit" else len(payload),
        "payload_digest": (told and told.removeprefix("sha1:")) if kind == "revisit" else payload_digest(payload),
        "record_type": kind, "refers_to": _page(fields, "x-refers-to-page-id"),
        "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
    }


def _page(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if name in fields else None


def split_stream(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, one at a time, byte for byte: no more than one record and one chunk are held. Line ends before a record are skipped."""
    data = bytearray()
    for chunk in chunks:
        data += chunk
        while True:
            while data[:2] == b"\r\n":
                del data[:2]
            if (at := data.find(b"\r\n\r\n")) < 0:
                break
            end = at + 4 + int(_fields(bytes(data[:at]))["content-length"]) + 4
            if len(data) < end:
                break
            yield bytes(data[:end])
            del data[:end]
    if data.strip(b"\r\n"):
        raise ValueError(f"the stream ends inside a record, after {len(data)} bytes of it")


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What a gzip file holds, whether one stream or many members, with zero bytes after any of them. A file that ends inside of one is an error, wherever the cut falls."""
    stream, begun, ended = zlib.decompressobj(_GZIP), False, False
    for chunk in chunks:
        while chunk:
            if ended and not begun and not (chunk := chunk.lstrip(b"\0")):
                break
            begun = True
            if got := stream.decompress(chunk, 4 * _CHUNK):
                yield got
            chunk = stream.unconsumed_tail
            if stream.eof:
                chunk, stream = stream.unused_data, zlib.decompressobj(_GZIP)
                begun, ended = False, True
    if begun:
        raise ValueError("the gzip stream ends before its trailer")


def member(record: bytes, level: int = 6) -> bytes:
    packed = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
    return packed.compress(record) + packed.flush()


def _open(path: str):
    """The file system of a path and the path in it. Spark's names of a few of them differ."""
    scheme, _, rest = path.partition(":")
    if scheme in ("s3a", "s3n"):
        path = f"s3:{rest}"
    elif scheme == "dbfs":
        path = f"file:///dbfs/{rest.lstrip('/')}"
    return fs.FileSystem.from_uri(path)


def _chunks(file) -> Iterator[bytes]:
    while chunk := file.read(_CHUNK):
        yield chunk


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, refers_to (the smallest page_id of the pages with the same payload, null for itself).

    Only the payloads that more than one page has are joined back; payloads under least_bytes never are. A null page_id comes
    after all others; of several rows with the smallest page_id, all are responses.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("hex", F.sha1("payload"))
    firsts = (
        own.filter(F.octet_length("payload") >= least_bytes).groupBy(F.col("hex").alias("_hex")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("_hex", "first")
    )
    joined = own.join(firsts, own.hex == firsts._hex, "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_monolithic(records: DataFrame, folder: str, most_bytes: int = 64 << 20, level: int = 6) -> DataFrame:
    """Writes archives of about most_bytes uncompressed, each one single gzip stream, into the folder; the table of their paths, written."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file = packer = path = None
        size = n = 0
        for rows in batches:
            for page_id, url, payload, refers_to in rows.itertuples(index=False):
                if file is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    system, inner = _open(path)
                    file, packer, size, n = system.open_output_stream(inner, compression=None), zlib.compressobj(level, zlib.DEFLATED, _GZIP), 0, 0
                whole = lambda x: None if pd.isna(x) else int(x)
                revisit = whole(refers_to) is not None
                record = build_record(whole(page_id), url, payload, payload_digest(payload), whole(refers_to), revisit)
                file.write(packer.compress(record))
                size, n = size + len(record), n + 1
                if size >= most_bytes:
                    file.write(packer.flush())
                    file.close()
                    file = None
                    yield pd.DataFrame({"path": [path], "n_records": [n]})
        if file is not None:
            file.write(packer.flush())
            file.close()
            yield pd.DataFrame({"path": [path], "n_records": [n]})

    _make(folder)
    return written(records.mapInPandas(write, "path string, n_records long"), "warc-archives")


def _make(folder: str) -> None:
    system, inner = _open(folder)
    system.create_dir(inner, recursive=True)


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Inflates each archive once, rewrites every record as a gzip member of its own, and writes a sidecar index (JSON lines of offset, length, page_id, record_type, digest, record_id, target_uri) beside it. The table (path, index_path, n_records), written.

    Archives may be others' too: padding, records of every type and header fields in any form come through as they are.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for source in rows["path"]:
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                from_system, from_inner = _open(source)
                to_system, to_inner = _open(path)
                offset = n = 0
                with (
                    from_system.open_input_stream(from_inner, compression=None) as read,
                    to_system.open_output_stream(to_inner, compression=None) as write,
                    to_system.open_output_stream(f"{to_inner}.idx", compression=None) as index,
                ):
                    for record in split_stream(inflate(_chunks(read))):
                        packed, row = member(record, level), parse_record(record)
                        write.write(packed)
                        entry = {"offset": offset, "length": len(packed), "page_id": row["page_id"], "record_type": row["record_type"], "digest": row["payload_digest"], "record_id": row["record_id"], "target_uri": row["target_uri"]}
                        index.write(json.dumps(entry).encode() + b"\n")
                        offset, n = offset + len(packed), n + 1
                yield pd.DataFrame({"path": [path], "index_path": [f"{path}.idx"], "n_records": [n]})

    _make(folder)
    paths = archives.select("path")
    spread = paths.repartition(max(1, archives.count()), "path")
    return written(spread.mapInPandas(rewrite, "path string, index_path string, n_records long"), "warc-normalised")


def read_index(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """The entries of all sidecar indexes, with their archive's path."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, index_path in rows.itertuples(index=False):
                system, inner = _open(index_path)
                with system.open_input_stream(inner, compression=None) as file:
                    found = [json.loads(x) for x in file.readall().splitlines()]
                yield pd.DataFrame({"path": path, "offset": [e["offset"] for e in found], "length": [e["length"] for e in found], "page_id": pd.array([e["page_id"] for e in found], "Int64"), **{c: pd.array([e[c] for e in found], "string") for c in ("record_type", "record_id", "target_uri")}})

    return archives.select("path", "index_path").mapInPandas(entries, "path string, offset long, length long, page_id long, record_type string, record_id string, target_uri string")


def read_records(archives: DataFrame) -> DataFrame:
    """RECORDS of all records, each found by its index entry and inflated on its own."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, index_path in rows.itertuples(index=False):
                system, inner = _open(path)
                index_system, index_inner = _open(index_path)
                with system.open_input_file(inner) as file, index_system.open_input_stream(index_inner, compression=None) as index:
                    found = []
                    for line in index.readall().splitlines():
                        entry = json.loads(line)
                        file.seek(entry["offset"])
                        found.append(parse_record(zlib.decompress(file.read(entry["length"]), _GZIP)))
                out = pd.DataFrame(found, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    return archives.select("path", "index_path").repartition(max(1, archives.count()), "path").mapInPandas(read, RECORDS)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes, normalises and reads back all pages; a row of RECORDS per page.

    A null html is an empty payload, a very long one is one record, whole. Repeated rows get a record each: of several pages with
    the smallest page_id of their payload all are responses. A null page_id comes after all others and stays null. An empty
    table gives no archives and no rows. Extra columns, whatever their names, aren't looked at.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    monolithic = write_monolithic(with_revisits(pages, least_bytes), f"{folder}/monolithic")
    return read_records(normalise(monolithic, f"{folder}/members"))
