"""WARC archives written and read by an index.

Writing gives the index first of all: per record its file, offset, length, address and digest. Every record is a
compressed member of its own, so a record can be read by its byte range alone. Reading takes index rows, sorts them
by place, joins ranges that lie close together into one read, and parses what it got.

Equal payloads of at least ``least`` bytes are kept once: the record with the smallest id is the response, the others
revisit it. A task writes to a file of its own name, and the index names only files of tasks that ended well; a task
that is repeated leaves an orphan, which goes with the folder.

Defined results: a null payload is empty; a null address gives no address field; a null id never is the smallest
(equal payloads that all lack an id are responses each). Rows with the same id and payload share their role. An empty
table gives an empty index; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, written

LEAST_BYTES = 100
FILE_BYTES = 1 << 30
#: Ranges this close are read at once, up to so many bytes.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20

#: Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2026-01-01T00:00:00Z"

INDEX = "page_id long, url string, record_type string, payload_digest string, path string, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean"


def roles(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Pages (``page_id``, ``url``, ``payload``) with ``digest`` and ``refers_to``, null for responses.

    Roles are found on ids and digests alone; payloads move once, to meet them.
    """
    pages = pages.select("*", F.sha2(F.col("payload").cast("binary"), 256).alias("digest"))
    narrow = pages.where(F.octet_length("payload") >= least).select("page_id", "digest")
    first = narrow.groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    again = narrow.join(first, F.col("digest") == F.col("d")).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = again.select(F.col("page_id").alias("p"), "d", "refers_to").distinct()
    same = (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p"))
    return pages.join(again, same, "left").drop("p", "d")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def build(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record."""
    response = refers_to is None
    block = _HTTP + payload if response else b""
    fields = {
        "WARC-Type": "response" if response else "revisit",
        "WARC-Record-ID": _record_id(page_id, digest),
        "WARC-Date": _DATE,
        "WARC-Target-URI": None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": None if response else _PROFILE,
        "WARC-Refers-To": None if response else _record_id(refers_to, digest),
        "X-Page-Id": page_id,
        "X-Refers-To-Page-Id": refers_to,
        "X-Payload-Length": len(payload),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else b""


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Write archives to ``folder`` (one that all executors reach) and return their index, stored beside them."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, offset = None, "", 0
        try:
            for batch in batches:
                index: dict[str, list] = {name.split()[0]: [] for name in INDEX.split(", ")}
                for row in range(batch.num_rows):
                    number, address, body, digest, refers_to = (batch.column(i)[row].as_py() for i in range(5))
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        path, offset = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(path, compression=None)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = packer.compress(build(number, address, body.encode(), digest, refers_to)) + packer.flush()
                    out.write(member)
                    for name, value in zip(index, (number, address, "revisit" if refers_to is not None else "response", digest, path, offset, len(member)), strict=True):
                        index[name].append(value)
                    offset += len(member)
                yield pa.RecordBatch.from_pydict(index, schema=_arrow(INDEX))
        finally:
            if out is not None:
                out.close()

    return written(roles(rows, least).mapInArrow(run, INDEX), "warc-index")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def _runs(places: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Joined ranges of sorted (offset, length), each with the places it holds."""
    start = end = 0
    held: list[tuple[int, int]] = []
    for offset, length in places:
        if held and (offset - end > GAP_BYTES or offset + length - start > READ_BYTES):
            yield start, end - start, held
            held = []
        if not held:
            start = end = offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield start, end - start, held


def read(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Records of the index rows given, parsed; ``intact`` tells whether a response's payload has its digest."""
    places = index.select("path", "offset", "length").repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    schema = RECORD + (", payload binary" if payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                by_file.setdefault(path, []).append((offset, length))
            for path, sorted_places in by_file.items():
                with store.open_input_file(path) as file:
                    for start, size, held in _runs(sorted_places):
                        data = file.read_at(size, start)
                        rows = [_row(zlib.decompress(data[o - start : o - start + n], 31), payload) for o, n in held]
                        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(schema))

    return places.mapInArrow(run, schema)


def _row(record: bytes, payload: bool) -> dict:
    fields, body = parse(record)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    response = fields["WARC-Type"] == "response"
    found = hashlib.sha256(body).hexdigest() if response else digest
    row = {
        "page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None, "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"], "payload_bytes": len(body) if response else int(fields["X-Payload-Length"]),
        "payload_digest": found, "refers_to": int(fields["X-Refers-To-Page-Id"]) if not response else None,
        "intact": found == digest,
    }
    return row | ({"payload": body} if payload else {})


def new_folder(pages: DataFrame) -> str:
    """A folder for archives under the shared one, as an address."""
    path = scratch_path(pages.sparkSession, "warc")
    return path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1)
