"""WARC archives of page captures, written, read back and assembled into one nested row per capture.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record. The request and
the metadata name the response in WARC-Concurrent-To. Archives are .warc.gz files with one gzip member per
record; readers also take plain files. Reading goes by each record's Content-Length, so payloads may hold
anything, record headers included."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from . import files
from .common import at_places, cut, placeable, scratch_path, with_groups, with_places

CAPTURE = "page_id long, url string, payload string, digest string, response_id string, refers_to string"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, intact boolean, fields map<string,string>, payload binary"
NULL_ID = -(1 << 63)
ROLL_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
_LINE = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r?\n")


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 SHA-1, without Python: 40 hex digits as four groups of 40 bits."""
    digest = F.sha1(text.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(*parts: Column) -> Column:
    """A URN made from what the record is about, so that a task that runs again writes the same one."""
    h = F.md5(F.concat_ws("\x1f", *parts))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def record(kind: str, own_id: str, uri: str | None, block: bytes, **headers: str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": own_id, "WARC-Date": DATE} | ({"WARC-Target-URI": uri} if uri else {}) | headers | {"Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def capture_records(page_id: int, url: str | None, payload: str, digest: str, response_id: str, refers_to: str | None) -> list[bytes]:
    """The three records of a capture."""
    body = payload.encode()
    uri = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "")
    own = lambda role: f"<urn:uuid:{hashlib.md5(f'{role} {response_id}'.encode()).hexdigest()}>"
    path = "/" + (uri.split("/", 3)[3] if uri.count("/") > 2 else "")
    host = uri.split("/")[2] if uri.count("/") > 1 else ""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    answer = {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to:
        answer |= {"WARC-Refers-To": refers_to, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    fields = f"page-id: {'' if page_id == NULL_ID else page_id}\r\nurl-known: {int(url is not None)}\r\n".encode()
    return [
        record("request", own("request"), uri, f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), **{"Content-Type": "application/http; msgtype=request", "WARC-Concurrent-To": response_id}),
        record("revisit" if refers_to else "response", response_id, uri, http if refers_to else http + body, **answer),
        record("metadata", own("metadata"), uri, fields, **{"Content-Type": "application/warc-fields", "WARC-Concurrent-To": response_id}),
    ]


def inflated(read, size: int = 1 << 18) -> Iterator[bytes]:
    """Blocks of a file's bytes; gzip members are unpacked one after the other."""
    block = read(size)
    if not block.startswith(b"\x1f\x8b"):
        while block:
            yield block
            block = read(size)
        return
    member = zlib.decompressobj(31)
    while block:
        yield member.decompress(block)
        block = member.unused_data if member.eof else b""
        if member.eof:
            member = zlib.decompressobj(31)
        block = block or read(size)


def records(read) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record."""
    blocks, held = inflated(read), bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            more = next(blocks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while need(1) and held[:1] in (b"\r", b"\n"):
            del held[:1]
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not need(len(held) + 1):
                if held:
                    raise ValueError("a record's header is cut off")
                return
        head = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, v in _LINE.findall(bytes(held[: end + 2]))}
        length = int(head["content-length"])
        if not need(end + 4 + length):
            raise ValueError("a record's block is cut off")
        yield head, bytes(memoryview(held)[end + 4 : end + 4 + length])
        del held[: end + 4 + length]


def parsed(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """A RECORD row. The digest and size of a response are those of its payload; a revisit's are in its headers."""
    kind, http, payload = head["warc-type"], {}, None
    stated = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    digest, size, intact = stated, None, True
    if head.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, v in _LINE.findall(top + b"\r\n")}
    elif head.get("content-type") == "application/warc-fields":
        http = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, v in _LINE.findall(block)}
    if kind == "response":
        digest, size = base32_digest(payload), len(payload)
        intact = stated in (None, digest)
    elif kind == "revisit":
        size = int(http.get("content-length", 0))
    return head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), digest, size, intact, list(http.items()), payload if with_payload and kind == "response" else None


@dataclass
class Archive(InputPartition):
    file: str


class WarcFiles(DataSource):
    """format("warc_captures"): writes CAPTURE rows; reads RECORD rows, with payloads if option payload is true."""

    @classmethod
    def name(cls) -> str:
        return "warc_captures"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema):
        return WarcReader(self.options["path"], str(self.options.get("payload", "true")).lower() == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload = path, with_payload

    def partitions(self):
        return [Archive(e["file"]) for e in files.listed(self.path)]

    def read(self, partition):
        if partition is None:
            return
        kinds = [pa.string()] * 6 + [pa.int64(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", RECORD)]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        rows, held = [], 0
        with files.open_input(files.join(self.path, partition.file)) as f:
            for head, block in records(f.read):
                rows.append(parsed(head, block, self.with_payload))
                held += 300 + len(block)
                if held > 8 << 20:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> files.Written:
        done, out, size = [], None, 0
        for b in iterator:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or size > ROLL_BYTES:
                    if out is not None:
                        out.close()
                    done.append({"file": files.new_name(".warc.gz")})
                    out, size = files.open_output(files.join(self.path, done[-1]["file"])), 0
                for r in capture_records(*row):
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    member = z.compress(r) + z.flush()
                    out.write(member)
                    size += len(member)
        if out is not None:
            out.close()
        return files.Written(done)

    def commit(self, messages) -> None:
        files.publish(self.path, messages)

    def abort(self, messages) -> None:
        files.discard(self.path, messages)


def captures(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """CAPTURE rows: of equal payloads of at least min_bytes, the row with the largest id is the response.

    Only ids, digests and places are grouped; each page is then joined to its verdict by its place, and payloads stay where they
    lie unless there are very many repeats. A null payload is empty, a null id counts as the smallest and comes back as null.
    Rows of one id and payload are told apart by their place, of which the last is the response; an empty table gives none."""
    pages = placeable(pages)
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    id_, digest = F.coalesce(pages[id_col].cast("long"), F.lit(NULL_ID)).alias("page_id"), base32_sha1(payload).alias("digest")
    light = cut(with_places(pages, id_, digest, F.octet_length(payload).alias("size")))
    own = F.struct("page_id", "_file", "_row")
    groups = light.groupBy("digest").agg(F.max(own).alias("keeper"), F.count("*").alias("n")).where("n > 1")
    verdict = with_groups(light.where(F.col("size") >= min_bytes), groups, "digest", ["_file", "_row"]).where((F.col("n") > 1) & (own != F.col("keeper")))
    rows = with_places(pages, id_, pages[url_col].cast("string").alias("url"), payload.alias("payload"), digest)
    joined = at_places(rows, cut(verdict.select("_file", "_row", "keeper")), "left")
    name = lambda at: record_id(F.lit("response"), at("page_id").cast("string"), F.col("digest"), F.element_at(F.split(at("_file"), "/"), -1), at("_row").cast("string"))
    return joined.select("page_id", "url", "payload", "digest", name(F.col).alias("response_id"), F.when(F.col("keeper").isNotNull(), name(lambda c: F.col(f"keeper.{c}"))).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, **options) -> None:
    """Write the captures of pages as archives of about ROLL_BYTES each."""
    pages.sparkSession.dataSource.register(WarcFiles)
    captures(pages, **options).write.format("warc_captures").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """RECORD rows of all archives of path."""
    spark.dataSource.register(WarcFiles)
    return spark.read.format("warc_captures").option("payload", payload).load(path)


def assemble(rows: DataFrame) -> DataFrame:
    """One row per capture: response_id and nested structs response (or revisit), request and metadata.

    Requests and metadata go to the response that they name in WARC-Concurrent-To. Where several of a kind
    name one response, the one with the smallest record id is taken, and counts tell; a request or metadata
    whose response is missing makes a row with a null response."""
    names = rows.columns
    whole = F.struct(F.col("record_id"), *[c for c in ("type", "refers_to", "target_uri", "payload_digest", "payload_bytes", "intact", "fields", "payload") if c in names])
    answers = rows.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("response_id"), whole.alias("response"))
    side = F.struct("record_id", "target_uri", "fields")
    pick = lambda kind: F.min_by(F.when(F.col("type") == kind, side), F.when(F.col("type") == kind, F.col("record_id"))).alias(kind)
    sides = rows.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("response_id"))
    sides = sides.agg(pick("request"), pick("metadata"), *[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in ("request", "metadata")])
    return answers.join(sides, "response_id", "full_outer")


def op1_warc_transactions(spark, sf_dir: str) -> DataFrame:
    """Per page, from its archived capture: size and digest of the payload, its record's type and the page revisited."""
    path = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = assemble(read_warc(spark, path, payload=False))
    page = F.when(F.col("metadata.fields")["page-id"] != "", F.col("metadata.fields")["page-id"].cast("long"))
    flat = cut(found.select(
        page.alias("page_id"), "response_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("target"), F.col("response.intact").alias("intact"),
    ))
    targets = flat.where("record_type = 'response'").select(F.col("response_id").alias("target"), F.col("page_id").alias("refers_to"))
    revisits = with_groups(flat.where("record_type = 'revisit'"), targets, "target", ["response_id"])
    out = flat.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT page_id, payload_bytes, x, array_to_string(list_transform(range(0, 160, 5), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((16 * (strpos('0123456789abcdef', substr(x, CAST(i // 4 + 1 AS INT), 1)) - 1)
    + greatest(strpos('0123456789abcdef', substr(x || '0', CAST(i // 4 + 2 AS INT), 1)) - 1, 0)) >> CAST(3 - i % 4 AS INT)) % 32 AS INT), 1)), '') AS payload_digest FROM d),
k AS (SELECT x, max(page_id) AS keeper FROM d GROUP BY x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to, TRUE AS intact
FROM b JOIN k USING (x)
"""
