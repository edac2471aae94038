"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page_id into shards of about ``shard_bytes`` of
payload. The shards follow from sums over cells of the id range, so a rerun
over the same rows writes the same files. In a shard, each record is a gzip
member of its own, and a file is closed as soon as its compressed size reaches
``roll_bytes``. All headers, ids and digests are made from the rows.

Of records with equal payloads of at least ``revisit_bytes`` the one with the
largest page_id is the response and the others are revisit records that refer
to it; smaller ones are all responses. A file is written under a temporary name
and renamed when complete; then its shard's manifest is written in the same way,
and the archive's manifest after all shards. A task that runs again replaces
whole files by equal ones. Names hold a digest of the rows and parameters, and the
archive's manifest, replaced last, names that digest: other rows written to the
same folder add files and take over once complete. Readers go by the manifests only.

NULL payload: empty payload. NULL url: no target header. A NULL page_id is
written as such and sorts first. Repeated rows are written once each; of equal
rows with the largest id the first is the response. Other columns are ignored.
No row: an archive without files. The folder must be one that executors can
open through pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from urllib.parse import quote
from uuid import NAMESPACE_URL, uuid4, uuid5

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapgauge.llm.common import opened, ordered_shards, settled

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"


@dataclass(frozen=True)
class WarcParams:
    revisit_bytes: int = 1000
    shard_bytes: int = 64 << 20
    roll_bytes: int = 8 << 20
    date: str = "1970-01-01T00:00:00Z"


def put(store, path: str, data: bytes) -> None:
    """Write under a temporary name, then rename."""
    part = f"{path}.{uuid4().hex}.tmp"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'page:{page_id}:{digest}:{copy}')}>"


def encoded(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member without a time stamp."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    fields += [("WARC-Payload-Digest", f"sha1:{base32(digest)}"), ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).hexdigest())}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, 0)), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        fields.append(("X-Page", str(page_id)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return gzip.compress(f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)


class ShardWriter:
    """Files of one shard, closed by compressed size."""

    def __init__(self, store, folder: str, run: str, shard: int, p: WarcParams):
        self.store, self.folder, self.run, self.shard, self.p = store, folder, run, shard, p
        self.parts: list[bytes] = []
        self.size = self.records = 0
        self.files: list[dict] = []

    def add(self, record: bytes) -> None:
        self.parts.append(record)
        self.size += len(record)
        self.records += 1
        if self.size >= self.p.roll_bytes:
            self.roll()

    def roll(self) -> None:
        if self.parts:
            data = b"".join(self.parts)
            name = f"part-{self.run}-{self.shard:06d}-{len(self.files):05d}.warc.gz"
            put(self.store, f"{self.folder}/{name}", data)
            self.files.append({"file": name, "bytes": self.size, "records": self.records, "sha1": hashlib.sha1(data).hexdigest()})
            self.parts, self.size, self.records = [], 0, 0

    def close(self) -> list[dict]:
        self.roll()
        put(self.store, f"{self.folder}/manifest-{self.run}-{self.shard:06d}.json", json.dumps(self.files).encode())
        return self.files


def write_archive(pages: DataFrame, folder: str, p: WarcParams = WarcParams()) -> DataFrame:
    """Write page_id, url, html as WARC files below ``folder``; returns the manifest rows."""
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest, size = F.sha1(F.encode("html", "UTF-8")), F.octet_length("html")
    large = rows.filter(size >= p.revisit_bytes).select("page_id", digest.alias("digest"))
    large = settled(large, "warc-digests")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    groups = settled(groups, "warc-groups")
    known = large.join(groups, "digest").select("page_id", "digest", "refers_to").distinct()
    shard, shards = ordered_shards(rows, "page_id", size.cast("long"), p.shard_bytes)
    both = rows.select("page_id", "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind"))
    both = both.unionByName(known.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to", F.lit(0).alias("kind")))
    dealt = both.withColumn("shard", shard).repartitionById(shards, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", "page_id", "kind", "url", "html")
    # as text, since a NULL would turn the long ids of its batch into doubles
    dealt = dealt.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})

    content = rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("page_id", "url", "html")), F.sum(F.xxhash64("url", "page_id", "html").cast("decimal(38,0)"))).first()
    run = hashlib.sha1(json.dumps([*map(str, content), *map(str, asdict(p).items())]).encode()).hexdigest()[:12]
    store, path = opened(folder)
    store.create_dir(path, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = opened(folder)
        writer, page, refers, copies = None, object(), {}, {}
        done: list[dict] = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                own = None if pd.isna(row.page_id) else int(row.page_id)
                if writer is None or writer.shard != row.shard:
                    if writer:
                        done += writer.close()
                    writer = ShardWriter(store, path, run, int(row.shard), p)
                if own != page:
                    page, refers, copies = own, {}, {}
                if row.kind == 0:
                    refers[row.digest] = None if pd.isna(row.refers_to) else int(row.refers_to)
                    continue
                payload = row.html.encode()
                digest = hashlib.sha1(payload).hexdigest()
                copy = copies[digest] = copies.get(digest, -1) + 1
                target = refers.get(digest, own)
                revisit = digest in refers and (target != own or copy > 0)
                url = row.url if isinstance(row.url, str) else None
                writer.add(encoded(own, url, payload, digest, copy, target, revisit, p.date))
        if writer:
            done += writer.close()
        yield pd.DataFrame(done, columns=["file", "bytes", "records", "sha1"])

    manifest = settled(dealt.mapInPandas(write, "file string, bytes long, records long, sha1 string"), "warc-manifest")
    put(store, f"{path}/manifest.json", json.dumps({"run": run, "files": manifest.count()}).encode())
    return manifest


def members(stream) -> Iterator[bytes]:
    """Decompressed gzip members of a stream, one at a time."""
    data, unpack, out = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                return
        out.append(unpack.decompress(data))
        data = b""
        if unpack.eof:
            yield b"".join(out)
            data, unpack, out = unpack.unused_data, zlib.decompressobj(31), []


def parsed(record: bytes) -> tuple:
    """Fields of one record; a digest that does not fit is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).hexdigest())}":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (size != len(payload) or digest != hashlib.sha1(payload).hexdigest()):
        raise ValueError(f"payload differs from its digest in {fields['WARC-Record-ID']}")
    page, refers = fields.get("X-Page"), fields.get("X-Refers-To-Page")
    refers = None if refers in (None, "None") else int(refers)
    return None if page is None else int(page), size, digest, fields["WARC-Type"], refers, fields.get("WARC-Target-URI"), None if revisit else payload.decode()


def read_archive(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Records of all files of a manifest, digests checked (RECORD columns)."""
    names = RECORD.replace(", payload string", "") if not payload else RECORD

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = opened(folder)
        for batch in batches:
            for name in batch["file"]:
                rows, size = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for record in members(stream):
                        row = parsed(record)
                        rows.append(row if payload else row[:-1])
                        size += len(record) if payload else 256
                        if size > 8 << 20:
                            yield frame(rows)
                            rows, size = [], 0
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[f.split(" ")[0] for f in names.split(", ")], dtype=object)
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInPandas(read, names)


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows of the run that was finished last in a folder."""
    store, path = opened(folder)
    with store.open_input_stream(f"{path}/manifest.json") as top:
        last = json.loads(top.read())
    kind = "file string, bytes long, records long, sha1 string"
    if not last["files"]:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).json(f"{folder}/manifest-{last['run']}-*.json")
