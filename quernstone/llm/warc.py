"""A deterministic sharded WARC writer, and its reader.

Records are range-sorted by id: bounds come from a hash sample of the ids whose size is bounded
(``common.SAMPLE``), so the same table always gives the same shards. Each task streams its sorted range into
gzip members, one per record, and starts a new file when the compressed size reaches ``roll_bytes``.
Headers and digests are made anew from the payload. A file is written under a temporary name with the
task's attempt in it and then renamed; the manifest, itself committed as a table, lists the files that
count. A task that runs twice writes the same bytes under the same final name.

Of records with equal payloads of at least ``least_bytes`` the one with the smallest id is a response;
the others become revisit records that name it and carry no payload. Only (id, digest) pairs are
shuffled to find them: those verdicts join the records' own range shuffle, so payloads move once.

Nulls and edges: a null payload is an empty one; a null id sorts last and is dealt by digest; among
rows of one id and equal payload the first is the response; a null URI is written as ``urn:record:ID``;
an empty table writes no file and reads back as no row; only the named columns are read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import range_shards, trimmed
from quernstone.session import stage, staged_path

SHARD_BYTES = 32 << 20
MANIFEST = "file string, records long, bytes long, sha256 string"
RECORD = "record_id string, record_type string, uri string, page_id long, payload binary, payload_bytes long, payload_digest string, refers_to long"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [*fields, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 4, mtime=0)


def _response(page_id, uri: str, payload: bytes, digest: str, date: str, first) -> bytes:
    name = f"<urn:record:{page_id}>"
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", "sha256:" + digest)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if first is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:record:{first[0]}>"), ("X-Payload-Length", str(len(payload)))]
        return _record(fields, http)
    return _record(fields, http + payload)


class _Roller:
    """Files of one shard; each is complete under its final name or absent."""

    def __init__(self, root: str, shard: int, roll_bytes: int, attempt: str, date: str):
        self.fs, self.root = open_fs(root)
        self.shard, self.roll, self.attempt, self.date = shard, roll_bytes, attempt, date
        self.seq, self.out = 0, None

    def add(self, member: bytes) -> dict | None:
        """Writes a member; gives the closed file's manifest row when it rolled."""
        done = self.close() if self.out is not None and self.bytes >= self.roll else None
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{self.name}.{self.attempt}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out, self.bytes, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            info = f"software: quernstone\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:shard:{self.name}>"), ("WARC-Filename", self.name), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], info))
        self._put(member)
        self.records += 1
        return done

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out, final = None, f"{self.root}/{self.name}"
        try:
            self.fs.move(self.temporary, final)
        except OSError:
            # some stores don't replace: the file there has the same bytes
            if self.fs.get_file_info(final).type != pafs.FileType.File:
                raise
            self.fs.delete_file(self.temporary)
        self.seq += 1
        return {"file": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest()}


def write_warc(records: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", roll_bytes: int = 16 << 20, least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes one record per row under ``path``; returns the manifest (file, records, bytes, sha256)."""
    spark = records.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = records.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = stage(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("n")), "warc-digests")
    firsts = narrow.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("c")).filter("c > 1").drop("c")
    verdicts = narrow.filter(F.col("n") >= least_bytes).join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
    total = narrow.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    place, parts = range_shards(narrow, "page_id", parts)
    shard = F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int")).otherwise(place(F.col("page_id"))).cast("int")
    both = rows.select("page_id", "uri", "payload", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first_id")).unionByName(
        verdicts.select("page_id", F.lit(None).cast("string").alias("uri"), F.lit(None).cast("binary").alias("payload"), "digest", F.lit(0).alias("kind"), "first_id"))
    dealt = both.withColumn("shard", shard).repartitionById(parts, F.col("shard")).sortWithinPartitions(F.col("page_id").asc_nulls_last(), "digest", "kind", "uri")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, known, seen, out = None, None, None, []
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, digest, kind = batch["page_id"][k].as_py(), batch["digest"][k].as_py(), batch["kind"][k].as_py()
                key = (page_id, digest)
                if kind == 0:
                    known = (key, batch["first_id"][k].as_py())
                    continue
                body = batch["payload"][k].as_py()
                first = None
                if known is not None and known[0] == key:
                    first = (known[1],)
                elif seen == key and len(body) >= least_bytes:
                    first = (page_id,)
                seen = key
                if roller is None:
                    roller = _Roller(path, batch["shard"][k].as_py(), roll_bytes, attempt, date)
                uri = (batch["uri"][k].as_py() or f"urn:record:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
                if row := roller.add(_response(page_id, uri, body, digest, date, first)):
                    out.append(row)
        if roller is not None:
            out.append(roller.close())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    manifest = dealt.mapInArrow(trimmed(write), MANIFEST)
    manifest.write.parquet(f"{path}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def _id(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:record:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a gzip stream."""
    reader = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    while line := reader.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := reader.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = reader.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("a record is cut short")
        yield fields, block


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all files in the manifest; checks file and payload digests. Revisits have a null payload."""
    listed = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    files = listed.repartition(max(1, min(listed.count(), 100_000)), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        where, root = open_fs(path)
        for batch in batches:
            for name in batch["file"].to_pylist():
                out, held = [], 0
                with where.open_input_stream(os.path.join(root, name), compression=None) as stream:
                    for fields, block in parse_warc(stream):
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        if "sha256:" + hashlib.sha256(block).hexdigest() != fields["warc-block-digest"]:
                            raise ValueError(f"{name}: a block's digest differs")
                        head, _, body = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            digest, size = hashlib.sha256(body).hexdigest(), len(body)
                            if "sha256:" + digest != fields["warc-payload-digest"]:
                                raise ValueError(f"{name}: a payload's digest differs")
                        else:
                            digest, size, body = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"]), None
                        out.append({"record_id": fields["warc-record-id"], "record_type": kind, "uri": fields["warc-target-uri"], "page_id": _id(fields["warc-record-id"]), "payload": body if payloads else None, "payload_bytes": size, "payload_digest": digest, "refers_to": _id(fields.get("warc-refers-to"))})
                        held += len(body or b"") if payloads else 100
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.mapInArrow(read, RECORD)


def archive_path(spark: SparkSession) -> str:
    return staged_path(spark, "warc")
