"""Deterministic sharded WARC writer, and its reader.

Records are range-sorted by id and payload digest into shards of about equal
bytes, whose bounds come from the rows with the lowest hashes. A task writes a shard
as files of one gzip member per record, and rolls to the next file when the
compressed size is reached. Headers and digests are made anew. Files get temporary
names that no other attempt shares; the manifest, a Parquet table, lists the attempts
that count, and only those are renamed to their final names; what other attempts
left is removed. The reader opens only files of a manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import materialize

SAMPLE = 32  # rows per shard from which the bounds of the shards are taken; every record is written
HEADERS = 512  # bytes that a record has besides its payload, about
DATE = "2000-01-01T00:00:00Z"  # fixed, so that the same records give the same bytes


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, payload_digest: str, copy: int = 0) -> str:
    """The same for the same record; further copies of a row count on."""
    name = f"{page_id} {url} {payload_digest}" + (f" {copy}" if copy else "")
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _header(text: str | None) -> str:
    return (text or "").encode("unicode_escape").decode()


def record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, first_url: str | None = None, copy: int = 0
) -> bytes:
    """One WARC/1.1 record; a revisit has headers only."""
    own = digest(payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, own, copy)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha1:{own}",
        f"X-Payload-Length: {len(payload)}", f"Content-Length: {0 if revisit else len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to, first_url, own)}", f"WARC-Refers-To-Target-URI: {_header(first_url)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def write(
    pages: DataFrame, path: str, file_bytes: int = 64 << 20, shard_bytes: int = 64 << 20, min_bytes: int = 0,
    key: str = "page_id", url: str = "url", payload: str = "html",
) -> DataFrame:
    """Write every row as a record below ``path``; returns the manifest (name, temporary, records, bytes).

    Null payload is empty. Of equal payloads of at least ``min_bytes``, rows with
    the smallest id are responses and the others revisits of it; rows with null
    id are always responses. Rows follow each other by id, null first, then by digest and url. A
    shard has about ``shard_bytes`` of payload and is written by one task; rows of one id with
    different payloads may be in several shards, rows equal in both are in one. An
    empty table has an empty manifest. Repeated rows are records of their own. The payload is shuffled once.
    """
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").alias("url"), body.alias("payload"), F.sha1(body.cast("binary")).alias("sha"))
    keys = materialize(rows.select("id", "url", "sha", F.octet_length("payload").alias("size")), "warc-keys")
    known = keys.where("id is not null")
    first = known.groupBy("sha").agg(F.min(F.struct("id", "url")).alias("first"))
    revisits = (
        known.where(F.col("size") >= min_bytes).select("id", "sha").distinct().join(first, "sha").where("id != first.id")
        .select(F.col("id").alias("rid"), F.col("sha").alias("rsha"), F.col("first.id").alias("first"), F.col("first.url").alias("first_url"))
    )
    weight = F.col("size") + HEADERS
    shards = max(1, -(-(keys.agg(F.sum(weight)).first()[0] or 0) // shard_bytes))
    # Rows in proportion to the shards, each named by id and digest.
    drawn = keys.orderBy(F.xxhash64("id", "sha"), "id", "sha").limit(SAMPLE * shards).select("id", "sha", weight.alias("w")).collect()
    drawn = sorted((_place(r.id, r.sha), r.w) for r in drawn)
    share, seen, bounds = sum(w for _, w in drawn) / shards, 0, []
    for place, w in drawn:
        seen += w
        if seen > share * (len(bounds) + 1) and len(bounds) < shards - 1 and (not bounds or place > bounds[-1]):
            bounds.append(place)

    @F.pandas_udf("int")
    def shard_of(id_: pd.Series, sha: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, _place(i, s)) for i, s in zip(id_, sha, strict=True)], dtype="int32")

    def save(own: pd.DataFrame, again: pd.DataFrame) -> pd.DataFrame:
        """Write the rows of one shard; ``again`` tells which payloads another record has."""
        if own.empty:
            return pd.DataFrame({"name": [], "temporary": [], "records": [], "bytes": []})
        system, folder = _open(path)
        system.create_dir(folder, recursive=True)
        former = {(int(i), s): (int(f), u) for i, s, f, u in zip(again["rid"], again["rsha"], again["first"], again["first_url"], strict=True)}
        shard, done, target, before = int(own["shard"].iloc[0]), [], None, None
        lines = zip(own["id"], own["url"], own["payload"], own["sha"], strict=True)
        order = sorted(((_place(i, s), u or "", t, u) for i, u, t, s in lines), key=lambda r: r[:2])
        for (known_id, i, sha), _, text, link in order:
            if target is None or done[-1][3] >= file_bytes:
                if target is not None:
                    target.close()
                done.append([f"shard-{shard:05d}-{len(done):05d}.warc.gz", f"_temporary-{uuid.uuid4().hex}", 0, 0])
                target = system.open_output_stream(f"{folder}/{done[-1][1]}", compression=None)
            copy = copy + 1 if before == (known_id, i, sha, link) else 0  # noqa: F821
            before = (known_id, i, sha, link)
            refers_to, first_url = former.get((i, sha), (None, None)) if known_id else (None, None)
            content = text.encode("utf-8", "replace")
            packed = gzip.compress(record(i if known_id else None, link, content, refers_to, refers_to is not None, first_url, copy), 6, mtime=0)
            target.write(packed)
            done[-1][2] += 1
            done[-1][3] += len(packed)
        target.close()
        return pd.DataFrame(done, columns=["name", "temporary", "records", "bytes"])

    left = rows.withColumn("shard", shard_of("id", "sha")).groupBy("shard")
    right = revisits.withColumn("shard", shard_of("rid", "rsha")).groupBy("shard")
    manifest = left.cogroup(right).applyInPandas(save, "name string, temporary string, records long, bytes long")
    manifest = materialize(manifest, "warc-manifest")

    def rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            system, folder = _open(path)
            for old, new in zip(batch["temporary"], batch["name"], strict=True):
                if system.get_file_info(f"{folder}/{old}").type != fs.FileType.NotFound:  # else an earlier attempt has renamed it
                    system.move(f"{folder}/{old}", f"{folder}/{new}")
            yield batch

    manifest = materialize(manifest.mapInPandas(rename, manifest.schema), "warc-manifest")
    _drop_temporary(path)
    return manifest


def _place(id_, sha: str) -> tuple[bool, int, str]:
    """Position of a record in the order of all: null ids first, then ids, then digests."""
    return (False, 0, sha) if pd.isna(id_) else (True, int(id_), sha)


def _drop_temporary(path: str) -> None:
    """Remove what attempts that do not count have left."""
    from pyarrow import fs

    system, folder = _open(path)
    for found in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if found.base_name.startswith("_temporary-"):
            system.delete_file(found.path)


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one record each, read piece by piece."""
    unpack, out = zlib.decompressobj(31), io.BytesIO()
    while piece := stream.read(1 << 20):
        while piece:
            out.write(unpack.decompress(piece))
            piece = unpack.unused_data
            if unpack.eof:
                yield out.getvalue()
                unpack, out = zlib.decompressobj(31), io.BytesIO()


def read(manifest: DataFrame, path: str) -> DataFrame:
    """One row per record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, intact."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["name"]:
                system, folder = _open(path)
                rows: list[tuple] = []
                with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        head, _, rest = raw.partition(b"\r\n\r\n")
                        h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                        content = rest[: int(h["Content-Length"])]
                        stated = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = h["WARC-Type"] == "revisit"
                        number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                        rows.append(
                            (number("X-Page-ID"), h["WARC-Target-URI"], number("X-Payload-Length") if revisit else len(content), stated, h["WARC-Type"],
                             number("X-Refers-To-Page-ID"), None if revisit else content, revisit or digest(content) == stated)
                        )
                        if len(rows) >= 500:
                            yield _frame(rows)
                            rows = []
                if rows:
                    yield _frame(rows)

    # As many tasks as files, up to the session's number; without a number the few names would be one task.
    slots = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(slots, "name").mapInPandas(
        parse,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, intact boolean",
    )


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "intact"]
    return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
