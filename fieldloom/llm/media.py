"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as an 8-bit greyscale PNG, 64 samples a row, under its SHA-256 in tar shards
of the shared folder. Rows carry digest, shard, offset and length. Metadata columns are filled by range
reads of the header alone; payloads come back by range reads of their member.

Rows that repeat the payload of a row with a smaller id are found by digest before anything is stored (digests and ids alone
are shuffled), and left out of the scan that stores; what a null or repeated id lets through collapses in its task and
in the index. So payloads never cross the network, and one that a third of all rows share is one member. A task writes shards under names of its own attempt and its rows name
them, so a retried task leaves an unreferenced shard, never a wrong row; ``sweep`` deletes such shards.

Defined results: null text is empty (64 zero bytes); equal texts share a member and all values; an empty
table gives no shards and no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.ship import shipped
from fieldloom.llm.store import Scratch

WIDTH = 64
_MAGIC = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # signature and IHDR chunk
COPIES = 1_000_000


def payload(text: str | None) -> bytes:
    """UTF-8 and zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes, level: int = 6) -> bytes:
    """A greyscale image whose samples are the bytes; the length is a positive multiple of 64."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 before each line
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from an image's first 33 bytes."""
    if head[:8] != _MAGIC or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(png: bytes) -> bytes:
    """The samples of an image of ``to_png``; checksums are verified."""
    width, height, _ = header(png[:HEADER_BYTES])
    at, data = 8, []
    while at < len(png):
        (n,) = struct.unpack(">I", png[at : at + 4])
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered PNG lines")
    return lines[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples and the shares of 8 equal ranges, as fixed decimals."""
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    shares = n.reshape(8, 32).sum(1) / len(x)
    return ";".join([f"{x.mean():.4f}", f"{x.std():.4f}", f"{-(p * np.log2(p)).sum() + 0.0:.4f}", *(f"{s:.4f}" for s in shares)])


def _encode(batches, level: int):
    """(text) to (digest, media), each digest once a task."""
    seen: set[bytes] = set()
    for batch in batches:
        digests, media, size = [], [], 0
        for text in batch.column(0).to_pylist():
            data = payload(text)
            d = hashlib.sha256(data).digest()
            if d not in seen:
                seen.add(d)
                digests.append(d)
                media.append(to_png(data, level))
                size += len(media[-1])
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(media, pa.binary())], ["digest", "media"])
                    digests, media, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(media, pa.binary())], ["digest", "media"])


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _shard(batches, base: str, limit: int):
    """(digest, media) to (digest, shard, offset, length); writes tar shards of about ``limit`` bytes."""
    filesystem, root = _filesystem(base)
    filesystem.create_dir(root, recursive=True)
    names = ["digest", "shard", "offset", "length"]
    kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64()]
    seen: set[bytes] = set()
    out, rows, name, at = None, [], "", 0

    def close():
        nonlocal out
        if out is not None:
            out.write(bytes(1024))  # the archive's end
            out.close()
            out = None

    try:
        for batch in batches:
            for d, png in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if d in seen:
                    continue
                seen.add(d)
                if out is None or at > limit:
                    close()
                    name, at = f"shard-{uuid.uuid4().hex}.tar", 0
                    out = filesystem.open_output_stream(f"{root}/{name}")
                info = tarfile.TarInfo(f"{d.hex()}.png")
                info.size = len(png)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                out.write(head + png + bytes(-len(png) % 512))
                rows.append((d, name, at + len(head), len(png)))
                at += len(head) + len(png) + -len(png) % 512
    finally:
        close()
    # rows are given only once every shard of this task is complete
    for i in range(0, len(rows), 10_000):
        part = list(zip(*rows[i : i + 10_000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds, strict=True)], names)


def store(df: DataFrame, level: int = 6, shard_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, str]:
    """Writes the payloads. Returns rows (id, n_bytes, digest), index (digest, shard, offset, length) and the shards' folder."""
    scratch = Scratch(df.sparkSession, "media")
    base = scratch.path("shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.octet_length(text)
    padded = F.greatest(F.lit(WIDTH), F.ceil(n / WIDTH) * WIDTH)
    data = F.concat(F.encode(text, "utf-8"), F.unhex(F.repeat(F.lit("00"), (padded - n).cast("int"))))
    rows = df.select(F.col(id_col), n.cast("long").alias("n_bytes"), F.unhex(F.sha2(data, 256)).alias("digest"))
    known = scratch.keep("digests", rows.select(F.col(id_col).alias("id"), "digest"))
    owners = known.groupBy("digest").agg(F.min("id").alias("owner"))
    copies = scratch.keep("copies", known.join(owners, "digest").where("id <> owner").select("id", "digest").distinct())
    n_copies = copies.count()
    fresh = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.unhex(F.sha2(data, 256)).alias("digest"))
    # copies are broadcast up to COPIES of them (about 100 MB), else both sides are shuffled
    fresh = fresh.join(F.broadcast(copies) if n_copies <= COPIES else copies, ["id", "digest"], "left_anti")
    index = fresh.select("text").mapInArrow(shipped(__name__, "_store", base, level, shard_bytes), "digest binary, shard string, offset long, length long")
    index = scratch.keep("found", index)
    index = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.shard", "at.offset", "at.length")
    return rows, scratch.keep("index", index), base


def _store(batches, base: str, level: int, limit: int):
    return _shard(_encode(batches, level), base, limit)


def sweep(index: DataFrame, base: str) -> int:
    """Deletes shards that no row of the index names (of failed attempts); returns how many."""
    from pyarrow import fs

    filesystem, root = _filesystem(base)
    named = {r[0] for r in index.select("shard").distinct().collect()}  # one row a shard of many megabytes
    stray = [f for f in filesystem.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name not in named]
    for f in stray:
        filesystem.delete_file(f.path)
    return len(stray)


def _open(cache: dict, base: str, name: str):
    if name not in cache:
        for f in cache.values():
            f.close()
        cache.clear()
        filesystem, root = _filesystem(base)
        cache[name] = filesystem.open_input_file(f"{root}/{name}")
    return cache[name]


def _headers(batches, base: str):
    cache: dict = {}
    for batch in batches:
        got = [header(_open(cache, base, s).read_at(HEADER_BYTES, o)) for s, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        cols = list(zip(*got, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int32()) for c in cols)], ["digest", "width", "height", "depth"])


def metadata(index: DataFrame, base: str) -> DataFrame:
    """digest, width, height, depth by header-only range reads."""
    return index.select("digest", "shard", "offset").mapInArrow(shipped(__name__, "_headers", base), "digest binary, width int, height int, depth int")


def _read(batches, base: str):
    cache: dict = {}
    names = ["digest", "width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for d, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            f = _open(cache, base, shard)
            width, height, _ = header(f.read_at(HEADER_BYTES, offset))
            png = f.read_at(length, offset)
            data = from_png(png)
            sha = hashlib.sha256(data)
            if sha.digest() != d:
                raise ValueError(f"{shard} at {offset}: content is not {d.hex()}")
            rows.append((d, width, height, len(data), sha.hexdigest(), zlib.crc32(data[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), features(data)))
        part = list(zip(*rows, strict=True)) or [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds, strict=True)], names)


def read_back(index: DataFrame, base: str) -> DataFrame:
    """One row a distinct payload: metadata of its header, and digests and features of the bytes as stored."""
    near = index.select("digest", "shard", "offset", "length")
    return near.mapInArrow(
        shipped(__name__, "_read", base),
        "digest binary, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def extract_tar(data: bytes) -> dict[str, bytes]:
    """Members of a shard, for tools and tests."""
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        return {m.name: t.extractfile(m).read() for m in t.getmembers()}
