"""Best-two-fit packing of tokenised documents into sequences.

Each bin is filled greedily with the longest piece that still fits. Then the bin's smallest piece is given
back if two unpacked pieces fill its expanded gap more tightly. Only lengths matter, so a group of pieces is
packed from its length counts (at most ``max_tokens`` distinct ones) in time linear in its bins.

Pieces are dealt to groups by hash; each group is packed on its own by one task and has a bounded expected
size (``group_rows``), so the result costs at most one part-filled bin a group against one global packing.

Defined results: null or empty text has the end id alone (length 1); repeated rows are packed each;
an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.ship import shipped
from fieldloom.llm.store import Scratch


def fill(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece; every length is from 1 to ``size``."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(lengths, kind="stable")
    there, first, counts = np.unique(lengths[order], return_index=True, return_counts=True)
    left = np.zeros(size + 1, np.int64)
    left[there] = counts
    avail = there.tolist()  # sorted lengths of which pieces are left
    waiting = {k: order[i : i + c].tolist() for k, i, c in zip(avail, first.tolist(), counts.tolist(), strict=True)}

    def take(k: int) -> None:
        left[k] -= 1
        if not left[k]:
            del avail[bisect_left(avail, k)]

    at = 0
    while avail:
        gap, held = size, []
        while (i := bisect_right(avail, gap) - 1) >= 0:
            k = avail[i]
            take(k)
            held.append(k)
            gap -= k
        while gap and avail:  # best two fit for the smallest, the last one taken
            s = held[-1]
            room = gap + s
            a = np.flatnonzero(left[: room + 1])
            if not len(a):
                break
            p = np.searchsorted(a, room - a, "right") - 1  # the longest partner that fits
            own = (p >= 0) & (a[p] == a) & (left[a] < 2)
            p = np.where(own, p - 1, p)
            total = np.where(p >= 0, a + a[p], 0)
            best = int(total.argmax())
            if total[best] <= s:
                break
            x, y = int(a[best]), int(a[p[best]])
            held.pop()
            take(x)
            take(y)
            if not left[s]:
                insort(avail, s)
            left[s] += 1
            held += sorted((x, y), reverse=True)
            gap = room - x - y
        offset = 0
        for k in held:
            row = waiting[k].pop()
            bins[row], offsets[row] = at, offset
            offset += k
        at += 1
    return bins, offsets


def _cut(batches, path: str, size: int, end: int):
    """Arrow batches of (id, text) to batches of token pieces."""
    from fieldloom.llm.tokens import load

    encoder, tail = load(path), int(end).to_bytes(4, "little")
    encode = encoder.ids
    for batch in batches:
        out = {"key": [], "piece": [], "start": [], "length": [], "ids": []}
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text or "") + tail
            for i in range(0, len(ids), 4 * size):
                part = ids[i : i + 4 * size]
                out["key"].append(key)
                out["piece"].append(i // (4 * size))
                out["start"].append(i // 4)
                out["length"].append(len(part) // 4)
                out["ids"].append(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["key"], batch.column(0).type), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["ids"], pa.binary())],
            ["key", "piece", "start", "length", "ids"],
        )
    encoder.forget()


def pieces(df: DataFrame, path: str, max_tokens: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids with ``end_id`` after them, cut to ``max_tokens``: id, piece, start, length, ids (binary, little-endian uint32)."""
    src = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    out = src.mapInArrow(shipped(__name__, "_cut", path, max_tokens, end_id), f"key {kind}, piece int, start long, length long, ids binary")
    return out.withColumnRenamed("key", id_col)


def _pack(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    pdf = pdf.sort_values(list(pdf.columns[1:4]), kind="stable", ignore_index=True)
    bins, offsets = fill(pdf["length"].to_numpy(), size)
    pdf["sequence_id"] = pdf["__group"].to_numpy().astype(np.int64) * (1 << 32) + bins
    pdf["offset"] = offsets
    return pdf.drop(columns="__group")


def pack(df: DataFrame, path: str, max_tokens: int = 4096, end_id: int = 1, group_rows: int = 100_000, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed pieces: id, piece, start, length, ids_crc32, sequence_id, offset, and with ``with_ids`` the ids."""
    scratch = Scratch(df.sparkSession, "packing")
    cut = pieces(df, path, max_tokens, end_id, id_col, text_col).withColumn("ids_crc32", F.crc32("ids"))
    cols = [id_col, "piece", "start", "length", "ids_crc32"]
    kept = scratch.keep("pieces", cut.select(*cols, *["ids"] * with_ids))
    groups = max(1, -(-kept.count() // group_rows))
    dealt = kept.select(F.pmod(F.xxhash64(id_col, "piece"), F.lit(groups)).alias("__group"), *kept.columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("__group").applyInPandas(shipped(__name__, "_pack", max_tokens), kinds)
