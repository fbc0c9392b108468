"""Exact n-gram Jaccard join by signature trees.

A document's set holds the 64-bit hashes of its distinct word shingles. Two documents link when
``100 * |x & y| >= percent * |x | y|``. The result is the components of these links; no link between
different sets is missed, and pairs are never spelled out within a group of copies.

1. ``_blocks`` and ``_recurrent`` sift. Of n shingles, two linked sets miss at most n - ceil(percent * n / 100) each, so a
   set with more shingles than that which no other set holds links with nothing. Only hashes of the lower half are
   tried, of all sets alike, so the same bound holds there; codes of these, packed by block of documents and bucket of
   codes, meet by bucket, and the counts go back to the block. What is left (a seventh of the test documents) shares most
   of its text.
2. ``_sets``: the sets that are left, and min-hashes of them. Classes of equal sets that share a min-hash are verified
   against the least of them, a star, so families of near copies become components at linear cost.
3. Each class has a prefix, the rarest shingles of which two linked sets must share one. Classes of different components
   that share a prefix shingle are a group; overlapping groups are a family.
4. A family's classes, their sets with them, meet in one task and form a signature tree, a node of which holds an
   OR-combined bitmap and a size range; the tree is traversed against itself, node pairs are pruned by the largest
   overlap that these allow (and where both nodes lie in one component), and leaves are compared on whole sets. Of the
   links found only a spanning forest leaves the task. A family of more than ``bound`` bytes is traversed group by group,
   and a group of more than that in blocks of like size, each pair of blocks that may hold a link on its own.

Defined results: null, empty and wordless texts have an empty set and link with nothing; rows with fewer
words than a shingle have their whole sequence as one; repeated rows are one class; rows without an id keep their size
and have no component of their own; an empty table gives an empty result; columns other than id and text are not read.
Words are runs of other than ASCII white space, A-Z lower-cased.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.components import components
from fieldloom.llm.ship import pair_shipped, shipped
from fieldloom.llm.store import Scratch

LEAF = 64  # classes below which a tree is not split
KEYS = 4  # min-hashes
SMALL = 1_000_000  # ids that are broadcast (16 MB); beyond, the join shuffles
BOUND = 16 << 20  # bytes of sets that meet in one task of the trees, or in one of two blocks
PACKED = 1 << 21  # codes that a block holds, and those that a bucket is made for
_U = np.uint64
_HALF = _U(1 << 63)
_MIX = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(31))
    h = h * _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(29))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(raw), seed=n)], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, n)
    h = np.zeros(n - words + 1, np.uint64)
    for i in range(words):
        h = h * _MIX[0] + w[i : n - words + 1 + i]
    return np.unique(_mixed(h))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s, digest_size=16).digest()


def missable(n: int, percent: int) -> int:
    """One more than the shingles of a set of n that a linked set may lack."""
    return n - -(-percent * n // 100) + 1


def _pack(x: np.ndarray) -> bytes:
    """Small numbers by their bytes' planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(b: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


_BLOCKS = pa.schema([("key", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("block", pa.int64()), ("place", pa.int64()), ("own", pa.int64()), ("bucket", pa.int64()), ("gaps", pa.binary()), ("who", pa.binary())])
_BLOCKS_SQL = "key long, tag long, n long, digest binary, block long, place long, own long, bucket long, gaps binary, who binary"


def _rows(**cols) -> pa.RecordBatch:
    size = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(size, f.type) for f in _BLOCKS], schema=_BLOCKS)


def _blocks(batches, words: int, percent: int, bits: int, buckets: int):
    """(key, text, tag) to a row of each document and, by block and bucket, the codes of the tried shingles.

    A document's ``own`` is how many of its tried shingles no other document of its block holds, less those that it
    may lack; a document that a task has seen before has no place. Codes that several documents of a block hold are sent
    once, without a document.
    """
    from pyspark import TaskContext

    part, block = TaskContext.get().partitionId(), 0
    seen: set[bytes] = set()
    edges = np.arange(1, buckets, dtype=np.uint64) * _U((1 << bits) // buckets)
    held: dict[str, list] = {"key": [], "tag": [], "n": [], "digest": [], "codes": [], "lack": []}

    def out(number: int):
        codes, sizes = np.concatenate(held["codes"]), np.array([len(c) for c in held["codes"]])
        who = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(codes, kind="stable")
        codes, who = codes[order], who[order]
        change = codes[1:] != codes[:-1]
        first, alone = np.ones((2, len(codes)), bool)
        first[1:] = change
        alone[:-1] = change
        alone &= first
        own = np.bincount(who[alone], minlength=len(sizes)) - np.array(held["lack"])
        size = len(sizes)
        yield _rows(**{k: held[k] for k in ("key", "tag", "n", "digest")}, block=np.full(size, number), place=np.arange(size), own=own)
        codes, who = codes[first], np.where(alone, who, size)[first]
        cut = [0, *np.searchsorted(codes, edges).tolist(), len(codes)]
        spans = [(k, lo, hi) for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if hi > lo]
        yield _rows(block=[number] * len(spans), bucket=[k for k, _, _ in spans], gaps=[_pack(np.diff(codes[lo:hi], prepend=_U(0))) for _, lo, hi in spans], who=[_pack(who[lo:hi]) for _, lo, hi in spans])

    total = 0
    for batch in batches:
        again: dict[str, list] = {"key": [], "tag": [], "n": [], "digest": []}
        for key, text, tag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = shingles(text, words)
            d = _digest(s)
            row = {"key": key, "tag": tag, "n": len(s), "digest": d}
            if not len(s) or key is None or d in seen:
                for k, v in row.items():
                    again[k].append(v)
                continue
            seen.add(d)
            lack = missable(len(s), percent)
            tried = s[: np.searchsorted(s, _HALF)]
            for k, v in (row | {"codes": _mixed(tried * _MIX[1]) >> _U(64 - bits), "lack": lack}).items():
                held[k].append(v)
            total += len(tried)
            if total > PACKED:
                yield from out((part << 32) + block)
                block, total = block + 1, 0
                held = {k: [] for k in held}
        if again["key"]:
            yield _rows(**again)
    if held["key"]:
        yield from out((part << 32) + block)


def _recurrent(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket, by block the documents (once for each code) whose code another block holds too."""
    codes = [np.cumsum(_unpack(g), dtype=np.uint64) for g in pdf["gaps"]]
    whole = np.concatenate(codes)
    order = np.argsort(whole, kind="stable")
    ordered = whole[order]
    same = ordered[1:] == ordered[:-1]
    shared = np.zeros(len(whole), bool)
    shared[order] = np.append(same, False) | np.append(False, same)
    rows, at = [], 0
    for block, who, c in zip(pdf["block"], pdf["who"], codes, strict=True):
        hit = _unpack(who)[shared[at : at + len(c)]]
        at += len(c)
        if len(hit):
            rows.append((block, _pack(hit)))
    return pd.DataFrame(rows, columns=["block", "hits"]).astype({"block": "int64"})


def _left(docs: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
    """The documents of one block that may link."""
    own = np.zeros(len(docs) + 1, np.int64)
    own[docs["place"].to_numpy()] = docs["own"].to_numpy()
    for h in hits["hits"]:
        own -= np.bincount(_unpack(h).astype(np.int64), minlength=len(own))
    return docs.loc[own[docs["place"].to_numpy()] < 0, ["digest"]]


def _sets(batches, words: int):
    """(key, text) to key, digest, set, min-hashes."""
    longs = pa.list_(pa.int64())
    for batch in batches:
        sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
        mins = [[int(s[0]) if not k else int(_mixed(s * _MIX[k]).min()) for k in range(KEYS)] if len(s) else [] for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], longs), pa.array([np.array(m, np.uint64).view(np.int64) for m in mins], longs)],
            ["key", "digest", "set", "mins"],
        )


def _links(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    return bool(both) and 100 * both >= percent * (len(s) + len(t) - both)


def _verify(pairs: pd.DataFrame, sets: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The pairs (a, b) of one deal that link, by their whole sets."""
    of = {i: s for i, s in zip(sets["id"], sets["set"], strict=True)}
    found = [(a, b) for a, b in pairs[["a", "b"]].sort_values(["a", "b"]).itertuples(index=False) if _links(of[a], of[b], percent)]
    return pd.DataFrame(found, columns=["u", "v"]).astype({"u": "int64", "v": "int64"})


class Forest:
    """Components under links."""

    def __init__(self, labels):
        self.up = {int(c): int(c) for c in labels}

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """False if both were in one component."""
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


class Tree:
    """Classes in the order of large components, then size; a node holds the OR of its bitmaps, its size range, the most
    shingles of a class that share bits, and its component if it lies in one."""

    def __init__(self, ids, comp, sets, bits: int):
        n = np.array([len(s) for s in sets])
        _, where, count = np.unique(comp, return_inverse=True, return_counts=True)
        order = np.lexsort((ids, n, np.where(count[where] > 1, comp, -1)))
        self.ids, self.comp, self.n, self.sets = ids[order], comp[order], n[order], [sets[k] for k in order]
        self.bits = np.stack([bitmap(s, bits) for s in self.sets])
        self.excess = self.n - np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        self.nodes: dict[tuple[int, int], tuple] = {}

    def node(self, i: int, j: int) -> tuple:
        if (i, j) not in self.nodes:
            n, one = self.n[i:j], bool((self.comp[i:j] == self.comp[i]).all())
            self.nodes[i, j] = (np.bitwise_or.reduce(self.bits[i:j]), int(n.min()), int(n.max()), int(self.excess[i:j].max()), int(self.comp[i]) if one else None)
        return self.nodes[i, j]


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Token bits of a set as 64-bit words; ``bits`` is a power of two, 64 at least."""
    on = np.zeros(bits, np.uint8)
    on[(s.view(np.uint64) & _U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(on, bitorder="little").view(np.uint64)


def most(x: tuple, y: tuple) -> int:
    """The largest overlap that two nodes allow."""
    shared = int(np.bitwise_count(x[0] & y[0]).sum())
    return min(x[2], y[2], shared + min(x[3], y[3]))


def _may(overlap, least_total, percent: int):
    return (100 + percent) * overlap >= percent * least_total


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Exact overlaps of all sets of x with all sets of y."""
    sets = [*x, *y]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[col] > 1
    place = np.cumsum(count > 1) - 1
    row, col = row[keep], place[col[keep]]
    out = np.zeros((len(x), len(y)), np.int64)
    order = np.argsort(col, kind="stable")
    row, col, wide = row[order], col[order], 1 << 14
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, wide):  # so many shingles at once
        i, j = np.searchsorted(col, [lo, lo + wide])
        there = np.zeros((len(sets), wide), np.float32)
        there[row[i:j], col[i:j] - lo] = 1
        out += (there[: len(x)] @ there[len(x) :].T).astype(np.int64)
    return out


def traverse(x: Tree, y: Tree, percent: int, forest: Forest):
    """Links (id of x, id of y) between components, which they join in ``forest``."""
    same = x is y
    stack = [((0, len(x.ids)), (0, len(y.ids)))]
    while stack:
        p, q = stack.pop()
        if same and q[1] <= p[0]:
            continue  # the mirrored pair
        a, b = x.node(*p), y.node(*q)
        if a[4] is not None and a[4] == b[4]:
            continue
        if 100 * a[2] < percent * b[1] or 100 * b[2] < percent * a[1] or not _may(most(a, b), a[1] + b[1], percent):
            continue
        if p[1] - p[0] <= LEAF and q[1] - q[0] <= LEAF:
            yield from _leaves(x, y, p, q, percent, forest)
        elif p[1] - p[0] >= q[1] - q[0]:
            mid = (p[0] + p[1]) // 2
            stack += [((p[0], mid), q), ((mid, p[1]), q)]
        else:
            mid = (q[0] + q[1]) // 2
            stack += [(p, (q[0], mid)), (p, (mid, q[1]))]


def _leaves(x: Tree, y: Tree, p: tuple, q: tuple, percent: int, forest: Forest):
    shared = np.bitwise_count(x.bits[p[0] : p[1], None] & y.bits[None, q[0] : q[1]]).sum(2, dtype=np.int64)
    nx, ny = x.n[p[0] : p[1], None], y.n[None, q[0] : q[1]]
    top = np.minimum(np.minimum(nx, ny), shared + np.minimum(x.excess[p[0] : p[1], None], y.excess[None, q[0] : q[1]]))
    roots = [np.array([forest.find(int(c)) for c in t.comp[r[0] : r[1]]]) for t, r in ((x, p), (y, q))]
    may = _may(top, nx + ny, percent) & (roots[0][:, None] != roots[1][None])
    if x is y:
        may &= np.arange(*p)[:, None] < np.arange(*q)[None]
    i, j = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    if not len(i):
        return
    both = overlaps([x.sets[p[0] + k] for k in i], [y.sets[q[0] + k] for k in j])
    found = may[np.ix_(i, j)] & (both > 0) & _may(both, (nx + ny)[np.ix_(i, j)], percent)
    for r, c in zip(*np.nonzero(found), strict=True):
        r, c = p[0] + i[r], q[0] + j[c]
        if forest.join(int(x.comp[r]), int(y.comp[c])):
            yield int(x.ids[r]), int(y.ids[c])


def _dual(rows: pd.DataFrame, sets: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Units (unit, i, j) of classes, each in block i or j, with their sets, to links."""
    found: set[tuple[int, int]] = set()
    of = dict(zip(sets["id"], sets["set"], strict=True))
    for (_, i, j), unit in rows.groupby(["unit", "i", "j"], sort=True):
        parts = [unit] if i == j else [unit[unit["block"] == k] for k in (i, j)]
        if any(not len(p) for p in parts):
            continue
        mean = sum(len(of[k]) for k in unit["id"]) / len(unit)
        bits = 1 << max(6, math.ceil(math.log2(4 * mean)))
        trees = [Tree(p["id"].to_numpy(), p["comp"].to_numpy(), [of[k] for k in p["id"]], bits) for p in parts]
        for a, b in traverse(trees[0], trees[-1], percent, Forest(unit["comp"].unique())):
            found.add((min(a, b), max(a, b)))
    return pd.DataFrame(sorted(found), columns=["u", "v"]).astype({"u": "int64", "v": "int64"})


def _second(both, name: str, last: tuple):
    return globals()[name](*both, *last)


class Join:
    """One run of the join over a table."""

    def __init__(self, df: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", bound: int = BOUND):
        self.words, self.percent, self.bound = words, percent, bound
        self.docs = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
        self.scratch = Scratch(df.sparkSession, "neardup")

    def small(self, ids: DataFrame) -> DataFrame:
        """``ids`` to broadcast if there are few."""
        return F.broadcast(ids) if ids.count() <= SMALL else ids

    def deals(self, total: int | None) -> int:
        return max(1, -(-int(total or 0) // self.bound))

    def labelled(self, classes: DataFrame, comps: DataFrame) -> DataFrame:
        found = self.small(comps.withColumnRenamed("id", "cid"))
        out = classes.join(found, classes["id"] == found["cid"], "left").drop("cid")
        return out.withColumn("comp", F.coalesce("comp", "id"))

    def fits(self, x: Column, y: Column) -> Column:
        return (100 * F.least(x, y)) >= self.percent * F.greatest(x, y)

    def sifted(self) -> tuple[DataFrame, DataFrame]:
        """(key, tag, n, digest) of every row; the digests of sets that may link."""
        s = self.scratch
        chars = self.docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
        codes = max(1, chars // 12)  # about half the words
        buckets, bits = max(16, -(-codes // PACKED)), min(62, math.ceil(math.log2(codes)) + 10)
        rows = self.docs.select("key", "text", F.xxhash64("text").alias("tag"))
        packed = s.keep("packed", rows.mapInArrow(shipped(__name__, "_blocks", self.words, self.percent, max(bits, 24), buckets), _BLOCKS_SQL))
        hits = packed.where("bucket is not null").select("bucket", "block", "gaps", "who").groupBy("bucket").applyInPandas(shipped(__name__, "_recurrent"), "block long, hits binary")
        placed = packed.where("place is not null").select("block", "place", "own", "digest")
        left = placed.groupBy("block").cogroup(hits.groupBy("block")).applyInPandas(pair_shipped(__name__, "_left"), "digest binary")
        left = s.keep("left", left.distinct())
        members = s.keep("members", packed.where("bucket is null").select("key", "tag", "n", "digest"))
        s.drop("packed")
        return members, left

    def sent(self, name: str, ids: DataFrame, classes: DataFrame) -> DataFrame:
        """(deal, id, set): each deal gets each of its sets once."""
        return classes.select("id", "set").join(self.small(self.scratch.keep(name, ids.distinct())), "id")

    def run(self) -> DataFrame:
        """(key, tag, n_shingles, comp) of every document."""
        s = self.scratch
        members, left = self.sifted()
        held = members.where("n > 0 and key is not null").groupBy("digest").agg(F.min("key").alias("id"))
        # one row of each set, that with the smallest id of all copies
        active = self.small(s.keep("active", held.join(left, "digest", "left_semi")))
        rows = self.docs.where("text is not null").join(active.select(F.col("id").alias("key")), "key", "left_semi")
        rows = rows.mapInArrow(shipped(__name__, "_sets", self.words), "key long, digest binary, set array<long>, mins array<long>")
        rows = rows.join(active.withColumnRenamed("id", "key"), ["key", "digest"], "left_semi")
        sets = rows.groupBy("digest").agg(F.first("key").alias("id"), F.first("set").alias("set"), F.first("mins").alias("mins"))
        classes = s.keep("classes", sets.select("id", F.size("set").cast("long").alias("n"), "set", "mins"))

        keyed = classes.select("id", "n", F.posexplode("mins").alias("k", "m"))
        stars = keyed.groupBy("k", "m").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("size")).where("size > 1")
        near = keyed.join(stars, ["k", "m"]).where(F.col("id") != F.col("lead.id")).where(self.fits(F.col("n"), F.col("lead.n")))
        near = near.groupBy(F.col("lead.id").alias("a"), F.col("id").alias("b")).agg(F.max(F.ceil(F.col("size") / 256)).alias("salts"), F.max(8 * F.col("n")).alias("bytes"))
        near = s.keep("near", near)
        deals = self.deals(near.agg(F.sum("bytes")).first()[0])
        pairs = near.select(F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("salts"))), F.lit(deals)).alias("deal"), "a", "b")
        wanted = self.sent("near-ids", pairs.select("deal", F.explode(F.array("a", "b")).alias("id")), classes)
        links = pairs.groupBy("deal").cogroup(wanted.groupBy("deal")).applyInPandas(pair_shipped(__name__, "_verify", self.percent), "u long, v long")
        links = s.keep("links-stars", links)
        comps = components(links, s, "cc-stars")

        kept = self.units(self.groups(classes, comps))
        wanted = self.sent("tree-ids", kept.select("deal", "id"), classes)
        more = kept.groupBy("deal").cogroup(wanted.groupBy("deal")).applyInPandas(pair_shipped(__name__, "_dual", self.percent), "u long, v long")
        more = s.keep("links-trees", more)
        if not more.isEmpty():
            comps = components(links.unionByName(more), s, "cc-trees")
        final = self.labelled(held, comps).select("digest", "comp")
        return members.select("key", "tag", "digest", F.col("n").alias("n_shingles")).join(final, "digest", "left").select("key", "tag", "n_shingles", F.coalesce("comp", "key").alias("comp"))

    def groups(self, classes: DataFrame, comps: DataFrame) -> DataFrame:
        """(h, id, n, comp, least) of the classes of different components that share a prefix shingle h; of groups with the same members, one."""
        s = self.scratch
        rows = classes.select("id", "n", F.explode("set").alias("h"))
        often = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
        # from the end of a set's order by frequency, what is beyond those that a linked set must hold is in its prefix
        last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("df"), F.desc("h")))
        prefix = rows.join(often, "h").withColumn("last", last).where(F.col("last") * 100 >= F.col("n") * self.percent).select("h", "id", "n")
        prefix = s.keep("prefixes", self.labelled(prefix, comps))
        tally = prefix.groupBy("h").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("id").alias("least"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s1"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(20,0)")).alias("s2"))
        one = tally.where("lo < hi").groupBy("size", "s1", "s2").agg(F.min(F.struct("h", "least")).alias("g")).select("g.h", "g.least")
        return s.keep("groups", prefix.join(one, "h"))

    def units(self, groups: DataFrame) -> DataFrame:
        """(deal, unit, i, j, block, id, comp): families, or their groups or pairs of blocks of these, of bounded size."""
        s = self.scratch
        edges = groups.where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))
        family = components(edges, s, "families").withColumnsRenamed({"id": "fid", "comp": "family"})
        classes = groups.select("id", "n", "comp").distinct()
        one = s.keep("members-of-families", classes.join(family, classes["id"] == family["fid"]).drop("fid"))
        sizes = s.keep("families", one.groupBy("family").agg(F.sum(8 * F.col("n")).alias("bytes")))
        total, largest = sizes.agg(F.sum("bytes"), F.max("bytes")).first()
        deals = self.deals(total)
        flat = lambda df, unit: df.select(F.col(unit).alias("unit"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), "id", "comp")
        if (largest or 0) <= self.bound:
            return s.keep("units", flat(one, "family").withColumn("deal", F.pmod(F.xxhash64("unit"), F.lit(deals))))
        large = sizes.where(F.col("bytes") > self.bound)
        whole = flat(one.join(large, "family", "left_anti"), "family")
        rest = groups.join(one.join(large, "family", "left_semi").select("id"), "id", "left_semi")
        # blocks of a group: classes of like size, and a component that alone is too much for one apart
        rest = rest.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / self.percent)).cast("int"))
        parts = rest.groupBy("h", "band", "comp").agg(F.sum(8 * F.col("n")).alias("bytes"))
        parts = parts.withColumn("pure", F.when(F.col("bytes") > self.bound, F.col("comp"))).withColumn("pool", F.coalesce("pure", F.lit(-1)))
        cells = parts.groupBy("h", "band", "pool").agg(F.ceil(F.sum("bytes") / self.bound).cast("int").alias("subs"))
        subs = parts.select("h", "band", "comp", "pool").join(cells, ["h", "band", "pool"])
        rest = rest.join(subs, ["h", "band", "comp"]).withColumn("block", F.xxhash64("band", "pool", F.pmod(F.xxhash64("id"), F.col("subs"))))
        rest = s.keep("blocks", rest.select("h", "id", "comp", "n", "band", "pool", "block"))
        nodes = s.keep("block-nodes", rest.groupBy("h", "block", "band", "pool").agg(F.sum(8 * F.col("n")).alias("bytes"), F.min("comp").alias("lo"), F.max("comp").alias("hi")))
        y = nodes.select("h", F.col("block").alias("j"), F.col("band").alias("jband"), F.col("lo").alias("jlo"), F.col("hi").alias("jhi"), F.col("bytes").alias("jbytes"))
        twos = nodes.join(y, "h").where("block <= j and abs(band - jband) <= 1 and not (lo = hi and jlo = jhi and lo = jlo)")
        twos = s.keep("block-pairs", twos.select("h", F.col("block").alias("i"), "j", (F.col("bytes") + F.col("jbytes")).alias("bytes")))
        many = self.deals(twos.agg(F.sum("bytes")).first()[0])
        ends = twos.select("h", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        cut = rest.join(ends, ["h", "block"]).select(F.col("h").alias("unit"), "i", "j", "block", "id", "comp", F.pmod(F.xxhash64("h", "i", "j"), F.lit(many)).alias("deal"))
        whole = whole.select("unit", *[F.col(c).cast("long").alias(c) for c in ("i", "j", "block")], "id", "comp", (-1 - F.pmod(F.xxhash64("unit"), F.lit(deals))).alias("deal"))
        return s.keep("units", whole.unionByName(cut))


def jaccard_components(df: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", bound: int = BOUND) -> DataFrame:
    """id, n_shingles, component_id (the smallest linked id, itself included) of every row. Ids are integers."""
    out = Join(df, words, percent, id_col, text_col, bound).run()
    return out.select(F.col("key").alias(id_col), "n_shingles", F.col("comp").alias("component_id"))


def representatives(df: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id (and, where rows share an id, the least hash of a text); all
    columns stay. Rows without words or without an id stay. A row that repeats with its id and text is one document."""
    join = Join(df, words, percent, id_col, text_col)
    s = join.scratch
    rows = s.keep("labelled", join.run().where("n_shingles > 0 and key is not null").select("key", "tag", "comp"))
    best = rows.groupBy("comp").agg(F.min(F.struct("key", "tag")).alias("best"))
    drop = rows.join(best, "comp").where("key <> best.key or tag <> best.tag").select("key", "tag").distinct()
    drop = s.keep("dropped", drop.select(F.col("key").alias("__key"), F.col("tag").alias("__tag")))
    twice = s.keep("twice", rows.groupBy("key", "tag").count().where("count > 1").select(F.col("key").alias("__key"), F.col("tag").alias("__tag")))
    on = lambda other: (F.col(id_col).cast("long") == other["__key"]) & (F.xxhash64(text_col) == other["__tag"])
    out = df.join(join.small(drop), on(drop), "left_anti")
    if twice.isEmpty():
        return out
    many = join.small(twice)
    once = out.join(many, on(twice), "left_semi").dropDuplicates([id_col, text_col])
    return out.join(many, on(twice), "left_anti").unionByName(once)
