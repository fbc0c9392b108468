"""SentencePiece encoding and decoding as a relational lattice.

A text's words (a run of the space sign and letters or other signs after it, or a line end) never share a piece, so each
distinct word is encoded once: its substrings of bounded length are exploded and equi-joined to the piece table, the
matches (lattice edges) are grouped by word, and a higher-order ``aggregate`` folds them to the word's segmentation.

``mode="unigram"`` folds Viterbi: the path with the greatest sum of scores, ties to the longer last piece. For
a BPE model that sum does not give the model's own segmentation, so ``mode="bpe"`` folds over the same edges
the merge with the best score, leftmost first, until none is left; its ids equal the library's. A character
without an edge becomes its UTF-8 bytes' pieces.

Documents go through this in blocks: a task numbers a block's distinct words and stays with the block's documents, in a table that
is bucketed by block. Only the words travel: once to be grouped with the places they came from and meet the vocabulary, and once
back as packed ids to the block, whose documents are put together from them. Words of more than ``LONGEST`` characters (data without
spaces), on which the folds' arrays would take quadratic time, take the same path in linear time on arrays (``viterbi``), or for
``bpe`` in the library.

Defined results: null and empty texts have no ids and an empty decoded text; an empty table gives no rows; each row is a
document of its own, also where rows repeat or share an id; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.ship import shipped
from fieldloom.llm.store import Scratch

SPACE = "▁"
LONGEST = 256
UNKNOWN = -1e10  # score of a character without a piece
PACKED = 1 << 22  # words that a block holds
SLICE = 1000  # documents that a row of a block holds
SHARE = 200_000  # blocks' words that a task encodes: their lattice is sorted in memory
_BASE = LONGEST + 1
_WORD = rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+"
_CLASS = rf"\n|{SPACE}*\p{{L}}+|{SPACE}*[^{SPACE}\n\p{{L}}]+|{SPACE}+"


def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _rows(sp) -> list[tuple[str, int, float]]:
    return [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]


def _first_byte(sp) -> int:
    first = next((i for i in range(sp.get_piece_size()) if sp.is_byte(i)), -1)
    if first < 0:
        raise ValueError("the model has no byte pieces")
    return first


def piece_table(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(piece, id, score) of the model's ordinary pieces; the longest one's length; the id of byte 0."""
    sp = _model(path)
    rows = _rows(sp)
    return spark.createDataFrame(rows, "piece string, id int, score double"), max(len(r[0]) for r in rows), _first_byte(sp)


def word_pattern(path: str) -> str:
    """The pattern of words: letters apart from other signs if no piece of the model holds both."""
    cores = (r[0].lstrip(SPACE) for r in _rows(_model(path)))
    return _CLASS if all(c.isalpha() or not any(map(str.isalpha, c)) for c in cores) else _WORD


def _merge_fold(edges: Column) -> Column:
    """The ids of the BPE segmentation."""
    n = F.element_at(edges, -1)["e"]
    key = lambda s, e: s * _BASE + e
    at = F.map_from_entries(F.transform(edges, lambda x: F.struct(key(x["e"] - x["l"], x["e"]).alias("k"), F.struct(x["w"].alias("w"), x["id"].alias("id")).alias("v"))))

    def fold(at: Column) -> Column:
        def step(b: Column, _: Column) -> Column:
            tried = F.transform(F.sequence(F.lit(0), F.size(b) - 3), lambda i: F.struct(at[key(F.get(b, i), F.get(b, i + 2))]["w"].alias("s"), (-i).alias("i")))
            best = F.array_max(F.filter(tried, lambda x: x["s"].isNotNull()))
            cut = F.transform(F.array(best), lambda x: F.when(x.isNull(), b).otherwise(F.filter(b, lambda _v, k: k != 1 - x["i"])))[0]
            return F.when(F.size(b) < 3, b).otherwise(cut)

        b = F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step)
        return F.transform(F.array(b), lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda i: at[key(F.get(b, i), F.get(b, i + 1))]["id"]))[0]

    return F.transform(F.array(at), fold)[0]


def _viterbi_fold(edges: Column) -> Column:
    """The ids of the path with the greatest sum of scores.

    Edges are in the order of their ends, then lengths, and every end has one of length 1. That one closes the end before it, which
    joins ``b``; longer ones compare with the open end (w, l, id) alone, so an array is copied once an end.
    """
    node = "struct<w:double,l:int,id:int>"
    zero = F.struct(F.array().cast(f"array<{node}>").alias("b"), F.lit(0.0).alias("w"), F.lit(0).alias("l"), F.lit(0).alias("id"))

    def step(a: Column, x: Column) -> Column:
        total = F.get(a["b"], x["e"] - x["l"])["w"] + x["w"]
        closed = F.array_append(a["b"], F.struct(a["w"].alias("w"), a["l"].alias("l"), a["id"].alias("id")))
        opened = F.struct(closed.alias("b"), (a["w"] + x["w"]).alias("w"), x["l"].alias("l"), x["id"].alias("id"))
        better = F.struct(a["b"].alias("b"), total.alias("w"), x["l"].alias("l"), x["id"].alias("id"))
        return F.when(x["l"] == 1, opened).when(total >= a["w"], better).otherwise(a)

    def back(a: Column) -> Column:
        last = F.struct((F.size(a["b"]) - a["l"]).alias("p"), F.array(a["id"]).alias("ids"))

        def go(c: Column, _: Column) -> Column:
            at = F.get(a["b"], c["p"])
            return F.when(c["p"] == 0, c).otherwise(F.struct((c["p"] - at["l"]).alias("p"), F.array_append(c["ids"], at["id"]).alias("ids")))

        return F.aggregate(a["b"], last, go, lambda c: F.reverse(c["ids"]))

    return F.aggregate(edges, zero, step, back)


def _byte_ids(char: Column, first: int) -> Column:
    h = F.hex(F.encode(char, "utf-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), lambda i: F.conv(F.substring(h, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + first)


def viterbi(word: str, table: dict[str, tuple[int, float]], longest: int, first: int) -> list[int]:
    """The ids that ``_viterbi_fold`` gives, in time linear in the word's length."""
    best, prev, piece = [0.0], [0], [-1]
    for e in range(1, len(word) + 1):
        top = None
        for s in range(max(0, e - longest), e):
            i, w = table.get(word[s:e], (-1, UNKNOWN if s == e - 1 else None))
            if w is not None and (top is None or best[s] + w > top[0]):
                top = (best[s] + w, s, i)
        best.append(top[0])
        prev.append(top[1])
        piece.append(top[2])
    out, e = [], len(word)
    while e:
        out.append([piece[e]] if piece[e] >= 0 else [first + b for b in word[prev[e] : e].encode()])
        e = prev[e]
    return [i for part in reversed(out) for i in part]


def _long(batches, path: str, mode: str):
    """(word, others) of any length with its ids before the others."""
    sp = _model(path)
    table = {p: (i, w) for p, i, w in _rows(sp)}
    longest, first = max(map(len, table)), _first_byte(sp)
    lead = sp.encode("\n")  # the library sets a space sign before a text; a line end takes it off the word
    for batch in batches:
        words = batch.column(0).to_pylist()
        ids = [viterbi(w, table, longest, first) for w in words] if mode == "unigram" else [x[len(lead) :] for x in sp.encode(["\n" + w.replace(SPACE, " ") for w in words], num_threads=1)]
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), *batch.columns[1:]], [names[0], "ids", *names[1:]])


def encode_words(words: DataFrame, path: str, mode: str = "unigram") -> DataFrame:
    """(word, others) of distinct words to (word, ids, others)."""
    if mode not in ("bpe", "unigram"):
        raise ValueError(f"unknown mode {mode!r}")
    table, longest, first = piece_table(words.sparkSession, path)
    others = [c for c in words.columns if c != "word"]
    words = words.select("word", *others)
    short = words.where(F.length("word") <= LONGEST).withColumn("len", F.length("word"))
    at = short.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("len") - 1)))
    at = at.withColumn("l", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("len") - F.col("s")))))
    # the others go with a word's first character alone, which always has an edge
    mine = [F.when((F.col("s") == 0) & (F.col("l") == 1), F.col(c)).alias(c) for c in others]
    at = at.select("word", "s", "l", *mine, F.substring("word", F.col("s") + 1, F.col("l")).alias("piece"))
    # the table is the model's vocabulary, a file of fixed size
    edges = at.join(F.broadcast(table), "piece", "left").where("id is not null or l = 1")
    # a character without a piece has its place, from -1 down, for an id
    edge = F.struct((F.col("s") + F.col("l")).alias("e"), "l", F.coalesce("score", F.lit(UNKNOWN)).alias("w"), F.coalesce("id", -1 - F.col("s")).alias("id"))
    by_word = edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"), *[F.first(c, ignorenulls=True).alias(c) for c in others])
    cut = by_word.select("word", (_merge_fold if mode == "bpe" else _viterbi_fold)(F.col("edges")).alias("ids"), *others)
    spelt = F.flatten(F.transform("ids", lambda i: F.when(i < 0, _byte_ids(F.substring(F.col("word"), -i, F.lit(1)), first)).otherwise(F.array(i))))
    cut = cut.withColumn("ids", F.when(F.exists("ids", lambda i: i < 0), spelt).otherwise(F.col("ids")))
    kinds = "".join(f", {c} {words.schema[c].dataType.simpleString()}" for c in others)
    return cut.unionByName(words.where(F.length("word") > LONGEST).mapInArrow(shipped(__name__, "_long", path, mode), "word string, ids array<int>" + kinds))


def _blocks(batches, pattern: str):
    """(key, text) to rows of a block: its distinct words, and its documents' keys, word counts and words by number."""
    import regex
    from pyspark import TaskContext

    find = regex.compile(pattern)
    part, block = TaskContext.get().partitionId(), 0
    known: dict[str, int] = {}
    total, keys, sizes, codes = 0, [], [], []
    schema = None

    def docs():
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + block]), pa.array([0]), pa.array([None], pa.list_(pa.string())), pa.array([keys], pa.list_(schema)), pa.array([np.array(sizes, "<u4").tobytes()]), pa.array([_pack(codes)])], ["block", "n", "words", "keys", "sizes", "codes"])

    def words():
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + block]), pa.array([len(known)]), pa.array([list(known)], pa.list_(pa.string())), pa.array([None], pa.list_(schema)), pa.array([None], pa.binary()), pa.array([None], pa.binary())], ["block", "n", "words", "keys", "sizes", "codes"])

    for batch in batches:
        schema = batch.schema.field(0).type
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = find.findall(SPACE + text.replace(" ", SPACE)) if text else []
            keys.append(key)
            sizes.append(len(found))
            codes += [known.setdefault(w, len(known)) for w in found]
            total += len(found)
            if len(keys) >= SLICE or len(codes) > PACKED:
                yield docs()
                keys, sizes, codes = [], [], []
            if total > PACKED:
                if keys:
                    yield docs()
                yield words()
                known, block, total, keys, sizes, codes = {}, block + 1, 0, [], [], []
    if keys:
        yield docs()
    if known:
        yield words()


def _pack(codes) -> bytes:
    """Numbers by their bytes' planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=6).compress(np.ascontiguousarray(np.asarray(codes).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(b: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _returned(batches):
    """(of: places of a word, ids) of a task to rows (block, coded): how many words, their numbers' steps, their ids' counts, all ids."""
    blocks, ats, words, sizes, flats, seen = [], [], [], [], [], 0
    for batch in batches:
        of, ids = batch.column(0), batch.column(1)
        places = of.flatten()
        blocks.append(places.field(0).to_numpy())
        ats.append(places.field(1).to_numpy())
        words.append(seen + np.repeat(np.arange(len(of)), of.value_lengths().to_numpy()))
        sizes.append(ids.value_lengths().to_numpy())
        flats.append(ids.flatten().to_numpy())
        seen += len(of)
    if not seen:
        return
    block, at, word, size, flat = (np.concatenate(x) for x in (blocks, ats, words, sizes, flats))
    start = np.cumsum(size, dtype=np.int64) - size
    order = np.lexsort((at, block))
    block, at, word = block[order], at[order], word[order]
    ends = [*(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        coded = _pack(np.concatenate([[b - a], np.diff(at[a:b], prepend=0), size[word[a:b]], _runs(flat, start, size, word[a:b])]))
        yield pa.RecordBatch.from_arrays([pa.array(block[a : a + 1]), pa.array([coded])], ["block", "coded"])


def _runs(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that start and size give, of ``which`` one after another."""
    many = size[which].astype(np.int64)
    return flat[np.repeat(start[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())]


def _assembled(docs: pa.Table, words: pa.Table, path: str, digests: bool) -> pa.Table:
    """One block's documents: key, ids and the text that these decode to, or the number of ids and both's digests."""
    sp = _model(path)
    raw = {i: p.replace(SPACE, " ").encode() for p, i, _ in _rows(sp)} | {_first_byte(sp) + b: bytes([b]) for b in range(256)}
    flats, numbers, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for coded in words["coded"].to_pylist():
        x = _unpack(coded).astype(np.int64)
        n = int(x[0])
        numbers.append(np.cumsum(x[1 : 1 + n]))
        counts.append(x[1 + n : 1 + 2 * n])
        flats.append(x[1 + 2 * n :])
    flat, number, count = np.concatenate(flats), np.concatenate(numbers), np.concatenate(counts)
    order = np.argsort(number)
    size = count[order]
    start = (np.cumsum(count) - count)[order]
    part = [raw[i] for i in flat.tolist()]
    said = [b"".join(part[s : s + n]) for s, n in zip(start.tolist(), size.tolist(), strict=True)]
    keys, found, texts = [], [], []
    for i in range(docs.num_rows):
        keys += docs["keys"][i].as_py()
        codes, at = _unpack(docs["codes"][i].as_py()).astype(np.int64), 0
        for n in np.frombuffer(docs["sizes"][i].as_py(), "<u4").tolist():
            c = codes[at : at + n]
            at += n
            mine = _runs(flat, start, size, c)
            text = b"".join([said[k] for k in c.tolist()]).removeprefix(b" ")
            if digests:
                found.append((len(mine), hashlib.sha256(mine.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))
            else:
                found.append(mine.astype(np.int32))
                texts.append(text.decode("utf-8", "replace"))
    kind = docs.schema.field("keys").type.value_type
    if digests:
        n, a, b = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(keys, kind), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["key", "n_pieces", "ids_sha256", "decoded_sha256"])
    return pa.table([pa.array(keys, kind), pa.array(found, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["key", "ids", "text"])


def _block(path: str, digests: bool):
    f = shipped(__name__, "_both", path, digests)

    def run(docs, words):
        return f((docs, words))

    return run


def _both(pair, path: str, digests: bool):
    return _assembled(*pair, path, digests)


def round_trip(df: DataFrame, path: str, mode: str = "unigram", id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id, ids, text of every row: its ids, and what they decode to; or, with ``digests``, n_pieces, ids_sha256 (of little-endian
    32-bit ids) and decoded_sha256."""
    scratch = Scratch(df.sparkSession, "pieces")
    src = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    packed = src.mapInArrow(shipped(__name__, "_blocks", word_pattern(path)), f"block long, n long, words array<string>, keys array<{kind}>, sizes binary, codes binary")
    packed = scratch.keep_by("packed", packed, "block")
    # a block's documents stay where they are; only its words, and their ids on the way back, are shuffled
    tasks = -(-(packed.agg(F.sum("n")).first()[0] or 0) // SHARE)
    words = packed.where("words is not null").select("block", F.posexplode("words").alias("at", "word"))
    words = words.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), "word")
    words = words.groupBy("word").agg(F.collect_list(F.struct("block", "at")).alias("of"))
    back = encode_words(words, path, mode).select("of", "ids").mapInArrow(shipped(__name__, "_returned"), "block long, coded binary")
    docs = packed.where("sizes is not null").select("block", "keys", "sizes", "codes")
    out = f"key {kind}, " + ("n_pieces long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, text string")
    return docs.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_block(path, digests), out).withColumnRenamed("key", id_col)


def encode(df: DataFrame, path: str, mode: str = "unigram", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids of every row."""
    return round_trip(df, path, mode, id_col, text_col).select(id_col, "ids")


def decoded(pieces: Column) -> Column:
    """The text of an array of (piece, byte) structs."""
    code = lambda x: F.when(x["byte"].isNotNull(), F.lpad(F.hex(x["byte"]), 2, "0")).otherwise(F.hex(F.encode(F.replace(x["piece"], F.lit(SPACE), F.lit(" ")), "utf-8")))
    raw = F.array_join(F.transform(pieces, code), "")
    return F.decode(F.unhex(raw), "utf-8")


def decode(df: DataFrame, path: str, key_cols: list[str], ids_col: str = "ids", keep_lead: bool = False) -> DataFrame:
    """key columns, text of rows with an array of ids: ids are exploded, equi-joined to the table and folded back in order.

    Keys must tell the rows apart; a row without ids gives an empty text, control ids give nothing.
    """
    spark = df.sparkSession
    table, _, first = piece_table(spark, path)
    codes = table.select("piece", "id", F.lit(None).cast("int").alias("byte")).unionByName(spark.range(256).select(F.lit(None).cast("string").alias("piece"), (F.col("id") + first).cast("int").alias("id"), F.col("id").cast("int").alias("byte")))
    rows = df.select(*key_cols, F.posexplode_outer(ids_col).alias("at", "id")).join(F.broadcast(codes), "id", "left")
    got = rows.groupBy(*key_cols).agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull() | F.col("byte").isNotNull(), F.struct("at", "piece", "byte")))).alias("p"))
    got = got.select(*key_cols, F.coalesce(decoded(F.col("p")), F.lit("")).alias("text"))
    return got if keep_lead else got.withColumn("text", F.regexp_replace("text", "^ ", ""))
