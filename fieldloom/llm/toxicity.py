"""Toxicity by noisy-channel deobfuscation.

Obfuscated strings (digits or signs for letters, separators inside a word, letters set apart, repetitions)
become lattices: every character may stand for itself, for the letters it resembles, or for nothing. The
cheapest path under a character trigram model of the whole corpus (Viterbi) is the restored text. A text's
words and restored words are then scored by a logistic model over the words, and the beginnings of words, that the
labels mark.

Defined results: null, empty and wordless texts get the intercept's score; without a labelled row of
either class the score is the share of label 1 (0 with no rows at all); repeated rows get equal scores; ties
in the choice of words fall to the smaller word; of several labels of one id the greatest holds; columns other than
those named are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.ship import shipped
from fieldloom.llm.store import Scratch

#: What a character of the channel may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¢": "c",
}
SEPARATORS = " .-_*~'/\\,:;#^=`"
#: Costs in nats.
LOOK_COST, DROP_SEPARATOR, KEEP_SEPARATOR, DROP_REPEAT, KEEP_REPEAT, DROP_DOUBLE = 0.3, 0.2, 2.0, 0.1, 3.0, 4.0
LONGEST = 64  # longer strings are decoded in windows that overlap by so much
SMALL = 1_000_000
START = 4  # letters of a word's beginning, a feature of its own: words of one stem share it
RIDGE = 0.3
LIFT = 3  # times as frequent in documents of label 1 as in the others
CACHE = 100_000  # chunks remembered; affects speed alone

#: The model's alphabet: 0 is a word's end, 1 any other letter.
ALPHABET = "".join(chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xDF, 0x100)) if chr(c).isalpha())
SYMBOL = {c: k + 2 for k, c in enumerate(ALPHABET)}
WIDTH = 64

_GAP = rf"[\s{re.escape(SEPARATORS)}]"
_APART = re.compile(rf"(?<![\w@$!|+])(?:[^\W_]|[@$!|+])(?:{_GAP}+[^\s{re.escape(SEPARATORS)}]){{2,}}(?![\w@$|+])")
_GAPS = re.compile(rf"{_GAP}{{3,}}|\s")
_EDGE = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "¡¿«»…“”„’–—"
_RUN = re.compile(r"[^\W\d_]+")
_DOUBLE = re.compile(r"(.)\1")
_TRIPLE = re.compile(r"(.)\1\1")
_LONG_RUN = re.compile(r"(.)\1{3,}")


def _symbols(text: str) -> np.ndarray:
    """Codes of the lower-cased text."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.zeros(0x250, np.int64)
    for c, k in SYMBOL.items():
        table[ord(c)] = k
    small = np.minimum(cp, 0x24F)
    return np.where(cp < 0x24F, table[small], 1)


def _trigrams(batches):
    total = np.zeros(WIDTH**3, np.int64)
    for batch in batches:
        held: list[str] = []
        size = 0

        def add():
            s = np.concatenate([[0], _symbols(" ".join(held)), [0]])
            code = (s[:-2] * WIDTH + s[1:-1]) * WIDTH + s[2:]
            np.add(total, np.bincount(code, minlength=WIDTH**3), out=total)

        for text in batch.column(0).to_pylist():
            held.append(text)
            size += len(text)
            if size > 1 << 20:
                add()
                held, size = [], 0
        if held:
            add()
    codes = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(total[codes])], ["code", "n"])


def language_model(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Cost in nats of each symbol after two others, from every text; at most ``WIDTH**3`` counts reach the driver."""
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    got = rows.mapInArrow(shipped(__name__, "_trigrams"), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    n3 = np.zeros(WIDTH**3)
    n3[got["code"].to_numpy()] = got["n"].to_numpy()
    n3 = n3.reshape(WIDTH, WIDTH, WIDTH)
    n3[:, 0, 0] = 0  # between words
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 0.5) / (n1.sum() + 0.5 * WIDTH)
    p2 = (n2 + 8 * p1) / (n2.sum(1, keepdims=True) + 8)
    p3 = (n3 + 8 * p2) / (n3.sum(2, keepdims=True) + 8)
    return -np.log(p3).astype(np.float32)


def readings(noisy: str, i: int, double: float = DROP_DOUBLE) -> list[tuple[str, float]]:
    """What a character of a lattice may stand for (a letter, a space or nothing), each with its cost."""
    c = noisy[i]
    same = i > 0 and c == noisy[i - 1]
    triple = same and (i > 1 and noisy[i - 2] == c or noisy[i + 1 : i + 2] == c)
    options: list[tuple[str, float]] = []
    if c in SEPARATORS:
        options += [("", DROP_SEPARATOR), (" ", KEEP_SEPARATOR)]
    elif c.isalpha():
        options.append((c, KEEP_REPEAT if triple else 0.0))
    if c in LOOKS:
        options += [(x, LOOK_COST) for x in LOOKS[c]]
    elif not options:
        options.append((" ", KEEP_SEPARATOR))
    if same and c not in SEPARATORS:
        options.append(("", DROP_REPEAT if triple else double))
    return options


def decode(noisy: str, cost: np.ndarray, double: float = DROP_DOUBLE) -> str:
    """The cheapest text of a lattice of ``noisy`` (lower case); words are space-separated. double: cost of dropping one of a pair."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for i in range(len(noisy)):
        options = readings(noisy, i, double)
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (x, out) in states.items():
            for sign, extra in options:
                if not sign:
                    key, total, text = (a, b), x + extra, out
                elif sign == " ":
                    if b == 0:
                        key, total, text = (a, b), x + extra, out
                    else:
                        key, total, text = (b, 0), x + extra + float(cost[a, b, 0]), out + " "
                else:
                    k = SYMBOL.get(sign, 1)
                    key, total, text = (b, k), x + extra + float(cost[a, b, k]), out + sign
                if key not in new or (total, text) < new[key]:
                    new[key] = (total, text)
        states = new
    return min((x + (float(cost[a, b, 0]) if b else 0.0), out) for (a, b), (x, out) in states.items())[1].strip()


def undouble(word: str, cost: np.ndarray) -> str:
    """``decode`` of a word of letters without a triple one: as pairs share no trigram, each is decided alone."""
    drop = []
    for m in _DOUBLE.finditer(word):
        i = m.start()
        a, b, c = (SYMBOL.get(word[k], 1) if 0 <= k < len(word) else 0 for k in (i - 1, i, i + 2))
        if DROP_DOUBLE + float(cost[a, b, c]) < float(cost[a, b, b]) + float(cost[b, b, c]):
            drop.append(i)
    for i in reversed(drop):
        word = word[:i] + word[i + 1 :]
    return word


def windows(text: str):
    """The text whole, or in windows that overlap by a word's length."""
    return [text] if len(text) <= LONGEST else [text[i : i + 5 * LONGEST] for i in range(0, max(1, len(text) - LONGEST), 4 * LONGEST)]


def features(words) -> tuple[str, ...]:
    """Words and, marked by ``*``, the beginnings of longer ones."""
    return tuple(dict.fromkeys([*words, *(f"{w[:START]}*" for w in words if len(w) > START)]))


class Reader:
    """The words of a text, with those restored from disguise, and their beginnings."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost
        self.known: dict[str, tuple[str, ...]] = {}

    def decoded(self, noisy: str) -> list[str]:
        if len(noisy) > LONGEST:
            noisy = _LONG_RUN.sub(r"\1\1\1", noisy)
        return [w for part in windows(noisy) for double in (DROP_DOUBLE, 99.0) for w in decode(part, self.cost, double).split()]

    def chunk(self, chunk: str) -> tuple[str, ...]:
        core = chunk.strip(_EDGE)
        if core.isalpha() and not _TRIPLE.search(core):
            found = (core,)
            if _DOUBLE.search(core) and (single := undouble(core, self.cost)) != core:
                found = (core, single)
        else:
            words = _RUN.findall(core)
            if words and (_TRIPLE.search(core) or len(core) != sum(map(len, words))):
                words += self.decoded(core)
            wide = chunk.strip(SEPARATORS + "?")  # signs at a word's edge can be letters too: $tupid
            if wide != core and any(c in LOOKS for c in wide) and any(c.isalpha() for c in wide):
                words += self.decoded(wide)
            found = tuple(dict.fromkeys(words))
        found = features(found)
        if len(self.known) > CACHE:
            self.known.clear()
        self.known[chunk] = found
        return found

    def words(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        get, new = self.known.get, self.chunk
        out: set[str] = set()
        for c in set(low.split()):
            got = get(c)
            out.update(new(c) if got is None else got)
        for m in _APART.finditer(low):
            run = _GAPS.sub(lambda g: "  "[: len(g.group())], m.group())
            if len(set(run) - {" "}) > 2:
                for part in windows(run):
                    restored = decode(part, self.cost)
                    out.update(features([*restored.split(), restored.replace(" ", "")]))
        return out


def _word_counts(batches, cost: np.ndarray):
    """Batches of (text, toxic) to partial document counts of words."""
    read, pos, neg = Reader(cost), Counter(), Counter()

    def out():
        words = list(dict.fromkeys([*pos, *neg]))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([pos[w] for w in words], pa.int64()), pa.array([neg[w] for w in words], pa.int64())], ["word", "pos", "neg"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (pos if toxic else neg).update(read.words(text))
            if len(pos) + len(neg) > 200_000:
                yield out()
                pos.clear()
                neg.clear()
    yield out()


def _hits(batches, cost: np.ndarray, index: dict[str, int]):
    """Batches of (text, toxic) to (indices of known words, toxic)."""
    read = Reader(cost)
    for batch in batches:
        got = [sorted(index[w] for w in read.words(t) if w in index) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32())), batch.column(1).cast(pa.int32())], ["hits", "toxic"])


def _logistic(col: np.ndarray, sizes: np.ndarray, y: np.ndarray, width: int, ridge: float = RIDGE, rounds: int = 400) -> np.ndarray:
    """Weights and, last, the intercept; gradient steps scaled by each weight's own curvature bound.

    col: the words of all rows, one row after another; sizes: how many each row has.
    """
    w = np.zeros(width + 1)
    if not len(y) or not 0 < y.sum() < len(y):
        share = min(1 - 1e-6, max(1e-6, float(y.mean()) if len(y) else 0.0))
        w[-1] = math.log(share / (1 - share))
        return w
    row = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    much = np.bincount(row, minlength=len(y)) + 1.0  # coupling between the weights of one row
    bound = np.append(np.bincount(col, much[row], width) / 4 + ridge, much.sum() / 4)
    w[-1] = math.log(y.mean() / (1 - y.mean()))
    v = w.copy()
    for k in range(rounds):
        z = v[-1] + np.bincount(row, v[col], len(y))
        off = 1 / (1 + np.exp(-z)) - y
        grad = np.append(np.bincount(col, off[row], width) + ridge * v[:-1], off.sum())
        new = v - grad / bound
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def fit(df: DataFrame, labels: DataFrame, max_words: int | None = None, min_docs: int = 3, max_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train: F.Column | None = None) -> dict:
    """A model: the character model of all texts, and word weights from the labelled rows for which ``train`` holds.

    Document counts of words cover all these rows. The words are all that are associated with label 1
    (``LIFT``, G-squared of 10.8 or more, 16 for beginnings, in ``min_docs`` documents or more), or the first ``max_words`` of these; their weights
    are fitted on at most ``max_rows`` labelled rows, the first by a hash of their id.
    """
    scratch = Scratch(df.sparkSession, "toxicity")
    cost = language_model(df, text_col)
    docs = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), (F.lit(True) if train is None else train).alias("train")).where("train and text is not null")
    marks = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("toxic")).where("toxic is not null").groupBy("key").agg(F.max("toxic").alias("toxic"))
    marks = scratch.keep("marks", docs.select("key").join(marks, "key").dropDuplicates(["key"]))  # ids alone are shuffled
    total = marks.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    # labels are broadcast up to SMALL of them (16 MB), else texts are shuffled once
    rows = docs.join(F.broadcast(marks) if sum(total) <= SMALL else marks, "key")
    counted = rows.select("text", "toxic").mapInArrow(shipped(__name__, "_word_counts", cost), "word string, pos long, neg long")
    p, n = (float(x) + 1e-9 for x in total)
    summed = counted.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(f"pos >= {int(min_docs)} and pos * {n!r} > {LIFT} * neg * {p!r}")
    part = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    share = (pos + neg) / (p + n)
    g2 = 2 * (part(pos, share * p) + part(neg, share * n) + part(p - pos, (1 - share) * p) + part(n - neg, (1 - share) * n))
    marked = summed.withColumn("g2", g2).where("g2 >= if(word like '%*', 16, 10.8)").orderBy(F.desc("g2"), "word").select("word")
    words = (marked if max_words is None else marked.limit(max_words)).toArrow()["word"].to_pylist()
    index = {w: i for i, w in enumerate(words)}
    chosen = scratch.keep("sample", marks.orderBy(F.xxhash64("key"), "key").limit(max_rows))
    sample = docs.join(F.broadcast(chosen), "key").select("text", "toxic")  # max_rows rows at most
    got = sample.mapInArrow(shipped(__name__, "_hits", cost, index), "hits array<int>, toxic int").toArrow()
    hits = got["hits"].combine_chunks()
    w = _logistic(hits.flatten().to_numpy(), hits.value_lengths().to_numpy(), got["toxic"].to_numpy().astype(float), len(words))
    return {"cost": cost, "weights": {x: float(w[i]) for x, i in index.items() if w[i] > 0}, "intercept": float(w[-1])}


class Scorer:
    def __init__(self, model: dict):
        self.read, self.weights, self.intercept = Reader(model["cost"]), model["weights"], model["intercept"]

    def __call__(self, text: str | None) -> float:
        z = self.intercept + math.fsum(self.weights[w] for w in self.read.words(text) if w in self.weights)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _score(batches, model: dict, at: int, below: float | None):
    score = Scorer(model)
    for batch in batches:
        got = [score(t) for t in batch.column(at).to_pylist()]
        if below is not None:
            yield batch.filter(pa.array([x < below for x in got], pa.bool_()))
        else:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["key", "score"])


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) of every row."""
    src = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(shipped(__name__, "_score", model, 1, None), f"key {kind}, score double").withColumnRenamed("key", id_col)


def kept(df: DataFrame, model: dict, below: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows that score under ``below``; all columns stay."""
    return df.mapInArrow(shipped(__name__, "_score", model, df.columns.index(text_col), below), df.schema)
