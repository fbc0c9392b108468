"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams (1 to 3, over all training texts) in order. A text
gets the language whose profile is nearest by out-of-place distance: over the text's own most frequent
n-grams, the sum of rank differences, ``size`` for an n-gram that the profile lacks.

Equal counts are ordered by n-gram code and equal distances by language name, so results are fixed. Null text
or one without a letter is ``und`` with score 0; an empty training set gives ``und`` throughout; repeated rows
get equal results; columns other than those named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.ship import shipped

_PENDING = 1 << 21  # n-grams held per language before a partial sum is sent on


def _count(batches):
    """Batches of (lang, text) to partial sums of (lang, code, n)."""
    from fieldloom.llm.grams import counts, merged

    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def out(lang):
        codes, n = merged(held.pop(lang))
        sizes.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n, pa.int64())], ["lang", "code", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = counts(text)
            held.setdefault(lang, []).append(got)
            sizes[lang] = sizes.get(lang, 0) + len(got[0])
            if sizes[lang] > _PENDING:
                both = merged(held[lang])
                held[lang], sizes[lang] = [both], len(both[0])
                if sizes[lang] > _PENDING // 2:
                    yield out(lang)
    for lang in list(held):
        yield out(lang)


def fit(df: DataFrame, size: int = 400, lang_col: str = "lang", text_col: str = "text") -> dict[str, list[int]]:
    """Profiles from every row with a language and a text: the ``size`` most frequent n-gram codes of each language."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    total = rows.mapInArrow(shipped(__name__, "_count"), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= size)
    found: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):  # at most size rows a language
        found.setdefault(r["lang"], []).append(r["code"])
    return found


class Judge:
    """Distances of texts to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size, self.langs = size, sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            p = np.array(profiles[lang], np.int64)
            self.ranks[k, np.searchsorted(self.codes, p)] = np.arange(len(p))

    def __call__(self, text: str | None) -> tuple[str, float]:
        from fieldloom.llm.grams import counts

        if not text or not self.langs:
            return "und", 0.0
        codes, n = counts(text)
        if not (codes >> 21 == (1 << 42) - 1).any():  # no single letter
            return "und", 0.0
        top = codes[np.argsort(-n, kind="stable")[: self.size]]
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        rank = np.where(self.codes[at] == top, self.ranks[:, at], -1)
        off = np.where(rank >= 0, np.abs(rank - np.arange(len(top))), self.size).sum(axis=1)
        k = int(off.argmin())
        return self.langs[k], float(min(1.0, max(0.0, 1 - off[k] / (self.size * len(top)))))


def _judge(batches, profiles, size: int, keep: float | None, at: int):
    judge = Judge(profiles, size)
    for batch in batches:
        got = [judge(t) for t in batch.column(at).to_pylist()]
        if keep is not None:
            yield batch.filter(pa.array([lang != "und" and score >= keep for lang, score in got], pa.bool_()))
        else:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["key", "lang_pred", "score"])


def predict(df: DataFrame, profiles: dict[str, list[int]], size: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row; score is 1 less the distance as a share of the largest possible."""
    src = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(shipped(__name__, "_judge", profiles, size, None, 1), f"key {kind}, lang_pred string, score double").withColumnRenamed("key", id_col)


def kept(df: DataFrame, profiles: dict[str, list[int]], least: float, size: int = 400, text_col: str = "text") -> DataFrame:
    """The rows whose text is in a learned language with ``least`` score or more; all columns stay."""
    return df.mapInArrow(shipped(__name__, "_judge", profiles, size, least, df.columns.index(text_col)), df.schema)
