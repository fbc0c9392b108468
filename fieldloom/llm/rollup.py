"""Token counts as delta-maintained rollups.

Changes (insert, delete, revise) come in named batches. A batch's documents are counted by every tokenizer
version; signed deltas by source, language and version, and the documents' new counts, are written as
Parquet under the batch's name. Totals are sums of deltas, so they are additive and never recomputed.

A batch is committed once its deltas' ``_SUCCESS`` file is there, written last. Applying a committed batch
again changes nothing; a batch that broke off is written anew over its own remains. One writer at a time.

Defined results: null text counts 0 tokens; null source or language are groups of their own; deleting an
unknown document changes nothing; inserting a known one revises it; of rows with one id in a batch the one with the
greatest ``seq`` holds if the changes have that column, else, and among equals, the one with the greatest (operation, source,
language, counts); an empty batch commits no rows; other columns are not read. Names of batches are letters, digits and ``_.-``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White-space words, and runs of word characters or single other signs.
WORDS = r"[^\x20\x09-\x0D]+"
PIECES = r"[0-9A-Za-z]+|[^0-9A-Za-z\x20\x09-\x0D]"
Counter = Callable[[Column], Column]
NATIVE: dict[str, Counter] = {
    "words@1": lambda text: F.regexp_count(text, F.lit(WORDS)),
    "pieces@1": lambda text: F.regexp_count(text, F.lit(PIECES)),
}


def bpe(path: str) -> Counter:
    """Counts ids of a ``tokenizers`` word-BPE file, in Arrow batches."""
    from fieldloom.llm.ship import shipped

    count = F.pandas_udf(_typed(shipped(__name__, "_bpe", path)), "long")
    return lambda text: count(text)


def _typed(f):
    import pandas as pd

    def g(s: pd.Series) -> pd.Series:
        return f(s)

    g.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return g


def _bpe(texts, path: str):
    from fieldloom.llm.tokens import load

    ids = load(path).ids
    return texts.map(lambda t: len(ids(t or "")) // 4).astype("int64")


_DELTA = "source string, lang string, version string, docs long, tokens long"


class Rollup:
    """A rollup in folder ``root`` of a file system that driver and executors share. Ids are of ``id_type``."""

    def __init__(self, spark: SparkSession, root: str, counters: dict[str, Counter] | None = None, id_type: str = "long"):
        self.spark, self.root, self.counters = spark, root.rstrip("/"), counters or NATIVE
        self.state_type = f"doc_id {id_type}, version string, source string, lang string, tokens long, alive boolean, seq long"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        p, fs = self._fs(f"{self.root}/deltas")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in names if fs.exists(self._fs(f"{self.root}/deltas/{n}/_SUCCESS")[0]))

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{kind}/{b}" for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def state(self) -> DataFrame:
        """The latest count of each document and version."""
        s = self._read("state", self.state_type)
        return s.groupBy("doc_id", "version").agg(F.max_by(F.struct("source", "lang", "tokens", "alive"), "seq").alias("s")).select("doc_id", "version", "s.*")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits changes (op, doc_id, source, lang, text[, seq]); False if the batch was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"not a batch's name: {batch!r}")
        done = self.committed()
        if batch in done:
            return False
        text = F.coalesce("text", F.lit(""))
        new = changes.select(
            "doc_id",
            F.struct((F.col("seq") if "seq" in changes.columns else F.lit(0)).alias("seq"), (F.col("op") != "delete").alias("alive"), "source", "lang", F.struct(*[c(text).cast("long").alias(f"v{k}") for k, c in enumerate(self.counters.values())]).alias("n")).alias("c"),
        )
        new = new.groupBy("doc_id").agg(F.max("c").alias("c"))
        versions = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"c.n.v{k}").alias("tokens")) for k, v in enumerate(self.counters)]))
        new = new.select("doc_id", F.col("c.alive").alias("alive"), F.col("c.source").alias("source"), F.col("c.lang").alias("lang"), versions.alias("v"))
        new = new.select("doc_id", "v.version", "alive", "source", "lang", "v.tokens")
        at = f"{self.root}/state/{batch}"
        old = self.state().where("alive").select("doc_id", "version", *[F.col(c).alias(f"old_{c}") for c in ("source", "lang", "tokens")], F.lit(True).alias("was"))
        both = new.join(old, ["doc_id", "version"], "left").where("alive or was")
        keep = both.select("doc_id", "version", F.expr("if(alive, source, old_source)").alias("source"), F.expr("if(alive, lang, old_lang)").alias("lang"), F.expr("if(alive, tokens, 0L)").alias("tokens"), "alive", F.lit(len(done) + 1).cast("long").alias("seq"), "old_source", "old_lang", "old_tokens", F.coalesce("was", F.lit(False)).alias("was"))
        keep.write.mode("overwrite").parquet(at)
        kept = self.spark.read.schema(keep.schema).parquet(at)
        plus = kept.where("alive").select("source", "lang", "version", F.lit(1).cast("long").alias("docs"), "tokens")
        minus = kept.where("was").select(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "version", F.lit(-1).cast("long").alias("docs"), (-F.col("old_tokens")).alias("tokens"))
        delta = plus.unionByName(minus).groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.root}/deltas/{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens of the live documents."""
        d = self._read("deltas", _DELTA)
        return d.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

