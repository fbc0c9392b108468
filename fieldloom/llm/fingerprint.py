"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences, in native expressions only.

Sections are parted by blank lines, paragraphs by line ends; a leaf is a sentence, cut every ``LEAF`` code
points where it has no end. A node's hash is the SHA-256 of its children's, comma-joined; the root tests
equality, and differing branches locate edits (``edits``). A fingerprint is ``root:leaf.leaf...`` with leaves
shortened to 12 hex digits, in order.

Likeness of two fingerprints is the Dice coefficient of their distinct leaves, 1 for equal roots.

Defined results: null text is empty; an empty text is one empty section; equal texts have equal
fingerprints; rows that share an id follow each other by text; a single row is its own next; a row with a null
id has an empty next text; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.store import Scratch

LEAF = 200
_LEAVES = rf"[^.!?\n]{{1,{LEAF}}}[.!?]*|[.!?]+"


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _join(c: Column) -> Column:
    return F.array_join(c, ",")


def leaf_hashes(paragraph: Column) -> Column:
    return F.transform(F.regexp_extract_all(paragraph, F.lit(_LEAVES), F.lit(0)), _sha)


def tree(text: Column) -> Column:
    """array (sections) of array (paragraphs) of array (leaf hashes)."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda s: F.transform(F.split(s, "\n"), leaf_hashes))


def section_hashes(t: Column) -> Column:
    return F.transform(t, lambda s: _sha(_join(F.transform(s, lambda p: _sha(_join(p))))))


def root(t: Column) -> Column:
    return _sha(_join(section_hashes(t)))


def fingerprint(t: Column) -> Column:
    """``root:leaf.leaf...`` of a tree."""
    leaves = F.transform(F.flatten(F.flatten(t)), lambda h: F.substring(h, 1, 12))
    return F.concat(root(t), F.lit(":"), F.array_join(leaves, "."))


def leaves(fp: Column) -> Column:
    """The distinct leaves of a fingerprint."""
    return F.array_distinct(F.filter(F.split(F.substring_index(fp, ":", -1), r"\."), lambda x: x != ""))


def likeness(a: Column, b: Column, a_leaves: Column, b_leaves: Column) -> Column:
    """Of two fingerprints with their leaves, 0 to 1."""
    both = F.size(F.array_intersect(a_leaves, b_leaves)).cast("double")
    sizes = F.size(a_leaves) + F.size(b_leaves)
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).when(sizes == 0, 0.0).otherwise(2.0 * both / sizes)


def edits(a: Column, b: Column) -> Column:
    """array<struct<section,paragraph,leaf>> of the leaves of tree ``b`` that differ from tree ``a``, descending only where hashes differ."""
    # bound as one value, so that the trees are not computed again at every step down
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: _edits(x["a"], x["b"]))[0]


def _edits(a: Column, b: Column) -> Column:
    at = lambda c, i: F.get(c, i)

    def in_paragraph(i, j, p, q):
        return F.filter(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(p), F.size(q), F.lit(1)) - 1), lambda k: F.when(~at(p, k).eqNullSafe(at(q, k)), F.struct(i.alias("section"), j.alias("paragraph"), k.alias("leaf")))),
            lambda x: x.isNotNull(),
        )

    none = F.array().cast("array<array<string>>")
    empty = F.array().cast("array<string>")

    def in_section(i, s, t):
        return F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(s), F.size(t)) - 1),
                lambda j: in_paragraph(i, j, F.coalesce(at(s, j), empty), F.coalesce(at(t, j), empty)),
            )
        )

    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1),
            lambda i: F.when(at(a, i).eqNullSafe(at(b, i)), F.array().cast("array<struct<section:int,paragraph:int,leaf:int>>")).otherwise(in_section(i, F.coalesce(at(a, i), none), F.coalesce(at(b, i), none))),
        )
    )


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (null: empty), fingerprint of every row."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("t", tree(F.col("text"))).select(id_col, "text", fingerprint(F.col("t")).alias("fingerprint"))


def with_next(df: DataFrame, id_col: str, text_col: str, rows_a_range: int = 1000) -> DataFrame:
    """``fingerprints`` of each row, with text and fingerprint of the next one by descending integer id, then text (after the last:
    the first), as struct ``next``.

    Rows are dealt to ranges of the id of about ``rows_a_range`` rows, the one shuffle of texts; a window orders each
    range. A range's last row takes the first row of the range below from a written table of one row a range. Ids that
    lie unevenly make ranges uneven, which costs time alone.
    """
    scratch = Scratch(df.sparkSession, "fingerprint")
    df = df.select(id_col, text_col)
    n, low, high = df.agg(F.count(id_col), F.min(id_col), F.max(id_col)).first()
    ranges = max(1, -(-n // rows_a_range))
    width = (high - low) // ranges + 1 if n else 1
    range_of = F.floor((F.col(id_col) - F.lit(low or 0)) / F.lit(width)).cast("long")
    first = df.select(F.col(id_col).alias("__head"), range_of.alias("range")).where("range is not null").groupBy("range").agg(F.max("__head").alias("__head"))
    down = Window.orderBy("range")
    chain = first.select("__head", F.coalesce(F.lead("range").over(down), F.min("range").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__to"))
    chain = scratch.keep("chain", chain)  # written, so that its size is known and the join below does not move texts
    s = F.struct("text", "fingerprint")
    heads = fingerprints(df.join(chain, df[id_col] == chain["__head"]).select(F.col("__to").alias(id_col), text_col), id_col, text_col)
    heads = scratch.keep("heads", heads.groupBy(F.col(id_col).alias("range")).agg(F.min(s).alias("over")))
    placed = fingerprints(df, id_col, text_col).withColumn("range", range_of)
    led = placed.withColumn("led", F.lead(s).over(Window.partitionBy("range").orderBy(F.desc(id_col), "text")))
    return led.join(heads, "range", "left").withColumn("next", F.coalesce("led", "over")).drop("range", "led", "over")


def with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, n_chars, fingerprint, next_fingerprint, edited_text, edited_fingerprint, edits, near_edited, near_next.

    The edited text is the text with its last half (rounded down) replaced by the start of the next document's; ``edits`` are
    the places of its leaves that differ.
    """
    rows = with_next(df, id_col, text_col)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    following = F.coalesce(F.col("next.text"), F.lit(""))
    out = rows.select(
        id_col,
        "text",
        n.cast("long").alias("n_chars"),
        "fingerprint",
        F.coalesce(F.col("next.fingerprint"), F.col("fingerprint")).alias("next_fingerprint"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring(following, F.lit(1), half)).alias("edited_text"),
    )
    out = out.withColumn("t", tree(F.col("edited_text"))).withColumns({"edited_fingerprint": fingerprint(F.col("t")), "edits": edits(tree(F.col("text")), F.col("t"))}).drop("t")
    out = out.withColumns({"a": leaves(F.col("fingerprint")), "b": leaves(F.col("edited_fingerprint")), "c": leaves(F.col("next_fingerprint"))})
    like = lambda fp, x: likeness(F.col("fingerprint"), F.col(fp), F.col("a"), F.col(x))
    return out.withColumns({"near_edited": like("edited_fingerprint", "b"), "near_next": like("next_fingerprint", "c")}).drop("a", "b", "c")


#: DuckDB SQL for ``with_edits`` over documents, reduced as the query op10 reduces it.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt FROM d WINDOW w AS (ORDER BY doc_id DESC, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, text, nxt, length(text) AS n, substring(text, 1, length(text) - length(text) // 2) || substring(nxt, 1, length(text) // 2) AS edited FROM n),
t AS (SELECT *, list_transform([text, nxt, edited], lambda x: list_transform(string_split(x, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
    lambda p: list_transform(regexp_extract_all(p, '[^.!?
]{1,200}[.!?]*|[.!?]+'), lambda l: sha256(l))))) AS ts FROM e),
f AS (SELECT *, list_transform(ts, lambda x: sha256(array_to_string(list_transform(x, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(p, ','))), ','))), ','))) AS roots,
    list_transform(ts, lambda x: list_transform(flatten(flatten(x)), lambda h: substring(h, 1, 12))) AS leaves FROM t)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
    list_sum(list_transform(range(1, greatest(len(ts[1]), len(ts[3])) + 1), lambda i: list_sum(list_transform(range(1, greatest(len(ts[1][i]), len(ts[3][i])) + 1),
        lambda j: len(list_filter(range(1, greatest(len(ts[1][i][j]), len(ts[3][i][j]), 1) + 1), lambda k: ts[1][i][j][k] IS DISTINCT FROM ts[3][i][j][k]))))))::BIGINT AS n_edits,
    roots[1] || ':' || array_to_string(leaves[1], '.') AS fingerprint,
    roots[3] || ':' || array_to_string(leaves[3], '.') AS edited_fingerprint,
    CASE WHEN roots[1] = roots[3] THEN 1.0::DOUBLE WHEN len(leaves[1]) + len(leaves[3]) = 0 THEN 0.0::DOUBLE
        ELSE 2.0::DOUBLE * len(list_intersect(list_distinct(leaves[1]), list_distinct(leaves[3]))) / (len(list_distinct(leaves[1])) + len(list_distinct(leaves[3]))) END AS near_edited,
    CASE WHEN roots[1] = roots[2] THEN 1.0::DOUBLE WHEN len(leaves[1]) + len(leaves[2]) = 0 THEN 0.0::DOUBLE
        ELSE 2.0::DOUBLE * len(list_intersect(list_distinct(leaves[1]), list_distinct(leaves[2]))) / (len(list_distinct(leaves[1])) + len(list_distinct(leaves[2]))) END AS near_next
FROM f
"""
