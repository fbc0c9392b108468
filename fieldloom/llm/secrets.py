"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty for strings in a sensitive context.

A candidate is every string of 16 or more key characters within ``around`` characters of a sensitive word, on either
side and on any line, or as near to a string that was reported (the lines of a key's body). Its marginal bytes are what it
adds to a zstandard frame of a dictionary of identifiers and the code around it, in which no long string stands,
so that a key that stands twice does not prime itself. Identifiers, paths and words cost less than a random string
of their length and alphabet under the same dictionary; those at ``ratio`` of its cost or more are reported as ``novel``.
Of a string below that, its parts between signs are measured alone (a key behind a long name or path).

Defined results: null text is empty; an empty text or table has no spans; equal rows have equal spans;
columns other than id and text are not read. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import functools
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.ship import shipped

#: The base patterns, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # same as the runs of hex digits that have 32 or more
KINDS = ("assign", "access", "hex", "novel")

#: Words that make their surroundings sensitive.
CONTEXT = ("password", "passwd", "passphrase", "pwd", "secret", "token", "credential", "authorization", "bearer", "private", "api_key", "apikey", "api-key", "access_key", "access-key", "auth_key", "signature", "cookie", "session")
_CONTEXT = re.compile("|".join(map(re.escape, CONTEXT)), re.ASCII | re.IGNORECASE)
_BASE_WORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Common identifiers that prime the compressor.
IDENTIFIERS = (
    "import from return class function def self this public private static final void string int float bool true false none null "
    "const var let new delete throw raise try except catch finally async await yield lambda print printf console.log request response "
    "session cookie header headers authorization bearer token access_token refresh_token client_id client_secret username password "
    "config settings environment variable getenv os.environ process.env localhost https://www.example.com/api/v1/ http://127.0.0.1:8080/ "
    "application/json content-type text/html charset=utf-8 user-agent index.html document.getElementById addEventListener "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000000000000000 xxxxxxxxxxxxxxxxxxxxxxxx "
    "insert select update where group_by order_by primary_key foreign_key created_at updated_at timestamp datetime version release "
    "node_modules package.json requirements.txt usr/local/bin/python lib/site-packages src/main/java/com/example/ README LICENSE"
)


#: Pieces of ordinary words prime it too, as words of 16 or more letters are measured.
_WORDS = (
    "international information organization administration communication responsibility availability possibilities characteristic "
    "understanding environmental development management government department experience independent revolution traditional "
    "professional constitution transformation implementation representation interpretation investigation mathematical knowledge "
    "national relation station mission vision ability ibility ically ization isation fulness ousness lessness ability ments counter "
    "inter trans under over super micro macro multi pseudo electro photo thermo psycho anti auto hyper infra ultra contra retro "
    "database server client service controller handler manager factory builder provider repository production development staging "
    "connection timeout seconds default network cluster dashboard deployment container kubernetes resource component template "
    "authentication permission validation exception listener interface abstract serialize deserialize initialize "
    "gesellschaft wissenschaft wirtschaft versicherung regierung verwaltung entwicklung verantwortung möglichkeit geschwindigkeit "
    "rechts schutz arbeits kranken bundes landes stadt schiff fahrt dampf donau haupt bahnhof ungen lichkeit ischen keiten "
    "constitution gouvernement développement administrativement naturellement ement ations responsabilidad internacional desarrollo "
    "administración características aciones mente iones idades"
)
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PART = re.compile(r"[A-Za-z0-9]{16,}")
#: The alphabets of keys, narrow before wide; strings in capitals alone count as small letters.
_ALPHABETS = ("0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz234567", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdefABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_STEADY = 256  # from this length on, a random string's cost is in proportion to its length


def _marginal(word: str, around: str) -> int:
    import zstandard as z

    press = z.ZstdCompressor(level=19, write_content_size=False).compress
    before = f"{IDENTIFIERS} {_WORDS}\n{around}\n".encode("utf-8", "replace")
    return len(press(before + word.encode())) - len(press(before))


@functools.lru_cache(None)
def _random_cost(alphabet: str, n: int) -> float:
    """Mean marginal bytes of random strings."""
    draw = random.Random(f"{alphabet} {n}")
    return sum(_marginal("".join(draw.choices(alphabet, k=n)), "") for _ in range(16)) / 16


def _share(word: str, around: str) -> float:
    """Marginal bytes of a string as a share of those of random strings of its length and alphabet."""
    word = word.lower() if word.isupper() else word
    signs = set(word) - set("+/_=-")
    alphabet = next(a for a in _ALPHABETS if signs <= set(a))
    n = min(len(word), _STEADY)
    return _marginal(word, around) * n / (len(word) * _random_cost(alphabet, n))


def _blank(m: re.Match) -> str:
    return " " * len(m.group())


def _novel(text: str, around: int, ratio: float, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Strings outside the spans ``taken``, by start."""
    marks = [m.span() for m in _CONTEXT.finditer(text)]
    kept, at = [], 0
    for a, b in sorted(taken):
        kept += [text[at:a], " " * (b - max(a, at))]
        at = max(at, b)
    text = "".join([*kept, text[at:]])
    runs = [m.span() for m in _RUN.finditer(text)]
    plain = _RUN.sub(_blank, text)
    found: dict[int, list[tuple[int, int]]] = {}

    def novel(k: int) -> list[tuple[int, int]]:
        if k not in found:
            s, e = runs[k]
            near = plain[max(0, s - around) : s] + plain[e : e + around]
            parts = [(s, e)] if _share(text[s:e], near) >= ratio else [m.span() for m in _PART.finditer(text, s, e) if _share(m.group(), near) >= ratio]
            found[k] = parts
        return found[k]

    last, i = -math.inf, 0
    for k, (s, e) in enumerate(runs):
        while i < len(marks) and marks[i][0] < e:
            last, i = max(last, marks[i][1]), i + 1
        if s - last <= around and novel(k):
            last = max(last, e)
    last, i = math.inf, len(marks) - 1
    for k in range(len(runs) - 1, -1, -1):
        s, e = runs[k]
        while i >= 0 and marks[i][1] > s:
            last, i = min(last, marks[i][0]), i - 1
        if last - e <= around and novel(k):
            last = min(last, s)
    return sorted(x for parts in found.values() for x in parts)


def find(text: str | None, around: int = 256, ratio: float = 0.75) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind), by start, then kind in the order of ``KINDS``."""
    text = text or ""
    low = text.lower()
    spans: list[tuple[int, int, str]] = []
    if any(w in low for w in _BASE_WORDS):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT):
        spans += [(s, e, "novel") for s, e in _novel(text, around, ratio, [x[:2] for x in spans])]
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with the union of its spans replaced, each run by one mark."""
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches, around: int, ratio: float, mark: str | None):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        found = [find(t, around, ratio) for t in texts]
        cols = [batch.column(0), pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in f] for f in found], _SPANS)]
        names = ["key", "spans"]
        if mark is not None:
            cols.append(pa.array([t if t is None or not f else redact(t, f, mark) for t, f in zip(texts, found, strict=True)], pa.string()))
            names.append("redacted")
        yield pa.RecordBatch.from_arrays(cols, names)


def scan(df: DataFrame, around: int = 256, ratio: float = 0.75, mark: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans array<struct<kind,start,end>>; with ``mark`` also the text with its secrets replaced by it."""
    src = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    schema = f"key {kind}, spans array<struct<kind:string,start:int,end:int>>" + ", redacted string" * (mark is not None)
    return src.mapInArrow(shipped(__name__, "_scan", around, ratio, mark), schema).withColumnRenamed("key", id_col)


def _redact_rows(batches, around: int, ratio: float, mark: str, at: int):
    for batch in batches:
        texts = batch.column(at).to_pylist()
        new = pa.array([t if t is None or not (f := find(t, around, ratio)) else redact(t, f, mark) for t in texts], pa.string())
        yield batch.set_column(at, batch.schema.names[at], new)


def redacted(df: DataFrame, mark: str = "[SECRET]", around: int = 256, ratio: float = 0.75, text_col: str = "text") -> DataFrame:
    """The table with its secrets replaced; other columns and columns' order stay."""
    return df.mapInArrow(shipped(__name__, "_redact_rows", around, ratio, mark, df.columns.index(text_col)), df.schema)


def joined(spans: str, base_only: bool = False) -> F.Column:
    """kind:start:end of a spans column, comma-joined."""
    c = F.filter(spans, lambda s: s["kind"] != "novel") if base_only else F.col(spans)
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
