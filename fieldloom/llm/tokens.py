"""Token ids of a ``tokenizers`` word-BPE file, fast for natural text and exact for any.

The file's normaliser and splitter work on one character at a time and white space always separates words,
so a white-space chunk has the same ids wherever it stands. Chunks of Basic Latin to U+017F (no combining
marks, hence already in NFC) are split here, and each new word is merged once with the file's own ranks;
any text with another character or with a special token's opening ``<|`` goes to ``tokenizers`` whole.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: Characters below U+0180 by the classes that the tokenizer file's splitter names.
_SPACE = "\t-\r \x85\xa0"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")
_GAP = re.compile(f"[{_SPACE}]+")
#: The highest UTF-8 lead byte of a character below U+0180.
_LAST_LEAD = 0xC5
_ODD = "\x1c\x1d\x1e\x1f"  # str.split() splits at these, the tokenizer does not
_STOPS = frozenset(".,;:!?")
_END = b"\xff"  # never part of UTF-8: marks a word's end in the merge ranks


class WordBPE:
    """``ids(text)`` as little-endian unsigned 32-bit bytes, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    CACHE = 100_000  # chunks remembered before the memory is given back; affects speed alone

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.slow = Tokenizer.from_file(path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        to_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {}
        for token, i in vocab.items():
            if token.startswith("<|"):
                continue
            core, end = (token[:-4], _END) if token.endswith("</w>") else (token, b"")
            ranks[bytes(to_byte[c] for c in core) + end] = i
        self.merge = Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            low, merge = chunk.lower(), self.merge
            if low.isalpha():
                found = merge(low.encode() + _END)
            elif low[-1] in _STOPS and low[:-1].isalpha():
                found = merge(low[:-1].encode() + _END) + merge(low[-1].encode() + _END)
            else:
                found = []
                for w in _WORD.findall(low):
                    found += merge(w.encode() + _END)
            ids = array("I", found).tobytes()
        self.chunks[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return b""
        if "<|" in text or np.frombuffer(raw, np.uint8).max() > _LAST_LEAD:
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.chunks) > self.CACHE:  # frequent chunks come back from the older half
            self.older, self.chunks = self.chunks, {}
        chunks = [c for c in _GAP.split(text) if c] if any(c in text for c in _ODD) else text.split()
        get, new = self.chunks.get, self._chunk
        return b"".join([get(c) or new(c) for c in chunks])


    def forget(self) -> None:
        """Empties the cache; a worker lives on after its task."""
        self.chunks, self.older = {}, {}


_loaded: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    """One tokenizer per worker process."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]
