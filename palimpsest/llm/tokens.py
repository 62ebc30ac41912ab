"""Token counts with a whole-token shortcut, and token ids with a cache of pre-tokens.

The library's own pre-tokenisation is reproduced for texts whose characters all lie in a fixed Latin range, where
both sides classify every character alike (the tests compare them character by character); each other text is
given to the library whole. Vocabulary strings that the library encodes alone as one token are proven once, on the
driver, before any text is read, and handed to the tasks; a pre-token among them counts 1 without merging. The rest go to the library, one call for each
different pre-token, kept in a bounded cache.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters on which the Python and library classes agree, and number forms that are not digits.
OUTSIDE = re.compile("[^\t-\r -~\xa0-ɏ‐-‧‰-⁞€]")
OTHER_NUMBERS = "²³¹¼½¾"
LETTER, NUMBER, OTHER = rf"[^\W\d_{OTHER_NUMBERS}]", rf"[\d{OTHER_NUMBERS}]", r"(?:[^\w\s]|_)"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
WORDS = re.compile(f"{ENDINGS}|{LETTER}+|{NUMBER}|{OTHER}+")
PIECES = re.compile(rf"{ENDINGS}| ?{LETTER}+| ?{NUMBER}+| ?{OTHER}+|\s+(?!\S)|\s+")
CACHE = 800_000

_loaded: dict = {}


def tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def special_strings(path: str) -> list[str]:
    """The added tokens' strings, which the library cuts out of a text before anything else; longer ones first."""
    added = [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
    return sorted(added, key=len, reverse=True)


def whole_tokens(path: str, end: str = "</w>") -> set[str]:
    """The strings of the vocabulary's word-final entries that the library encodes, alone, as that one token."""
    tok = tokenizer(path)
    bytes_of = {ch: b for b in range(256) if len(ch := _byte_char(b)) == 1}
    vocab, texts, ids = tok.get_vocab(with_added_tokens=False), [], []
    for entry, i in vocab.items():
        if entry.endswith(end):
            try:
                texts.append(bytes(bytes_of[c] for c in entry[: -len(end)]).decode())
                ids.append(i)
            except (KeyError, UnicodeDecodeError):
                pass
    return {t for t, i, e in zip(texts, ids, tok.encode_batch(texts, add_special_tokens=False)) if e.ids == [i] and t}


def _byte_char(b: int) -> str:
    """The printable character that byte-level vocabularies use for a byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(b) if b in shown else chr(256 + sorted(set(range(256)) - set(shown)).index(b))


class Texts(dict):
    """A cache of pre-tokens, with what is known of the file's special strings."""

    def __init__(self, path: str, most: int):
        super().__init__()
        strings = special_strings(path)
        self.tok, self.most = tokenizer(path), most
        self.special = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None
        self.mark = os.path.commonprefix(strings)  # found faster than the pattern

    def has_special(self, text: str) -> bool:
        return self.special is not None and self.mark in text and self.special.search(text) is not None


class Counter(Texts):
    """Pre-token -> number of tokens."""

    def __init__(self, path: str, most: int, whole: Iterable[str]):
        super().__init__(path, most)
        self.update(dict.fromkeys(whole, 1))
        self.most += len(self)

    def __missing__(self, word: str) -> int:
        n = len(self.tok.encode(word, add_special_tokens=False).ids)
        if len(self) < self.most:
            self[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.has_special(text):
            return sum(i % 2 or self.count(x) for i, x in enumerate(self.special.split(text)))
        if OUTSIDE.search(text):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return sum(map(self.__getitem__, WORDS.findall(text.lower())))


class Encoder(Texts):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def raw(self, text: str) -> bytes:
        ids = array.array("I", self.tok.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.raw(piece)
        if len(self) < self.most:
            self[piece] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.has_special(text) or OUTSIDE.search(text):
            return self.raw(text)
        return b"".join(map(self.__getitem__, PIECES.findall(text)))


def kept(kind, path: str, most: int, *more):
    """One counter or encoder for each file and Python worker; a smaller bound makes a new one."""
    if (kind, path) not in _loaded or _loaded[kind, path][0] != most:
        _loaded[kind, path] = most, kind(path, most, *more)
    return _loaded[kind, path][1]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, cache: int = CACHE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; special strings inside texts count as the library counts them.
    Repeated rows give repeated rows, null ids stay, other columns are not read, an empty table gives an empty table.
    No shuffle: each scan task streams its batches and holds one batch, the proven strings (broadcast; as many as the
    vocabulary has at most) and a cache of `cache` pre-tokens.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    if ("whole", path) not in _loaded:
        _loaded["whole", path] = sorted(whole_tokens(path))
    whole = docs.sparkSession.sparkContext.broadcast(_loaded["whole", path])

    def run(batches):
        c = kept(Counter, path, cache, whole.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.count(t) for t in b.column(2).to_pylist()], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
