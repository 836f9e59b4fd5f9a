"""Ids of whole texts from the tokenizers library, with a cache of words in each Python worker.

A text is cut into words by the tokenizer's own pattern, each word is looked up, and the
library's model encodes the words that are new. Texts for which the cuts aren't certain (special
tokens, characters that the library would compose anew) go to the library whole.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words of at most so many characters are kept, so many of them in a worker.
WORD_CHARS, WORDS = 48, 400_000
#: White space and words as the byte-level tokenizer's pattern has them, and the words of the tokenizer that drops white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{SPACE}{LN}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|[^{SPACE}{LN}]+"


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """Cuts a text into the matches of ``pattern``; texts of ASCII or Latin-1 take a shorter way to the same."""

    def filled(letters: str, digits: str, space: str) -> str:
        values = {"{LN}": letters + digits, "{L}": f"[{letters}]", "{N}": f"[{digits}]", "{SPACE}": space}
        return re.sub("|".join(map(re.escape, values)), lambda m: values[m[0]], pattern)

    ascii_ = re.compile(filled("a-zA-Z", "0-9", r"\t-\r ")).findall
    latin = re.compile(filled(r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0")).findall
    whole = regex.compile(filled(r"\p{L}", r"\p{N}", SPACE)).findall

    def cut(text: str) -> list[str]:
        if text.isascii():
            return ascii_(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return latin(text)

    return cut


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Known(dict):
    """The ids of the words that this worker has met, at most ``most`` of them, as little-endian 16-bit integers; ``encode`` encodes another one."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        self.keep(word, ids)
        return ids

    def keep(self, word: str, ids: bytes) -> None:
        if len(word) <= WORD_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids


class LibraryEncoder:
    """Encodes texts to little-endian 16-bit ids by a tokenizer of the library whose words are ``pattern`` and whose letters stand for bytes."""

    def __init__(self, tokenizer, pattern: str, lower: bool, words: int):
        self.tokenizer, self.cut, self.lower = tokenizer, cutter(pattern), lower
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.letters = {b: c for c, b in byte_letters().items()}
        self.model = tokenizer.model
        self.known = Known(self.word, words)

    def word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}H", *ids)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2").tobytes()

    def words(self, text: str) -> list[str] | None:
        """The text's words, or None if the library has to find them."""
        if any(s in text for s in self.special):
            return None
        if self.lower:
            if not text.isascii() and not unicodedata.is_normalized("NFC", text):
                return None
            # Letter by letter where lower case depends on the place in a word, which the library ignores.
            text = "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()
        return self.cut(text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids = self.known.__getitem__
        return [self.whole(t) if (words := self.words(t)) is None else b"".join(map(ids, words)) for t in texts]


_encoders: dict[tuple[str, int], LibraryEncoder] = {}


def encoder(path: str, words: int = WORDS) -> LibraryEncoder:
    """This worker's encoder for a tokenizer file of at most 65,536 ids, which keeps as many ``words``."""
    if (path, words) not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        if tokenizer.get_vocab_size() > 65_536:
            raise ValueError(f"{path} has more ids than 16 bits hold")
        spec = json.loads(tokenizer.to_str())
        drops = (spec["pre_tokenizer"] or {}).get("type") == "Sequence"
        _encoders[path, words] = LibraryEncoder(tokenizer, WORD_PATTERN if drops else PATTERN, spec["normalizer"] is not None, words)
    return _encoders[path, words]


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 2**24) -> None:
    """Whole texts may be long: fewer rows and bytes in an Arrow batch. The settings stay with the session, as plans are run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ids_column(text: Column, path: str, end_id: int | None = None) -> Column:
    """The ids of each text (null: empty) as little-endian 16-bit integers in a binary column, ``end_id`` last if given."""
    end = b"" if end_id is None else np.array([end_id], "<u2").tobytes()

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path)
        for texts in batches:
            yield pd.Series([ids + end for ids in encode([t or "" for t in texts])])

    return ids(text)


def wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2").astype("<u4")


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
