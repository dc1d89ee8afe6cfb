"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A text over split_chars characters is handed to the library in parts, cut only where a character that isn't
white space is followed by a blank: no match of the pattern holds both, and none looks back, so the parts'
matches are those of the whole text. Without such a place the part goes on until one comes. Decoding joins raw
token bytes, so a character that several tokens share comes back whole.

A run of over RUN_CHARS characters of white space, on which the library's pattern would exhaust its stack, is one match
but for its last character, if anything follows. That match is encoded as one piece, without the pattern.

Defined results: null and empty texts have no ids (the digests are those of no bytes); strings of special tokens
are ordinary text; a null id stays null; repeated rows give repeated rows; an empty table gives none; columns of
the input that bear a name of a result are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import BINARY, BOOLEAN, LONG, STRING, append_columns, field, strings, table

SPLIT_CHARS = 65_536
#: \S of Python's re leaves out all that any definition calls white space.
SAFE = re.compile(r"\S(?=[ \t\n\r])")
#: White space as the library's patterns know it. Python's also holds U+001C to U+001F.
RUN_CHARS = 10_000
RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN_CHARS)
#: What a pattern must end with for a run to be such a match.
RUN_RULE = r"|\s+(?!\S)|\s+"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class Codec:
    def __init__(self, path: str, pattern: str, split_chars: int = SPLIT_CHARS):
        import tiktoken

        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        self.split_chars, self.runs = split_chars, pattern.endswith(RUN_RULE)

    def parts(self, text: str):
        start = 0
        while len(text) - start > self.split_chars:
            cut = SAFE.search(text, start + self.split_chars)
            if cut is None:
                break
            yield text[start : cut.end()]
            start = cut.end()
        yield text[start:]

    def encode(self, text: str) -> list[int]:
        if len(text) <= min(self.split_chars, RUN_CHARS):
            return self.library.encode_ordinary(text)
        ids, start = [], 0
        for run in RUN.finditer(text) if self.runs else ():
            end = run.end() - (run.end() < len(text))
            for part in self.parts(text[start : run.start()]):
                ids += self.library.encode_ordinary(part)
            ids += self.library._encode_single_piece(text[run.start() : end])
            start = end
        for part in self.parts(text[start:]):
            ids += self.library.encode_ordinary(part)
        return ids

    def decode(self, ids) -> bytes:
        return self.library.decode_bytes(ids)


@functools.lru_cache(maxsize=1)
def worker_codec(path: str, pattern: str, split_chars: int = SPLIT_CHARS) -> Codec:
    """One in a Python worker, whatever number of tasks it runs."""
    return Codec(path, pattern, split_chars)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", split_chars: int = SPLIT_CHARS) -> DataFrame:
    """df with the ids of each text, array<int>, in column out."""

    def make():
        codec = worker_codec(path, pattern, split_chars)

        def fn(column):
            ids = [codec.encode(t) for t in strings(column)]
            return [pa.array(ids, type=pa.list_(pa.int32()))]

        return fn

    return append_columns(df, [text], make, [field(out, T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that each ids column stands for (null ids: no bytes)."""

    def make():
        codec = worker_codec(path, pattern)
        return lambda column: [[codec.decode(x or []) for x in column.to_pylist()]]

    return append_columns(df, [ids], make, [field(out, BINARY)])


def coded(df: DataFrame, path: str, pattern: str, text: str = "text", split_chars: int = SPLIT_CHARS) -> DataFrame:
    """df with ids, n_tokens and exact (whether the ids decode to the text's bytes), in one pass."""

    def make():
        codec = worker_codec(path, pattern, split_chars)

        def fn(column):
            texts = strings(column)
            ids = [codec.encode(t) for t in texts]
            exact = [codec.decode(i) == t.encode() for i, t in zip(ids, texts)]
            return [pa.array(ids, type=pa.list_(pa.int32())), list(map(len, ids)), exact]

        return fn

    return append_columns(df, [text], make, [field("ids", T.ArrayType(T.IntegerType())), field("n_tokens", LONG), field("exact", BOOLEAN)])


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", split_chars: int = SPLIT_CHARS) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256: digests of the ids and of what they decode to."""

    def make():
        codec = worker_codec(path, pattern, split_chars)
        # decimal digits and comma of every id, for digests without a Python object for each id
        names = [b"%d," % i for i in range(codec.library.n_vocab)]

        def one(text):
            ids = codec.encode(text)
            joined = b"".join(map(names.__getitem__, ids))[:-1]
            return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

        return lambda column: list(map(list, zip(*map(one, strings(column))))) or [[], [], []]

    return append_columns(df, [text], make, [field("n_tokens", LONG), field("ids_sha256", STRING), field("decoded_sha256", STRING)])


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
