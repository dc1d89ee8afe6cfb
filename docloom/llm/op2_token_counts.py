"""Token counts by overlap resynchronisation.

A text of at most chunk_chars characters is counted by its pieces (pieces.py). A longer one is encoded in
overlapping chunks with offsets. Two neighbouring chunks are spliced at a character position where both start
a pre-token, and where the left chunk holds at least two further pre-tokens: its split there doesn't depend on
what it doesn't see, and from there on the right chunk scans the same characters from the same state. Where
there is no such position the overlap is doubled, up to encoding both chunks as one; then the next chunk is twice as
long. So the ids are those of the whole text, memory is bounded by the chunk unless a single pre-token is longer, and
what goes to the library is some times the text at most, whatever the text: ten million blanks take a few times as
long as the library alone.

Defined results: null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows give
repeated rows; an empty table gives none; columns of the input that bear a name of a result are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .common import BOOLEAN, LONG, append_columns, field, strings, table, utf8
from .pieces import PieceCache, load_tokenizer, with_blanks

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 2_048
#: A special string cut by an edge of a chunk is not seen there; the longest that a vocabulary here has is shorter.
EDGE_CHARS = 64
LIMIT = 1024


def starts_of(encoding, base: int) -> dict[int, int]:
    """Absolute character position of each pre-token's start -> index of its first token."""
    words, offsets = encoding.word_ids, encoding.offsets
    return {base + offsets[i][0]: i for i in range(len(words) - 1, -1, -1) if i == 0 or words[i] is None or words[i] != words[i - 1]}


def spliced(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[list[int]]:
    """Ids of text, in parts, from overlapping chunks."""

    def encoded(start: int, stop: int):
        return tokenizer.encode(text[start:stop], add_special_tokens=False)

    left, end, step, taken = 0, min(len(text), chunk), chunk, 0
    enc = encoded(left, end)
    while end < len(text):
        here = starts_of(enc, left)
        # the last two pre-tokens, and what a cut special string may have changed, prove nothing
        known = sorted(here)
        sure = [p for p in known[:-2] if p <= end - EDGE_CHARS and here[p] >= taken]
        found, start, width = None, left, overlap
        while sure and found is None:
            start = max(left, end - max(width, end - sure[-1] + EDGE_CHARS))
            if start == left:
                break
            there = starts_of(encoded(start, end), start)
            found = next((p for p in reversed(sure) if p >= start + EDGE_CHARS and p in there), None)
            width *= 2
        stop = min(len(text), end + step)
        if found is not None:
            right = encoded(start, stop)
            there = starts_of(right, start)
            if found in there:
                yield enc.ids[taken : here[found]]
                enc, left, end, taken, step = right, start, stop, there[found], chunk
                continue
        # both chunks as one; the next one is twice as long, so that all work is a constant times the text
        enc, end, step = encoded(left, stop), stop, 2 * step
    yield enc.ids[taken:]


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.tokenizer, self.chunk, self.overlap = load_tokenizer(path), chunk, overlap
        self.cache = PieceCache(self.tokenizer, self.split, lambda text: [i for part in spliced(self.tokenizer, text, self.chunk, self.overlap) for i in part])

    def split(self, text: str) -> list[str] | None:
        """A longer text than a chunk goes whole to the splicing."""
        return with_blanks(text) if len(text) <= self.chunk else None


@functools.lru_cache(maxsize=1)
def worker_counter(path: str, chunk: int, overlap: int) -> Counter:
    """One in a Python worker, whatever number of tasks it runs."""
    return Counter(path, chunk, overlap)


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (n_tokens > limit). path: a file of the tokenizers library, on every node."""

    def make():
        counter = worker_counter(path, chunk, overlap)

        def fn(column):
            n = counter.cache.counts(strings(column))
            return [list(map(len, utf8(column))), n, [x > limit for x in n]]

        return fn

    return append_columns(df, [text], make, [field("n_bytes", LONG), field("n_tokens", LONG), field("over_limit", BOOLEAN)])


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
