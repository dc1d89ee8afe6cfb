"""Encoding through pieces that no token crosses, so that each distinct piece is encoded once.

A piece is a run of blanks and the run of other characters behind it. A pre-tokenizer that never joins a
character that isn't white space with white space behind it splits at every start of a piece, whatever
stands around, so the tokens of a text are the tokens of its pieces. Where a piece ends in white space that
is no blank (U+00A0 and the like) this doesn't hold, and a text with such a character is encoded whole.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: Letters that neither composition nor lower case turns into several characters, and marks behind them: one word, or two.
PLAIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+[.,;:!?%&$#()\"-]*")
#: White space by any of the libraries' definitions, but for the four blanks.
OTHER = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


class Numbers(dict):
    """A number for each piece, in the order in which they first come up; fresh: those since the last look."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number


class PieceCache:
    """Ids of texts, each distinct piece being encoded once; when pieces of over max_chars are known, all are forgotten.

    split: a text's pieces, or None for a text that must be encoded whole. whole: encodes a text; the library's by default.
    Pieces go to the library in texts of TOGETHER, parted by a string that it never joins with what stands beside it: cut,
    with the one token that it gives, or else one of the special tokens, at which the library cuts a text before it does
    anything else. So what stands beside a piece never changes its ids. Where tokens that end a word bear word_end, pieces
    of plain letters and marks behind them are parted by blanks, and told apart by the words that they must hold.
    """

    TOGETHER = 200

    def __init__(self, tokenizer, split, whole=None, cut: str | None = None, word_end: str | None = None, max_chars: int = 9_000_000):
        self.tokenizer, self.max_chars = tokenizer, max_chars
        self.whole = whole or (lambda text: tokenizer.encode(text, add_special_tokens=False).ids)
        added = tokenizer.get_added_tokens_decoder()
        # a special string that takes white space along would reach over the pieces' borders
        reaching = any(t.lstrip or t.rstrip or t.single_word or t.content.split() != [t.content] for t in added.values())
        self.split = (lambda text: None) if reaching else split
        self.strings = [t.content for t in added.values()]
        own = tokenizer.encode(cut, add_special_tokens=False).ids if cut else []
        self.cut = (cut, own[0]) if len(own) == 1 else next(((t.content, i) for i, t in sorted(added.items()) if t.special and not t.normalized), None)
        self.last = None
        if word_end:
            self.last = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
            self.last[[i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(word_end)]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.lengths, self.starts, self.chars = Numbers(), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def learn(self, pieces: list[str]) -> None:
        self.chars += sum(map(len, pieces))
        plain = np.fromiter(map(bool, map(PLAIN.fullmatch, pieces)), bool, len(pieces)) if self.last is not None else np.zeros(len(pieces), bool)
        ids, lengths, base = [self.ids], np.zeros(len(pieces), np.int64), len(self.lengths)
        order = []
        for chosen, encode in ((np.flatnonzero(plain), self.plain_groups), (np.flatnonzero(~plain), self.cut_groups)):
            found, sizes = encode([pieces[i] for i in chosen])
            ids += found
            lengths[chosen] = np.concatenate([np.zeros(0, np.int64), *sizes])
            order.append(chosen)
        order = np.concatenate(order)
        starts = np.zeros(len(pieces), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order] + len(self.ids)
        self.ids, self.lengths, self.starts = np.concatenate(ids), np.concatenate([self.lengths, lengths]), np.concatenate([self.starts, starts])

    def grouped(self, pieces: list[str], between: str, size: int):
        """Groups of pieces, their text, and its ids."""
        for first in range(0, len(pieces), 20 * size):
            groups = [pieces[i : i + size] for i in range(first, min(len(pieces), first + 20 * size), size)]
            joined = [between.join(g) for g in groups]
            for group, text, enc in zip(groups, joined, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                yield group, text, np.array(enc.ids, np.uint32)

    def one_by_one(self, group: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in group]
        return np.fromiter(chain.from_iterable(parts), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts))

    def plain_groups(self, pieces: list[str]) -> tuple[list, list]:
        """Ids of the pieces, and how many each has."""
        ids, lengths = [], []
        for group, _, found in self.grouped(pieces, " ", self.TOGETHER):
            words = np.cumsum(np.fromiter((1 if p[-1].isalpha() else 2 for p in group), np.int64, len(group)))
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) == words[-1] and ends[-1] == len(found):
                sizes = np.diff(np.concatenate([[0], ends[words - 1]]))
            else:
                found, sizes = self.one_by_one(group)
            ids.append(found)
            lengths.append(sizes)
        return ids, lengths

    def cut_groups(self, pieces: list[str]) -> tuple[list, list]:
        ids, lengths = [], []
        between, token = self.cut or ("", -1)
        for group, text, found in self.grouped(pieces, between, self.TOGETHER if self.cut else 1):
            cuts = np.flatnonzero(found == token)
            if len(cuts) == len(group) - 1 and not any(s in text for s in self.strings if s != between):
                sizes = np.diff(np.concatenate([[-1], cuts, [len(found)]])) - 1
                found = np.delete(found, cuts)
            else:  # a piece holds one of the strings
                found, sizes = self.one_by_one(group)
            ids.append(found)
            lengths.append(sizes)
        return ids, lengths

    def numbered(self, texts: list[str]) -> tuple[list[list | None], np.ndarray, np.ndarray]:
        """Pieces of each text, all pieces' numbers, and where each text's numbers end."""
        if self.chars > self.max_chars:
            self.forget()
        split = [self.split(t) for t in texts]
        counts = np.fromiter((len(ps or ()) for ps in split), np.int64, len(split))
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(ps or () for ps in split)), np.int64, int(counts.sum()))
        if self.known.fresh:
            self.learn(self.known.fresh)
            self.known.fresh = []
        return split, numbers, np.cumsum(counts)

    def counts(self, texts: list[str]) -> list[int]:
        split, numbers, ends = self.numbered(texts)
        before = np.concatenate([[0], np.cumsum(self.lengths[numbers])])
        found = np.diff(before[np.concatenate([[0], ends])]).tolist()
        return [len(self.whole(t)) if ps is None else n for t, ps, n in zip(texts, split, found)]

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        split, numbers, ends = self.numbered(texts)
        lengths = self.lengths[numbers]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.starts[numbers] - before[:-1], lengths) + np.arange(before[-1])]
        parts = np.split(ids, before[ends[:-1]]) if len(texts) else []
        return [np.array(self.whole(t), np.uint32) if ps is None else part for t, ps, part in zip(texts, split, parts)]


def with_blanks(text: str) -> list[str] | None:
    """Pieces for pre-tokenizers that keep white space."""
    if OTHER.search(text):
        return None
    return PIECE.findall(text)


#: For pre-tokenizers that drop white space: a control character between blanks is a token of its own.
CONTROL_CUT = " \x01 "


def without_blanks(text: str) -> list[str] | None:
    """Pieces for pre-tokenizers that drop white space. Python alone counts U+001C to U+001F as such."""
    return None if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


def load_tokenizer(path: str):
    """The tokenizers library on one thread: the tasks of an executor already use its cores."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer
