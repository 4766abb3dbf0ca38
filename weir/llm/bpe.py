"""Byte-pair encoding by prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that can end its encoding. It is found from the tokens
that are suffixes of the prefix: the right one is compatible with the last token of what precedes it. A stored table of
these last tokens gives the encoding of every prefix, so that text can be appended without encoding it again, and an
edit costs the pieces near it.
"""

from __future__ import annotations

import base64
import bisect
import re
from array import array
from collections.abc import Callable

import regex

#: Fixed value: the pattern by which the byte_bpe vocabularies split text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The longest piece or word whose ids are remembered, and how many are before the memory starts anew; results don't depend on it.
MEMO_CHARS, MEMO_ENTRIES = 48, 300_000
#: A space that any white space follows, and a split at the spaces that none follows.
SPACE_RUN, WORD_START = re.compile(r" (?=\s|$)").search, re.compile(r" (?=\S)").split
#: Characters that the longest fixed alternative of the pattern may look ahead, with one more for its negative lookahead.
LOOKAHEAD = 4


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens and ids of a rank file: a token in base64 and its id a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class Memo(dict):
    """Values of a function of a text, kept while the texts are short and not too many."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        value = self.make(text)
        if len(text) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[text] = value
        return value


class Vocabulary:
    """Encodes texts. Ids are packed as native 32-bit integers, as those of a whole text are then one join of bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.reach: dict[bytes, int] = {}  # by the two bytes that a token ends in: the length of the longest such token
        for token in ranks:
            self.reach[token[-2:]] = max(len(token), self.reach.get(token[-2:], 0))
        self.split = regex.compile(pattern).findall
        self.find = regex.compile(pattern).finditer
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._ends: dict[int, list[tuple[bytes, int, int]]] = {}
        self._begins: dict[int, list[tuple[bytes, int, int]]] = {}
        self._joins: dict[tuple[int, int], bool] = {}
        self.pieces = Memo(lambda piece: array("i", self.encode_piece(piece)).tobytes())
        pieces = self.pieces.__getitem__
        self.heads = Memo(lambda word: b"".join(map(pieces, self.split(word))))
        self.words = Memo(lambda word: b"".join(map(pieces, self.split(" " + word))))

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self._parts:
            own = self.bytes_of[token]
            ids = [self.ranks[own[i : i + 1]] for i in range(len(own))]
            while len(ids) > 2:
                merges = [self.ranks.get(self.bytes_of[a] + self.bytes_of[b], token) for a, b in zip(ids, ids[1:])]
                best = min(merges)
                at = merges.index(best)
                ids[at : at + 2] = [best]
            self._parts[token] = (ids[0], ids[1]) if len(ids) == 2 else None
        return self._parts[token]

    def border(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The parts of a token that touch its end (side 1) or its start (side 0): bytes, and the ranks that make and use up each."""
        known = (self._begins, self._ends)[side]
        if token not in known:
            out, until, at = [], len(self.ranks) + 1, token
            while True:
                halves = self.parts(at)
                out.append((self.bytes_of[at], at if halves else -1, until))
                if halves is None:
                    break
                at, until = halves[side], at
            known[token] = out
        return known[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes stand side by side.

        At any time during the merges, one part of each token lies at the border. A merge across it happens if its rank
        comes before both of these parts are used up; of equal ranks the one further left goes first.
        """
        known = self._joins.get((left, right))
        if known is None:
            get, known = self.ranks.get, True
            for b, b_from, b_until in self.border(right, 0):
                for a, a_from, a_until in self.border(left, 1):
                    rank = get(a + b)
                    if rank is not None and a_from < rank < a_until and b_from < rank <= b_until:
                        known = False
                        break
                if not known:
                    break
            if len(self._joins) > 2 * MEMO_ENTRIES:
                self._joins.clear()
            self._joins[left, right] = known
        return known

    def last_tokens(self, piece: bytes, last: array | None = None) -> array:
        """The last token of each prefix of the piece; `last` holds those that are known already and is extended."""
        last = array("i") if last is None else last
        ranks, reach, compatible = self.ranks, self.reach.get, self.compatible
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, end - reach(piece[max(0, end - 2) : end], 1)), end):
                token = ranks.get(piece[start:end])
                if token is not None and (start == 0 or compatible(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def unwind(self, last: array, piece_len: int) -> list[int]:
        """The encoding of a prefix, read backwards from its last token."""
        out: list[int] = []
        while piece_len:
            out.append(last[piece_len - 1])
            piece_len -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.unwind(self.last_tokens(data), len(data))

    def pack(self, text: str | None) -> bytes:
        """Ids of a text as bytes; none for a null or empty one.

        A piece always starts at a space that a visible character follows, so that texts fall apart there into words,
        most of which were met before.
        """
        if not text:
            return b""
        words = WORD_START(text) if SPACE_RUN(text) else text.split(" ")
        if text[0] == " ":
            if not words[0]:  # the text starts with a word's own space
                return b"".join(map(self.words.__getitem__, words[1:]))
        return self.heads[words[0]] + b"".join(map(self.words.__getitem__, words[1:]))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.pack(text)).tolist()

    def count(self, text: str | None) -> int:
        return len(self.pack(text)) // 4

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")


class Encoded:
    """A text with the last tokens of every byte prefix of its pieces, for exact appends and edits."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, ""
        self.starts: list[int] = []  # of the pieces, in characters
        self.pieces: list[bytes] = []
        self.tables: list[array] = []
        self.encoded_bytes = 0  # how much work was done so far
        self.replace(0, 0, text)

    def ids(self) -> list[int]:
        return [i for piece, table in zip(self.pieces, self.tables) for i in self.vocabulary.unwind(table, len(piece))]

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, text: str) -> None:
        """Puts text in place of the characters from start to end.

        Splitting begins anew at a piece that ends too early to have seen the edit, and stops at the first border behind
        the edit that was one before. A piece that only grew keeps its table and continues it.
        """
        grown, old_text = len(text) - (end - start), self.text
        self.text = old_text[:start] + text + old_text[end:]
        first = max(0, bisect.bisect_right(self.starts, max(0, start - LOOKAHEAD)) - 1)
        begin = self.starts[first] if self.starts else 0
        old_border = {s + grown: i for i, s in enumerate(self.starts) if i >= first and s >= end}
        old_border[len(self.text)] = len(self.starts)
        starts, pieces, tables, after = [], [], [], len(self.starts)
        for match in self.vocabulary.find(self.text, begin):
            if match.start() in old_border and match.start() >= start + len(text):
                after = old_border[match.start()]
                break
            data = match.group().encode("utf-8", "surrogatepass")
            at, table = first + len(pieces), array("i")
            if at < len(self.pieces) and data.startswith(self.pieces[at]):
                table = self.tables[at][:]
            self.encoded_bytes += len(data) - len(table)
            starts.append(match.start())
            pieces.append(data)
            tables.append(self.vocabulary.last_tokens(data, table))
        self.starts[first:] = starts + [s + grown for s in self.starts[after:]]
        self.pieces[first:] = pieces + self.pieces[after:]
        self.tables[first:] = tables + self.tables[after:]
