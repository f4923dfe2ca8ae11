"""Token counts of byte-level BPE at every prefix of a text (operator 10).

A piece (what the pattern below cuts out) is encoded by dynamic programming over its prefixes: the
encoding of a prefix ends in the one vocabulary token whose start is the end of a shorter prefix
and which follows that prefix's last token in a valid pair; a pair is valid if encoding its bytes
gives just the pair. So every prefix has its exact count, and a text is the sum of its pieces.
The tokens that end at a byte are read off a trie with links (Aho and Corasick), the longest first.

Of many texts the pieces not met before are encoded in order, so that each begins with the prefixes
that it shares with the one before.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import accumulate, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import shipped, text_or_empty

#: Tokens beyond which a text counts as over the limit.
LIMIT = 512
#: Pieces whose counts a worker keeps at most; then it drops those that were not met of late.
KEPT_PIECES = 500_000
#: Characters of the longest piece that is kept.
LONGEST_KEPT = 255
#: Bytes of the texts whose pieces are held at a time.
AT_ONCE = 2_000_000
NEVER = 1 << 60
#: Longer pieces are plain letters, numbers, marks or white space: no contraction, no special token.
SHORT_PIECE = 24
# The white space and the pieces of this family of vocabularies: fixed values.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = r"'(?:s|t|re|ve|m|ll|d)| ?{L}+| ?{N}+| ?[^{S}{LN}]+|[{S}]+(?![^{S}])|[{S}]+"
_ANY = regex.compile(_PIECES.format(L=r"\p{L}", N=r"\p{N}", LN=r"\p{L}\p{N}", S=_SPACE))
# Where \d and the other word characters are just the numbers and letters, the quicker library does.
_ODD = re.compile("[^\\x00-\\u024f]|[\\xb2\\xb3\\xb9\\xbc-\\xbe]")
_LATIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:_|[^\w{S}])+|[{S}]+(?![^{S}])|[{S}]+".format(S=_SPACE))
_TAIL_SPACE = re.compile(f"[{_SPACE}]+\\Z")


def _cut(text: str) -> list[str]:
    """The pieces of a text without special tokens."""
    return (_LATIN if text.isascii() or not _ODD.search(text) else _ANY).findall(text)


def _bytes_of_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabulary files: printable bytes for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Totals(dict):
    """Tokens of whole pieces; one that is not here is counted."""

    def __init__(self, count: Callable[[str], int]) -> None:
        super().__init__()
        self.count = count

    def __missing__(self, piece: str) -> int:
        return self.count(piece)


class PrefixCounter:
    """Counts of all prefixes of pieces and texts, for the vocabulary in a tokenizers file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = _bytes_of_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        special = [t["content"] for t in model["added_tokens"] if t["special"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.tokens = [raw(t) for t in model["model"]["vocab"] if t not in special]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.made = {a + b: (a, b, i) for (a, b), i in self.ranks.items()}
        self.edges: tuple[dict, dict] = ({}, {})
        #: whether a token (by its number) follows another; before the first one is the number -1
        self.valid: dict[int, bool] = {}
        self.latest: tuple[bytes, list[int], list[int], list[int]] = b"", [], [], []
        self.totals, self.older = Totals(self.count), {}
        self._link()

    def _link(self) -> None:
        """The trie of the tokens; of each state the longest token that ends there, of each token the next shorter one."""
        self.lengths = list(map(len, self.tokens))
        self.goto: dict[int, int] = {}  # by state and byte
        whole, depth = [-1], [0]  # by state
        for number, token in enumerate(self.tokens):
            state = 0
            for byte in token:
                if (child := self.goto.get(state << 8 | byte)) is None:
                    child = self.goto[state << 8 | byte] = len(whole)
                    whole.append(-1)
                    depth.append(depth[state] + 1)
                state = child
            whole[state] = number
        self.back, self.ends, self.shorter = [0] * len(whole), whole, [-1] * len(self.tokens)
        for key, child in sorted(self.goto.items(), key=lambda x: depth[x[1]]):
            state, byte, found = key >> 8, key & 255, None
            while state and found is None:
                state = self.back[state]
                found = self.goto.get(state << 8 | byte)
            self.back[child] = found or 0
            less = self.ends[self.back[child]]
            if whole[child] < 0:
                self.ends[child] = less
            else:
                self.shorter[whole[child]] = less

    def merged(self, piece: bytes) -> list[bytes]:
        """The encoding of a short byte string, merge by merge."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            pair = parts[best], parts[best + 1]
            if pair not in self.ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def edge(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The parts at one edge of a token while it is merged, each with the merge that ends it."""
        known = self.edges[right]
        if (chain := known.get(token)) is None:
            rank, chain, part = NEVER, [], token
            while True:
                chain.append((part, rank))
                if part not in self.made:
                    break
                *halves, rank = self.made[part]
                part = halves[right]
            known[token] = chain = chain[::-1]
        return chain

    def apart(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens side by side stay as they are: no merge across their border comes first."""
        left, right = self.edge(a, True), self.edge(b, False)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = self.ranks.get((x, y), NEVER)
            if across < x_ends and across <= y_ends and across != NEVER:  # of equal merges the left one comes first
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def follows(self, last: int, token: int) -> bool:
        if len(self.valid) > KEPT_PIECES * 2:
            self.valid.clear()
        own = self.tokens[token]
        found = self.merged(own) == [own] if last < 0 else self.apart(self.tokens[last], own)
        self.valid[last * len(self.tokens) + token] = found
        return found

    def _prefixes(self, piece: str) -> list[int]:
        """Of each byte prefix the tokens; what the piece before it began with is taken from there."""
        goto, back, ends, valid = self.goto, self.back, self.ends, self.valid
        lengths, shorter, size = self.lengths, self.shorter, len(self.tokens)
        data, (known, counts, lasts, states), done = piece.encode(), self.latest, 0
        for byte, other in zip(data, known, strict=False):
            if byte != other:
                break
            done += 1
        self.latest = b"", [], [], []
        if not done:
            counts, lasts, states = [0], [-size], [0]  # the last token's number, times their number
        del counts[done + 1 :], lasts[done + 1 :], states[done + 1 :]
        state = states[done]
        for end in range(done + 1, len(data) + 1):
            byte = data[end - 1]
            while (found := goto.get(state << 8 | byte)) is None:
                if not state:
                    raise ValueError("the vocabulary lacks a byte")
                state = back[state]
            state, token = found, ends[found]
            while token >= 0:
                last = lasts[start := end - lengths[token]]
                if (fits := valid.get(last + token)) is None:
                    fits = self.follows(last // size, token)
                if fits:
                    counts.append(counts[start] + 1)
                    lasts.append(token * size)
                    states.append(state)
                    break
                token = shorter[token]
            else:
                raise ValueError("the vocabulary lacks a byte")
        self.latest = data, counts, lasts, states
        return counts

    def piece(self, piece: str) -> list[int]:
        """Tokens of each byte prefix of a piece, the empty one included."""
        return self._prefixes(piece)[:]

    def count(self, piece: str) -> int:
        """Tokens of a piece, which are kept."""
        if (found := self.totals.get(piece, self.older.get(piece))) is None:
            special = self.special is not None and self.special.fullmatch(piece)
            found = 1 if special else self._prefixes(piece)[-1]
        if len(piece) <= LONGEST_KEPT:
            if len(self.totals) >= KEPT_PIECES // 2:
                self.totals, self.older = Totals(self.count), self.totals
            self.totals[piece] = found
        return found

    def pieces(self, text: str) -> Iterator[str]:
        """The pieces of a text; a special token is one piece."""
        if self.special is None or not self.special.search(text):
            return iter(_cut(text))
        return self._with_special(text)

    def _with_special(self, text: str) -> Iterator[str]:
        at = 0
        for m in self.special.finditer(text):
            yield from _cut(text[at : m.start()])
            yield m[0]
            at = m.end()
        yield from _cut(text[at:])

    def text(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)

    def texts(self, texts: list[str]) -> Iterator[PrefixTable]:
        """The same of many texts, whose new pieces are counted in order."""
        parts = [list(self.pieces(text)) for text in texts]
        for piece in sorted(set().union(*parts) - self.totals.keys()):
            self.count(piece)
        yield from map(PrefixTable, repeat(self), texts, parts)


class PrefixTable:
    """One text's pieces with the tokens before each, from which any prefix is answered."""

    def __init__(self, counter: PrefixCounter, text: str, parts: list[str] | None = None) -> None:
        self.counter, self.string = counter, text
        self.parts = list(counter.pieces(text)) if parts is None else parts
        self.counts = list(map(counter.totals.__getitem__, self.parts))
        self.total = sum(self.counts)

    @cached_property
    def starts(self) -> list[int]:
        return [0, *accumulate(map(len, self.parts))]

    @cached_property
    def before(self) -> list[int]:
        return [0, *accumulate(self.counts)]

    def at(self, chars: int) -> int:
        """Tokens of the text's first ``chars`` characters, as if they were encoded alone."""
        if chars <= 0:
            return 0
        if chars >= len(self.string):
            return self.total
        k = bisect_right(self.starts, chars) - 1
        special = self.counter.special
        if special is not None and k < len(self.parts) and special.fullmatch(self.parts[k]) and chars > self.starts[k]:
            # a cut special token is plain text, and joins the piece before it
            first = max(0, k - 1) if not (k and special.fullmatch(self.parts[k - 1])) else k
            tail = self.string[self.starts[first] : chars]
            return self.before[first] + sum(map(self.counter.count, self.counter.pieces(tail)))
        if m := _TAIL_SPACE.search(self.string, max(0, chars - 1), chars):
            # white space at the end is one piece, however the whole text cuts it
            start = chars
            while start and _TAIL_SPACE.fullmatch(self.string[start - 1]):
                start -= 1
            j = bisect_right(self.starts, start) - 1
            return self.before[j] + self.counter.piece(self.string[start : m.end()])[-1]
        part = self.string[self.starts[k] : chars]
        if part in ("'r", "'v", "'l"):
            return self.before[k] + self.counter.piece("'")[-1] + self.counter.piece(part[1:])[-1]
        return self.before[k] + (self.counter.piece(self.parts[k])[len(part.encode())] if part else 0)

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix that has at most ``budget`` tokens."""
        if self.total <= budget:
            return len(self.string)
        # white space cut at the end can save tokens, but only those of its own pieces
        k = bisect_right(self.before, budget)
        while k < len(self.parts) and _TAIL_SPACE.fullmatch(self.parts[k]):
            k += 1
        for j in range(min(k, len(self.parts) - 1), -1, -1):
            if found := self._longest_in(j, budget):
                return found
        return 0

    def _longest_in(self, j: int, budget: int) -> int:
        """The longest prefix within the budget that ends in a piece, past its start; 0 without one."""
        first, start, end = j, self.starts[j], self.starts[j + 1]
        least = start + 1
        if end - start > SHORT_PIECE:
            if space := _TAIL_SPACE.fullmatch(self.parts[j]):
                while first and _TAIL_SPACE.fullmatch(self.parts[first - 1]):
                    first -= 1
            run = self.string[self.starts[first] : end]
            counts = self.counter.piece(run)
            left, at = budget - self.before[first], len(counts) - 1
            least = start + 1 if space else start + 2  # a single leading blank is left to at()
            for chars in range(end, least - 1, -1):
                if counts[at] <= left:
                    return chars
                at -= len(self.string[chars - 1].encode())
            end = least - 1
        return next((chars for chars in range(end, start, -1) if self.at(chars) <= budget), 0)


_LOADED: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of this process for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = PrefixCounter(path)
    return _LOADED[path]


def token_counts(df: DataFrame, path: str, budget: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row its key, ``n_bytes`` and ``n_tokens`` of the whole text, and ``budget_bytes``.

    ``budget_bytes``: UTF-8 bytes of the longest prefix of at most ``budget`` tokens, read from the
    prefix counts. Null and empty texts have 0 of each. Keys are carried as they are, null or
    repeated; no rows give no rows; other columns are not read.
    """
    shipped(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").alias("_key"), text_or_empty(text).alias("_text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = batch.column("_text")
            sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
            part = np.cumsum(sizes) // AT_ONCE
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
            for first, end in pairwise(bounds):
                tokens, fits = [], []
                for table, n in zip(own.texts(texts[first:end].to_pylist()), sizes[first:end].tolist(), strict=True):
                    tokens.append(table.total)
                    fits.append(n if table.total <= budget else len(table.string[: table.longest(budget)].encode()))
                arrays = [batch.column("_key")[first:end], *[pa.array(x, pa.int64()) for x in (sizes[first:end], tokens, fits)]]
                yield pa.RecordBatch.from_arrays(arrays, ["_key", "n_bytes", "n_tokens", "budget_bytes"])

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(counted, f"_key {kind}, n_bytes long, n_tokens long, budget_bytes long").withColumnRenamed("_key", key)
