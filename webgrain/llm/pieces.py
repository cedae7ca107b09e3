"""Texts cut into the pieces that a byte-level BPE encodes one by one, many texts at once in numpy.

``cuts`` says where the pre-tokenizer's pattern (``PIECE``) begins a piece.
``PieceMemory`` keeps what was worked out for a piece: pieces are found by a 64-bit hash of
their code points and then compared code point by code point, so a hash that two pieces
share does no harm.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

# The published pre-tokenizer pattern of byte-level BPE, its white
# space spelled as the Unicode property.
PIECE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CONTRACTIONS = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])
# Pieces that a worker remembers.
PIECES = 300_000
# Code points that are looked at together.
BLOCK = 1 << 20

_LETTER, _NUMBER, _OTHER, _WHITE = 1, 2, 0, 3
_BASE = 0x9E3779B97F4A7C15


def character_kinds() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    every = "".join(map(chr, range(0x110000)))
    kinds = np.zeros(0x110000, np.uint8)
    for kind, name in ((_LETTER, "L"), (_NUMBER, "N"), (_WHITE, "White_Space")):
        for found in regex.finditer(rf"\p{{{name}}}+", every):
            kinds[found.start():found.end()] = kind
    return kinds


def cuts(code: np.ndarray, begins: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pieces begin in ``code``, the code points of texts that begin at ``begins`` (none of them empty)."""
    if not len(code):
        return np.zeros(0, np.int64)
    kind = kinds[code]
    cut = np.ones(len(code), bool)
    cut[1:] = kind[1:] != kind[:-1]
    first = np.zeros(len(code), bool)
    first[begins] = True
    cut |= first
    # A blank before something else is on its own, and goes with what follows if it is a space.
    after_white = np.flatnonzero((kind[1:] != _WHITE) & (kind[:-1] == _WHITE) & ~first[1:]) + 1
    cut[after_white - 1] = True
    cut[after_white] = code[after_white - 1] != 32
    # A quote that begins a piece goes with certain letters after it.
    quote = np.flatnonzero(cut[:-1] & (code[:-1] == 39) & ~first[1:])
    if len(quote):
        padded = np.concatenate([code, np.zeros(2, code.dtype)])
        ends = np.concatenate([first, [True, True]])
        one, two = padded[quote + 1], np.where(ends[quote + 2], 0, padded[quote + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for at, size in ((quote[short], 2), (quote[long], 3)):
            cut[at + 1] = False
            cut[at[at + size < len(code)] + size] = True
    return np.flatnonzero(cut)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, one stretch after the other."""
    total = np.cumsum(sizes)
    out = np.arange(total[-1] if len(total) else 0)
    return out + np.repeat(starts - (total - sizes), sizes)


class PieceMemory:
    """Token ids of pieces, or only how many there are; pieces that were not met since the last time it was full are forgotten.

    ``of_new`` works out pieces that are not known: their ids, one piece after the other, and how many each
    has.  Where the ids are empty, only numbers are kept.
    """

    def __init__(self, of_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], size: int | None = None) -> None:
        self._of_new, self._size = of_new, size or PIECES
        self._kinds = character_kinds()
        self._powers = np.ones(1, np.uint64)
        self._clear()

    def _clear(self) -> None:
        # By ascending hash: the entry of each known piece.
        self._hash, self._entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # By entry: where its code points and ids stand in the pools.
        self._code_at, self._code_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._id_at, self._id_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._met = np.zeros(0, bool)
        self._codes, self._ids = np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def counts(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has."""
        return self.ids(texts, numbers_only=True)[1]

    def ids(self, texts: list[str], numbers_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        ids, counts, at = [], [], 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= BLOCK):
                held += len(texts[end])
                end += 1
            some, n = self._block(texts[at:end], numbers_only)
            ids.append(some)
            counts.append(n)
            at = end
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])

    def _block(self, texts: list[str], numbers_only: bool) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not len(code):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        ends = np.cumsum(sizes)
        begins = (ends - sizes)[sizes > 0]
        starts = cuts(code, begins, self._kinds)
        lengths = np.diff(np.append(starts, len(code)))
        entry = self._entries(joined, code, starts, lengths)
        n = self._id_n[entry]
        ids = np.zeros(0, np.uint32) if numbers_only else self._ids[ragged(self._id_at[entry], n)]
        # Tokens before each piece, read where texts end.
        before = np.concatenate([[0], np.cumsum(n)])
        upto = before[np.searchsorted(starts, ends)]
        return ids, np.diff(np.concatenate([[0], upto]))

    def _hashes(self, code: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        longest = int(lengths.max())
        if len(self._powers) < longest:
            self._powers = np.multiply.accumulate(np.full(2 * longest, _BASE, np.uint64))
        inside = ragged(np.zeros(len(starts), np.int64), lengths)
        sums = np.add.reduceat((code.astype(np.uint64) + np.uint64(1)) * self._powers[inside], starts)
        sums ^= sums >> np.uint64(32)
        return (sums + lengths.astype(np.uint64)) * np.uint64(_BASE)

    def _entries(self, joined: str, code: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if len(self._hash) > self._size:
            self._forget()
        hashes, first, back = np.unique(self._hashes(code, starts, lengths), return_index=True, return_inverse=True)
        at = np.searchsorted(self._hash, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self._hash)
        known[inside] = self._hash[at[inside]] == hashes[inside]
        found = np.full(len(hashes), -1, np.int64)
        found[known] = self._entry[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            found[new] = self._add(joined, code, starts[first[new]], lengths[first[new]])
            self._hash = np.insert(self._hash, at[new], hashes[new])
            self._entry = np.insert(self._entry, at[new], found[new])
        entry = found[back]
        self._met[entry] = True
        # Every piece is compared with the one that it is taken for.
        same_size = self._code_n[entry] == lengths
        checked = np.where(same_size, lengths, 0)
        equal = code[ragged(starts, checked)] == self._codes[ragged(self._code_at[entry], checked)]
        wrong = ~same_size
        if not equal.all():
            owner = np.repeat(np.arange(len(starts)), checked)
            wrong[owner[~equal]] = True
        if wrong.any():
            # Another piece with the same hash: worked out anew, under no hash.
            odd = np.flatnonzero(wrong)
            entry[odd] = self._add(joined, code, starts[odd], lengths[odd])
        return entry

    def _add(self, joined: str, code: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ids, sizes = self._of_new([joined[s:s + n] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)])
        out = len(self._met) + np.arange(len(starts))
        self._code_at = np.concatenate([self._code_at, len(self._codes) + np.cumsum(lengths) - lengths])
        self._code_n = np.concatenate([self._code_n, lengths])
        self._id_at = np.concatenate([self._id_at, len(self._ids) + np.cumsum(sizes) - sizes])
        self._id_n = np.concatenate([self._id_n, sizes])
        self._met = np.concatenate([self._met, np.zeros(len(starts), bool)])
        self._codes = np.concatenate([self._codes, code[ragged(starts, lengths)]])
        self._ids = np.concatenate([self._ids, ids.astype(np.uint32)])
        return out

    def _forget(self) -> None:
        kept = self._met[self._entry]
        if kept.sum() > 0.8 * self._size:
            self._clear()
            return
        entry = self._entry[kept]
        self._hash, self._entry = self._hash[kept], np.arange(len(entry))
        codes = self._codes[ragged(self._code_at[entry], self._code_n[entry])]
        ids = self._ids[ragged(self._id_at[entry], self._id_n[entry])] if len(self._ids) else self._ids
        self._code_n, self._id_n = self._code_n[entry], self._id_n[entry]
        self._code_at, self._id_at = np.cumsum(self._code_n) - self._code_n, np.cumsum(self._id_n) - self._id_n
        self._codes, self._ids, self._met = codes, ids, np.zeros(len(entry), bool)
