"""Byte-level BPE vocabularies: exact token counts at every prefix, and library ids.

``PrefixCounter`` is the prefix dynamic program.  For a piece of text (what the
pre-tokenizer pattern matches) it finds, for every byte prefix, the last token of
that prefix's encoding; the count of a prefix is the count before its last token
plus one.  A token can follow another exactly if encoding the two of them
together gives back the two, so one look at the token before decides.

A piece of a prefix is a prefix of a piece, with two exceptions that are counted
on their own: contractions ("'re" cut after "'r" is two pieces) and runs of white
space (whose last character belongs to the next piece, unless the text ends there).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import regex

from webgrain.llm.pieces import CONTRACTIONS, PIECE, PieceMemory, ragged

# The alphabet of byte-level BPE that stands for bytes.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

_BLANKS = regex.compile(r"\p{White_Space}+")
# Pairs of tokens that a worker remembers before it starts anew.
PAIRS = 500_000
# Pieces that the library encodes as one line.
LINE_PIECES = 256


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file to the byte it stands for."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of texts and of all their prefixes, for a byte-level BPE ``.json`` file.

    Tokens are numbered: bytes first, then the results of the merges in order.
    """

    def __init__(self, spec: str) -> None:
        model = json.loads(spec)
        kind = model["pre_tokenizer"]
        if model["model"]["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or model["normalizer"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.special = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"]):
            raise ValueError("special tokens that take blanks or whole words are not supported")
        self._at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        # A byte is the character of its number here, so that the automaton can read pieces as strings.
        to_byte = {ord(c): b for c, b in byte_alphabet().items()}
        number = {chr(b): b for b in range(256)}
        self._parts: list[tuple[int, int] | None] = [None] * 256
        self._rank: dict[int, int] = {}
        for pair in model["model"]["merges"]:
            left, right = (x.translate(to_byte) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            if left not in number or right not in number or left + right in number:
                raise ValueError("the merges do not make each token once, after its parts")
            new = number[left + right] = len(self._parts)
            self._rank[number[left] << 32 | number[right]] = new
            self._parts.append((number[left], number[right]))
        names = set(self.special)
        if not {w.translate(to_byte) for w in model["model"]["vocab"] if w not in names} <= number.keys():
            raise ValueError("the vocabulary has tokens that no merge makes")
        self._automaton = ahocorasick.Automaton()
        for token, at in number.items():
            self._automaton.add_word(token, (at, len(token)))
        self._automaton.make_automaton()
        # From a token down to its last byte, and down to its first one.
        self._right_edge: list[list[int]] = []
        self._left_edge: list[list[int]] = []
        for at, parts in enumerate(self._parts):
            self._right_edge.append([*self._right_edge[parts[1]], at] if parts else [at])
            self._left_edge.append([*self._left_edge[parts[0]], at] if parts else [at])
        self._reached = [parts is None or self._joins(*parts, at) for at, parts in enumerate(self._parts)]
        self._follows: dict[int, bool] = {}
        self._memory = PieceMemory(self._of_new)

    # The dynamic program -------------------------------------------------

    def _meets(self, before: int, token: int) -> int:
        """The merge that joins two tokens across their border when both are built at once, or 0.

        Merging builds each side along its edge; a join of what stands at the border comes first if its
        rank is below those of the next steps on both sides (on a tie, the pair further left goes first).
        """
        left, right, rank = self._right_edge[before], self._left_edge[token], self._rank
        i = j = 0
        while True:
            joined = rank.get(left[i] << 32 | right[j], 0)
            next_left = left[i + 1] if i + 1 < len(left) else 1 << 40
            next_right = right[j + 1] if j + 1 < len(right) else 1 << 40
            if joined and joined < next_left and joined <= next_right:
                # Joined before both sides are whole, or as the last step.
                return joined
            if next_left == next_right == 1 << 40:
                return 0
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _joins(self, left: int, right: int, token: int) -> bool:
        """Whether merging the bytes of ``token`` ends in it."""
        return self._meets(left, right) == token

    def can_follow(self, before: int, token: int) -> bool:
        """Whether the encoding of the two tokens' bytes together is the two tokens."""
        key = before << 32 | token
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) >= PAIRS:
                self._follows.clear()
            known = self._follows[key] = self._meets(before, token) == 0
        return known

    def piece_counts(self, data: bytes) -> list[int]:
        """Tokens of each byte prefix of one piece; entry 0 is the empty prefix."""
        size = len(data)
        counts, last, follows, done = [0] * (size + 1), [-1] * (size + 1), self._follows, 0
        # All tokens that end at a place, the longest first; one of them ends the encoding of that prefix.
        for end, (token, length) in self._automaton.iter(data.decode("latin-1")):
            if end < done:
                continue
            start = end + 1 - length
            if start:
                known = follows.get(last[start] << 32 | token)
                if known is None:
                    known = self.can_follow(last[start], token)
            else:
                known = self._reached[token]
            if known:
                done = end + 1
                counts[done] = counts[start] + 1
                last[done] = token
        if done != size:
            raise ValueError("the vocabulary has no token for a byte")
        return counts

    # Texts ---------------------------------------------------------------

    def _of_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(0, np.uint32), np.array([self.piece_counts(p.encode())[-1] for p in pieces], np.int64)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts."""
        split = [list(self._stretches(t)) for t in texts]
        plain = iter(self._memory.counts([part for parts in split for part in parts if isinstance(part, str)]).tolist())
        return [sum(part if isinstance(part, int) else next(plain) for part in parts) for parts in split]

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return self.counts([text])[0]

    def _stretches(self, text: str) -> Iterator[str | int]:
        """Plain stretches, and 1 for each special string between them."""
        at = 0
        if self._at_special is not None:
            for found in self._at_special.finditer(text):
                yield text[at:found.start()]
                yield 1
                at = found.end()
        yield text[at:]

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of ``text[:n]`` for every n from 0 to the length of the text.

        A prefix that ends inside a special string counts that string's start as plain text.
        """
        out = [0]
        at = 0
        marks = list(self._at_special.finditer(text)) if self._at_special is not None else []
        for begin, end in [*((m.start(), m.end()) for m in marks), (len(text), len(text))]:
            base = out[-1]
            # The start of a special string is plain text for the prefixes that end inside it.
            plain = self._prefix_plain(text[at:max(begin, end - 1)])
            out += [base + n for n in plain[1:]]
            if end > begin:
                out.append(base + plain[begin - at] + 1)
            at = end
        return out

    def _prefix_plain(self, text: str) -> list[int]:
        counts, before, blank_from = [0] * (len(text) + 1), 0, None
        pieces = [(m.start(), m.end()) for m in PIECE.finditer(text)]
        for start, end in pieces:
            piece = text[start:end]
            by_char = self._by_char(piece)
            for n in range(1, len(piece) + 1):
                counts[start + n] = before + by_char[n]
            if piece in CONTRACTIONS:
                for n in range(2, len(piece)):
                    counts[start + n] = before + sum(self._by_char(p)[-1] for p in PIECE.findall(piece[:n]))
            blank = _BLANKS.fullmatch(piece) is not None
            if blank_from is not None and (blank or piece[0] == " "):
                # The run of blanks goes on into this piece: a text that ends inside has it as one piece.
                run_start, run_before = blank_from
                reach = start + (len(piece) if blank else 1)
                for n, c in enumerate(self._by_char(text[run_start:reach])):
                    if run_start + n > start:
                        counts[run_start + n] = run_before + c
            blank_from = (blank_from or (start, before)) if blank else None
            before += by_char[-1]
        return counts

    def _by_char(self, piece: str) -> list[int]:
        counts, at, out = self.piece_counts(piece.encode()), 0, [0]
        for c in piece:
            at += len(c.encode())
            out.append(counts[at])
        return out

    def truncation(self, text: str, budget: int) -> int:
        """Length of the longest prefix of at most ``budget`` tokens."""
        counts = self.prefix_counts(text)
        return max(n for n, c in enumerate(counts) if c <= budget)


def id_width(spec: str) -> int:
    """Bytes that an id of a vocabulary file needs."""
    model = json.loads(spec)
    most = max([*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])], default=0)
    return 2 if most < 1 << 16 else 4


class LibraryIds:
    """Ids of whole texts as the tokenizers library gives them, as packed little-endian integers.

    Pieces that repeat are encoded by the library once and remembered.
    """

    def __init__(self, spec: str) -> None:
        # A task has one core; the library would start a thread for each core of the machine.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(spec)
        self.width = id_width(spec)
        special = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self._special = regex.compile("|".join(map(regex.escape, special))) if special else None
        tab = self._tokenizer.encode("\t", add_special_tokens=False).ids
        if len(tab) != 1:
            raise ValueError("the vocabulary has no token for a tab")
        self._tab = tab[0]
        self._memory = PieceMemory(self._of_new)

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        apart = {i for i, t in enumerate(texts) if self._special is not None and self._special.search(t)}
        ids, counts = self._memory.ids(["" if i in apart else t for i, t in enumerate(texts)])
        data, ends = ids.astype(f"<u{self.width}").tobytes(), (np.cumsum(counts) * self.width).tolist()
        out = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if texts else []
        for i in apart:
            out[i] = np.array(self._encoded(texts[i]), f"<u{self.width}").tobytes()
        return out

    def _encoded(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _of_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        blank = np.array([p.isspace() for p in pieces], bool)
        # A tab is a piece and a token of its own between pieces that are not blank, so one call encodes many.
        plain = [p for p, b in zip(pieces, blank.tolist(), strict=True) if not b]
        lines = ["\t".join(plain[k:k + LINE_PIECES]) for k in range(0, len(plain), LINE_PIECES)]
        found = [np.array([*x.ids, self._tab], np.uint32) for x in self._tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        every = np.concatenate([np.zeros(0, np.uint32), *found])
        is_tab = every == self._tab
        ends = np.flatnonzero(is_tab) - np.arange(len(plain))
        rest = [np.array(self._encoded(p), np.uint32) for p, b in zip(pieces, blank.tolist(), strict=True) if b]
        # Those of plain pieces, then those of blank ones; brought into the order of ``pieces``.
        sizes = np.concatenate([np.diff(np.concatenate([[0], ends])), np.array([len(x) for x in rest], np.int64)]).astype(np.int64)
        pool, at = np.concatenate([every[~is_tab], *rest]), np.cumsum(sizes) - sizes
        order = np.argsort(np.argsort(blank, kind="stable"), kind="stable")
        return pool[ragged(at[order], sizes[order])], sizes[order]
