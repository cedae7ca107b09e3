"""Secrets in documents: fixed patterns, and a small character network for what they miss.

Method: a character convolutional network in numpy over every candidate and its
surrounding context, trained on labelled findings, with a calibrated and
recall-constrained threshold.

The labelled findings are what the base patterns find (secrets) against all other
candidates (not secrets).  So that the network learns what a secret and its place
look like instead of the patterns themselves, every example is shown without its
context as well, and every secret with the letters before it masked.  A share of the findings is held out:
on it the scores are calibrated (logistic regression on the logit), and the
threshold is the highest one that still finds ``RECALL`` of the secrets.  A candidate
above it that no base span touches becomes a span of kind ``model``.

Training begins with at most ``SAMPLE`` different findings, ``SAMPLE`` other candidates with a digit and as many
without one, those with the smallest hash of their content.  Where there are more, it goes on over every finding and every other candidate
of the corpus (``trained``): each task follows its own rows from the network that all begin with, and the
networks are averaged by what they have seen.  What has one value is either trained on or held out, and the scores of all
that is held out calibrate the network and set the threshold.
The scan reads every text whole and scores all its candidates, many at once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import map_batches, ship, whole
from webgrain.llm.pieces import ragged
from webgrain.session import discard, materialized

KINDS = ("assign", "access", "hex", "model")
SAMPLE = 1_500
RECALL = 0.95
CONTEXT = 24  # characters on each side of a candidate
LONGEST = 512  # characters of a candidate that are seen at once; longer ones in overlapping parts
FILTERS, WIDTH = 24, 5
EPOCHS, RATE, SEED = 8, 0.02, 5
# Candidates that one step follows, its rate, and the error from which on a candidate counts as learned.
STEP, STEP_RATE, LEARNED = 4096, 0.1, 1e-3
# Symbols beside a candidate that is shown without its context: more of them say nothing more.
BARE = WIDTH
# Parts of a unit of the logit that scores are counted by.
BINS = 256
# Candidates that are scored at once: their sums are some 1.5 MB, which fit a core's cache.
TOGETHER = 256

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_LEAST = 32
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

# A candidate is an unbroken run of the characters that keys are made of.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_DIGIT = re.compile(r"[0-9]")
ALPHABET = "\x00 \n\t" + "".join(map(chr, range(33, 127)))
_CODES = {c: i for i, c in enumerate(ALPHABET, start=1)}
SYMBOLS = len(ALPHABET) + 1
MASKED = "x"


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base findings; ``runs`` are the text's candidates where they are known."""
    out = []
    if ":" in text or "=" in text:  # the pattern needs one of them
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # A hex finding is part of one candidate.
    for start, end in candidates(text) if runs is None else runs:
        if end - start >= HEX_LEAST:
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, start, end)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def secret_part(text: str, start: int, kind: int, end: int) -> tuple[int, int]:
    """The secret itself inside a base finding."""
    if kind:
        return start, end
    value = ASSIGN.match(text, start)
    return (value.start(2), value.end(2)) if value else (start, end)


def coded(text: str, start: int, end: int, mask: bool = False, bare: bool = False) -> Iterator[np.ndarray]:
    """Symbols of a candidate with its context, inside ones apart from outside ones; long candidates in parts."""
    before = text[max(0, start - CONTEXT):start].rjust(CONTEXT, "\x00")
    after = text[end:end + CONTEXT].ljust(CONTEXT, "\x00")
    if mask:
        before = re.sub(r"[A-Za-z]", MASKED, before)
    if bare:
        before, after = "\x00" * CONTEXT, "\x00" * CONTEXT
    for at in range(start, end, LONGEST - WIDTH):
        part = text[at:min(end, at + LONGEST)]
        outer = [_CODES.get(c, 0) for c in before], [_CODES.get(c, 0) for c in after]
        yield np.array([*outer[0], *(SYMBOLS + _CODES.get(c, 0) for c in part), *outer[1]], np.int64)


@dataclass
class Network:
    """Embedding by symbol and offset (a convolution over one-hot symbols), rectified, maximum over places, logistic output."""

    kernel: np.ndarray  # WIDTH x 2 SYMBOLS x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0  # above any score: nothing is added

    @staticmethod
    def new(rng: np.random.Generator) -> Network:
        return Network(rng.normal(0, 0.1, (WIDTH, 2 * SYMBOLS, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, FILTERS), 0.0)

    def _places(self, code: np.ndarray) -> np.ndarray:
        size = len(code) - WIDTH + 1
        total = np.tile(self.bias, (size, 1))
        for k in range(WIDTH):
            total += self.kernel[k, code[k:k + size]]
        return total

    def pooled(self, parts: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
        """Largest response of each filter over all parts, and where it was."""
        best, where = np.full(FILTERS, -np.inf), [(parts[0], 0)] * FILTERS
        for code in parts:
            total = self._places(code)
            at = total.argmax(axis=0)
            top = total[at, np.arange(FILTERS)]
            for f in np.flatnonzero(top > best):
                where[f] = (code, int(at[f]))
            best = np.maximum(best, top)
        return np.maximum(best, 0), where

    def logit(self, parts: list[np.ndarray]) -> float:
        return float(self.pooled(parts)[0] @ self.out + self.out_bias)

    def step(self, parts: list[np.ndarray], label: int, rate: float) -> None:
        seen, where = self.pooled(parts)
        error = 1 / (1 + np.exp(-(seen @ self.out + self.out_bias))) - label
        back = error * self.out * (seen > 0)
        self.out -= rate * error * seen
        self.out_bias -= rate * error
        self.bias -= rate * back
        for f in np.flatnonzero(back):
            code, at = where[f]
            for k in range(WIDTH):
                self.kernel[k, code[at + k], f] -= rate * back[f]

    def score(self, parts: list[np.ndarray]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.logit(parts) + self.shift, -60, 60))))

    def tables(self) -> list[np.ndarray]:
        """The kernel by pairs of neighbouring symbols, so that fewer rows are added up for a place."""
        wide, out = 2 * SYMBOLS, []
        for k in range(0, WIDTH, 2):
            one = self.kernel[k].astype(np.float32)
            out.append(one if k + 1 == WIDTH else (one[:, None] + self.kernel[k + 1].astype(np.float32)).reshape(wide * wide, FILTERS))
        return out

    def _totals(self, tables: list[np.ndarray], code: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of many candidates, each a stretch of ``code`` with its context, and every filter's response there."""
        place = ragged(starts, counts)
        total = np.tile(self.bias.astype(np.float32), (len(place), 1))
        for k, table in zip(range(0, WIDTH, 2), tables, strict=True):
            at = code[place + k]
            total += table[at if k + 1 == WIDTH else at * (2 * SYMBOLS) + code[place + k + 1]]
        return place, total

    def logits(self, tables: list[np.ndarray], code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``logit`` of many candidates to some six digits, and the largest response of each filter."""
        counts = sizes - (WIDTH - 1)
        _, total = self._totals(tables, code, starts, counts)
        best = np.maximum(np.maximum.reduceat(total, np.cumsum(counts) - counts, axis=0), 0)
        return best @ self.out + self.out_bias, best

    def scores(self, tables: list[np.ndarray], code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``score`` of many candidates to some six digits."""
        logit, _ = self.logits(tables, code, starts, sizes)
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -60, 60)))

    def gradient(
        self, tables: list[np.ndarray], code: np.ndarray, starts: np.ndarray, sizes: np.ndarray, label: int,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Summed over many candidates of one label; those whose error is under ``LEARNED`` say nothing."""
        counts = sizes - (WIDTH - 1)
        place, total = self._totals(tables, code, starts, counts)
        best = np.maximum(np.maximum.reduceat(total, np.cumsum(counts) - counts, axis=0), 0)
        error = 1 / (1 + np.exp(-np.clip(best @ self.out + self.out_bias, -60, 60))) - label
        open_ = np.abs(error) >= LEARNED
        if not open_.all():
            still = np.repeat(open_, counts)
            place, total, error, best, counts = place[still], total[still], error[open_], best[open_], counts[open_]
        kernel, bias = np.zeros_like(self.kernel), np.zeros_like(self.bias)
        if len(error):
            back = error[:, None] * self.out * (best > 0)
            of = np.repeat(np.arange(len(error)), counts)
            row, f = np.nonzero((total == best[of]) & (total > 0))
            # The first place of each filter's largest response.
            _, first = np.unique(of[row] * FILTERS + f, return_index=True)
            row, f = row[first], f[first]
            bias = back.sum(axis=0)
            for k in range(WIDTH):
                np.add.at(kernel[k], (code[place[row] + k], f), back[of[row], f])
        return kernel, bias, best.T @ error, float(error.sum())

    def calibrate(self, held: list[tuple[list[np.ndarray], int]], recall: float) -> None:
        """Scale and shift of the logit by logistic regression; then the recall-constrained threshold."""
        x = np.array([self.logit(p) for p, _ in held])
        y = np.array([label for _, label in held], float)
        self._regress(x, y, np.ones(len(x)))
        found = np.sort([self.score(p) for p, label in held if label])
        self.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 2.0

    def calibrate_counted(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> None:
        """As ``calibrate``, of ``n`` examples for each logit and label; the threshold is at the lower end of a logit's bin."""
        self._regress(x, y, n)
        order = np.argsort(x[y > 0])
        yes, upto = x[y > 0][order], np.cumsum(n[y > 0][order])
        at = yes[np.searchsorted(upto, int((1 - recall) * upto[-1]), "right")]
        self.threshold = float(1 / (1 + np.exp(-np.clip(self.scale * np.floor(at * BINS) / BINS + self.shift, -60, 60))))

    def _regress(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        # Smoothed targets, so that separable data have a finite optimum.
        n_yes, n_no = float(n[y > 0].sum()), float(n[y == 0].sum())
        t = np.where(y > 0, (n_yes + 1) / (n_yes + 2), 1 / (n_no + 2))
        mean = lambda v: float((v * n).sum() / n.sum())
        a, b = 1.0, 0.0
        for _ in range(500):
            gap = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60))) - t
            a, b = max(1e-3, a - 0.05 * mean(gap * x) / max(1.0, mean(x * x))), b - 0.5 * mean(gap)
        self.scale, self.shift = a, b


def labelled_findings(docs: DataFrame, *, text_col: str = "text", sample: int = SAMPLE) -> list[tuple[str, int, int, int]]:
    """(piece of text, start, end, label): different ones, at most ``sample`` of each sort, by the smallest hash of their content.

    The sorts are findings, other candidates with a digit, and those without.  A long one comes in pieces
    of bounded size, all of which take part.  NULL or empty texts have none.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Copies within a batch go at once, the others where they meet.
            seen: tuple[set, set, set] = set(), set(), set()
            for text in batch.column(0).to_pylist():
                runs = candidates(text)
                base = base_spans(text, runs)
                for start, kind, end in base:
                    seen[0].update(_pieces(text, *secret_part(text, start, kind, end)))
                for start, end in runs:
                    if not base or not _touches(base, start, end):
                        seen[1 if _DIGIT.search(text, start, end) else 2].update(_pieces(text, start, end))
            rows = [(*row, int(not sort), sort) for sort, found in enumerate(seen) for row in _smallest(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["h", "piece", "a", "b", "label", "sort"])

    def _smallest(found: set[tuple[str, int, int]]) -> list[tuple[int, str, int, int]]:
        """The ``sample`` first; no others can be among the first of all."""
        return sorted((zlib.crc32(piece.encode("utf-8", "replace")), piece, a, b) for piece, a, b in found)[:sample]

    def _pieces(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
        if end - start <= 4 * LONGEST:
            low = start - CONTEXT if start > CONTEXT else 0
            return [(text[low:end + CONTEXT], start - low, end - low)]
        out = []
        for at in range(start, end, 4 * LONGEST):
            upto, low = min(end, at + 4 * LONGEST), max(0, at - CONTEXT)
            out.append((text[low:upto + CONTEXT], at - low, upto - low))
        return out

    given = docs.select(whole(F.col(text_col)).alias("text"))
    rows = materialized(map_batches(given, find, "h long, piece string, a long, b long, label long, sort long"), "findings")
    out = []
    for sort in range(3):
        top = rows.where(F.col("sort") == sort).select("h", "piece", "a", "b", "label").distinct().orderBy("h", "piece", "a", "b").limit(sample)
        out += [(r["piece"], r["a"], r["b"], r["label"]) for r in top.toLocalIterator()]
    return out


def _touches(spans: list[tuple[int, int, int]], start: int, end: int) -> bool:
    return any(s < end and start < e for s, _, e in spans)


def fit(
    findings: list[tuple[str, int, int, int]], *, recall: float = RECALL, seed: int = SEED, held_back: Callable[[str], bool] | None = None,
) -> Network:
    """Train, calibrate and set the threshold; without findings of both labels nothing is ever added.

    Every fourth value is held out, or those that ``held_back`` names.
    """
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    if len({label for *_, label in findings}) < 2:
        return net
    held, train = [], []
    # A value is held out wherever it stands.
    number: dict[str, int] = {}
    for piece, a, b, label in sorted(findings):
        back = number.setdefault(piece[a:b], len(number)) % 4 == 0 if held_back is None else held_back(piece[a:b])
        into = held if back else train
        into.append((list(coded(piece, a, b)), label))
        into.append((list(coded(piece, a, b, bare=True)), label))
        if label:
            into.append((list(coded(piece, a, b, mask=True)), label))
    # Both labels weigh the same.
    yes, no = [x for x in train if x[1]], [x for x in train if not x[1]]
    if not yes or not no or len({label for _, label in held}) < 2:
        return net
    for epoch in range(EPOCHS):
        size = max(len(yes), len(no))
        mixed = [yes[i] for i in rng.integers(len(yes), size=size)] + [no[i] for i in rng.integers(len(no), size=size)]
        for i in rng.permutation(len(mixed)):
            net.step(*mixed[i], RATE / (1 + epoch / 4))
    net.calibrate(held, recall)
    return net


def value_held(value: str) -> bool:
    """The quarter of all values that training over a corpus holds out."""
    return zlib.crc32(value.encode("utf-8", "replace")) % 4 == 0


def joined(texts: list[str], symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts with room for a context between them, and where each text begins."""
    gap = "\x00" * CONTEXT
    code = symbol[np.frombuffer((gap + "".join(t + gap for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)]
    return code, np.cumsum([CONTEXT] + [len(t) + CONTEXT for t in texts])


def shown(code: np.ndarray, starts: np.ndarray, inside: np.ndarray, mask: bool = False, bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """What ``coded`` shows of many candidates of at most ``LONGEST`` characters: the symbols of all, and their numbers.

    Of the places without context, which are all the same, there are as many as matter.
    """
    beside = BARE if bare else CONTEXT
    sizes = inside + 2 * beside
    own = code[ragged(starts - beside, sizes)]
    begins = np.cumsum(sizes) - sizes
    room = np.full(len(inside), beside)
    if bare:
        own[ragged(begins, room)] = _CODES["\x00"]
        own[ragged(begins + beside + inside, room)] = _CODES["\x00"]
    if mask:
        before = ragged(begins, room)
        own[before] = np.where(np.isin(own[before], [_CODES[c] for c in ALPHABET if c.isalpha()]), _CODES[MASKED], own[before])
    own[ragged(begins + beside, inside)] += SYMBOLS
    return own, sizes


def examples(texts: list[str], symbol: np.ndarray, held: bool) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], list[tuple[int, list[np.ndarray]]]]:
    """All labelled examples in the texts that are held out, or that are not: (label, symbols, sizes) of many, (label, parts) of long ones."""
    found: tuple[list, list] = ([], [])
    long = []
    for i, text in enumerate(texts):
        runs = candidates(text)
        base = base_spans(text, runs)
        spans = [(*secret_part(text, s, k, e), 1) for s, k, e in base]
        spans += [(s, e, 0) for s, e in runs if not base or not _touches(base, s, e)]
        for s, e, label in spans:
            if value_held(text[s:e]) != held:
                continue
            if e - s <= LONGEST:
                found[label].append((i, s, e))
            else:
                long += [(label, list(coded(text, s, e, **way))) for way in ({}, {"bare": True}, {"mask": True})[:2 + label]]
    many = []
    if found[0] or found[1]:
        code, base_at = joined(texts, symbol)
    for label, spans in enumerate(found):
        if spans:
            part = np.array(spans, np.int64)
            starts, inside = base_at[part[:, 0]] + part[:, 1], part[:, 2] - part[:, 1]
            many += [(label, *shown(code, starts, inside, **way)) for way in ({}, {"bare": True}, {"mask": True})[:2 + label]]
    return many, long


def blocks(code: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, starts, sizes) of ``TOGETHER`` examples at a time."""
    ends = np.cumsum(sizes)
    for at in range(0, len(sizes), TOGETHER):
        some = sizes[at:at + TOGETHER]
        first = ends[at] - sizes[at]
        yield code[first:first + some.sum()], np.cumsum(some) - some, some


class Course:
    """Training over a task's rows, in steps of ``STEP`` candidates and the findings met with them."""

    def __init__(self, net: Network, sample: list[tuple[str, int, int, int]]) -> None:
        self.net, self.n = net, 0
        self.rng = np.random.default_rng(SEED)
        # What a step has too few of is filled up from those of the sample and those seen before.
        ways = {0: ({}, {"bare": True}), 1: ({}, {"bare": True}, {"mask": True})}
        self.known: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for piece, a, b, label in sample:
            if b - a <= LONGEST and not value_held(piece[a:b]):
                self.known[label].extend(c for way in ways[label] for c in coded(piece, a, b, **way))
        # Blocks of ``TOGETHER`` at most, and how many examples they are.
        self.waiting: tuple[list, list] = ([], [])
        self.held = [0, 0]

    def take(self, label: int, code: np.ndarray, sizes: np.ndarray) -> None:
        self.n += len(sizes)
        if label:
            self.known[1].extend(np.split(code, np.cumsum(sizes)[:-1]))
        for block in blocks(code, sizes):
            self.waiting[label].append(block)
            self.held[label] += len(block[2])
            if self.held[0] >= STEP:
                self.step()

    def step(self) -> None:
        rate = STEP_RATE * min(1.0, max(self.held) / STEP)
        total = [np.zeros_like(self.net.kernel), np.zeros_like(self.net.bias), np.zeros_like(self.net.out), 0.0]
        tables = self.net.tables()
        for label in (0, 1):
            given, n = self.waiting[label][:], self.held[label]
            self.waiting[label].clear()
            self.held[label] = 0
            if n < TOGETHER and self.known[label]:
                more = [self.known[label][i] for i in self.rng.integers(len(self.known[label]), size=TOGETHER - n)]
                given += blocks(np.concatenate(more), np.array([len(c) for c in more], np.int64))
                n = TOGETHER
            for block in given:
                total = [t + g / n for t, g in zip(total, self.net.gradient(tables, *block, label), strict=True)]
        net = self.net
        net.kernel -= rate * total[0]
        net.bias -= rate * total[1]
        net.out -= rate * total[2]
        net.out_bias -= rate * total[3]


def trained(docs: DataFrame, *, text_col: str = "text", sample: int = SAMPLE, recall: float = RECALL) -> Network:
    """The network of all findings and all other candidates in ``docs``, calibrated on all that are held out.

    Where ``labelled_findings`` has them all, that is ``fit``.  Otherwise training goes on from there: every task follows all its
    rows, and the networks are averaged by the examples they have seen; the driver receives one network for each task, one after the other.
    """
    findings = labelled_findings(docs, text_col=text_col, sample=sample)
    sorts = [0, 0, 0]
    for piece, a, b, label in findings:
        sorts[0 if label else 1 if _DIGIT.search(piece, a, b) else 2] += 1
    if max(sorts) < sample:
        return fit(findings, recall=recall)
    net = fit(findings, recall=recall, held_back=value_held)
    if net.threshold > 1:
        return net
    spark = docs.sparkSession
    given = docs.select(whole(F.col(text_col)).alias("text"))
    begun = ship(spark, (net.kernel, net.bias, net.out, net.out_bias, findings), net.kernel.nbytes + sum(4 * len(f[0]) for f in findings))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, bias, out, out_bias, known = begun.value
        course, symbol = Course(Network(kernel.copy(), bias.copy(), out.copy(), out_bias), known), symbols()
        for batch in batches:
            many, long = examples(batch.column(0).to_pylist(), symbol, False)
            # Findings first: they are few, and every step takes those that wait.
            for label, code, sizes in sorted(many, key=lambda x: -x[0]):
                course.take(label, code, sizes)
            for label, parts in long:
                course.net.step(parts, label, STEP_RATE / STEP)
                course.n += 1
        if course.waiting[0] or course.waiting[1]:
            course.step()
        if course.n:
            state = course.net
            flat = np.concatenate([state.kernel.ravel(), state.bias, state.out, [state.out_bias]])
            yield pa.RecordBatch.from_arrays([pa.array([course.n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["n", "net"])

    networks = materialized(map_batches(given, follow, "n long, net binary"), "networks")
    total, n = np.zeros(net.kernel.size + 2 * FILTERS + 1), 0
    for row in networks.toLocalIterator():
        total += row["n"] * np.frombuffer(bytes(row["net"]))
        n += row["n"]
    discard(networks)
    if n:
        total /= n
        net.kernel = total[:net.kernel.size].reshape(net.kernel.shape)
        net.bias, net.out, net.out_bias = total[-2 * FILTERS - 1:-FILTERS - 1], total[-FILTERS - 1:-1], float(total[-1])
    done = ship(spark, (net.kernel, net.bias, net.out, net.out_bias), net.kernel.nbytes)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, symbol = Network(*done.value), symbols()
        tables = network.tables()
        counted: dict[tuple[int, int], list[float]] = {}

        def add(label: int, x: np.ndarray) -> None:
            bins, place, n = np.unique(np.floor(x * BINS).astype(np.int64), return_inverse=True, return_counts=True)
            for at, some, part in zip(bins.tolist(), n.tolist(), np.bincount(place, x).tolist(), strict=True):
                into = counted.setdefault((label, at), [0, 0.0])
                into[0] += some
                into[1] += part

        for batch in batches:
            many, long = examples(batch.column(0).to_pylist(), symbol, True)
            for label, code, sizes in many:
                add(label, np.concatenate([network.logits(tables, *block)[0] for block in blocks(code, sizes)]))
            for label, parts in long:
                add(label, np.array([network.logit(parts)]))
        if counted:
            rows = [(*key, *value) for key, value in counted.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["label", "bin", "n", "x"])

    seen = map_batches(given, judge, "label long, bin long, n long, x double")
    # A logit is bounded by the network's weights, and so are its bins.
    rows = seen.groupBy("label", "bin").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("label", "bin").collect()
    y, n, x = (np.array([r[c] for r in rows], float) for c in ("label", "n", "x"))
    if not rows or y.min() == y.max():
        net.threshold = 2.0
    else:
        net.calibrate_counted(x / n, y, n, recall)
    return net


def symbols() -> np.ndarray:
    """The symbol of every code point."""
    out = np.zeros(0x110000, np.int64)
    out[[ord(c) for c in ALPHABET]] = [_CODES[c] for c in ALPHABET]
    return out


def model_spans(
    net: Network, tables: list[np.ndarray], symbol: np.ndarray, texts: list[str], base: list[list[tuple[int, int, int, float]]],
    runs: list[list[tuple[int, int]]] | None = None,
) -> Iterator[tuple[int, int, int, float]]:
    """(text, start, end, score) of all candidates (``runs``) that no base span touches and that reach the threshold."""
    short: list[tuple[int, int, int]] = []
    for i, text in enumerate(texts):
        known = [(s, k, e) for s, k, e, _ in base[i]]
        for s, e in candidates(text) if runs is None else runs[i]:
            if known and _touches(known, s, e):
                continue
            if e - s > LONGEST:
                # Seen in parts that overlap.
                if (p := net.score(list(coded(text, s, e)))) >= net.threshold:
                    yield i, s, e, p
            else:
                short.append((i, s, e))
    if not short:
        return
    code, base_at = joined(texts, symbol)
    for at in range(0, len(short), TOGETHER):
        part = np.array(short[at:at + TOGETHER], np.int64)
        own, sizes = shown(code, base_at[part[:, 0]] + part[:, 1], part[:, 2] - part[:, 1])
        near = net.scores(tables, own, np.cumsum(sizes) - sizes, sizes) >= net.threshold - 1e-3
        for i, s, e in part[near].tolist():
            if (p := net.score(list(coded(texts[i], s, e)))) >= net.threshold:
                yield i, s, e, p


def scan(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, findings: array of (start, end, kind, score) in order, one row for each row of ``docs``.

    Base findings have score 1.  NULL text is empty and has none.  NULL and
    repeated ids are passed on, extra columns ignored; an empty table gives an empty result.
    """
    # Plain values only: workers need not have this package.
    state = (net.kernel, net.bias, net.out, net.out_bias, net.scale, net.shift, net.threshold)
    shared = ship(docs.sparkSession, state, net.kernel.nbytes)
    kind_of = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(*shared.value)
        tables = network.tables() if network.threshold <= 1 else []
        symbol = symbols()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            runs = [candidates(t) for t in texts]
            spans = [[(s, k, e, 1.0) for s, k, e in base_spans(t, r)] for t, r in zip(texts, runs, strict=True)]
            if network.threshold <= 1:
                for i, s, e, p in model_spans(network, tables, symbol, texts, spans, runs):
                    spans[i].append((s, 3, e, p))
            found = [[{"start": s, "end": e, "kind": KINDS[k], "score": p} for s, k, e, p in sorted(x)] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind_of))], ["doc_id", "findings"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    return map_batches(given, work, "doc_id long, findings array<struct<start:long,end:long,kind:string,score:double>>")


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all findings in ``docs``, then scan ``docs``."""
    return scan(docs, trained(docs, text_col=text_col), id_col=id_col, text_col=text_col)
