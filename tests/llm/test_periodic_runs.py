"""Runs against a search through all periods, and the query against its own definition."""

import hashlib
import random
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from test_operators import AWKWARD, awkward

from webgrain.llm import periodic_runs
from webgrain.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def brute_runs(x, least_words=6, least_periods=4):
    found = set()
    for q in range(1, len(x) // least_periods + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least_words, least_periods * q) and not any(
                    all(x[k] == x[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.add((i, length, q))
            i = j + 1
    return sorted(found)


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def through_stretches(x):
    code, out = np.array(x, np.int64), []
    for start, end in periodic_runs.stretches(np.zeros(len(x), np.int64), code):
        out += [(start + s, n, q) for s, n, q in periodic_runs.runs_of(code[start:end].tolist())]
    return sorted(out)


def test_runs_of_random_sequences():
    rng, seen = random.Random(12), 0
    for _ in range(1500):
        k, x, size = rng.choice([1, 2, 2, 3, 4, 6]), [], rng.randint(0, 60)
        while len(x) < size:
            block = [rng.randrange(k) for _ in range(rng.randint(1, 5))]
            x += (block * rng.randint(1, 8))[:rng.randint(1, 40)] if rng.random() < 0.5 else block
        want = brute_runs(x)
        seen += len(want)
        assert periodic_runs.runs_of(x) == want and through_stretches(x) == want
        assert periodic_runs.runs_of(x, 2, 2) == brute_runs(x, 2, 2)
    assert seen > 1000


def test_long_and_nested_runs():
    assert periodic_runs.runs_of([7] * 50_000) == [(0, 50_000, 1)]
    block = list(range(3_000))
    assert periodic_runs.runs_of([-1] + block * 5 + [5, 9]) == [(1, 15_000, 3_000)]
    inner = [1] * 8 + [2]
    # Runs of one word stand inside a run of nine words.
    assert periodic_runs.runs_of(inner * 4) == sorted([(0, 36, 9)] + [(9 * k, 8, 1) for k in range(4)])


def test_texts_of_a_batch_stay_apart():
    text_of, code = np.repeat([0, 1, 2], [3, 3, 8]), np.array([5] * 14)
    assert periodic_runs.stretches(text_of, code) == [(6, 14)]


def test_awkward_rows(spark):
    extra = [(60, "na " * 7 + "batman", "en", "s"), (None, "x\ty\n" * 5, None, None), (61, ("ha\x0b" * 100_000) + "end", "en", "s"),
             (62, "a b a b a b a", "en", "s"), (62, "a b a b a b a b", "en", "s"), (63, "word word " * 9, "en", "s")]
    docs = awkward(spark, AWKWARD + extra).repartition(3)
    out = periodic_runs.find_runs(docs)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=repr)
    want = []
    for doc_id, text, *_ in AWKWARD + extra:
        words = (text or "").encode().split()
        runs = [(0, 100_000, 1)] if doc_id == 61 else brute_runs(words)
        want.append((doc_id, len(words), runs, b" ".join(brute_collapsed(words, runs)).decode()))
    assert got == sorted(want, key=repr)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_query_equals_its_definition(spark):
    want = []
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        words = (r.text or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(words)
        top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None, None, None)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        want.append((r.doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                     digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), digest(b" ".join(brute_collapsed(words, runs)))))
    out = QUERIES["op12_periodic_runs"](spark, FOLDER)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(want) and sum(w[1] for w in want) > 10
