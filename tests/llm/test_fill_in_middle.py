"""Fill-in-the-middle examples against plain slicing."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import AWKWARD, awkward

from webgrain.llm import fill_in_middle as fim

MARKED = [(50, "a <P> mark", "en", "s"), (51, "half a mark <S", "en", "s"), (52, "<" * 500, "en", "s"), (53, "ab<S<P<M" * 40, "en", "s"),
          (54, "é中😀 " * 3000, "zz", None), (55, "﻿x\u0000y", "en", "s"), (56, "<M>", "en", "s")]


def expected(doc_id, text, plain_percent=10):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain_percent:
        return doc_id, n, "plain", None, None, None, text
    p, m, s = text[:low], text[low:high], text[high:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark, AWKWARD + MARKED).repartition(3).cache()


@pytest.mark.parametrize("plain_percent", [10, 0, 100])
def test_examples_and_their_way_back(docs, plain_percent):
    made = fim.fill_in_middle(docs, plain_percent=plain_percent)
    assert made.columns == ["doc_id", "n", "form", "prefix", "middle", "suffix", "output"]
    rows = made.select("*", fim.restored_text(F.col("output"), F.col("form")).alias("back")).collect()
    want = [expected(i, t, plain_percent) for i, t, *_ in AWKWARD + MARKED]
    assert sorted((tuple(r)[:-1] for r in rows), key=repr) == sorted(want, key=repr)
    text = {}
    for i, t, *_ in AWKWARD + MARKED:
        text.setdefault(i, []).append(t or "")
    assert all(r.back in text[r.doc_id] for r in rows)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_many_forms_come_back(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" <S ", F.lit("x<"), F.repeat(F.lit("ä<M P> "), F.col("id").cast("int"))).alias("text"))
    rows = fim.fill_in_middle(docs).select("*", fim.restored_text(F.col("output"), F.col("form")).alias("back")).join(docs, "doc_id").collect()
    assert {r.form for r in rows} == {"plain", "psm", "spm"} and all(r.back == r.text for r in rows)


def test_chunks_of_long_texts_find_every_cut():
    rng = random.Random(3)
    text = "".join(rng.choice(["a", "é", "中", "😀", " ", "\n", "\t", "bcd "]) for _ in range(40_000)) + "q" * 50_000
    data = text.encode()
    for unit, places in (("character", None), ("word", [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)])):
        chunks = fim.Chunks(unit)
        count = len(text) if places is None else len(places)
        asked = sorted({0, 1, count - 1, count, count + 5, *(rng.randrange(count) for _ in range(300))})
        n, cuts = chunks.cuts(data, asked)
        assert n == count
        want = [len(data) if k >= count else len(text[:k if places is None else places[k]].encode()) for k in asked]
        assert cuts == want
    assert fim.Chunks().cuts(b"", [0]) == (0, [0]) and fim.Chunks("word").cuts(b" \n ", [0, 1]) == (0, [3, 3])
    with pytest.raises(ValueError):
        fim.Chunks("line")


def test_shared_passages_are_looked_up():
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    chunks = fim.Chunks()
    chunks.count(passage.encode())
    missed = chunks.misses
    chunks.count(("other start " * 40 + passage + " other end").encode())
    # Borders follow the content: all but the chunks at both ends are known.
    assert chunks.misses - missed < 0.1 * missed and chunks.hits > 0.85 * missed


def test_rolling_hash_is_that_of_the_window():
    gear = fim._gear()
    data = np.frombuffer(bytes(random.Random(1).randrange(256) for _ in range(300)), np.uint8)
    slow = []
    for i in range(len(data)):
        state = 0
        for b in data[max(0, i - fim.WINDOW + 1):i + 1]:
            state = (state * 2 + int(gear[b])) & 0xFFFFFFFF
        slow.append(state)
    assert fim.rolling(data, gear).tolist() == slow


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(fim, "MEMORY", 5_000)
    chunks, rng = fim.Chunks(), random.Random(8)
    for _ in range(50):
        text = "".join(rng.choice("xyzé ") for _ in range(4_000))
        assert chunks.count(text.encode()) == 4_000
    assert chunks._held < 5_000 + fim.MOST_CHUNK + 120
