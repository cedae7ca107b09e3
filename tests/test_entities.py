"""Similar names and entities against all pairs, and connected components against union-find."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from webgrain.operators import entities
from webgrain.operators.graph import components


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def linked(a, b):
    longest = max(len(a), len(b))
    return abs(len(a) - len(b)) * 100 <= 15 * longest and 100 * distance(a, b) <= 15 * longest


def grouped(nodes, links):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return {n: find(n) for n in nodes}


def edited(rng, name, times, letters):
    name = list(name)
    for _ in range(times):
        at = rng.randrange(len(name))
        act = rng.random()
        if act < 0.4:
            name[at] = rng.choice(letters)
        elif act < 0.7 and len(name) > 1:
            del name[at]
        else:
            name.insert(at, rng.choice(letters))
    return "".join(name)


@pytest.fixture(scope="module")
def names():
    rng, out = random.Random(9), ["", "a", "ab", "abc", "abd", "aé中", "aé中x"]
    for size in (5, 6, 7, 8, 12, 13, 14, 17, 18, 19, 20, 21, 23, 26, 27, 33, 40, 55):
        for letters in ("ab ", "abcdefghijklmnopqrstuvwxyzéö中😀 "):
            base = "".join(rng.choice(letters) for _ in range(size))
            out += [edited(rng, base, rng.randint(0, 1 + size * 18 // 100), letters) for _ in range(9)]
    # One passage in every name: hot segments.
    out += ["university of applied " + "".join(rng.choice("xyz") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    return out


@pytest.mark.parametrize("block", [256, 5])
def test_names_equal_all_pairs(spark, names, block):
    given = spark.createDataFrame([(n,) for n in [*names, *names[:50], None]], "name string").repartition(3)
    got = [tuple(r) for r in entities.similar_names(given, block=block).collect()]
    want = [(a, b, round(1 - distance(a, b) / max(len(a), len(b)), 4)) for a, b in itertools.combinations(sorted({*names} - {""}), 2) if linked(a, b)]
    # Spark orders strings by their bytes, as code points do.
    assert len(want) > 400 and sorted(g[:2] for g in got) == sorted(w[:2] for w in want)
    assert [g[2] for g in sorted(got)] == pytest.approx([w[2] for w in sorted(want)], abs=2e-4)


def test_few_pairs_leave_blocks(spark, names):
    """All similar pairs, and hardly any other: the edit distance is not taken for every pair that meets."""
    given = spark.createDataFrame([(n, 1) for n in sorted({*names} - {""})], "name string, key int").repartition(2)
    marked = given.withColumn("mark", entities._signature(F.col("name")))
    got = {tuple(r) for r in entities._pairs_in_blocks(marked, ["key"]).collect()}
    pairs = list(itertools.combinations(sorted({*names} - {""}), 2))
    want = {p for p in pairs if linked(*p)}
    assert want <= got and all(a < b for a, b in got) and len(got) < len(want) + len(pairs) / 20


def test_entities_with_a_hot_name_and_handle(spark, names):
    rng = random.Random(2)
    rows = [(i, n, None) for i, n in enumerate(names)]
    rows += [(10_000 + i, "Hot, Name & Co", rng.choice([None, "@Site"])) for i in range(2_000)]
    rows += [(20_000, "other", "SITE"), (20_001, None, "@@site"), (20_002, None, None), (20_003, "  !!", ""), (20_004, None, "alone")]
    table = spark.createDataFrame(rows, "entity_id long, name string, handle string").withColumn("node", F.lit("x")).repartition(3)
    out = entities.resolve_entities(table)
    assert out.columns == [*table.columns, "representative", "n_links"]
    got = {r.entity_id: (r.representative, r.n_links) for r in out.collect()}
    normal = spark.createDataFrame([(r[0], r[1]) for r in rows], "k long, name string").select("k", entities.normal_name(F.col("name")).alias("n"))
    plain = {r.k: r.n or None for r in normal.collect()}
    bare = {k: (h or "").lstrip("@").lower() or None for k, _, h in rows}
    distinct = sorted({n for n in plain.values() if n})
    pairs = [(a, b) for a, b in itertools.combinations(distinct, 2) if linked(a, b)]
    links = [(("n", a), ("n", b)) for a, b in pairs] + [(("n", plain[k]), ("h", bare[k])) for k in plain if plain[k] and bare[k]]
    node = {k: ("n", plain[k]) if plain[k] else ("h", bare[k]) if bare[k] else ("k", k) for k in plain}
    group = grouped({*node.values(), *(x for pair in links for x in pair)}, links)
    least = {}
    for k in sorted(node):
        least.setdefault(group[node[k]], k)
    count = {}
    for a, b in pairs:
        count[a] = count.get(a, 0) + 1
        count[b] = count.get(b, 0) + 1
    assert got == {k: (least[group[node[k]]], count.get(plain[k], 0)) for k in node}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "entity_id long, name string, handle string")
    assert entities.resolve_entities(empty).count() == 0 and entities.similar_names(empty).count() == 0


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 400)] + [(500, i) for i in range(501, 900)] + [(7, 7), (None, 3), (3, None)]
    links += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(180)]
    table = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = {r.node: r.component for r in components(table).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == grouped({x for p in real for x in p}, real)
    assert components(table.where("a = b")).count() == 0


@pytest.mark.parametrize("key_costs", [0, 1 << 40])
def test_both_ways_equal_all_pairs(spark, names, monkeypatch, key_costs):
    """By keys, also hot ones, and in tiles of few names."""
    monkeypatch.setattr(entities, "TILE", 7)
    given = spark.createDataFrame([(n,) for n in names], "name string").repartition(3)
    want = sorted((a, b) for a, b in itertools.combinations(sorted({*names} - {""}), 2) if linked(a, b))
    for costs in (0, 1 << 40):
        monkeypatch.setattr(entities, "BLOCK_COSTS", costs)
        got = [tuple(r)[:2] for r in entities.similar_names(given, block=5, key_costs=key_costs).collect()]
        assert sorted(got) == want


def test_names_of_one_passage_make_few_pairs(spark, monkeypatch):
    """Segments that most names share are not multiplied: names meet at most once for each key, or all of them once."""
    stored = {}
    plain = entities.materialized

    def watched(df, name):
        out = plain(df, name)
        stored[name] = stored.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(entities, "materialized", watched)
    rng = random.Random(5)
    words = ["the ", "tion ", "and ", "er ", "en ", "ing "]
    names = ["".join(rng.choice(words) for _ in range(16))[:60].strip() for _ in range(400)]
    got = entities.similar_names(spark.createDataFrame([(n,) for n in names], "name string").repartition(3)).collect()
    assert len(got) == sum(linked(a, b) for a, b in itertools.combinations(sorted(set(names)), 2))
    assert sum(stored.values()) < 200_000
