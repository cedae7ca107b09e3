"""Documents linked by the Jaccard similarity of their word n-grams.

Method: size-aware heavy-light join.

*Light* sets (up to a boundary size) enumerate fixed-size subsets: two sets of n
and m shingles are linked exactly if they share a subset of o(n, m) shingles, the
least overlap, so equal subset keys are links.  *Heavy* sets scan inverted lists, of one of two kinds.

At a high similarity a list's key is not one shingle but a *slice* of the set: the shingles whose hash
falls into one of P parts, where P is so much more than the shingles by which linked
sets of that size class may differ that they have at least one slice with something in it in
common (``sliced``).  A slice holds several shingles, so neither a passage that many
documents share nor a phrase that meets by chance makes a long list, and empty slices make none.

At a lower one slices would hold few shingles and be many.  There the lists are those of a set's *first shingles*
in one order of all (of n shingles the first n - least + 1, where least is what a partner must share; linked sets
have one of them in common).  The order puts shingles that many documents
share last: a passage or a licence line that is everywhere makes no list, unless documents
consist of it.  Any order finds all links, so it rests on counts that are cheap: every task counts the
shingles it has seen, hands on those it saw several times, and a bit map of bounded size
remembers which are frequent.  The boundary is chosen by cost: the subsets
to enumerate against the list entries to scan, counted on the light sets at hand.

Equal sets collapse first (a 128-bit digest of the set; a clash of the 64-bit ids
used after that is detected and raises).  Lists do not become pairs:

1. every list member is compared with its list's smallest member (linear);
2. what is still in different components meets within the lists, in blocks of
   bounded size, on parity sketches whose distance never exceeds the true
   difference; a block reports only a forest of possible links, not all of them;
3. after two such rounds, all remaining possible links are reported, also those
   of lists of two: a set tests only its nearest hub in step 1.

Possible links are verified on the texts themselves.  A pair that is already in one
component is never looked at again: it can't change the result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.llm.common import LAST_ID, carried, map_batches, restored, ship, text_digest, whole
from webgrain.session import discard, in_slices, materialized

SHINGLE = 3
PERCENT = 90
# Light sets have at most so many shingles; the boundary is chosen below it.
LIGHTEST = 24
# Lists are slices of sets where these hold so many shingles or more, and first shingles elsewhere.
HELD = 8
# Growth of a size class of heavy sets; hashes by which a set is sliced until it has enough slices.
CLASS, SALTS = 1.4, 8
# Layouts of size classes that were worked out.
_LAYOUTS: dict[tuple[int, int], tuple[int, int]] = {}
# A shingle is frequent from so many documents on; more if there are more than ``MOST_FREQUENT`` such shingles.
FREQUENT, MOST_FREQUENT = 4, 1 << 22
# A task counts so many shingles together, and hands on what it saw so often among them.
COUNTED, LOCALLY = 1 << 20, 2
# Bits of the map of frequent shingles.
MAP_BITS = 26
# List members that meet in one block.
BLOCK = 4096
# Rows that fetch a sketch in one slice of the work, and pairs that fetch two texts, for each set that is in a list; so many at least.
SKETCHED, FETCHED, LEAST_SLICE = 2, 1, 10_000
# Narrow rows that one task may hold: two ids each.
ONE_TASK = 200_000
# Bits of a sketch for each shingle that linked sets may differ by.
SKETCH = 16

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# Sets ------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Ascending hashes of the distinct shingles; A-Z in lower case, words between ASCII blanks."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    total = np.full(len(codes) - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed(total) + codes[k:k + len(total)]
    return np.unique(mixed(total))


def overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """Least common shingles of linked sets of n and m: 100 o >= percent (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def differing(n: int, m: int, percent: int = PERCENT) -> int:
    """Most shingles by which linked sets of n and m differ."""
    return n + m - 2 * overlap(n, m, percent)


def partners(n: int, percent: int = PERCENT) -> range:
    """Sizes that a set of n can be linked with."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def size_class(n: int) -> tuple[int, int, int]:
    """Number, first size and last size of the class of heavy sets that ``n`` is in."""
    number, first = 0, 1
    while True:
        last = max(first, math.ceil(first * CLASS) - 1)
        if n <= last:
            return number, first, last
        number, first = number + 1, last + 1


def layout(first: int, last: int, percent: int) -> tuple[int, int]:
    """Most shingles by which linked sets of a size class differ, and the parts of the hash space for it.

    There are so many parts that a set has more than that many slices with something in them, but for one
    set in some hundreds; a slice that is empty in both sets says nothing and gets no key.
    """
    # The bound for all pairs of the class; ``differing`` itself goes up and down with the sizes.
    most = 2 * last * (100 - percent) // (100 + percent)
    least, parts = max(1, -(-percent * first // 100)), most + 1
    while True:
        fill = least / parts
        empty = parts * math.exp(-fill)
        spread = math.sqrt(max(0.0, parts * (math.exp(-fill) - (1 + fill) * math.exp(-2 * fill))))
        if parts - most > empty + 2.5 * spread or parts > 4 * (most + 2):
            return most, parts
        parts += max(1, parts // 50)


def sliced(codes: np.ndarray, number: int, most: int, parts: int) -> np.ndarray:
    """A key for each slice of the set, in the group of a size class, that has something in it.

    Of linked sets at most ``most`` slices differ.  So if one of the two has more slices than that, they have an equal
    one.  A set with fewer is sliced anew by another hash, and anew; two such sets meet in the last of these that
    both go through, or, after ``SALTS`` of them, by the class alone.
    """
    out = []
    for salt in range(SALTS):
        place = codes if salt == 0 else mixed(codes + np.uint64(salt))
        part = (place >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        values = mixed(codes)
        if salt:
            order = np.argsort(part, kind="stable")
            part, values = part[order], values[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums = np.add.reduceat(values, starts)
        out.append(mixed(sums ^ mixed(part[starts] + np.uint64((number << 44) + (salt << 40)))))
        if len(starts) > most:
            return np.concatenate(out)
    return np.concatenate([*out, mixed(np.array([(1 << 61) + number], np.uint64))])


def slice_keys(codes: np.ndarray, percent: int = PERCENT, above: int = 0) -> np.ndarray:
    """List keys of a set for links whose larger set has more than ``above`` shingles.

    A pair belongs to the class of its larger set; a set near the end of its class also enters the next one.
    """
    n = len(codes)
    most = partners(n, percent)[-1]
    if most <= above:
        return np.zeros(0, np.uint64)
    number, first, last = size_class(n)
    out = []
    while True:
        if last > above:
            key = (number, percent)
            if key not in _LAYOUTS:
                _LAYOUTS[key] = layout(first, last, percent)
            out.append(sliced(codes, number, *_LAYOUTS[key]))
        if most <= last:
            return np.concatenate(out)
        number, first, last = size_class(last + 1)


def prefix_keys(codes: np.ndarray, frequent: np.ndarray, percent: int = PERCENT, above: int = 0) -> np.ndarray:
    """Shingles of a set whose lists it enters for links whose larger set has more than ``above`` shingles.

    ``codes`` ascend; ``frequent`` is the bit map of shingles that come last in the order.
    """
    n = len(codes)
    if not n or partners(n, percent)[-1] <= above:
        return np.zeros(0, np.uint64)
    place = codes >> np.uint64(64 - MAP_BITS)
    late = (frequent[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    # A partner shares at least percent / 100 of n.
    size = n + percent * n // -100 + 1
    return np.concatenate([codes[~late], codes[late]])[:size]


def by_slices(percent: int) -> bool:
    """Whether slices hold enough shingles to be the better lists."""
    return 100 + percent >= 2 * HELD * (100 - percent)


def list_keys(codes: np.ndarray, frequent: np.ndarray | None, percent: int, above: int) -> np.ndarray:
    """Keys of the lists that a set enters for links whose larger set has more than ``above`` shingles."""
    return slice_keys(codes, percent, above) if frequent is None else prefix_keys(codes, frequent, percent, above)


def subset_rows(n: int, percent: int, upto: int) -> int:
    """Subset keys of a set of n for links whose larger set has at most ``upto``."""
    return sum(math.comb(n, overlap(n, m, percent)) for m in partners(n, percent) if 0 < m and max(n, m) <= upto)


def subset_keys(codes: np.ndarray, percent: int, upto: int) -> np.ndarray:
    """A key for each subset of the least overlap, for each size of partner up to ``upto``."""
    n, out = len(codes), []
    values = mixed(codes)
    total = values.sum(dtype=np.uint64)
    for m in partners(n, percent):
        if m < 1 or max(n, m) > upto:
            continue
        left_out = n - overlap(n, m, percent)
        chosen = np.array(list(itertools.combinations(range(n), left_out)), np.int64).reshape(math.comb(n, left_out), left_out)
        sums = total - values[chosen].sum(axis=1, dtype=np.uint64)
        out.append(mixed(sums ^ mixed(np.array([(1 << 62) + (min(n, m) << 20) + max(n, m)], np.uint64))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(codes: np.ndarray, percent: int = PERCENT) -> bytes:
    """Parity of the shingles in each of a power of two of cells: cells that differ are at most the shingles that do."""
    n = len(codes)
    width = max(64, 1 << (SKETCH * differing(n, n, percent)).bit_length())
    cells = np.bincount((codes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").tobytes()


def folded(data: bytes, size: int) -> np.ndarray:
    """A sketch brought to ``size`` bytes."""
    cells = np.frombuffer(data, np.uint8)
    while len(cells) > size:
        half = len(cells) // 2
        cells = cells[:half] ^ cells[half:]
    return cells


# Stages ----------------------------------------------------------------------


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, text, digest: ids may be NULL or repeat, so the digest of the text goes with them."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_id"), whole(F.col(text_col)).alias("text"),
        text_digest(F.col(text_col)).alias("digest"))


def frequent_shingles(docs: DataFrame, text_col: str, size: int) -> Broadcast:
    """A bit map of shingles that many rows have, by the first bits of their hash; at most 2^``MAP_BITS`` bits, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(waiting), return_counts=True)
            often = n >= LOCALLY
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["code", "n"])

        held = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                codes = shingles(text, size)
                waiting.append(codes)
                held += len(codes)
                if held >= COUNTED:
                    yield counted()
                    held = 0
        if held:
            yield counted()

    spark = docs.sparkSession
    seen = map_batches(docs.select(whole(F.col(text_col)).alias("text")), count, "code long, n long")
    seen = materialized(seen.groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "frequent")
    levels = [FREQUENT << k for k in range(0, 40, 2)]
    above = seen.agg(*[F.count(F.when(F.col("n") >= x, 1)).alias(str(x)) for x in levels]).first()
    least = next((x for x in levels if above[str(x)] <= MOST_FREQUENT), levels[-1])
    place = F.shiftrightunsigned("code", 64 - MAP_BITS)
    parts = seen.where(F.col("n") >= least).select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    # At most 2^(MAP_BITS - 15) rows of 4 KB.
    for row in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bits[row["part"] << 12:(row["part"] + 1) << 12] = np.frombuffer(bytes(row["bits"]), np.uint8)
    discard(seen)
    return ship(spark, bits, bits.nbytes)


def described(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, frequent: Broadcast | None) -> DataFrame:
    """_id, digest (of the text), sid, d2 (the digest of the set), n, sketch, keys (heavy sets), codes (sets that may be light)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                codes = shingles(text, size)
                n = len(codes)
                digest = xxhash.xxh3_128_digest(codes.tobytes()) if n else bytes(16)
                light = n <= LIGHTEST
                rows.append((
                    int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), n,
                    sketch(codes, percent) if n else b"", [] if light else list_keys(codes, frequent and frequent.value, percent, LIGHTEST).view(np.int64),
                    codes.tobytes() if light else b""))
            sid, d2, n, sk, keys, small = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(sid, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int64()),
                pa.array(sk, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(small, pa.binary())],
                ["_id", "digest", "sid", "d2", "n", "sketch", "keys", "codes"])

    return map_batches(_given(docs, id_col, text_col), work, "_id long, digest binary, sid long, d2 long, n long, sketch binary, keys array<long>, codes binary")


def light_keys(rows: DataFrame, percent: int, boundary: int, frequent: Broadcast | None) -> DataFrame:
    """(sid, n, key, heavy) of sets that may be light: subsets up to the boundary, first shingles for larger partners."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, sizes, keys, kinds = [], [], [], []
            for sid, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = np.frombuffer(data, np.uint64)
                for kind, found in enumerate((subset_keys(codes, percent, boundary), list_keys(codes, frequent and frequent.value, percent, boundary))):
                    sids += [sid] * len(found)
                    sizes += [n] * len(found)
                    kinds += [kind == 1] * len(found)
                    keys += found.view(np.int64).tolist()
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(kinds)],
                    ["sid", "n", "key", "heavy"])

    return map_batches(rows.select("sid", "n", "codes"), work, "sid long, n long, key long, heavy boolean")


def chosen_boundary(light: DataFrame, percent: int, frequent: Broadcast | None) -> int:
    """The size up to which enumerating subsets costs less than scanning lists; costs are summed by size."""
    scanned = light_keys(light, percent, 0, frequent).select("n", "key")
    lengths = scanned.groupBy("key").agg(F.count("*").alias("length"))
    # An entry of a list costs one step for each other entry, which one pass over the counts tells.
    scan = scanned.groupBy("key", "n").agg(F.count("*").alias("c")).join(lengths, "key").groupBy("n").agg(
        F.sum(F.col("c") * F.col("length").cast("double")).alias("cost"))
    sizes = light.groupBy("n").agg(F.count("*").alias("c")).join(scan, "n", "left").collect()  # at most LIGHTEST rows
    best = (math.inf, 0)
    for boundary in range(LIGHTEST + 1):
        cost = sum(
            r["c"] * subset_rows(r["n"], percent, boundary) if r["n"] <= boundary else (r["cost"] or 0.0) for r in sizes)
        best = min(best, (cost, -boundary))
    return -best[1]


def inverted_lists(rows: DataFrame, percent: int, frequent: Broadcast | None) -> DataFrame:
    """(key, sid) of all lists that hold at least two different sets."""
    light = materialized(
        rows.where(f"n > 0 AND n <= {LIGHTEST}").groupBy("sid", "n").agg(F.min("codes").alias("codes")), "light-sets")
    boundary = chosen_boundary(light, percent, frequent)
    entries = rows.where(f"n > {LIGHTEST}").select(F.explode("keys").alias("key"), "sid")
    entries = entries.unionByName(light_keys(light, percent, boundary, frequent).select("key", "sid"))
    # Most keys stand alone: counting combines map-side and moves keys only.
    often = materialized(entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared-keys")
    # Stored, so that both sides of the join are plain shuffles, which Spark splits where one key is hot.
    shared = materialized(entries.join(often.hint("shuffle_hash"), "key").distinct(), "list-entries")
    discard(light, often)
    # Lists of the same sets say the same: one of them stays, told by two hashes over its members.
    members = shared.groupBy("key").agg(
        F.count("*").alias("c"), *[F.bit_xor(F.xxhash64("sid", F.lit(k))).alias(f"x{k}") for k in (1, 2)]).where("c > 1")
    kept = materialized(members.groupBy("c", "x1", "x2").agg(F.min("key").alias("key")).select("key"), "different-lists")
    lists = materialized(shared.join(kept.hint("shuffle_hash"), "key"), "lists")
    discard(shared, kept)
    return lists


def hub_pairs(lists: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b): each set with one smallest member of its lists, the one that looks nearest, if any may be a link.

    ``most`` rows at a time fetch their sketches.
    """
    hubs = materialized(lists.groupBy("key").agg(F.min("sid").alias("b")), "hubs")
    pairs = materialized(lists.join(hubs, "key").where("sid <> b").select(F.col("sid").alias("a"), "b").distinct(), "hub-rows")
    mine = sets.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    theirs = sets.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, n, s, m, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = min(len(s), len(t))
                apart = int(np.bitwise_count(folded(s, size) ^ folded(t, size)).sum())
                if apart <= differing(n, m, percent) and overlap(n, m, percent) <= min(n, m):
                    found.append((a, b, apart))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b", "apart"])

    def nearest(pairs: DataFrame) -> DataFrame:
        seen = map_batches(pairs.join(mine, "a").join(theirs, "b").select("a", "b", "n_a", "s_a", "n_b", "s_b"), near, "a long, b long, apart long")
        # By distance, then id: the nearest hub of a set.
        return seen.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best")).select("a", F.col("best.b").alias("b"))

    out = in_slices(pairs, ["a"], most, nearest, "hub-pairs")
    discard(hubs, pairs)
    return out


def block_pairs(lists: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, forest: bool, most: int) -> DataFrame:
    """(a, b) of different components that share a list and may be linked: a forest for each block, or all of them.

    ``most`` rows at a time fetch their sketches.
    """
    rows = lists.join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    mixed_lists = rows.groupBy("key").agg(
        F.count("*").alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    mixed_lists = materialized(mixed_lists.select("key", blocks.alias("blocks")), "mixed-lists")
    mine = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    rows = rows.join(mixed_lists, "key").withColumn("mine", mine)
    # A long list is cut; each of its blocks meets each other one once.
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("other", other).select(
        "key", "sid", "comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    rows = materialized(rows, "block-rows")
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, []

        def found() -> list[tuple[int, int]]:
            return possible_links(members, percent, forest) if len(members) > 1 else []

        for batch in batches:
            out = []
            for *here, sid, comp, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != group:
                    out += found()
                    group, members = here, []
                members.append((sid, comp, n, data))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
        if out := found():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    def compared(rows: DataFrame) -> DataFrame:
        rows = rows.join(sets.select("sid", "n", "sketch"), "sid").select("key", "i", "j", "sid", "comp", "n", "sketch")
        rows = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "sid")
        return map_batches(rows, work, "a long, b long").distinct()

    found = in_slices(rows, ["key", "i", "j"], most, compared, "slice-pairs")
    out = materialized(found.distinct(), "pairs")
    discard(mixed_lists, rows, found)
    return out


def possible_links(members: list[tuple[int, int, int, bytes]], percent: int, forest: bool) -> list[tuple[int, int]]:
    """Pairs of different components in a block whose sketches allow a link; as a forest, at most one for each joining of components."""
    size = min(len(m[3]) for m in members)
    cells = np.stack([folded(m[3], size) for m in members])
    words = cells.view(np.uint64)
    sizes = np.array([m[2] for m in members], np.int64)
    names, comp = np.unique(np.array([m[1] for m in members], np.int64), return_inverse=True)
    out = []
    for i in range(len(members) - 1):
        if len(names) < 2 or (forest and (comp == comp[0]).all()):
            break
        apart = np.bitwise_count(words[i + 1:] ^ words[i]).sum(axis=1)
        both = sizes[i + 1:] + sizes[i]
        least = -(-percent * both // (100 + percent))
        may = (comp[i + 1:] != comp[i]) & (apart <= both - 2 * least) & (least <= np.minimum(sizes[i + 1:], sizes[i]))
        for j in np.flatnonzero(may) + i + 1:
            if forest:
                if comp[j] == comp[i]:
                    continue
                comp[comp == comp[j]] = comp[i]
            a, b = members[i][0], members[int(j)][0]
            out.append((min(a, b), max(a, b)))
    return out


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, most: int) -> DataFrame:
    """The pairs (a, b) that are links, by the shingles of their texts, which ``most`` pairs fetch at a time."""
    asked: list[DataFrame] = []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            good = []
            for k in range(len(a)):
                s, t = shingles(x[k], size), shingles(y[k], size)
                common = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * common >= percent * (len(s) + len(t) - common))
            kept = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    def linked(pairs: DataFrame) -> DataFrame:
        # Where few texts are asked for, no others are shuffled.
        ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))
        asked.append(materialized(ends.distinct(), "asked"))
        own = texts.join(asked[-1], "sid", "left_semi")
        left = own.select(F.col("sid").alias("a"), F.col("text").alias("t_a"))
        right = own.select(F.col("sid").alias("b"), F.col("text").alias("t_b"))
        return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "t_a", "t_b"), work, "a long, b long")

    out = in_slices(pairs, ["a", "b"], most, linked, "links")
    discard(*asked)
    return out


def components(links: DataFrame) -> DataFrame:
    """(sid, comp) of every end of a link; comp is the smallest sid that it reaches.

    Every round hooks each node to its smallest neighbour and contracts the links;
    as set ids are hashes, a constant share of the nodes goes in each round.  Links
    that fit one partition stay in one, so that late rounds need no exchange.
    """
    hooks = []
    edges = _sized(materialized(links.select("a", "b"), "edges"))
    stored = [edges]
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = _sized(materialized(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up")), "hooks"))
        hooks.append(hook)
        moved = edges.join(hook, "a").select("b", F.col("up").alias("u")).join(
            hook.select(F.col("a").alias("b"), F.col("up").alias("v")), "b")
        moved = moved.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        edges = _sized(materialized(moved.distinct(), "edges"))
        stored += [hook, edges]
        if edges.isEmpty():
            break
    found = hooks.pop()
    while hooks:
        below = hooks.pop()
        above = found.select(F.col("a").alias("up"), F.col("up").alias("top"))
        found = below.join(above, "up", "left").select("a", F.coalesce("top", "up").alias("up"))
    labels = materialized(found.select(F.col("a").alias("sid"), F.col("up").alias("comp")), "components")
    discard(*stored)
    return labels


def _sized(stored: DataFrame) -> DataFrame:
    """A stored table in one partition if it has at most ``ONE_TASK`` rows, as it is beyond."""
    return stored.coalesce(1) if stored.count() <= ONE_TASK else stored


def linked_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``docs``.

    Two documents are linked when ``100 * common >= percent * union`` of their
    distinct shingles of ``size`` words; a shorter text is one shingle, and a text
    without words (or NULL) is linked with nothing.  ``component_id`` is the
    smallest doc_id that links reach.  NULL ids come after all others; a component
    of such rows alone has a NULL ``component_id``.  Repeated rows have equal sets and
    share a component.  Extra columns are ignored; an empty table gives an empty result.
    """
    rows, named, labels = _labelled(docs, id_col, text_col, size, percent)
    least = materialized(named.join(labels, "sid", "left").select("sid", F.coalesce("comp", "sid").alias("comp"), "first"), "labelled")
    firsts = materialized(least.groupBy("comp").agg(F.min("first").alias("component")), "least-ids")
    answers = materialized(least.join(firsts, "comp").select("sid", "component"), "answers")
    discard(named, labels, least, firsts)
    out = rows.select("_id", "sid", "n").join(answers, "sid", "left")
    nullable = lambda c: F.when(c != LAST_ID, c)
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id"))
    return out.select(nullable(F.col("_id")).alias("doc_id"), F.col("n").alias("n_shingles"), nullable(component).alias("component_id"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (_id, digest, sid, n, ...), the sets (sid, first, n) and the components of linked sets (sid, comp)."""
    spark = docs.sparkSession
    frequent = None if by_slices(percent) else frequent_shingles(docs, text_col, size)
    rows = materialized(described(docs, id_col, text_col, size, percent, frequent), "sets")
    sets = rows.where("n > 0").groupBy("sid").agg(
        F.min("_id").alias("first"), F.min("n").alias("n"), F.min("d2").alias("low"), F.max("d2").alias("high"))
    clash = sets.where("low <> high").limit(1).count()
    if clash:
        raise ValueError("two different sets have the same 64-bit id")
    lists = inverted_lists(rows, percent, frequent)
    listed = materialized(lists.select("sid").distinct(), "listed")
    named = materialized(sets.select("sid", "first", "n"), "named")
    # What the comparisons need, for sets in lists only: the sketch, and one text that has the set, by id and digest.
    wanted = rows.where("n > 0").select("sid", "_id", "n", "sketch", "digest").join(
        listed.join(named.select("sid", F.col("first").alias("_id")), "sid"), ["sid", "_id"])
    wanted = wanted.groupBy("sid", "_id", "digest").agg(
        F.count("*").alias("copies"), F.min("n").alias("n"), F.first("sketch").alias("sketch"))
    wanted = materialized(wanted.dropDuplicates(["sid"]), "sketches")
    sketches = wanted.select("sid", "n", "sketch")
    # From here on rows go without what made the lists.
    slim = materialized(rows.select("_id", "digest", "sid", "n"), "set-rows")
    discard(rows, listed)
    texts = materialized(
        _given(docs, id_col, text_col).join(wanted.select("sid", "_id", "digest", "copies").hint("shuffle_hash"), ["_id", "digest"])
        .select("sid", "text", "copies"), "texts")
    # Rows that repeat id and text fetch it as often; one is enough.
    once = materialized(texts.where("copies > 1").dropDuplicates(["sid"]), "repeated-texts")
    texts = texts.where("copies = 1").unionByName(once).select("sid", "text")
    labels = _joined(spark, lists, sketches, texts, size, percent)
    discard(lists, wanted, texts)
    return slim, named, labels


def _joined(spark: SparkSession, lists: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(sid, comp) over all links."""
    sets = max(LEAST_SLICE, sketches.count())
    pairs = hub_pairs(lists, sketches, percent, SKETCHED * sets)
    links = verified(pairs, texts, size, percent, FETCHED * sets)
    discard(pairs)
    for forest in (True, True, False):
        labels = components(links)
        pairs = block_pairs(lists, sketches, labels, percent, forest, SKETCHED * sets)
        if pairs.isEmpty():
            discard(pairs, links)
            return labels
        discard(labels)
        links = links.unionByName(verified(pairs, texts, size, percent, FETCHED * sets))
        discard(pairs)
    labels = components(links)
    discard(links)
    return labels


def keep_first(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT,
) -> DataFrame:
    """Rows of ``docs`` that stay: of each component one, of the smallest id (NULL last); same columns.

    Rows of one id, or without id, are told apart by their texts: of several that share the smallest id the
    one with the smallest digest of its text stays.  Texts without words are copies of nothing and all stay.
    """
    rows, named, labels = _labelled(docs, id_col, text_col, size, percent)
    labels = labels.withColumnRenamed("sid", "_sid")
    own = rows.where("n > 0").groupBy("sid", "_id", "digest").agg(F.count("*").alias("copies"))
    own = own.join(labels, F.col("sid") == F.col("_sid"), "left").withColumn("comp", F.coalesce("comp", "sid"))
    own = materialized(own.select("comp", "_id", "digest", "copies"), "members")
    first = materialized(own.groupBy("comp").agg(F.min(F.struct("_id", "digest")).alias("stays")), "first-members")
    judged = own.join(first, "comp").withColumn("stays", F.col("stays") == F.struct("_id", "digest"))
    judged = materialized(judged.where("NOT stays OR copies > 1").select(
        F.col("_id").alias("_gone"), F.col("digest").alias("_gone_digest"), "stays"), "judged")
    discard(rows, named, labels, own, first)
    keyed = carried(docs, _key=F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), _digest=text_digest(F.col(text_col)))
    same = (F.col("_key") == F.col("_gone")) & (F.col("_digest") == F.col("_gone_digest"))
    out = keyed.join(judged.hint("shuffle_hash"), same, "left_anti")
    repeated = judged.where("stays")
    if not repeated.isEmpty():
        # Rows that repeat id and text of one that stays: one of them.
        out = out.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(["_key", "_digest"]))
    return restored(out, docs.columns)
