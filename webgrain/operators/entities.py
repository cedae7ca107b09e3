"""Entity tables, similar names and pair verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from webgrain.functions.scalars import tolerant_json
from webgrain.functions.text import let, strip
from webgrain.operators.graph import components
from webgrain.session import dealt, materialized

MATCH_AT = 0.85


def entity_table(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """One row per entity of a stored answer.

    Accepts an object with an ``entities`` list, the same object in a one-item
    list, or a bare list; anything else yields no rows.
    """
    value = tolerant_json(F.col(body), object_only=False)
    items = lambda v: F.coalesce(
        F.try_variant_get(v, "$.entities", "array<variant>"),
        F.when(
            F.try_variant_get(v, "$[1]", "variant").isNull(),
            F.try_variant_get(v, "$[0].entities", "array<variant>"),
        ),
        F.try_variant_get(v, "$", "array<variant>"),
    )
    rows = answers.select(key, F.posexplode(let(value, items)).alias("pos", "entity"))
    get = lambda name, kind: F.try_variant_get("entity", f"$.{name}", kind).alias(name)
    return rows.select(
        key, "pos", get("name", "string"), get("type", "string"), get("handle", "string"),
        get("url", "string"), get("confidence", "double"),
    )


def normal_name(name: Column) -> Column:
    """Lower case, letters and digits only, single blanks."""
    plain = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " ")
    return strip(plain)


def pair_score(name_a: Column, name_b: Column) -> Column:
    """Edit similarity of two normalised names, 0.0 to 1.0."""
    longest = F.greatest(F.length(name_a), F.length(name_b))
    return F.when(
        longest > 0, F.lit(1.0) - F.levenshtein(name_a, name_b) / longest
    ).otherwise(F.lit(0.0))


def resolve_pairs(pairs: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Verdict for every given pair; the caller names the pairs.

    ``pairs``: pair_id, name_a, handle_a, name_b, handle_b.  A stored verdict
    (pair_id, match, confidence, reasoning) wins; else equal handles or similar
    names decide; pairs without usable names are no match with confidence 0.
    """
    a, b = normal_name(F.col("name_a")), normal_name(F.col("name_b"))
    handle = lambda c: F.nullif(F.lower(F.regexp_replace(c, "^@+", "")), F.lit(""))
    same_handle = F.coalesce(handle(F.col("handle_a")) == handle(F.col("handle_b")), F.lit(False))
    score = F.round(F.when(same_handle, F.lit(1.0)).otherwise(F.coalesce(pair_score(a, b), F.lit(0.0))), 4)
    rows = pairs.withColumn("__score", score).withColumn("__same", same_handle)
    match, confidence = F.col("__score") >= MATCH_AT, F.col("__score")
    reason = F.when(F.col("__same"), "same handle").when(match, "similar names").otherwise("")
    if verdicts is not None:
        stored = verdicts.select(
            "pair_id", F.col("match").alias("__m"), F.col("confidence").alias("__c"),
            F.col("reasoning").alias("__r"),
        )
        rows = rows.join(stored, "pair_id", "left")
        match = F.coalesce(F.col("__m"), match)
        confidence = F.coalesce(F.col("__c"), confidence)
        reason = F.coalesce(F.col("__r"), reason)
    return rows.select(
        *pairs.columns, match.alias("match"), confidence.alias("confidence"), reason.alias("reasoning")
    )


# --- I9: pairs from names alone ---------------------------------------------------------
# Two names are similar if their edit distance is at most so many percent of the longer one.
EDIT_PERCENT = 15
# Pairs of names up to this length meet in deletion neighbourhoods, others in segments: up to two edits are possible here.
SHORT_NAME = 19
# Names that are compared in one block.
BLOCK = 256
# Words of 64 bits that sum a name up.
SIGNATURE = 4
# Pairs that are compared at once.
PAIRS_TOGETHER = 1 << 20
# Names of a tile, and tiles that a table of names is cut into if these would be more: a name goes to as many tasks.
TILE, TILES = 4096, 32
# What a key of a name costs, in pairs whose signatures are compared in a tile; a pair of a block costs as much as several.
KEY_COSTS, BLOCK_COSTS = 1000, 8
# Names of so many characters differ by so many bits as similar ones may: the edit distance is taken for most of their pairs.
LONG_NAME = 160


def edits(length: Column) -> Column:
    """Edits that a pair may be apart whose longer name has ``length`` characters."""
    return F.floor(length * EDIT_PERCENT / 100).cast("int")


def _longest_partner(length: Column) -> Column:
    return F.floor(length * 100 / (100 - EDIT_PERCENT)).cast("int")


def _shortest_partner(length: Column) -> Column:
    return F.ceil(length * (100 - EDIT_PERCENT) / 100).cast("int")


def similar(a: Column, b: Column) -> Column:
    """Whether two names are at most ``EDIT_PERCENT`` of the longer one apart."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    near = F.abs(F.char_length(a) - F.char_length(b)) <= edits(longest)
    # With a bound the distance is -1 beyond it, and costs less.
    return near & (F.call_function("levenshtein", a, b, edits(longest)) >= 0)


def _upto(first: Column, last: Column) -> Column:
    """first ... last, empty if last is smaller."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _without_one(name: Column) -> Column:
    """The name with each one of its characters left out."""
    return F.transform(
        _upto(F.lit(1), F.char_length(name)), lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)))


def _deletion_keys(name: Column) -> Column:
    """Hashes of what is left of a short name without up to as many characters as it may be edited.

    Two names that are k edits apart have a string in common that leaves out at most k characters of either.
    """
    n = F.char_length(name)
    most = edits(F.least(F.lit(SHORT_NAME), _longest_partner(n)))
    one = _without_one(name)
    left = F.concat(
        F.array(name), F.when(most >= 1, one).otherwise(F.array().cast("array<string>")),
        F.when(most >= 2, F.flatten(F.transform(one, _without_one))).otherwise(F.array().cast("array<string>")))
    hashed = F.transform(F.array_distinct(left), lambda s: F.xxhash64(F.lit("deletion"), s))
    return F.when((n <= SHORT_NAME) & (most >= 1), hashed).otherwise(F.array().cast("array<bigint>"))


def _each(values: Column, keys) -> Column:  # noqa: ANN001
    return F.flatten(F.transform(values, keys))


def _segment_keys(name: Column) -> Column:
    """Hashes of segments, for pairs whose longer name has more than ``SHORT_NAME`` characters.

    The shorter name is cut into k + 1 segments, k being the edits that the pair may be apart: one
    of them is untouched, and stands in the longer name not further from its place than k
    edits can shift it with the lengths' difference made up on the other side.
    """
    n = F.char_length(name)

    def keys(shorter: Column, k: Column, shifts) -> Column:  # noqa: ANN001
        parts = k + 1
        start = lambda i: F.floor(i * shorter / parts).cast("int")

        def placed(i: Column) -> Column:
            """(hash of segment i as it stands at a place of this name) for each place."""
            size = start(i + 1) - start(i)
            fits = F.filter(shifts, lambda d: (start(i) + d >= 0) & (start(i) + d + size <= n))
            return F.transform(fits, lambda d: F.xxhash64(
                F.lit("segment"), shorter, k, i, F.substr(name, start(i) + d + 1, size)))

        return _each(F.sequence(F.lit(0), parts - 1), placed)

    own = F.array(F.lit(0))
    # As the shorter one: segments of its own, for the edits of each longer partner.
    low, high = edits(F.greatest(n, F.lit(SHORT_NAME + 1))), edits(_longest_partner(n))
    as_shorter = _each(_upto(low, high), lambda k: keys(n, k, own))
    # As the longer one: what it has where segments of each shorter partner may stand.
    mine = edits(n)
    as_longer = _each(_upto(_shortest_partner(n), n), lambda m: keys(m, mine, _upto(
        -F.floor((mine - (n - m)) / 2).cast("int"), F.floor((mine + (n - m)) / 2).cast("int"))))
    none = F.array().cast("array<bigint>")
    both = F.concat(
        F.when(_longest_partner(n) > SHORT_NAME, as_shorter).otherwise(none), F.when(n > SHORT_NAME, as_longer).otherwise(none))
    return F.array_distinct(both)


def _signature(name: Column) -> Column:
    """``SIGNATURE`` words of 64 bits; a bit tells whether an odd number of the name's neighbouring characters hash to it.

    An edit takes at most two neighbours away and adds as many, so it turns at most four bits.  Neighbours that a name
    has several times are told apart by how often they came before: else an even number of them would leave no trace.
    """
    pairs = F.transform(_upto(F.lit(1), F.char_length(name) - 1), lambda i: F.xxhash64(F.substr(name, i, F.lit(2))))
    marks = lambda ordered: F.transform(ordered, lambda x, i: F.pmod(F.xxhash64(
        x, i.cast("long") - F.call_function("array_position", ordered, x)), F.lit(64 * SIGNATURE)).cast("int"))
    word = lambda marked, k: F.aggregate(marked, F.lit(0).cast("long"), lambda bits, m: bits.bitwiseXOR(
        F.when(F.floor(m / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(m, F.lit(64)))).otherwise(F.lit(0).cast("long"))))
    words = let(let(F.sort_array(pairs), marks), lambda marked: F.struct(*[word(marked, k).alias(f"w{k}") for k in range(SIGNATURE)]))
    return let(words, lambda w: F.struct(F.char_length(name).alias("size"), *[w[f"w{k}"].alias(f"w{k}") for k in range(SIGNATURE)]))


def _pairs_in_blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of names that share ``by`` and may be similar; blocks are bounded, and only such pairs leave them.

    Names are not similar if their lengths or signatures are too far apart.
    """
    blocks = dealt(rows, *by).groupBy(*by).agg(F.collect_set(F.struct("name", "mark")).alias("members")).select("members")
    percent, words, together = EDIT_PERCENT, SIGNATURE, PAIRS_TOGETHER

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            flat, counts = members.flatten(), members.value_lengths().to_numpy()
            name, mark = pc.struct_field(flat, "name"), pc.struct_field(flat, "mark")
            size = pc.struct_field(mark, "size").to_numpy().astype(np.int64)
            bits = [pc.struct_field(mark, f"w{k}").to_numpy() for k in range(words)]
            # A member meets those that stand after it in its block.
            last = np.repeat(np.cumsum(counts), counts)
            place = np.arange(len(size))
            partners = last - place - 1
            ends = np.cumsum(partners)
            at = 0
            while at < len(size):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + together, "right")))
                n = partners[at:upto]
                a = np.repeat(place[at:upto], n)
                b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + a + 1
                most = np.maximum(size[a], size[b]) * percent // 100
                near = np.abs(size[a] - size[b]) <= most
                a, b, most = a[near], b[near], most[near]
                turned = np.zeros(len(a), np.int64)
                for word in bits:
                    turned += np.bitwise_count((word[a] ^ word[b]).view(np.uint64))
                near = turned <= 4 * most
                yield pa.RecordBatch.from_arrays([name.take(pa.array(a[near])), name.take(pa.array(b[near]))], ["x", "y"])
                at = upto

    return blocks.mapInArrow(compare, "x string, y string").select(F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"))


def _reach(size: int) -> int:
    """Length of the longest name that is similar to one of ``size`` characters."""
    return size * 100 // (100 - EDIT_PERCENT)


def _key_count(size: int) -> int:
    """About as many keys as a name of ``size`` characters gets."""
    if size <= SHORT_NAME:
        most = size * EDIT_PERCENT // 100
        return 1 + size * (most > 0) + size * (size - 1) // 2 * (most > 1)
    parts = size * EDIT_PERCENT // 100 + 1
    return 2 * parts + parts ** 3 // 2


def _costs(sizes: dict[int, int]) -> tuple[int, int]:
    """Of names of these lengths (with their numbers): of all pairs in tiles, and of keys; in pairs of a tile."""
    pairs = keys = 0
    for size, n in sizes.items():
        # A pair counts where its longer name does; of one length half of them.
        met = sum(c for other, c in sizes.items() if other < size <= _reach(other)) + (n + 1) // 2
        pairs += n * met * (1 if size < LONG_NAME else size * size // 25)
        keys += n * KEY_COSTS * _key_count(size)
    return pairs, keys


def _pairs_in_tiles(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Pairs of all names that may be similar, as ``_pairs_in_blocks`` has them: any two meet once.

    Names are dealt by their length into tiles of bounded size; those whose lengths are near enough meet.
    """
    spark = rows.sparkSession
    most = max(TILE, -(-sum(sizes.values()) // TILES))
    # A tile holds names of one length, or of some that follow each other.
    tiles: list[list[int]] = []  # least and greatest length
    dealt_to, held = [], most
    for size, n in sorted(sizes.items()):
        if held + n > most:
            held, parts = 0, -(-n // most)
            tiles += [[size, size] for _ in range(parts)]
        else:
            parts = 1
            tiles[-1][1] = size
        dealt_to.append((size, len(tiles) - parts, parts))
        held = most if parts > 1 else held + n
    meet = [(i, j) for i in range(len(tiles)) for j in range(i, len(tiles)) if tiles[j][0] <= _reach(tiles[i][1])]
    goes = sorted({(t, i, j) for i, j in meet for t in (i, j)})
    tile_of = spark.createDataFrame(dealt_to, "size int, first int, parts int")
    goes_to = spark.createDataFrame(goes, "tile int, i int, j int")
    tile = F.col("first") + F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")
    own = rows.join(F.broadcast(tile_of), F.col("mark.size") == F.col("size")).select("name", "mark", tile.alias("tile"))
    own = own.join(F.broadcast(goes_to), "tile")
    groups = dealt(own, "i", "j").groupBy("i", "j").agg(F.collect_list(F.struct("tile", "name", "mark")).alias("members"))
    percent, words = EDIT_PERCENT, SIGNATURE

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in range(batch.num_rows):
                here = batch.slice(number, 1)
                members = here.column(2).flatten()
                place, name, mark = (pc.struct_field(members, c) for c in ("tile", "name", "mark"))
                place, size = place.to_numpy(), pc.struct_field(mark, "size").to_numpy().astype(np.int64)
                bits = [pc.struct_field(mark, f"w{k}").to_numpy().view(np.uint64) for k in range(words)]
                i, j = here.column(0)[0].as_py(), here.column(1)[0].as_py()
                left, right = np.flatnonzero(place == i), np.flatnonzero(place == j)
                found: list[tuple[np.ndarray, np.ndarray]] = []
                # Squares that fit a core's cache.
                for at in range(0, len(left), 64):
                    a = left[at:at + 64]
                    for upto in range(at if i == j else 0, len(right), 2048):
                        b = right[upto:upto + 2048]
                        turned = np.bitwise_count(bits[0][a][:, None] ^ bits[0][b])
                        for word in bits[1:-1]:
                            turned += np.bitwise_count(word[a][:, None] ^ word[b])
                        turned = np.add(turned, np.bitwise_count(bits[-1][a][:, None] ^ bits[-1][b]), dtype=np.uint16)
                        longest = 4 * (max(size[a].max(), size[b].max()) * percent // 100)
                        x, y = np.nonzero(turned <= longest)
                        apart, x, y = turned[x, y], a[x], b[y]
                        most = np.maximum(size[x], size[y]) * percent // 100
                        near = (np.abs(size[x] - size[y]) <= most) & (apart <= 4 * most)
                        if i == j:
                            near &= x < y
                        if near.any():
                            found.append((x[near], y[near]))
                if found:
                    x, y = (np.concatenate(c) for c in zip(*found, strict=True))
                    for at in range(0, len(x), 1 << 16):
                        yield pa.RecordBatch.from_arrays(
                            [name.take(pa.array(x[at:at + (1 << 16)])), name.take(pa.array(y[at:at + (1 << 16)]))], ["x", "y"])

    met = groups.mapInArrow(compare, "x string, y string")
    return met.select(F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"))


def similar_names(names: DataFrame, name: str = "name", block: int = BLOCK, key_costs: int | None = None) -> DataFrame:
    """(name_a, name_b, score), a < b, of all distinct names that are similar; no pairs need to be given.

    Names that meet are told apart by their signatures first; the edit distance is taken once for each pair that passes.
    All names of near lengths meet where that costs less than their keys.  Otherwise short names meet by
    what deletions leave of them, long ones by segments.  The names of keys that more than ``block`` of them share
    are cut into parts, each of which meets each other one, or all meet, whichever costs less.  Names
    are taken as they are; NULL and empty ones are similar to nothing.
    """
    distinct = materialized(names.select(F.col(name).alias("name")).where("name <> ''").distinct(), "names")
    distinct = materialized(dealt(distinct, "name").withColumn("mark", _signature(F.col("name"))), "names")

    sizes = _lengths(distinct)
    in_tiles, by_keys = _costs(sizes)
    costs = KEY_COSTS if key_costs is None else key_costs
    met = _pairs_in_tiles(distinct, sizes) if in_tiles <= by_keys // KEY_COSTS * costs else _pairs_by_keys(distinct, block).distinct()
    # Stored, as the filter would otherwise be pushed below the distinct.
    pairs = materialized(met, "name-pairs")
    links = pairs.where(similar(F.col("name_a"), F.col("name_b")))
    return links.select("name_a", "name_b", F.round(pair_score(F.col("name_a"), F.col("name_b")), 4).alias("score"))


def _lengths(rows: DataFrame) -> dict[int, int]:
    """How many names have each length."""
    return dict(tuple(r) for r in rows.groupBy("mark.size").agg(F.count(F.lit(1))).collect())


def _pairs_by_keys(distinct: DataFrame, block: int) -> DataFrame:
    """Pairs of names that share a key and may be similar, some of them more than once."""

    def entries(keys: Column) -> DataFrame:
        return distinct.select("name", "mark", F.explode(keys).alias("key"))

    column = F.col("name")
    first = materialized(entries(_deletion_keys(column)).unionByName(entries(_segment_keys(column))), "name-entries")
    counts = first.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    counts = materialized(counts.select("key", "c", F.ceil(F.col("c") / block).cast("int").alias("parts")), "name-keys")
    shared = first.join(counts, "key")
    found = _pairs_in_blocks(shared.where("parts = 1"), ["key"])
    in_blocks = counts.where("parts > 1").agg(F.sum(F.col("c").cast("double") * F.col("c") / 2)).first()[0]
    if in_blocks is None:
        return found
    hot = shared.where("parts > 1")
    hot_names = materialized(hot.select("name", "mark").distinct(), "hot-names")
    sizes = _lengths(hot_names)
    if _costs(sizes)[0] <= BLOCK_COSTS * in_blocks:
        return found.unionByName(_pairs_in_tiles(hot_names, sizes))
    part = F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")
    crossed = hot.select("key", "name", "mark", part.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    crossed = crossed.select("key", "name", "mark", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return found.unionByName(_pairs_in_blocks(crossed, ["key", "i", "j"]))


def resolve_entities(entities: DataFrame, key: str = "entity_id", name: str = "name", handle: str = "handle") -> DataFrame:
    """The columns of ``entities`` with ``representative`` and ``n_links``, one row for each of them.

    Entities are the same if their normalised names are similar, their handles equal, or others say so in
    turn; the representative is the smallest key of all that are.  ``n_links`` counts the other
    distinct names that are similar to the row's.  Without a name and a handle an entity stands for itself.
    """
    plain = normal_name(F.col(name))
    bare = F.nullif(F.lower(F.regexp_replace(F.col(handle), "^@+", "")), F.lit(""))
    rows = entities.select(
        F.struct("*").alias("row"), F.col(key).alias("key"), F.nullif(plain, F.lit("")).alias("name"), bare.alias("handle"))
    links = materialized(similar_names(rows.select("name")), "similar-names")
    by_name, by_handle = F.concat(F.lit("n:"), "name"), F.concat(F.lit("h:"), "handle")
    edges = links.select(F.concat(F.lit("n:"), "name_a").alias("a"), F.concat(F.lit("n:"), "name_b").alias("b")).unionByName(
        rows.select(by_name.alias("a"), by_handle.alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    groups = materialized(components(edges), "entity-groups").withColumnRenamed("node", "_node")
    rows = rows.withColumn("node", F.coalesce(by_name, by_handle))
    least = rows.groupBy("node").agg(F.min("key").alias("least")).join(groups, F.col("node") == F.col("_node"), "left")
    least = least.select("node", "least", F.coalesce("component", "node").alias("component"))
    least = materialized(least, "entity-nodes")
    best = materialized(least.groupBy("component").agg(F.min("least").alias("representative")), "representatives")
    answers = materialized(least.join(best, "component").select(F.col("node").alias("_node"), "representative"), "entity-answers")
    ends = links.select(F.col("name_a").alias("linked")).unionByName(links.select(F.col("name_b").alias("linked")))
    counts = materialized(ends.groupBy("linked").agg(F.count(F.lit(1)).alias("n")), "name-links")
    out = rows.join(answers, F.col("node") == F.col("_node"), "left").join(counts, F.col("name") == F.col("linked"), "left")
    return out.select(
        "row.*", F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("representative")).alias("representative"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))
