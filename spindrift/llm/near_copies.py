"""Near copies by the word shingles that two texts have in common: the rule of the pipeline's near-duplicate stage.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of at least SIMILARITY. Such texts differ in up to
a dozen bits of a 64-bit SimHash, and masks that cover so many would be thousands, so candidates come from two kinds of buckets: the
covering masks of the SimHash of the same shingles, and BANDS bands of ROWS minimum hashes, of which a pair at 0.8 shares one with
probability 1 - (1 - 0.8^5)^20 = 0.9996. In a bucket each text is paired with the texts of the least and the greatest digest, under one of HUBS orders by table; only
pairs whose sets, compared as a whole, are similar enough are linked, so a bucket costs in proportion to its members. What these links leave apart is then
searched exactly: two such texts share a shingle among the first of both, n - 0.8 n + 1 of n, in an order of all shingles. All texts of different groups that share one are paired, so no link
between groups is missed; links inside a group that is already one are not listed. The order puts rare shingles first, by counts in a sample of texts and then, as a sample of one size shows less the more texts there are, by counts in the prefixes that it leads to;
it decides how many are paired, not what is found.

Where many share one shingle, as edited copies of one text that are below 0.8 among themselves do, they are not paired by it. All of them are compared with one of them, the hub, and go on by what they do not have
in common with it: sets x and y of p and q shingles that differ from the hub's differ in p + q - 2 c, where c are in both differences. Two that are similar enough and not both linked to the hub have at least
(p + q - (x + y) / 9) / 2 > 0 of these in common (x, y: sizes), so again one among the first of both; an edit of one text alone is in no other. Shingles that too many share there take another hub, LEVELS times at most.

Sets are made and compared of the pairs alone that bounds leave: the sizes, the places of a shared shingle in both orders, and bit sketches, which hold a bit or two for each shingle: each bit is the parity of the shingles that fall on it,
so two sets differ in as many shingles as their sketches do in bits, at least. No bound leaves out a pair that is similar enough.

Defined cases: null text counts as empty; texts without words are alike; a text under five words has one shingle of all its words;
equal texts are one node, a 64-bit digest; very long texts are read whole; ties of id go to the first row; rows without id take part and stay only if nothing in the component has an id;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_since, mark, row_name, rows_of, small_batches, steady, stored, whole_text
from .components import components
from .simhash import BITS, covering_masks

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
HUBS = 4
PART = 1 << 12
#: Texts whose shingles are counted for the order, and the frequent ones that come last in it: those counted at least OFTEN times.
SAMPLED, FREQUENT, OFTEN = 20_000, 1 << 16, 3
#: Prefixes that have a shingle in common which the sample did not show, from which on it goes behind rarer ones; how many shingles do so in a round, at most; and rounds, at most. They decide how many are paired, not what is found.
MET, LATER, ROUNDS = 8, 1 << 20, 3
#: Texts that are looked up by one shingle without a hub, and how often differences from a hub are dealt to further hubs. They decide how many are paired, not what is found.
CROWD, LEVELS = 16, 3
#: Places of the bitmap that tells which texts are in a pair; where it fills up, more sets are made than are needed.
PLACES = 1 << 23
#: Longs of a sketch, at least; a power of two.
SKETCH = 2
_MASKS = np.array(covering_masks(), dtype=np.uint64)
_RNG = np.random.default_rng(11)
_XOR = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = [0, 0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F]


def shingle_hashes(text: str, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle, one of all words if the text is shorter; none without words."""
    parts = text.encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if not parts:
        grams = []
    elif len(parts) < words:
        grams = [b" ".join(parts)]
    else:
        grams = map(b" ".join, zip(*(parts[k:] for k in range(words))))
    return np.fromiter((digest(g, seed) for g in grams), dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that most of the hashes have; zero of none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), PART):
        part = hashes[k : k + PART].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = WORDS, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; zero without words."""
    return majority(shingle_hashes(text, words, seed))


def bucket_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each table: the masked SimHash, then the bands of minimum hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), PART):
        low = np.minimum(low, ((hashes[k : k + PART] ^ _XOR) * _ODD).min(axis=1))
    bands = np.zeros(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        bands = (bands ^ row) * np.uint64(0x9E3779B97F4A7C15)
        bands ^= bands >> np.uint64(29)
    return np.concatenate([np.uint64(majority(hashes)) & _MASKS, bands])


def _counted(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of shingles, 0 if not among the frequent, which are sorted."""
    if not len(frequent):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return np.where(frequent[at] == hashes, counts[at], 0)


def prefix(hashes: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a set of shingles, in order of their counts (0 if not among the frequent, which are sorted), then hashes: sets of that similarity have one of them in common."""
    if not len(hashes):
        return hashes
    count = _counted(hashes, frequent, counts)
    return hashes[np.lexsort((hashes, count))][: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


def difference(x: np.ndarray, hub: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> tuple[bool, int, int, np.ndarray]:
    """Whether two sets are similar enough, in how many shingles they differ, and the first of these: those that x has come first, then those that only the hub has.

    Two similar sets that are not both linked to the hub have in common one of all the first of the set that differs from it in more shingles and of `reach` first of the other, the third of the result:
    by the sizes that the other set may have, by differing in no more shingles itself, and, of a linked set, by the other one not being linked.
    """
    new, gone = np.setdiff1d(x, hub, assume_unique=True), np.setdiff1d(hub, x, assume_unique=True)
    differ, common = len(new) + len(gone), len(x) - len(new)
    linked = common >= similarity * (len(x) + len(hub) - common)
    wide = (1 / similarity - 1) * len(x)
    half = (differ - (1 - similarity) / (1 + similarity) * (len(hub) - len(x))) / 2 if linked else wide
    first = np.concatenate([new[np.lexsort((new, _counted(new, frequent, counts)))], gone])
    return bool(linked), differ, math.floor(min(half, wide / 2) + 1e-6) + 1, first[: math.floor(min(half, wide) + 1e-6) + 1]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity of a set's shingles on each bit, of as many bits as shingles or up to twice as many; the first half of a sketch xor the second is the sketch of half as many bits."""
    longs = SKETCH
    while 64 * longs < len(hashes):
        longs *= 2
    odd = np.bincount((hashes & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _usual(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> float:
    return float(np.count_nonzero(_counted(hashes, frequent, counts))) / max(1, len(hashes))


def _keys(words: int, similarity: float, frequent: np.ndarray, counts: np.ndarray):
    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in b.column(1).to_pylist()]
            keys = [bucket_keys(s).view(np.int64) for s in sets]
            firsts = [prefix(s, similarity, frequent, counts).view(np.int64) for s in sets]
            longs = pa.list_(pa.int64())
            sketches = pa.array([sketch(s) for s in sets], longs)
            usual = pa.array([_usual(s, frequent, counts) for s in sets], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, longs), pa.array([len(s) for s in sets], pa.int32()), pa.array(firsts, longs), sketches, usual], names=["node", "keys", "size", "prefix", "sketch", "usual"])

    return run


def _frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of texts has often, sorted, and in how many of all texts they are by that; FREQUENT at most."""

    def run(batches):
        for b in batches:
            for t in b.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, words)).view(np.int64))], names=["shingle"])

    share = max(1, texts.count() // SAMPLED)
    some = texts.filter(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).mapInArrow(run, "shingle long")
    got = some.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    hashes = got.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], got.column("n").to_numpy()[order] * share


def _prefixes(words: int, similarity: float, wanted: np.ndarray, frequent: np.ndarray, counts: np.ndarray):
    """Of each text whose place is marked, what _keys has of the order."""

    def run(batches):
        for b in batches:
            at = _wanted(b.column(0).to_numpy(), wanted)
            sets = [np.unique(shingle_hashes(t, words)) for t in b.column(1).take(at).to_pylist()]
            firsts = pa.array([prefix(s, similarity, frequent, counts).view(np.int64) for s in sets], pa.list_(pa.int64()))
            usual = pa.array([_usual(s, frequent, counts) for s in sets], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([len(s) for s in sets], pa.int32()), usual, firsts], names=["node", "size", "usual", "prefix"])

    return run


def _by_prefixes(texts: DataFrame, keyed: DataFrame, words: int, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(node, size, usual, prefix) by an order in which the shingles that MET prefixes or more have in common, and that are not among the frequent, come by their number there; and that order.

    These shingles go back in the order and no other moves, so a prefix without them stays as it is; those with them are made again.
    """
    spark = texts.sparkSession
    light = some = keyed.select("node", "size", "usual", "prefix")
    for _ in range(ROUNDS):
        got = some.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= MET).orderBy(F.desc("n"), "s").limit(LATER).toArrow()
        hashes, n = got.column("s").to_numpy().view(np.uint64), got.column("n").to_numpy()
        new = ~np.isin(hashes, frequent)
        if not new.any():
            break
        late = spark.createDataFrame(pa.table({"s": hashes[new].view(np.int64)}))
        moved = light.select("node", F.explode("prefix").alias("s")).join(F.broadcast(late), "s", "left_semi")
        hashes, n = np.concatenate([frequent, hashes[new]]), np.concatenate([counts, n[new]])
        order = np.argsort(hashes)
        frequent, counts = hashes[order], n[order]
        wanted = _marked(moved.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct())
        # of a passage that many texts share the next shingles may have come into their prefixes
        some = stored(texts.mapInArrow(_prefixes(words, similarity, wanted, frequent, counts), "node long, size int, usual double, prefix array<long>"))
        light = light.join(some.select("node"), "node", "left_anti").unionByName(some)
    return light, frequent, counts


def _place(node):
    return F.pmod(node, F.lit(PLACES))


def _wanted(nodes: np.ndarray, wanted: np.ndarray) -> pa.Array:
    """Where the nodes are whose place is marked."""
    place = nodes % PLACES
    return pa.array(np.nonzero(wanted[place >> 3] >> (place & 7).astype(np.uint8) & 1)[0], pa.int64())


def _sets(words: int, wanted: np.ndarray):
    """The set of shingles of each text whose place is marked."""

    def run(batches):
        for b in batches:
            at = _wanted(b.column(0).to_numpy(), wanted)
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in b.column(1).take(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def _marked(pairs: DataFrame) -> np.ndarray:
    """A bit for each place of a text in `pairs`: PLACES / 8 bytes whatever their number."""
    places = pairs.select(F.explode(F.array("a", "b")).alias("node")).select(_place(F.col("node")).alias("p"))
    # 64 places in a number: the rows that come to the driver are bounded by PLACES / 64
    words = places.select(F.expr("p div 64").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit")).groupBy("w").agg(F.expr("bit_or(bit)").alias("bits"))
    out = np.zeros(PLACES // 64, dtype=np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def _sets_of(texts: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the texts that are in `pairs`, and of a few more. A table."""
    return stored(texts.mapInArrow(_sets(words, _marked(pairs)), "node long, shingles array<long>").dropDuplicates(["node"]))


def _keyed(texts: DataFrame, words: int, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(node, keys, size, prefix, sketch, usual) of texts (node, text); usual is the share of a text's shingles that are frequent."""
    return stored(texts.mapInArrow(_keys(words, similarity, frequent, counts), "node long, keys array<long>, size int, prefix array<long>, sketch array<long>, usual double"))


def candidates(keyed: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes: each member of a bucket with the bucket's hub."""
    rows = keyed.select("node", F.posexplode("keys").alias("t", "key"))
    salt = F.element_at(F.array(*[F.lit(s) for s in _SALTS[:HUBS]]), F.col("t") % HUBS + 1)
    least = rows.groupBy("t", "key").agg(F.min(F.col("node").bitwiseXOR(salt)).alias("low"), F.max(F.col("node").bitwiseXOR(salt)).alias("high"))
    ends = F.explode(F.array(F.col("low").bitwiseXOR(salt), F.col("high").bitwiseXOR(salt))).alias("hub")
    hubs = least.filter("low != high").select("t", "key", ends)
    met = rows.join(hubs, ["t", "key"]).filter("node != hub")
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _may(common: Column, sizes: Column, similarity: float) -> Column:
    """Whether sets of so many shingles together are similar enough if they have `common` of them in common."""
    return common >= F.lit(similarity) * (sizes - common) - F.lit(1e-6)


def _differing(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ, the longer one, if any, in its form of half as many bits."""

    def halved(z: Column, other: Column) -> Column:
        half = F.size(other)
        return F.when(F.size(z) > half, F.zip_with(F.slice(z, 1, half), F.slice(z, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(z)

    bits = F.zip_with(halved(x, y), halved(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda total, n: total + n)


def _differences(similarity: float, frequent: np.ndarray, counts: np.ndarray):
    def run(batches):
        for b in batches:
            sets = zip(*(b.column(k).to_pylist() for k in (5, 6)))
            got = [difference(*(np.array(s, dtype=np.int64).view(np.uint64) for s in both), similarity, frequent, counts) for both in sets]
            linked, differ, reach = (pa.array([g[k] for g in got], t) for k, t in enumerate((pa.bool_(), pa.int32(), pa.int32())))
            firsts = pa.array([g[3].view(np.int64) for g in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), linked, differ, reach, firsts], names=["node", "hub", "size", "usual", "root", "linked", "n", "reach", "prefix"])

    return run


def _shared(rows: DataFrame, similarity: float) -> DataFrame:
    """The rows (s, node, root, ...) whose s is in different groups, with a hub, of the most usual shingles, where more texts are looked up by it than CROWD and than two times the shingles that a text goes on by. A table."""
    looked_up = F.sum((F.col("at") < F.col("reach")).cast("int"))
    crowd = F.greatest(F.lit(float(CROWD)), F.lit(2 * (1 / similarity - 1)) * F.avg("size"))
    hub = F.max(F.struct("usual", "node"))["node"]
    of = rows.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.when(looked_up > crowd, hub).alias("hub")).filter("low != high")
    return stored(rows.join(of.select("s", "hub"), "s"))


def _paired(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different groups that share an s, whose sizes and places of it fit."""
    one = rows.select("s", *[F.col(c).alias(f"{c}1") for c in ("node", "root", "size", "n", "at", "linked")])
    other = rows.filter("at < reach").select("s", *[F.col(c).alias(f"{c}2") for c in ("node", "root", "size", "n", "at", "linked")])
    # the first shingle in common has all the others behind it in both
    common = (F.col("n1") + F.col("n2") - F.lit((1 - similarity) / (1 + similarity)) * (F.col("size1") + F.col("size2"))) / 2
    fit = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) >= common - F.lit(1e-6)
    apart = (F.col("root1") != F.col("root2")) & ~(F.col("linked1") & F.col("linked2"))
    larger = (F.col("n1") > F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("node1") > F.col("node2")))
    both = one.join(other, "s").filter(apart & larger & fit)
    return both.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"))


def across(texts: DataFrame, prefixes: DataFrame, groups: DataFrame, words: int, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of nodes of different groups (node, root) that may be similar enough, and edges (u, v) to hubs that are. Members of one group are not paired, however many share a shingle."""
    rows = prefixes.select("node", "size", "usual", F.posexplode("prefix").alias("at", "s"))
    # most shingles are of one text: what is left after one shuffle is small
    one = Window.partitionBy("s")
    rows = rows.withColumns({"low": F.min("node").over(one), "high": F.max("node").over(one)}).filter("low != high").drop("low", "high").distinct()
    rows = stored(rows.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")))
    # of two sets the smaller one is looked up by fewer
    reach = F.floor(F.lit((1 - similarity) / (1 + similarity)) * F.col("size") + F.lit(1e-6)).cast("int") + 1
    rows = rows.withColumns({"n": F.col("size"), "reach": reach, "linked": F.lit(False)})
    pairs, links, sets = [], [], None
    for level in range(LEVELS + 1):
        rows = _shared(rows, similarity)
        crowd = rows.filter("hub is not null")
        if level == LEVELS or crowd.isEmpty():
            pairs.append(_paired(rows, similarity))
            break
        pairs.append(_paired(rows.filter("hub is null"), similarity))
        met = stored(crowd.filter("node != hub").select("node", "hub", "size", "usual", "root").distinct())
        if sets is None:
            sets = _sets_of(texts, met.select(F.col("node").alias("a"), F.col("hub").alias("b")), words)
        both = met.join(sets.withColumnRenamed("shingles", "x"), "node").join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("y")), "hub")
        both = both.select("node", "hub", "size", "usual", "root", "x", "y")
        schema = "node long, hub long, size int, usual double, root long, linked boolean, n int, reach int, prefix array<long>"
        found = stored(both.mapInArrow(_differences(similarity, frequent, counts), schema))
        links.append(found.filter("linked").select(F.col("node").alias("u"), F.col("hub").alias("v")))
        rows = found.select(*[c for c in found.columns if c != "prefix"], F.posexplode("prefix").alias("at", "s")).withColumn("s", F.xxhash64("hub", "s")).drop("hub")
    every = pairs[0]
    for more in pairs[1:]:
        every = every.unionByName(more)
    edges = groups.sparkSession.createDataFrame([], "u long, v long") if not links else links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    return every.distinct(), edges


def similar_pairs(texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (u, v) between texts whose sets of shingles are similar enough; any two such texts are joined by a path of them. A table; those that led to it are removed."""
    since = mark()
    order = _frequent(texts, words)
    keyed = _keyed(texts, words, similarity, *order)
    first = mark()
    found = stored(_alike(texts, keyed, candidates(keyed), words, similarity))
    drop_since(texts.sparkSession, first, keep=1)
    prefixes, *order = _by_prefixes(texts, keyed, words, similarity, *order)
    pairs, near = across(texts, prefixes, components(found), words, similarity, *order)
    links = stored(found.unionByName(near).unionByName(_alike(texts, keyed, pairs, words, similarity)))
    drop_since(texts.sparkSession, since, keep=1)
    return links


def possible(keyed: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not exclude."""
    light = keyed.select("node", "size", "sketch").dropDuplicates(["node"])
    left = light.select(F.col("node").alias("a"), F.col("size").alias("nx"), F.col("sketch").alias("p"))
    right = light.select(F.col("node").alias("b"), F.col("size").alias("ny"), F.col("sketch").alias("q"))
    sizes = F.col("nx") + F.col("ny")
    # sizes first: sketches of similar sizes have as many bits, or one has twice as many
    sized = pairs.join(left, "a").join(right, "b").filter(_may(F.least("nx", "ny"), sizes, similarity))
    near = F.when(_ratio(F.size("p"), F.size("q")) <= 2, _may((sizes - _differing(F.col("p"), F.col("q"))) / 2, sizes, similarity)).otherwise(True)
    return sized.filter(near).select("a", "b")


def _ratio(m: Column, n: Column) -> Column:
    return F.greatest(m, n) / F.least(m, n)


def _alike(texts: DataFrame, keyed: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (u, v) of the pairs (a, b) whose sets are similar enough."""
    pairs = stored(possible(keyed, pairs, similarity))
    sets = _sets_of(texts, pairs, words)
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    alike = common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)
    return both.filter(alike).select(F.col("b").alias("u"), F.col("a").alias("v"))


def keep_representatives(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the smallest doc_id of each component, with all its columns; of rows repeated under it the first."""
    small_batches(docs.sparkSession)
    docs = steady(docs)
    node = F.xxhash64(whole_text(text_col))
    texts = docs.select(node.alias("node"), whole_text(text_col).alias("text"))
    found = components(similar_pairs(texts, words, similarity))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("first")
    light = docs.select(node.alias("node"), F.col(id_col).cast("long").alias("doc_id"), row_name(docs).alias("row"))
    classes = light.groupBy("node").agg(first)
    classes = classes.join(found.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    heads = classes.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return rows_of(docs, heads.select("first.row"))
