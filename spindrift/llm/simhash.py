"""SimHash near duplicates with covering locality-sensitive hashing.

Every bit position gets a random non-zero vector of radius + 1 bits; the mask of table v keeps the positions
whose vector has an odd product with v. For any positions where two fingerprints differ, at most `radius` of them,
some v is orthogonal to all their vectors, so the pair agrees under that mask: no pair within the radius is missed.

Inside a bucket two members agree on the masked bits and are linked if they differ in at most two others. They
are found without comparing pairs: every member is listed under itself and under its one-bit neighbours outside
the mask; two members are within two bits exactly if they share such a point, and a point has as
many members as free bits + 1 at most. Each point's members are linked to the smallest. Large buckets therefore cost
as much a member as small ones.

Defined cases: null text counts as empty; texts without words have fingerprint zero and are linked like any other;
very long texts are read whole; rows without id take part, with a null component_id only if nothing in the component has an id; repeated rows share
their component; ties need no order, as the smallest doc_id names a component; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_name, rows_of, small_batches, steady, stored, whole_text
from .components import components

RADIUS = 2
BITS = 64
CHUNK = 1 << 15


def covering_masks(radius: int = RADIUS, bits: int = BITS, seed: int = 7) -> list[int]:
    rng, size = random.Random(seed), 1 << (radius + 1)
    vectors = [v for _ in range(-(-bits // (size - 1))) for v in rng.sample(range(1, size), size - 1)][:bits]
    return [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") & 1) for v in range(1, size)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; zero without words."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        grams = [b" ".join(parts)]
    else:
        grams = map(b" ".join, zip(*(parts[k:] for k in range(words))))
    hashes = np.fromiter((digest(g, seed) for g in grams), dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = hashes[k : k + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        prints = [signed(fingerprint(t)) for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints, pa.int64())], names=[*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect just the distinct fingerprints in `fp` which are within two bits."""
    if radius != 2:
        raise ValueError("the one-bit points inside buckets are exact for radius 2")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for v, m in enumerate(masks)])
    keyed = prints.select("fp", F.inline(tables))
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").select("t", "key")
    members = keyed.join(shared, ["t", "key"], "left_semi")
    points = None
    for v, m in enumerate(masks):
        free = [1 << i for i in range(BITS) if not m >> i & 1]
        at = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(b))) for b in free])
        points = F.when(F.col("t") == v, at) if points is None else points.when(F.col("t") == v, at)
    spread = members.select("t", "fp", F.explode(points).alias("z"))
    hubs = spread.groupBy("t", "z").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    return hubs.select(F.col("fps")[0].alias("v"), F.explode(F.slice("fps", 2, BITS)).alias("u")).select("u", "v").distinct()


def _classes(prints: DataFrame) -> DataFrame:
    """(fp, first, root, component_id) for each distinct fingerprint."""
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(classes.select("fp")))
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id (smallest doc_id reachable)."""
    prints = stored(fingerprints(docs, id_col, text_col))
    named = _classes(prints).select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the smallest doc_id of each component, with all its columns; of rows repeated under it the first. Texts are fingerprinted once."""
    docs = steady(docs)
    small_batches(docs.sparkSession)
    rows = docs.select(row_name(docs).alias("row"), F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    prints = stored(rows.mapInArrow(_fingerprints, "row struct<file:bigint,row:bigint>, doc_id long, fp long"))
    rooted = prints.join(_classes(prints).select("fp", "root"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    return rows_of(docs, rooted.groupBy("root").agg(first.alias("first")).select("first.row"))
