"""Inverted lists around centres, with whole vectors or product codes: comparators of the projection indexes."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import doubles, inner_product, norm2
from ..sources.tables import stored
from . import shares

Centres = list[list[float]]


def learn_centres(points: DataFrame, k: int, seed: int = 42, part: tuple[int, int] | None = None) -> Centres:
    """k-means centres of the vectors, or of the entries [start, start + length) of them."""
    v = doubles(F.col("vec")) if part is None else F.slice(doubles(F.col("vec")), part[0] + 1, part[1])
    model = KMeans(k=k, seed=seed, maxIter=10, featuresCol="f").fit(points.select(array_to_vector(v).alias("f")))
    return [[float(x) for x in c] for c in model.clusterCenters()]


def _nearest(v: Column, centres: Centres) -> Column:
    """Number of the centre at the least Euclidean distance; of equal ones the first."""
    far = F.transform(_table(centres), lambda c, i: F.struct((norm2(c) - 2 * inner_product(v, c)).alias("d"), i.alias("i")))
    return F.array_min(far)["i"]


def _probed(queries: DataFrame, centres: Centres, n_probes: int) -> DataFrame:
    """(query_id, vec, lists): the numbers of the lists whose centres have the largest inner products with the query; picked inside each row."""
    near = F.transform(_table(centres), lambda c, i: F.struct((-inner_product(F.col("vec"), c)).alias("s"), i.alias("i")))
    return queries.select("query_id", "vec", F.transform(F.slice(F.array_sort(near), 1, n_probes), lambda e: e["i"]).alias("lists"))


def _asked(lists: int):
    """Which lists each query probes, and, where it has them, its products with the codes of each part."""

    def own(rows) -> tuple:
        probed = np.zeros((len(rows), lists), dtype=bool)
        for i, r in enumerate(rows):
            probed[i, r["lists"]] = True
        return (probed, np.array([r["products"] for r in rows], dtype=float)) if "products" in rows[0] else (probed,)

    return own


def _table(centres: Centres) -> Column:
    """An array of arrays; of the index's own, fixed size."""
    return F.array(*[F.lit(c) for c in centres])


def ivf_search(points: DataFrame, queries: DataFrame, k: int = 10, n_lists: int = 16, n_probes: int = 4, seed: int = 42, centres: Centres | None = None) -> DataFrame:
    """(query_id, rank, point_id, score): the lists whose centres have the largest inner product with the query are scored exactly. Centres are learned by k-means unless given."""
    centres = centres or learn_centres(points, n_lists, seed)
    listed = points.select("point_id", "vec", _nearest(F.col("vec"), centres).alias("list"))
    return shares.search(listed, ["list"], _probed(queries, centres, n_probes), _asked(len(centres)), shares.by_lists, len(centres), k)


def learn_codebooks(points: DataFrame, parts: int, codes: int, seed: int = 42) -> list[Centres]:
    """For each of `parts` equal runs of entries, its centres."""
    dim = points.select(F.size("vec").alias("n")).first()["n"]
    if dim % parts:
        raise ValueError("the number of parts must divide the length of the vectors")
    return [learn_centres(points, codes, seed, (j * (dim // parts), dim // parts)) for j in range(parts)]


def ivf_pq_search(
    points: DataFrame, queries: DataFrame, k: int = 10, n_lists: int = 16, n_probes: int = 4, parts: int = 8, codes: int = 16, n_cand: int = 100, seed: int = 42,
    centres: Centres | None = None, codebooks: list[Centres] | None = None,
) -> DataFrame:
    """(query_id, rank, point_id, score): points of the probed lists are estimated by the sum, over the runs of entries, of the query's products with the point's codes; the n_cand best are scored exactly."""
    centres = centres or learn_centres(points, n_lists, seed)
    codebooks = codebooks or learn_codebooks(points, parts, codes, seed)
    width, longest = len(codebooks[0][0]), max(map(len, codebooks))
    # k-means may find fewer centres in one run of entries than in another; a centre that is there twice is never the nearest
    codebooks = [[*book, *[book[-1]] * (longest - len(book))] for book in codebooks]
    run = lambda j: F.slice(doubles(F.col("vec")), j * width + 1, width)
    coded = points.select("point_id", "vec", _nearest(F.col("vec"), centres).alias("list"), F.array(*[_nearest(run(j), book) for j, book in enumerate(codebooks)]).alias("codes"))
    # a query's products with every centre of every run: parts x codes numbers
    products = F.array(*[_products(run(j), book) for j, book in enumerate(codebooks)])
    coded = stored(coded)  # read three times: for a sample, to count and to score
    asked = _probed(queries, centres, n_probes).withColumn("products", products)
    return shares.search(coded, ["list", "codes"], asked, _asked(len(centres)), shares.by_lists, len(centres) + len(codebooks) * longest, k, n_cand)


def _products(v: Column, centres: Centres) -> Column:
    return F.transform(_table(centres), lambda c: inner_product(v, c))
