"""Hard negatives by one-dimensional distance keys.

Vectors of whole numbers get one more entry, sqrt(M - |x|^2) with M the greatest |x|^2, and anchors a zero; then the greater the inner product, the smaller the distance: |q - x|^2 = |q|^2 + M - 2 qx. PIVOTS pivots are
the means of a bounded sample (SAMPLE rows of least hash of id, ROUNDS of k-means); every row is stored under its nearest pivot and its distance to it, sorted by (pivot, distance, id) and cut into key intervals of one pivot, of SEGMENT rows
or, on large tables, more, so that there are about SEGMENTS intervals at most, whose pivots and ends go to all tasks. A row at distance t of its pivot is at least |d - t| and at most d + t from an anchor at distance d of the pivot; so an interval has a bound
of the scores in it from above and below.

Anchors, sorted and packed in the same way, search in rounds. A round reads the next intervals of each pack in order of their bounds, FIRST at first and GROWTH times as many each time, if they may hold a row that is still wanted, and inside them only the keys between
d - r and d + r; each task passes on only rows that are no worse than the k-th found in earlier rounds. The search ends when no interval's bound reaches the k-th score of any anchor of a pack, so nothing is missed. Where distances do not tell rows
apart, as in many random dimensions, all intervals are read, pack by pack.

Positives, the best rows of the anchor's label, are searched first; each then sets a band of scores for its negatives, which a second search of the same kind finds, a place for each positive.

Defined cases: rows without id, label or vector, or with an entry that is null or not finite, take no part; shorter vectors count as filled with zeros; rows that repeat id, label and vector count once; rows of one id that differ are rows of
their own, but none is a positive of the other; ties go to the smaller id; an anchor without positives, or a positive without negatives, has no rows; an empty table gives an empty result; long vectors are taken whole; vectors of a squared length of 2^53 or more raise
an error, as their products are no longer exact; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PIVOTS, SAMPLE, ROUNDS = 32, 4096, 8
#: Rows of an interval at least; intervals of large tables at most, but for those that the ends of tasks and pivots cut.
SEGMENT, SEGMENTS = 1024, 16_384
#: Anchors in a pack.
PACK = 128
#: Intervals that a pack reads in its first round, and how many times as many by the end of each round after.
FIRST, GROWTH = 32, 8
POSITIVES, NEGATIVES = 5, 3
#: Distances are off by less than this share of the greatest one; bounds are wider by it.
NEAR = 1e-7
#: A negative's score, as percent of its positive's.
BAND = (50, 95)
_PACKED = "name long, pivot int, low double, high double, n int, ids binary, labels binary, keys binary, vectors binary"
_FOUND = "pack long, place int, slot int, id long, score long"


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 256.0) -> DataFrame:
    """(id, label, vec): rows that take part, their entries as floor(scale * x)."""
    v = F.col(vec_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.filter(sound).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * scale)).alias("vec"))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of augmented rows to augmented pivots."""
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def augmented(x: np.ndarray, greatest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(greatest - (x * x).sum(axis=1), 0))[:, None]])


def learn_pivots(sample: np.ndarray, count: int = PIVOTS, rounds: int = ROUNDS) -> np.ndarray:
    """k-means over a sample; a centre that loses its rows stays."""
    centres = sample[:: max(1, len(sample) // count)][:count].copy()
    for _ in range(rounds):
        near = _distances(sample, centres).argmin(axis=1)
        for k in np.unique(near):
            centres[k] = sample[near == k].mean(axis=0)
    return centres


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column, filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class _Space:
    """What all tasks know: the width, M and the pivots."""

    def __init__(self, rows: DataFrame):
        square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        got = rows.agg(F.max(F.size("vec")).alias("width"), F.max(square).alias("greatest"), F.count("*").alias("n")).first()
        self.n, self.width, self.greatest = got["n"], got["width"] or 0, got["greatest"] or 0.0
        if self.greatest >= 1 << 53:
            raise ValueError("vectors are too long for exact products")
        sample = [r["vec"] for r in rows.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
        x = np.zeros((max(1, len(sample)), self.width))
        for k, v in enumerate(sample):
            x[k, : len(v)] = v
        self.pivots = learn_pivots(augmented(x, self.greatest))


def _keyed(space: _Space):
    def run(batches):
        for b in batches:
            if b.num_rows:
                far = _distances(augmented(_matrix(b.column(2), space.width), space.greatest), space.pivots)
                near = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(far[np.arange(len(far)), near])], names=["id", "label", "vec", "pivot", "key"])

    return run


def _packer(width: int, size: int):
    """Runs of at most `size` sorted rows of one pivot as one row."""

    def run(batches):
        from pyspark import TaskContext

        name, held = TaskContext.get().partitionId() << 32, []
        schema = pa.schema([("name", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "labels", "keys", "vectors")]])

        def pack(part):
            nonlocal name
            name += 1
            ids, labels, pivot, keys, x = part
            row = (name, int(pivot[0]), keys[0], keys[-1], len(ids), *(c.tobytes() for c in (ids.astype("<i8"), labels.astype("<i8"), keys.astype("<f8"), x.astype("<i4"))))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        def cut(last):
            """Full runs of what is held, and at the end or at another pivot the rest."""
            nonlocal held
            whole = [np.concatenate(c) for c in zip(*held)]
            held, at, n = [], 0, len(whole[0])
            ends = [*(np.flatnonzero(np.diff(whole[2])) + 1).tolist(), n]
            for end in ends:
                while end - at >= size or (at < end and (end < n or last)):
                    to = min(end, at + size)
                    yield pack([c[at:to] for c in whole])
                    at = to
            if at < n:
                held = [[c[at:] for c in whole]]

        for b in batches:
            if b.num_rows:
                held.append([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4)])
                held[-1].append(_matrix(b.column(2), width))
                if sum(len(h[0]) for h in held) >= size:
                    yield from cut(False)
        if held:
            yield from cut(True)

    return run


def packed(keyed: DataFrame, width: int, size: int) -> DataFrame:
    """Rows sorted by (pivot, key, id) in packs of one pivot, as a table."""
    order = ["pivot", "key", "id"]
    return stored(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packer(width, size), _PACKED))


class _Pack:
    """The numbers of a packed row."""

    def __init__(self, row: dict, prefix: str = ""):
        self.ids, self.labels = (np.frombuffer(row[prefix + c], dtype="<i8") for c in ("ids", "labels"))
        self.keys = np.frombuffer(row[prefix + "keys"], dtype="<f8")
        self.x = np.frombuffer(row[prefix + "vectors"], dtype="<i4").reshape(len(self.ids), -1).astype(float)


class _Wanted:
    """Of each anchor of a pack and each slot, the scores that are still wanted: low to cap, none where cap is below low."""

    def __init__(self, n: int, slots: int, bands: list[dict] | None, limits: list[dict] | None):
        free = bands is None
        self.low = np.full((n, slots), -np.inf if free else np.inf)
        self.cap = np.full((n, slots), np.inf if free else -np.inf)
        for b in bands or []:
            self.low[b["place"], b["slot"]], self.cap[b["place"], b["slot"]] = b["low"], b["cap"]
        for b in limits or []:
            self.low[b["place"], b["slot"]] = max(self.low[b["place"], b["slot"]], b["low"])


def _planner(space: _Space, directory, slots: int, banded: bool, start: int, stop: int):
    """For each pack of anchors: the intervals of this round, and how many are left after it that may be wanted."""
    names, pivots, lows, highs = directory

    def run(batches):
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row in b.to_pylist():
                pack = _Pack(row)
                q = np.hstack([pack.x, np.zeros((len(pack.x), 1))])
                square = (pack.x * pack.x).sum(axis=1)[:, None] + space.greatest
                slack = NEAR * square + 1e-6
                d = _distances(q, space.pivots)[:, pivots]
                gap = np.maximum(0, np.maximum(d - highs, lows - d))
                most, least = (square - gap * gap) / 2 + slack, (square - (d + highs) ** 2) / 2 - slack
                wanted = _Wanted(len(q), slots, (row["bands"] or []) if banded else None, row["limits"])
                may = np.zeros(len(names), dtype=bool)
                for s in range(slots):
                    may |= ((most >= wanted.low[:, s, None]) & (least <= wanted.cap[:, s, None])).any(axis=0)
                order = np.argsort(-most.max(axis=0), kind="stable")
                left = order[start:]
                out[0].append(row["name"])
                out[1].append(names[[k for k in order[start:stop] if may[k]]])
                out[2].append(int(may[left].sum()) - len(out[1][-1]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.int32())], names=["name", "intervals", "left"])

    return run


def _searcher(space: _Space, slots: int, banded: bool, k: int):
    """Rows of an interval that are among the k best of an anchor and slot there, and wanted."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                pack, points = _Pack(row, "a_"), _Pack(row)
                wanted = _Wanted(len(pack.ids), slots, (row["bands"] or []) if banded else None, row["limits"])
                lowest = wanted.low.min(axis=1)
                # keys between d - r and d + r of any anchor
                q, square = np.hstack([pack.x, np.zeros((len(pack.x), 1))]), (pack.x * pack.x).sum(axis=1) + space.greatest
                d = _distances(q, space.pivots[row["pivot"]][None, :])[:, 0]
                r = np.sqrt(np.maximum(square - 2 * np.maximum(lowest, -square), 0)) + NEAR * np.sqrt(square) + 1e-6
                some = np.isfinite(wanted.cap.max(axis=1)) | (not banded)
                if not some.any():
                    continue
                at, to = np.searchsorted(points.keys, (d - r)[some].min(), "left"), np.searchsorted(points.keys, (d + r)[some].max(), "right")
                ids, labels = points.ids[at:to], points.labels[at:to]
                scores = pack.x @ points.x[at:to].T
                alike = pack.labels[:, None] == labels[None, :]
                fit = (scores >= lowest[:, None]) & (scores <= wanted.cap.max(axis=1)[:, None]) & (~alike if banded else alike & (pack.ids[:, None] != ids[None, :]))
                place, col = np.nonzero(fit)
                score, point = scores[place, col], ids[col]
                order = np.lexsort((point, -score, place))
                place, score, point = place[order], score[order], point[order]
                for s in range(slots):
                    here = np.flatnonzero((score >= wanted.low[place, s]) & (score <= wanted.cap[place, s]))
                    first = np.searchsorted(place[here], place[here], "left")
                    here = here[np.arange(len(here)) - first < k]
                    cols = ([row["pack"]] * len(here), pa.int64()), (place[here], pa.int32()), ([s] * len(here), pa.int32()), (point[here], pa.int64()), (score[here].astype(np.int64), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["pack", "place", "slot", "id", "score"])

    return run


def _search(space: _Space, intervals: DataFrame, packs: DataFrame, k: int, bands: DataFrame | None = None, slots: int = 1, report: list | None = None) -> DataFrame:
    """(pack, place, slot, id, score, rank): the k best of each anchor and slot. bands: pack, bands (array<struct<place,slot,low,cap>>), of other labels; without, those of the anchor's label. report: gets, for each round, the intervals read and left, over all packs."""
    spark = intervals.sparkSession
    rows = sorted(intervals.select("name", "pivot", "low", "high").collect())  # SEGMENTS, and one for each task and pivot, at most
    directory = tuple(np.array([r[c] for r in rows]) for c in ("name", "pivot", "low", "high"))
    sent = tuple(a.astype(int) if c < 2 else a for c, a in enumerate(directory))
    payload = packs.select("name", "ids", "labels", "keys", "vectors")
    none = F.lit(None).cast("array<struct<place:int,slot:int,low:bigint,cap:bigint>>").alias("bands")
    payload = payload.select("*", none) if bands is None else payload.join(bands, payload["name"] == bands["pack"]).select("name", "ids", "labels", "keys", "vectors", "bands")
    place = Window.partitionBy("pack", "place", "slot").orderBy(F.desc("score"), "id")
    found, start, stop = None, 0, FIRST
    while True:
        if found is None:
            asked = payload.withColumn("limits", F.lit(None).cast("array<struct<place:int,slot:int,low:bigint>>"))
        else:
            limits = found.filter(F.col("rank") == k).groupBy("pack").agg(F.collect_list(F.struct("place", "slot", F.col("score").alias("low"))).alias("limits"))  # PACK times slots at most
            asked = payload.join(limits, payload["name"] == limits["pack"], "left").drop("pack")
        turn = stored(asked.mapInArrow(_planner(space, sent, slots, bands is not None, start, stop), "name long, intervals array<long>, left int"))
        got = turn.agg(F.sum(F.size("intervals")).alias("now"), F.sum("left").alias("left")).first()
        if report is not None:
            report.append((got["now"] or 0, got["left"] or 0))
        if got["now"]:
            pairs = turn.select(F.col("name").alias("pack"), F.explode("intervals").alias("interval"))
            names = ("ids", "labels", "keys", "vectors")
            units = pairs.join(asked.select(F.col("name").alias("pack"), *[F.col(c).alias("a_" + c) for c in names], "bands", "limits"), "pack").join(intervals.select(F.col("name").alias("interval"), "pivot", *names), "interval")
            new = units.mapInArrow(_searcher(space, slots, bands is not None, k), _FOUND)
            new = new if found is None else new.unionByName(found.drop("rank"))
            found = stored(new.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k))
        if not got["left"]:
            return spark.createDataFrame([], _FOUND + ", rank int") if found is None else found
        start, stop = stop, stop * GROWTH


def hard_negatives(points: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND, segment: int = SEGMENT, pack: int = PACK, report: list | None = None) -> DataFrame:
    """anchor_id, positive_id, rank (of the negative, from 1), negative_id, positive_score, negative_score. points: id, label, vec (array<bigint>); anchors: the condition on id under which a row is one."""
    low, high = band
    rows = stored(points.groupBy("id", "label", "vec").agg(F.lit(1).alias("one")).drop("one"))
    space = _Space(rows)
    keyed = rows.mapInArrow(_keyed(space), "id long, label long, vec array<long>, pivot int, key double")
    intervals = packed(keyed, space.width, max(segment, -(-space.n // SEGMENTS)))
    packs = packed(keyed.filter(anchors), space.width, pack)
    near = _search(space, intervals, packs, positives, report=report).select("pack", "place", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # ceiling and floor in whole numbers
    limit = F.struct("place", (F.col("slot") - 1).cast("int").alias("slot"), F.expr(f"{low} * positive_score div 100 + cast({low} * positive_score % 100 > 0 as bigint)").alias("low"), F.expr(f"{high} * positive_score div 100 - cast({high} * positive_score % 100 < 0 as bigint)").alias("cap"))
    bands = near.groupBy("pack").agg(F.collect_list(limit).alias("bands"))  # PACK times positives at most
    far = _search(space, intervals, packs, negatives, bands, positives, report).select("pack", "place", (F.col("slot") + 1).alias("slot"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = packs.select(F.col("name").alias("pack"), "ids").mapInArrow(_unpacked, "pack long, place int, anchor_id long")
    return near.join(far, ["pack", "place", "slot"]).join(ids, ["pack", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _unpacked(batches):
    for b in batches:
        for pack, raw in zip(*(c.to_pylist() for c in b.columns)):
            ids = np.frombuffer(raw, dtype="<i8")
            yield pa.RecordBatch.from_arrays([pa.array([pack] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids)], names=["pack", "place", "anchor_id"])


def mined(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """The query: labels of ids divisible by 7 are moved on by one of ten, anchors are the ids divisible by `every`."""
    rows = usable(embeddings)
    moved = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("id") % every == 0)


#: For tables of distinct ids.
ORACLE_SQL = f"""
    with p as (
        select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
        from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), s as (
        select a.id as anchor_id, b.id, a.label = b.label as alike, list_inner_product(a.v, b.v)::bigint as score from p a, p b where a.id % 50 = 0 and a.id <> b.id
    ), pos as (
        select anchor_id, id as positive_id, score as positive_score from s where alike qualify row_number() over (partition by anchor_id order by score desc, id) <= {POSITIVES}
    )
    select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id) as rank, id as negative_id, positive_score, score as negative_score
    from pos join s using (anchor_id) where not alike and {BAND[0]} * positive_score <= 100 * score and 100 * score <= {BAND[1]} * positive_score
    qualify rank <= {NEGATIVES}
"""
