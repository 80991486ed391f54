"""The registered vector queries over `embeddings` and the SQL that checks them.

Points are all rows; queries are the rows whose id is divisible by 50.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import center, column_mean, hadamard, l2_normalize, mean_vector, pad, sign_of, sql
from ..operators import index as ix
from ..operators.bounded import bounded_search
from ..operators.codes import CodeIndex, Codebook
from ..operators.exact import exact_search
from ..operators.shares import inner_products
from ..operators.ivf import ivf_pq_search, ivf_search
from ..operators.rotation import flip, long_projection, project, rotate, round_bits, sign_table
from ..operators.threshold import threshold_candidates
from ..operators.topk import probes, to_matrix
from ..operators.tuning import certain_search
from ..sources.tables import fresh_path, id_at, stored, with_row_ids
from ..streaming import StreamingIndex, WindowIndex
from ..streaming.reserve import ReserveWindow
from . import IndexConfig, QueryConfig

CFG = IndexConfig(dim=64, n_proj=64, n_repeats=2, top_m=50)
Q = QueryConfig(k=10, n_probed_vectors=10, n_cand=50)
#: Points in a bucket and scored exactly: ROOT times the root of the points, at least LEAST; the hash form reads half of a bucket. What a query reads grows with that root.
#: The dense form, which estimates all points, scores a 16th of that.
ROOT, LEAST, DENSE = 9, 50, 16
#: The whole searches (those in WHOLE): buckets and candidates of at least a 5th of the points, read of a bucket half of that, the dense form included.
SHARE = 5
PROBED = {"dense": 64, "bucket": 48, "hash": 16}
GIVEN = 61
WIDE = 15
PADDED = 100
SWEEP = [(5, 20), (10, 20), (10, 50), (20, 50)]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vec"))


def queries_of(p: DataFrame) -> DataFrame:
    return p.filter("point_id % 50 = 0").select(F.col("point_id").alias("query_id"), "vec")


def r6(c: str | Column) -> Column:
    # zero without a sign
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def _entries(df: DataFrame, vec: Column, id_col: str = "point_id") -> DataFrame:
    return df.select(id_col, F.posexplode(vec).alias("pos", "x")).withColumn("x", r6("x"))


def _exact(metric: str):
    return lambda s, d: _rounded(exact_search(p := points(s, d), queries_of(p), Q.k, metric), "score")


def bounded_exact(spark, d):
    p = points(spark, d)
    return _rounded(bounded_search(p, queries_of(p), Q.k), "score")


def bounded_exact_scaled(spark, d):
    """Points of lengths 1 to 7."""
    p = points(spark, d).withColumn("vec", F.transform("vec", lambda x: x.cast("double") * (F.col("point_id") % 7 + 1)))
    return _rounded(bounded_search(p, queries_of(p), Q.k), "score")


def inner_product_pairs(spark, d):
    p = points(spark, d)
    return _rounded(inner_products(p, queries_of(p)), "score")


def _built(kind: str):
    def build(spark, d):
        p = points(spark, d)
        return ix.MipsIndex.build(p, CFG, kind), queries_of(p)

    return build


def sized(p: DataFrame, centering: bool = False, whole: bool = False) -> tuple[IndexConfig, dict[str, QueryConfig]]:
    """Parameters of the searches for so many points."""
    n = p.count()
    m = max(LEAST, math.isqrt(ROOT * ROOT * n), n // SHARE if whole else 0)
    h = m // 2
    cfg = IndexConfig(CFG.dim, CFG.n_proj, CFG.n_repeats, m, centering=centering)
    return cfg, {kind: QueryConfig(Q.k, s, h if kind == "hash" else None, max(LEAST, m // DENSE) if kind == "dense" and not whole else m) for kind, s in PROBED.items()}


def _search(kind: str, centering: bool = False, whole: bool = False):
    def run(spark, d):
        p = points(spark, d)
        cfg, q = sized(p, centering, whole)
        return _rounded(ix.MipsIndex.build(p, cfg, kind).search(queries_of(p), q[kind]), "score")

    return run


def _probed(spark, d):
    return probes(project(queries_of(points(spark, d)), CFG, "query_id"), Q.n_probed_vectors)


def _buckets(spark, d):
    return ix.build_buckets(points(spark, d), CFG)


def _recall(kind: str):
    def run(spark, d):
        p = points(spark, d)
        cfg, q = sized(p)
        found = ix.MipsIndex.build(p, cfg, kind).search(queries_of(p), q[kind])
        return _rounded(ix.recall(found, exact_search(p, queries_of(p), Q.k), Q.k), "recall")

    return run


def _windows(spark, d):
    """The older nine tenths of the rows, the newest tenth, and how many leave."""
    p = points(spark, d).withColumnRenamed("point_id", "seq")
    n = p.count()
    cut = id_at(p, "seq", n - n // 10)
    return p.filter(F.col("seq") < cut), p.filter(F.col("seq") >= cut), n // 10


def _updated(mode: str, centering: bool = False, whole: bool = False):
    def run(spark, d):
        old, new, n_del = _windows(spark, d)
        return WindowIndex.build(old, sized(points(spark, d), centering, whole)[0]).update(new, n_del, mode)

    return run


def _stream_search(kind: str, centering: bool = False):
    def run(spark, d):
        p = points(spark, d)
        return _rounded(_updated("incremental", centering)(spark, d).search(queries_of(p), sized(p)[1]["hash" if kind == "hash" else "bucket"], kind), "score")

    return run


def stream_one_window(spark, d):
    """Both searches on one state of the window."""
    p = points(spark, d)
    state, q = _updated("incremental")(spark, d), sized(p)[1]
    found = [state.search(queries_of(p), q["hash" if kind == "hash" else "bucket"], kind).withColumn("kind", F.lit(kind)) for kind in ("estimate", "hash")]
    return _rounded(found[0].unionByName(found[1]), "score")


def stream_update_lossless(spark, d):
    """The newest tenth arrives in two steps; buckets are those of the whole window."""
    old, new, n_del = _windows(spark, d)
    cut = id_at(new, "seq", n_del // 2)
    window = ReserveWindow.build(old, sized(points(spark, d))[0])
    for part, leave in ((F.col("seq") < cut, n_del // 2), (F.col("seq") >= cut, n_del - n_del // 2)):
        window = window.update(new.filter(part), leave)
    return _rounded(window.buckets, "val")


def certain(spark, d):
    """Searched by buckets where a bound shows that this is exact, else exactly."""
    p = points(spark, d)
    cfg, q = sized(p)
    return _rounded(certain_search(ix.MipsIndex.build(p, cfg, "bucket"), queries_of(p), q["hash"]), "score")


def residual_codes_search(spark, d):
    """Lists of a 16th of the points, half of them probed; 16 bytes a point."""
    p = points(spark, d)
    index = CodeIndex.build(p, Codebook.learn(p, parts=16))
    return _rounded(index.search(queries_of(p), Q.k, 8, sized(p)[0].top_m), "score")


def table_function_search(spark, d):
    """The neighbours of the point of least id, by the table function in SQL."""
    sql.register(spark)
    points(spark, d).createOrReplaceTempView("spindrift_points")
    query = spark.table("spindrift_points").orderBy("point_id").first()["vec"]
    best = f"mips_search(points => table(select point_id, vec, point_id % 16 as part from spindrift_points) partition by part, query => array({', '.join(f'{float(x)!r}D' for x in query)}), k => {Q.k})"
    return _rounded(spark.sql(f"select point_id, score from {best} order by score desc, point_id limit {Q.k}"), "score")


def sign_flips(spark, d):
    """Points with the signs of the first round of the first rotation."""
    return _entries(points(spark, d), flip(pad(F.col("vec"), CFG.width), round_bits(CFG, 0, 0)))


def stream_delete(spark, d):
    """The buckets of all points after those whose id leaves 3 by 7 have left."""
    p = points(spark, d).withColumnRenamed("point_id", "seq")
    return _rounded(WindowIndex.build(p, CFG).delete(p.filter("seq % 7 = 3").select("seq")).buckets, "val")


def recall_stream(spark, d):
    p = points(spark, d)
    state, q = _updated("incremental")(spark, d), queries_of(p)
    truth = exact_search(state.points.withColumnRenamed("seq", "point_id"), q, Q.k)
    return _rounded(ix.recall(state.search(q, sized(p)[1]["bucket"]), truth, Q.k), "recall")


def _given(spark, d):
    """Centres that are points themselves, those whose id leaves 0 by GIVEN and is below 16 of them; and the runs of eight entries of the same."""
    rows = points(spark, d).filter(f"point_id % {GIVEN} = 0").orderBy("point_id").limit(16).collect()
    centres = [[float(x) for x in r["vec"]] for r in rows]
    return centres, [[c[j : j + 8] for c in centres] for j in range(0, CFG.dim, 8)]


def ivf_given(spark, d):
    p = points(spark, d)
    return _rounded(ivf_search(p, queries_of(p), Q.k, n_probes=4, centres=_given(spark, d)[0]), "score")


def ivf_pq_given(spark, d):
    p, (centres, books) = points(spark, d), _given(spark, d)
    return _rounded(ivf_pq_search(p, queries_of(p), Q.k, n_probes=8, n_cand=sized(p, whole=True)[0].top_m, centres=centres, codebooks=books), "score")


def candidate_sweep(spark, d):
    index, q = _built("bucket")(spark, d)
    index.table = stored(index.table)  # built once for all rows of the sweep
    truth, out = stored(exact_search(index.points, q, Q.k)), None
    for s, c in SWEEP:
        found = index.search(q, QueryConfig(Q.k, s, None, c))
        row = ix.recall(found, truth, Q.k).select(F.lit(s).alias("n_probed_vectors"), F.lit(c).alias("n_cand"), r6("recall").alias("recall"))
        out = row if out is None else out.unionByName(row)
    return out


def stream_microbatch_state(spark, d):
    """All rows arrive in two micro-batches, the older half first."""
    p, path = points(spark, d).withColumnRenamed("point_id", "seq"), fresh_path(spark, "arrivals")
    half, sink = id_at(p, "seq", p.count() // 2), StreamingIndex(CFG)
    for part in (F.col("seq") < half, F.col("seq") >= half):
        p.filter(part).write.mode("append").parquet(path)
        state = sink.run(spark.readStream.schema(p.schema).parquet(path))
    return _rounded(state.buckets, "val")


def stream_window_state(spark, d):
    """Micro-batches of a quarter, a half (more than the window holds) and a quarter of the rows into a window of three tenths of them."""
    p, path = points(spark, d).withColumnRenamed("point_id", "seq"), fresh_path(spark, "arrivals")
    n = p.count()
    cuts = [id_at(p, "seq", n * k // 4) for k in (1, 3)]
    sink = StreamingIndex(CFG, window=n * 3 // 10)
    for part in (F.col("seq") < cuts[0], F.col("seq").between(cuts[0], cuts[1] - 1), F.col("seq") >= cuts[1]):
        p.filter(part).write.mode("append").parquet(path)
        state = sink.run(spark.readStream.schema(p.schema).parquet(path))
    return _rounded(state.buckets, "val")


def _reread(kind: str):
    def run(spark, d):
        p, path = points(spark, d), fresh_path(spark, kind)
        if kind == "bin":
            sources.write_bin(p, path)
            got = sources.read_bin(spark, path, CFG.dim)
        elif kind == "txt":
            sources.write_txt(p, path)
            got = sources.read_txt(spark, path)
        else:
            spark.range(0).write.parquet(path)  # makes the folder where all can see it
            sources.write_npy(p, path + "/x.npy")
            got = sources.read_npy(spark, path + "/x.npy")
        return _entries(got, F.col("vec").cast("array<double>"))

    return run


def read_memory(spark, d):
    """The points as a NumPy array in the driver's memory and back; the ids are positions, so of the sorted rows."""
    rows = points(spark, d).orderBy("point_id").collect()
    got = sources.from_memory(spark, np.array([r["vec"] for r in rows], dtype="<f4"))
    return _entries(got, F.col("vec").cast("array<double>"))


def result_lines(spark, d):
    """The lines of the text sink, read again in order."""
    path = fresh_path(spark, "results")
    sources.write_results(exact_search(p := points(spark, d), queries_of(p), Q.k), path)
    lines = spark.read.text(path)
    place = lines.metadataColumn("_metadata")
    return with_row_ids(lines.select("value", place["file_path"].alias("_file"), place["file_block_start"].alias("_block")), "line", file_order=True)


def padded_matrix(spark, d):
    """Results as arrays filled with zeros beyond those found, one row per place."""
    m = to_matrix(exact_search(p := points(spark, d), queries_of(p), Q.k), WIDE, pad=True)
    places = m.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("place", "e"))
    return places.select("query_id", "place", F.col("e.ids").alias("point_id"), r6(F.col("e.scores")).alias("score"))


def stream_positions(spark, d):
    """Places of the points in the window: the age in it, oldest first."""
    state = _updated("incremental")(spark, d)
    low = state.points.agg(F.min("seq").alias("low"))  # one row
    return state.points.join(F.broadcast(low), F.col("seq") >= F.col("low")).select("seq", (F.col("seq") - F.col("low")).alias("position"))


def stream_tumbling(spark, d):
    """A full turnover: the newer half takes the place of the older."""
    p = points(spark, d).withColumnRenamed("point_id", "seq")
    n = p.count()
    cut = id_at(p, "seq", n // 2)
    return _rounded(WindowIndex.build(p.filter(F.col("seq") < cut), CFG).update(p.filter(F.col("seq") >= cut), n // 2).buckets, "val")


QUERIES = {
    "exact_mips_topk": _exact("dot"),
    "exact_cosine_topk": _exact("cosine"),
    "exact_l2_topk": _exact("l2"),
    "bounded_exact": bounded_exact,
    "bounded_exact_scaled": bounded_exact_scaled,
    "inner_product_pairs": inner_product_pairs,
    "l2_normalize": lambda s, d: _entries(points(s, d), l2_normalize(F.col("vec"))),
    "pad_vector": lambda s, d: _entries(points(s, d), pad(F.col("vec"), PADDED)),
    "column_mean": lambda s, d: _rounded(column_mean(points(s, d)), "mean"),
    "center_vectors": lambda s, d: _entries(center(p := points(s, d), mean_vector(p)), F.col("vec")),
    "sign_bits": lambda s, d: sign_table(s, CFG),
    "sign_flips": sign_flips,
    "hadamard_round": lambda s, d: _entries(points(s, d), hadamard(flip(pad(F.col("vec"), CFG.width), round_bits(CFG, 0, 0)), CFG.width)),
    "rotate3": lambda s, d: _entries(points(s, d), rotate(F.col("vec"), CFG)),
    "project_points": lambda s, d: _rounded(long_projection(project(points(s, d), CFG, backend="arrow"), "point_id"), "val"),
    "project_queries": lambda s, d: _rounded(long_projection(project(queries_of(points(s, d)), CFG, "query_id", backend="sql"), "query_id"), "val"),
    "query_probes": lambda s, d: _rounded(_probed(s, d), "mag"),
    "dense_estimate": lambda s, d: _rounded(ix.dense_estimates(project(points(s, d), CFG), _probed(s, d)), "est"),
    "dense_candidates": lambda s, d: _rounded((b := _built("dense")(s, d))[0].candidates(b[1], Q), "est"),
    "dense_search": _search("dense", whole=True),
    "bucket_close": lambda s, d: _rounded(_buckets(s, d).filter("sgn = 1"), "val"),
    "bucket_far": lambda s, d: _rounded(_buckets(s, d).filter("sgn = -1"), "val"),
    "bucket_prefix": lambda s, d: _rounded(_buckets(s, d).filter("rk <= 10"), "val"),
    "bucket_estimate": lambda s, d: _rounded(ix.bucket_estimates(_buckets(s, d), _probed(s, d), CFG.top_m), "est"),
    "bucket_estimate_mean": lambda s, d: _rounded(ix.bucket_estimates(_buckets(s, d), _probed(s, d), CFG.top_m, "mean"), "est"),
    "bucket_candidates": lambda s, d: _rounded((b := _built("bucket")(s, d))[0].candidates(b[1], Q), "est"),
    "bucket_search": _search("bucket"),
    "threshold_candidates": lambda s, d: _rounded(threshold_candidates(stored(_buckets(s, d)), _probed(s, d), CFG.top_m, Q.n_cand), "est"),
    "certain_search": certain,
    "table_function_search": table_function_search,
    "hash_candidates": lambda s, d: ix.hash_candidates(_buckets(s, d), _probed(s, d), CFG.top_m),
    "hash_candidate_count": lambda s, d: _rounded(ix.candidate_counts(ix.hash_candidates(_buckets(s, d), _probed(s, d), CFG.top_m)), "avg_candidates"),
    "hash_search": _search("hash"),
    "stream_update_incremental": lambda s, d: _rounded(_updated("incremental")(s, d).buckets, "val"),
    "stream_update_rebuild": lambda s, d: _rounded(_updated("rebuild", whole=True)(s, d).buckets, "val"),
    "stream_update_lossless": stream_update_lossless,
    "stream_estimate_search": _stream_search("estimate"),
    "stream_hash_search": _stream_search("hash"),
    "recall_dense": _recall("dense"),
    "recall_bucket": _recall("bucket"),
    "recall_hash": _recall("hash"),
    "recall_stream": recall_stream,
    "index_size_report": lambda s, d: ix.size_report(points(s, d), CFG),
    "candidate_sweep": candidate_sweep,
    "read_bin": _reread("bin"),
    "read_txt": _reread("txt"),
    "read_npy": _reread("npy"),
    "stream_microbatch_state": stream_microbatch_state,
    "read_memory": read_memory,
    "result_lines": result_lines,
    "padded_matrix": padded_matrix,
    "vector_signs": lambda s, d: points(s, d).select("point_id", F.posexplode(F.transform("vec", sign_of)).alias("pos", "sign")),
    "stream_positions": stream_positions,
    "stream_tumbling": stream_tumbling,
    "hash_search_centered": _search("hash", True, True),
    "stream_search_centered": _stream_search("estimate", True),
    "stream_one_window": stream_one_window,
    "stream_delete": stream_delete,
    "stream_window_state": stream_window_state,
    "ivf_given": ivf_given,
    "ivf_pq_given": ivf_pq_given,
    "ivf_pq_search": lambda s, d: _rounded(ivf_pq_search(p := points(s, d), queries_of(p), Q.k, n_cand=sized(p)[0].top_m), "score"),
    "residual_codes_search": residual_codes_search,
    "ivf_search": lambda s, d: _rounded(ivf_search(p := points(s, d), queries_of(p), Q.k), "score"),
}


# --- the same in SQL ---------------------------------------------------------------------------

def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


_POINTS = "p as (select vec_id as point_id, embedding::double[] as vec from embeddings), q as (select point_id as query_id, vec from p where point_id % 50 = 0)"
_LONG = "l as (select point_id, unnest(vec) as x, unnest(range(len(vec))) as pos from p)"
_N_BITS = CFG.width * 3 * CFG.n_repeats
_BITS = f"""g as (
    select 0 as i, {CFG.sign_seed}::bigint as x union all select i + 1, (16807 * x) % 2147483647 from g where i < {_N_BITS + 16}
), bits as (
    select n // {CFG.width * 3} as repeat, (n // {CFG.width}) % 3 as round, n % {CFG.width} as pos, b as bit
    from (select row_number() over (order by i) - 1 as n, (x - 1) // 1073741822 as b from g where i > 0 and x - 1 < 2147483644) where n < {_N_BITS}
)"""
_ROUNDS = "p0 as (select point_id, r.repeat, pos, x from l, (select distinct repeat from bits) r), " + ", ".join(
    f"p{k + 1} as (select point_id, v.repeat, i.i as pos, sum(x * (2 * bit - 1) * (1 - 2 * (bit_count((i.i & v.pos)::bigint) % 2))) as x"
    f" from p{k} v join bits b on b.repeat = v.repeat and b.pos = v.pos and b.round = {k}, (select unnest(range({CFG.width})) as i) i group by all)"
    for k in range(3)
)
_PROJ = f"pr as (select point_id, (repeat * {CFG.n_proj} + pos)::int as dir, x as val from p3 where pos < {CFG.n_proj})"


def _probe(s: int = Q.n_probed_vectors, name: str = "pb") -> str:
    return (
        f"{name} as (select point_id as query_id, dir, case when val < 0 then -1 else 1 end as sgn, abs(val) as mag, row_number() over (partition by point_id order by abs(val) desc, dir) as rk"
        f" from pr where point_id % 50 = 0 qualify rk <= {s})"
    )


_SIDES = "sides as (select dir, s.sgn, point_id, s.sgn * val as val from pr, (values (1), (-1)) s(sgn))"


def _bucket(name: str, source: str, top: str = str(CFG.top_m)) -> str:
    ranked = f"select dir, sgn, row_number() over (partition by dir, sgn order by val desc, point_id) as rk, point_id, val from {source}"
    return f"{name} as (select * from ({ranked}) where rk <= {top})"


_SIZES = f"z as (select m, m // 2 as h, greatest({LEAST}, m // {DENSE}) as c from (select greatest({LEAST}, floor(sqrt({ROOT * ROOT} * count(*)))::bigint) as m from p))"
_WHOLE = f"z as (select m, m // 2 as h, m as c from (select greatest({LEAST}, floor(sqrt({ROOT * ROOT} * count(*)))::bigint, count(*) // {SHARE}) as m from p))"
_M, _H, _C = "(select m from z)", "(select h from z)", "(select c from z)"


_BASE = f"with recursive {_POINTS}, {_LONG}, {_BITS}, {_ROUNDS}, {_PROJ}, {_probe()}, {_SIDES}, {_bucket('bk', 'sides')}"
_PROBES = ", ".join(_probe(s, f"pb_{kind}") for kind, s in PROBED.items())
#: The searches: their larger buckets, and the probes of each kind.
_SIZED = f"with recursive {_POINTS}, {_LONG}, {_BITS}, {_ROUNDS}, {_PROJ}, {_SIZES}, {_PROBES}, {_SIDES}, {_bucket('bk', 'sides', _M)}"
_AGES = "w as (select count(*) // 10 as tenth, count(*) as n from p), a as (select point_id, row_number() over (order by point_id) - 1 as age from p)"
_OLD, _NEW = "age < n - tenth", "age >= n - tenth"
_STREAM = (
    f"{_AGES}, "
    + _bucket("b0", f"(select sides.* from sides join a using (point_id), w where {_OLD})", _M)
    + ", "
    + _bucket("b1", f"(select dir, sgn, point_id, val from b0 join a using (point_id), w where age >= tenth union all select sides.* from sides join a using (point_id), w where {_NEW})", _M)
)
_LIVE = "(select p.* from p join a using (point_id), w where age >= tenth)"


def _centred(of: str) -> str:
    """As _SIZED with the mean of the points that `of` selects taken off; queries, not centred, go along under ids below 0."""
    mean = f"mean as (select pos, avg(x) as c from (select point_id, unnest(vec) as x, unnest(range(len(vec))) as pos from {of}) group by pos)"
    long = "l as (select point_id, x - c as x, pos from (select point_id, unnest(vec) as x, unnest(range(len(vec))) as pos from p) join mean using (pos) union all select -1 - query_id, unnest(vec), unnest(range(len(vec))) from q)"
    probes = ", ".join(_probe(s, f"pb_{kind}").replace("select point_id as query_id", "select -1 - point_id as query_id").replace("point_id % 50 = 0", "point_id < 0") for kind, s in PROBED.items())
    sides = _SIDES.replace("from pr,", "from (select * from pr where point_id >= 0) pr,")
    return f"with recursive {_POINTS}, {_AGES}, {mean}, {long}, {_BITS}, {_ROUNDS}, {_PROJ}, {_SIZES}, {probes}, {sides}, {_bucket('bk', 'sides', _M)}"


def _est(buckets: str = "bk", agg: str = "sum", probe: str = "pb") -> str:
    return f"select query_id, point_id, {agg}(val) as est from {probe} join {buckets} using (dir, sgn) group by query_id, point_id"


def _cand(est: str, n: int | str = Q.n_cand) -> str:
    return f"select * from (select *, row_number() over (partition by query_id order by est desc, point_id) as rank from ({est})) where rank <= {n}"


def _top(pairs: str) -> str:
    return (
        "select query_id, row_number() over (partition by query_id order by score desc, point_id) as rank, point_id, score from"
        f" (select c.query_id, c.point_id, list_inner_product(q.vec, p.vec) as score from ({pairs}) c join p using (point_id) join q using (query_id)) qualify rank <= {Q.k}"
    )


def _out(body: str, *rounded: str) -> str:
    return f"select * replace ({', '.join(f'{_r(c)} as {c}' for c in rounded)}) from ({body})"


_DENSE = "select query_id, point_id, sum(sgn * val) as est from pb join pr using (dir) group by query_id, point_id"
_HASH = "select distinct query_id, point_id from pb join bk using (dir, sgn)"
_ALL = "select query_id, point_id from q, p"


def _found(kind: str, buckets: str = "bk") -> str:
    """Candidates of a search by its own parameters."""
    if kind == "hash":
        return f"select distinct query_id, point_id from pb_hash join {buckets} using (dir, sgn) where {buckets}.rk <= {_H}"
    est = _est(buckets, probe="pb_bucket") if kind == "bucket" else _DENSE.replace("from pb ", "from pb_dense ")
    return _cand(est, _C if kind == "dense" else _M)


def _given_sql(body: str) -> str:
    c = f"c as (select row_number() over (order by point_id) - 1 as list, vec from p where point_id % {GIVEN} = 0 order by point_id limit 16)"
    near = "select {0}, arg_min(list, list_inner_product(c.vec{1}, c.vec{1}) - 2 * list_inner_product(p.vec{1}, c.vec{1})) as {2} from p, c group by all"
    lists = f"lists as ({near.format('point_id', '', 'list')})"
    probed = "probed as (select query_id, list from (select query_id, list, row_number() over (partition by query_id order by list_inner_product(q.vec, c.vec) desc, list) as r from q, c) where r <= {})"
    return f"with {_POINTS}, {c}, {lists}, {probed}, {body}"


_PQ_PARTS = ", ".join(str(j) for j in range(0, CFG.dim, 8))
_PQ = (
    f"parts as (select unnest([{_PQ_PARTS}]) as j), sub as (select list, j, vec[j + 1 : j + 8] as v from c, parts), "
    "codes as (select point_id, j, arg_min(list, (list_inner_product(v, v) - 2 * list_inner_product(vec[j + 1 : j + 8], v), list)) as code from p, sub group by point_id, j), "
    "products as (select query_id, j, list as code, list_inner_product(vec[j + 1 : j + 8], v) as x from q, sub), "
    "e as (select query_id, point_id, sum(x) as est from probed join lists using (list) join codes using (point_id) join products using (query_id, j, code) group by query_id, point_id) "
)


def _recall_sql(found: str, truth: str) -> str:
    share = _r(f"count(*) / ((select count(*) from q) * {Q.k}.0)")
    return f"select * from (with f as ({found}), t as ({truth}) select {share} as recall from f join t using (query_id, point_id))"


def _scored(metric: str, points: str = "") -> str:
    return f"with {points or _POINTS} " + _out(f"select query_id, row_number() over (partition by query_id order by score desc, point_id) as rank, point_id, score from (select query_id, point_id, {metric} as score from q, p) qualify rank <= {Q.k}", "score")


def _rows(x: str = _r("x")) -> str:
    return f"with {_POINTS}, {_LONG} select point_id, pos, {x} as x from l"


_SWEEP_PROBES = ", ".join(_probe(s, f"pb{s}") for s in sorted({s for s, _ in SWEEP}))
_READ = _rows()

ORACLE_SQL = {
    "exact_mips_topk": _scored("list_inner_product(q.vec, p.vec)"),
    "bounded_exact": _scored("list_inner_product(q.vec, p.vec)"),
    "bounded_exact_scaled": _scored("list_inner_product(q.vec, p.vec)", _POINTS.replace("embedding::double[]", "list_transform(embedding, lambda x: x::double * (vec_id % 7 + 1))")),
    "exact_cosine_topk": _scored("list_inner_product(q.vec, p.vec) / sqrt(list_inner_product(q.vec, q.vec)) / sqrt(list_inner_product(p.vec, p.vec))"),
    "exact_l2_topk": _scored("2 * list_inner_product(q.vec, p.vec) - list_inner_product(q.vec, q.vec) - list_inner_product(p.vec, p.vec)"),
    "inner_product_pairs": f"with {_POINTS} select query_id, point_id, {_r('list_inner_product(q.vec, p.vec)')} as score from q, p",
    "l2_normalize": _rows(_r("x / sqrt(sum(x * x) over (partition by point_id))")),
    "pad_vector": f"with {_POINTS}, {_LONG}, n as (select unnest(range({PADDED})) as pos) select point_id, pos, {_r('coalesce(x, 0)')} as x from (select point_id, pos from p, n) left join l using (point_id, pos)",
    "column_mean": f"with {_POINTS}, {_LONG} select pos, {_r('avg(x)')} as mean from l group by pos",
    "center_vectors": _rows(_r("x - avg(x) over (partition by pos)")),
    "sign_bits": f"with recursive {_BITS} select repeat, round, pos, bit from bits",
    "sign_flips": f"with recursive {_POINTS}, {_LONG}, {_BITS} select point_id, l.pos, {_r('x * (2 * bit - 1)')} as x from l join bits b on b.pos = l.pos and b.repeat = 0 and b.round = 0",
    "hadamard_round": f"{_BASE} select point_id, pos, {_r('x')} as x from p1 where repeat = 0",
    "rotate3": f"{_BASE} select point_id, pos, {_r('x')} as x from p3 where repeat = 0",
    "project_points": f"{_BASE} {_out('select * from pr', 'val')}",
    "project_queries": f"{_BASE} select point_id as query_id, dir, {_r('val')} as val from pr where point_id % 50 = 0",
    "query_probes": f"{_BASE} {_out('select * from pb', 'mag')}",
    "dense_estimate": f"{_BASE} {_out(_DENSE, 'est')}",
    "dense_candidates": f"{_BASE} {_out(_cand(_DENSE), 'est')}",
    "dense_search": f"{_SIZED} {_out(_top(_found('dense')), 'score')}",
    "bucket_close": f"{_BASE} {_out('select * from bk where sgn = 1', 'val')}",
    "bucket_far": f"{_BASE} {_out('select * from bk where sgn = -1', 'val')}",
    "bucket_prefix": f"{_BASE} {_out('select * from bk where rk <= 10', 'val')}",
    "bucket_estimate": f"{_BASE} {_out(_est(), 'est')}",
    "bucket_estimate_mean": f"{_BASE} {_out(_est(agg='avg'), 'est')}",
    "bucket_candidates": f"{_BASE} {_out(_cand(_est()), 'est')}",
    "threshold_candidates": f"{_BASE} {_out(_cand(_est()), 'est')}",
    "table_function_search": f"with {_POINTS}, one as (select vec as v from p order by point_id limit 1) select point_id, {_r('list_inner_product(v, vec)')} as score from p, one order by list_inner_product(v, vec) desc, point_id limit {Q.k}",
    "certain_search": _scored("list_inner_product(q.vec, p.vec)"),
    "bucket_search": f"{_SIZED} {_out(_top(_found('bucket')), 'score')}",
    "hash_candidates": f"{_BASE} {_HASH}",
    "hash_candidate_count": f"{_BASE} select {_r('avg(n)')} as avg_candidates, count(*) as n_queries from (select query_id, count(*) as n from ({_HASH}) group by query_id)",
    "hash_search": f"{_SIZED} {_out(_top(_found('hash')), 'score')}",
    "stream_update_incremental": f"{_SIZED}, {_STREAM} {_out('select * from b1', 'val')}",
    "stream_update_rebuild": f"{_SIZED}, {_STREAM}, " + _bucket("b2", "(select sides.* from sides join a using (point_id), w where age >= tenth)", _M) + f" {_out('select * from b2', 'val')}",
    "stream_update_lossless": f"{_SIZED}, {_AGES}, " + _bucket("b2", "(select sides.* from sides join a using (point_id), w where age >= tenth)", _M) + f" {_out('select * from b2', 'val')}",
    "stream_estimate_search": f"{_SIZED}, {_STREAM} {_out(_top(_found('bucket', 'b1')), 'score')}",
    "stream_hash_search": f"{_SIZED}, {_STREAM} {_out(_top(_found('hash', 'b1')), 'score')}",
    "recall_dense": f"{_SIZED} {_recall_sql(_top(_found('dense')), _top(_ALL))}",
    "recall_bucket": f"{_SIZED} {_recall_sql(_top(_found('bucket')), _top(_ALL))}",
    "recall_hash": f"{_SIZED} {_recall_sql(_top(_found('hash')), _top(_ALL))}",
    "recall_stream": f"{_SIZED}, {_STREAM} {_recall_sql(_top(_found('bucket', 'b1')), _top(f'select query_id, point_id from q, {_LIVE}'))}",
    "index_size_report": f"select count(*) as n_points, count(*) * {CFG.dim * 4} as vector_bytes, count(*) * {(CFG.dim + CFG.directions) * 4} as dense_bytes, count(*) * {CFG.dim * 4} + {16 * CFG.top_m * CFG.directions} as bucket_bytes, count(*) * {CFG.dim * 4} + {8 * CFG.top_m * CFG.directions} as hash_bytes from embeddings",
    "candidate_sweep": f"{_BASE}, {_SWEEP_PROBES} " + " union all ".join(f"select {s} as n_probed_vectors, {c} as n_cand, recall from ({_recall_sql(_top(_cand(_est(probe=f'pb{s}'), c)), _top(_ALL))})" for s, c in SWEEP),
    "read_bin": _READ,
    "read_txt": _READ,
    "read_npy": _READ,
    "stream_microbatch_state": f"{_BASE} {_out('select * from bk', 'val')}",
    "read_memory": _READ,
    "result_lines": f"with {_POINTS} select row_number() over (order by query_id) - 1 as line, string_agg(point_id, ' ' order by rank) || ' ' as value from ({_top(_ALL)}) group by query_id",
    "padded_matrix": f"with {_POINTS}, t as ({_top(_ALL)}), s as (select query_id, unnest(range({WIDE})) as place from q) select s.query_id, place, coalesce(point_id, 0) as point_id, {_r('coalesce(score, 0)')} as score from s left join t on t.query_id = s.query_id and rank = place + 1",
    "vector_signs": f"with {_POINTS}, {_LONG} select point_id, pos, case when x < 0 then -1 else 1 end as sign from l",
    "stream_positions": f"with {_POINTS}, {_AGES} select point_id as seq, age - tenth as position from a, w where age >= tenth",
    "stream_tumbling": f"{_BASE}, {_AGES}, " + _bucket("b6", "(select sides.* from sides join a using (point_id), w where age >= n // 2)") + f" {_out('select * from b6', 'val')}",
    "hash_search_centered": f"{_centred('p')} {_out(_top(_found('hash')), 'score')}",
    "stream_search_centered": f"{_centred('(select p.* from p join a using (point_id), w where age < n - tenth)')}, {_STREAM.removeprefix(_AGES + ', ')} {_out(_top(_found('bucket', 'b1')), 'score')}",
    "stream_one_window": f"{_SIZED}, {_STREAM} {_out(' union all '.join(f"select *, '{name}' as kind from ({_top(_found(kind, 'b1'))})" for name, kind in (('estimate', 'bucket'), ('hash', 'hash'))), 'score')}",
    "stream_delete": f"{_BASE}, " + _bucket("b3", "(select dir, sgn, point_id, val from bk where point_id % 7 <> 3)") + f" {_out('select * from b3', 'val')}",
    "stream_window_state": f"{_BASE}, {_AGES}, "
    # all of the first batch leave, so the second batch's newest are a window built anew; of these half and more stay
    + _bucket("b4", "(select sides.* from sides join a using (point_id), w where age < n * 3 // 4 and age >= n * 3 // 4 - n * 3 // 10)")
    + ", "
    + _bucket("b5", "(select dir, sgn, point_id, val from b4 join a using (point_id), w where age >= n - n * 3 // 10 union all select sides.* from sides join a using (point_id), w where age >= n * 3 // 4)")
    + f" {_out('select * from b5', 'val')}",
    "ivf_given": _given_sql("f as (select query_id, point_id from probed join lists using (list))").format(4) + f" {_out(_top('select * from f'), 'score')}",
    "ivf_pq_given": _given_sql(_SIZES + ", " + _PQ).format(8) + f" {_out(_top(_cand('select * from e', _M)), 'score')}",
}
WHOLE = ("dense_search", "stream_update_rebuild", "hash_search_centered", "ivf_pq_given")
ORACLE_SQL |= {name: ORACLE_SQL[name].replace(_SIZES, _WHOLE) for name in WHOLE}
