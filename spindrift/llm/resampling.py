"""Importance resampling towards a target: documents are drawn by how much more likely their words are in the target than in the corpus.

Features are the runs of 1 to `runs` consecutive words of a text, repeats counted, each in one of BUCKETS buckets by its CRC-32. Higher-order functions make a document's array of buckets, once, to a table in the shared folder; the corpus and the
target are counted by bucket, so only totals are shuffled, BUCKETS rows a task at most. From the totals the driver works out BUCKETS gains, 1000 times the smoothed log ratio of a bucket's shares in target and corpus,
and a document's weight is the sum of its buckets' gains, looked up in one literal array. With Gumbel noise from a hash of the id on top, the greatest scores are a draw without replacement in proportion to exp(weight / 1000).

The draw takes PERCENT of the documents of LEAST_WORDS words or more. Their scores are put in order by sampled ranges, and a place in the order is the place in its range and the rows of the ranges before; no task sees all rows.

Defined cases: null text counts as empty; texts without words have no features and weight 0, and are not drawn; very long texts are taken whole; ties go to the smaller doc_id, rows without id have the noise of an empty id and come
after all others of their score; rows repeated under one id and with one score are drawn side by side, in any order; a null or empty target leaves smoothed gains; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_name, rows_of, steady, stored, whole_text

BUCKETS = 10_000
RUNS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: What words are apart by: ASCII signs that are neither digits nor letters; capitals are no letters here, as A-Z are lower-cased first.
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, SEPARATOR), lambda w: w != "")


def features_of(words: Column, runs: int = RUNS) -> Column:
    """The runs of 1 to `runs` words, joined by one space."""

    def of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.size(words) - (n - 1))
        return F.when(F.size(words) >= n, F.transform(at, lambda k: F.array_join(F.slice(words, k, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))

    return words if runs == 1 else F.concat(words, *[of(n) for n in range(2, runs + 1)])


def buckets_of(features: Column, buckets: int = BUCKETS) -> Column:
    return F.transform(features, lambda f: F.pmod(F.crc32(f.cast("binary")), F.lit(buckets)).cast("int"))


def _bucketed(docs: DataFrame, text_col: str, runs: int, buckets: int, *others: Column) -> DataFrame:
    words = docs.select(*others, words_of(whole_text(text_col)).alias("words"))
    return words.select(*[c for c in words.columns if c != "words"], F.size("words").alias("n_words"), buckets_of(features_of(F.col("words"), runs), buckets).alias("buckets"))


def _totals(bucketed: DataFrame, buckets: int) -> list[int]:
    """How many features are in each bucket."""
    out = [0] * buckets
    for b, n in bucketed.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():  # a row per bucket
        out[b] = n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets, in doubles."""
    s_all, t_all = float(sum(corpus) + len(corpus)), float(sum(target) + len(corpus))
    return [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus, target)]


def _noise(doc_id: Column, seed: int) -> Column:
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u))).cast("long")


def scores(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", row: Column | None = None) -> DataFrame:
    """doc_id, n_words, n_features, weight, score (and the name of the row), as a table in the shared folder."""
    names = [] if row is None else [row.alias("row")]
    made = stored(_bucketed(docs, text_col, runs, buckets, F.col(id_col).cast("long").alias("doc_id"), *names))
    table = gains(_totals(made, buckets), _totals(_bucketed(target, target_text_col, runs, buckets), buckets))
    # one text that is split and cast while the plan is made, so that the plan holds a single literal array
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(literal, b + 1))
    weighed = made.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"), *(["row"] if names else []))
    return stored(weighed.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with `rank`: 1, 2, 3... of those drawn, null of the others. scored is a table."""
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranged = scored.filter(able).repartitionByRange(*order).sortWithinPartitions(*order)
    # numbers inside a task, written with the rows, so that they are the same for all that follows
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = stored(ranged.withColumns({"part": F.spark_partition_id(), "at": at}))
    parts = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row per range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    rank = F.col("before") + F.col("at") + 1
    chosen = placed.join(F.broadcast(parts.select("part", before)), "part").withColumn("rank", F.when(rank <= drawn, rank))
    others = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return chosen.select(*others.columns).unionByName(others)


def resampling_weights(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank."""
    return ranked(scores(docs, target, **options), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """The rows of docs that are drawn, with all their columns."""
    docs = steady(docs)
    drawn = ranked(scores(docs, target, row=row_name(docs), **options), percent, least_words).filter("rank is not null")
    return rows_of(docs, drawn.select("row"))


def _words_sql(table: str, name: str) -> str:
    low = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"{name} as (select *, list_filter(string_split_regex({low}, '{SEPARATOR}'), lambda w: w <> '') as ws from {table})"


#: For documents with ids. CRC-32 is worked out a word at a time, from a table of the 256 remainders that the rule gives.
ORACLE_SQL = f"""
    with recursive steps as (
        select unnest(range(256))::bigint as i, unnest(range(256))::bigint as c, 0 as n
        union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n + 1 from steps where n < 8
    ), remainders as (select list(c order by i) as r from steps where n = 8
    ), {_words_sql('documents', 'd')}, {_words_sql('benchmark', 'e')}
    , uses as (
        select w, sum(s)::bigint as s, sum(t)::bigint as t from (
            select w, count(*) as s, 0 as t from (select unnest(ws) as w from d) group by w union all select w, 0, count(*) from (select unnest(ws) as w from e) group by w
        ) group by w
    ), coded as (
        select w, s, t, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(w) + 1), lambda k: ('0x' || substr(hex(encode(w)), 2 * k - 1, 2))::bigint)), lambda c, b: xor(c >> 8, r[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} as b
        from uses, remainders
    ), totals as (select b, sum(s) as s, sum(t) as t from coded group by b
    ), sums as (select sum(s) as s_all, sum(t) as t_all from totals
    ), gain as (
        select b, floor(1000 * ln((t + 1)::double * (s_all + {BUCKETS})::double / ((s + 1)::double * (t_all + {BUCKETS})::double)))::bigint as g from totals, sums
    ), weights as (
        select doc_id, sum(g)::bigint as weight from (select doc_id, unnest(ws) as w from d) join coded using (w) join gain using (b) group by doc_id
    ), scored as (
        select doc_id, len(ws) as n_features, coalesce(weight, 0) as weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || doc_id), 8))::bigint + 0.5) / 4294967296)))::bigint as score
        from d left join weights using (doc_id)
    ), ranks as (
        select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_features >= {LEAST_WORDS}
    )
    select doc_id, n_features, weight, score, case when rank <= {PERCENT} * n // 100 then rank end as rank from scored left join ranks using (doc_id)
"""
