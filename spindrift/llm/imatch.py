"""I-Match fingerprints: terms of a middle band of document frequency, hashed over randomised lexicon subsets.

A term is a run of letters or digits in lower case, its key the first 15 hex digits of its MD5; the lexicon tells terms by a 64-bit hash. The lexicon holds the terms that stand in at
least LEAST_SHARE and at most MOST_SHARE of all documents, counted term by term over the whole table; as each takes LEAST_SHARE of the documents, it has at most
(distinct terms of a mean document) / LEAST_SHARE terms whatever the size of the table, which bounds the table sent to all tasks. Kept are the distinct terms
of a text that are in the lexicon, sorted; where these are fewer than LEAST, all its distinct terms.

Signatures are hashes of the sorted kept terms within subsets of the lexicon, chosen at random by the digits of the keys: the whole lexicon, so that every kept
term counts; BIG subsets that each leave out a quarter of it; and, as a change to many terms alters all of these, up to SMALL subsets that each hold a share of 2^-s of it, where a text of n kept
terms uses s = floor(log2(n)) and s + 1. Two texts may be
taken for copies where any large signature is equal; their likeness is the share of equal signatures, of the whole lexicon and of the subsets at the finest share that both have, among those not empty in both.

Defined cases: null text counts as empty; texts without terms have the fingerprint "-", are alike to each other (1) and to nothing else (0); very long texts
are whole, and their signatures no larger; the document after the last is the first, of one document itself; rows without id come first in the order; rows of one id follow one
another in order of their text's hash, then of their text; rows equal in both are alike, so their order says nothing; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, whole_text

#: The band of document frequency, as shares of all documents: an inverse document frequency of ln 20 to ln 200.
LEAST_SHARE, MOST_SHARE = 0.005, 0.05
LEAST = 3
KEY = 15
BIG, SMALL = 4, 64
#: Terms in a bucket of the table that tells the lexicon, on average.
LOAD = 4
SEPARATOR = "[^\\p{L}\\p{N}]+"
_SPLITS = 200
_NO_STRINGS = "cast(array() as array<string>)"


def terms(text: Column) -> Column:
    """The distinct terms."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SEPARATOR), lambda w: w != ""))


def keys_of(some: Column) -> Column:
    """Sorted keys of distinct terms."""
    return F.sort_array(F.transform(some, lambda w: F.substring(F.md5(w), 1, KEY)))


def _number(key: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(key, start, digits), 16, 10).cast("long")


def band(n: int) -> tuple[int, int]:
    """The least and the greatest number of documents, of n, that a term of the lexicon has."""
    return max(1, math.ceil(LEAST_SHARE * n)), max(1, math.ceil(MOST_SHARE * n))


def lexicon(docs: DataFrame, text_col: str = "text") -> list[int]:
    """Hashes (XXH64) of the terms in the band; their number is bounded by the distinct terms of a mean document over LEAST_SHARE."""
    low, high = band(docs.count())
    hashes = docs.select(F.explode(F.transform(terms(whole_text(text_col)), lambda w: F.xxhash64(w))).alias("h"))
    rows = hashes.groupBy("h").agg(F.count("*").alias("df")).filter(F.col("df").between(low, high)).select("h").collect()
    return [r["h"] for r in rows]


class Lexicon:
    """A hash table as one run of bytes: buckets of equal width with their hashes in hex between blanks, so that a hash is in just if its bucket contains it."""

    def __init__(self, hashes: list[int]):
        self.buckets = max(1, len(hashes) // LOAD)
        held = defaultdict(list)
        for h in hashes:
            held[h % self.buckets].append(f"{h & (1 << 64) - 1:X} ")
        rows = [" " + "".join(sorted(held[b])) for b in range(self.buckets)]
        self.width = max(map(len, rows))
        self.table = "".join(r.ljust(self.width) for r in rows).encode()

    def has(self, term: Column) -> Column:
        def found(h):
            at = F.pmod(h, F.lit(self.buckets)) * self.width + 1
            return F.contains(F.substring(F.lit(self.table), at.cast("int"), F.lit(self.width)), F.concat(F.lit(" "), F.hex(h), F.lit(" ")).cast("binary"))

        return let(F.xxhash64(term), found)


def kept_terms(text: Column, words: Lexicon) -> Column:
    """Sorted keys of the terms in the lexicon, of all terms where these are few."""

    def pick(all_terms):
        return let(F.filter(all_terms, words.has), lambda some: F.when(F.size(some) < LEAST, all_terms).otherwise(some))

    return keys_of(let(terms(text), pick))


def _digest(keys: Column, digits: int) -> Column:
    return F.substring(F.md5(F.array_join(keys, "")), 1, digits)


def _big(kept: Column) -> Column:
    """Signatures "w:" of all kept terms and "a:" to "d:" of those outside a quarter of the lexicon; none of no terms."""

    def without(digit: int) -> Column:
        return F.filter(kept, lambda k: F.substring(k, digit, 1) > "3")

    def signed(name: str, keys: Column) -> Column:
        return let(keys, lambda ks: F.when(F.size(ks) > 0, F.concat(F.lit(name + ":"), _digest(ks, 16))))

    made = [signed("w", kept)] + [signed(chr(97 + j), without(j + 1)) for j in range(BIG)]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def _small(kept: Column, s: Column) -> Column:
    """Signatures "i:" of the subsets i below SMALL of 2^s which have a term."""
    many = F.pow(F.lit(2.0), s).cast("long")
    placed = F.transform(kept, lambda k: F.struct((_number(k, 9, 7) % many).alias("i"), k.alias("k")))
    placed = F.sort_array(F.filter(placed, lambda x: x["i"] < SMALL))

    def cut(xs):
        same = lambda x, j: (j > 0) & (F.get(xs, j - 1)["i"] == x["i"])
        run = F.transform(xs, lambda x, j: F.concat(F.when(same(x, j), "").otherwise(F.concat(F.lit(";"), x["i"].cast("string"), F.lit(":"))), x["k"]))
        parts = F.split(F.array_join(run, ""), ";")
        signed = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.substring_index(p, ":", 1), F.lit(":"), F.substring(F.md5(p), 1, 8)))
        return F.when(F.size(xs) == 0, F.expr(_NO_STRINGS)).otherwise(signed)

    return let(placed, cut)


def signatures(kept: Column) -> Column:
    """struct<s, big, coarse, fine>: the share, and the signatures of large subsets and of shares 2^-s and 2^-(s+1); s is -1 without terms."""

    def made(keys: Column) -> Column:
        s = F.length(F.bin(F.greatest(F.size(keys), F.lit(1)))) - 1
        return F.struct(F.when(F.size(keys) == 0, -1).otherwise(s).alias("s"), _big(keys).alias("big"), _small(keys, s).alias("coarse"), _small(keys, s + 1).alias("fine"))

    return let(kept, made)


def likeness(a: Column, b: Column) -> Column:
    def names(x: Column) -> Column:
        return F.transform(x, lambda e: F.substring_index(e, ":", 1))

    def share(x: Column, y: Column) -> Column:
        x, y = F.concat(F.slice(a["big"], 1, 1), x), F.concat(F.slice(b["big"], 1, 1), y)
        return F.size(F.array_intersect(x, y)) / F.size(F.array_union(names(x), names(y)))

    both = (a["s"] >= 0) & (b["s"] >= 0)
    return (
        F.when((a["s"] < 0) & (b["s"] < 0), 1.0)
        .when(both & (a["s"] == b["s"]), share(a["fine"], b["fine"]))
        .when(both & (a["s"] + 1 == b["s"]), share(a["fine"], b["coarse"]))
        .when(both & (a["s"] == b["s"] + 1), share(a["coarse"], b["fine"]))
        .otherwise(0.0)
    )


def shown(sig: Column) -> Column:
    return F.when(sig["s"] < 0, "-").otherwise(F.concat_ws("|", sig["s"].cast("string"), *[F.array_join(sig[part], ",") for part in ("big", "coarse", "fine")]))


def _buckets(docs: DataFrame, id_col: str, text_hash: Column) -> tuple[Column, Column]:
    """(interval, bucket): monotone numbers of (id, hash of text), from _SPLITS sampled quantiles of the ids, each divided evenly: a few thousand documents a bucket.

    An id that fills several quantiles, as a repeated one does, is divided by the hash of its texts.
    """
    got = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [k / _SPLITS for k in range(_SPLITS + 1)], 10_000).alias("q"), F.count("*").alias("n"), F.count(id_col).alias("ids")).first()
    points, n = list(got["q"] or [0]), got["n"]
    q = sorted(set(points))
    each = max(1, n // (_SPLITS * 2000))
    x = F.col(id_col).cast("long")
    # interval k of q holds 2 k + 1: its first id, 2 k + 2: the ids between; null comes first, as interval 0
    k = F.size(F.filter(F.lit(q), lambda v: v <= x)) - 1
    at = lambda values: F.element_at(F.lit(values), F.greatest(k, F.lit(0)) + 1)
    below, first = x.isNull(), x == at(q)
    interval = F.when(below, 0).when(k < 0, 1).otherwise(2 * k + F.when(first, 2).otherwise(3)).cast("long")
    split = F.when(below, max(1, (n - got["ids"]) // 2000)).when(k < 0, 1).when(first, at([each * points.count(v) if points.count(v) > 1 else 1 for v in q])).otherwise(each).cast("long")
    by_hash = F.pmod(F.shiftrightunsigned(text_hash, 24), F.lit(1 << 40)) / float(1 << 40)
    low, high = at(q), at(q[1:] + [q[-1] + 1])
    part = F.when(below | first, by_hash).when(k < 0, 0.0).otherwise((x.cast("double") - low) / (high - low))
    sub = F.least(split - 1, F.greatest(F.lit(0), F.floor(part * split)))
    return interval, (interval * (1 << 40) + sub).cast("long")


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row per document that compares its fingerprint with its edited text's and the next document's."""
    spark = docs.sparkSession
    words = Lexicon(lexicon(docs, text_col))
    text = whole_text(text_col)
    interval, bucket = _buckets(docs, id_col, F.xxhash64(text))
    top = F.shiftrightunsigned(F.xxhash64(text), 24)
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), top.alias("th"), text.alias("text"), interval.alias("iv"), bucket.alias("b"))
    rows = light.drop("iv").repartition("b").withColumn("sig", signatures(kept_terms(F.col("text"), words)))
    # the first document of each bucket follows the last of the bucket before; a row per bucket
    firsts = light.groupBy("iv", "b").agg(F.min_by("text", F.struct("doc_id", "th", "text")).alias("head"))
    edges = light.groupBy("iv").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).orderBy("iv").collect()  # a row per interval: at most 2 _SPLITS + 3
    ends = spark.createDataFrame([(e["iv"], edges[k - 1]["hi"]) for k, e in enumerate(edges)], "iv long, last long")
    before = F.lag("b").over(Window.partitionBy("iv").orderBy("b"))
    heads = firsts.withColumn("before", before).join(F.broadcast(ends), "iv").select(F.coalesce("before", "last").alias("pb"), "head")
    own = Window.partitionBy("b").orderBy("doc_id", "th", "text")
    nxt = rows.withColumns({"n_text": F.lead("text").over(own), "n_sig": F.lead("sig").over(own)})
    # only the last row of a bucket takes its follower from there; rows lie by bucket already
    rows = nxt.join(heads, (F.col("b") == F.col("pb")) & F.col("n_sig").isNull(), "left")
    rows = rows.withColumn("n_sig", F.when(F.col("n_sig").isNull(), signatures(kept_terms(F.col("head"), words))).otherwise(F.col("n_sig")))
    rows = rows.withColumn("n_text", F.coalesce("n_text", "head"))
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(char_length(text) div 4 as int))"), F.expr("substring(n_text, 1, cast(char_length(text) div 4 as int))"))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sig", "n_sig")
    rows = rows.withColumn("e_sig", signatures(kept_terms(F.col("edited"), words)))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("sig")).alias("fingerprint"), shown(F.col("e_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("e_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("n_sig")).alias("near_next"),
    )


def _signed_sql(source: str) -> str:
    """Of `source` (id, part, key): one row (id, part, s, name, level, sig) for each signature."""
    big = " union all ".join(
        [f"select id, 'w' as name, key from {source}"] + [f"select id, '{chr(97 + j)}', key from {source} where substr(key, {j + 1}, 1) > '3'" for j in range(BIG)]
    )
    small = " union all ".join(f"select id, {level} as level, (('0x' || substr(key, 9, 7))::bigint % (1::bigint << (s + {level} - 1)::int)) as i, key from {source} join shares using (id)" for level in (1, 2))
    return f"""shares as (select id, (length(bin(count(*))) - 1)::int as s from {source} group by id),
    big as (select id, name, name || ':' || left(md5(string_agg(key, '' order by key)), 16) as sig from ({big}) group by id, name),
    small as (select id, level, i::varchar as name, i || ':' || left(md5(i || ':' || string_agg(key, '' order by key)), 8) as sig, i from ({small}) where i < {SMALL} group by id, level, i),
    sigs as (
        select id, s, coalesce(b.xs, []) as big, coalesce(c.xs, []) as coarse, coalesce(f.xs, []) as fine
        from shares left join (select id, list(sig order by case name when 'w' then 0 else ascii(name) end) as xs from big group by id) b using (id)
        left join (select id, list(sig order by i) as xs from small where level = 1 group by id) c using (id)
        left join (select id, list(sig order by i) as xs from small where level = 2 group by id) f using (id)
    )"""


def _like_sql(a: str, b: str) -> str:
    def share(x, y):
        x, y = f"list_concat({a}.big[1:1], {a}.{x})", f"list_concat({b}.big[1:1], {b}.{y})"
        names = lambda z: f"list_transform({z}, lambda e: split_part(e, ':', 1))"
        return f"len(list_intersect({x}, {y})) / len(list_distinct(list_concat({names(x)}, {names(y)})))"

    return f"""case when {a}.s is null and {b}.s is null then 1.0 when {a}.s is null or {b}.s is null then 0.0
        when {a}.s = {b}.s then {share("fine", "fine")} when {a}.s + 1 = {b}.s then {share("fine", "coarse")}
        when {a}.s = {b}.s + 1 then {share("coarse", "fine")} else 0.0 end"""


def _shown_sql(x: str) -> str:
    return f"case when {x}.s is null then '-' else concat_ws('|', {x}.s, array_to_string({x}.big, ','), array_to_string({x}.coarse, ','), array_to_string({x}.fine, ',')) end"


#: For documents with distinct ids.
ORACLE_SQL = f"""
    with d as (
        select doc_id, coalesce(text, '') as text, coalesce(lead(doc_id) over o, min(doc_id) over ()) as next_id from documents window o as (order by doc_id)
    ), e as (
        select a.doc_id, a.next_id, length(a.text) as n_chars, left(a.text, length(a.text) - length(a.text) // 4) || left(b.text, length(a.text) // 4) as edited
        from d a join d b on b.doc_id = a.next_id
    ), texts as (select doc_id * 2 as id, text from d union all select doc_id * 2 + 1, edited from e
    ), terms as (
        select id, left(md5(w), {KEY}) as key
        from (select id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '{SEPARATOR}'), lambda w: w <> ''))) as w from texts)
    ), band as (
        select key from terms where id % 2 = 0 group by key
        having count(*) between greatest(1, ceil({LEAST_SHARE} * (select count(*) from d))) and greatest(1, ceil({MOST_SHARE} * (select count(*) from d)))
    ), few as (select id from terms left join band using (key) group by id having count(band.key) < {LEAST}
    ), kept as (select id, key from terms where key in (select key from band) or id in (select id from few)
    ), {_signed_sql("kept")}
    select e.doc_id, n_chars, sha256(edited) as edited_sha256, {_shown_sql("x")} as fingerprint, {_shown_sql("y")} as edited_fingerprint,
        {_like_sql("x", "y")} as near_edited, {_like_sql("x", "z")} as near_next
    from e left join sigs x on x.id = e.doc_id * 2 left join sigs y on y.id = e.doc_id * 2 + 1 left join sigs z on z.id = e.next_id * 2
"""
