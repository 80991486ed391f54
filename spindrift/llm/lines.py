"""Removal of lines and passages that stand in several places.

Units are lines, whatever their length, and in lines of several sentences the fewest sentences that follow one another, from each sentence on and up to each, and have MIN_WORDS words
together: shorter sentences say little by themselves. Units are normalised (lower case, single spaces) and digested to 128 bits. The occurrence that ranks first stays,
the others are removed; their offsets are code points of the original text. Rank is by doc_id, then by row, then by position; each row is a document of its own, also where ids are repeated or missing.
Units are extracted once, to a table in the shared folder. Digests are counted with partial aggregation before the shuffle, and only those that occur twice meet their units again: those of more than one in HOT units, of which there
are fewer than HOT, without a shuffle of the units.

Defined cases: null text counts as empty and has no units; very long texts and lines are taken whole; rows without id rank last, among each other by row, and a unit that only they have stays in the first of them; a
row that is repeated under its id loses what the first one has; ties of id go to the row that comes first in the table; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, whole_text

MIN_WORDS = 8
#: At most so many digests are very common ones.
HOT = 10_000
_LINE = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r"[^.!?]*(?:[.!?]+|$)")
_UNITS = "doc_id long, row long, hi long, lo long, start int, end int, words int, sentence boolean, again boolean"


def _windows(sizes: list[int], least: int) -> list[tuple[int, int]]:
    """(i, j) of the fewest sizes i to j - 1 whose sum is `least` or more, from each start and up to each end."""
    found, i, total = set(), 0, 0
    for j, n in enumerate(sizes, 1):
        total += n
        while total - sizes[i] >= least:
            total, i = total - sizes[i], i + 1
        if total >= least:
            found.add((i, j))
    j, total = 0, 0
    for i, n in enumerate(sizes):
        while total < least and j < len(sizes):
            total, j = total + sizes[j], j + 1
        if total >= least:
            found.add((i, j))
        total -= n
    return sorted(found)


def units_of(text: str, min_words: int = MIN_WORDS, line_words: int = 1):
    """(digest, start, end, words, is_sentence, whether the text has it before) of each unit."""
    seen: set[int] = set()
    for m in _LINE.finditer(text):
        line = m.group()
        whole = line.lower().split()
        if not whole:
            continue
        spans = [(m.start(), m.end(), whole, False)] if len(whole) >= line_words else []
        parts = [(m.start() + p.start(), m.start() + p.end(), p.group().lower().split(), True) for p in _SENTENCE.finditer(line)]
        parts = [p for p in parts if p[2]]
        if len(parts) > 1:
            spans += [(parts[i][0], parts[j - 1][1], sum((p[2] for p in parts[i:j]), []), True) for i, j in _windows([len(p[2]) for p in parts], min_words)]
        for start, end, words, sentence in spans:
            digest = xxhash.xxh3_128_intdigest(" ".join(words).encode()) ^ sentence
            yield digest, start, end, len(words), sentence, digest in seen
            seen.add(digest)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _extract(min_words: int, line_words: int):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("sentence", pa.bool_()), ("again", pa.bool_())])
        low = (1 << 64) - 1
        for b in batches:
            rows = [
                (i, row, _signed(d >> 64), _signed(d & low), *rest)
                for i, row, t in zip(*(c.to_pylist() for c in b.columns))
                for d, *rest in units_of(t, min_words, line_words)
            ]
            cols = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (the number of the row in this scan) and text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))


def _removed(rows: DataFrame, min_words: int, line_words: int) -> DataFrame:
    """The removed units with the row that they stand in."""
    small_batches(rows.sparkSession)
    rows = rows.select("doc_id", "row", whole_text("text").alias("text"))
    units = stored(rows.mapInArrow(_extract(min_words, line_words), _UNITS))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    first = units.groupBy("hi", "lo").agg(F.min(rank).alias("first"), F.count("*").alias("n"), F.sum(F.when(F.col("again"), 0).otherwise(1)).alias("copies"))
    first = stored(first.filter("n > 1").select("hi", "lo", "n", "copies", F.col("first.id").alias("kept_doc_id"), F.col("first.row").alias("kept_row")))
    # digests of more than one in HOT units: fewer than HOT of them, so they go to all tasks, and no other fills one
    common = F.col("n") * HOT > units.count()
    hot, others = F.broadcast(first.filter(common)), first.filter(~common)
    met = units.join(hot, ["hi", "lo"]).unionByName(units.join(hot, ["hi", "lo"], "left_anti").join(others, ["hi", "lo"]))
    gone = met.filter(F.col("again") | (F.col("row") != F.col("kept_row")))
    # a row's units by start: lines come before their sentences, and the removed line that reaches furthest is the one they could lie in
    order = Window.partitionBy("row").orderBy("start", "sentence", F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(~F.col("sentence"), F.col("end"))).over(order)
    return gone.withColumn("reach", reach).filter(~F.col("sentence") | F.col("reach").isNull() | (F.col("reach") < F.col("end")))


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, line_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per removed unit: doc_id, start, end, words, unit, kept_doc_id, copies (rows that have it).

    A sentence inside a removed line isn't listed again. Units of several sentences overlap their neighbours. Lines of fewer words than line_words are no units; by default all are.
    """
    unit = F.when(F.col("sentence"), "sentence").otherwise("line").alias("unit")
    return _removed(_rows(docs, id_col, text_col), min_words, line_words).select("doc_id", "start", "end", "words", unit, "kept_doc_id", "copies")


def remove_repeated(docs: DataFrame, min_words: int = MIN_WORDS, line_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without the removed units, and `removed`: array of (start, end) in the original text."""
    # scanned twice, so with its numbers in a table
    docs = stored(_rows(docs, id_col, text_col))
    gone = _removed(docs, min_words, line_words)
    # units of several sentences overlap: what lies together is cut as one
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)
    runs = gone.withColumn("reach", reach).withColumn("run", F.sum(apart).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    gone = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = gone.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))  # a row's own
    rows = docs.join(spans, "row", "left")
    # what stands before each removed span and after the last
    stays = F.zip_with(F.concat(F.array(F.lit(0)), F.col("removed.end")), F.concat(F.col("removed.start"), F.array(F.length("text"))), lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return rows.select("doc_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(stays, "")).alias("text"), F.coalesce("removed", none).alias("removed"))


_WHITE = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def _plain_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{_WHITE}', ' ', 'g'))"


#: The removed units of documents with distinct ids.
ORACLE_SQL = f"""
    with cut as (select doc_id, string_split(coalesce(text, ''), chr(10)) as xs from documents
    ), lines as (
        select doc_id, k, line, {_plain_sql("line")} as plain, (sum(length(line) + 1) over (partition by doc_id order by k) - length(line) - 1)::int as start
        from (select doc_id, unnest(xs) as line, generate_subscripts(xs, 1) as k from cut)
    ), parts as (
        select doc_id, k, m, {_plain_sql("part")} as plain, start + sum(length(part)) over w - length(part) as start, start + sum(length(part)) over w as stop
        from (select doc_id, k, start, unnest(ps) as part, generate_subscripts(ps, 1) as m from (select *, regexp_extract_all(line, '[^.!?]*[.!?]+|[^.!?]+$') as ps from lines where plain <> ''))
        window w as (partition by doc_id, k order by m)
    ), sentences as (
        select *, len(string_split(plain, ' ')) as words, row_number() over w as i, count(*) over (partition by doc_id, k) as n, sum(len(string_split(plain, ' '))) over w as total
        from parts where plain <> '' window w as (partition by doc_id, k order by m)
    ), pairs as (
        select a.doc_id, a.k, a.i, b.i as j from sentences a join sentences b on a.doc_id = b.doc_id and a.k = b.k and a.i <= b.i and b.total - a.total + a.words >= {MIN_WORDS} where a.n > 1
    ), spans as (
        select doc_id, k, max(i) as i, j from pairs group by doc_id, k, j union select doc_id, k, i, min(j) from pairs group by doc_id, k, i
    ), units as (
        select doc_id, k, 0 as i, 0 as j, start, start + length(line) as stop, len(string_split(plain, ' ')) as words, 'line' as unit, plain from lines where plain <> ''
        union all
        select s.doc_id, s.k, s.i, s.j, min(x.start), max(x.stop), sum(x.words), 'sentence', string_agg(x.plain, ' ' order by x.i)
        from spans s join sentences x on x.doc_id = s.doc_id and x.k = s.k and x.i between s.i and s.j group by s.doc_id, s.k, s.i, s.j
    ), ranked as (
        select *, min(doc_id) over u as kept_doc_id, row_number() over (partition by unit, plain order by doc_id, k, i, j) as occurrence from units window u as (partition by unit, plain)
    ), counted as (select unit, plain, count(distinct doc_id) as copies from units group by unit, plain
    ), gone as (select * from ranked join counted using (unit, plain) where occurrence > 1
    )
    select doc_id, start::int as start, stop::int as "end", words::int as words, unit, kept_doc_id, copies from gone g
    where unit = 'line' or not exists (select 1 from gone h where h.unit = 'line' and h.doc_id = g.doc_id and h.k = g.k)
"""
