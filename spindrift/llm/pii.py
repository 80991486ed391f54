"""Personal data: known forms, and identifiers that bootstrapped contexts discover.

The known forms (email, ip, card, phone) are seeds. Every token with a digit or @, with the groups of digits
that follow it, is an instance, and the last two words of its line before it are its lexical pattern. The bipartite graph of patterns and instances is scored in rounds: a pattern's confidence is the mean
score of its occurrences, where a seed scores 1, an instance accepted in an earlier round its score and any other 0, smoothed by PRIOR occurrences of none; a pattern is sure with at least SUPPORT distinct seeds or accepted instances
and a confidence of at least CONFIDENT. Instances of MIN_DIGITS digits or an @ that stand in a sure pattern are accepted with the best confidence of their sure patterns, damped, and so can
support further patterns. Rounds go on until the sum of scores grows by less than SETTLED, at most MAX_ROUNDS; as accepted ones lose DAMP a step, chains are short. All instances in sure patterns are marked as kind `found`. Counts are taken over all
documents; both sides of the graph are aggregated by key before they meet, patterns and instances each in salted parts first.

Only DataFrame functions are used. Defined cases: null text counts as empty; a text without spans gives zero
counts, the digest of the empty string and spans ""; texts and lines are read whole however long; ties need no order, as all instances of a pattern fare alike; rows without id and repeated rows each give a row and count each; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, find_spans, stored, whole_text

# Fixed forms. A possessive loop takes what a greedy one would, as nothing follows it; where a run can only match from
# its start or from the end of the match before, that is said, so long runs cost no more than their length.
EMAIL = "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9]){12,}+"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
#: Parts that the instances of a pattern are summed in first.
SALTS = 64
KINDS = ("email", "ip", "card", "phone", "found")
_CLASS = "A-Za-z0-9@._%+()-"
INSTANCE = f"(?:(?<![{_CLASS}])|\\G)[A-Za-z._%+()-]*+[0-9@][{_CLASS}]*+(?:\\x20[(+]?[0-9][{_CLASS}]*+)*+"
#: Tried at the start of a word only, and a word is taken whole, so that a long run costs no more than its length.
CONTEXT = "(?<!\\p{L})(\\p{L}++)[^\\p{L}\\n]{1,3}(\\p{L}++)[^\\p{L}\\p{N}\\n]{1,4}$"
MAX_ROUNDS, SUPPORT, CONFIDENT, PRIOR, DAMP, MIN_DIGITS = 8, 3, 0.5, 1.0, 0.9, 5
SETTLED = 0.01


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is divisible by ten."""
    ds = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(ds, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _ip_ok(hit: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(hit, "\\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(F.concat(F.lit("0"), part(p)), 1, 4).cast("int") <= 255))


def known_spans(text: Column) -> Column:
    """The base spans as array<struct<k,start,end,kind>>, by kind, then start."""
    digit = text.rlike("[0-9]")
    email = find_spans(text, EMAIL, text.contains("@"))
    ip = F.filter(find_spans(text, IP, digit), lambda s: _ip_ok(s["hit"]))
    size = lambda s: F.length(_digits(s["hit"]))
    card = F.filter(find_spans(text, CARD, digit), lambda s: size(s).between(13, 19) & luhn(_digits(s["hit"])))
    phone = F.filter(find_spans(text, PHONE, text.contains("+")), lambda s: size(s).between(9, 15))
    kinds = zip(KINDS, (email, ip, card, phone))
    one = lambda kind: lambda s: F.struct(F.lit(KINDS.index(kind)).alias("k"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    return F.concat(*[F.transform(spans, one(kind)) for kind, spans in kinds])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def private(instance: Column) -> Column:
    return instance.contains("@") | (F.length(_digits(instance)) >= MIN_DIGITS)


def confident_patterns(graph: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Sure patterns (pattern, confidence, support) of a graph (pattern, instance, seed, n) with a row per pair."""
    graph = stored(graph.select("pattern", "instance", "seed", "n", F.pmod(F.xxhash64("instance"), F.lit(SALTS)).alias("salt")))
    # (instance, score) of what is not a seed; in all rounds a score is the best that the instance had in any round
    accepted = stored(graph.filter("false").select("instance", F.lit(0.0).alias("score")))
    known = 0.0
    for _ in range(max_rounds):
        scored = graph.join(accepted, "instance", "left").select("pattern", "salt", "n", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))
        parts = scored.groupBy("pattern", "salt").agg(F.sum(F.col("score") * F.col("n")).alias("mass"), F.sum("n").alias("n"), F.sum((F.col("score") > 0).cast("long")).alias("support"))
        summed = parts.groupBy("pattern").agg(F.sum("mass").alias("mass"), F.sum("n").alias("n"), F.sum("support").alias("support"))
        sure = summed.select("pattern", (F.col("mass") / (F.col("n") + PRIOR)).alias("confidence"), "support")
        sure = stored(sure.filter((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENT)))
        through = graph.filter(~F.col("seed") & private(F.col("instance"))).join(sure, "pattern").select("instance", (F.col("confidence") * DAMP).alias("score"))
        accepted = stored(accepted.unionByName(through).groupBy("instance").agg(F.max("score").alias("score")))
        total = accepted.agg(F.sum("score")).first()[0] or 0.0
        if total <= known * (1 + SETTLED):
            break
        known = total
    return sure


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    text = whole_text(text_col)

    def instance(s):
        before = F.substring_index(s["gap"], "\n", -1)
        pattern = F.lower(F.concat_ws(" ", F.regexp_extract(before, CONTEXT, 1), F.regexp_extract(before, CONTEXT, 2)))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("instance"), pattern.alias("pattern"))

    seen = F.filter(F.transform(find_spans(text, INSTANCE), instance), lambda x: x["pattern"] != " ")
    light = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), known_spans(text).alias("base"), seen.alias("seen")))
    flat = beside(light, "seen", "base", "instance:string,pattern:string").withColumn("seed", ~F.col("beside")).drop("beside")
    graph = flat.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    sure = confident_patterns(graph).select("pattern")
    more = flat.filter(~F.col("seed") & private(F.col("instance"))).join(sure, "pattern", "left_semi")
    one = F.struct(F.lit(4).alias("k"), "start", "end", F.lit("found").alias("kind"))
    more = more.groupBy("row").agg(F.collect_list(one).alias("more"))  # a document's own tokens
    none = F.expr("cast(array() as array<struct<k:int,start:int,end:int,kind:string>>)")
    out = light.join(more, "row", "left").withColumn("more", F.coalesce("more", none))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    ordered = joined(F.col("base"))
    return out.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(ordered.cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"))
