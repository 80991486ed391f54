"""Secrets: known forms, and tokens that a battery of tests can't tell from random strings of their encoding.

Candidates are tokens of MIN_TOKEN characters or more of the base64 alphabets. For each, the narrowest encoding that
holds its characters is inferred, and its symbols are tested against uniform randomness: chi-squared over the alphabet, runs above and below the
alphabet's middle, and serial correlation of neighbours. Fisher's method joins the three p-values; a token passes the battery at ALPHA.

As ordinary words may pass when short, a second p-value asks how likely an ordinary token of this length mixes its
characters as much: the number of changes between digits, capitals and small letters, and the chi-squared value, under rates that
are measured over all letter-only candidates of the table. Benjamini-Hochberg thresholds at level FDR are found for each length band on
histograms of that p-value over the whole table. Flagged are candidates which pass both and do not overlap a known form.

Only DataFrame functions are used. Defined cases: null text counts as empty; a text without spans gives zero
counts, the digest of the empty string and spans ""; very long texts and tokens are tested whole; candidates of equal p-value share a cell of the histogram and fare alike; rows without id and repeated rows each give a row; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, find_spans, let, normal_cdf, stored, whole_text

ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
MIN_TOKEN = 16
#: A run of the class is tried at its start only, so a long one costs no more than its length.
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN
ALPHA, FDR = 0.001, 0.01
KINDS = ("assign", "access", "hex", "random")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def known_spans(text: Column) -> Column:
    """The base spans as array<struct<start,k,end,kind>>, by start, then kind."""
    assign = F.filter(find_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 6)
    access = find_spans(text, ACCESS, text.contains("AKIA"))
    return F.array_sort(F.concat(_of_kind(assign, "assign"), _of_kind(access, "access"), _of_kind(find_spans(text, HEX), "hex")))


def _z(value: Column, mean: Column, var: Column) -> Column:
    return (value - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, n, x2 (chi-squared per alphabet), changes (of character class), p_random to a column `token`.

    Padding (= at the end) doesn't count; rows with less than two characters before it are left out.
    """
    symbols = F.rtrim("token", F.lit("="))
    enc = (
        F.when(F.col("sym").rlike("^[0-9]+$"), "dec")
        .when(F.col("sym").rlike("^([A-Z]?[a-z]+|[A-Z]+)$"), "alpha")
        .when(F.col("sym").rlike("^[0-9a-f]+$") | F.col("sym").rlike("^[0-9A-F]+$"), "hex")
        .when(F.col("sym").rlike("^[A-Z2-7]+$"), "base32")
        .when(F.col("sym").rlike("^[A-Z0-9]+$") | F.col("sym").rlike("^[a-z0-9]+$"), "base36")
        .when(F.col("sym").rlike("^[A-Za-z0-9]+$"), "base62")
        .otherwise("base64")
    )
    alphabet = {"dec": "0123456789", "alpha": "abcdefghijklmnopqrstuvwxyz", "hex": "0123456789abcdef", "base32": "abcdefghijklmnopqrstuvwxyz234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz"}
    full = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    letters = F.lit(full + "+/")
    for name, chars in alphabet.items():
        letters = F.when(F.col("enc") == name, chars).otherwise(letters)
    letters = F.when(F.col("enc") == "base62", full).otherwise(letters)
    folded = F.when(F.col("enc").isin("base62", "base64"), F.translate("sym", "-_", "+/")).otherwise(F.lower("sym"))
    t = tokens.withColumn("sym", symbols).filter(F.length("sym") > 1).withColumn("enc", enc).withColumn("letters", letters).withColumn("folded", folded)
    t = t.withColumn("xs", let(F.col("letters"), lambda abc: F.transform(F.split("folded", ""), lambda c: F.instr(abc, c) - 1)))
    t = t.withColumns({"n": F.size("xs").cast("double"), "m": F.length("letters").cast("double")})
    counts = let(F.col("xs"), lambda xs: F.transform(F.array_distinct(xs), lambda x: F.size(F.filter(xs, lambda y: y == x)).cast("double")))
    zero = F.lit(0.0)
    sq = lambda a: F.aggregate(a, zero, lambda acc, x: acc + x * x)
    t = t.withColumn("x2", F.col("m") / F.col("n") * sq(counts) - F.col("n"))
    p_chi = 1.0 - normal_cdf(_z(F.col("x2"), F.col("m") - 1, 2 * (F.col("m") - 1) * (F.col("n") - 1) / F.col("n")))
    # runs above and below the middle of the alphabet
    t = t.withColumn("bits", let(F.col("m"), lambda m: F.transform("xs", lambda x: (x * 2 >= m).cast("int"))))
    t = t.withColumn("ones", F.aggregate("bits", F.lit(0), lambda a, b: a + b).cast("double"))
    turns = lambda a: F.size(F.filter(F.zip_with(F.slice(a, 2, F.size(a)), F.slice(a, 1, F.size(a) - 1), lambda x, y: x != y), lambda d: d))
    expect = 1 + 2 * F.col("ones") * (F.col("n") - F.col("ones")) / F.col("n")
    p_runs = 2 * (1 - normal_cdf(F.abs(_z(turns(F.col("bits")) + 1.0, expect, (expect - 1) * (expect - 2) / (F.col("n") - 1)))))
    p_runs = F.when((F.col("ones") == 0) | (F.col("ones") == F.col("n")), F.pow(F.lit(2.0), 1 - F.col("n"))).otherwise(p_runs)
    mean = F.aggregate("xs", zero, lambda a, x: a + x) / F.col("n")
    t = t.withColumn("dev", let(mean, lambda mid: F.transform("xs", lambda x: x - mid)))
    # `let` keeps what is the same for all symbols out of the loops over them
    t = t.withColumn("var", sq(F.col("dev")))
    lag = F.aggregate(F.zip_with(F.slice("dev", 2, F.size("dev")), F.slice("dev", 1, F.size("dev") - 1), lambda x, y: x * y), zero, lambda a, x: a + x)
    corr = F.when(F.col("var") > 0, lag / F.col("var")).otherwise(1.0)
    p_serial = 2 * (1 - normal_cdf(F.abs((corr + 1 / (F.col("n") - 1)) * F.sqrt("n"))))
    half = -(F.log(F.greatest(p_chi, F.lit(1e-12))) + F.log(F.greatest(p_runs, F.lit(1e-12))) + F.log(F.greatest(p_serial, F.lit(1e-12))))
    t = t.withColumn("half", half).withColumn("p_random", F.exp(-F.col("half")) * (1 + F.col("half") + F.col("half") * F.col("half") / 2))
    kind = F.transform(F.split("sym", ""), lambda c: F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3))
    t = t.withColumn("changes", turns(kind).cast("double")).withColumn("length", F.length("sym").cast("double"))
    return t.drop("sym", "letters", "folded", "xs", "m", "bits", "ones", "dev", "var", "half")


def ordinary_rates(tested: DataFrame) -> tuple[float, float]:
    """(chance that two symbols of an ordinary token agree, changes of class per neighbouring pair), over all letter-only tokens."""
    plain = tested.filter(F.col("enc") == "alpha")
    # X2 of n letters over 26: 26/n * sum c^2 - n; pairs that agree: (sum c^2 - n) / (n (n - 1))
    agree = ((F.col("x2") + F.col("n")) * F.col("n") / 26 - F.col("n"))
    got = plain.agg(F.sum(agree).alias("a"), F.sum(F.col("n") * (F.col("n") - 1)).alias("p"), F.sum("changes").alias("c"), F.sum(F.col("length") - 1).alias("l")).first()
    same = got["a"] / got["p"] if got["p"] else 1 / 15
    return float(same), float((got["c"] or 0) + 1) / float((got["l"] or 0) + 50)


def ordinary_p(same: float, change: float) -> Column:
    """How likely an ordinary token of this length is as mixed; small for keys."""
    pairs = F.col("length") - 1
    p_mix = 1 - normal_cdf(_z(F.col("changes") - 0.5, pairs * change, pairs * change * (1 - change)))
    k = F.when(F.col("enc") == "hex", 16.0).when(F.col("enc") == "dec", 10.0).when(F.col("enc") == "alpha", 26.0).when(F.col("enc") == "base32", 32.0).when(F.col("enc") == "base36", 36.0).when(F.col("enc") == "base62", 62.0).otherwise(64.0)
    agree = ((F.col("x2") + F.col("n")) * F.col("n") / k - F.col("n")) / 2
    number = F.col("n") * (F.col("n") - 1) / 2
    p_flat = normal_cdf(_z(agree + 0.5, number * same, number * same * (1 - same)))
    half = -(F.log(F.greatest(p_mix, F.lit(1e-12))) + F.log(F.greatest(p_flat, F.lit(1e-12))))
    return F.exp(-half) * (1 + half)


def thresholds(scored: DataFrame, level: float = FDR) -> DataFrame:
    """Benjamini-Hochberg cut on -log10 p (in fortieths) per length band; a row per band of doubling length."""
    cells = scored.groupBy("band", "cell").agg(F.count("*").alias("n"))
    down = Window.partitionBy("band").orderBy(F.desc("cell"))
    counted = cells.select("band", "cell", F.sum("n").over(down).alias("rank"), F.sum("n").over(Window.partitionBy("band")).alias("m"))
    passing = counted.filter(F.pow(F.lit(10.0), -F.col("cell") / 40.0) <= F.col("rank") * level / F.col("m"))
    return passing.groupBy("band").agg(F.min("cell").alias("cut"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    text = whole_text(text_col)
    token = F.transform(find_spans(text, TOKEN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("token")))
    light = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), known_spans(text).alias("base"), token.alias("tokens"))
    light = stored(light)
    tested = stored(battery(beside(light, "tokens", "base", "token:string").withColumnRenamed("beside", "apart")))
    scored = tested.withColumn("p", ordinary_p(*ordinary_rates(tested)))
    band = F.floor(F.log2(F.col("length"))).cast("int")
    scored = scored.withColumn("band", band).withColumn("cell", F.least(F.lit(480), F.floor(-40 * F.log10(F.greatest("p", F.lit(1e-12))))).cast("int"))
    cuts = F.broadcast(thresholds(scored))  # a row per band: at most 31
    flagged = scored.join(cuts, "band").filter((F.col("cell") >= F.col("cut")) & (F.col("p_random") >= ALPHA) & F.col("apart") & (F.col("enc") != "alpha"))
    one = F.struct("start", F.lit(3).alias("k"), "end", F.lit("random").alias("kind"))
    added = flagged.groupBy("row").agg(F.collect_list(one).alias("more"))  # a document's own tokens
    none = F.expr("cast(array() as array<struct<start:int,k:int,end:int,kind:string>>)")
    out = light.join(added, "row", "left").withColumn("more", F.coalesce("more", none))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"))
