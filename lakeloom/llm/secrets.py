"""Secret scans with DataFrame functions only: fixed patterns, and a battery of randomness tests for all other tokens.

Base spans: assigned values, access keys and long hex strings, leftmost and non-overlapping for each kind. All other runs
of 20 or more token characters (TOKEN) that touch no base span are candidates of kind `random`; shorter ones prove too little to be
tested. A prefix of words (`ghp_`, `sk_live_`) before a last part of 32 or more is left out of the tests. What remains, the body, gets
an inferred encoding, hence an alphabet of k symbols, and these tests:

- alphabet uniformity: chi-squared, written as the rate of coinciding symbol pairs, once against uniform symbols and once
  against symbols as skewed as written words of that encoding (TEXT_SKEW); the variance depends on the length;
- runs above and below the alphabet's middle, and serial correlation of neighbouring symbols, against uniform symbols.

A candidate whose symbols fit `uniform` (the three p-values combined by Fisher's method stay above PLAUSIBLE) is a secret
if it is too even to be words: Benjamini-Hochberg at level FDR over all candidates of its length band (powers of two), so
short tokens, which prove little, neither profit from long ones nor are drowned by them. The p-values' ranks come
from a histogram of at most BINS bins a band, not from a sort.

Defined results: a null text counts as empty; positions are code points, ends exclusive; rows that repeat are scanned
alike; further columns aren't looked at; texts of any length and number of matches take linear time; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, settled, table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, TOKEN = r"AKIA[A-Z0-9]+", r"[0-9a-f]{24,}", r"[A-Za-z0-9+/_-]{20,}={0,2}"
FDR, PLAUSIBLE, BINS, BINS_PER_DECADE = 0.01, 0.001, 800, 20
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings in the order they are tried: name, pattern of the whole token without padding, alphabet.
ENCODINGS = [
    ("decimal", "^[0-9]+$", DIGITS),
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", LOWER),
    ("upper", "^[A-Z]+$", UPPER),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", ".", UPPER + LOWER + DIGITS + "+/-_"),
]
#: Sums of squares and cubes of symbol frequencies in written words or numbers, against 1/k and 1/k^2 for uniform ones.
TEXT_SKEW = {"decimal": (0.16, 0.035), "hex": (0.14, 0.027), "HEX": (0.14, 0.027)}
WORDS_SKEW = (0.066, 0.0055)
#: Words before the last part of a token, where that is long enough to be judged alone.
PREFIX = "^(?:[A-Za-z]{2,12}[-_]){1,3}(?=[A-Za-z0-9+/]{32,}$)"
SPAN = "array<struct<start:int,stop:int,token:string>>"
FOLD = 256  # matches whose spans are summed up in one list before the lists are joined
MASK = "\x01"


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _pieces(text: Column, pattern: str, needed: int) -> Column:
    """The text cut at all matches: (gap, token, kept), where kept says that the match counts; the last piece has no token."""
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if needed else 0))
    zipped = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), group)
    return F.transform(zipped, lambda x: F.struct(F.coalesce(x["0"], F.lit("")).alias("gap"), F.coalesce(x["1"], F.lit("")).alias("token"), F.coalesce(F.length(x["2"]) >= needed, F.lit(False)).alias("kept")))


def _spans(text: Column, pattern: str, needed: int = 0) -> Column:
    """All matches as (start, stop, token); needed: least length of group 2. Lengths are summed in lists of FOLD matches, then over the lists."""
    step_to = lambda at, x: at + F.length(x["gap"]) + F.length(x["token"])

    def step(acc: Column, x: Column) -> Column:
        start, stop = acc["at"] + F.length(x["gap"]), step_to(acc["at"], x)
        hit = F.array(F.struct(start.alias("start"), stop.alias("stop"), x["token"].alias("token")))
        return F.struct(stop.alias("at"), F.when(x["kept"], F.concat(acc["found"], hit)).otherwise(acc["found"]).alias("found"))

    def of_list(pieces: Column, start: Column) -> Column:
        return F.aggregate(pieces, F.struct(start.alias("at"), F.array().cast(SPAN).alias("found")), step, lambda acc: acc["found"])

    def of_lists(lists: Column) -> Column:
        widths = F.transform(lists, lambda xs: F.aggregate(xs, F.lit(0), step_to))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        starts = F.aggregate(widths, begin, lambda acc, w: F.struct((acc["at"] + w).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
        return _let(starts, lambda at: F.flatten(F.transform(lists, lambda xs, k: of_list(xs, F.element_at(at, k + 1)))))

    def listed(pieces: Column) -> Column:
        last = F.floor((F.size(pieces) - 1) / FOLD).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(pieces, k * FOLD + 1, F.lit(FOLD)))

    return F.when(text.rlike(pattern), _let(_let(_pieces(text, pattern, needed), listed), of_lists)).otherwise(F.array().cast(SPAN))


def _masked(text: Column, pattern: str, needed: int, least: int) -> Column:
    """The text with each counting match of at least that length turned into as many MASK signs."""
    hide = lambda x: F.concat(x["gap"], F.when(x["kept"] & (F.length(x["token"]) >= least), F.repeat(F.lit(MASK), F.length(x["token"]))).otherwise(x["token"]))
    return F.array_join(F.transform(_pieces(text, pattern, needed), hide), "")


def normal_tail(z: Column) -> Column:
    """P(Z > z), after Abramowitz and Stegun 26.2.17; its error is under 1e-7, and values stay above 1e-40."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) * 0.3989422804014327 * series
    return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-40))


def _when(name: Column, values: dict) -> Column:
    out = F.lit(None)
    for key, value in reversed(values.items()):
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out


def battery(tokens: DataFrame) -> DataFrame:
    """tokens: has `token`. Adds encoding, n, p_words (as uneven as words?), p_runs, p_serial, p_uniform, p_random."""
    body = F.regexp_replace(F.regexp_replace("token", "=+$", ""), PREFIX, "")
    name = F.lit(None).cast("string")
    for n, pattern, _ in reversed(ENCODINGS):
        name = F.when(F.col("body").rlike(pattern), F.lit(n)).otherwise(name)
    df = tokens.withColumn("body", body).withColumn("encoding", name).withColumn("n", F.length("body").cast("double"))
    df = df.withColumns({"k": _when(F.col("encoding"), {n: float(len(a)) for n, _, a in ENCODINGS}), "alphabet": _when(F.col("encoding"), {n: a for n, _, a in ENCODINGS})})
    df = df.withColumns({k: _when(F.col("encoding"), {n: TEXT_SKEW.get(n, WORDS_SKEW)[i] for n, _, _ in ENCODINGS}) for i, k in enumerate(("q2", "q3"))})
    df = df.withColumn("pairs", F.aggregate(F.array_distinct(F.split("body", "")), F.lit(0.0), lambda a, s: a + F.when(F.length(s) > 0, F.pow(F.col("n") - F.length(F.replace(F.col("body"), s, F.lit(""))), F.lit(2.0))).otherwise(0.0)) - F.col("n"))
    symbols = F.expr("transform(filter(split(body, ''), c -> length(c) > 0), c -> cast(instr(alphabet, c) - 1 as double))")
    start = F.expr("named_struct('before', cast(-1 as double), 'first', cast(-1 as double), 'runs', 0D, 'high', 0D, 's1', 0D, 's2', 0D, 'sxy', 0D)")

    def step(acc: Column, x: Column) -> Column:
        middle = F.col("k") / 2
        turn = (acc["before"] < 0) | ((acc["before"] >= middle) != (x >= middle))
        return F.struct(
            x.alias("before"), F.when(acc["before"] < 0, x).otherwise(acc["first"]).alias("first"), (acc["runs"] + F.when(turn, 1.0).otherwise(0.0)).alias("runs"), (acc["high"] + F.when(x >= middle, 1.0).otherwise(0.0)).alias("high"),
            (acc["s1"] + x).alias("s1"), (acc["s2"] + x * x).alias("s2"), (acc["sxy"] + F.when(acc["before"] < 0, 0.0).otherwise(acc["before"] * x)).alias("sxy"),
        )

    df = df.withColumn("walk", F.aggregate(symbols, start, step))
    n, k, walk = F.col("n"), F.col("k"), F.col("walk")
    count = n * (n - 1)

    def coincide(p2: Column, p3: Column) -> Column:
        """Standardised rate of coinciding pairs, for symbols whose frequencies have these sums of squares and cubes."""
        variance = (4 * (n - 2) * (p3 - p2 * p2) + 2 * (p2 - p2 * p2)) / count
        return (F.col("pairs") / count - p2) / F.sqrt(variance)

    high, low = walk["high"], n - walk["high"]
    expected = 2 * high * low / n + 1
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    two_sided = lambda z: F.least(F.lit(1.0), 2 * normal_tail(F.abs(z)))
    circle = walk["sxy"] + walk["before"] * walk["first"]
    scatter = n * walk["s2"] - walk["s1"] * walk["s1"]
    serial = F.when(scatter > 0, (n * circle - walk["s1"] * walk["s1"]) / scatter).otherwise(1.0)
    df = df.withColumns({
        "p_words": normal_tail(-coincide(F.col("q2"), F.col("q3"))),
        "p_uniform": normal_tail(coincide(1 / k, 1 / (k * k))),
        "p_runs": F.when((high == 0) | (low == 0), 1e-9).otherwise(two_sided((walk["runs"] - expected) / spread)),
        "p_serial": two_sided((serial + 1 / (n - 1)) * F.sqrt(n)),
    })
    # Fisher: -2 * sum of ln p is chi-squared with 6 degrees of freedom, whose tail has a closed form.
    half = -(F.log("p_uniform") + F.log("p_runs") + F.log("p_serial"))
    return df.withColumn("p_random", F.exp(-half) * (1 + half + half * half / 2)).drop("body", "k", "alphabet", "q2", "q3", "pairs", "walk")


def band(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def bin_of(p: Column) -> Column:
    return F.least(F.floor(-F.log10(p) * BINS_PER_DECADE), F.lit(BINS - 1)).cast("int")


def thresholds(tested: DataFrame) -> DataFrame:
    """A row for each length band with discoveries: the least bin of p_words that Benjamini-Hochberg passes."""
    bins = tested.groupBy(band(F.col("n")).alias("band"), bin_of(F.col("p_words")).alias("bin")).agg(F.count("*").alias("m"))  # BINS rows a band at most
    down = W.partitionBy("band").orderBy(F.col("bin").desc())
    ranked = bins.withColumn("rank", F.sum("m").over(down)).withColumn("all", F.sum("m").over(W.partitionBy("band")))
    edge = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    return ranked.filter(edge <= FDR * F.col("rank") / F.col("all")).groupBy("band").agg(F.min("bin").alias("least_bin"))


@settled("secrets")
def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_assign, n_access, n_hex, n_random, base_sha256, spans, found (kind, start, stop).

    The secrets themselves are written nowhere: spans are code points of the text, ends exclusive.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    found = texts.withColumns({"assign": _spans(F.col("body"), ASSIGN, 6), "access": F.filter(_spans(F.col("body"), ACCESS), lambda s: s["stop"] - s["start"] >= 20), "hex": _spans(F.col("body"), HEX)})
    named = lambda kind, order: F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))
    found = found.withColumn("base", F.array_sort(F.concat(named("assign", 0), named("access", 1), named("hex", 2))))
    # A run of token characters and masked ones that holds a masked one touches a base span.
    masked = F.replace(F.col("body"), F.lit(MASK), F.lit(" "))
    for kind, pattern, needed, least in (("assign", ASSIGN, 6, 0), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 0)):
        masked = F.when(F.size(kind) > 0, _let(masked, lambda text: _masked(text, pattern, needed, least))).otherwise(masked)  # noqa: B023
    found = found.withColumn("masked", F.when(F.size("base") > 0, masked).otherwise(F.replace(F.col("body"), F.lit(MASK), F.lit(" "))))
    free = F.filter(_spans(F.col("masked"), TOKEN.replace("[", "[" + MASK, 1)), lambda t: ~F.contains(t["token"], F.lit(MASK)))
    found = found.select("id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"), "base", free.alias("free"), F.monotonically_increasing_id().alias("row"))
    # A row for each candidate, the first of a document with what else is known of it; of tokens only their tests are written.
    each = found.select(*found.columns, F.posexplode_outer("free").alias("at", "span")).withColumn("token", F.col("span.token")).drop("free")
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    tested = battery(each).select("row", first.alias("first"), *(F.when(first, F.col(c)).alias(c) for c in ("id", "n_assign", "n_access", "n_hex", "base")), "span.start", "span.stop", "n", "p_words", "p_random")
    tested = materialize(tested, "spans")
    passed = tested.filter("start is not null").withColumn("band", band(F.col("n"))).join(F.broadcast(thresholds(tested.filter("start is not null"))), "band")  # a row for each power of two
    passed = passed.filter((bin_of(F.col("p_words")) >= F.col("least_bin")) & (F.col("p_random") > PLAUSIBLE))
    span = F.struct("start", F.lit(3).alias("order"), F.lit("random").alias("kind"), "stop")
    secrets = passed.groupBy("row").agg(F.collect_list(span).alias("random"))  # the spans of one document
    out = tested.filter("first").drop("start", "stop").join(secrets, "row", "left")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    both = F.array_sort(F.concat("base", F.coalesce("random", F.filter("base", lambda s: F.lit(False)))))
    out = out.withColumn("found", both)
    return out.select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", (F.size("found") - F.size("base")).cast("long").alias("n_random"),
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"), F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("found"),
    )


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")
