"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's mean repetition rate is its target share of the output's characters over its own characters. Each document's
count is drawn by inverting that Poisson distribution at a number in (0, 1) hashed from seed and identifier, so a rerun
or a lost executor draws the same. Documents are exploded by their counts and shuffled globally by a hash of seed,
identifier and copy number.

Target weights: `targets` names the shares of some sources; the others share what is left, in proportion to their
characters to the power `alpha`. Defined results: null sources are one source; null texts have no characters, and a source
without characters has the rate `epochs`; rows that repeat an identifier draw alike, a null identifier as the
text `null`; a document of the columns added keeps its own column, and the added one gets the suffix `_1`; an empty table
gives an empty result.

A distribution is kept from 12 standard deviations below its mean to 12 (and 30 copies) above it: 24 * sqrt(rate) + 31 chances,
with their sum to 1 within rounding. Copy numbers are 64-bit, and copies are made in blocks, so a rate of 1e10 works like any other. The table of rates has a row per source. It is broadcast if its chances are at most
BROADCAST_CHANCES (16 MB). Beyond that only sources of over 1/HOT_SHARE of all rows are, so fewer than HOT_SHARE rows, with at
most BROADCAST_CHANCES / HOT_SHARE chances each; all others meet their documents in a shuffle join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialize, scratch, table

TARGETS, ALPHA, EPOCHS, SEED = {"src0": 0.2}, 0.7, 1.0, "mix-1"
BROADCAST_CHANCES, HOT_SHARE = 2_000_000, 1000
COPIES = 100_000  # a document's copies are numbered in blocks of so many, so no row holds a longer list


def uniform(seed: str, id_col: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of seed and identifier."""
    word = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(word, 16, 10).cast("double") + 0.5) / float(16**13)


def chance(k: Column, rate: Column) -> Column:
    """The Poisson chance of k copies, both doubles, for a rate above 0.

    Beyond 16 copies it is exp(-deviance - rest) / sqrt(2 pi k), where k ln(k / rate) + rate - k is the deviance and the rest is that of Stirling's
    series: no large numbers cancel, so the chances hold at any rate.
    """
    x = (rate - k) / k
    deviance = k * (x - F.log1p(x))
    rest = 1 / (12 * k) - 1 / (360 * k * k * k) + 1 / (1260 * F.pow(k, F.lit(5.0)))
    few = F.exp(k * F.log(rate) - rate) / F.factorial(F.least(k, F.lit(16.0)).cast("int")).cast("double")
    return F.when(k < 16, few).otherwise(F.exp(-deviance - rest) / F.sqrt(2 * math.pi * k))


def numbered(rows: DataFrame, count: str, copy: str) -> DataFrame:
    """A row for each copy, numbered from 1 in the column `copy`; rows whose count is 0 have none. Two steps, of at most COPIES copies each for counts up to COPIES squared."""
    block = fresh(rows, "block")
    blocks = rows.filter(F.col(count) > 0).withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{count}` - 1) div {COPIES}"))))
    first = F.col(block) * COPIES + 1
    return blocks.withColumn(copy, F.explode(F.sequence(first, F.least(F.col(count), first + (COPIES - 1))))).drop(block)


def source_rates(docs: DataFrame, source_col: str, text_col: str, targets: dict[str, float], alpha: float, epochs: float) -> DataFrame:
    """A row for each source: key, chars, rows, rate, least (copies), cdf (the chances of at most least, least + 1, ... copies)."""
    key = F.concat(F.lit("="), F.col(source_col).cast("string"))
    sizes = docs.groupBy(F.coalesce(key, F.lit("")).alias("key")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("long")).alias("chars"), F.count("*").alias("rows"))
    named = F.lit(None).cast("double")
    for source, share in sorted(targets.items()):
        named = F.when(F.col("key") == F.lit("=" + source), F.lit(float(share))).otherwise(named)
    sized = materialize(sizes.withColumns({"named": F.when(F.col("chars") > 0, named), "power": F.pow(F.col("chars").cast("double"), F.lit(alpha))}), "sources")
    whole = sized.agg(F.sum("chars").alias("all_chars"), F.coalesce(F.sum("named"), F.lit(0.0)).alias("all_named"), F.sum(F.when(F.col("named").isNull(), F.col("power"))).alias("all_power"))
    rest = F.greatest(F.lit(0.0), 1 - F.col("all_named"))
    share = F.coalesce("named", rest * F.col("power") / F.when(F.col("all_power") > 0, F.col("all_power")))
    rated = sized.join(F.broadcast(whole), how="cross")  # one row of totals
    rate = F.when(F.col("chars") > 0, share * F.col("all_chars") * epochs / F.col("chars")).otherwise(F.lit(float(epochs)))
    wide = 12 * F.sqrt("rate")
    rated = rated.select("key", "chars", "rows", rate.alias("rate")).withColumn("least", F.greatest(F.lit(0), F.floor(F.col("rate") - wide)).cast("long"))
    chances = rated.withColumn("k", F.explode(F.sequence(F.col("least"), F.ceil(F.col("rate") + wide + 30).cast("long"))))
    k = F.col("k").cast("double")
    p = F.when(F.col("rate") > 0, chance(k, F.col("rate"))).otherwise((F.col("k") == 0).cast("double"))
    upto = F.sum("p").over(W.partitionBy("key").orderBy("k").rowsBetween(W.unboundedPreceding, 0))  # the chances of one source
    summed = chances.withColumn("p", p).withColumn("cdf", upto)
    return summed.groupBy("key", "chars", "rows", "rate", "least").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda x: x["cdf"]).alias("cdf"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = EPOCHS, seed: str = SEED, copy_col: str = "copy_no", order_col: str = "shuffle_key") -> DataFrame:
    """docs with each row repeated by its count (maybe none), in a global random order; adds copy number (from 1) and order key."""
    with scratch() as keep:
        rates = keep(materialize(source_rates(docs, source_col, text_col, TARGETS if targets is None else targets, alpha, epochs), "rates"))
    key, least, cdf, hot, copy, order = (fresh(docs, stem) for stem in ("key", "least", "cdf", "hot", "copy", "order"))
    small = rates.select(F.col("key").alias(key), F.col("least").alias(least), F.col("cdf").alias(cdf), "rows")
    keyed = docs.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")))
    chances, rows = rates.agg(F.sum(F.size("cdf")), F.sum("rows")).first()
    if (chances or 0) <= BROADCAST_CHANCES:
        drawn = keyed.join(F.broadcast(small.drop("rows")), key)
    else:
        is_hot = (F.col("rows") > rows // HOT_SHARE) & (F.size(cdf) <= BROADCAST_CHANCES // HOT_SHARE)
        often, seldom = small.filter(is_hot).drop("rows"), small.filter(~is_hot).drop("rows")
        flagged = keyed.join(F.broadcast(often.select(key, F.lit(True).alias(hot))), key, "left")
        drawn = flagged.filter(F.col(hot)).drop(hot).join(F.broadcast(often), key).unionByName(flagged.filter(F.col(hot).isNull()).drop(hot).join(seldom, key))
    draw = uniform(seed, F.col(id_col))
    copies = F.col(least) + F.size(F.filter(F.col(cdf), lambda c: c <= draw))
    drawn = numbered(drawn.withColumn(cdf, copies), cdf, copy)
    drawn = drawn.withColumn(order, F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(copy).cast("string")).cast("binary")))
    mixed = drawn.select(*docs.columns, copy, order).repartition(F.col(order)).sortWithinPartitions(order)
    taken = {c.lower() for c in docs.columns}
    return mixed.withColumnsRenamed({a: b + "_1" * (b.lower() in taken) for a, b in ((copy, copy_col), (order, order_col))})


def mixed_corpus(docs: DataFrame, **options) -> DataFrame:
    """The mix with the columns of docs alone."""
    copy, order = fresh(docs, "copy"), fresh(docs, "order")
    return mix(docs, copy_col=copy, order_col=order, **options).drop(copy, order)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars", F.col("copy_no").cast("int").alias("copy_no"), "shuffle_key")


OP5_SQL = f"""
WITH s AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY source),
w AS (SELECT *, {" ".join(f"CASE WHEN source = '{k}' AND chars > 0 THEN {v!r}::DOUBLE END" for k, v in TARGETS.items())} AS named, pow(chars::DOUBLE, {ALPHA!r}) AS power FROM s),
t AS (SELECT sum(chars)::DOUBLE AS all_chars, coalesce(sum(named), 0) AS all_named, sum(power) FILTER (WHERE named IS NULL) AS all_power FROM w),
r AS (SELECT source, CASE WHEN chars > 0 THEN coalesce(named, greatest(0, 1 - all_named) * power / nullif(all_power, 0)) * all_chars * {EPOCHS!r} / chars ELSE {EPOCHS!r} END AS rate FROM w, t),
p AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 31)::BIGINT)) AS k FROM r)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
d AS (SELECT *, (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / {16**13}::DOUBLE AS u FROM documents),
n AS (SELECT d.*, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM d.source AND c.cdf <= d.u) AS n FROM d)
SELECT doc_id, text, lang, source, n_chars, copy_no::INTEGER AS copy_no, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy_no) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy_no FROM n)
"""
