"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a learned lexicon (words and word beginnings with their log-odds), how often lexicon
words stand near a second-person word, shares of capitals, punctuation and repeated punctuation, and rates of obfuscation
(look-alike digits and signs inside words, letters drawn out or set apart).

Learning: labels of rows whose crc32 of the identifier modulo 5 is not 0, at most TRAIN_ROWS of them, drawn by hash. The
lexicon has at most LEXICON entries. The features of a training row come from the lexicon of the other half of the
rows, so that trees see what unseen texts look like. Trees learn on three quarters of the rows, the calibration on the rest.
Equal rows teach equal models, to the last digit, however Spark deals the work.

Defined results: null and empty texts are scored by their features, all zero; rows without a label or identifier teach
nothing; of rows that share an identifier the largest text teaches; with no rows or one class only to learn from, every score is that class's share (0 with no rows); rows that
repeat are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of_id, drawn, fresh, materialize, scratch, table

TRAIN_ROWS, LEXICON, LEAST_DOCS, BEGINNINGS, NEAR = 16_000, 4_000, 3, (4, 5, 6), 4
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
LOOK_ALIKE = str.maketrans("013457@$!|", "oieastasii")
_WORDS = re.compile(r"\w+").findall
_HIDDEN = re.compile(r"(?<=[^\W\d_])[@$!|*0-9]+(?=[^\W\d_])")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall
_SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b").findall
_REPEATED = re.compile(r"[!?.*#@$%&]{2,}").findall


def terms_of(words: set[str]) -> Iterator[str]:
    """A text's lexicon terms: its words and, marked by their length, its words' beginnings."""
    yield from words
    for n in BEGINNINGS:
        yield from {f"{n}{w[:n]}" for w in words if len(w) > n}


def words_of(lower: str) -> tuple[list[str], int]:
    """The words of a lower-cased text, look-alikes inside them turned into letters, and the number of such places."""
    lower, hidden = _HIDDEN.subn(lambda m: m[0].translate(LOOK_ALIKE).replace("*", ""), lower)
    return _WORDS(lower), hidden


def drawn_out(text: str) -> tuple[int, int]:
    """Places where a letter comes three times in a row, and where three single letters stand one sign apart."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (c >= 97) & (c != 0xD7) & (c != 0xF7) & ((c <= 122) | (c >= 0xDF) & (c < 0x2000)) if len(c) >= 3 else np.zeros(0, bool)
    thrice = int((letter[2:] & (c[2:] == c[1:-1]) & (c[2:] == c[:-2])).sum())
    alone = letter[1:-1] & ~letter[:-2] & ~letter[2:]
    return thrice, int((alone[:-4] & alone[2:-2] & alone[4:]).sum()) if len(alone) > 4 else 0


def roots_of(lexicon: dict[str, float]) -> frozenset[str]:
    """The shortest beginnings of all the lexicon's beginnings: a word without one of them has none."""
    return frozenset(t[1 : 1 + min(BEGINNINGS)] for t in lexicon if t[0].isdigit())


def features_of(text: str | None, lexicon: dict[str, float], roots: frozenset[str]) -> list[float]:
    text = text or ""
    lower = text.lower()
    words, hidden = words_of(lower)
    counts = Counter(words)
    n, chars = max(1, len(words)), max(1, len(text))
    out = [math.log1p(len(words)), math.log1p(len(text))]
    hits = {w: lexicon[w] for w in counts.keys() & lexicon.keys()}
    strong = {w for w, x in hits.items() if x >= 2.5}
    total, weight = sum(counts[w] for w in strong), math.fsum(x * counts[w] for w, x in hits.items())
    out += [total, 100 * total / n, len(strong), max(hits.values(), default=0.0), weight, 100 * weight / n]
    rooted = [(w, c) for w, c in counts.items() if w[: min(BEGINNINGS)] in roots]
    for size in BEGINNINGS:
        found = [(lexicon[b], c) for w, c in rooted if len(w) > size and (b := f"{size}{w[:size]}") in lexicon]
        out += [sum(c for _, c in found), 100 * sum(x * c for x, c in found) / n]
    near, second = 0, SECOND_PERSON & counts.keys()
    if strong and second:
        places = [(k, w in second) for k, w in enumerate(words) if w in second or w in strong]
        near = sum(x != y and b - a <= NEAR for (a, x), (b, y) in zip(places, places[1:]))
    out += [float(near), 100 * sum(counts[w] for w in second) / n]
    thrice, apart = drawn_out(lower)
    out += [100 * len(_CAPITALS(text)) / chars, 100 * len(_SHOUTED(text)) / n, 100 * text.count("!") / chars, 100 * len(_REPEATED(text)) / n]
    return [*map(float, out), 100 * hidden / n, 100 * (thrice + apart) / n]


def _features(lexicon: dict[str, float]):
    roots = roots_of(lexicon)

    @F.arrow_udf("array<double>")
    def features(text: pa.Array) -> pa.Array:
        return pa.array([features_of(t, lexicon, roots) for t in text.to_pylist()], pa.list_(pa.float64()))

    return features


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of each half and label have a term, counted within the batch first."""
    for batch in batches:
        found: Counter = Counter()
        for text, toxic, half in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for t in terms_of(set(words_of((text or "").lower())[0])):
                found[t, toxic, half] += 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["term", "toxic", "half", "n"])


def _lexicons(train: DataFrame) -> list[dict[str, float]]:
    """Of the rows of half 0, of half 1 and of both: the terms that tell most for label 1, with their log-odds."""
    sizes = {(r.half, r.toxic): r.n for r in train.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    counts = materialize(train.select("body", "toxic", "half").mapInArrow(_term_counts, "term string, toxic int, half int, n long").groupBy("term", "toxic", "half").agg(F.sum("n").alias("n")), "terms")
    out = []
    for halves in ([0], [1], [0, 1]):
        pos, neg = (sum(sizes.get((h, y), 0) for h in halves) for y in (1, 0))
        tally = counts.filter(F.col("half").isin(halves)).groupBy("term").agg(*(F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col("n"))), F.lit(0)).alias(a) for y, a in ((1, "p"), (0, "q"))))
        odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("q") + 0.5) / (neg + 1))
        best = tally.withColumn("odds", odds).filter((F.col("p") >= LEAST_DOCS) & (F.col("odds") > 1)).orderBy((F.col("odds") * F.sqrt("p")).desc(), "term").limit(LEXICON)
        best = materialize(best.select("term", "odds"), "lexicon")  # cut on an executor, so that the driver gets LEXICON rows at most
        out.append({r.term: r.odds for r in best.collect()})
    return out


@scratch()
def toxicity_scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """Learn from docs and labels; returns a function that adds a score column (its second argument) to a table with the same text column."""
    teach = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & (bucket_of_id(F.col("id"), 5) != 0))
    teach = teach.groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = teach.count()
    teach = materialize(teach.filter(drawn("draw", F.col("id"), min(1.0, TRAIN_ROWS / max(n, 1)))), "taught")  # TRAIN_ROWS identifiers, give or take a few hundred
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(F.broadcast(teach), "id").groupBy("id", "toxic").agg(F.max("body").alias("body"))
    train = materialize(train.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)).cast("int")).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(4)).cast("int")), "labelled")
    classes = {(r.toxic, r.cal): r.n for r in train.groupBy("toxic", (F.col("part") == 0).alias("cal")).agg(F.count("*").alias("n")).collect()}
    ones, all_rows = sum(v for k, v in classes.items() if k[0] == 1), sum(classes.values())
    if ones in (0, all_rows) or not all(classes.get((y, False)) for y in (0, 1)):
        return lambda df, score: df.withColumn(score, F.lit(ones / all_rows if all_rows else 0.0))
    first, second, both = _lexicons(train)
    seen = train.withColumn("dense", F.when(F.col("half") == 1, _features(first)("body")).otherwise(_features(second)("body")))
    seen = materialize(seen.select("id", "part", F.col("toxic").cast("double").alias("label"), "dense"), "dense")
    # the sample's features, a few MB, in one sorted partition: sums of floating-point numbers then have one order, and so one result
    seen = materialize(seen.coalesce(1).sortWithinPartitions("id", "label", "dense"), "ordered").withColumn("features", array_to_vector("dense"))
    trees = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.3, seed=7, maxBins=32, cacheNodeIds=False).fit(seen.filter("part != 0"))
    held = trees.transform(seen.filter("part = 0")).select("label", vector_to_array("probability")[1].alias("features"))
    calibration = IsotonicRegression().fit(held) if all(classes.get((y, True)) for y in (0, 1)) else None

    def score_into(df: DataFrame, score: str) -> DataFrame:
        names = {k: fresh(df, k) for k in ("dense", "features", "raw", "probability", "prediction", "chance", "calibrated")}
        out = df.withColumn(names["dense"], _features(both)(F.col(text_col))).withColumn(names["features"], array_to_vector(names["dense"]))
        model = trees.copy().setFeaturesCol(names["features"]).setRawPredictionCol(names["raw"]).setProbabilityCol(names["probability"]).setPredictionCol(names["prediction"])
        out = model.transform(out).withColumn(names["chance"], vector_to_array(names["probability"])[1])
        if calibration is None:
            out = out.withColumn(score, F.col(names["chance"]))
        else:  # the trees' own value, at 1 in 100, parts what the calibration ties
            out = calibration.copy().setFeaturesCol(names["chance"]).setPredictionCol(names["calibrated"]).transform(out)
            out = out.withColumn(score, 0.99 * F.col(names["calibrated"]) + 0.01 * F.col(names["chance"]))
        return out.drop(*names.values())

    return score_into


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, held_out, score, predicted."""
    scored = toxicity_scorer(docs, labels, id_col, text_col)(docs.select(id_col, text_col), "score")
    return scored.select(id_col, (bucket_of_id(F.col(id_col), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score 0.5 or more, all columns as they were."""
    score = fresh(docs, "score")
    return toxicity_scorer(docs, labels, id_col, text_col)(docs, score).filter(F.col(score) < 0.5).select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
