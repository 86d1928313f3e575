"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over hashed character n-grams (1 to 3 code points,
letters lower-cased, all else a blank) says which of the two groups of languages a text's n-grams fit better: its
margin is the mean over the text's n-grams of a log-odds weight. Decoding takes the codeword of least loss, bits being
weighted by how well they were predicted for each language on the training rows (loss-weighted decoding). A text whose two
best codewords are close is flagged as ambiguous.

Learning: texts and non-null languages of rows whose crc32 of the identifier modulo 3 is not 1. The MOST_LANGS languages with
most rows are learned, from about TRAIN_ROWS rows in all, drawn by hash, as many of each language as there are. N-gram counts
of languages are summed by Spark, at most 2^HASH_BITS rows a language.

Defined results: null texts and texts without a letter are `und` with score 0; rows without language or identifier teach
nothing; rows that repeat are treated alike; with nothing to learn from, all are `und`; with one language to learn, that one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of_id, drawn, materialize, scratch, table, worker_cache

TRAIN_ROWS, MOST_LANGS, HASH_BITS, SMOOTH, SHARPNESS, CLOSE = 12_000, 200, 14, 0.5, 4.0, 0.75


def codewords(k: int) -> np.ndarray:
    """(k, bits) of -1 and 1: all distinct splits for up to 7 languages, beyond that the best spread of random codes."""
    if k <= 7:
        bits = max(1, 2 ** (k - 1) - 1)
        return np.array([[1] * bits] + [[1 if (b + 1) >> (r - 1) & 1 == 0 else -1 for b in range(bits)] for r in range(1, k)])[:k]
    rng = np.random.Generator(np.random.PCG64(11))
    bits = 10 * math.ceil(math.log2(k))
    best, spread = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (k, bits))
        d = ((code[:, None] != code[None]).sum(axis=2) + bits * np.eye(k, dtype=int)).min()
        if d > spread and (abs(code.sum(axis=0)) < k).all():
            best, spread = code, d
    return best


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    kept = worker_cache()
    if (found := kept.get("letters")) is None:
        found = kept["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return found


def ngrams(text: str, letter: np.ndarray) -> np.ndarray | None:
    """Hashed n-grams of the whole text; None if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[c]
    if not is_letter.any():
        return None
    c = np.where(is_letter, c, 32).astype(np.uint32)
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])
    blank = c == 32
    c = c[~(blank & np.roll(blank, 1)) | (np.arange(len(c)) == 0)]
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    return np.concatenate([one, two, three]) >> np.uint32(32 - HASH_BITS)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letter = letters()
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (h := ngrams(text or "", letter)) is not None:
                sums.setdefault(lang, np.zeros(1 << HASH_BITS, np.int64))
                sums[lang] += np.bincount(h, minlength=1 << HASH_BITS)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(s[at])], names=["lang", "gram", "n"])


def _margins(text: str | None, weights: np.ndarray, letter: np.ndarray) -> np.ndarray | None:
    h = ngrams(text or "", letter)
    return None if h is None else weights @ np.bincount(h, minlength=1 << HASH_BITS) / len(h)


def losses(margins: np.ndarray, code: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Of each codeword: the mean logistic loss of the margins against its bits, weighted by trust."""
    return (trust * np.logaddexp(0, -SHARPNESS * code * margins[None])).sum(axis=1)


def predictor(langs: list[str], weights: np.ndarray, code: np.ndarray, trust: np.ndarray):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters()
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                m = _margins(text, weights, letter) if langs else None
                if m is None:
                    found.append(("und", 0.0, True))
                    continue
                loss = losses(m, code, trust)
                chance = np.exp((loss.min() - loss) * SHARPNESS)
                best = int(loss.argmin())
                p = float(chance[best] / chance.sum())
                found.append((langs[best], p, bool(len(langs) > 1 and p < CLOSE)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], names=["id", "lang_pred", "score", "ambiguous"])

    return predict


@scratch()
def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str):
    spark = docs.sparkSession
    pool = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & (bucket_of_id(F.col("id"), 3) != 1))
    sizes = pool.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()  # MOST_LANGS rows at most
    shares = spark.createDataFrame([(r.lang, TRAIN_ROWS / len(sizes) / r.n) for r in sizes], "lang string, share double")
    train = materialize(pool.join(F.broadcast(shares), "lang").filter(drawn("draw", F.col("id"), F.col("share"))).select("body", "lang"), "languages")
    counted = train.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # 2^HASH_BITS rows a language at most
    langs = sorted(counted["lang"].unique())
    if not langs:
        return predictor([], np.zeros((0, 1)), np.zeros((0, 0)), np.zeros((0, 0)))
    rates = np.zeros((len(langs), 1 << HASH_BITS))
    rates[[langs.index(x) for x in counted["lang"]], counted["gram"]] = counted["n"]
    rates = (rates + SMOOTH) / (rates + SMOOTH).sum(axis=1, keepdims=True)
    code = codewords(len(langs))
    weights = np.array([np.log(rates[bit > 0].mean(axis=0)) - np.log(rates[bit < 0].mean(axis=0)) if (bit < 0).any() else np.zeros(1 << HASH_BITS) for bit in code.T])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters()
        for batch in batches:
            right, rows = np.zeros(code.shape, np.int64), np.zeros(len(langs), np.int64)
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang in langs and (m := _margins(text, weights, letter)) is not None:
                    k = langs.index(lang)
                    right[k] += np.sign(m) == code[k]
                    rows[k] += 1
            k, b = (x.ravel() for x in np.indices(code.shape))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(right.ravel()), pa.array(rows[k])], names=["lang", "bit", "hits", "n"])

    trust = np.zeros(code.shape)
    for r in train.mapInArrow(hits, "lang long, bit long, hits long, n long").groupBy("lang", "bit").agg(F.sum("hits").alias("h"), F.sum("n").alias("n")).collect():  # a row for each language and bit
        trust[r.lang, r.bit] = (r.h + 1) / (r.n + 2)
    return predictor(langs, weights, code, trust / trust.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row for each document: id, held_out, lang_pred, score, ambiguous."""
    predict = learn(docs, id_col, text_col, lang_col)
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).mapInArrow(predict, "id long, lang_pred string, score double, ambiguous boolean")
    return out.select(F.col("id").alias(id_col), (bucket_of_id(F.col("id"), 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
