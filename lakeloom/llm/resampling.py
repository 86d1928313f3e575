"""Target-distribution importance resampling: documents are drawn by how much their hashed word runs look like a target corpus.

Features are all runs of 1 to NGRAM consecutive words, hashed into BUCKETS by CRC-32. Both corpora give a count for each bucket,
smoothed by one; a bucket's gain is its log ratio, a document's weight the sum of its features' gains. The largest weights
plus Gumbel noise (from a hash of seed and identifier) are a sample without replacement in proportion to exp(weight).

The hash is a position-table CRC. CRC-32 is affine over XOR: a message's value is the XOR of what each byte gives at its distance
from the message's end, and of a constant of the message's length. `CONTRIBUTIONS` holds the former for distances below SPAN; the
words of a batch stand in one array, the contributions of all features' bytes are gathered at once and XORed over each
feature's span by bitwise_xor.reduceat. Longer spans are cut into blocks of SPAN bytes from their end, whose values are folded
in pairs: the left one moved on by the right one's length, which is a linear map of 32 bits for each power of two.

Counting needs one pass over both corpora, weighing another one over the documents; what is shuffled is a row for each task and
bucket. BUCKETS rows come to the driver and go out with the second pass. The drawn documents' ranks are the places in a
range-partitioned sort of those near the cut or above it: no join, and no task with all of them.

Defined results: null and texts without words have no features and weight 0; texts count whole, however long, in pieces of PIECE
bytes; a null identifier counts as the text `null` for the noise and sorts last among ties; rows that repeat are documents of
their own with equal scores, whose order among themselves follows their number of features; with an empty target, or no
document of LEAST_WORDS words, the same holds with counts of 0; an empty table gives an empty result; further columns aren't
looked at. Counts stay exact below 2^53 features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, settled, table

BUCKETS, NGRAM, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, "42"
SPAN, PIECE = 64, 1 << 18
POLYNOMIAL = 0xEDB88320  # fixed by CRC-32
ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """What a byte gives at the end of a message."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & np.uint32(1), (x >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), x >> np.uint32(1))
    return x


_LAST = _byte_table()


def _position_table() -> np.ndarray:
    """CONTRIBUTIONS[d, b]: what byte b gives d bytes before the message's end; each row is the one before it, moved on by a zero byte."""
    rows = [_LAST]
    for _ in range(SPAN - 1):
        rows.append((rows[-1] >> np.uint32(8)) ^ _LAST[rows[-1] & np.uint32(255)])
    return np.array(rows)


CONTRIBUTIONS = _position_table()


def _moved(by: np.ndarray, x: np.ndarray) -> np.ndarray:
    """CRC registers moved on as the map `by` says, a table of what each byte of the register becomes."""
    out = by[0][x & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ by[k][(x >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _maps() -> list[np.ndarray]:
    """Maps that move a register on by 1, 2, 4, ... zero bytes, up to 2^40."""
    x = np.arange(256, dtype=np.uint32)
    one = np.array([(v >> np.uint32(8)) ^ _LAST[v & np.uint32(255)] for v in (x << np.uint32(8 * k) for k in range(4))])
    out = [one]
    for _ in range(40):
        out.append(_moved(out[-1], out[-1].ravel()).reshape(4, 256))
    return out


_ZEROS = _maps()


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of as many zero bytes."""
    x = np.full(len(lengths), ONES)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        odd = (lengths >> k & 1).astype(bool)
        x[odd] = _moved(_ZEROS[k], x[odd])
    return x ^ ONES


_CONSTANTS = length_constants(np.arange(SPAN + 1))


def _linear(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XOR of the contributions of the bytes of each span; sizes are 1 to SPAN."""
    stop = np.cumsum(size)
    first = stop - size
    place = np.arange(stop[-1])
    byte = data[np.repeat(start - first, size) + place]
    distance = np.repeat(stop - 1, size) - place
    return np.bitwise_xor.reduceat(CONTRIBUTIONS.ravel()[distance * 256 + byte], first)


def span_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start : start + size] for each span; no size is 0."""
    out = np.empty(len(start), np.uint32)
    short = size <= SPAN
    if short.any():
        out[short] = _linear(data, start[short], size[short]) ^ _CONSTANTS[size[short]]
    if not short.all():
        begin, length = start[~short], size[~short]
        n = -(-length // SPAN)  # blocks of each span; its first one may be short
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        end = (begin + length)[owner] - (n[owner] - 1 - at) * SPAN
        block = np.maximum(begin[owner], end - SPAN)
        step = PIECE // SPAN
        value = np.concatenate([_linear(data, block[k : k + step], (end - block)[k : k + step]) for k in range(0, len(block), step)])
        left, level = n.copy(), SPAN.bit_length() - 1
        while left.max() > 1:  # fold pairs from each span's end; a first block without partner stays as it is
            last = np.cumsum(left) - 1
            from_end = np.repeat(last, left) - np.arange(left.sum())
            right = np.flatnonzero(from_end % 2 == 0)
            partner = from_end[right] + 1 < np.repeat(left, left)[right]
            value[right[partner]] ^= _moved(_ZEROS[level], value[right[partner] - 1])
            value, left, level = value[right], -(-left // 2), level + 1
        out[~short] = value ^ length_constants(length)
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def words_of(batch: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in one array of bytes with a blank after each: the bytes, each word's start and size, and its text's number."""
    texts = batch.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = _LOWER[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _IN_WORD[data]
    before = np.r_[False, inside[:-1]]
    before[offsets[offsets < len(data)]] = False  # words end with their text
    first = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False]
    after[offsets[offsets > 0] - 1] = False
    size = np.flatnonzero(inside & ~after) + 1 - first
    start = np.cumsum(size + 1) - size - 1
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[inside]
    return joined, start, size, np.searchsorted(offsets, first, "right") - 1


def features(batch: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's number, bucket) of all features of the texts, some at a time."""
    data, start, size, text = words_of(batch)
    for n in range(1, NGRAM + 1):
        first, last = np.arange(max(0, len(start) - n + 1)), np.arange(n - 1, len(start))
        same = text[first] == text[last]
        first, last = first[same], last[same]
        width = start[last] + size[last] - start[first]
        cut = np.searchsorted(np.cumsum(width), np.arange(PIECE, int(width.sum()), PIECE)) if len(width) else []
        for part in np.split(np.arange(len(first)), np.unique(cut)):
            if len(part):
                yield text[first[part]], span_crcs(data, start[first[part]], width[part]) % np.uint32(BUCKETS)


def _pieces(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The column in slices of about 4 * PIECE bytes, or of one text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), 4 * PIECE)) + at)
        yield at, column.slice(at, end - at)
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's features for each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, part in _pieces(batch.column(0)):
            for _, bucket in features(part):
                total += np.bincount(bucket, minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): how many features of the texts fall into each bucket that has some."""
    return texts.select(F.col(text_col).cast("string").alias("body")).mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """Each bucket's floored gain. At most BUCKETS rows of either side come to the driver."""
    s, t = ({r.bucket: r.n for r in counts.collect()} for counts in (source, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    return np.array([math.floor(1000 * math.log((t.get(b, 0) + 1) * (all_s + BUCKETS) / ((s.get(b, 0) + 1) * (all_t + BUCKETS)))) for b in range(BUCKETS)], np.int64)


def _weighed(gain: np.ndarray):
    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros((3, batch.num_rows), np.int64)  # words, features, weight
            for at, part in _pieces(batch.column(1)):
                for k, (text, bucket) in enumerate(features(part)):
                    cuts = np.r_[0, np.flatnonzero(np.diff(text)) + 1]
                    own = text[cuts] + at  # texts come in order, so each stands once
                    n[1, own] += np.diff(np.r_[cuts, len(text)])
                    n[2, own] += np.add.reduceat(gain[bucket], cuts)
            # with w words there are w + (w - 1) + ... features, as far as w reaches
            over = NGRAM * (NGRAM - 1) // 2
            n[0] = np.where(n[1] >= NGRAM * NGRAM - over, (n[1] + over) // NGRAM, np.searchsorted([w * (w + 1) // 2 for w in range(1, NGRAM)], n[1], "right"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, n)], names=["id", "words", "n_features", "weight"])

    return weighed


def _ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored, with the rank of the drawn rows. It is read several times, so it stands in a written table."""
    fit = F.col("words") >= least_words
    n = scored.filter(fit).count()
    wanted = percent * n // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    least = scored.filter(fit).agg(F.percentile_approx("score", max(0.0, 1 - percent / 100 - 0.001), 10_000)).first()[0]
    near = fit & (F.col("score") >= least)
    if scored.filter(near).count() < wanted:  # the sketch's error is below 0.001 by its contract
        near = fit
    order = [F.desc("score"), F.asc_nulls_last("id"), F.desc("n_features")]
    # A row's number holds its partition's above the 33 bits of its place there.
    placed = materialize(scored.filter(near).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("place", 33)
    # one row for each partition of the sort
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())
    ahead = dict(zip((p for p, _ in sizes), np.cumsum([0, *(c for _, c in sizes)]).tolist()))
    ahead = placed.sparkSession.createDataFrame(list(ahead.items()), "part int, ahead long")
    rank = F.col("ahead") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    top = placed.withColumn("part", part.cast("int")).join(F.broadcast(ahead), "part").withColumn("rank", F.when(rank <= wanted, rank))
    return top.select(*scored.columns, "rank").unionByName(scored.filter(~F.coalesce(near, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


@settled("resampled")
def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """A row for each document: id, n_features, weight, score, rank (null if it isn't drawn), n_words. target: texts like those to be drawn."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    rows = rows.mapInArrow(_weighed(gain), "id long, words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(rows.withColumn("score", F.col("weight") + noise), "scored")
    out = _ranked(scored, percent, least_words)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank", F.col("words").alias("n_words"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
