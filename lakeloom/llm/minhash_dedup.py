"""MinHash near-dedup by a multi-index Hamming join, with every link confirmed on the full shingle sets.

A document's signature is SYMBOLS minhash values of BITS bits. It is cut into CHUNKS chunks. Two signatures that differ
in fewer than CHUNKS * (ERRORS + 1) symbols have, by the pigeonhole principle, a chunk with at most ERRORS = 1 differing
symbol; leaving out each symbol of each chunk in turn gives the keys under which such a pair must meet. So all pairs
within GUARANTEED differing symbols are found, and of those further apart each with the chance that LSH gives
it: a pair of similarity 0.75 misses all keys once in 160,000 times. Every pair that meets and whose sets are near enough in size is
judged by its full sets, or lies within one component already.

Equal shingle sets collapse first. Keys that HOT_LEAST of about HOT_SAMPLE documents share, some 60,000 keys at most, are hot: their
rows stay where they are and learn what concerns their bucket from a broadcast; all others meet by a shuffle. Candidates are then confirmed in two steps, so that no group gives all its pairs: every
member of a bucket against the bucket's smallest member, whose text is repeated, if the bucket is hot, for every SPREAD members or so; then the
pairs across the components of buckets that still span several. The sets in such buckets are ordered by how rare their shingles
are among them, and only pairs whose prefixes share a shingle, early enough in both for threshold percent to be shared, and that have a
key in common, are read and judged. This loses no pair of the bucket, and documents that share a template but not threshold percent
don't meet at all: what is rare in them fills their prefixes. In ROUNDS rounds each set is judged with the one most alike of another
component, so that groups of near copies that no smallest member joins become few components; then all pairs across those that are left.
What can still grow with the square of a group are unlike sets that share their rarest shingles; they meet in blocks of about BLOCK rows.
Joins of one row for each set or vertex with another such table never broadcast (`merge`): there are many, and each would take some of the driver's memory.

Defined results: null, empty or white-space texts have no shingles and link with nothing; rows with a null identifier
link with nothing and stay; rows that share an identifier are documents of their own, told apart by their sets, whose groups
may then have equal component_ids; of a group's rows with its smallest identifier the one with the first set and text stays, and
of rows that repeat both the one whose other columns come first as JSON: so a rerun keeps the same rows; texts count whole,
however long, and a text's set must fit into a task's memory; further columns stay as they are, whatever their names; an empty table gives
an empty result. Rows of one identifier are told apart by a 64-bit hash of their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, drawn, fresh, materialize, release_memory, settled, sorted_groups, table
from .graph import connected_components, spanning_edges

SYMBOLS, CHUNKS, ERRORS, WORDS = 60, 12, 1, 5
WIDTH = SYMBOLS // CHUNKS
GUARANTEED = CHUNKS * (ERRORS + 1) - 1
BLOCK, ROUNDS = 512, 2
HOT_SAMPLE, HOT_LEAST = 20_000, 20
SPREAD = 1000  # members of a hot bucket that meet one copy of its smallest member
_RNG = np.random.Generator(np.random.PCG64(20240901))
_A = _RNG.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_SLOT = _RNG.integers(0, 2**63, (CHUNKS, WIDTH), dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_WORD_HASHES: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; bytes.split() cuts at exactly x20 and x09 to x0D."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORD_HASHES) > 400_000:
        _WORD_HASHES.clear()
    get = _WORD_HASHES.get
    hashes = []
    for w in words:
        if (h := get(w)) is None:
            h = _WORD_HASHES[w] = xxhash.xxh64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    acc = np.full(n, size, np.uint64)
    for j in range(size):
        acc = mix(acc * _P + h[j : n + j])
    return np.unique(acc)


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 8192):
        np.minimum(least, (_A[:, None] * shingles[None, k : k + 8192] + _B[:, None]).min(axis=1), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes, sigs = [], [], []
        for text in batch.column(2).cast(pa.binary()).to_pylist():
            s = shingle_set(text)
            sizes.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=["id", "h", "set_key", "n", "sig"])
    release_memory()


def signature_keys(sigs: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS, WIDTH) keys: each is a chunk's symbols but one, with the place of the one left out."""
    parts = sigs.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty(parts.shape, np.uint64)
    for e in range(WIDTH):
        acc = np.zeros(parts.shape[:2], np.uint64)
        for j in range(WIDTH):
            if j != e:
                acc = (acc << np.uint64(16)) | parts[:, :, j]
        out[:, :, e] = mix(acc ^ _SLOT[:, e])
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            keys = signature_keys(sigs).reshape(len(sigs), -1)
            slots = np.tile(np.arange(keys.shape[1], dtype=np.int8), len(sigs))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1])), pa.array(slots)], names=["key", "id", "slot"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and id, those whose key occurs again, with the key's smallest id. One row is carried between batches."""
    held = None  # the last row so far: key, id, slot, its run's first id, whether it follows one of the same key

    def out(key, i, slot, first, keep):
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(i[keep]), pa.array(slot[keep]), pa.array(first[keep])], names=["key", "id", "slot", "center"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, i, slot = (batch.column(k).to_numpy() for k in range(3))
        if held:
            key, i, slot = np.r_[held[0], key], np.r_[held[1], i], np.r_[held[2], slot].astype(np.int8)
        same = np.r_[bool(held and held[4]), key[1:] == key[:-1]]
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
        first = i[start]
        if held and held[4]:
            first[start == 0] = held[3]
        keep = same[:-1] | same[1:]
        held = (key[-1], i[-1], slot[-1], first[-1], bool(same[-1]))
        yield out(key[:-1], i[:-1], slot[:-1], first[:-1], keep)
    if held and held[4]:
        yield out(*(np.array([x]) for x in held[:2]), np.array([held[2]], np.int8), np.array([held[3]]), np.array([True]))


def jaccard_at_least(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether threshold percent of two sorted sets' union is shared."""
    if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)) or not len(x):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = y.searchsorted(x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _similar(threshold: int):
    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        sets: dict[bytes, np.ndarray] = {}

        def of(text: bytes | None) -> np.ndarray:
            if (s := sets.get(text)) is None:
                if len(sets) >= 256:
                    sets.clear()
                s = sets[text] = shingle_set(text)
            return s

        return pa.array([jaccard_at_least(of(x), of(y), threshold) for x, y in zip(a.cast(pa.binary()).to_pylist(), b.cast(pa.binary()).to_pylist())], pa.bool_())

    return similar


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, s): a row for each shingle of each text's set."""
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            s = shingle_set(text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i)), pa.array(s.view(np.int64))], names=["id", "s"])
    release_memory()


def _near_pairs(threshold: int, best: bool):
    def near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b, alike) of two blocks of rows that share a shingle: of different components and near in size, so placed that threshold percent can still be shared, with a common key.

        alike: how many symbols agree. best: of each row's partners only the one most alike, of equal ones the first.
        """
        for g in sorted_groups(batches, 3):
            bi, bj = g.column(1)[0].as_py(), g.column(2)[0].as_py()
            blk, ids, comp, n, pos = (g.column(k).to_numpy() for k in range(3, 8))
            sig = np.frombuffer(b"".join(g.column(8).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            rows, cols = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
            left = n - pos  # shingles from this one on
            for at in range(0, len(rows), 256):
                r = rows[at : at + 256]
                ok = (comp[r][:, None] != comp[cols][None]) & (100 * np.minimum.outer(n[r], n[cols]) >= threshold * np.maximum.outer(n[r], n[cols]))
                ok &= (100 + threshold) * np.minimum.outer(left[r], left[cols]) >= threshold * np.add.outer(n[r], n[cols])
                if bi == bj:
                    ok &= r[:, None] < cols[None]
                x, y = np.nonzero(ok)
                found = []
                for k in range(0, len(x), 65536):
                    a, b = r[x[k : k + 65536]], cols[y[k : k + 65536]]
                    off = (sig[a] != sig[b]).reshape(-1, CHUNKS, WIDTH).sum(axis=2)
                    meet = (off <= ERRORS).any(axis=1)
                    found.append(np.stack([ids[a], ids[b], SYMBOLS - off.sum(axis=1)])[:, meet])
                a, b, alike = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
                if best:  # for either side
                    one, two = np.r_[a, b], np.r_[b, a]
                    order = np.lexsort((two, -np.r_[alike, alike], one))
                    order = order[np.r_[True, one[order][1:] != one[order][:-1]]] if len(order) else order
                    a, b, alike = one[order], two[order], np.r_[alike, alike][order]
                for k in range(0, len(a), 65536):
                    part = slice(k, k + 65536)
                    low, high = (np.minimum(a, b), np.maximum(a, b)) if not best else (a, b)
                    yield pa.RecordBatch.from_arrays([pa.array(low[part]), pa.array(high[part]), pa.array(alike[part])], names=["a", "b", "alike"])

    return near_pairs


def _prefixes(sets: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(s, id, n, pos) for the shingles of each set's prefix, the rarest of these sets first; pos: how many of its own come before.

    Two sets of which threshold percent are shared have a shingle in common that is in both prefixes. Shingles of one set alone come
    first and meet nothing, so they are counted and left out.
    """
    rows = texts.mapInArrow(_shingles, "id long, s long")
    often = rows.groupBy("s").agg(F.count("*").alias("often")).filter("often > 1")
    shared = rows.join(often, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "s"))).alias("shared"))  # the set of one text
    placed = sets.select("id", "n").join(shared, "id").withColumn("alone", F.col("n") - F.size("shared"))
    least = F.ceil(F.lit(threshold) * F.col("n") / 100)
    prefix = F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.col("n") - least + 1 - F.col("alone")).cast("int"))
    out = placed.select("id", "n", "alone", F.posexplode(prefix).alias("k", "e"))
    return out.select("e.s", "id", "n", (F.col("alone") + F.col("k")).alias("pos"))


def _cross_pairs(prefixes: DataFrame, open_sets: DataFrame, threshold: int, best: bool) -> DataFrame:
    """Pairs (a, b) of open_sets (id, comp, n, sig) in different components that may be similar, by the shingles that their prefixes share. best: for each set the pair most alike alone.

    The smaller set of a similar pair has the first shared shingle among its first 1 - 2t / (1 + t), so a shingle's rows without one that
    has it there (`early`) give nothing. Rows meet in blocks, but neither two that aren't early nor two of the shingle's largest component.
    """
    rows = prefixes.join(open_sets.select("id", "comp"), "id")
    rows = rows.withColumn("early", F.expr(f"(n - pos) * {100 + threshold} >= n * {2 * threshold}"))
    of_s = rows.groupBy("s", "comp").agg(F.count("*").alias("count"), F.max("early").alias("early")).groupBy("s")
    of_s = of_s.agg(F.max_by("comp", F.struct("count", "comp")).alias("largest"), F.count("*").alias("comps"), F.max("early").alias("some")).filter("comps > 1 and some").select("s", "largest")
    rows = rows.join(of_s, "s").withColumn("in_largest", F.expr("comp = largest")).drop("largest")
    # blocks stand in the order of these kinds, so that a row's partners are a range of blocks
    kinds = {"a": "early and in_largest", "b": "early and not in_largest", "c": "not early and not in_largest", "d": "not early and in_largest"}
    sizes = materialize(rows.groupBy("s").agg(*(F.ceil(F.count(F.expr(f"if({kind}, 1, null)")) / BLOCK).cast("int").alias(k) for k, kind in kinds.items())), "blocks")
    rows = rows.join(sizes, "s")
    own = F.expr(f"case when {kinds['a']} then struct(0 as first, a as size, a as lo, a + b + c as hi) when {kinds['b']} then struct(a as first, b as size, 0 as lo, a + b + c + d as hi) when {kinds['c']} then struct(a + b as first, c as size, 0 as lo, a + b as hi) else struct(a + b + c as first, d as size, a as lo, a + b as hi) end")
    rows = rows.withColumn("own", own).filter("own.hi > own.lo").withColumn("blk", F.col("own.first") + F.pmod(F.xxhash64("id"), F.col("own.size")).cast("int"))
    rows = rows.withColumn("mate", F.explode(F.expr("sequence(own.lo, own.hi - 1)")))
    tasks = rows.join(open_sets.select("id", "sig"), "id").select("s", F.least("blk", "mate").alias("bi"), F.greatest("blk", "mate").alias("bj"), "blk", "id", "comp", "n", "pos", "sig")
    where = ["s", "bi", "bj"]
    pairs = tasks.repartition(*where).sortWithinPartitions(*where).mapInArrow(_near_pairs(threshold, best), "a long, b long, alike long")
    if best:
        pairs = pairs.groupBy("a").agg(F.max(F.struct("alike", (-F.col("b")).alias("b"))).alias("most")).select("a", (-F.col("most.b")).alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _assign(df: DataFrame, components: DataFrame, id_col: str) -> DataFrame:
    """df with `comp`: the component of its identifier."""
    return df.join(components.select(F.col("u").alias(id_col), F.col("v").alias("comp")).hint("merge"), id_col, "left").withColumn("comp", F.coalesce("comp", id_col))


def _buckets(reps: DataFrame) -> DataFrame:
    """key, id, slot, center, hot: a row for each key of each signature that other signatures share, with the smallest identifier that has it."""
    keys_of = lambda sets: sets.select("id", "sig").mapInArrow(_keys, "key long, id long, slot byte")
    sample = reps.filter(drawn("hot", F.col("id"), min(1.0, HOT_SAMPLE / max(reps.count(), 1))))
    hot = materialize(keys_of(sample).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_LEAST).select("key"), "hot-keys")
    # broadcast: HOT_SAMPLE * CHUNKS * WIDTH / HOT_LEAST keys at most
    hot_rows = materialize(keys_of(reps).join(F.broadcast(hot), "key", "left_semi"), "hot-rows")
    centers = hot_rows.groupBy("key").agg(F.min("id").alias("center"))
    cold = keys_of(reps).join(F.broadcast(hot), "key", "left_anti").repartition("key").sortWithinPartitions("key", "id")
    met = cold.mapInArrow(_shared, "key long, id long, slot byte, center long")
    return met.withColumn("hot", F.lit(False)).unionByName(hot_rows.join(F.broadcast(centers), "key").withColumn("hot", F.lit(True)))


def _join_keys(rows: DataFrame, of_key: DataFrame) -> DataFrame:
    """rows joined with one row for each key; both have `hot`. Rows of hot keys stay where they are: of these keys there are some 60,000 at most."""
    cold = rows.filter("not hot").join(of_key.filter("not hot").drop("hot"), "key")
    return cold.unionByName(rows.filter("hot").join(F.broadcast(of_key.filter("hot").drop("hot")), "key"))


def _with_salts(df: DataFrame, salts: DataFrame) -> DataFrame:
    """df, with `salts` of the centre in its column a: 1 for those not in the table, which holds one row for each hot bucket at most."""
    return df.join(F.broadcast(salts), "a", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))


def _salted(stars: DataFrame, salts: DataFrame) -> DataFrame:
    """stars, with the copy of its centre that each row meets."""
    return _with_salts(stars, salts).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")


def _copies(centers: DataFrame, salts: DataFrame) -> DataFrame:
    """centers, a row for each copy that stars meet."""
    return _with_salts(centers, salts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _components(reps: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(u, v): v is the smallest vertex of u's component, for each vertex u of reps that isn't it itself."""
    sets = reps.select(F.col("v").alias("id"), "n", "sig")  # below, an id is a vertex
    buckets = materialize(_buckets(sets), "buckets")
    similar = _similar(threshold)
    side = lambda s: sets.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"))

    def read(vertices: DataFrame) -> DataFrame:
        """id and body of each of these vertices (id); other texts are left out before the join shuffles them."""
        rows = materialize(reps.select("v", "id", "h").join(vertices.select(F.col("id").alias("v")).hint("merge"), "v"), "wanted")
        mine = KeyFilter(rows.select(F.xxhash64("id", "h").alias("h"))).keep(texts, F.xxhash64("id", "h"))
        return mine.dropDuplicates(["id", "h"]).join(rows.hint("merge"), ["id", "h"]).select(F.col("v").alias("id"), "body")

    def with_texts(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
        return pairs.join(bodies.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b").join(bodies.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a")

    stars = materialize(buckets.filter("id != center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct(), "members")
    hot = buckets.filter("hot").select(F.col("center").alias("a")).distinct()
    salts = stars.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("salts")).filter("salts > 1")
    salts = materialize(salts.join(F.broadcast(hot), "a", "left_semi"), "salts")
    stars = _salted(stars, salts).join(side("b").hint("merge"), "b").join(_copies(side("a"), salts), ["a", "salt"]).filter(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    stars = materialize(stars.select("a", "b", "salt").distinct(), "stars")
    wanted = materialize(read(materialize(stars.select(F.col("a").alias("id")).union(stars.select(F.col("b").alias("id"))).distinct(), "star-ids")), "star-texts")
    both = stars.join(wanted.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b").join(_copies(wanted.select(F.col("id").alias("a"), F.col("body").alias("body_a")), salts), ["a", "salt"])
    links = materialize(both.filter(similar("body_a", "body_b")).select("a", "b").distinct(), "star-links")
    components = connected_components(links)

    placed = _assign(buckets, components, "id")
    of_key = placed.select("key", "hot", "comp").distinct().groupBy("key", "hot")
    open_keys = of_key.agg(F.count("*").alias("comps")).filter("comps > 1").select("key", "hot")
    members = _join_keys(placed, open_keys).select("id", "comp").distinct().join(sets, "id")
    members = materialize(members.select("id", "comp", "n", "sig"), "open-sets")
    if members.head(1):
        wanted = materialize(read(members.select("id")), "cross-texts")
        prefixes = materialize(_prefixes(members, wanted, threshold), "prefixes")
        judged = None
        # first, in rounds, each set and the one most alike of another component, then all pairs across what components are left
        for best in [True] * ROUNDS + [False]:
            now = materialize(_assign(members.drop("comp"), components, "id"), "open-components")
            pairs = _cross_pairs(prefixes, now, threshold, best)
            pairs = materialize(pairs if judged is None else pairs.join(judged, ["a", "b"], "left_anti"), "cross-pairs")
            more = materialize(with_texts(pairs, wanted).filter(similar("body_a", "body_b")).select("a", "b"), "cross-links")
            if more.head(1):
                components = connected_components(components.union(more))
            judged = pairs if judged is None else judged.unionByName(pairs)
    return components

def _sources(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, body and h, a hash of the text: id and h name a row, or rows that repeat it."""
    body = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(body).alias("h"), body.alias("body"))


@settled("near-dups")
def _resolve(texts: DataFrame, threshold: int) -> DataFrame:
    """A row for each document (id, h, body): id, h, set_key, n, component_id, stays (whether this id and h are its group's first).

    Vertices are the distinct sets, numbered as they stand in a written table, so that rows of one identifier are told apart.
    """
    feats = materialize(texts.mapInArrow(_features, "id long, h long, set_key binary, n long, sig binary"), "features")
    reps = feats.filter("set_key is not null and id is not null").groupBy("set_key").agg(F.min(F.struct("id", "h")).alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = materialize(reps.select("set_key", "first.id", "first.h", "n", "sig").withColumn("v", F.monotonically_increasing_id()), "sets")
    components = _components(reps, texts, threshold)

    # Sets alone in their component are their own first.
    grouped = components.select(F.col("u").alias("v"), F.col("v").alias("comp")).unionByName(components.select("v", F.col("v").alias("comp")).distinct())
    grouped = grouped.join(reps.select("v", "id", "set_key", "h"), "v")
    first = grouped.groupBy("comp").agg(F.min(F.struct("id", "set_key", "h")).alias("first"))
    first = grouped.join(first, "comp").select("v", F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h"))
    of_set = reps.join(first.hint("merge"), "v", "left").select("set_key", F.coalesce("first_id", "id").alias("component_id"), F.coalesce("first_h", "h").alias("first_h"))
    found = feats.select("id", "h", "set_key", "n").join(of_set, "set_key", "left")
    linked = F.col("id").isNotNull() & F.col("set_key").isNotNull()
    stays = ~linked | (F.col("id").eqNullSafe(F.col("component_id")) & F.col("h").eqNullSafe(F.col("first_h")))
    return found.select("id", "h", "set_key", "n", F.when(linked, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), stays.alias("stays"))


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75) -> DataFrame:
    """A row for each document: id, n_shingles, component_id, kept. threshold: percent of the union that must be shared."""
    found = _resolve(_sources(docs, id_col, text_col), threshold)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75) -> DataFrame:
    """docs with one document of each group, all columns as they were: of its rows with the smallest identifier the one with the first set and text."""
    found = _resolve(_sources(docs, id_col, text_col), threshold)
    i, h, row = (fresh(docs, stem) for stem in ("id", "hash", "row"))
    named = lambda rows: rows.select(F.col("id").alias(i), F.col("h").alias(h))
    gone = named(found.filter("not stays")).distinct()
    again = named(found.filter("stays and id is not null and set_key is not null").groupBy("id", "h").count().filter("count > 1"))
    again = materialize(again, "again")
    out = materialize(gone.unionByName(again), "gone")
    maybe = KeyFilter(out.select(F.xxhash64(i, h).alias("h")))
    marked = docs.withColumns({i: docs[id_col].cast("long"), h: F.xxhash64(docs[text_col].cast("string"))})
    key = F.xxhash64(i, h)
    kept = maybe.drop(marked, key).unionByName(maybe.keep(marked, key).join(out, [i, h], "left_anti").select(*marked.columns)).select(*docs.columns)
    if again.head(1):  # of rows that repeat identifier and text, the first by their other columns
        whole = F.struct(*docs.columns)
        same = marked.join(again, [i, h], "left_semi").groupBy(i, h).agg(F.min_by(whole, F.to_json(whole)).alias(row))
        kept = kept.unionByName(same.select(f"{row}.*"))
    return kept


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(table(spark, sf_dir, "documents"))
