"""Source divergence audit: how unlike the term shares of a language's sources are, by hash-consed segment trees over term ids.

A language keeps the terms of at least LEAST_DOCS of its documents. Each source of it, and the language itself, gives each kept
term a smoothed share in units of 1/SCALE. Two groups differ by the sum over terms of (p - q)^2 / q; a source's telling terms
are those it has more often than its language.

Kept terms are dealt by hash to blocks of about BLOCK; in a block a term's id is its place by total count. A group's counts in a block
are the leaves of a segment tree. Trees are hash-consed: nodes of equal children are one node for all groups of the block,
so the many stretches of equal counts, zeros above all, are shared. Two trees are traversed together, level by level from
their roots; a pair of nodes that comes up again is not followed again but counted with its multiplicity, and a pair of leaves, equal
counts of the one and equal ones of the other, is priced once. A block's tasks are dealt by pairs of chunks of CHUNK
sources, so a task has about 2 * CHUNK sources and BLOCK terms, whatever the language's or a source's size. What leaves it
is a row for each pair of groups, as the result has, which are summed over the blocks, and each source's telling terms of the block.

All arithmetic is exact: shares by long division in integers, for up to 9.2e15 terms in a language.

Defined results: null text, lang and source count as empty text; groups without kept terms have N = 0; a language without kept
terms has pairs of value 0; texts count whole, however long; rows that repeat are documents of their own; further columns aren't
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, settled, table

LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
BLOCK, CHUNK, KEPT_TERMS = 4096, 64, 500_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
_LOWER = str.maketrans(UPPER, UPPER.lower())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents); a row without term says that the group occurs. Counts of some KEPT_TERMS terms at a time."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = list(n)
            cols = [pa.array([None, *terms], pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, terms)], pa.int64())]
            for at in range(0, len(terms) + 1, 10_000):
                part = [c.slice(at, 10_000) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(part[0])), pa.repeat(pa.scalar(source, pa.string()), len(part[0])), *part], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            text = text.as_py()
            terms = _TERMS(text.lower() if text.isascii() else text.translate(_LOWER))
            n.update(terms)
            docs.update(set(terms))
            size += len(n)
            if size > KEPT_TERMS:
                yield from flushed()
                groups, size = {}, 0
    yield from flushed()


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), by long division in steps of 1000, so that no step leaves 64 bits; total: kept terms included."""
    total = np.maximum(total, 1)
    out, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def hash_consed(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Segment trees over the rows of leaves (their number a power of two): each row's root, the leaves' values, and the children of each level's nodes, from the root's level down.

    A node is a number of its level; the children (left, right) of a level's nodes are numbers of the level below, at last of the values.
    """
    values, nodes = np.unique(leaves, return_inverse=True)
    nodes, levels = nodes.reshape(leaves.shape), []
    while nodes.shape[1] > 1:
        pairs, at = np.unique(nodes[:, ::2] * (int(nodes.max()) + 1) + nodes[:, 1::2], return_inverse=True)
        levels.append(np.stack(np.divmod(pairs, int(nodes.max()) + 1)))
        nodes = at.reshape(len(leaves), -1)
    return nodes[:, 0], values, levels[::-1]


def leaf_pairs(roots_a: np.ndarray, roots_b: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Pairs of trees traversed together: (number of the pair, value of a, value of b, how many leaves) with every pair of values of a pair once."""
    pair, a, b, times = np.arange(len(roots_a)), roots_a, roots_b, np.ones(len(roots_a), np.int64)
    for children in levels:
        pair, times = np.r_[pair, pair], np.r_[times, times]
        a, b = np.r_[children[0][a], children[1][a]], np.r_[children[0][b], children[1][b]]
        wide, high = int(b.max()) + 1, int(a.max()) + 1
        key, at = np.unique((pair * high + a) * wide + b, return_inverse=True)
        times = np.bincount(at, times, len(key)).astype(np.int64)
        rest, b = np.divmod(key, wide)
        pair, a = np.divmod(rest, high)
    return pair, a, b, times


def _priced(top: int):
    def priced(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """A block's terms and a pair of chunks' sources: (lang, source, part, item, value), the block's part of both values of each pair of them, and the sources' telling terms.

        Rows without term are the sources, with their totals; the others hold a term's counts.
        """
        heads = rows.filter(pc.is_null(rows.column("term"))).sort_by("source")
        names, chunk, total = heads.column("source").to_pylist(), heads.column("chunk").to_numpy(), heads.column("total").to_numpy()
        rows = rows.filter(pc.is_valid(rows.column("term"))).sort_by([("all_n", "descending"), ("term", "ascending")])  # ids by falling total, so that rare terms, and with them zeros, lie side by side
        counts = rows.column("counts").combine_chunks()
        source = np.searchsorted(np.array(names, object), np.array(counts.flatten().field(0).to_pylist(), object)) if len(rows) else np.zeros(0, int)
        n, ids = counts.flatten().field(1).to_numpy(), np.repeat(np.arange(len(rows)), pc.list_value_length(counts).to_numpy())
        kept = heads.column("kept")[0].as_py()  # terms of the block that any source of the language has
        leaves = np.full((len(names), 1 << max(0, kept - 1).bit_length()), -1, np.int64)  # -1 fills up to a power of two and has no price
        leaves[:, :kept] = 0
        leaves[source, ids] = n
        ca, cb = key[2].as_py(), key[3].as_py()
        a, b = np.nonzero((chunk == ca)[:, None] & (chunk == cb)[None])
        a, b = (a[a < b], b[a < b]) if ca == cb else (a, b)
        back, there = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        roots, values, levels = hash_consed(leaves)
        for at in range(0, len(a), 256):
            i, j = a[at : at + 256], b[at : at + 256]
            pair, x, y, times = leaf_pairs(roots[i], roots[j], levels)
            real = values[x] >= 0
            pair, x, y, times = pair[real], values[x[real]], values[y[real]], times[real]
            p, q = shares(x, total[i[pair]]), shares(y, total[j[pair]])
            square = (p - q) ** 2
            np.add.at(there, at + pair, times * (square // q))
            np.add.at(back, at + pair, times * (square // p))
        left, right = [names[k] for k in a], [names[k] for k in b]
        out = [("pair", left, right, there), ("pair", right, left, back)]
        if ca == cb and len(rows):
            p, q = shares(n, total[source]), shares(rows.column("all_n").to_numpy(), heads.column("lang_total").to_numpy()[0])[ids]
            told = np.flatnonzero((n > 0) & (p > q))
            value = (p[told] - q[told]) ** 2 // q[told]
            terms = rows.column("term").combine_chunks()
            for k in np.unique(source[told]):
                mine = np.flatnonzero(source[told] == k)
                best = pa.table({"value": pa.array(value[mine]), "item": terms.take(pa.array(ids[told[mine]]))})
                best = best.take(pc.select_k_unstable(best, top, [("value", "descending"), ("item", "ascending")]))
                out.append(("term", [names[k]] * len(best), best.column("item").to_pylist(), best.column("value").to_numpy()))
        size = sum(len(v) for *_, v in out)
        return pa.table({
            "lang": pa.repeat(pa.scalar(key[0].as_py(), pa.string()), size), "source": pa.array([s for _, sources, _, _ in out for s in sources], pa.string()), "part": pa.array([part for part, _, _, v in out for _ in range(len(v))], pa.string()),
            "item": pa.array([i for _, _, items, _ in out for i in items], pa.string()), "value": pa.array(np.concatenate([v for *_, v in out]), pa.int64()),
        })

    return priced


@settled("audit")
def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part `pair` for each other source of the language, part `term` for the source's `top` telling terms."""
    plain = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("body"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    # both aggregates keep this partitioning; tasks have summed their own rows before
    of_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = of_source.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("counts"), F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
    terms = materialize(terms.filter(F.col("term").isNull() | (F.col("docs") >= least_docs)).select("lang", "term", "counts", "all_n"), "terms")
    kept = terms.filter("term is not null")

    langs = terms.groupBy("lang").agg(F.count("term").alias("v"), F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("all_n"))), F.lit(0)).alias("n"))
    langs = langs.select("lang", "v", (F.col("n") + F.col("v")).alias("lang_total"), F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK)).cast("int").alias("blocks"))
    groups = terms.select("lang", F.col("term").isNotNull().alias("real"), F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.coalesce(F.sum(F.when(F.col("real"), F.col("c.n"))), F.lit(0)).alias("n"))
    chunks = groups.groupBy("lang").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    langs = materialize(langs.join(chunks, "lang"), "langs")

    chunk_of = lambda source: F.pmod(F.xxhash64(source), F.col("chunks")).cast("int")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    placed = kept.join(langs, "lang").withColumn("block", block)
    sizes = placed.groupBy("lang", "block").agg(F.count("*").cast("int").alias("kept"))
    heads = groups.join(langs, "lang").withColumn("chunk", chunk_of("source")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sizes, ["lang", "block"], "left")
    heads = heads.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "lang", "block", F.least("chunk", "mate").alias("ca"), F.greatest("chunk", "mate").alias("cb"), "source", "chunk", (F.col("n") + F.col("v")).alias("total"), "lang_total", F.coalesce("kept", F.lit(0)).alias("kept"),
        F.lit(None).cast("string").alias("term"), F.lit(None).cast("array<struct<source:string,n:bigint>>").alias("counts"), F.lit(0).cast("long").alias("all_n"),
    )
    upto = F.sequence(F.lit(0), F.col("chunks") - 1)
    pairs = F.flatten(F.transform(upto, lambda x: F.transform(F.filter(upto, lambda y: y >= x), lambda y: F.struct(x.alias("ca"), y.alias("cb")))))
    body = placed.withColumn("c", F.explode(pairs)).select("lang", "block", "c.ca", "c.cb", "term", "counts", "all_n", "chunks")
    mine = F.filter("counts", lambda x: chunk_of(x["source"]).isin(F.col("ca"), F.col("cb")))
    body = body.withColumn("counts", F.when(F.col("chunks") > 1, mine).otherwise(F.col("counts"))).filter(F.size("counts") > 0).drop("chunks")
    tasks = heads.unionByName(body, allowMissingColumns=True)
    priced = materialize(tasks.groupBy("lang", "block", "ca", "cb").applyInArrow(_priced(top), "lang string, source string, part string, item string, value long"), "priced")

    value = priced.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    told = priced.filter("part = 'term'")  # `top` for each source and block at most
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = value.withColumn("rank", rank).unionByName(told.withColumn("rank", rank).filter(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
w AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
t AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM t GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN t USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, t.n AS all_n, l.total AS lang_total, l.v,
  1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS p
  FROM g JOIN l USING (lang) JOIN t USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
q AS (SELECT lang, source, term, n, p, 1 + ({SCALE}::HUGEINT * (all_n + 1)) // (lang_total + v) AS q FROM p),
r AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM q WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term', item, value::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM r) WHERE rank <= {TOP}
"""
