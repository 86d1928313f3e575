"""Exact dedup by a log-structured merge index over text digests.

Each task's rows are dealt to one of MEMTABLES memtables, and a memtable is flushed as a run: its (digest, id) rows, sorted by
digest, with a Bloom filter on the digest in each file. Compaction merges runs, at most `fanout` at a time, into a run of the
next level that has a row per digest (the identifier that stays, and the number of rows), until one run is left: the
lowest level. Digests with more than one row there are hits. A filter over the hits' identifiers tells which texts may be
theirs; these alone are read again, and all their bytes compared, before they count as equal. `lookup` asks an index for
given digests; the runs' order and Bloom filters let it skip most of what they hold.

The digest is SHA-256, by DataFrame functions. The dealt method keeps smallest identifiers; here the contract's largest stays.

Defined results: a null text counts as empty; a null identifier sorts below all others, and a group of nulls alone keeps
a null; of rows that repeat both identifier and text, exactly one stays; further columns stay as they are, whatever
their names; texts count whole, however long; an empty table gives an empty result.

What is broadcast: at most HOT_SHARE hot digests, and a filter of at most 2^MOST_BITS bits. Beyond some 8 million hits the
filter lets more rows through, and beyond some 100 million nearly all: then all texts shuffle once, which is exact too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, fresh, materialize, settled, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEMTABLES, FANOUT = 64, 8
HOT_SHARE = 1000  # a group with over 1/1000 of all rows is hot; so there are fewer than 1000 hot groups


def normal_text(text: Column) -> Column:
    """The text with A-Z lower-cased, nothing else changed; null counts as empty. All-ASCII texts have a faster way."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def digest_of(text: Column) -> Column:
    """SHA-256 of the normal text, as 32 bytes."""
    return F.unhex(F.sha2(normal_text(text), 256))


class DigestIndex:
    """Memtables flushed as sorted runs in the shared folder, and their compaction into one run of (digest, keep_id, n_rows)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.flushed, self.levels = spark, fanout, [], []

    def _write(self, rows: DataFrame, label: str) -> DataFrame:
        bloom = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.max.bytes": "65536", "parquet.bloom.filter.adaptive.enabled": "true"}
        return materialize(rows.sortWithinPartitions("run", "digest"), label, bloom)

    def flush(self, rows: DataFrame) -> None:
        """rows: (digest binary, id). Every task sorts its rows and writes them as its memtable's run, without a shuffle."""
        first = len(self.flushed) * MEMTABLES
        run = F.lit(first) + F.pmod(F.spark_partition_id(), F.lit(MEMTABLES))
        self.flushed.append(self._write(rows.select(run.alias("run"), "digest", "id"), "run"))

    def rows(self) -> DataFrame:
        """All flushed rows: (run, digest, id)."""
        out = self.flushed[0]
        for more in self.flushed[1:]:
            out = out.unionByName(more)
        return out

    def compact(self) -> DataFrame:
        """The lowest level: for each digest the largest identifier and the number of rows.

        Runs r * fanout to r * fanout + fanout - 1 merge into run r of the next level; rows of a digest meet within tasks first, so
        a hot digest shuffles a row per task and run. A level has at most one row per run and digest.
        """
        level = self.rows().select("run", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n_rows"))
        runs = len(self.flushed) * MEMTABLES
        while runs > 1:
            into = F.floor(F.col("run") / self.fanout).cast("int")
            merged = level.withColumn("run", into).groupBy("run", "digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n_rows").alias("n_rows"))
            level, runs = self._write(merged, f"level{len(self.levels) + 1}"), -(-runs // self.fanout)
            self.levels.append(level)
        return level.drop("run")

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """The flushed rows of a few digests: the runs' statistics and Bloom filters tell Parquet which row groups to skip."""
        return self.rows().filter(F.col("digest").isin([F.lit(d) for d in digests]))


def join_level(rows: DataFrame, level: DataFrame, total: int) -> DataFrame:
    """rows joined to level by digest. Hot digests (fewer than HOT_SHARE, so a bounded broadcast) never shuffle their rows."""
    least = max(1, total // HOT_SHARE)
    hot, rest = level.filter(F.col("n_rows") > least), level.filter(F.col("n_rows") <= least)
    if not hot.head(1):
        return rows.join(rest, "digest")
    flagged = rows.join(F.broadcast(hot.select("digest", F.lit(True).alias("is_hot"))), "digest", "left")
    return flagged.filter("is_hot").drop("is_hot").join(F.broadcast(hot), "digest").unionByName(flagged.filter("is_hot is null").drop("is_hot").join(rest, "digest"))


def row_key(id_col: Column) -> Column:
    """An identifier's hash; null identifiers share one."""
    return F.xxhash64(F.coalesce(id_col.cast("string"), F.lit("null")))


@settled("resolved")
def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=digest_of) -> DataFrame:
    """A row for each document: (digest, id, keep_id, n_rows, part), written to the shared folder.

    part tells apart texts of the same digest: null where all of the digest's texts are byte for byte the same.
    """
    index = DigestIndex(docs.sparkSession)
    index.flush(docs.select(digest(F.col(text_col)).alias("digest"), F.col(id_col).alias("id")))
    level = index.compact()
    total = level.agg(F.sum("n_rows")).first()[0] or 0
    entries = materialize(join_level(index.rows().drop("run"), level, total), "entries")

    hits = entries.filter("n_rows > 1")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    texts = KeyFilter(hits.select(row_key(F.col("id")).alias("h"))).keep(texts, row_key(F.col("id")))  # other texts stay where they are
    texts = texts.select(digest(F.col("body")).alias("digest"), "id", normal_text(F.col("body")).alias("body"))
    # Copies of a group meet in the map-side half of this aggregate; what is shuffled is one row for each group, text and task.
    seen = texts.groupBy("digest", "body").agg(F.count("*").alias("m"))
    broken = materialize(seen.groupBy("digest").agg(F.count("*").alias("k")).filter("k > 1").select("digest"), "collisions")
    entries = entries.withColumn("part", F.lit(None).cast("string"))
    if broken.head(1):  # different texts under one digest: these, and only these, are grouped by their bytes
        apart = texts.join(broken, "digest", "left_semi")
        groups = apart.groupBy("digest", "body").agg(F.max("id").alias("keep_id"), F.count("*").alias("n_rows"))
        apart = apart.join(groups, ["digest", "body"]).withColumnRenamed("body", "part")
        entries = materialize(entries.join(broken, "digest", "left_anti").unionByName(apart), "parted")
    return entries


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=digest_of) -> DataFrame:
    """A row for each document: id, keep_id, group_size, kept, text_sha256 of the text with A-Z lower-cased.

    Of rows that repeat both identifier and text, one says that it is kept.
    """
    entries = resolve(docs, id_col, text_col, digest)
    sha = F.lower(F.hex("digest")) if digest is digest_of else F.sha2("part", 256)
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    out = entries.select("digest", "part", F.col("id"), "keep_id", F.col("n_rows").alias("group_size"), stays.alias("kept"), sha.alias("text_sha256"))
    again = materialize(out.filter("kept").groupBy("digest", "part").agg(F.count("*").alias("n")).filter("n > 1"), "again")
    if again.head(1):
        same = (out["digest"] == again["digest"]) & out["part"].eqNullSafe(again["part"]) & out["kept"]
        rest = out.join(again, same, "left_anti")
        out = rest.unionByName(_repeats(out.join(again, same, "left_semi")))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def _repeats(rows: DataFrame) -> DataFrame:
    """Rows that all stay and repeat identifier and text: counted first, so that no group meets in a task, then one of each keeps."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    return counted.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("kept", F.col("k") == 1).drop("n", "k")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=digest_of) -> DataFrame:
    """docs with one row of each group of equal texts, all its columns as they were."""
    entries = resolve(docs, id_col, text_col, digest)
    d, part, i, h = (fresh(docs, stem) for stem in ("digest", "part", "id", "hash"))
    key = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    named = lambda e: e.select(F.col("digest").alias(d), key(F.col("id")).alias(i), F.coalesce(F.sha2("part", 256), F.lit("")).alias(part))
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    again = materialize(entries.filter(stays).groupBy("digest", "part", "id").agg(F.count("*").alias("n")).filter("n > 1"), "again")
    gone = materialize(named(entries.filter(~stays)).unionByName(named(again)).distinct(), "gone")
    split = bool(entries.filter("part is not null").head(1))
    maybe = KeyFilter(gone.select(F.xxhash64(i).alias("h")))
    marked = docs.withColumn(i, key(F.col(id_col)))
    once, rest = maybe.drop(marked, F.xxhash64(i)), maybe.keep(marked, F.xxhash64(i))
    # Only rows whose identifier may be among those to drop need their digest again.
    rest = rest.withColumn(d, digest(F.col(text_col)))
    if split:
        parted = entries.filter("part is not null").select(F.col("digest").alias(d)).distinct().withColumn(h, F.lit(True))
        rest = rest.join(parted, d, "left").withColumn(part, F.when(F.col(h), F.sha2(normal_text(F.col(text_col)), 256)).otherwise(F.lit(""))).drop(h)
    else:
        rest = rest.withColumn(part, F.lit(""))
    kept = once.select(*docs.columns).unionByName(rest.join(gone, [d, i, part], "left_anti").select(*docs.columns))
    if again.head(1):  # rows that repeat identifier and text
        kept = kept.unionByName(rest.join(named(again), [d, i, part], "left_semi").dropDuplicates([d, i, part]).select(*docs.columns))
    return kept


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
