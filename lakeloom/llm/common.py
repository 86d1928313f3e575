"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import gc
import re
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions sent to executors travel by value, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__package__])


TEXT_BATCH = 1000  # rows of text that go to Python at a time


def small_batches(query):
    """query, run in a session that hands texts to Python in batches of TEXT_BATCH rows at most, for bounded memory."""

    def run(spark: SparkSession, *args):
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        spark.conf.set(key, min(TEXT_BATCH, int(spark.conf.get(key))) if int(spark.conf.get(key)) > 0 else TEXT_BATCH)
        return query(spark, *args)

    run.__doc__ = query.__doc__
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset, a temporary one, on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lakeloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lakeloom/{label}-{uuid.uuid4().hex}"


_SCRATCH: contextvars.ContextVar[list | None] = contextvars.ContextVar("scratch", default=None)  # what materialize wrote in the innermost `scratch`


def materialize(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, label)
    if (written := _SCRATCH.get()) is not None:
        written.append((df.sparkSession, path))
    df.write.options(**options or {}).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


@contextlib.contextmanager
def scratch():
    """Deletes at its end what materialize wrote inside, but for the tables given to the function that it yields, which pass to the scratch around it, if any."""
    token, kept = _SCRATCH.set([]), set()
    try:
        yield lambda table: kept.add(table.scratch_path) or table
    except BaseException:
        kept.clear()
        raise
    finally:
        written = _SCRATCH.get()
        _SCRATCH.reset(token)
        for spark, path in written:
            if path not in kept:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            elif (around := _SCRATCH.get()) is not None:
                around.append((spark, path))


def settled(label: str):
    """An operator whose result stands in a written table, the only one of its tables that stays."""

    def settle(operator):
        @functools.wraps(operator)
        def run(*args, **options) -> DataFrame:
            with scratch() as keep:
                return keep(materialize(operator(*args, **options), label))

        return run

    return settle


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__ll_{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"__ll_{stem}_{n}"
    return name


def bucket_of_id(id_col: Column, n: int) -> Column:
    """crc32 of the identifier as text, modulo n; a null identifier counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def drawn(seed: str, key: Column, share: float | Column) -> Column:
    """Whether a row is drawn into a sample of this share of all keys: by 53 bits of a hash, so that tiny shares of huge tables draw too."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") / float(1 << 53) < share


def join_by_size(rows: DataFrame, table: DataFrame, keys: list[str], size: str, least: int) -> DataFrame:
    """rows joined with a table of one row for each key, whose column `size` counts the rows that have it.

    Keys of more than `least` rows never shuffle their rows: they are broadcast, so there must be few of them; choose `least` as a
    share of all rows. No other key brings more rows than that together.
    """
    hot, flag = table.filter(F.col(size) > least), fresh(rows.join(table.limit(0), keys), "hot")
    flagged = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias(flag))), keys, "left")
    often = flagged.filter(F.col(flag)).drop(flag).join(F.broadcast(hot), keys)
    return often.unionByName(flagged.filter(F.col(flag).isNull()).drop(flag).join(table.filter(F.col(size) <= least), keys))


def sorted_groups(batches, keys: int):
    """Groups of rows that follow each other with equal values in the first `keys` integer columns, as Arrow tables.

    The input must be sorted by these columns. Only the group at the end of a batch is carried to the next one.
    """
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = pa.Table.from_batches([batch])
        rest = own if rest is None else pa.concat_tables([rest, own])
        new = np.zeros(rest.num_rows - 1, bool)
        for k in range(keys):
            col = rest.column(k).to_numpy()
            new |= col[1:] != col[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1)]
        if len(cuts) > 1:
            rest = rest.combine_chunks()
        for a, b in zip(cuts, cuts[1:]):
            yield rest.slice(a, b - a)
        rest = rest.slice(cuts[-1])
    if rest is not None:
        yield rest


def worker_cache() -> dict:
    """A dictionary that lasts as long as the Python worker, across the tasks that it runs. Its users bound what they keep."""
    return sys.modules.setdefault("_lakeloom_worker_cache", types.ModuleType("_lakeloom_worker_cache")).__dict__


def release_memory() -> None:
    """Hand back to the system what a Python worker's earlier tasks left: garbage in cycles and free pages of Arrow and malloc.

    Functions that travel by value refer to themselves through their globals, so their caches wait for a full collection.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the GNU library alone has it
        ctypes.CDLL(None).malloc_trim(0)


class KeyFilter:
    """A bitmap of hashed keys, of at most 2^MOST_BITS bits (16 MB), that is broadcast to part rows ahead of a join.

    `keep` never leaves out a row whose key is among the keys; it lets through 1 in 16 of the others, and more once there are
    over 8 million keys. So joins behind it stay exact, and shuffle little more than the rows that match.
    """

    MOST_BITS = 27

    def __init__(self, keys: DataFrame):
        """keys: one column, a 64-bit hash of the key; keys may repeat."""
        (h,) = keys.columns
        self.n_bits = 1 << min(self.MOST_BITS, max(15, (16 * keys.count()).bit_length()))
        at = self._at(F.col(h))
        self.bits = materialize(keys.filter(F.col(h).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")), "filter")

    def _at(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.n_bits)) + 1

    def _marked(self, rows: DataFrame, h: Column, how: str) -> tuple[DataFrame, Column]:
        page, bits, place = fresh(rows, "page"), fresh(rows, "bits"), fresh(rows, "place")
        at = self._at(h)
        marked = rows.withColumns({page: F.bitmap_bucket_number(at), place: F.bitmap_bit_position(at)})
        marked = marked.join(F.broadcast(self.bits.select(F.col("page").alias(page), F.col("bits").alias(bits))), page, how)  # 4096 rows of 4 KB at most
        byte = F.conv(F.hex(F.substring(F.col(bits), (F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.call_function("shiftright", byte, (F.col(place) % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
        return marked, hit

    def keep(self, rows: DataFrame, h: Column) -> DataFrame:
        """The rows whose key, of hash h, may be among the keys."""
        marked, hit = self._marked(rows, h, "inner")
        return marked.filter(hit).select(*rows.columns)

    def drop(self, rows: DataFrame, h: Column) -> DataFrame:
        """The other rows."""
        marked, hit = self._marked(rows, h, "left")
        return marked.filter(~F.coalesce(hit, F.lit(False))).select(*rows.columns)
