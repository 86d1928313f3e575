"""Hierarchical multi-length packing of documents into training windows.

A document's tokens (with the end token) are routed by their number to the shortest context tier that holds them; what is longer
than the longest tier fills windows of that length and routes its rest. Tiers are packed from the longest to the shortest: an item
of more than half a window opens one, and the gap behind it is filled from shorter tiers, with the longest item that fits, again
and again; where none fits, the shortest one is cut and its rest routed anew. So every window is full, and at most one cut is made in each. The
windows of a slice of rows are dealt to step groups of about STEP_TOKENS tokens, the longest first, each to the lightest group.

Each task packs its own rows, slice by slice, so no token is shuffled. What no window of the shortest tier holds at a task's end,
fewer tokens than that tier has, meets the rests of JOINED - 1 other tasks and is packed into long windows without cuts, best
fit first: these alone are padded.

Tokens are those of the tokenizers library: words are cut by its pattern, with letters, numbers and white space classed as it does,
and each word is encoded once, by tiktoken with the same vocabulary's ranks, which merges as that library does and takes a third of the
time. Words are kept for later texts; once they are many, those not met again are dropped.

Defined results: a null text counts as empty and has its end token alone; texts count whole, however long; rows that repeat are
packed as documents of their own; a null identifier stays null; an empty table gives an empty result; further columns aren't looked at.
The pieces stand in a written table, so that every reader sees one layout. Sequences have ids of their task and number.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_symbols, char_ranges
from .common import materialize, release_memory, table

TIERS, STEP_TOKENS, END_ID = (1024, 512, 256, 128), 65_536, 0
SLICE_TOKENS, JOINED = 1 << 20, 512
KEPT_WORDS, LONG_WORD, CUT_CHARS = 150_000, 100, 500_000
FIELDS = [("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int32()), ("step_id", pa.int64()), ("ids", pa.list_(pa.int32()))]
NAMES = [n for n, _ in FIELDS]
SCHEMA = "id long, start long, length long, crc long, doc_tokens long, sequence_id long, offset long, window int, step_id long, ids array<int>"


@functools.cache
def library_classes() -> dict[str, str]:
    """The tokenizers library's letters, numbers and white space, as the insides of character classes."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]))  # elsewhere Unicode has none
    found = lambda kind: pre_tokenizers.Split(Regex(kind + "+"), "removed", invert=True).pre_tokenize_str(every)
    return {k: char_ranges(set("".join(word for word, _ in found(kind)))) for k, kind in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))}


class WordEncoder:
    """Token ids of texts, as little-endian 32-bit integers, for byte-level vocabularies without a normalizer."""

    def __init__(self, spec: str, classes: dict[str, str]):
        import tiktoken

        read = json.loads(spec)
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        as_byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(map(as_byte.__getitem__, token)): i for token, i in read["model"]["vocab"].items() if token not in self.special}
        self.piece = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.classes, self.found = classes, {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The words of the library's byte-level pre-tokenization (a fixed pattern). The fewer characters the classes hold, the faster they are."""
        kind = 0 if text.isascii() else 1 if max(text) <= "￿" else 2
        if kind not in self.found:
            if kind:
                top = 0xFFFF if kind == 1 else 0x10FFFF
                own = {k: "".join(a + "-" + b for a, b in re.findall(r"(\\U[0-9a-f]{8})-(\\U[0-9a-f]{8})", c) if int(b[2:], 16) <= top) for k, c in self.classes.items()}
            else:
                own = {"L": "A-Za-z", "N": "0-9", "S": r"\t-\r\x20"}
            self.found[kind] = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{own['L']}]+| ?[{own['N']}]+| ?[^{own['S']}{own['L']}{own['N']}]+|[{own['S']}]+(?![^{own['S']}])|[{own['S']}]+").findall
        return self.found[kind](text)

    def learn(self, words: set[str]) -> None:
        if len(self.known) > KEPT_WORDS:
            self.older, self.known = self.known, {}
        new = [w for w in words if w not in self.known]
        again = [w for w in new if w in self.older]
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        new = [w for w in new if w not in self.known]
        for w in new:
            self.known[w] = array("I", [self.special[w]] if w in self.special else self.piece(w)).tobytes()

    def parts(self, text: str) -> Iterator[str]:
        """The text cut, where it is very long, between a letter and a blank before a letter: there a word always ends."""
        at = 0
        while len(text) - at > CUT_CHARS and (m := re.compile("[a-z](?= [a-z])").search(text, at + CUT_CHARS - 1)):
            yield text[at : m.end()]
            at = m.end()
        yield text[at:] if at else text

    def encode(self, text: str) -> bytes:
        out = []
        for k, plain in enumerate(self.cut(text) if self.cut else [text]):
            for part in [plain] if k % 2 else self.parts(plain):
                words = [part] if k % 2 else self.words(part) if part else []
                try:
                    out.append(b"".join(map(self.known.__getitem__, words)))
                except KeyError:
                    self.learn(set(words))
                    out.append(b"".join(map(self.known.__getitem__, words)))
                    for w in [w for w in set(words) if len(w) > LONG_WORD]:
                        del self.known[w]
        return b"".join(out)


class Packer:
    """Packs documents' token ids into full windows. An item is (identifier, start, ids as bytes, the document's tokens)."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.by_length: list[list[tuple]] = [[] for _ in range(tiers[0] + 1)]
        self.lengths = self.tokens = 0  # bit n of lengths: there are items of n tokens
        self.full: list[tuple[int, list[tuple]]] = []
        self.n_steps = 0

    def add(self, id_, ids: bytes) -> None:
        top, n = self.tiers[0], len(ids) // 4
        for start in range(0, n - top + 1, top):
            self.full.append((top, [(id_, start, ids[4 * start : 4 * (start + top)], n)]))
        if n % top:
            self.route((id_, n - n % top, ids[4 * (n - n % top) :], n))

    def route(self, item: tuple) -> None:
        n = len(item[2]) // 4
        self.by_length[n].append(item)
        self.lengths |= 1 << n
        self.tokens += n

    def take(self, n: int) -> tuple:
        item = self.by_length[n].pop()
        if not self.by_length[n]:
            self.lengths ^= 1 << n
        self.tokens -= n
        return item

    def head(self, item: tuple, n: int) -> tuple:
        """The item's first n tokens; what is left is routed anew."""
        id_, start, ids, of = item
        self.route((id_, start + n, ids[4 * n :], of))
        return id_, start, ids[: 4 * n], of

    def longest(self, most: int) -> int:
        return (self.lengths & (2 << most) - 1).bit_length() - 1

    def pack(self, last: bool = False) -> None:
        """Fill windows with what is routed. In the last call items longer than what is left to a tier's window are cut to shorter tiers."""
        for size in self.tiers:
            least = size // 2 if size != self.tiers[-1] else 0
            while last and self.tokens >= size and (n := self.longest(self.tiers[0])) > size:
                self.full.append((size, [self.head(self.take(n), size)]))
            while self.tokens >= size and (n := self.longest(size)) > least:
                items, room = [self.take(n)], size - n
                while room:
                    if (n := self.longest(room)) > 0:
                        items.append(self.take(n))
                        room -= n
                    else:
                        longer = self.lengths >> room + 1
                        n = (longer & -longer).bit_length() + room
                        items.append(self.head(self.take(n), room))
                        room = 0
                self.full.append((size, items))

    def steps(self) -> Iterator[tuple[int, int, list[tuple]]]:
        """(step, window size, items) of the windows filled so far, which are forgotten: dealt to groups of nearly equal size."""
        full, self.full = sorted(self.full, key=lambda w: -w[0]), []
        groups = -(-sum(size for size, _ in full) // self.step_tokens)
        heap = [(0, k) for k in range(groups)]
        for size, items in full:
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            yield self.n_steps + k, size, items
        self.n_steps += groups

    def rest(self) -> list[tuple]:
        return [item for items in self.by_length for item in items]


def _row(item: tuple, sequence: int | None, offset: int | None, window: int | None, step: int | None, with_ids: bool) -> tuple:
    id_, start, ids, of = item
    return id_, start, len(ids) // 4, zlib.crc32(ids), of, sequence, offset, window, step, np.frombuffer(ids, "<i4") if with_ids else None


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    def made(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*some), FIELDS)], names=NAMES)

    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) >= 5000:
            yield made(some)
            some = []
    if some:
        yield made(some)


def _packed(spec: str, classes: dict[str, str], tiers: tuple[int, ...], end_id: int, step_tokens: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        release_memory()
        encoder, packer = WordEncoder(spec, classes), Packer(tiers, step_tokens)
        task = TaskContext.get().partitionId() << 32
        sequence = task

        def filled() -> Iterator[tuple]:
            nonlocal sequence
            for step, size, items in packer.steps():
                offset = 0
                for item in items:
                    yield _row(item, sequence, offset, size, task + step, with_ids)
                    offset += len(item[2]) // 4
                sequence += 1

        pending = 0
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                packer.add(id_, ids)
                pending += len(ids) // 4
                if pending >= SLICE_TOKENS:
                    pending = 0
                    packer.pack()
                    yield from filled()
        packer.pack(last=True)
        yield from filled()
        for item in packer.rest():  # no sequence yet; the step holds the task
            yield _row(item, None, None, None, task >> 32, with_ids)
        del encoder, packer
        release_memory()

    return lambda batches: _batches(rows(batches))


def best_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Numbers of the given items in bins of that room, each put where it leaves the least room, the longest first."""
    open_by_room: list[list[int]] = [[] for _ in range(room + 1)]
    rooms, bins = 0, []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        fits = rooms >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = open_by_room[left].pop()
            if not open_by_room[left]:
                rooms ^= 1 << left
        else:
            left, b = room, len(bins)
            bins.append([])
        bins[b].append(k)
        left -= n
        open_by_room[left].append(b)
        rooms |= 1 << left
    return bins


def _joined(window: int):
    def joined(key: tuple[pa.Scalar, ...], rest: pa.Table) -> pa.Table:
        """The rests of some tasks, fewer than JOINED times the shortest tier's tokens, as windows of their own."""
        rest = rest.sort_by([("step_id", "ascending"), ("id", "ascending"), ("start", "ascending"), ("crc", "ascending"), ("doc_tokens", "ascending")])
        first = (1 << 62) + (key[0].as_py() << 32)
        lengths = rest.column("length").to_pylist()
        order, sequence, offset = [], [], []
        for b, items in enumerate(best_fit(lengths, window)):
            at = 0
            for k in items:
                order.append(k)
                sequence.append(first + b)
                offset.append(at)
                at += lengths[k]
        out = rest.take(pa.array(order, pa.int64())).select(NAMES)
        new = {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()), "window": pa.array([window] * len(order), pa.int32()), "step_id": pa.array([first] * len(order), pa.int64())}
        for name, values in new.items():
            out = out.set_column(NAMES.index(name), name, values)
        return out

    return joined


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS, with_ids: bool = True) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (its sequence's length, padding included), step_id and, with_ids, the ids.

    tiers: powers of two, the longest first. A piece is a stretch of a document's ids in a sequence.
    """
    spec = Path(vocabulary or default_vocabulary()).read_text(encoding="utf-8")  # some MB, read where the driver is
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    pieces = materialize(rows.mapInArrow(_packed(spec, library_classes(), tuple(tiers), end_id, step_tokens, with_ids), SCHEMA), "pieces")
    rest = pieces.filter("sequence_id is null").withColumn("tasks", F.floor(F.col("step_id") / JOINED).cast("long"))
    rest = rest.groupBy("tasks").applyInArrow(_joined(tiers[0]), SCHEMA)
    out = pieces.filter("sequence_id is not null").unionByName(rest)
    return out.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_id", *["ids"] * with_ids)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
