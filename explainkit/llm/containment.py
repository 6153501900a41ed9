"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles in powers of two. A partition of up to ``u`` shingles
cuts every document into windows of ``2u`` shingles, each ``u`` after the one before, so that an item's
passage lies whole in a window of comparable size and its Jaccard similarity to that window stays high
however long the document is. Windows and items share 64 MinHash functions; block minima are taken once
and serve all partitions. An item that agrees with a window on any function is a candidate, and
candidates are verified by exact containment of the item's shingles in the whole document.

The items are a stated query set. Their index is built once, by tasks, as files of about ``BLOCK_SHINGLES``
shingles in the shared folder; a worker holds ``HELD`` of them at a time, so what it holds is bounded
whatever their number. Documents are read and hashed once, and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from explainkit.llm.common import SLICE, map_batches, pack, small_batches, unpack
from explainkit.llm.shingles import shingle_hashes, word_hashes
from explainkit.plans.storage import fresh_path, persist_table

FUNCTIONS, THRESHOLD = 64, 0.8
#: Shingles of one block of items, about; a block of 8-byte hashes and signatures stays below 60 MB. Blocks that a
#: worker keeps open.
BLOCK_SHINGLES, HELD = 2_000_000, 4
_RNG = np.random.default_rng(97)
_FACTORS = _RNG.integers(1, 2**32, FUNCTIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFTS = _RNG.integers(0, 2**32, FUNCTIONS, dtype=np.uint64).astype(np.uint32)


def _folded(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint32)


def _mixed(h32: np.ndarray, j: int) -> np.ndarray:
    v = h32 * _FACTORS[j] + _SHIFTS[j]
    return (v ^ (v >> np.uint32(15))) * np.uint32(0x2C1B3C6D)


def index_arrays(items: list[tuple]) -> list[np.ndarray]:
    """A block of items as arrays: ids, numbers of shingles, the shingles one after another, and the MinHash values."""
    ids, sets = [], []
    for item_id, text in items:
        found = np.unique(shingle_hashes(word_hashes(text)))
        if len(found):
            ids.append(item_id)
            sets.append(found)
    mins = np.array([[_mixed(_folded(s), j).min() for j in range(FUNCTIONS)] for s in sets], dtype=np.uint32)
    return [np.array(ids, np.int64), np.array([len(s) for s in sets], np.int64), np.concatenate(sets) if sets else np.zeros(0, np.uint64), mins.reshape(-1)]


class ItemIndex:
    """Signatures and exact shingles of a block of items."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        ids, sizes, flat, mins = arrays
        self.ids, mins = ids.tolist(), mins.reshape(-1, FUNCTIONS)
        self.sets = np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []
        self.level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        self.levels = sorted({*self.level.tolist()})
        self.tables = {}
        for level in self.levels:
            at = np.flatnonzero(self.level == level)
            order = [np.argsort(mins[at, j], kind="stable") for j in range(FUNCTIONS)]
            self.tables[level] = [(mins[at, j][o], at[o]) for j, o in enumerate(order)]

    def candidates(self, hashes: list[np.ndarray]) -> list[set[int]]:
        """For each document the items that share a MinHash with one of its windows."""
        out: list[set[int]] = [set() for _ in hashes]
        if not self.levels:
            return out
        base = self.levels[0]
        # every document's last block is filled with its own last hash, so blocks never mix documents
        step = 1 << base
        blocks = [-(-len(h) // step) for h in hashes]
        if not sum(blocks):
            return out
        flat = np.concatenate([np.r_[h, np.repeat(h[-1:], b * step - len(h))] for h, b in zip(hashes, blocks, strict=True) if b])
        h32 = _folded(flat)
        owner = np.repeat(np.arange(len(hashes)), blocks)
        for j in range(FUNCTIONS):
            mins, own = _mixed(h32, j).reshape(-1, step).min(axis=1), owner
            for level in range(base, self.levels[-1] + 1):
                if level in self.tables:
                    # windows are this block and the next of the same document
                    pair = np.minimum(mins, np.r_[np.where(own[1:] == own[:-1], mins[1:], mins[:-1]), mins[-1:]])
                    keys, at = self.tables[level][j]
                    lo = np.searchsorted(keys, pair)
                    hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == pair)
                    for w in hit:
                        place, doc = lo[w], out[own[w]]
                        while place < len(keys) and keys[place] == pair[w]:
                            doc.add(int(at[place]))
                            place += 1
                if level < self.levels[-1]:
                    # next level: blocks of twice the size, counted from each document's start
                    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    place = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
                    head = np.flatnonzero(place % 2 == 0)
                    mins, own = np.minimum.reduceat(mins, head), own[head]
        return out

    def verified(self, hashes: np.ndarray, found: set[int]) -> list[tuple]:
        """Items contained in the document: ``(item_id, shared, size)``."""
        if not found:
            return []
        own = np.unique(hashes)
        out = []
        for i in sorted(found):
            mine = self.sets[i]
            at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            shared = int((own[at] == mine).sum())
            if shared >= THRESHOLD * len(mine) - 1e-9:
                out.append((self.ids[i], shared, len(mine)))
        return out


def write_index(benchmark: DataFrame) -> list[str]:
    """The items' index as files of about ``BLOCK_SHINGLES`` shingles; their names (one a block)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").distinct()
    folder = fresh_path(benchmark.sparkSession, "items")
    load = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) / 4 + 1)).first()[0] or 0
    blocks = max(1, int(-(-load // BLOCK_SHINGLES)))

    def run(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        rows = [row for batch in batches for row in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(0).to_pylist(), strict=True)]
        for block in sorted({r[2] for r in rows}):
            arrays = index_arrays([r[:2] for r in rows if r[2] == block])
            if len(arrays[0]):
                name = uuid.uuid4().hex  # a repeated attempt writes a file of its own; the manifest names the one that counts
                store.create_dir(base, recursive=True)
                with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                    f.write(pack(*arrays))
                yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"]})

    dealt = items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"), "item_id", "text").repartition(blocks, "block")
    return sorted(r["file"] for r in persist_table(small_batches(dealt).mapInArrow(run, "file string"), "index").collect())


_open: dict[str, ItemIndex] = {}


def open_index(file: str) -> ItemIndex:
    """A block, kept by the worker while it is in use."""
    if file not in _open:
        from pyarrow import fs

        while len(_open) >= HELD:
            del _open[next(iter(_open))]
        store, name = fs.FileSystem.from_uri(file)
        with store.open_input_file(name) as f:
            _open[file] = ItemIndex(unpack(f.read()))
    return _open[file]


def _search(docs: DataFrame, files: list[str], keep_clean: bool) -> DataFrame:
    """Matches of all blocks, or the rows of ``docs`` without a match."""
    text_at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            hashes = [shingle_hashes(word_hashes(t)) for t in batch.column(text_at).to_pylist()]
            found: list[list[tuple]] = [[] for _ in hashes]
            for file in files:
                index = open_index(file)
                for start in range(0, len(hashes), SLICE):
                    part = hashes[start : start + SLICE]
                    for n, (h, c) in enumerate(zip(part, index.candidates(part), strict=True), start):
                        found[n] += index.verified(h, c)
            if keep_clean:
                yield batch.filter(pa.array([not f for f in found]))
            else:
                rows = [(d, *m) for d, ms in zip(batch.column(0).to_pylist(), found, strict=True) for m in ms]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "n_shared", "n_item"])

    return map_batches(docs, run, docs.schema if keep_clean else StructType.fromDDL("doc_id long, item_id long, n_shared long, n_item long"))


def contained_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item, containment)`` of each item that a document holds to 0.8 or more.

    Containment is shared over item shingles, as sets of five-word shingles of the whole texts (fewer
    words: the whole sequence, which then only equals an as short text); exactly 0.8 counts. Null or
    wordless texts hold nothing and are held by nothing; very long texts are searched whole; null item ids
    are skipped, null document ids kept; a repeated row gives its matches again; equal items are reported
    each; extra columns don't matter; empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _search(rows, write_index(benchmark), False).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    Odd rows count as in :func:`contained_items`: null, empty and wordless texts stay, repeated rows and null ids
    are judged one by one. Columns of any name pass through; empty tables give no rows, or all.
    """
    return _search(docs, write_index(benchmark), True)
