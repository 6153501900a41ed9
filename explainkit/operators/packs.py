"""Rows of owners as array files: tasks take packs of owners and add up what they have for the shared sides.

A pack holds all rows of its owners, so what belongs to an owner never leaves its pack. The shared sides (items,
statements) are arrays by dense number, held whole by a task; every task writes one partial sum of them and a second job
adds these up. All files are below the shared folder; a repeated task replaces a file by an equal one.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from explainkit.plans.storage import drop_path, fresh_path

#: Rows of a shared side in one file.
RANGE = 65_536


@dataclass
class Store:
    """Arrays by name below one folder."""

    folder: str

    def put(self, name: str, **arrays: np.ndarray) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.folder)
        store.create_dir(base, recursive=True)
        held = io.BytesIO()
        np.savez(held, **arrays)
        attempt = f"{base}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(attempt, compression=None) as f:
            f.write(held.getbuffer())
        store.move(attempt, f"{base}/{name}")

    def get(self, name: str) -> dict[str, np.ndarray] | None:
        """None if nothing was put."""
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.folder)
        if store.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
            return None
        with store.open_input_stream(f"{base}/{name}", compression=None) as f:
            with np.load(io.BytesIO(f.read())) as z:
                return {k: z[k] for k in z.files}

    def put_side(self, name: str, x: np.ndarray) -> None:
        for k in range(max(1, -(-len(x) // RANGE))):
            self.put(f"{name}-{k}", x=x[k * RANGE : (k + 1) * RANGE])

    def side(self, name: str, n: int) -> np.ndarray:
        return np.concatenate([self.get(f"{name}-{k}")["x"] for k in range(max(1, -(-n // RANGE)))])


def new_store(spark: SparkSession, name: str) -> Store:
    return Store(fresh_path(spark, name))


def tasks(spark: SparkSession, n: int, work: Callable[[int], list[float]], values: int = 0) -> np.ndarray:
    """``work(0)`` to ``work(n - 1)`` as tasks; the sums of the few numbers that each returns."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"t": [t], "values": pa.array([[float(x) for x in work(t) or []]], pa.list_(pa.float64()))})

    found = sorted((r["t"], r["values"]) for r in spark.range(0, n, 1, n).mapInArrow(run, "t long, values array<double>").collect())
    return np.sum([v for _, v in found], axis=0) if values else np.zeros(0)


def add_up(spark: SparkSession, packs: int, workers: int, open_work: Callable, into: Store, sides: dict[str, tuple[int, int]], values: int = 0) -> np.ndarray:
    """Run ``open_work()(pack, sums)`` for every pack; ``sums`` has a zero array ``(n, dim)`` for each of ``sides``, whose totals over all
    packs go to ``into``. ``open_work()(None, sums)`` ends a task. Returns the sums of the ``values`` numbers given for each pack."""
    parts = new_store(spark, "parts")

    def work(t: int) -> list[float]:
        each, total = open_work(), np.zeros(values)
        sums = {name: np.zeros(shape) for name, shape in sides.items()}
        for k in range(t, packs, workers):
            got = each(k, sums)
            if got is not None:
                total += got
        each(None, sums)
        for name, x in sums.items():
            parts.put_side(f"{name}-{t}", x)
        return total.tolist()

    total = tasks(spark, workers, work, values)
    ranges = [(name, k) for name, (n, _) in sides.items() for k in range(max(1, -(-n // RANGE)))]

    def add(j: int) -> None:
        name, k = ranges[j]
        x = parts.get(f"{name}-0-{k}")["x"]
        for t in range(1, workers):
            x += parts.get(f"{name}-{t}-{k}")["x"]
        into.put(f"{name}-{k}", x=x)

    if ranges:
        tasks(spark, len(ranges), add)
        drop_path(spark, parts.folder)
    return total


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def segment_sums(x: np.ndarray, starts: np.ndarray, long: int = 64) -> np.ndarray:
    """Sums of the rows from each start to the next; segments of one length are added together, place by place."""
    if not len(starts) or x.ndim == 1:
        return np.add.reduceat(x, starts, axis=0) if len(starts) else np.zeros((0, *x.shape[1:]))
    size, out = np.diff(np.r_[starts, len(x)]), np.empty((len(starts), x.shape[1]))
    by = np.argsort(size, kind="stable")
    cuts = [*runs(size[by]).tolist(), len(by)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        at, n = by[a:b], int(size[by[a]])
        first = starts[at]
        if n >= long:
            for i, f in zip(at.tolist(), first.tolist(), strict=True):
                out[i] = x[f : f + n].sum(0)
            continue
        total = x.take(first, axis=0)
        for j in range(1, n):
            total += x.take(first + j, axis=0)
        out[at] = total
    return out


def scatter(into: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    """``into[at] += x``, with repeated places added."""
    order = np.argsort(at.astype(np.uint16) if len(into) <= 1 << 16 else at, kind="stable")  # two bytes are sorted by radix
    starts = runs(at[order])
    into[at[order][starts]] += segment_sums(x.take(order, axis=0), starts)


def draws(size: int, ids: np.ndarray, *salt) -> np.ndarray:
    """Seeded places below ``size``; by id, so the same on any dealing."""
    x = ids.astype(np.int64).view(np.uint64)
    for s in salt:
        x = x * np.uint64(0x9E3779B97F4A7C15) + np.asarray(s).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x % np.uint64(max(1, size))).astype(np.int64)


def pack_of(column: str, packs: int):
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(packs)).cast("int")


def write_packs(rows: DataFrame, store: Store, name: str, packs: int, order: list[str]) -> None:
    """``rows (pack, longs ..., one array column or none)`` as a file a pack, in ``order``; an array column ``x`` is flat beside ``x_size``."""
    spark, columns = rows.sparkSession, rows.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def close(k: int, held: list) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            out = {}
            for c in columns[1:]:
                x = table.column(c).combine_chunks()
                x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
                if pa.types.is_list(x.type):
                    out[f"{c}_size"] = np.diff(x.offsets.to_numpy()).astype(np.int32)
                    x = x.flatten()
                out[c] = x.to_numpy(zero_copy_only=False)
            store.put(f"{name}-{k}", **out)

        now, held = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = runs(keys).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if keys[a] != now and held:
                    close(now, held)
                    held = []
                now = int(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            close(now, held)
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int64())})

    dealt = rows.repartition(min(packs, 4 * spark.sparkContext.defaultParallelism), "pack").sortWithinPartitions("pack", *order)
    dealt.mapInArrow(run, "done long").collect()


def write_side(rows: DataFrame, store: Store, name: str, column: str = "id") -> int:
    """A shared side's ``rows (id, ...)`` by ascending id: its ids, or its vectors ``v``; their number."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if column == "id":
            x = np.concatenate([b.column(0).to_numpy() for b in held]) if held else np.zeros(0, np.int64)
        else:
            x = np.concatenate([b.column(1).flatten().to_numpy().reshape(b.num_rows, -1) for b in held]) if held else np.zeros((0, 1))
        store.put_side(name, x)
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(x)], pa.int64())})

    return rows.repartition(1).sortWithinPartitions("id").mapInArrow(run, "n long").first()["n"]


def vectors(spark: SparkSession, n: int, rows: Callable[[int], tuple[np.ndarray, np.ndarray] | None]) -> DataFrame:
    """``(id, v)`` of files: ``rows(k)`` gives the ids and vectors of file ``k`` of ``n``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in batch.column(0).to_pylist():
                got = rows(k)
                for a in range(0, len(got[0]) if got else 0, 8_192):
                    ids, x = got[0][a : a + 8_192], np.ascontiguousarray(got[1][a : a + 8_192])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], names=["id", "v"])

    return spark.range(0, n, 1, n).mapInArrow(run, "id long, v array<double>")


def ranks_of(owners: np.ndarray, truths: np.ndarray, things: np.ndarray, k: int, block: int = 128, cells: int = 1 << 22) -> np.ndarray:
    """The rank, from one, of the thing at ``truths[i]`` for the vector ``owners[i]`` among all ``things``, by product and then place, where it is
    ``k`` or better; else some number above ``k``. An owner with ``k`` better things isn't looked at further, so most see one block."""
    n, out = len(truths), np.zeros(len(truths), np.int64)
    own = np.empty(n)
    for a in range(0, n, 65_536):
        own[a : a + 65_536] = np.round(np.einsum("ij,ij->i", owners[a : a + 65_536], things[truths[a : a + 65_536]]), 9)
    order = np.argsort(-np.einsum("ij,ij->i", things, things), kind="stable")  # long vectors take the first ranks
    left, at = np.arange(n), 0
    while len(left) and at < len(things):
        some = order[at : at + block]
        for a in range(0, len(left), max(1, cells // len(some))):
            rows = left[a : a + max(1, cells // len(some))]
            scores = np.round(owners[rows] @ things[some].T, 9)
            mine = own[rows, None]
            own_place = truths[rows, None]
            out[rows] += (((scores > mine) & (some != own_place)) | ((scores == mine) & (some < own_place))).sum(1)
        left, at, block = left[out[left] < k], at + block, block * 4
    return out + 1
