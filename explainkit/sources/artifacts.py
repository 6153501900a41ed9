"""Array files, prompts, settings and model parts: read into long tables, written from them.

Array files are read by row ranges: a task opens a file through the cluster's file system and takes its own rows, so
no array is loaded whole. Shapes are checked before anything is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from explainkit.plans.storage import qualified

#: File names and row widths of sampled evaluation artefacts (raw little-endian 32-bit integers in the first).
POOL_FILE, OFFSETS_FILE, NEGATIVES_FILE = "stmt_ids.int32.mmap", "offsets_main.int32.npy", "offsets_neg.int32.npy"
OFFSETS, NEGATIVES = 5, 4
PAD = -1


def _open(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def exists(spark: SparkSession, path: str) -> bool:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(qualified(spark, path))
    return store.get_file_info(name).type != fs.FileType.NotFound


def npy_header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and data offset of an array file."""
    with _open(path) as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, kind = read(f)
        if by_column and len(shape) > 1:
            raise ValueError(f"{path}: rows must be contiguous")
        return shape, kind, f.tell()


def read_rows(spark: SparkSession, path: str, shape: tuple[int, int], kind: str, offset: int = 0, rows: int = 65_536) -> DataFrame:
    """``(row, values array<double>)`` of a raw row-major array, a range of rows a task."""
    path, (n, width) = qualified(spark, path), shape
    size = np.dtype(kind).itemsize * width

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for start in pdf["start"]:
                with _open(path) as f:
                    f.seek(offset + int(start) * size)
                    table = np.frombuffer(f.read(size * min(rows, n - int(start))), dtype=kind).reshape(-1, width)
                yield pd.DataFrame({"row": np.arange(start, start + len(table)), "values": list(table.astype(np.float64))})

    starts = spark.range(0, max(n, 0), rows, max(1, -(-n // rows))).select(F.col("id").alias("start"))
    return starts.mapInPandas(run, "row long, values array<double>")


def read_npy(spark: SparkSession, path: str, columns: int | None = None) -> DataFrame:
    """``(row, values)`` of a two-dimensional array file; an error for other shapes."""
    shape, kind, offset = npy_header(qualified(spark, path))
    if len(shape) != 2 or (columns is not None and shape[1] != columns):
        raise ValueError(f"{path} has shape {shape}, expected (rows, {columns or 'columns'})")
    return read_rows(spark, path, shape, kind.str, offset)


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """``(src, rank, dst, sim)`` of an archive with arrays ``indices`` and ``sims`` of one shape; padding is left out."""
    path = qualified(spark, path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for content in pdf["content"]:
                import io

                with np.load(io.BytesIO(content)) as found:
                    dst, sim = found["indices"], found["sims"]
                if dst.shape != sim.shape or dst.ndim != 2:
                    raise ValueError("indices and sims must be of one two-dimensional shape")
                for at in range(0, len(dst), 16_384):
                    d, s = dst[at : at + 16_384], sim[at : at + 16_384]
                    out = pd.DataFrame({"src": np.repeat(np.arange(at, at + len(d)), d.shape[1]), "rank": np.tile(np.arange(1, d.shape[1] + 1), len(d)), "dst": d.ravel(), "sim": s.ravel().astype(float)})
                    yield out[out["dst"] >= 0]

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "src long, rank int, dst long, sim double")


def write_neighbours(neighbours: DataFrame, path: str, rows: int, k: int) -> None:
    """The archive that :func:`read_neighbours` reads: ``rows`` times ``k`` cells, both stated by the caller, so its size is known."""
    dst, sim = np.full((rows, k), PAD, np.int64), np.full((rows, k), -np.inf)
    for r in neighbours.where(F.col("rank") <= k).select("src", "rank", "dst", "sim").toLocalIterator():
        dst[r["src"], r["rank"] - 1], sim[r["src"], r["rank"] - 1] = r["dst"], r["sim"]
    with _create(path) as f:
        np.savez(f, indices=dst, sims=sim)


def _create(path: str):
    import io

    from pyarrow import fs

    class Buffer(io.BytesIO):
        def __exit__(self, *args):
            if args[0] is None:
                store, name = fs.FileSystem.from_uri(path)
                store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(name, compression=None) as out:
                    out.write(self.getvalue())
            return super().__exit__(*args)

    return Buffer()


def read_artifacts(spark: SparkSession, folder: str, interactions: int, width: int) -> DataFrame:
    """``(interaction_id, pool array<long>, offsets array<int>, negatives array<int>)`` of a folder of sampled candidates.

    Shapes must be (interactions, width), (interactions, 5) and, if the file is there, (interactions, 4); ``negatives`` is
    null without it. Padding stays in ``pool``; see :func:`pool_rows`.
    """
    for name in (POOL_FILE, OFFSETS_FILE):
        if not exists(spark, f"{folder}/{name}"):
            raise FileNotFoundError(f"{folder}/{name}")
    held = _size(spark, f"{folder}/{POOL_FILE}")
    if held != 4 * interactions * width:
        raise ValueError(f"{POOL_FILE} holds {held} bytes, expected {4 * interactions * width}")
    if npy_header(qualified(spark, f"{folder}/{OFFSETS_FILE}"))[0] != (interactions, OFFSETS):
        raise ValueError(f"{OFFSETS_FILE} must be of shape {(interactions, OFFSETS)}")
    offset = lambda name: npy_header(qualified(spark, f"{folder}/{name}"))[2]
    files = [("pool", f"{folder}/{POOL_FILE}", width, 0), ("offsets", f"{folder}/{OFFSETS_FILE}", OFFSETS, offset(OFFSETS_FILE))]
    if exists(spark, f"{folder}/{NEGATIVES_FILE}"):
        if npy_header(qualified(spark, f"{folder}/{NEGATIVES_FILE}"))[0] != (interactions, NEGATIVES):
            raise ValueError(f"{NEGATIVES_FILE} must be of shape {(interactions, NEGATIVES)}")
        files.append(("negatives", f"{folder}/{NEGATIVES_FILE}", NEGATIVES, offset(NEGATIVES_FILE)))
    out = _read_together(spark, [(name, qualified(spark, path), size, at) for name, path, size, at in files], interactions)
    return out if len(files) == 3 else out.withColumn("negatives", F.lit(None).cast("array<int>"))


def _read_together(spark: SparkSession, files: list[tuple[str, str, int, int]], n: int, rows: int = 65_536, batch: int = 8_192) -> DataFrame:
    """``(interaction_id, a list a file)``: a task reads the same range of rows of all ``files (name, path, width, offset)`` of
    32-bit integers, so that they need no join (which Spark would take for a small one and send through the driver)."""

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            for start in part.column(0).to_pylist():
                end = min(start + rows, n)
                opened = [_open(path) for _, path, _, _ in files]
                for f, (_, _, width, offset) in zip(opened, files, strict=True):
                    f.seek(offset + 4 * width * start)
                for at in range(start, end, batch):
                    held = min(batch, end - at)
                    columns = [pa.array(np.arange(at, at + held))]
                    for f, (name, _, width, _) in zip(opened, files, strict=True):
                        flat = np.frombuffer(f.read(4 * width * held), "<i4").astype(np.int64 if name == "pool" else np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(held + 1, dtype=np.int32) * width), pa.array(flat)))
                    yield pa.RecordBatch.from_arrays(columns, ["interaction_id", *(f[0] for f in files)])
                for f in opened:
                    f.close()

    schema = ", ".join(f"{name} array<{'long' if name == 'pool' else 'int'}>" for name, _, _, _ in files)
    return spark.range(0, max(n, 0), rows, max(1, -(-n // rows))).mapInArrow(run, f"interaction_id long, {schema}")


def _size(spark: SparkSession, path: str) -> int:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(qualified(spark, path))
    return store.get_file_info(name).size


def write_artifacts(rows: DataFrame, folder: str, interactions: int, width: int, block: int = 65_536) -> None:
    """``rows (interaction_id, pool, offsets, negatives)`` as the files of :func:`read_artifacts`; ids are 0 to ``interactions`` - 1.

    The format is single files of a stated size. Tasks write ``block`` rows each into files beside them, and these are
    appended in order: the driver sees a row a block and copies bytes, whatever the number of interactions.
    """
    where = qualified(rows.sparkSession, folder)
    files = ((POOL_FILE, "pool", width), (OFFSETS_FILE, "offsets", OFFSETS), (NEGATIVES_FILE, "negatives", NEGATIVES))
    store, base = _open_store(where)
    store.create_dir(f"{base}/parts", recursive=True)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        attempt, store, base = TaskContext.get().taskAttemptId(), *_open_store(f"{where}/parts")
        at, seen, outs = None, 0, []

        def told(error: str | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": [at], "attempt": [attempt], "rows": [seen], "error": pa.array([error], pa.string())})

        try:
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for first, last in _runs(ids // block):
                    if ids[first] // block != at:
                        if at is not None:
                            yield told()
                        for f in outs:
                            f.close()
                        at, seen = int(ids[first]) // block, 0
                        outs = [store.open_output_stream(f"{base}/{name}-{at}-{attempt}", compression=None) for name, _, _ in files]
                    part = batch.slice(first, last - first)
                    if not np.array_equal(ids[first:last], at * block + seen + np.arange(last - first)):
                        yield told("ids must be dense")
                        return
                    for n, ((_, name, size), f) in enumerate(zip(files, outs, strict=True), 1):
                        table = _padded(part.column(n), size, empty=name == "negatives", short=name == "pool")
                        if table is None:
                            yield told(f"{name} must be whole numbers of 32 bits, {size} {'at most' if name == 'pool' else 'each'}")
                            return
                        f.write(table.tobytes())
                    seen += last - first
        finally:
            for f in outs:
                f.close()
        if at is not None:
            yield told()

    dealt = rows.select("interaction_id", *[F.col(name).cast("array<long>").alias(name) for _, name, _ in files])
    dealt = dealt.repartition(max(1, -(-interactions // block)), F.floor(F.col("interaction_id") / block)).sortWithinPartitions("interaction_id")
    found = sorted((r["block"], r["attempt"], r["rows"], r["error"]) for r in dealt.mapInArrow(run, "block long, attempt long, rows long, error string").collect())
    for _, _, _, error in found:
        if error:
            raise ValueError(error)
    sizes = [min(block, interactions - at) for at in range(0, interactions, block)]
    if [r[0] for r in found] != list(range(len(sizes))) or [r[2] for r in found] != sizes:
        raise ValueError(f"{sum(r[2] for r in found)} rows, expected {interactions}; ids must be dense")
    for name, _, size in files:
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            if name != POOL_FILE:
                np.lib.format.write_array_header_1_0(out, {"descr": "<i4", "fortran_order": False, "shape": (interactions, size)})
            for at, attempt, _, _ in found:
                part = f"{base}/parts/{name}-{at}-{attempt}"
                with store.open_input_stream(part, compression=None) as f:
                    while content := f.read(1 << 20):
                        out.write(content)
                store.delete_file(part)
    store.delete_dir(f"{base}/parts")


def _open_store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Ends of the runs of equal keys."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1 if len(keys) else np.zeros(0, int)
    ends = [0, *cuts.tolist(), len(keys)]
    return [(a, b) for a, b in zip(ends, ends[1:], strict=False) if a < b]


def _padded(lists, width: int, empty: bool, short: bool) -> np.ndarray | None:
    """A table of 32-bit integers from lists of ``width`` numbers: fewer are padded if ``short`` is allowed, no list is zeros
    if ``empty`` is; nothing for any other content."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    none = sizes == 0 if empty else np.zeros(len(sizes), bool)
    if flat.null_count or (lists.null_count and not empty) or (sizes > width).any() or (not short and (sizes[~none] != width).any()):
        return None
    values = flat.to_numpy(zero_copy_only=False)
    if len(values) and (values.min() < -(2**31) or values.max() >= 2**31):
        return None
    table = np.full((len(sizes), width), PAD, "<i4")
    table[none] = 0
    table[np.arange(width) < sizes[:, None]] = values
    return table


def slice_rows(artifacts: DataFrame, wanted: DataFrame, key: str = "interaction_id") -> DataFrame:
    """The artefacts of ``wanted`` interactions."""
    # rows read from files look few to Spark, which would broadcast them
    return artifacts.join(wanted.select(key).hint("merge"), key, "left_semi")


def pool_rows(artifacts: DataFrame) -> DataFrame:
    """``(interaction_id, pos, sid)`` without padding: the long form needs no masks."""
    return artifacts.select("interaction_id", F.posexplode("pool").alias("pos", "sid")).where(F.col("sid") >= 0)


def read_splits(spark: SparkSession, folder: str, parts: tuple[str, ...] = ("train", "eval", "test")) -> DataFrame:
    """``(interaction_id, split)`` of one-column index files named after the parts."""
    out = None
    for part in parts:
        df = spark.read.option("header", "true").csv(f"{folder}/{part}.csv")
        df = df.select(F.col(f"`{df.columns[-1]}`").cast("long").alias("interaction_id"), F.lit(part).alias("split"))
        out = df if out is None else out.unionByName(df)
    return out


def write_splits(splits: DataFrame, folder: str) -> None:
    """The folders that :func:`read_splits` reads."""
    for (part,) in splits.select("split").distinct().collect():  # three names
        splits.where(F.col("split") == part).select("interaction_id").write.mode("overwrite").option("header", "true").csv(f"{folder}/{part}.csv")


def join_rows(table: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """``table`` with the vector of its row number ``key``; an error if the two differ in number."""
    have, want = vectors.count(), table.count()
    if have != want:
        raise ValueError(f"{have} vectors for {want} rows")
    return table.join(vectors.select(F.col("row").alias(key), F.col("values").alias("embedding")), key)


def read_prompt(spark: SparkSession, path: str) -> str:
    """A prompt file's whole text."""
    return spark.read.text(path, wholetext=True).first()["value"]


def merge_settings(*layers: dict) -> dict:
    """Later layers win; nested settings are merged, a ``None`` takes a setting away."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            if value is None:
                out.pop(key, None)
            elif isinstance(value, dict) and isinstance(out.get(key), dict):
                out[key] = merge_settings(out[key], value)
            else:
                out[key] = value
    return out


def read_settings(spark: SparkSession, path: str) -> dict:
    """A settings file: JSON, or plain ``key: value`` lines nested by indentation, with lists in brackets."""
    text = read_prompt(spark, path)
    if text.lstrip().startswith("{"):
        return json.loads(text)
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth, (key, _, value) = len(body) - len(body.lstrip()), body.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            stack[-1][1][key.strip()] = _literal(value.strip())
        else:
            stack[-1][1][key.strip()] = {}
            stack.append((depth, stack[-1][1][key.strip()]))
    return root


def _literal(text: str):
    if text.startswith("[") and text.endswith("]"):
        return [_literal(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    if text.lower() in {"true", "false"}:
        return text.lower() == "true"
    if text.lower() in {"null", "none", "~"}:
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text.strip("'\"")


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """``df`` as Parquet, JSON lines, CSV or TSV with a header; lists become bracketed literals in the last two."""
    if form in {"parquet", "json"}:
        getattr(df.write.mode("overwrite"), form)(path)
        return
    flat = [F.concat(F.lit("["), F.array_join(F.col(n).cast("array<string>"), ", "), F.lit("]")).alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").options(header="true", sep="\t" if form == "tsv" else ",", quote='"', escape='"').csv(path)


def write_summary(row: DataFrame, path: str) -> None:
    """A one-row table as one JSON line."""
    row.limit(2).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_npy(vectors: DataFrame, path: str, rows: int, width: int, block: int = 65_536) -> None:
    """``vectors (row, values)`` as one array file of a stated shape, streamed in order."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(qualified(vectors.sparkSession, path))
    store.create_dir(base.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(base, compression=None) as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (rows, width)})
        held = []
        for r in vectors.orderBy("row").toLocalIterator():
            held.append(r["values"])
            if len(held) >= block:
                f.write(np.array(held, "<f4").tobytes())
                held = []
        if held:
            f.write(np.array(held, "<f4").tobytes())
