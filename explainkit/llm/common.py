"""Shared pieces of the training-data operators."""

from __future__ import annotations

import functools
import gc
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import compress
from typing import ClassVar

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from explainkit.plans.storage import fresh_path, persist_table

#: Rows handled at once inside a task.
SLICE = 256
#: Characters that a worker's memo of hashes may hold before it is emptied.
MEMO_CHARS = 12_000_000

#: The Unicode White_Space characters.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_CUT = re.compile(f"(?= [^{WHITE}])")
_BLANKS = frozenset(WHITE)
#: Stands before a word at a text's start or behind a line break.
LINE = "\x01"
_BARE = frozenset({"", LINE})
#: Bytes that a worker's memo of words may take, what an entry takes beside its characters, and characters of a
#: word that is kept.
WORD_BYTES, ENTRY, KEPT = 200_000_000, 200, 64


#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 4 * 1024 * 1024


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with batches to Python bounded in bytes, so that long texts never meet thousands of others in one batch.

    The bound is a setting of the session; it is lowered for the session unless the user has set it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df


def map_rows(df: DataFrame, columns: list[str], work: Callable[[list[list]], list[list]], schema: str) -> DataFrame:
    """Apply ``work`` to column lists of a few hundred rows at a time; it returns column lists.

    Only ``columns`` reach Python, so other columns of any name or type do no harm.
    """

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = work([part.column(i).to_pylist() for i in range(part.num_columns)])
                if out and len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, target, strict=True)], schema=target)

    return small_batches(df).select(*columns).mapInArrow(run, schema)


def map_batches(df: DataFrame, run: Callable[[Iterator], Iterator], schema: StructType) -> DataFrame:
    """``mapInArrow`` by position, for tables whose columns have any names: ``run`` sees and gives columns in order."""
    inside = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])

    def numbered(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=inside.names)

    plain = small_batches(df).toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(numbered, inside).toDF(*schema.names)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed run of bytes; each array's bytes are laid out by place value, so small numbers cost little."""
    import zstandard

    raw = [len(arrays).to_bytes(4, "little")]
    for x in arrays:
        kind = x.dtype.str.encode()
        raw += [bytes([len(kind)]), kind, len(x).to_bytes(8, "little"), np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unpack(raw: bytes) -> list[np.ndarray]:
    import zstandard

    raw, out, at = zstandard.ZstdDecompressor().decompress(raw), [], 4
    for _ in range(int.from_bytes(raw[:4], "little")):
        size = raw[at]
        kind, n = np.dtype(raw[at + 1 : at + 1 + size].decode()), int.from_bytes(raw[at + 1 + size : at + 9 + size], "little")
        at += 9 + size
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def by_unit(unit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number of ``unit`` with the places of its rows, in order."""
    small = len(unit) and unit.min() >= 0 and unit.max() < 1 << 16
    order = np.argsort(unit.astype(np.uint16) if small else unit, kind="stable")  # two bytes are sorted by radix
    cuts = [0, *(np.flatnonzero(np.diff(unit[order])) + 1).tolist(), len(order)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield int(unit[order[a]]), order[a:b]


def grouped(batches: Iterator, columns: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of sorted batches by their first column."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(columns)), strict=True):
            if held and row[0] != now:
                yield now, held
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield now, held


def write_parts(rows: DataFrame, name: str, partitions: int) -> str:
    """``rows (chunk, part)`` as one file a chunk in the shared folder; the folder. Whoever reads a chunk's table finds its
    file by number, so the table itself needn't be shuffled. A repeated task replaces a file by an equal one."""
    folder = fresh_path(rows.sparkSession, name)

    def run(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for chunk, parts in grouped(batches, 2):
            attempt = f"{base}/.{chunk}-{uuid.uuid4().hex}"
            with store.open_output_stream(attempt, compression=None) as f:
                for (part,) in sorted(parts):
                    f.write(len(part).to_bytes(8, "little") + part)
            store.move(attempt, f"{base}/{chunk}")
            yield pa.RecordBatch.from_pydict({"chunk": [chunk]})

    dealt = rows.select("chunk", "part").repartition(partitions, "chunk").sortWithinPartitions("chunk")
    persist_table(dealt.mapInArrow(run, "chunk long"), f"{name}-written")
    return folder


def read_parts(folder: str, chunk: int) -> list[bytes]:
    """What :func:`write_parts` wrote for a chunk; nothing if there is none."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    path = f"{base}/{chunk}"
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return []
    with store.open_input_file(path) as f:
        raw = f.read()
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text``; extra columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have (Spark compares them without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def crc_mod(doc_id: int | None, n: int) -> int:
    """crc32 of the id's decimal text, modulo n; a null id counts as the text ``null``."""
    return zlib.crc32(b"null" if doc_id is None else str(doc_id).encode()) % n


def ascii_words(text: str | None) -> list[bytes]:
    """Runs outside space and tab to carriage return, as UTF-8 with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Memo(dict):
    """A worker's memo, emptied between slices once its keys pass a bound, or once another operator's memo grows."""

    live: ClassVar[list[Memo]] = []
    busy: ClassVar[Memo | None] = None

    def __init__(self) -> None:
        super().__init__()
        self.chars = 0
        Memo.live.append(self)

    def touch(self) -> None:
        """A worker that turns to another operator lets go of what it kept for the last one."""
        if Memo.busy is not self:
            Memo.rest(self)
            Memo.busy = self

    @staticmethod
    def rest(but: Memo | None = None) -> None:
        """Empties all memos but one; for operators that need their room and keep no memo."""
        for memo in Memo.live:
            if memo is not but:
                memo.clear()
                memo.chars = 0
        Memo.busy = None

    def settle(self, extra: int) -> None:
        self.chars += extra
        if self.chars > MEMO_CHARS:
            self.clear()
            self.chars = 0


def uncollected(f: Callable) -> Callable:
    """``f`` without garbage collection meanwhile: its many short lists hold no cycles."""

    @functools.wraps(f)
    def run(*args):
        on = gc.isenabled()
        gc.disable()
        try:
            return f(*args)
        finally:
            if on:
                gc.enable()

    return run


def marked(text: str) -> str:
    """``text`` with its keys of :class:`Words` between spaces."""
    return f"{LINE}{text}".replace("\n", f" \n {LINE}")


def _shows_run(key: str) -> bool:
    """Whether a key is empty or starts with white space, as a run of white space makes it."""
    return key in _BARE or key[key[0] == LINE] in _BLANKS and key != "\n"


class Words(Memo):
    """A worker's values of words, for byte-level vocabularies whose pattern never joins a word with a space behind it.

    A text is cut before each space that a word follows, and on both sides of a line break between words: the
    pattern cuts there too, so the parts' tokens are the text's tokens. Keys are words without their leading
    space, line breaks, and ``LINE`` with a word that has no space before it. Texts with runs of white space are
    cut by a pattern of their own, into parts kept in ``own``. ``learn`` gives the values of new keys, and of
    new parts of the other kind.
    """

    def __init__(self, learn: Callable[[list[str], list[str]], tuple[list, list]]) -> None:
        super().__init__()
        self.learn, self.own = learn, {}

    def clear(self) -> None:
        super().clear()
        self.own.clear()

    def _keep(self, target: dict, learned: dict) -> None:
        if any(len(k) > KEPT for k in learned):
            learned = {k: v for k, v in learned.items() if len(k) <= KEPT}
        target.update(learned)
        self.chars += 2 * sum(map(len, learned)) + ENTRY * len(learned)

    def _begin(self) -> None:
        self.touch()
        if self.chars > WORD_BYTES:
            self.clear()
            self.chars = 0

    @uncollected
    def of(self, keys: list[str]) -> list:
        """The values of distinct keys; None for keys that show a run of white space."""
        self._begin()
        found = [*map(self.get, keys)]
        gaps = [i for i, v in enumerate(found) if v is None and not _shows_run(keys[i])]
        new = [keys[i] for i in gaps]
        values, _ = self.learn(new, [])
        for i, value in zip(gaps, values, strict=True):
            found[i] = value
        self._keep(self, dict(zip(new, values, strict=True)))
        return found

    @uncollected
    def values(self, texts: list[str]) -> list[list]:
        """The values of each text's parts, in order."""
        self._begin()
        get, plans, missing = self.get, [], set()
        for text in texts:
            keys = marked(text).split(" ") if text and LINE not in text else []
            found = [*map(get, keys)]
            gaps = [*compress(range(len(found)), [v is None for v in found])] if None in found else ()
            new = [keys[i] for i in gaps]
            missing.update(new)
            plans.append((found, gaps, new))
        bad = {k for k in missing if _shows_run(k)}
        odd: dict[int, list[str]] = {}
        for i, (text, plan) in enumerate(zip(texts, plans, strict=True)):
            if text and (bad and not bad.isdisjoint(plan[2]) or LINE in text):
                odd[i] = [k for k in _CUT.split(text) if k]
        words = [*(missing - bad)]
        parts = [*{k for keys in odd.values() for k in keys if k not in self.own}]
        values, own = self.learn(words, parts)
        new, own = dict(zip(words, values, strict=True)), dict(zip(parts, own, strict=True))
        for i, (found, gaps, keys) in enumerate(plans):
            if i not in odd:
                for at, k in zip(gaps, keys, strict=True):
                    found[at] = new[k]
        out = [[own[k] if k in own else self.own[k] for k in odd[i]] if i in odd else plan[0] for i, plan in enumerate(plans)]
        self._keep(self, new)
        self._keep(self.own, own)
        return out


def part_text(key: str) -> str:
    """The part of a text that a key of :class:`Words` stands for."""
    return key[1:] if key[0] == LINE else key if key == "\n" else " " + key
