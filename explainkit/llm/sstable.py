"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order. Layout::

    "EKST0001"
    data blocks    zstd(entries, restart offsets, their number) + crc32 of the compressed bytes
    index block    zstd(last key, offset, length, documents, ids of every data block)
    Bloom block    bits of all keys
    footer         offsets and lengths of index and Bloom block, documents, ids, id width, "EKST0001"

An entry is (shared prefix length, suffix length, value length, suffix, value): keys are compressed
against the key before, anew at every restart. Values are little-endian ids of 2 or 4 bytes. A lookup
asks the Bloom filter, searches the block index, then the restarts, then a few entries.
"""

from __future__ import annotations

import bisect
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from explainkit.llm.common import LINE, Words, id_and_text, marked, small_batches
from explainkit.operators.dictionary import running_totals
from explainkit.plans.storage import fresh_path, persist_table, qualified

MAGIC = b"EKST0001"
_FOOTER = struct.Struct("<QQQQQQB8s")
_INDEX = struct.Struct("<QQQQ")
#: Raw bytes after which a data block is closed, entries between restarts, Bloom bits and probes a key.
BLOCK, RESTART, BITS, PROBES = 256 * 1024, 16, 10, 7
#: Text bytes that a shard is meant to hold: the least, the most, and the shards from which on they grow.
SHARD_BYTES, LARGEST, SHARDS = 24 * 1024 * 1024, 512 * 1024 * 1024, 4096
#: Words encoded in one text; marks that stand behind words, and how many of them are known together.
TOGETHER, MARKS, MOST_MARKS = 4096, ".,;:!?#*$%&|<>", 4


def key_of(doc_id: int | None) -> bytes:
    """Big-endian with the sign flipped, so keys order like ids; null comes first."""
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + 2**63) % 2**64)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest(key, 7)
    step = h >> 32 | 1
    return [(h + i * step) % bits for i in range(PROBES)]


class ShardWriter:
    """Writes entries in ascending key order to a binary file; equal keys are allowed."""

    def __init__(self, sink, width: int) -> None:
        import zstandard

        self.sink, self.width, self.at = sink, width, 0
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.docs = self.ids = 0
        self.last: bytes | None = None
        self._open()
        self._put(MAGIC)

    def _open(self) -> None:
        self.buf, self.restarts, self.block_docs, self.block_ids, self.prefix = bytearray(), [], 0, 0, b""

    def _put(self, raw: bytes) -> tuple[int, int]:
        self.sink.write(raw)
        at, self.at = self.at, self.at + len(raw)
        return at, len(raw)

    def add(self, key: bytes, value: bytes) -> None:
        if self.last is not None and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block_docs % RESTART == 0:
            self.restarts.append(len(self.buf))
        else:
            most = min(len(key), len(self.prefix))
            while shared < most and key[shared] == self.prefix[shared]:
                shared += 1
        self.buf += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.prefix = self.last = key
        self.keys.append(key)
        self.block_docs += 1
        self.block_ids += len(value) // self.width
        if len(self.buf) >= BLOCK:
            self._close_block()

    def _close_block(self) -> None:
        if not self.block_docs:
            return
        self.buf += struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        raw = self.pack(bytes(self.buf))
        at, size = self._put(raw + struct.pack("<I", zlib.crc32(raw)))
        self.index.append(_varint(len(self.last)) + self.last + _INDEX.pack(at, size, self.block_docs, self.block_ids))
        self.docs, self.ids = self.docs + self.block_docs, self.ids + self.block_ids
        self._open()

    def close(self) -> None:
        self._close_block()
        index = self._put(self.pack(b"".join(self.index)))
        bits = max(64, BITS * len(self.keys))
        filled = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                filled[p >> 3] |= 1 << (p & 7)
        bloom = self._put(struct.pack("<Q", bits) + bytes(filled))
        self._put(_FOOTER.pack(*index, *bloom, self.docs, self.ids, self.width, MAGIC))


class ShardReader:
    """Reads a shard from a seekable binary file."""

    def __init__(self, source) -> None:
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        size = source.seek(0, io.SEEK_END)
        size = source.tell() if size is None else size
        index_at, index_len, bloom_at, bloom_len, self.docs, self.ids, self.width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a shard")
        raw, at = self.unpack(self._read(index_at, index_len)) if index_len else b"", 0
        self.last_keys, self.blocks = [], []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.last_keys.append(raw[at : at + n])
            self.blocks.append(_INDEX.unpack_from(raw, at + n))
            at += n + _INDEX.size
        self._bloom = (bloom_at, bloom_len)
        self._bits: bytes | None = None

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _block(self, i: int) -> bytes:
        at, size, _, _ = self.blocks[i]
        raw = self._read(at, size)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("damaged block")
        return self.unpack(raw[:-4])

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            more, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + more]
            yield key, raw[at + more : at + more + size]
            at += more + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            raw = self._block(i)
            n = struct.unpack("<I", raw[-4:])[0]
            yield from self._entries(raw, 0, len(raw) - 4 - 4 * n)

    def may_hold(self, key: bytes) -> bool:
        if self._bits is None:
            self._bits = self._read(*self._bloom)
        bits = struct.unpack("<Q", self._bits[:8])[0]
        return all(self._bits[8 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, bits))

    def get(self, key: bytes) -> np.ndarray | None:
        """Ids of the first document with the key."""
        if not self.may_hold(key):
            return None
        i = bisect.bisect_left(self.last_keys, key)
        if i == len(self.blocks):
            return None
        raw = self._block(i)
        n = struct.unpack("<I", raw[-4:])[0]
        end = len(raw) - 4 - 4 * n
        restarts = struct.unpack(f"<{n}I", raw[end:-4])
        first = [next(self._entries(raw, r, end))[0] for r in restarts]
        start = restarts[max(0, bisect.bisect_left(first, key) - 1)]
        for found, value in self._entries(raw, start, end):
            if found == key:
                return np.frombuffer(value, dtype=f"<u{self.width}")
            if found > key:
                return None
        return None


class _Encoder:
    """The library's ids, kept by word."""

    def __init__(self, path: str, end_id: int) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        added = self.model.get_added_tokens_decoder()
        self.special = sorted((t.content for t in added.values()), key=len, reverse=True)
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("only plain special tokens are supported")
        self.width = 2 if max(self.model.get_vocab_size(), end_id + 1) <= 65536 else 4
        self.kind = f"<u{self.width}"
        self.end = self._bytes([end_id])
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # ids whose text starts with a space (its stand-in in byte-level vocabularies)
        self.leads = np.zeros(1 << (8 * self.width if self.width == 2 else 24), dtype=bool)
        self.leads[[i for t, i in self.model.get_vocab(False).items() if t.startswith("Ġ")]] = True
        self.marks = {s: self._bytes([self.model.token_to_id(s)]) for s in self.special}
        self.points: dict[str, bytes] = {}
        self.breaks = self.model.encode("\n", add_special_tokens=False).ids
        self.words = Words(self._learn)

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.kind).tobytes()

    def _several(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _together(self, words: list[str], spaced: bool) -> list[bytes]:
        """Ids of words, many of them in one text: a token that starts with a space can only begin a spaced word,
        and a line break stands alone between two others."""
        out: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            text = " " + " ".join(some) if spaced else "\n" + "\n".join(some)
            if text.split() != some or len(self.breaks) != 1:  # white space inside words
                out += self._several([" " + w for w in some] if spaced else some)
                continue
            found = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)
            starts = np.flatnonzero(self.leads[found] if spaced else found == self.breaks[0])
            if len(starts) != len(some):
                raise ValueError("the vocabulary joins a space or a line break to what stands before it")
            raw, cuts = found.tobytes(), (starts * self.width).tolist()
            cuts.append(len(raw))
            skip = 0 if spaced else self.width
            out += [raw[a + skip : b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _learn(self, keys: list[str], parts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of keys and parts of :class:`Words`. Marks behind a letter are cut from it, so a word with marks
        needs the ids of its stem only, and words of one stem need them once."""
        known, points = self.words.get, self.points
        out: list = [b""] * len(keys)
        asked: tuple[dict, dict] = {}, {}
        plain, ended = [], []
        for i, key in enumerate(keys):
            if key[-1] in MARKS:
                stem = key.rstrip(MARKS)
                if len(key) - len(stem) <= MOST_MARKS and stem[-1:].isalpha() and stem[-1] < "\u0250":
                    marks = key[len(stem) :]
                    mark = points.get(marks)
                    if mark is None:
                        mark = points[marks] = self._bytes(self.model.encode(marks, add_special_tokens=False).ids)
                    have = known(stem)
                    if have is not None:
                        out[i] = have + mark
                        continue
                    asked[stem[0] != LINE][stem] = None
                    ended.append((i, stem, mark))
                    continue
            asked[key[0] != LINE and key != "\n"][key] = None
            plain.append(i)
        found: dict[str, bytes] = {}
        for spaced, some in enumerate(asked):
            words = [*some]
            found.update(zip(words, self._together(words if spaced else [w.removeprefix(LINE) for w in words], bool(spaced)), strict=True))
        for i in plain:
            out[i] = found[keys[i]]
        for i, stem, mark in ended:
            out[i] = found[stem] + mark
        return out, self._several(parts)

    def _gathered(self, texts: list[str]) -> list[memoryview | None]:
        """Ids of texts: their words are told apart and their ids gathered as arrays. None for a text with a run of white
        space."""
        import pyarrow as pa
        import pyarrow.compute as pc

        words = pc.split_pattern(pa.array([marked(t) for t in texts], pa.large_string()), " ")
        bounds, told = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        found = pa.array(self.words.of(told.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(told.indices)
        _, offsets, ids = found.buffers()
        cuts, ids = np.frombuffer(offsets, np.int64, len(found) + 1)[bounds].tolist(), memoryview(ids)
        odd = np.add.reduceat(found.is_null().to_numpy(zero_copy_only=False), bounds[:-1]).tolist() if found.null_count else [0] * len(texts)
        return [None if o else ids[i:j] for o, i, j in zip(odd, cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with the end id, as bytes."""
        plain = [i for i, t in enumerate(texts) if t and LINE not in t and not any(s in t for s in self.special)]
        whole: list[memoryview | None] = [None] * len(texts)
        for i, ids in zip(plain, self._gathered([texts[i] for i in plain]) if plain else [], strict=True):
            whole[i] = ids
        runs, owner = [], []
        for i, text in enumerate(texts):
            if whole[i] is None:
                text = text or ""
                some = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
                runs += some
                owner += [(i, j % 2) for j in range(len(some))]
        values = iter(self.words.values([r for r, (_, special) in zip(runs, owner, strict=True) if not special]))
        out: list[list] = [[ids] if ids is not None else [] for ids in whole]
        for run, (i, special) in zip(runs, owner, strict=True):
            out[i] += [self.marks[run]] if special else next(values)
        return [b"".join([*parts, self.end]) for parts in out]


_encoders: dict[tuple, _Encoder] = {}


def encoder(path: str, end_id: int) -> _Encoder:
    if (path, end_id) not in _encoders:
        _encoders[(path, end_id)] = _Encoder(path, end_id)
    return _encoders[(path, end_id)]


def write_shards(docs: DataFrame, path: str, out: str | None = None, end_id: int = 0, shard_bytes: int | None = None) -> DataFrame:
    """Encode ``docs`` and write shards below ``out``; returns the manifest ``(shard, file, n_docs, n_ids)``.

    One range shuffle by id gives each task the documents of one shard; shards grow with the corpus from 24 to 512 MB
    of text. A shard streams to a file of its own attempt and the manifest names the attempt that counts, so lost or
    repeated tasks do no harm; other files in the folder belong to no shard. Null text counts as empty, very long texts
    are encoded whole, null ids come first, repeated ids are all kept (ties by text hash, then text; very many rows of
    one id fill several shards), extra columns don't matter, an empty table writes nothing.
    """
    spark = docs.sparkSession
    folder = qualified(spark, out) if out else fresh_path(spark, "shards")
    rows = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // (shard_bytes or min(LARGEST, max(SHARD_BYTES, total // SHARDS)))))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        coder, shard = encoder(path, end_id), TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        name, writer, sink = f"shard-{shard:08d}-{uuid.uuid4().hex[:12]}.sst", None, None
        for batch in batches:
            if batch.num_rows:  # batches are bounded in bytes
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                if writer is None:
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(f"{base}/{name}", compression=None)
                    writer = ShardWriter(sink, coder.width)
                for doc_id, value in zip(ids, coder.encode(texts), strict=True):
                    writer.add(key_of(doc_id), value)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{folder}/{name}"], "n_docs": [writer.docs], "n_ids": [writer.ids]})

    ordered = rows.repartitionByRange(int(shards), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return persist_table(small_batches(ordered).mapInArrow(run, "shard long, file string, n_docs long, n_ids long"), "manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    The number of ids before each shard is a running total over the manifest; nothing reaches the driver but the number
    of shards. An empty manifest gives no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(file)
                with store.open_input_file(name) as source:
                    reader, out = ShardReader(source), ([], [], [], [])
                    for key, value in reader:
                        ids = np.frombuffer(value, dtype=f"<u{reader.width}")
                        for column, x in zip(out, (id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            column.append(x)
                        start += len(ids)
                        if len(out[0]) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            out = ([], [], [], [])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    starts = running_totals(manifest, ["shard"], upto="n_ids").select("file", (F.col("upto") - F.col("n_ids")).alias("start"))
    files = starts.repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
