"""Near-duplicate documents by SimHash, linked through pivot distance tables.

Equal fingerprints are one node. Every node has its Hamming distances to a table of reference fingerprints,
unions of sixteen blocks of four bits: the empty one, the blocks themselves, and sixteen balanced patterns of
blocks. The distances to the empty reference and to the blocks give a node's count of ones in each block.
Two nodes that link differ in at most four bits, so in at most four of the counts: dealt into six groups of
blocks, they agree on all counts of two groups at least. Nodes are dealt by those tuples of distances, one row
for each choice of groups; inside a cell pairs whose distances to any reference differ by more than four can't
link (triangle inequality) and are discarded, the rest are verified. Cells too large for a task are dealt again
by agreeing bits, and what is still too large into parts, where every two parts meet in a task of their own.
Links of dense cells are cut down to a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from explainkit.llm.common import ascii_words, fresh_names, id_and_text, map_rows, own_columns
from explainkit.operators.graph import connected_components
from explainkit.plans.storage import persist_table

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Nodes of one cell or part of a cell, and rows of it that meet all others at once.
PART, STRIPE = 8192, 512
#: Bits of a block, and the blocks of a fingerprint.
BITS = 4
BLOCKS = [((1 << BITS) - 1) << (BITS * i) for i in range(64 // BITS)]
#: Balanced patterns: block j is in pattern i if i and j share an odd number of binary digits.
PATTERNS = [sum(b for j, b in enumerate(BLOCKS) if (i & j).bit_count() % 2) for i in range(1, len(BLOCKS))]
#: Reference fingerprints, those that tell most pairs apart first.
PIVOTS = np.array([*PATTERNS, 0, *BLOCKS], dtype=np.uint64)
#: References whose distances are compared for all pairs of a cell; the others only for what they leave.
FIRST = 4


def fingerprint(text: str | None) -> int:
    """Majority of the shingles' XXH64 bits; no words: zero."""
    import xxhash

    words = ascii_words(text)
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        raw, count = xxhash.xxh64_digest(joined, SEED), 1
    else:
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        starts.append(at)
        digest = xxhash.xxh64_digest
        raw = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:], strict=False)])
        count = n - SHINGLE + 1
    table = np.frombuffer(raw, dtype=np.uint8).reshape(count, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, count, 4096):
        ones += np.unpackbits(table[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint's bits as a signed long."""

    def work(cols: list[list]) -> list[list]:
        found = [fingerprint(t) for t in cols[1]]
        return [cols[0], [f - 2**64 if f >= 2**63 else f for f in found]]

    return map_rows(id_and_text(docs), ["doc_id", "text"], work, "doc_id long, fp long")


def _choices(nodes: int) -> tuple[int, int]:
    """Groups of blocks, and how many of them agree: more nodes, longer keys. All choices are exact."""
    return (6, 2) if nodes < 2**21 else (8, 4)


def _cut(n: int, groups: int) -> list[range]:
    cuts = [round(n * i / groups) for i in range(groups + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def cells(nodes: DataFrame, groups: int, agree: int) -> DataFrame:
    """``(choice, cell, fp)``: a row for each choice of ``agree`` groups, keyed by the block counts in them.

    A block's count follows from two distances of the table, ``d`` to the empty reference and ``e`` to the
    block: it is ``(d - e + BITS) / 2``.
    """
    away = lambda ref: F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(ref))))).cast("long")
    counted = nodes.select("fp", away(0).alias("d"), *[away(b).alias(f"e{i}") for i, b in enumerate(BLOCKS)])
    counted = counted.select("fp", *[F.shiftright(F.col("d") - F.col(f"e{i}") + BITS, 1).alias(f"c{i}") for i in range(len(BLOCKS))])
    parts = _cut(len(BLOCKS), groups)
    keys = []
    for n, some in enumerate(combinations(parts, agree)):
        key = F.lit(0).cast("long")
        for i in (i for part in some for i in part):
            key = key * (BITS + 1) + F.col(f"c{i}")
        keys.append(F.struct(F.lit(n).alias("choice"), key.alias("cell")))
    return counted.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.*", "fp")


def _distances(fps: np.ndarray) -> np.ndarray:
    """The pivot table of some nodes: a row for each reference."""
    return np.bitwise_count(fps[None, :] ^ PIVOTS[:, None]).astype(np.int8)


def _near(table: np.ndarray, fps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of some rows to all nodes: pairs are discarded by the table's references in turn, the rest verified."""
    left = np.ones((len(rows), len(fps)), dtype=bool)
    for distance in table[:FIRST]:
        left &= np.abs(distance[rows, None] - distance[None, :]) <= RADIUS
    i, j = np.nonzero(left)
    i = rows[i]
    i, j = i[i < j], j[i < j]
    for distance in table[FIRST:]:
        keep = np.abs(distance[i] - distance[j]) <= RADIUS
        i, j = i[keep], j[keep]
    keep = np.bitwise_count(fps[i] ^ fps[j]) <= RADIUS
    return i[keep], j[keep]


def _forest(table: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a dense cell's links: a search takes linked nodes off the list."""
    rest = np.arange(len(fps))
    a, b = [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = rest[(np.abs(table[:, rest] - table[:, [i]]) <= RADIUS).all(axis=0)]
            found = near[np.bitwise_count(fps[near] ^ fps[i]) <= RADIUS]
            if len(found):
                a.append(np.full(len(found), i))
                b.append(found)
                queue.extend(found)
                rest = np.setdiff1d(rest, found, assume_unique=True)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def cell_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one cell; of a dense one those of a spanning forest."""
    table, a, b, seen = _distances(fps), [], [], 0
    for at in range(0, len(fps), STRIPE):
        i, j = _near(table, fps, np.arange(at, min(at + STRIPE, len(fps))))
        a.append(i)
        b.append(j)
        seen += len(i)
        if seen > 8 * len(fps):
            i, j = _forest(table, fps)
            return fps[i], fps[j]
    return fps[np.concatenate(a)], fps[np.concatenate(b)]


def links(nodes: DataFrame, count: int, part: int = PART) -> DataFrame:
    """Spanning edges ``(src, dst)`` between distinct fingerprints that differ in four bits or fewer."""
    dealt = cells(nodes, *_choices(count))
    masks = [sum(((1 << len(r)) - 1) << r[0] for r in some) for some in combinations(_cut(64, 6), 2)]
    crowded = dealt.groupBy("choice", "cell").agg(F.count("*").alias("n")).where(F.col("n") > part).select("choice", "cell", F.lit(True).alias("crowded"))
    agreeing = F.array(*[F.struct(F.lit(i).alias("by"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])
    whole = F.array(F.struct(F.lit(-1).alias("by"), F.lit(0).cast("long").alias("bits")))
    finer = dealt.join(crowded, ["choice", "cell"], "left").select("choice", "cell", "fp", F.explode(F.when(F.col("crowded"), agreeing).otherwise(whole)).alias("k")).select("choice", "cell", "k.*", "fp")
    keys = ["choice", "cell", "by", "bits"]
    hot = finer.where("by >= 0").groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > part).select(*keys, F.ceil(F.col("n") / part).alias("parts"))
    marked = finer.join(hot, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", "choice"), F.col("parts"))
    # with parts, each row meets every part; with one part this is a single row
    spread = marked.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = spread.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def edges(key: np.ndarray, fps: np.ndarray) -> Iterator:
            cuts = [0, *(np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1).tolist(), len(fps)]
            found = [cell_links(fps[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)], ["src", "dst"])

        held_key, held = np.zeros((0, 6), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            key = np.r_[held_key, np.stack(cols[:6], axis=1)]
            fps = np.r_[held, cols[6].view(np.uint64)]
            if not len(fps):
                continue
            back = np.flatnonzero(np.any(key != key[-1], axis=1))
            last = back[-1] + 1 if len(back) else 0  # the last cell may go on in the next batch
            yield from edges(key[:last], fps[:last]) if last else ()
            held_key, held = key[last:], fps[last:]
        if len(held):
            yield from edges(held_key, held)

    by = [*keys, "i", "j"]
    # comparing costs more than its few bytes tell, so the tasks follow the number of nodes
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // 8192))
    return rows.repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(run, "src long, dst long").distinct()


def components(prints: DataFrame) -> DataFrame:
    """``(fp, least, component)`` of each fingerprint: its smallest id, and the smallest one of its component.

    The graph's nodes are numbered by their smallest ids, so a component's name is its answer and no join by
    component is needed; nodes without any id come behind all others, numbered by their fingerprints.
    """
    nodes = persist_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    wide = "decimal(20,0)"
    none = F.lit(str(2**63)).cast(wide) + F.col("fp").cast(wide) + F.lit(str(2**63)).cast(wide)
    named = nodes.select("fp", F.coalesce(F.col("least").cast(wide), none.cast(wide)).alias("name"))
    end = lambda c: named.select(F.col("fp").alias(c), F.col("name").alias(f"{c}_name"))
    edges = links(nodes.select("fp"), nodes.count()).join(end("src"), "src").join(end("dst"), "dst")
    labels = connected_components(edges.select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst")))
    joined = nodes.join(named, "fp").join(labels, F.col("name") == F.col("node"), "left")
    label = F.coalesce("component", "name")
    return joined.select("fp", "least", F.when(label < F.lit(str(2**63)).cast(wide), label).cast("long").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of each document.

    Null or wordless text has fingerprint zero and links like any other; very long texts are read whole. Each
    row is answered, repeated rows too, and an id with several texts may be in several components; null ids
    are answered but never a component's id, unless all its ids are null; fingerprints with an equal number of
    ones and zeros in a bit have a zero there; extra columns don't matter; an empty table gives no rows.
    """
    prints = persist_table(fingerprints(docs), "prints")
    found = components(prints).select(F.col("fp").alias("node_fp"), F.col("component").alias("component_id"))
    out = prints.join(found, F.col("fp") == F.col("node_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id, with all its columns.

    Null, empty and very long texts count as in :func:`near_duplicates`, so of all wordless documents one stays.
    Rows without an id can't be told apart and stay. Of several rows with the kept id the one with the smallest
    text stays (null first, then by all columns), whatever its own group. Columns of any name pass through; an
    empty table gives no rows.
    """
    prints = persist_table(fingerprints(docs.where("doc_id is not null")), "prints")
    key, many = fresh_names(docs, "kept", "n")
    keep = components(prints).where("least = component").select(F.col("least").alias(key)).distinct()
    named = docs.join(keep, F.col("doc_id").cast("long") == F.col(key), "left_semi")
    # ids alone tell which rows repeat; only those are grouped with all their columns
    repeated = prints.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias(many)).where(F.col(many) > 1).select(key)
    again = lambda how: named.join(repeated, F.col("doc_id").cast("long") == F.col(key), how)
    row = F.struct(*own_columns(docs))
    first = again("left_semi").groupBy(F.col("doc_id").cast("long").alias(key)).agg(F.min_by(row, F.struct(F.col("text"), F.to_json(row))).alias(many))
    picked = first.select(*[F.col(many).getField(c).alias(c) for c in docs.columns])
    return again("left_anti").unionByName(picked).unionByName(docs.where("doc_id is null"))
