"""Fuzzy passages that repeat across documents, by collinear chaining of shared seeds.

Documents are cut once into chunks of local word numbers with a local vocabulary. Each text is winnowed: of
every ``WINDOW`` consecutive five-word shingles the least hash is a seed, so any run of ``WINDOW + 4`` shared
words shares a seed, and one shared seed is enough for a candidate. A passage's seeds may lead to different
documents that hold parts of it; therefore runs of ``RUN`` words, winnowed so that every ``LEAST`` words hold
one, are seeds of a second kind: an exact repeat meets a document that holds its ``RUN`` words in a row.

Inside a chunk every occurrence of a seed is matched to the seed's first document there (smallest id, then
position); those first ones alone are dealt by hash to meet the other chunks', where they are matched to the
first of all. So a passage shared by very many documents costs one row a chunk, in no task more. The matches
of a document with an owner are chained in both orders at once with gap costs, over a Fenwick tree of prefix
maxima. For each chain the owner's words are fetched from its chunk and sent to the document's chunk, where
chains are aligned word by word; aligned passages of ``LEAST`` words or more with an identity of 0.8 or more
are the result. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from explainkit.llm.common import SLICE, Memo, ascii_words, by_unit, fresh_names, grouped, id_and_text, map_batches, own_columns, pack, read_parts, small_batches, unpack, write_parts
from explainkit.llm.shingles import WORDS, shingle_hashes
from explainkit.plans.storage import persist_table

WINDOW, LEAST, IDENTITY = 6, 50, 0.8
#: Words of a run, and how many consecutive runs one is picked from.
RUN, RUNS = 36, 15
#: Cost of a gap word in either text against the gain of a seed; a gap beyond MAX_GAP words ends a chain.
GAP_COST, MAX_GAP = 0.02, 60
#: Words read beyond a chain's ends for its alignment.
MARGIN = 56
#: Words within which matches on one diagonal are thinned to the first and the last.
THIN = 16
#: Text bytes of a chunk; words whose seeds are dealt to one task, about.
CHUNK_BYTES, UNIT_WORDS = 12_000_000, 8_000_000
#: Words that are winnowed at once, and seeds of a unit that are sorted at once, about; both bound a task's arrays.
SEED_WORDS, SORTED = 200_000, 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def winnowed(words: np.ndarray, sizes: np.ndarray, h: np.ndarray, k: int, window: int) -> np.ndarray:
    """Places of the least of every ``window`` consecutive shingle hashes ``h`` (of ``k`` words), text by text; texts
    with fewer shingles have the least of all."""
    if not len(h):
        return np.zeros(0, np.int64)
    starts, count = np.cumsum(sizes) - sizes, np.maximum(sizes - k + 1, 0)
    first = np.zeros(len(h) + 1, np.int64)
    full = count >= window
    np.add.at(first, starts[full], 1)
    np.add.at(first, starts[full] + count[full] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(first[:-1]) > 0)  # where a whole window of one text starts
    out = []
    if len(at):
        view = np.lib.stride_tricks.sliding_window_view(h, window)
        out = [part + view[part].argmin(axis=1) for part in np.array_split(at, -(-len(at) // 200_000))]
    short = np.flatnonzero((count > 0) & ~full)
    out.append(np.array([starts[i] + h[starts[i] : starts[i] + count[i]].argmin() for i in short], np.int64))
    return np.unique(np.concatenate(out))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` words in a row, from prefix sums of a polynomial; fewer words: none."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)], dtype=np.uint64)
    upto = np.r_[np.uint64(0), np.cumsum(words * power[:n], dtype=np.uint64)]
    back = np.cumprod(np.r_[np.uint64(1), np.full(n - k, np.uint64(pow(int(_BASE), -1, 2**64)))], dtype=np.uint64)
    h = (upto[k:] - upto[:-k]) * back
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


def seeds(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, places and kinds (1 for runs) of the seeds of texts laid out one after another; some whole texts are
    winnowed at a time."""
    ends = np.cumsum(sizes)
    cuts = [0, *(np.flatnonzero(np.diff((ends - sizes) // SEED_WORDS)) + 1).tolist(), len(sizes)]
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i < j:
            start = int(ends[i] - sizes[i])
            h, at, kind = _seeds(words[start : ends[j - 1]], sizes[i:j])
            out.append((h, at + start, kind))
    h, at, kind = (np.concatenate(x) for x in zip(*out, strict=True))
    return h, at, kind


def _seeds(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, runs = shingle_hashes(words) if len(words) >= WORDS else np.zeros(0, np.uint64), run_hashes(words, RUN)
    at, run_at = winnowed(words, sizes, h, WORDS, WINDOW), winnowed(words, sizes, runs, RUN, RUNS)
    run_at = run_at[np.repeat(np.cumsum(sizes), sizes)[run_at] - run_at >= RUN] if len(run_at) else run_at
    return np.r_[h[at], runs[run_at]], np.r_[at, run_at], np.r_[np.zeros(len(at), np.int64), np.ones(len(run_at), np.int64)]


def repeated_texts(docs: DataFrame) -> DataFrame | None:
    """``(again, chosen)``: ids that several rows have, with the smallest of their texts; ``None`` without such ids.

    Ids alone are counted; texts are shuffled for repeated ids only.
    """
    rows = id_and_text(docs).where("doc_id is not null")
    repeated = persist_table(rows.groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"), "repeated")
    if repeated.isEmpty():
        return None
    return persist_table(rows.join(repeated, F.col("doc_id") == F.col("again")).groupBy("again").agg(F.min("text").alias("chosen")), "chosen")


def one_text(docs: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """``(doc_id, text)``: one row an id, without null ids; of several texts the smallest."""
    rows = id_and_text(docs).where("doc_id is not null")
    if chosen is None:
        return rows
    return rows.join(chosen, F.col("doc_id") == F.col("again"), "left_anti").unionByName(chosen.select(F.col("again").alias("doc_id"), F.col("chosen").alias("text")))


def word_chunks(texts: DataFrame) -> DataFrame:
    """``(chunk, ids, sizes, words)``: documents as numbers of the chunk's words, and the words' hashes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        Memo.rest()
        number = TaskContext.get().partitionId() << 32

        def row(words: dict, ids: list, tokens: list) -> pa.RecordBatch:
            flat = np.concatenate(tokens)
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # frequent words have small numbers
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))[order]
            columns = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in tokens]], pa.list_(pa.int64())), pa.array([pack(place[flat], hashes)])]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "sizes", "words"])

        words, ids, tokens, load = {}, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = ascii_words(text)
                if not own:
                    continue
                get = words.setdefault
                tokens.append(np.array([get(w, len(words)) for w in own], dtype=np.int64))
                ids.append(doc_id)
                load += len(text) + 64
                if load >= CHUNK_BYTES:
                    yield row(words, ids, tokens)
                    number += 1
                    words, ids, tokens, load = {}, [], [], 0
        if ids:
            yield row(words, ids, tokens)

    return persist_table(small_batches(texts.select("doc_id", "text")).mapInArrow(run, "chunk long, ids array<long>, sizes array<long>, words binary"), "words")


def opened(batches: Iterator) -> Iterator[tuple]:
    """Chunks ``(chunk, ids, sizes, words)`` with word hashes in place of numbers."""
    for batch in batches:
        for i in range(batch.num_rows):
            chunk, ids, sizes, words = (batch.column(k)[i].as_py() for k in range(4))
            tokens, hashes = unpack(words)
            yield chunk, np.array(ids, np.int64), np.array(sizes, np.int64), hashes[tokens]


def firsts(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by hash, document and position; which of them is each hash's first; and each row's first."""
    order = np.lexsort((pos, doc, h))
    new = np.r_[True, h[order][1:] != h[order][:-1]] if len(order) else np.zeros(0, bool)
    return order, new, order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order


def later_holders(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """``hash, doc, position`` of some chunks' seeds: ``docs, positions, part, mine, other`` over all parts laid out one after
    another, with the places of later holders of a seed, in order of hash, and of its first holder.

    Each part is in order of hash, so ranges of hashes are taken from all parts and sorted one by one. ``parts`` is emptied.
    """
    sizes = np.array([len(p[0]) for p in parts])
    offsets = np.cumsum(sizes) - sizes
    n = max(1, int(sizes.sum()) // SORTED)
    bounds = np.arange(1, n, dtype=np.uint64) * np.uint64((2**64 - 1) // n)
    cuts = np.array([[0, *np.searchsorted(p[0], bounds), len(p[0])] for p in parts]) + offsets[:, None]
    columns = []
    for _ in range(3):  # a column is let go of once it is laid out
        columns.append(np.concatenate([p.pop(0) for p in parts]))
    parts.clear()
    h, doc, pos = columns
    mine, other = [], []
    for k in range(n):
        at = np.concatenate([np.arange(a, b, dtype=np.int32) for a, b in cuts[:, k : k + 2].tolist()])
        order, new, first = firsts(h[at], doc[at], pos[at])
        mine.append(at[order[~new]])
        other.append(at[first[~new]])
    part = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return doc, pos, part, np.concatenate(mine), np.concatenate(other)


def spans_of(doc: np.ndarray, owner: np.ndarray, a: np.ndarray, b: np.ndarray, run: np.ndarray) -> list[np.ndarray]:
    """``doc, owner, start, end, owner start, owner end`` of the chains of all pairs; a run counts at both its ends."""
    tail = np.flatnonzero(run)
    doc, owner, a, b = np.r_[doc, doc[tail]], np.r_[owner, owner[tail]], np.r_[a, a[tail] + RUN - WORDS], np.r_[b, b[tail] + RUN - WORDS]
    order = np.lexsort((a, b - a, owner, doc))
    doc, owner, a, b = (x[order] for x in (doc, owner, a, b))
    pair = np.r_[True, (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1])] if len(doc) else np.zeros(0, bool)
    new = pair | np.r_[True, (b[1:] - a[1:] != b[:-1] - a[:-1]) | (a[1:] // THIN != a[:-1] // THIN)] if len(doc) else pair
    keep = new | np.r_[new[1:], True] if len(doc) else pair  # first and last of each stretch
    pair = np.maximum.accumulate(np.where(pair, np.arange(len(doc)), 0))[keep] if len(doc) else pair
    doc, owner, a, b = (x[keep] for x in (doc, owner, a, b))
    cuts = np.r_[0, np.flatnonzero(np.diff(pair)) + 1, len(doc)] if len(doc) else np.zeros(1, np.int64)
    sizes = np.diff(cuts)
    one = cuts[:-1][sizes == 1]
    out = [tuple(r) for r in zip(doc[one].tolist(), owner[one].tolist(), a[one].tolist(), (a[one] + WORDS).tolist(), b[one].tolist(), (b[one] + WORDS).tolist(), strict=True)]
    for i, n in zip(cuts[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        out += [(int(doc[i]), int(owner[i]), *s) for s in chain_spans(a[i : i + n].tolist(), b[i : i + n].tolist())]
    return [np.array(c, np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6


class MaxTree:
    """Fenwick tree of prefix maxima that remembers who holds them."""

    def __init__(self, n: int) -> None:
        self.best, self.who = [-1e18] * (n + 1), [-1] * (n + 1)

    def put(self, at: int, value: float, who: int) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at], self.who[at] = value, who
            at += at & -at

    def upto(self, at: int) -> tuple[float, int]:
        """The maximum over places 0 to ``at - 1``."""
        value, who = -1e18, -1
        while at > 0:
            if self.best[at] > value:
                value, who = self.best[at], self.who[at]
            at -= at & -at
        return value, who


def chains(a: list[int], b: list[int]) -> list[list[int]]:
    """Indices of the matches of each chain, best chain first; each match is in one chain."""
    order = sorted(range(len(a)), key=lambda i: (a[i], -b[i]))
    ranks = {v: r for r, v in enumerate(sorted(set(b)))}
    tree, score, before = MaxTree(len(ranks)), [0.0] * len(a), [-1] * len(a)
    for k, i in enumerate(order):
        value, who = tree.upto(ranks[b[i]])
        if who >= 0 and (a[i] - a[who] > MAX_GAP or b[i] - b[who] > MAX_GAP):  # the best of all is too far: the best of the near ones
            value, who = -1e18, -1
            for n in range(k - 1, -1, -1):
                j = order[n]
                if a[i] - a[j] > MAX_GAP:
                    break
                if a[j] < a[i] and 0 < b[i] - b[j] <= MAX_GAP and (held := score[j] + GAP_COST * (a[j] + b[j])) > value:
                    value, who = held, j
        gain = value - GAP_COST * (a[i] + b[i])
        score[i] = 1.0
        if who >= 0 and gain > 0:
            score[i] += gain
            before[i] = who
        tree.put(ranks[b[i]], score[i] + GAP_COST * (a[i] + b[i]), i)
    used, out = [False] * len(a), []
    for i in sorted(range(len(a)), key=lambda i: (-score[i], a[i], b[i])):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def _merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Chains that continue each other in both texts, as one."""
    out: list[list[int]] = []
    for s in sorted(spans):
        if out and -WORDS < s[0] - out[-1][1] <= MAX_GAP and -WORDS < s[2] - out[-1][3] <= MAX_GAP:
            out[-1][1], out[-1][3] = s[1], s[3]
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def chain_spans(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """``(start, end, owner start, owner end)`` in words of the chains worth an alignment."""
    spans = [(a[c[0]], a[c[-1]] + WORDS, b[c[0]], b[c[-1]] + WORDS) for c in chains(a, b)]
    return _merged(spans)


def align(x: np.ndarray, y: np.ndarray, start: tuple[int, int], end: tuple[int, int]) -> tuple[int, int, int, int, int, int]:
    """Align word hashes ``x`` and ``y`` from ``start`` to ``end`` and extend both ways.

    Returns start and end in both, matched words and columns. Inside, equal runs are walked and the
    words between them aligned by a small table; outside, words are added while two of three agree.
    """
    i, j = start
    matched = columns = 0
    while i < end[0] and j < end[1]:
        n = min(end[0] - i, end[1] - j)
        differ = np.flatnonzero(x[i : i + n] != y[j : j + n])
        run = int(differ[0]) if len(differ) else n
        matched, columns, i, j = matched + run, columns + run, i + run, j + run
        if i >= end[0] or j >= end[1]:
            break
        i2, j2 = _resume(x, y, i, j, end)
        di, dj = i2 - i, j2 - j
        same = int((x[i:i2] == y[j:j2]).sum()) if di == dj else _common(x[i:i2], y[j:j2])
        matched, columns, i, j = matched + same, columns + max(di, dj), i2, j2
    columns += max(end[0] - i, end[1] - j)
    after = _extend(x[end[0] :], y[end[1] :])
    front = _extend(x[: start[0]][::-1], y[: start[1]][::-1])
    need = LEAST - (end[0] - start[0])
    if front[0] + after[0] < need and matched:  # too short where agreement is densest: the best LEAST words
        front, after = _fill(x, y, start, end, need) or (front, after)
    matched += after[1] + front[1]
    columns += after[0] + front[0]
    return start[0] - front[0], end[0] + after[0], start[1] - front[0], end[1] + after[0], matched, columns


def _fill(x: np.ndarray, y: np.ndarray, start: tuple[int, int], end: tuple[int, int], need: int) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """``need`` words before and after, where most of them agree; words and agreeing words of both sides."""
    before, behind = min(start), min(len(x) - end[0], len(y) - end[1])
    left = np.arange(max(0, need - behind), min(need, before) + 1)
    if not len(left):
        return None
    front = np.r_[0, np.cumsum(x[start[0] - before : start[0]][::-1] == y[start[1] - before : start[1]][::-1])]
    after = np.r_[0, np.cumsum(x[end[0] : end[0] + behind] == y[end[1] : end[1] + behind])]
    best = int(left[(front[left] + after[need - left]).argmax()])
    return (best, int(front[best])), (need - best, int(after[need - best]))


def _resume(x: np.ndarray, y: np.ndarray, i: int, j: int, end: tuple[int, int]) -> tuple[int, int]:
    """The nearest place after a difference where three words agree again (or the end)."""
    reach = MAX_GAP + WORDS
    a, b = x[i : min(end[0], i + reach)], y[j : min(end[1], j + reach)]
    same = a[:, None] == b[None, :]
    if same.shape[0] >= 3 and same.shape[1] >= 3:
        three = same[:-2, :-2] & same[1:-1, 1:-1] & same[2:, 2:]
        p, q = np.nonzero(three)
        if len(p):
            best = int(np.lexsort((p, np.maximum(p, q) + np.abs(p - q)))[0])
            return i + int(p[best]), j + int(q[best])
    return i + len(a), j + len(b)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence of two short runs."""
    row = [0] * (len(b) + 1)
    for u in a.tolist():
        last = 0
        for k, v in enumerate(b.tolist(), 1):
            keep = row[k]
            row[k] = last + 1 if u == v else max(row[k], row[k - 1])
            last = keep
    return row[-1]


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Words to add and how many of them agree: the farthest end with the best score (+1, -2)."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    agree = a[:n] == b[:n]
    score = np.cumsum(np.where(agree, 1, -2))
    low = np.flatnonzero(np.maximum.accumulate(np.r_[0, score])[:-1] - score > 12)
    score = score[: low[0]] if len(low) else score
    if not len(score) or score.max() <= 0:
        return 0, 0
    k = len(score) - int(score[::-1].argmax())
    return k, int(agree[:k].sum())


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, start_word, end_word, owner_id, owner_start, owner_end, matched, identity)``.

    One row for each passage of a document that an earlier document (smaller id) holds too; ``end`` is
    exclusive, words are counted from 0. Null or wordless texts and null ids have no passages; very long
    texts are read whole; repeated rows of one id are one document (the text that sorts first). Of equal
    seeds in one document the first counts, of chains of equal score the one that starts first; passages
    may overlap and may be found in several documents. Extra columns don't matter; an empty table gives no
    rows.
    """
    return _repeated(one_text(docs, repeated_texts(docs)))


def _repeated(texts: DataFrame) -> DataFrame:
    """:func:`repeated_passages` of ``texts (doc_id, text)`` with one row an id."""
    chunks = word_chunks(texts)
    total = chunks.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))).first()[0]
    units = max(1, -(-total // UNIT_WORDS))

    def emit(batches: Iterator) -> Iterator:
        """Chains inside a chunk (``own``), and the first holders of its seeds, dealt by hash."""
        import pyarrow as pa

        Memo.rest()
        for chunk, ids, sizes, words in opened(batches):
            h, at, kind = seeds(words, sizes)
            ends = np.cumsum(sizes)
            doc = np.searchsorted(ends, at, side="right")
            name, pos = ids[doc], at - (ends - sizes)[doc]
            order, new, first = firsts(h, name, pos)
            # a later occurrence in another document is matched here; one in the same document isn't a match
            later = (~new) & (name[order] != name[first])
            mine, other = order[later], first[later]
            rows = [(int(chunk % units), chunk, True, pack(*spans_of(name[mine], name[other], pos[mine], pos[other], kind[mine])))]
            lead = order[new]
            for unit, some in by_unit(((h[lead] >> np.uint64(20)) % np.uint64(units)).astype(np.int64)):
                some = lead[some]
                rows.append((unit, chunk, False, pack(h[some], name[some], (2 * pos[some] + kind[some]).astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["unit", "chunk", "own", "part"])

    def match(batches: Iterator) -> Iterator:
        """Matches of each chunk's first holders with the first of all; chains inside a chunk pass through."""
        import pyarrow as pa

        Memo.rest()
        for _, rows in grouped(batches, 4):
            chunks, parts = [], []
            rows.reverse()
            while rows:  # what is unpacked or passed on is let go of
                chunk, own, part = rows.pop()
                if own:
                    yield pa.RecordBatch.from_pydict({"chunk": [chunk], "own": [True], "part": [part]})
                else:
                    chunks.append(chunk)
                    parts.append(unpack(part))
            if not parts:
                continue
            name, pos, held, mine, other = later_holders(parts)
            chunks = np.array(chunks, np.int64)
            for k, some in by_unit(held[mine]):
                x, y = mine[some], other[some]
                yield pa.RecordBatch.from_pydict({"chunk": [int(chunks[k])], "own": [False], "part": [pack(name[x], pos[x], chunks[held[y]], name[y], pos[y] // 2)]})

    def chain(batches: Iterator) -> Iterator:
        """Chains by where they go next: those with another chunk's document to that chunk, the others to their own."""
        import pyarrow as pa

        for chunk, rows in grouped(batches, 3):
            out = [(chunk, True, part) for own, part in rows if own]
            parts = [unpack(part) for own, part in rows if not own]
            if parts:
                name, pos, where, owner, opos = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(5))
                held = dict(zip(owner.tolist(), where.tolist(), strict=True))
                found = spans_of(name, owner, pos // 2, opos, pos % 2)
                for dest, some in by_unit(np.array([held[o] for o in found[1].tolist()], np.int64)):
                    out.append((dest, False, pack(np.full(len(some), chunk), *(f[some] for f in found))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["chunk", "own", "part"])

    def fetch(batches: Iterator) -> Iterator:
        """The owners' words around the chains that ask for them, by the asking document's chunk."""
        import pyarrow as pa

        for chunk, ids, sizes, words in opened(batches):
            parts = [unpack(part) for part in read_parts(asked, chunk)]
            if not parts:
                continue
            dest, name, owner, s, e, os_, oe = (np.concatenate([p[k] for p in parts]) for k in range(7))
            order = np.argsort(ids)
            at = order[np.searchsorted(ids, owner, sorter=order)]
            start, size = (np.cumsum(sizes) - sizes)[at], sizes[at]
            lo, hi = np.maximum(os_ - MARGIN, 0), np.minimum(oe + MARGIN, size)
            short = (words >> np.uint64(40)).astype(np.uint32)  # 24 bits tell words of one passage apart
            for to, some in by_unit(dest):
                flat = np.concatenate([short[a:b] for a, b in zip(start[some] + lo[some], start[some] + hi[some], strict=True)])
                yield pa.RecordBatch.from_pydict({"chunk": [to], "part": [pack(*(x[some] for x in (name, owner, s, e, os_, oe, lo, hi - lo)), flat)]})

    def finish(batches: Iterator) -> Iterator:
        """Chains aligned, with owners' words that were sent or that are in the chunk."""
        import pyarrow as pa

        for chunk, ids, sizes, words in opened(batches):
            short, starts = (words >> np.uint64(40)).astype(np.uint32), np.cumsum(sizes) - sizes
            text = {d: short[a : a + n] for d, a, n in zip(ids.tolist(), starts.tolist(), sizes.tolist(), strict=True)}
            out = []
            for part in read_parts(ready, chunk):
                arrays = unpack(part)
                if len(arrays) == 6:
                    sides = ((text[o], 0) for o in arrays[1].tolist())
                else:
                    ends = np.cumsum(arrays[7])
                    sides = zip((arrays[8][b - n : b] for n, b in zip(arrays[7].tolist(), ends.tolist(), strict=True)), arrays[6].tolist(), strict=True)
                for d, o, s, e, os_, oe, (y, lo) in zip(*(x.tolist() for x in arrays[:6]), sides, strict=True):
                    found = passage(text[d], y, s, e, os_ - lo, oe - lo)
                    if found:
                        out.append((d, found[0], found[1], o, found[2] + lo, found[3] + lo, found[4], found[4] / found[5]))
            if out:
                names = ["doc_id", "start_word", "end_word", "owner_id", "owner_start", "owner_end", "matched", "identity"]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    many = 4 * units
    dealt = chunks.mapInArrow(emit, "unit long, chunk long, own boolean, part binary").repartition(many, "unit").sortWithinPartitions("unit", "chunk")
    matched = dealt.mapInArrow(match, "chunk long, own boolean, part binary").repartition(many, "chunk").sortWithinPartitions("chunk")
    chained = persist_table(matched.mapInArrow(chain, "chunk long, own boolean, part binary"), "chains")
    asked = write_parts(chained.where("not own").select("chunk", "part"), "asked", many)
    sent = chunks.mapInArrow(fetch, "chunk long, part binary")
    ready = write_parts(sent.unionByName(chained.where("own").select("chunk", "part")), "ready", many)
    return chunks.mapInArrow(finish, "doc_id long, start_word int, end_word int, owner_id long, owner_start int, owner_end int, matched int, identity double")


def passage(x: np.ndarray, y: np.ndarray, s: int, e: int, os_: int, oe: int) -> tuple | None:
    """The passage that a chain's alignment makes: start and end in both texts, matched words, columns."""
    lo = max(0, s - MARGIN)
    x = x[lo : e + MARGIN]
    end = min(e - lo, len(x)), min(oe, len(y))
    if end[0] <= s - lo or end[1] <= os_:
        return None
    a0, a1, b0, b1, matched, columns = align(x, y, (s - lo, os_), end)
    return (a0 + lo, a1 + lo, b0, b1, matched, columns) if a1 - a0 >= LEAST and matched >= IDENTITY * columns else None


def cut_words(text: str, spans: list) -> str:
    """``text`` without the given word ranges; line breaks around a removed passage stay one."""
    import re

    if not spans:
        return text
    drop = np.zeros(max(s["end_word"] for s in spans) + 1, dtype=bool)
    for s in spans:
        drop[s["start_word"] : s["end_word"]] = True
    out, last = [], 0
    for i, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if i < len(drop) and drop[i]:
            out.append(text[last : m.start()] if not out or i == 0 or not drop[i - 1] else "")
            last = m.end()
    out.append(text[last:])
    return "".join(out).strip(" \t\n\x0b\x0c\r")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with each repeated passage cut from all but its first document; columns stay.

    ``n_chars``, where there is one, follows the new text. A document that was nothing but repeats goes;
    documents without a passage come through untouched, null, empty and wordless texts and null ids too. Of
    repeated rows of one id those with the smallest text are cut, others with another text stay as they are.
    Very long texts are cut whole; columns of any name pass through; an empty table gives no rows.
    """
    chosen = repeated_texts(docs)
    of, marks, again, kept = fresh_names(docs, "of", "marks", "again", "chosen")
    spans = _repeated(one_text(docs, chosen)).groupBy(F.col("doc_id").alias(of)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(marks))
    columns, text_at = docs.columns, docs.columns.index("text")
    own = own_columns(docs)
    joined = docs.join(spans, F.col("doc_id").cast("long") == F.col(of), "left").select(*own, marks)
    if chosen is not None:
        joined = joined.join(chosen.toDF(again, kept), F.col("doc_id").cast("long") == F.col(again), "left")
        other = F.col(again).isNotNull() & ~F.col("text").cast("string").eqNullSafe(F.col(kept))
        joined = joined.select(*own, F.when(~other, F.col(marks)).alias(marks))
    mark_at = len(columns)
    chars_at = columns.index("n_chars") if "n_chars" in columns else None
    schema = docs.schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                marks = part.column(mark_at).to_pylist()
                arrays = list(part.columns[: len(columns)])
                if any(marks):
                    texts = arrays[text_at].to_pylist()
                    new = [cut_words(t, m) if m and t else t for t, m in zip(texts, marks, strict=True)]
                    arrays[text_at] = pa.array(new, arrays[text_at].type)
                    if chars_at is not None:
                        sizes = arrays[chars_at].to_pylist()
                        arrays[chars_at] = pa.array([len(n) if m and n is not None else c for n, c, m in zip(new, sizes, marks, strict=True)], arrays[chars_at].type)
                    keep = pa.array([not m or bool(n) for n, m in zip(new, marks, strict=True)])
                    yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(keep)
                else:
                    yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return map_batches(joined, run, schema)
