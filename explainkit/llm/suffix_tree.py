"""Language-model scores by a probabilistic suffix tree over tokens.

A context is a suffix of the tokens before a token, up to ``DEPTH`` of them. It becomes a state if it is
frequent enough and if its next-symbol counts diverge from its parent's by more than they cost to describe.
States predict the frequent words and one rare symbol; they are smoothed by absolute discounting towards the
longest shorter state. Below them is the distribution of all counted words and the unknown word, whose share
the singletons tell. Scores use the longest state that is a suffix of what came before, and add up to a
probability over the same tokens as the base score.

The tree has two parts. Its crown holds contexts that make up a least share of all training tokens, over
frequent words and, for all others, classes of their last two characters; so it has a bounded size and is
broadcast. All other contexts are in branches, which are kept from a fixed count on if they diverge. A word of a class that occurs often
enough by count has a branch of its own: the contexts that end in that word. The rarer words of a class share a
branch, and so do the uses of a frequent word: of the contexts that end in it, a branch has those that the crown doesn't hold.
The branches grow with the corpus. They are never gathered: tokens are dealt by the word, or by their shortest context
that the crown doesn't hold, so a task holds whole branches, grows them, scores those tokens, and sends back sums by
document, as one file a chunk. (Without ``Bounds.every`` only a class's words of their own have branches; behind a word too
common for one task these start with the symbol before it.)

Documents are cut once into chunks of local token numbers with a local vocabulary. Vocabularies are dealt by
word, as arrays, to count the whole corpus; the counts come back as one small file a chunk, so that tokens are
never shuffled to meet them. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from explainkit.llm.common import SLICE, ascii_words, by_unit, crc_mod, grouped, id_and_text, pack, read_parts, small_batches, unpack, write_parts
from explainkit.plans.storage import drop_path, persist_path, persist_table

#: Longest context; discount of states; classes of rare words.
DEPTH, DISCOUNT, CLASSES = 3, 0.6, 4096


@dataclass(frozen=True)
class Bounds:
    """Least share of the training tokens that a context of the crown makes up, and a word that contexts and states know
    by itself; least count of a context, in branches and in the crown of small corpora; text bytes of a chunk; tokens
    whose words and branches are dealt to one task, about; whether every context the crown doesn't hold has a branch, and
    the crown's states know all their next symbols (if not, only words that aren't frequent have branches)."""

    share: float = 2e-4
    frequent: float = 5e-5
    least: int = 8
    chunk_bytes: int = 8_000_000
    unit_tokens: int = 3_000_000
    every: bool = False


#: The whole tree.
EVERY = Bounds(every=True)

#: The end of a text in the vocabulary (no word holds white space).
END = b"\n"
RARE, START, WHOLE = 0, 1, -1
#: Tokens whose branches are grown at once, about.
STEP = 400_000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def _tail_class(word: bytes) -> int:
    """The class of a word that isn't frequent: by its last two characters."""
    return zlib.crc32(word[-2:] if word.isascii() else word.decode("utf-8", "surrogatepass")[-2:].encode("utf-8", "surrogatepass")) % CLASSES


def chunk_table(docs: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Documents as local token numbers, with each chunk's vocabulary and its training counts.

    ``tokens`` are the local numbers, ``words`` the local words' hashes, classes and training counts.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def row(words: dict, ids: list, tokens: list) -> pa.RecordBatch:
            held = np.array([crc_mod(i, 10) == 0 for i in ids], dtype=bool)
            flat, sizes = np.concatenate(tokens), np.array([len(t) for t in tokens])
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # frequent words have small numbers
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            flat = place[flat]
            counts = np.bincount(flat[np.repeat(~held, sizes)], minlength=len(words)).astype(np.uint32)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))[order]
            classes = np.fromiter(map(_tail_class, words), dtype=np.uint16, count=len(words))[order]
            columns = [pa.array([number]), pa.array([pack(flat)]), pa.array([pack(hashes, classes, counts)]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([int(counts.sum())])]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "tokens", "words", "ids", "sizes", "n_train"])

        words, ids, tokens, load = {END: 0}, [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = ascii_words(text)
                    own.append(END)
                    get = words.setdefault
                    tokens.append(np.array([get(w, len(words)) for w in own], dtype=np.int64))
                    ids.append(doc_id)
                    load += len(text or "") + 64
                    if load >= bounds.chunk_bytes:
                        yield row(words, ids, tokens)
                        number += 1
                        words, ids, tokens, load = {END: 0}, [], [], 0
        if ids:
            yield row(words, ids, tokens)

    schema = "chunk long, tokens binary, words binary, ids array<long>, sizes array<long>, n_train long"
    return persist_table(small_batches(id_and_text(docs)).mapInArrow(run, schema), "chunks")


def _unit(hashes: np.ndarray, units: int) -> np.ndarray:
    """The task that a word is dealt to."""
    return ((hashes >> np.uint64(24)) % np.uint64(units)).astype(np.int64)


def vocabulary(chunks: DataFrame, units: int, total: int, bounds: Bounds = Bounds()) -> tuple[DataFrame, str]:
    """``(unit, chunk, counts, kinds, once, twice, words, uses)``: corpus counts of every chunk's words in the order in
    which the chunk dealt them; a unit's first row says how many words it counts, how many of them occur once and twice,
    and which are frequent. And the table's place."""

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for chunk, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes, _, counts = unpack(words)
                rows = [(u, chunk, pack(hashes[at], counts[at])) for u, at in by_unit(_unit(hashes, units))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["unit", "chunk", "part"])

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for unit, rows in grouped(batches, 3):
            parts = [unpack(part) for _, part in rows]
            found, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            c = np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(found)).astype(np.int64)
            ends = np.cumsum([len(p[0]) for p in parts])
            often = np.flatnonzero(c >= max(1, bounds.frequent * total))
            stats = ([int((c > 0).sum())], [int((c == 1).sum())], [int((c == 2).sum())], [found[often].view(np.int64).tolist()], [c[often].tolist()])
            for n, ((chunk, _), end) in enumerate(zip(rows, ends, strict=True)):
                mine = c[back[end - len(parts[n][0]) : end]]
                mine = mine.astype(np.uint32) if len(mine) == 0 or mine.max() < 2**32 else mine
                columns = [pa.array([unit]), pa.array([chunk]), pa.array([pack(np.array([unit]), mine)])]
                columns += [pa.array(x if not n else [None], t) for x, t in zip(stats, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["unit", "chunk", "counts", "kinds", "once", "twice", "words", "uses"])

    dealt = chunks.select("chunk", "words").mapInArrow(deal, "unit long, chunk long, part binary").repartition(4 * units, "unit").sortWithinPartitions("unit", "chunk")
    return persist_path(dealt.mapInArrow(count, "unit long, chunk long, counts binary, kinds long, once long, twice long, words array<long>, uses array<long>"), "vocabulary")


def read_counts(folder: str, chunk: int, hashes: np.ndarray, units: int) -> np.ndarray:
    """Corpus counts of a chunk's words, from the parts that the units wrote."""
    parts = {int(n[0]): c for n, c in (unpack(part) for part in read_parts(folder, chunk))}
    out = np.empty(len(hashes), np.int64)
    out[np.argsort(_unit(hashes, units), kind="stable")] = np.concatenate([parts[n] for n in sorted(parts)])
    return out


class Symbols:
    """Symbols of words: 2 and up for the frequent ones (by hash), then the classes of all others."""

    def __init__(self, frequent: np.ndarray) -> None:
        order = np.argsort(frequent)
        self.hashes, self.ids = frequent[order], order + 2
        self.base = len(frequent) + 2
        self.size = self.base + CLASSES

    def of(self, hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's symbol as a context and as the next symbol."""
        nexts = np.zeros(len(hashes), dtype=np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            nexts = np.where(self.hashes[at] == hashes, self.ids[at], RARE)
        return np.where(nexts == RARE, self.base + classes.astype(np.int64), nexts), nexts


def _hash(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The hash of a context with one more symbol before it (or of a context and its next symbol)."""
    v = (context ^ (symbol.astype(np.uint64) * _Q)) * _P
    return v ^ (v >> np.uint64(29))


def _columns(contexts: np.ndarray, place: np.ndarray, size: int) -> list[np.ndarray]:
    """The symbols one to ``size`` tokens before each token; a text's start stands before its first token, and ``WHOLE``
    before that."""
    at = np.arange(len(contexts))
    out = []
    for n in range(1, size + 1):
        out.append(np.where(place >= n, contexts[np.maximum(at - n, 0)], np.where(place == n - 1, START, WHOLE)))
    return out


def _isin(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values


def walk(columns: list[np.ndarray], first: np.ndarray, known: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: the tokens whose context is known, and the context's hash. ``columns`` are the symbols before the tokens."""
    at = np.arange(len(columns[0])) if columns else np.zeros(0, np.int64)
    h = np.ones(len(at), dtype=np.uint64)
    for n, column in enumerate(columns, 1):
        symbol = column[at]
        live = symbol != WHOLE
        if n == 1:
            live &= first[symbol]
        at, h = at[live], _hash(h[live], symbol[live])
        if n > 1:
            live = _isin(known[n], h)
            at, h = at[live], h[live]
        yield n, at, h


def _texts(tokens: np.ndarray, sizes: np.ndarray, most: int = 200_000) -> Iterator[tuple[slice, slice]]:
    """Runs of whole texts with about ``most`` tokens, as slices of texts and of tokens."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        begin = ends[i] - sizes[i]
        j = max(i + 1, int(np.searchsorted(ends, begin + most, side="right")))
        yield slice(i, j), slice(int(begin), int(ends[j - 1]))
        i = j


def _places(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _opened(batches: Iterator, symbols: Symbols) -> Iterator[tuple]:
    """Chunks with their tokens and their words' symbols: ``(chunk, tokens, hashes, contexts, nexts, ids, sizes)``."""
    for batch in batches:
        for i in range(batch.num_rows):
            chunk, tokens, words, ids, sizes = (batch.column(k)[i].as_py() for k in range(5))
            hashes, classes, _ = unpack(words)
            yield chunk, unpack(tokens)[0], hashes, *symbols.of(hashes, classes), ids, np.array(sizes)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    x = np.sort(x)
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.r_[at, len(x)])


def _count(chunks: DataFrame, symbols: Symbols, first: np.ndarray, known: list[np.ndarray], size: int) -> DataFrame:
    """Counts over the training texts, in one scan: of the symbols next to known contexts of ``size`` (and ``WHOLE``, all
    of them), and (``longer``) of contexts one longer both of whose shorter parts are known; of size 0: of rare words'
    classes. ``parent`` is the shorter context's hash."""
    shipped = chunks.sparkSession.sparkContext.broadcast((symbols, first, known))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        symbols, first, known = shipped.value
        span_of = symbols.size + 2  # symbols, and two below them
        for _, tokens, _, contexts, nexts, ids, sizes in _opened(batches, symbols):
            train, pairs, longer = np.array([crc_mod(d, 10) != 0 for d in ids], dtype=bool), [], []
            for docs, span in _texts(tokens, sizes):
                part = tokens[span][np.repeat(train[docs], sizes[docs])]
                if not len(part):
                    continue
                if not size:
                    pairs.append(contexts[part[nexts[part] == RARE]])
                    continue
                columns = _columns(contexts[part], _places(sizes[docs][train[docs]]), size + 1)
                for n, at, h in walk(columns[:size], first, known):  # noqa: B007  the last one counts
                    pass
                number = np.searchsorted(known[size], h) * span_of
                pairs.append(number + nexts[part[at]])
                if size < DEPTH:  # the context one token earlier has to be known too
                    have = np.zeros(len(part), dtype=bool)
                    have[at] = True
                    both = (columns[size][at] != WHOLE) & have[at - 1]
                    longer.append(number[both] + columns[size][at[both]])
            if not pairs:
                continue
            keys, n = _numbered(np.concatenate(pairs))
            if not size:
                yield _tally(pa, False, np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64), keys, n)
                continue
            number, symbol = keys // span_of, keys % span_of
            whole = np.bincount(number, n, len(known[size])).astype(np.int64)
            seen = np.flatnonzero(whole)
            yield _tally(pa, False, known[size][np.r_[number, seen]], np.zeros(len(number) + len(seen), np.uint64), np.r_[symbol, np.full(len(seen), WHOLE)], np.r_[n, whole[seen]])
            if longer:
                keys, n = _numbered(np.concatenate(longer))
                parent = known[size][keys // span_of]
                yield _tally(pa, True, _hash(parent, keys % span_of), parent, np.zeros(len(keys), np.int64), n)

    rows = chunks.select("chunk", "tokens", "words", "ids", "sizes").mapInArrow(run, "longer boolean, context long, parent long, symbol long, n long")
    return rows.groupBy("longer", "context", "parent", "symbol").agg(F.sum("n").alias("n"))


def _tally(pa, longer: bool, context: np.ndarray, parent: np.ndarray, symbol: np.ndarray, n: np.ndarray):
    columns = (np.full(len(context), longer), context.view(np.int64), parent.view(np.int64), symbol.astype(np.int64), n.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["longer", "context", "parent", "symbol", "n"])


class SuffixTree:
    """The crown: states as sorted arrays, what they keep for the shorter state, and their shares of next symbols."""

    def __init__(self, symbols: Symbols, root: np.ndarray, unknown: float, discount: float, total: int) -> None:
        self.symbols, self.root, self.unknown, self.discount, self.total = symbols, root, unknown, discount, total
        self.states, self.rest, self.up = [np.zeros(0, np.uint64)], [np.zeros(0)], [None]
        self.pairs, self.share = [np.zeros(0, np.uint64)], [np.zeros(0)]
        self.first, self.known = np.zeros(symbols.size, dtype=bool), [np.ones(1, np.uint64)]

    def climb(self, p: np.ndarray, size: int, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Probabilities with states of ``size`` taken in, given those by shorter states."""
        states, pairs = self.states[size], self.pairs[size]
        if not len(states):
            return p
        place = np.minimum(np.searchsorted(states, context), len(states) - 1)
        live = np.flatnonzero(states[place] == context)
        key = _hash(context[live], symbol[live])
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        share = np.where(pairs[at] == key, self.share[size][at], 0.0)
        p = p.copy()
        p[live] = share + self.rest[size][place[live]] * p[live]
        return p

    def below(self, size: int, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Probabilities of symbols after contexts of one size, by the states up to that size."""
        if not size:
            return self.root[symbol]
        ids, parents = self.up[size]
        at = np.minimum(np.searchsorted(ids, context), len(ids) - 1)
        parent = np.where(ids[at] == context, parents[at], np.uint64(0))
        return self.climb(self.below(size - 1, parent, symbol), size, context, symbol)

    def add(self, size: int, context: np.ndarray, parent: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> None:
        """States of one size from their counts: whole counts, and those of frequent next symbols."""
        whole = symbol == WHOLE
        order = np.argsort(context[whole])
        ids, mass = context[whole][order], n[whole][order]
        self.up.append((ids, parent[whole][order]))
        context, parent, symbol, n = context[~whole], parent[~whole], symbol[~whole], n[~whole]
        back = np.searchsorted(ids, context)
        lower = np.maximum(self.below(size - 1, parent, symbol), 1e-12)
        total = lambda x: np.bincount(back, weights=x, minlength=len(ids))
        left, left_lower = np.maximum(mass - total(n), 0), np.maximum(1 - total(lower), 1e-9)
        gain = total(n * np.log(n / mass[back] / lower)) + left * np.log(np.maximum(left, 1e-9) / mass / left_lower)
        kept = (gain > 0.5 * np.bincount(back, minlength=len(ids)) * np.log(mass)) & (total(n) > 0)
        share = np.maximum(n - DISCOUNT, 0) / mass[back]
        rest, rows = 1 - total(share), kept[back]
        key = _hash(context[rows], symbol[rows])
        order = np.argsort(key)
        self.states.append(ids[kept])
        self.rest.append(rest[kept])
        self.pairs.append(key[order])
        self.share.append(share[rows][order])

    def symbol_shares(self, columns: list[np.ndarray], nexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each next symbol after the symbols of ``columns``, and how many of the contexts the crown holds."""
        p, depth = self.root[nexts], np.zeros(len(nexts), np.int8)
        for size, at, h in walk(columns[: len(self.states) - 1], self.first, self.known):
            p[at] = self.climb(p[at], size, h, nexts[at])
            depth[at] = size
        return p, depth

    def beyond(self, columns: list[np.ndarray]) -> np.ndarray:
        """The hash of each token's shortest context that the crown doesn't hold; 0 if it holds all of them."""
        out = _hash(np.ones(len(columns[0]), np.uint64), columns[0])
        for size, at, h in walk(columns[: len(self.states) - 1], self.first, self.known):
            out[at] = np.where(columns[size][at] == WHOLE, 0, _hash(h, columns[size][at])) if size < DEPTH else 0
        return out

    def own_share(self, nexts: np.ndarray, c: np.ndarray) -> np.ndarray:
        """What a rare word has of the rare symbol by its training count ``c``; one for the others."""
        own = np.where(c > 0, (c - self.discount) / max(self.total, 1), self.unknown)
        return np.where(nexts == RARE, own / self.root[RARE], 1.0)


def train(chunks: DataFrame, vocab: DataFrame, total: int, bounds: Bounds = Bounds()) -> tuple[SuffixTree, int]:
    """The crown from all training texts of ``total`` tokens, and the number of distinct training tokens. What reaches
    the driver is bounded by the least shares, whatever the corpus."""
    kinds, once, twice = vocab.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("kinds", "once", "twice")]).first()
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    frequent = sorted((-n, h) for r in vocab.where("words is not null").select("words", "uses").toLocalIterator() for h, n in zip(r["words"], r["uses"], strict=True)) if total else []
    symbols = Symbols(np.array([h for _, h in frequent], np.int64).view(np.uint64))
    root = np.zeros(len(frequent) + 2)
    root[2:] = [(-n - discount) / total for n, _ in frequent]
    # the unknown word's share; without any training text it is all there is
    unknown = discount * kinds / total if total else 1.0
    root[RARE] = max(1 - root.sum(), unknown, 1e-9)
    tree = SuffixTree(symbols, root, unknown, discount, total)
    if not total:
        return tree, kinds
    least = max(bounds.least, bounds.share * total)
    classes = _count(chunks, symbols, tree.first, tree.known, 0).where(F.col("n") >= least).select("symbol").collect()
    first = np.array([i + 2 for i, (n, _) in enumerate(frequent) if -n >= least] + [r["symbol"] for r in classes] + [START])
    tree.first[first] = True
    known, parents = [*tree.known, np.unique(_hash(np.ones(len(first), np.uint64), first))], np.ones(len(first), np.uint64)
    for size in range(1, DEPTH + 1):
        if not len(known[size]):
            break
        # contexts and frequent symbols are bounded in number by their shares, so the rows are
        enough = F.when(F.col("longer"), F.col("n") >= least).otherwise((F.col("n") >= (1 if bounds.every else max(2, least / 50))) | (F.col("symbol") == WHOLE))
        rows = _count(chunks, symbols, tree.first, known, size).where(enough).toPandas()
        pairs, longer = rows[~rows["longer"].astype(bool)], rows[rows["longer"].astype(bool)]
        context = pairs["context"].to_numpy().view(np.uint64)
        tree.add(size, context, parents[np.searchsorted(known[size], context)], pairs["symbol"].to_numpy(), pairs["n"].to_numpy(dtype=float))
        tree.known = known[: size + 1]
        more, at = np.unique(longer["context"].to_numpy().view(np.uint64), return_index=True)
        known.append(more)
        parents = longer["parent"].to_numpy().view(np.uint64)[at]
    return tree, kinds


def grow(p: np.ndarray, word: np.ndarray, before: list[np.ndarray], nexts: np.ndarray, train: np.ndarray, held: np.ndarray, least: int) -> np.ndarray:
    """Probabilities with branches taken in, given those of the crown.

    A token's contexts are its last ``word``, with one symbol ``before`` it, with two; the first ``held`` of them are left
    out, for the crown holds them. A context becomes a state if it is seen ``least`` times in training and its training
    tokens gain more than its symbols cost; it is smoothed towards ``p``.
    """
    p, span_of = p.copy(), int(nexts.max(initial=0)) + 1
    at, number = np.arange(len(p)), word
    for level in range(len(before) + 1):
        if level:
            some = before[level - 1][at] >= 0
            at = at[some]
            number = number[some] * (1 << 17) + before[level - 1][at]
        groups, g = np.unique(number, return_inverse=True)
        mass = np.bincount(g, train[at], len(groups))
        ours = held[at] <= level
        # a context within one that is too rare is too rare itself
        some = (mass[g] >= least) | ~ours
        at, number, ours = at[some], g[some], ours[some]
        own, g = at[ours], number[ours]
        pairs, pair = np.unique(g * span_of + nexts[own], return_inverse=True)
        learn = train[own]
        n, owner = np.bincount(pair, learn, len(pairs)), pairs // span_of
        share = np.maximum(n - DISCOUNT, 0) / np.maximum(mass[owner], 1)
        kept_for = 1 - np.bincount(owner, share, len(groups))
        seen = np.flatnonzero(learn)
        gain = np.bincount(g[seen], np.log(n[pair[seen]] / mass[g[seen]] / p[own[seen]]), len(groups))
        state = gain > 0.5 * np.bincount(owner, n > 0, len(groups)) * np.log(np.maximum(mass, 1))
        live = state[g]
        g, pair, own = g[live], pair[live], own[live]
        p[own] = share[pair] + kept_for[g] * p[own]
    return p


def text_scores(docs: DataFrame, bounds: Bounds = EVERY) -> DataFrame:
    """Scores of each document, learning from those whose ``crc32(doc_id) mod 10`` isn't 0.

    ``score`` is the tree's log10 probability of the text, ``base_score`` that of smoothed word counts.
    Null text counts as empty (one token, the end); very long texts are scored whole; each row is answered and
    counted, repeated rows too; contexts of equal count are all kept or all dropped; a null id counts as the
    text ``null`` for the split; extra columns don't matter; an empty table gives no rows; without training
    documents both scores come from smoothing alone.
    """
    spark = docs.sparkSession
    chunks = chunk_table(docs, bounds)
    total, tokens = chunks.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    units = max(1, -(-tokens // bounds.unit_tokens))
    vocab, place = vocabulary(chunks, units, total, bounds)
    crown, kinds = train(chunks, vocab, total, bounds)
    folder = write_parts(vocab.select("chunk", F.col("counts").alias("part")), "counts", 4 * units)
    drop_path(spark, place)
    tree = spark.sparkContext.broadcast(crown)
    grown = ""
    opened = chunks.select("chunk", "tokens", "words", "ids", "sizes")

    def families(model: SuffixTree, hashes: np.ndarray, contexts: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether contexts that end in a word have branches, whether those are the word's own (and not shared by the
        words of its symbol that have none), and the hash of whom they belong to."""
        own = (contexts >= model.symbols.base) & (c >= bounds.least)
        return own | (bounds.every and total > 0), own, np.where(own, hashes, _hash(np.ones(len(contexts), np.uint64), contexts))

    def spans(model: SuffixTree, tokens: np.ndarray, sizes: np.ndarray, words: tuple, contexts: np.ndarray, c: np.ndarray) -> Iterator[tuple]:
        """Runs of texts: ``(texts, tokens, columns, key)``. ``key`` deals the tokens that are scored by branches and is 0
        for the others."""
        branch, own, family = words
        heavy = own & (c > bounds.unit_tokens) & (not bounds.every)
        for docs, span in _texts(tokens, sizes):
            part, place = tokens[span], _places(sizes[docs])
            columns = _columns(contexts[part], place, DEPTH)
            last = part[np.maximum(np.arange(len(part)) - 1, 0)]
            key = np.where(heavy[last], _hash(family[last], columns[1]), family[last])
            if bounds.every:
                key = np.where(own[last], key, model.beyond(columns))
            yield docs, part, columns, np.where(branch[last] & (place > 0), key, 0)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = tree.value
        for chunk, tokens, hashes, contexts, nexts, ids, sizes in _opened(batches, model.symbols):
            c = read_counts(folder, chunk, hashes, units)
            base, own = np.log10((c + 0.1) / (total + 0.1 * (kinds + 1))), np.log10(model.own_share(nexts, c))
            sums = []
            for docs, part, columns, key in spans(model, tokens, sizes, families(model, hashes, contexts, c), contexts, c):
                found, at = own[part], np.flatnonzero(key == 0)
                found[at] += np.log10(model.symbol_shares([x[at] for x in columns], nexts[part[at]])[0])
                starts = np.cumsum(sizes[docs]) - sizes[docs]
                sums.append([np.add.reduceat(x, starts) for x in ((c[part] > 0).astype(np.int64), base[part], found)])
            known, base, found = (np.concatenate(x) for x in zip(*sums, strict=True))
            for part in read_parts(grown, chunk) if total else []:
                docs, more = unpack(part)
                found[docs] += more
            columns = [ids, [crc_mod(d, 10) == 0 for d in ids], sizes, known, np.full(len(ids), total), base, found]
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def emit(batches: Iterator) -> Iterator:
        """Tokens that are scored by branches, dealt by key: whose branches they are, and of each token its family, the
        two symbols before its last word, the next symbol and its document (twice its number, and one for training)."""
        import pyarrow as pa

        model = tree.value
        for chunk, tokens, hashes, contexts, nexts, ids, sizes in _opened(batches, model.symbols):
            c = read_counts(folder, chunk, hashes, units)
            words = branch, own, family = families(model, hashes, contexts, c)
            heavy = own & (c > bounds.unit_tokens) & (not bounds.every)
            kinds_here, local = np.unique(family, return_inverse=True)
            first, held = np.zeros(len(kinds_here), np.int64), np.zeros(len(kinds_here), np.int64)
            first[local], held[local] = contexts, np.where(own, np.where(heavy, 1, 0), 2)
            local, doc = local.astype(np.uint32), np.repeat(np.arange(len(ids)), sizes)
            mark = 2 * doc + np.array([crc_mod(d, 10) != 0 for d in ids], dtype=bool)[doc]
            taken, at, small = [], 0, np.min_scalar_type(model.symbols.size + 1)
            for _, part, columns, key in spans(model, tokens, sizes, words, contexts, c):
                rows = np.flatnonzero(key)
                taken.append((_unit(key[rows], units), local[part[rows - 1]], *((x[rows] + 1).astype(small) for x in columns[1:]), nexts[part[rows]].astype(small), mark[at + rows].astype(np.uint32)))
                at += len(part)
            unit, *columns = (np.concatenate(x) for x in zip(*taken, strict=True))
            if not len(unit):
                continue
            order = np.argsort(columns[0], kind="stable")
            columns = [x[order] for x in columns]
            for u, rows in by_unit(unit[order]):
                mine = columns[0][rows]
                starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                some = mine[starts]
                part = pack(kinds_here[some], (4 * first[some] + held[some]).astype(np.int32), np.diff(np.r_[starts, len(mine)]).astype(np.uint32), *(x[rows] for x in columns[1:]))
                yield pa.RecordBatch.from_arrays([pa.array([u]), pa.array([chunk]), pa.array([part])], ["unit", "chunk", "part"])

    def finish(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = tree.value
        for _, rows in grouped(batches, 3):
            parts = [unpack(part) for _, part in rows]
            names, family = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
            kind = np.zeros(len(names), np.int64)
            kind[family] = np.concatenate([x[1] for x in parts])
            family = np.repeat(family.astype(np.uint32), np.concatenate([x[2] for x in parts]))
            second, third, nexts, mark = (np.concatenate([x[k] for x in parts]) for k in range(3, 7))
            chunks_of = [(chunk, len(x[3])) for (chunk, _), x in zip(rows, parts, strict=True)]
            del parts, rows
            order, found = np.argsort(family, kind="stable"), np.empty(len(family))
            ends = np.cumsum(np.bincount(family, minlength=len(names)))
            # runs of whole families
            for run, span in _texts(np.empty(0), np.diff(np.r_[0, ends]), STEP):
                at = order[span]
                word, symbols = family[at].astype(np.int64) - run.start, [x[at].astype(np.int64) for x in (second, third, nexts)]
                before, follow = [symbols[0] - 1, symbols[1] - 1], symbols[2]
                first = kind[run][word]
                p, depth = model.symbol_shares([first // 4, *before], follow)
                held = np.where(first % 4 == 2, depth, first % 4)
                found[at] = np.log10(grow(p, word, before, follow, mark[at] % 2 == 1, held, bounds.least))
            at = 0
            for chunk, n in chunks_of:
                docs, back = np.unique(mark[at : at + n] // 2, return_inverse=True)
                sums = np.bincount(back, found[at : at + n], len(docs))
                at += n
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "part": [pack(docs.astype(np.uint32), sums)]})

    if total:
        dealt = opened.mapInArrow(emit, "unit long, chunk long, part binary").repartition(4 * units, "unit").sortWithinPartitions("unit", "chunk")
        grown = write_parts(dealt.mapInArrow(finish, "chunk long, part binary"), "branches", 4 * units)
    return opened.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
