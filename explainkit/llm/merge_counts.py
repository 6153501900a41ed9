"""Token counts of byte-level merge vocabularies by rank-synchronous array merging.

Pre-tokens that a worker hasn't met are laid out as one ragged array of symbol ids. In each round
every sequence finds the lowest rank among its adjacent pairs, and all sequences apply their own
lowest pair at the same time; sequences without a pair are done. What counts is how many symbols
survive. A merge's result can only take part in merges of higher rank, so applying every occurrence
of the pair within the round gives the library's result.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame

from explainkit.llm.common import WHITE, Words, id_and_text, map_rows, part_text

_NONE = np.int64(2**62)
#: Symbols laid out at once.
LAYOUT = 400_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(moved)) for b in range(256)]


class RankMerger:
    """Counts tokens for a ``.json`` byte-level BPE file."""

    def __init__(self, path: str) -> None:
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level BPE files are supported")
        self.special = [x["content"] for x in spec["added_tokens"]]
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[c] for c in byte_alphabet()], dtype=np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.special_split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def survivors(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols that survive all merges, for each byte string."""
        counts = np.zeros(len(pieces), dtype=np.int64)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        at = 0
        while at < len(order):  # similar lengths together, so a layout ends in few rounds
            end, load = at, 0
            while end < len(order) and (load == 0 or load + len(pieces[order[end]]) <= LAYOUT):
                load += len(pieces[order[end]])
                end += 1
            ids = order[at:end]
            counts[ids] = self._merge([pieces[i] for i in ids])
            at = end
        return counts

    def _merge(self, pieces: list[bytes]) -> np.ndarray:
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        counts = lengths.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        while len(symbols) > 1:
            key = symbols[:-1] * self.size + symbols[1:]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[found] == key) & (owner[:-1] == owner[1:])
            rank = np.where(known, self.ranks[found], _NONE)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, _NONE], starts)
            which = np.repeat(lowest, np.diff(np.r_[starts, len(symbols)]))[:-1]
            hit = known & (rank == which)
            if not hit.any():
                break
            # overlapping occurrences (a a a): the first, third, ... of a run merge
            places = np.flatnonzero(hit)
            new_run = np.r_[True, np.diff(places) > 1]
            first = places[new_run][np.cumsum(new_run) - 1]
            places = places[(places - first) % 2 == 0]
            symbols[places] = self.made[found[places]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
            # finished sequences leave the layout
            alive = np.repeat(lowest < _NONE, np.diff(np.r_[starts, len(keep)]))[keep]
            if not alive.all():
                done = owner[~alive]
                ids, left = np.unique(done, return_counts=True)
                counts[ids] = left
                symbols, owner = symbols[alive], owner[alive]
        ids, left = np.unique(owner, return_counts=True)
        counts[ids] = left
        return counts

    def count_new(self, chunks: list[str]) -> list[int]:
        """Tokens of each chunk, by its pre-tokens."""
        seen: dict[str, int] = {}
        lists = []
        for chunk in chunks:
            lists.append([seen.setdefault(p, len(seen)) for p in self.split.findall(chunk)])
        counts = self.survivors([p.encode("utf-8", "surrogatepass") for p in seen]).tolist()
        return [sum(counts[i] for i in ids) for ids in lists]


    def count_keys(self, keys: list[str], parts: list[str]) -> tuple[list[int], list[int]]:
        counts = self.count_new([*map(part_text, keys), *parts])
        return counts[: len(keys)], counts[len(keys) :]


_state: dict[str, tuple] = {}


def count_texts(path: str, texts: list[str | None]) -> list[int]:
    """Token counts of whole texts; null counts as empty. Special strings inside count as one token."""
    if path not in _state:
        merger = RankMerger(path)
        _state[path] = (merger, Words(merger.count_keys))
    merger, words = _state[path]
    runs = [merger.special_split.split(t) if merger.special_split and any(s in t for s in merger.special) else [t] for t in (t or "" for t in texts)]
    counts = iter([sum(v) for v in words.values([r for some in runs for r in some])])
    return [len(some) - 1 + sum(next(counts) for _ in some) for some in runs]


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Per document: UTF-8 bytes, tokens, and whether the tokens pass ``limit``.

    ``.json`` files count by array merging; ``.model`` files by the piece encoder. Null text counts as
    empty (0 bytes, 0 tokens); each row is answered, repeated rows too; null ids stay null; extra
    columns don't matter; an empty table gives no rows. No shuffle: memory is bounded by a slice of rows.
    """

    def work(cols: list[list]) -> list[list]:
        ids, texts = cols
        if path.endswith(".model"):
            from explainkit.llm.pieces import count_texts as count
        else:
            count = count_texts
        tokens = count(path, texts)
        return [ids, [len((t or "").encode("utf-8", "surrogatepass")) for t in texts], tokens, [n > limit for n in tokens]]

    return map_rows(id_and_text(docs), ["doc_id", "text"], work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
