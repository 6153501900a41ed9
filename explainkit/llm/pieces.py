"""Piece encoding and decoding with a merge-type prefix table.

For merge vocabularies the encoding of every prefix ends in exactly one token. An automaton over all
pieces gives the pieces that end at a position; a candidate is the prefix's last token if, beside the
last token of the prefix before it, the two come out unchanged when merged together. That table is
filled left to right, and the ids are read from its end backwards. White space only leads a piece, so
texts are cut before it, and around line breaks where no piece holds one; a worker keeps the ids of short
units. Characters outside the pieces fall back to bytes.
"""

from __future__ import annotations

import hashlib
import re
from itertools import compress

from pyspark.sql import DataFrame

from explainkit.llm.common import Memo, id_and_text, map_rows, uncollected

SPACE = "▁"
#: Stands before what follows a line break.
LINE = "\x01"
#: No token; pair tests kept by a worker (about 130 bytes each); characters of a unit that is kept.
NONE, FITS, KEPT = -1, 800_000, 64
#: Bytes that a worker's kept units may take, and what one takes beside its characters.
UNIT_BYTES, ENTRY = 160_000_000, 200


class PieceCoder:
    """Encodes and decodes like the library does for a merge-type model with byte fallback."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece.sentencepiece_model_pb2 if hasattr(sentencepiece, "sentencepiece_model_pb2") else None
        if spec is None:
            from sentencepiece import sentencepiece_model_pb2 as spec
        proto = spec.ModelProto()
        proto.ParseFromString(model.serialized_model_proto())
        norm, kinds = proto.normalizer_spec, spec.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != spec.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only merge-type models without normalisation are supported")
        self.end = proto.trainer_spec.eos_id
        self.unknown, self.byte_of, self.byte_id = proto.trainer_spec.unk_id, {}, {}
        self.pieces: list[str] = []
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.silent: set[int] = set()
        for i, p in enumerate(proto.pieces):
            self.pieces.append(p.piece)
            if p.type == kinds.NORMAL:
                self.ids[p.piece], self.rank[p.piece] = i, p.score
                if SPACE in p.piece.lstrip(SPACE):
                    raise ValueError("white space inside a piece")
            elif p.type == kinds.BYTE:
                self.byte_of[i] = int(p.piece[1:-1], 16)
                self.byte_id[self.byte_of[i]] = i
            elif p.type == kinds.CONTROL:
                self.silent.add(i)
            elif p.type != kinds.UNKNOWN:
                raise ValueError("only normal, byte, control and unknown pieces are supported")
        if len(self.byte_id) != 256:
            raise ValueError("a model with byte fallback is needed")
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.lines = not any("\n" in p for p in self.ids)
        if self.lines:
            self.cut = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.sizes = [len(p) for p in self.pieces]
        self.fits: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Plain greedy merging, for texts of two pieces at most."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, before: int, piece: int) -> bool:
        """Whether two neighbouring tokens stay as they are when merged together.

        Tokens are ids; ``NONE`` stands before a text, and below it are characters outside the pieces.
        """
        first = "" if before == NONE else self.pieces[before] if before >= 0 else chr(NONE - 1 - before)
        second = self.pieces[piece]
        return self.merged(first + second) == ([first, second] if first else [second])

    def fit(self, before: int, piece: int) -> bool:
        """:meth:`compatible`, kept."""
        key, fits = before << 20 | piece, self.fits
        known = fits.get(key)
        if known is None:
            if len(fits) > FITS:
                fits.clear()
            known = fits[key] = self.compatible(before, piece)
        return known

    def last_tokens(self, unit: str) -> list[int]:
        """The last token of each prefix."""
        last, sizes, fits = [NONE] * len(unit), self.sizes, self.fits
        for end, piece in self.automaton.iter(unit):
            if last[end] != NONE:
                continue
            start = end - sizes[piece]
            before = NONE
            if start >= 0:
                before = last[start]
                if before == NONE:  # no piece ends there: the character stands alone
                    before = last[start] = NONE - 1 - ord(unit[start])
            known = fits.get(before << 20 | piece)
            if known or known is None and self.fit(before, piece):
                last[end] = piece
        return last

    def unit_ids(self, unit: str) -> list[int]:
        """Ids of a unit, recovered from the end of its table."""
        last, sizes, out, at = self.last_tokens(unit), self.sizes, [], len(unit) - 1
        while at >= 0:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= sizes[token]
            else:
                out += [self.byte_id[b] for b in reversed(unit[at].encode("utf-8", "surrogatepass"))]
                at -= 1
        return out[::-1]

    def units(self, text: str) -> list[str]:
        """The text with its leading mark, cut before each run of white space (and around line breaks)."""
        return self.cut.findall(SPACE + text.replace(" ", SPACE))

    def parts(self, text: str) -> list[str] | None:
        """Keys of the units of a text without special cases: a unit without its leading mark, a line break, or
        ``LINE`` and a unit that follows a line break. ``None``: the text holds ``LINE`` itself."""
        if LINE in text:
            return None
        return (text.replace("\n", f" \n {LINE}") if self.lines else text).split(" ")

    def encode(self, text: str, end: bool = True) -> list[int]:
        """Ids of a text, closed with the end id."""
        out = [i for u in self.units(text) for i in self.unit_ids(u)] if text else []
        return out + [self.end] if end else out

    def surface(self, ids: list[int]) -> str:
        """The text of ids, with white space marks turned back; the mark before a text remains."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_bytes_text(bytes(run)))
                run.clear()
            if i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(_bytes_text(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The library's decode: the mark that encoding puts first goes again."""
        text = self.surface(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and first not in self.byte_of and self.pieces[first].startswith(SPACE) else text


def _bytes_text(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that doesn't belong."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Units(Memo):
    """A worker's ids of units, as decimal ids each followed by a space, by :meth:`PieceCoder.parts` key.

    What is kept is bounded in bytes, and long units aren't kept. ``own`` holds units by themselves, for texts
    with runs of white space; ``other`` holds the surfaces of units that don't spell like their text.
    """

    def __init__(self, coder: PieceCoder) -> None:
        super().__init__()
        self.coder, self.own, self.other = coder, {}, {}
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.own.clear()
        self.other.clear()
        self.chars = 0
        if self.coder.lines:
            self["\n"] = self.written(self.coder.unit_ids("\n"))
            self[LINE] = ""

    @staticmethod
    def written(ids: list[int]) -> str:
        return " ".join(map(str, ids)) + " "

    def unit(self, unit: str) -> str:
        """Ids of a unit; its surface is checked, by decoding the ids."""
        coder = self.coder
        ids = coder.unit_ids(unit)
        if "".join([coder.pieces[i] for i in ids]) != unit and (surface := coder.surface(ids)) != unit.replace(SPACE, " "):
            self.other[unit] = surface
        return self.written(ids)

    def learn(self, parts: set[str]) -> dict[str, str]:
        """Ids of parts that aren't kept. A trailing mark is added to its stem's table where the two stay apart,
        as the prefix table has it. Long parts are returned only."""
        coder, marks, load, found = self.coder, self.coder.ids, 0, {}
        for part in parts:
            last = part[-1]
            if not last.isalnum() and (known := self.get(part[:-1])) and (mark := marks.get(last)) is not None:
                tail = int(known[known.rfind(" ", 0, -1) + 1 : -1])
                if tail not in coder.byte_of and coder.fit(tail, mark) and not self.other:
                    self[part] = f"{known}{mark} "
                    load += 2 * len(part) + 5 * len(known) // 4 + ENTRY
                    continue
            ids = self.unit(part[1:] if part[0] == LINE else SPACE + part)
            if len(part) <= KEPT:
                self[part] = ids
                load += 2 * len(part) + len(ids) + ENTRY
            else:
                found[part] = ids
        self.chars += load
        return found

    @uncollected
    def ids(self, texts: list[str | None]) -> list[str]:
        """Each text's ids, written."""
        self.touch()
        if self.chars > UNIT_BYTES:
            self.clear()
        coder, get, plans, missing = self.coder, self.get, [], set()
        for text in texts:
            parts = coder.parts(text) if text else None
            found, gaps = [*map(get, parts)] if parts else [], ()
            if None in found:
                gaps = [*compress(range(len(found)), [v is None for v in found])]
                new = [parts[i] for i in gaps]
                if "" in new or any(SPACE in p for p in new):
                    parts = None
                else:
                    missing.update(new)
            plans.append((parts, found, gaps))
        long = self.learn(missing)
        out = []
        for text, (parts, found, gaps) in zip(texts, plans, strict=True):
            if parts is None:
                out.append("".join(map(self.whole, coder.units(text))) if text else "")
                continue
            for i in gaps:
                found[i] = get(parts[i]) or long[parts[i]]
            out.append("".join(found))
        return out

    def whole(self, unit: str) -> str:
        known = self.own.get(unit)
        if known is None:
            known = self.unit(unit)
            if len(unit) <= KEPT:
                self.own[unit] = known
                self.chars += 2 * len(unit) + len(known) + ENTRY
        return known


_state: dict[str, Units] = {}


def kept_units(path: str) -> Units:
    if path not in _state:
        _state[path] = Units(PieceCoder(path))
    return _state[path]


def encode_digests(path: str, texts: list[str | None]) -> list[list]:
    """For each text: number of ids, hash of the ids, hash of the decoded text."""
    memo = kept_units(path)
    coder, written = memo.coder, memo.ids(texts)
    sizes, ids_hash, text_hash, tail = [], [], [], str(coder.end)
    for text, ids in zip(texts, written, strict=True):
        ids += tail
        if memo.other:
            decoded = coder.decode([int(x) for x in ids.split(" ")])
        else:  # every unit's ids were decoded when it was learned, and spelled the unit
            decoded = (text or "").replace(SPACE, " ")
        sizes.append(ids.count(" ") + 1)
        ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
        text_hash.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
    return [sizes, ids_hash, text_hash]


def encode_texts(path: str, texts: list[str | None]) -> list[list[int]]:
    """Ids of each text, with the end id."""
    memo = kept_units(path)
    return [[*map(int, ids.split()), memo.coder.end] for ids in memo.ids(texts)]


def count_texts(path: str, texts: list[str | None]) -> list[int]:
    """Number of ids of each text, without an end id."""
    return [ids.count(" ") for ids in kept_units(path).ids(texts)]


def piece_ids(docs: DataFrame, path: str) -> DataFrame:
    """Per document: ``ids`` (closed with the end id) and ``decoded`` text.

    Null text counts as empty and gives the end id alone; every row is answered, repeated rows too;
    null ids stay null; extra columns don't matter; an empty table gives no rows. Merges of equal score go
    left to right. Very long texts and units are encoded whole; long units aren't kept by the worker. Runs
    without a shuffle, a slice of rows at a time.
    """

    def work(cols: list[list]) -> list[list]:
        ids, texts = cols
        found = encode_texts(path, texts)
        coder = kept_units(path).coder
        return [ids, found, [coder.decode(f) for f in found]]

    return map_rows(id_and_text(docs), ["doc_id", "text"], work, "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """As :func:`piece_ids`, odd rows included, with SHA-256 digests in place of the ids and the decoded text."""

    def work(cols: list[list]) -> list[list]:
        return [cols[0], *encode_digests(path, cols[1])]

    return map_rows(id_and_text(docs), ["doc_id", "text"], work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
