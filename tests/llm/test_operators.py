"""Operators against brute force, the tokenizer libraries and planted cases, odd rows included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import public_tokenizers
from explainkit.llm import containment, html_blocks, merge_counts, passages, pieces, quality, simhash, sstable, suffix_tree, toxicity

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, n_words array<int>, h string"


def words_of(rng, n):
    return " ".join(rng.choice(["th", "er", "on", "an", "re", "ti", "es", "in", "ou", "éa", "ß"]) * rng.randint(1, 2) + rng.choice(["", "ing", "ed", "s", ".", ","]) for _ in range(n))


def corpus():
    """Plain, odd and copied texts; an extra column has a name that operators use inside."""
    rng = random.Random(5)
    texts = [words_of(rng, rng.choice([3, 30, 120, 300])) for _ in range(60)]
    long_text = words_of(rng, 4000)
    texts += [None, "", " \n\t ", "one", "one two three four", "a\x00b \x1c \x85 c", "▁▁ x  y\n\n z", "<|endoftext|> a <|endoftext|>", "<s></s> <0x0A>", "日本語 のテキスト 🙂 ქართული", "x" * 30000, long_text, long_text, long_text + " end"]
    near = texts[5].split(" ")
    near[3:4] = ["changed"]
    texts += [" ".join(near), texts[7], texts[7], texts[7]]
    passage = words_of(random.Random(77), 70)
    texts += [words_of(rng, 40) + " " + passage + " " + words_of(rng, 40) for _ in range(4)]
    fuzzy = passage.split(" ")
    fuzzy[20] = "other"
    fuzzy[45:46] = []
    texts.append(words_of(rng, 30) + " " + " ".join(fuzzy) + " " + words_of(rng, 30))
    return [(i, t, rng.choice(["en", "de", None]), "hot" if i % 3 else None, len(t or ""), [1], "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def repeated(spark, rows):
    """A null id and a row given twice."""
    return spark.createDataFrame([(None, *rows[0][1:]), rows[3], rows[3]], SCHEMA)


def test_pieces_match_library(docs, rows, empty, repeated):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = {r["doc_id"]: r for r in pieces.piece_digests(docs, PIECES).collect()}
    full = {r["doc_id"]: r for r in pieces.piece_ids(docs, PIECES).collect()}
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_eos=True)
        assert full[doc_id]["ids"] == ids
        assert full[doc_id]["decoded"] == library.decode(ids)
        r = found[doc_id]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.piece_digests(empty, PIECES).count() == 0
    assert pieces.piece_digests(repeated, PIECES).count() == 3


def test_piece_table_on_random_units():
    import sentencepiece

    library, coder, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.PieceCoder(PIECES), random.Random(3)
    parts = ["the", "in", "g", "ing", "er", "▁", " ", "  ", "x", "qu", "tion", "an", "é", "日", "\n", "1", "00", "🙂"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert coder.encode(text, end=False) == library.encode(text), text
        ids = [rng.randrange(32000) for _ in range(rng.randint(0, 12))]
        ids = [i for i in ids if i > 2]
        assert coder.decode(coder.encode(text)) == library.decode(library.encode(text))


def test_kept_units_match_library(monkeypatch):
    """Texts of words, line breaks, runs of white space and control characters, with the worker's units kept or let go."""
    import sentencepiece

    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(6)
    parts = ["the", "thing", "é", "x.", "--", ",", "▁", "日本", "🙂", "\x01", "\r", "y" * 70, "</s>", "<0x0A>"]
    gaps = [" ", " ", " ", "\n", "\n", "  ", " \n", "\n ", "\n\n", "\t", "", "▁", "\x01"]
    texts = ["".join(rng.choice(parts) + rng.choice(gaps[: rng.choice([5, 13])]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for limit in (10**9, 2000):
        monkeypatch.setattr(pieces, "UNIT_BYTES", limit)
        for at in range(0, len(texts), 100):
            some = texts[at : at + 100]
            want = [library.encode(t) for t in some]
            assert pieces.count_texts(PIECES, some) == [*map(len, want)]
            sizes, ids_hash, text_hash = pieces.encode_digests(PIECES, some)
            for n, a, b, ids in zip(sizes, ids_hash, text_hash, want):
                ids.append(2)
                assert (n, a, b) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    memo = pieces.kept_units(PIECES)
    monkeypatch.setattr(pieces, "UNIT_BYTES", 10**9)
    memo.clear()
    pieces.count_texts(PIECES, ["z" * 20_000 + str(i) for i in range(20)])
    assert sum(map(len, memo)) < 100 and memo.chars < 10_000


def test_merge_counts_match_library(docs, rows, empty, repeated):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    found = {r["doc_id"]: r for r in merge_counts.token_counts(docs, BYTES, limit=100).collect()}
    for doc_id, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        r = found[doc_id]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text or "").encode()), n, n > 100)
    assert merge_counts.token_counts(empty, BYTES).count() == 0
    assert merge_counts.token_counts(repeated, BYTES).count() == 3
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in merge_counts.token_counts(docs, PIECES).collect():
        assert r["n_tokens"] == len(library.encode(rows[r["doc_id"]][1] or ""))


def test_kept_words_match_library(monkeypatch):
    """Texts of words, marks and runs of white space, with the worker's words kept or let go."""
    from explainkit.llm import common
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(BYTES), random.Random(8)
    parts = ["the", "thing", "é", "x.", "Don't", "a,b", "12", "--", ".", "日本。", "🙂!", "\x01", "y" * 70 + ".", "<|endoftext|>", "ʰ.", "٣"]
    gaps = [" ", " ", " ", "\n", "\n", "  ", "   ", " \n", "\n ", "\n\n", "\n\n\n", "\t", "\t\t", " \t", "\xa0", "\xa0 ", "\u3000\u3000 ", "\r\n", ""]
    texts = ["".join(rng.choice(gaps[:6]) * rng.randint(0, 1) + rng.choice(parts) + rng.choice(gaps[: rng.choice([5, 19])]) for _ in range(rng.randint(0, 10))) for _ in range(4000)]
    coder = sstable.encoder(BYTES, 0)
    for limit in (10**9, 3000):
        monkeypatch.setattr(common, "WORD_BYTES", limit)
        for at in range(0, len(texts), 100):
            some = texts[at : at + 100]
            want = [library.encode(t, add_special_tokens=False).ids for t in some]
            assert [b"".join(i.to_bytes(2, "little") for i in [*ids, 0]) for ids in want] == coder.encode(some)
            assert merge_counts.count_texts(BYTES, some) == [*map(len, want)]
    coder.encode(["z" * 20_000 + str(i) for i in range(20)])
    assert sum(map(len, coder.words)) < 10**5


def test_stems_are_encoded_once(monkeypatch):
    """Words of one stem ask the library once, and a batch's texts ask for a word's ids once; marks are as the library has them."""
    from tokenizers import Tokenizer

    library, coder, rng = Tokenizer.from_file(BYTES), sstable._Encoder(BYTES, 0), random.Random(5)
    asked, looked, together, of = [], [], coder._together, coder.words.of
    monkeypatch.setattr(coder, "_together", lambda words, spaced: asked.extend(words) or together(words, spaced))
    monkeypatch.setattr(coder.words, "of", lambda keys: looked.extend(keys) or of(keys))
    coder.encode(["a zworp, zworp. zworp### zworp\nzworp; zworp", "a zworp!? zworp.", None, ""])
    assert sorted(asked) == ["\n", "a", "zworp", "zworp"] and len(looked) == len(set(looked))
    parts = ["the", "é", "Zürich", "naïve", "x1", "ª", "ʰ", "日", "<|endoftext|>", "a'", "\x01", ""]
    marks = ["", ".", "###", ",%%%", "!!!!", "?????", "<|", "|>", "$'", "...é", "&&&s"]
    texts = [rng.choice([" ", "\n", "  "]).join(rng.choice(parts) + rng.choice(marks) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    for at in range(0, len(texts), 150):
        some = texts[at : at + 150]
        assert coder.encode(some) == [b"".join(i.to_bytes(2, "little") for i in [*library.encode(t, add_special_tokens=False).ids, 0]) for t in some]


def test_merging_of_runs():
    from tokenizers import Tokenizer

    library, merger, rng = Tokenizer.from_file(BYTES), merge_counts.RankMerger(BYTES), random.Random(9)
    texts = ["".join(rng.choice("ab ith!'\n\t é1") for _ in range(rng.randint(0, 50))) for _ in range(800)] + ["a" * n for n in range(1, 40)]
    assert merger.count_new(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_shards_round_trip(spark, docs, rows, empty, repeated, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    manifest = sstable.write_shards(docs, BYTES, out=f"file://{tmp_path}", shard_bytes=60_000)
    assert manifest.count() > 2
    found = {r["doc_id"]: r for r in sstable.read_shards(spark, manifest).collect()}
    start, want = 0, {}
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want[doc_id] = ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert tuple(found[doc_id]) == (doc_id, start, len(ids), zlib.crc32(raw))
        start += len(ids)
    hits = 0
    for file in sorted(tmp_path.glob("*.sst")):
        with open(file, "rb") as f:
            reader = sstable.ShardReader(f)
            keys = [sstable.id_of(k) for k, _ in reader]
            assert keys == sorted(keys)
            for doc_id in range(-3, len(rows) + 3):
                got = reader.get(sstable.key_of(doc_id))
                assert (got is not None) == (doc_id in keys)
                if got is not None:
                    hits += 1
                    assert got.tolist() == want[doc_id]
    assert hits == len(rows)
    assert sstable.read_shards(spark, sstable.write_shards(empty, BYTES)).count() == 0
    assert [r["doc_id"] for r in sstable.read_shards(spark, sstable.write_shards(repeated, BYTES)).orderBy("start").collect()] == [None, 3, 3]


def brute_fingerprint(text):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(keys, linked):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash_components(docs, rows, empty, repeated):
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    want = components(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {k: r["fingerprint"] for k, r in found.items()} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {k: r["component_id"] for k, r in found.items()} == want
    assert len(set(want.values())) < len(want) - 5
    assert simhash.near_duplicates(empty).count() == 0
    assert sorted(r["component_id"] for r in simhash.near_duplicates(repeated).collect() if r["doc_id"]) == [3, 3]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.keep_one(repeated).count() == 2


@pytest.mark.parametrize("part", [4, 64, 8192])
def test_simhash_links_of_dense_groups(spark, part):
    """Chains of near fingerprints and one dense group, with cells split by bits and into parts or not."""
    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(200)}
    at = rng.getrandbits(64)
    for _ in range(40):  # a chain that drifts away
        at ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.add(at)
    centre = rng.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    want = components(sorted(signed), lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4)
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), len(fps), part=part).collect()
    assert all(bin((r["src"] ^ r["dst"]) & (2**64 - 1)).count("1") <= 4 for r in edges)
    pairs = {(r["src"], r["dst"]) for r in edges} | {(r["dst"], r["src"]) for r in edges}
    assert components(sorted(signed), lambda a, b: (a, b) in pairs) == want
    assert len(edges) < 40 * len(fps)


def test_cells_are_exact():
    """Any two fingerprints within the radius agree on enough groups of block counts, and pass all references."""
    rng = random.Random(2)
    counts = lambda x: [(x & b).bit_count() for b in simhash.BLOCKS]
    for groups, agree in ((6, 2), (8, 4)):
        parts = simhash._cut(len(simhash.BLOCKS), groups)
        for _ in range(500):
            x = rng.getrandbits(64)
            y = x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            a, b = counts(x), counts(y)
            assert sum(all(a[i] == b[i] for i in part) for part in parts) >= agree
            assert all(abs((x ^ int(p)).bit_count() - (y ^ int(p)).bit_count()) <= 4 for p in simhash.PIVOTS)


def test_references_discard_most_pairs():
    import numpy as np

    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    table = simhash._distances(fps)
    near = (np.abs(table[:, :, None] - table[:, None, :]) <= simhash.RADIUS).all(axis=0)
    assert (near.sum() - len(fps)) / 2 < 0.002 * len(fps) ** 2 / 2


def shingle_set(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def test_containment(spark, docs, rows, empty, repeated):
    rng = random.Random(4)
    items = [(100, " ".join(rows[10][1].split(" ")[:25]), 1), (101, " ".join(rows[71][1].split(" ")[1000:1040]), 2), (102, words_of(rng, 30), 3), (103, "one two three four", 4), (104, None, 5), (105, "", 6)]
    w = rows[20][1].split(" ")[:60]
    if len(w) >= 40:
        w[30] = "swapped"
    items += [(106, " ".join(w), 7), (106, " ".join(w), 7), (107, " ".join(rows[71][1].split(" ")[2000:2006]), 8), (None, rows[10][1], 9)]
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    want = set()
    for d, text, *_ in rows:
        own = shingle_set(text)
        for i, t, _ in items:
            mine = shingle_set(t)
            if i is not None and mine and len(mine & own) >= 0.8 * len(mine):
                want.add((d, i))
    got = containment.contained_items(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert len(got) == len(want) > 4
    clean = containment.keep_uncontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert containment.contained_items(empty, bench).count() == 0
    assert containment.contained_items(docs, bench.limit(0)).count() == 0
    assert containment.keep_uncontaminated(docs, bench.limit(0)).count() == len(rows)
    assert containment.keep_uncontaminated(repeated, bench).count() == 3


def test_containment_in_blocks(spark, docs, rows, monkeypatch):
    items = [(i, " ".join(rows[i][1].split(" ")[:20])) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in containment.contained_items(docs, bench).collect()}
    monkeypatch.setattr(containment, "BLOCK_SHINGLES", 60)
    assert {(r["doc_id"], r["item_id"]) for r in containment.contained_items(docs, bench).collect()} == whole
    assert len(whole) >= 12


def test_passages(spark, docs, rows, empty, repeated):
    found = passages.repeated_passages(docs).collect()
    by_doc = {}
    for r in found:
        assert r["owner_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 50 and r["identity"] >= 0.8
        by_doc.setdefault(r["doc_id"], []).append(r)
    n = len(rows)
    for d in range(n - 4, n):  # the passage's later holders
        assert any(r["end_word"] - r["start_word"] >= 66 for r in by_doc[d]), d
    assert {r[0] for r in rows if r[1] and rows.index(r) < 60 and r[0] not in (5, 7)}.isdisjoint(by_doc)
    cut = {r["doc_id"]: r for r in passages.remove_repeats(docs).collect()}
    first = n - 5
    assert cut[first]["text"] == rows[first][1]
    for d in range(n - 4, n):
        assert len(WORD.findall(cut[d]["text"])) <= 84 and cut[d]["n_chars"] == len(cut[d]["text"])
    assert 72 not in cut and cut[71]["text"] == rows[71][1] and cut[60]["text"] is None
    for d in range(60):
        assert cut[d]["text"] == rows[d][1]
    assert passages.repeated_passages(empty).count() == 0 and passages.remove_repeats(empty).count() == 0
    assert passages.remove_repeats(repeated).count() == 3


def test_passages_meet_a_holder_of_the_whole(spark):
    """Parts of a passage occur in earlier documents, before and between those that hold it whole."""
    rng = random.Random(7)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    p = new(60)
    held = {1: p[:30], 2: p[30:], 5: p, 6: p[:40], 7: p[20:], 9: p}
    rows = [(d, " ".join(new(80) + x + new(80))) for d, x in held.items()]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert any(r["doc_id"] == 9 and r["owner_id"] == 5 and r["end_word"] - r["start_word"] >= 60 for r in found)


def test_passages_of_the_least_identity(spark):
    """Pieces of 60 words, every fifth of them another word at random places."""
    rng = random.Random(3)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for d in range(40):
        p = new(60)
        q = list(p)
        for i in rng.sample(range(60), 12):
            q[i] = new(1)[0]
        rows += [(d, " ".join(new(80) + p + new(80))), (100 + d, " ".join(new(80) + q + new(80)))]
    found = {r["doc_id"] for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) >= 38 and min(found) >= 100


def test_chains_extend_the_nearest():
    first, second = list(range(0, 300, 6)), list(range(400, 456, 6))
    matches = first + second
    assert [len(c) for c in passages.chains(matches, matches)] == [50, 10]
    assert passages.chain_spans(matches, matches) == [(0, 299, 0, 299), (400, 459, 400, 459)]


def test_chains_follow_both_orders():
    assert passages.chains([0, 10, 20, 5], [100, 110, 120, 50])[0] == [0, 1, 2]
    assert len(passages.chains([0, 500], [0, 500])) == 2
    assert passages.chain_spans([], []) == []
    rng = random.Random(1)
    a = [rng.randrange(200) for _ in range(60)]
    b = [rng.randrange(200) for _ in range(60)]
    for chain in passages.chains(a, b):
        assert all(a[i] < a[j] or b[i] < b[j] for i, j in zip(chain, chain[1:]))
    assert sorted(i for c in passages.chains(a, b) for i in c) == list(range(60))


def test_cut_words():
    text = "a b  c\nd e f"
    assert passages.cut_words(text, [{"start_word": 1, "end_word": 3}]) == "a \nd e f"
    assert passages.cut_words(text, [{"start_word": 0, "end_word": 6}]) == ""
    assert passages.cut_words(text, []) == text


def brute_stats(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    cover = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] >= 2 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_quality_counts_and_verdicts(spark, rows, docs, empty, repeated):
    rng = random.Random(8)
    more = [(1000 + i, words_of(rng, 120), "en", "hot", 0, [1], "") for i in range(300)]
    more += [(2000, " ".join(w + "###" for w in words_of(rng, 120).split(" ")), "en", "hot", 0, [1], ""), (2001, words_of(rng, 120).upper(), "en", "hot", 0, [1], "")]
    more += [(2002, "\n".join([words_of(rng, 20)] * 9 + [words_of(rng, 60)]), "en", "hot", 0, [1], "")]
    every = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    found = {r["doc_id"]: r for r in quality.quality_verdicts(every).collect()}
    for d, text, *_ in rows + more:
        r, want = found[d], brute_stats(text)
        assert tuple(r[1:6]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert all(found[1000 + i]["kept"] for i in range(300))
    assert not any(found[i]["kept"] for i in (2000, 2001, 2002))
    kept = quality.keep_good(every)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in found.items() if r["kept"]}
    assert quality.quality_verdicts(empty).count() == 0 and quality.keep_good(empty).count() == 0
    assert quality.quality_verdicts(repeated).count() == 3


def test_sketch_quantiles(spark):
    rng = random.Random(6)
    values = sorted(rng.random() for _ in range(5000))
    rows = [(10_000, int(v * 10_000), 0, 0, 0, 1, 0, "en", "s") for v in values]
    stats = spark.createDataFrame(rows, "word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_words long, n_lines long, n_upper long, lang string, source string")
    cut = quality.cutoffs(quality.sketches(stats)).where("level = 0").first()["symbol_ratio_cut"]
    low, mid = values[1250], values[2500]
    assert cut == pytest.approx(mid + quality.REACH * (mid - low), rel=0.05)


def test_suffix_tree_scores(spark, docs, rows, empty, repeated):
    found = {r["doc_id"]: r for r in suffix_tree.text_scores(docs).collect()}
    tokens = {d: [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [None] for d, t, *_ in rows}
    train = Counter(t for d, ts in tokens.items() if zlib.crc32(str(d).encode()) % 10 for t in ts)
    n, v = sum(train.values()), len(train)
    for d, ts in tokens.items():
        r = found[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 10 == 0)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(train[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), abs=1e-6)
        assert r["score"] < 0
    assert suffix_tree.text_scores(empty).count() == 0
    assert suffix_tree.text_scores(repeated).count() == 3


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
<header><h1>Site</h1><p>The site of all the things that are in the world and of it and more of the same for you.</p></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-banner">We use cookies on this site.</div>
<article><h1>The title &amp; more</h1><p>It was the best of the times and it was the worst of the times, as it is said in the book that we have all read, and so it goes on.<p>Short
 &nbsp; one.</p><ul><li>An item</li></ul><form><p>Mail</p></form><div class="comments"><p>The best of the comments that I have read on this site so far, and it is not the only one.</p></div></article>
<aside>See also the other things that are in the list of the day.</aside><footer>&copy; me</footer></body>"""


def test_html(spark):
    assert html_blocks.main_text(PAGE) == "The title & more\n\nIt was the best of the times and it was the worst of the times, as it is said in the book that we have all read, and so it goes on.\n\nShort one.\n\nAn item"
    long = "It was the best of the times and it was the worst of the times, as it is said in the book that we have all read."
    plain = f"<body><div><a href=x>Home</a></div><div><h2>Head</h2><p>{long}</p><p>Short.</p><p>{long}</p></div><div>Contact</div><div><a href=y>More</a></div>"
    assert html_blocks.main_text(plain) == f"Head\n\n{long}\n\nShort.\n\n{long}"
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p", "x"), (4, "u", "<p", "x"), (None, "u", "<article><p>Hi", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_blocks.extract_pages(pages).collect()
    assert len(out) == 6 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert [r["text"] for r in out if r["page_id"] in (2, 3, 4)] == [""] * 4 and out[-1]["text"] == "Hi"
    assert html_blocks.extract_pages(pages.limit(0)).count() == 0


def test_html_of_the_given_pages(spark):
    for r in html_blocks.extract_pages(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        inner = re.sub(r"<p>|</p>|<h1>|</h1>", "\n\n", inner)
        import html

        want = [" ".join(html.unescape(re.sub("<[^>]*(>|$)", " ", b)).split()) for b in inner.split("\n\n")]
        assert r["text"] == "\n\n".join(b for b in want if b)


def test_toxicity(spark, empty):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(600):
        text, toxic = words_of(rng, 80).split(" "), i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["vekka", "vekkaing", "zurrdo"]) + rng.choice(["", "s"]))
        rows.append((i, " ".join(text), "en", "s", 0, [1], ""))
        marks.append((i, 1, int(toxic), "text"))
    rows += [(900, None, None, None, 0, None, None), (901, "", None, None, 0, None, None), (None, "you idiot", None, None, 0, None, None), (3, rows[3][1], "en", "s", 0, [1], "")]
    marks += [(None, 1, 1, ""), (5, 1, None, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string")
    found = toxicity.toxicity_scores(docs, labels).collect()
    assert len(found) == len(rows)
    truth = {m[0]: m[2] for m in marks if m[2] is not None}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 60 and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert toxicity.toxicity_scores(docs, labels.limit(0)).count() == len(rows)
