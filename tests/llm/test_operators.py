"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, jaccard, warc, webp
from graphloom.llm import quality as Q
from graphloom.llm import text_arrays as T
from graphloom.llm.components import components
from graphloom.llm.decontaminate import find_leaks
from graphloom.llm.language_id import identify
from graphloom.llm.lm_mixing import score_texts
from graphloom.llm.packing import OpenWindows, best_fit, pack, tokenizer
from graphloom.llm.toxicity import score_toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return docs.toPandas()


def low_words(text):
    return [w.lower() for w in (text or "").encode().split()]


# words and shingles


def test_words_are_those_of_a_split():
    texts = ["a b C", "", " x\ty\nz\x0b\x0cq ", "É é É", "one", "a" * 70 + " b", "c"]
    hashes, counts = T.words(*T.buffer_of(pa.array(texts)))
    assert counts.tolist() == [len(t.encode().split()) for t in texts]
    seen = {}
    for h, w in zip(hashes.tolist(), [w for t in texts for w in low_words(t)], strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_documents_are_cut_at_words(monkeypatch):
    text = " ".join(random.Random(1).choices(["ab", "cde", "f" * 50, "é"], k=5000))
    whole = T.words(*T.buffer_of(pa.array([text, "x y"])))
    monkeypatch.setattr(T, "CHUNK", 64)
    parts = T.words(*T.buffer_of(pa.array([text, "x y"])))
    assert (whole[0] == parts[0]).all() and whole[1].tolist() == parts[1].tolist()


# near duplicates


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = low_words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = collections.defaultdict(list)
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in at[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            at[x].append(i)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("width,percent,seed", [(4, 85, 1), (5, 80, 2), (1, 60, 3), (2, 90, 4)])
def test_jaccard_join_equals_brute_force(spark, width, percent, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, k = {}, 0
    for _ in range(12):  # families of near copies at all distances, chains among them
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 20, 60, 200]))
        for _ in range(rng.choice([1, 4, 15])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[k] = " ".join(copy)
            k += 1
            if rng.random() < 0.3:
                base = copy
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, sizes = brute_components(texts, width, percent)
    got = jaccard.jaccard_components(df, width, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes


def test_jaccard_join_on_documents(docs, local):
    want, _ = brute_components(dict(zip(local.doc_id, local.text, strict=True)), 4, 85)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()} == want


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_partenum_loses_no_pair(percent):
    rng = np.random.default_rng(percent)
    for _ in range(150):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        gone = rng.integers(0, max(1, len(a) * (100 - percent) // 100) + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, rng.integers(0, gone + 1), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * (len(a) + len(b) - common) and (len(a) != len(b) or (a != b).any()):
            for hot in (a[:0], np.sort(rng.permutation(a)[: len(a) // 3]), np.union1d(a, b)):
                assert len(np.intersect1d(jaccard.all_signatures(a, percent, hot), jaccard.all_signatures(b, percent, hot)))
        fold = jaccard._folded([jaccard.sketch(a), jaccard.sketch(b)])
        assert np.bitwise_count(fold[0] ^ fold[1]).sum() <= len(a) + len(b) - 2 * common


class Held:
    """A broadcast's stand-in."""

    def __init__(self, value):
        self.value = value


def test_what_a_worker_holds_does_not_follow_the_texts_of_a_batch(docs):
    """Rows and elements go out by ROWS_OUT, whatever a batch of texts gives, and are those of each text on its own; a pass over few bytes sets up few powers."""
    texts = [r.text for r in docs.select("text").collect()] * 6 + [None, "", "wort " * 400_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([f"{i} {t}" if t else t for i, t in enumerate(texts)])], ["doc_id", "text"])
    sets = list(jaccard._sets(batch, 5))
    most = 2 * jaccard.ROWS_OUT * 20
    signed = list(jaccard._signatures(5, 80, Held(np.zeros(0, np.uint64)))(iter([batch])))
    assert len(signed) > 2 and max(b.nbytes for b in signed) < most
    got = [x for b in signed for x in zip(b["sig"].to_pylist(), b["sid"].to_pylist(), strict=True)]
    want = {int(jaccard.set_id(x).view(np.int64)): T.signed(jaccard.all_signatures(x, 80, np.zeros(0, np.uint64))).tolist() for x in sets if len(x)}
    assert got == [(g, sid) for sid, own in want.items() for g in own]
    held = list(jaccard._arrays(5)(iter([batch])))
    assert len(held) > 1 and max(b.nbytes for b in held) < most
    assert [x for b in held for x in b["items"].to_pylist()] == [T.signed(x).tolist() for x in sets]


def test_heads_are_the_same_of_parts_of_a_batch(monkeypatch):
    rng = np.random.default_rng(3)
    diff = [rng.integers(0, 40, n).tolist() for n in (3, 0, 9, 30, 1, 12)]
    longs = {"first": [1, 1, 1, 2, 2, 2], "sid": [11, 12, 13, 14, 15, 16], "root": [11, 1, 13, 14, 2, 16], "n": [40] * 6, "d": [len(x) for x in diff], "d_any": [1] * 6, "d_away": [3] * 6}
    batch = pa.RecordBatch.from_pydict(longs | {"away": [True, False, True, True, False, True], "mark": [[i] * 8 for i in range(6)], "diff": diff})
    run = jaccard._heads(80, Held(np.full(1 << jaccard.COUNTERS, 2, np.int32)))
    rows = lambda: [r for b in run(iter([batch])) for r in b.to_pylist()]
    whole = rows()
    monkeypatch.setattr(jaccard, "ROWS_OUT", 10)
    assert len(list(run(iter([batch])))) > 1 and rows() == whole and whole


def test_powers_are_made_as_far_as_they_are_needed(monkeypatch):
    monkeypatch.setattr(T, "_POWERS", {})
    T.words(*T.buffer_of(pa.array(["a b c"])))
    assert len(T._POWERS["up"]) < T.PASS
    _, counts = T.words(*T.buffer_of(pa.array(["ab " * 200_000])))
    assert counts.tolist() == [200_000] and len(T._POWERS["down"]) > 600_000


@pytest.mark.parametrize("size", [1, 3, 7, 10_000])
@pytest.mark.parametrize("looked", [4, 256])
def test_bucket_stream_is_the_same_in_any_batches(size, looked, monkeypatch):
    monkeypatch.setattr(jaccard, "LOOKED", looked)
    rng = np.random.default_rng(5)
    rows = sorted(set(zip(rng.integers(0, 60, 900).tolist(), rng.integers(1, 12, 900).tolist(), strict=True)))
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([r[0] for r in own], [0] * len(own), [r[1] for r in own])], ["sig", "rank", "sid"]) for own in (rows[i : i + size] for i in range(0, len(rows), size))]
    small, large = collections.defaultdict(set), set()
    for b in jaccard._buckets(iter(batches)):
        for name, sid, first in zip(*(b[c].to_pylist() for c in ("bucket", "sid", "first")), strict=True):
            small[name].add(sid) if not first else large.add((first, sid))
    want = collections.defaultdict(set)
    for sig, sid in rows:
        want[sig].add(sid)
    assert sorted(map(sorted, small.values())) == sorted(map(sorted, {frozenset(x) for x in want.values() if 1 < len(x) <= looked}))
    assert large == {(min(x), sid) for x in want.values() if len(x) > looked for sid in x}


def dense_components(texts, width, percent):
    """Components by products of 0/1 matrices."""
    place, rows = {}, []
    for t in texts:
        w = low_words(t)
        rows.append({place.setdefault(tuple(w[k : k + width]), len(place)) for k in range(len(w) - width + 1)})
    m = np.zeros((len(rows), len(place)), np.float32)
    for i, own in enumerate(rows):
        m[i, list(own)] = 1
    size, label = m.sum(1), np.arange(len(rows))
    near = []
    for lo in range(0, len(rows), 1000):
        both = m[lo : lo + 1000] @ m.T
        near.append(100 * both >= percent * (size[lo : lo + 1000, None] + size - both))
    near = np.concatenate(near)
    while True:
        now = np.array([label[x].min() for x in near])
        if (now == label).all():
            return label.tolist()
        label = now


def test_large_families_equal_brute_force(spark):
    """A family of more than 4,096 near copies, half of them too far from its original; many texts around one passage; and many that are near in their rarest words only."""
    rng = random.Random(11)
    edits, words = [f"e{i}" for i in range(60)], [f"w{i}" for i in range(3000)]
    base, passage = rng.choices(words, k=40), rng.choices(words, k=14)
    texts = []
    for _ in range(4800):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            copy[rng.randrange(len(copy))] = rng.choice(edits)
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choices(words, k=9) + passage + rng.choices(words, k=9)) for _ in range(600)]
    texts += [" ".join(passage + rng.choices(words[:3], k=3)) for _ in range(300)]
    rng.shuffle(texts)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2, 85).collect()}
    assert [got[i] for i in range(len(texts))] == dense_components(texts, 2, 85)
    assert len(set(texts[:])) > 3500


def test_ids_that_repeat_or_are_missing_lose_no_link(spark):
    """Texts are told by their sets, not by ids."""
    rng = random.Random(12)
    base = rng.choices([f"w{i}" for i in range(500)], k=60)
    near = lambda k: " ".join([*base[:k], "x", *base[k + 1 :]])
    rows = [(None, near(3)), (None, near(40)), (7, "something else altogether, in a few words"), (7, near(20)), (9, " ".join(base))]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())
    assert got == [(0, 7), (0, 7), (7, 7), (7, 7), (9, 7)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {k for k, v in got.items() if v == 0} == set(range(41)) and all(got[k] == 100 for k in range(100, 130))


# packing


def test_best_fit_equals_a_scan():
    rng = random.Random(3)
    lengths = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    windows, offsets = best_fit(lengths, 100)
    room = []
    for n, w, o in zip(lengths, windows, offsets, strict=True):
        fits = [r for r in room if r >= n]
        if fits:
            assert room[w] == min(fits)
        else:
            assert w == len(room)
            room.append(100)
        assert o == 100 - room[w]
        room[w] -= n


def test_open_windows_find_the_tightest():
    tree = OpenWindows(10)
    tree.put(3, 1), tree.put(7, 2), tree.put(10, 3)
    assert tree.best(4) == (7, 2) and tree.best(4) == (10, 3) and tree.best(4) is None and tree.best(3) == (3, 1)


def test_packing_holds_each_id_once(docs, local):
    import public_tokenizers
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*code.encode(t or "", add_special_tokens=False).ids, 1] for i, t in zip(local.doc_id, local.text, strict=True)}
    got = pack(docs, keep_ids=True).toPandas()
    for doc, own in got.groupby("doc_id"):
        own = own.sort_values("start")
        assert [x for ids in own.ids for x in ids] == want[doc] and (own.doc_tokens == len(want[doc])).all()
        assert own.start.tolist() == np.concatenate([[0], own.length.cumsum()[:-1]]).tolist()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got.itertuples())
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 2048
    assert got.length.sum() / (got.sequence_id.nunique() * 2048) > 0.97


def test_ids_are_those_of_the_vocabulary():
    """Added tokens and all, on strings of awkward pieces."""
    import public_tokenizers
    from tokenizers import Tokenizer

    code, own, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokenizer("byte_bpe_50k.json"), random.Random(2)
    pieces = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "\r\n", "\t", "a", "Word", "don't", "'S", "é", "日本", "\U0001f642", "12", "...", "\u00a0", "\u0301", "\u200b", "\0"]
    for text in ["a <|endoftext|> b", "", *("".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(3000))]:
        assert own.encode(text, allowed_special="all") == code.encode(text, add_special_tokens=False).ids
    assert 50256 in own.encode("a <|endoftext|> b", allowed_special="all")


def test_added_tokens_are_packed_by_their_id(spark):
    got = pack(spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string"), keep_ids=True).first()
    assert got.doc_tokens == 5 and 50256 in got.ids


# lossless WebP


def pictures():
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (3, 5), (17, 13), (9, 40)):
        yield webp._join(rng.integers(0, 3, (h, w, 4)).cumsum(1) % 256)


@pytest.mark.parametrize("transforms", [(), (webp.SUBTRACT_GREEN,), (webp.PREDICTOR,), (webp.CROSS_COLOUR,), (webp.SUBTRACT_GREEN, webp.PREDICTOR), (webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN)])
@pytest.mark.parametrize("cache,references,groups", [(0, False, 1), (4, False, 1), (0, True, 1), (6, True, 3), (0, False, 2)])
def test_webp_round_trip(transforms, cache, references, groups):
    for k, p in enumerate(pictures()):
        assert (webp.decode(webp.encode(p, transforms, k * 5, cache, references, groups)) == p).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_webp_palettes(colours):
    rng = np.random.default_rng(colours)
    p = rng.integers(0, 2**32, colours, dtype=np.uint32)[rng.integers(0, colours, (11, 23))]
    for more in ((), (webp.PREDICTOR,)):
        assert (webp.decode(webp.encode(p, (webp.PALETTE, *more), 3, 2, True)) == p).all()


def test_webp_known_file():
    """One opaque red pixel, bits laid out by hand: five simple codes of one symbol each."""
    bits = "".join(f"{v:0{n}b}"[::-1] for v, n in [(0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)] + [x for s in (0, 255, 0, 255, 0) for x in ((1, 1), (0, 1), (1, 1), (s, 8))])
    stream = int(bits[::-1], 2).to_bytes((len(bits) + 7) // 8, "little")
    assert webp.decode(webp._file(stream)).tolist() == [[0xFFFF0000]]


def test_webp_refuses_damaged_files():
    p = np.random.default_rng(1).integers(0, 2**32, (9, 9), dtype=np.uint32)
    data = webp.encode(p)
    for k in range(26, len(data) - 2, 7):
        with pytest.raises(ValueError):
            webp.decode(data[:16] + (k - 20).to_bytes(4, "little") + data[20:k])
    with pytest.raises(ValueError):
        webp.decode(b"RIFF")


def test_near_distances():
    assert len(webp.NEAR) == 120 and webp.NEAR[:5] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2)] and webp.NEAR[-1] == (8, 7)


def test_stored_texts_are_read_back(docs, local):
    for r in webp.store_texts(docs, keep_media=True).collect():
        raw = (local.text[local.doc_id == r.doc_id].iloc[0] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert webp.payload_in(webp.decode(bytes(r.media)), len(payload)).tobytes() == payload


def transform_of(stored):
    bits = webp.Bits(bytes(stored[20:]), 8)
    bits.read(14), bits.read(14), bits.read(4)
    return bits.read(2) if bits.read(1) else None


def test_texts_are_stored_by_references_palettes_and_predictors(monkeypatch):
    """Each where it is smaller, and read back through the decoder's own steps."""
    met, copy, images = collections.Counter(), webp._copy, webp.TextImages()
    monkeypatch.setattr(webp, "_copy", lambda out, begin, size, d: (met.update(references=len(begin), copied=int(size.sum())), copy(out, begin, size, d)))
    for name in ("_unpack", "predictor"):
        monkeypatch.setattr(webp, name, (lambda f, name: lambda *a: (met.update([name]), f(*a))[1])(getattr(webp, name), name))
    rng = np.random.default_rng(7)
    walk = bytes((64 + np.clip(np.cumsum(rng.integers(-1, 2, 9000)), -30, 60)).astype(np.uint8))
    prose = " ".join(rng.choice(["the", "house", "stands", "near", "water", "and", "light"], 3000))
    texts = {"": None, prose: None, "".join(rng.choice(list("абвгдежзиклмнопрстуфхцчшщыэюя "), 3000)): webp.PALETTE, "".join(rng.choice(list("ACGT"), 3000)): webp.PALETTE, walk.decode(): webp.PREDICTOR, "x" * 700_000 + prose + "y" * 9: None, "\0" * 130: None}
    for text, want in texts.items():
        payload = webp.payload_of(text.encode())
        shape = webp.shape_of(len(payload))
        stored = images.encode(payload, *shape)
        assert (webp.payload_in(webp.decode(stored), len(payload)) == payload).all()
        assert want is None or transform_of(stored) == want
    assert met["references"] > 100 and met["copied"] > 700_000 and met["_unpack"] >= 2 and met["predictor"] >= 1


def test_awkward_payloads_are_read_back():
    rng, images = np.random.default_rng(8), webp.TextImages()
    shapes = [rng.integers(0, k, n, dtype=np.uint8) for k in (2, 3, 5, 17, 256) for n in (64, 640, 70_016)]
    shapes += [np.resize(rng.integers(0, 256, k, dtype=np.uint8), 399_360) for k in (1, 7, 64, 5000, 300_000)]
    for payload in shapes:
        width, height = webp.shape_of(len(payload))
        assert (webp.payload_in(webp.decode(images.encode(payload, width, height)), len(payload)) == payload).all()


def test_references_are_apart_and_true():
    rng = np.random.default_rng(9)
    for k in (2, 4, 30):
        data = rng.integers(0, k, 5000, dtype=np.uint8)
        end = 0
        for at, n, back in zip(*(x.tolist() for x in webp.repeats(data)), strict=True):
            assert at >= end and webp.LEAST <= n <= webp.LONGEST and 0 < back <= at
            assert all(data[at + i] == data[at - back + i] for i in range(n))
            end = at + n
        assert end <= len(data)


# chat formatting


def test_chat_digests(spark):
    c = spark.read.parquet(f"{DATA}/conversations.parquet")
    got = {r.conv_id: r for r in chat.digest(chat.format_records(chat.records_of(c))).collect()}
    for k, g in c.toPandas().sort_values(["conv_id", "turn"]).groupby("conv_id"):
        under = "".join(t for t, r in zip(g.text, g.role, strict=True) if r == "assistant")
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text, strict=True)).encode()).hexdigest()
        assert (got[k].n_turns, got[k].loss_chars, got[k].loss_sha256) == (len(g), len(under), hashlib.sha256(under.encode()).hexdigest())


def test_escaping_is_reversible_and_hides_control_strings(spark):
    rng = random.Random(9)
    pieces = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "|end|>", "|turn|>", "a", "\n", "<|im_start|>", "é"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    raw = re.compile(r"</?s>|\[/?INST\]|<</?SYS>>|<\|[A-Za-z_]{1,32}\|>")
    for t, e, u in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert u == t and not raw.search(e)


def test_layouts_are_told_by_fingerprint(spark):
    rows = [('{"prompt": "a", "response": "b"}', "prompt_response"), ('{"response": "b", "prompt": "a"}', "prompt_response"), ('{"instruction": "a", "input": "", "output": "b"}', "instruction_input"), ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}', "messages"), ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', "conversations"), ('{"question": "a", "answer": "b"}', "question_answer")]
    for r, want in zip(chat.format_records(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "i int, record string")).orderBy("i").collect(), rows, strict=True):
        assert r["mapping"] == want[1] and [(t["role"], t["text"]) for t in r["turns"]] == [("user", "a"), ("assistant", "b")]
        assert sum(x["length"] for x in r["loss_runs"]) == len(r["formatted"]) and [x["loss"] for x in r["loss_runs"]].count(True) == 1


def test_fields_that_no_mapping_carries_make_a_layout_unknown(spark):
    """Later messages of another layout, further or deeper fields, mixed types: named by another fingerprint, with no turns."""
    known = ['{"messages": [{"role": "user", "content": "a"}, {"content": null, "role": "assistant"}]}', '{"messages": [{"content": "", "role": ""}]}']
    odd = [
        '{"messages": [{"role": "user", "content": "a"}, {"from": "gpt", "value": "b"}]}', '{"conversations": [{"from": "human", "value": "a"}, {"role": "assistant", "content": "b"}]}', '{"messages": [{"role": "user", "content": "a"}, {"role": "user", "content": "b", "weight": 1}]}',
        '{"messages": [{"role": "user", "content": {"parts": ["a"]}}]}', '{"messages": [{"role": "user", "content": ["a"]}, {"role": "user", "content": "b"}]}', '{"prompt": "a", "response": "b", "meta": {"x": 1}}', '{"prompt": ["a"], "response": "b"}', '{"prompt": "a", "response: STRING": "b"}', '["a"]',
    ]
    rows = list(enumerate(known + odd))
    got = chat.format_records(spark.createDataFrame(rows, "i int, record string")).orderBy("i").collect()
    assert [r["mapping"] for r in got] == ["messages"] * 2 + [None] * len(odd)
    assert len({r["fingerprint"] for r in got[1:]}) == len(odd) + 1 and all(r["fingerprint"] is not None and r["turns"] is None for r in got[2:])
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and [r["record"] for r in got] == known + odd


# language model


@pytest.mark.parametrize("lookup", [3_000_000, 500])
def test_base_score_equals_brute_force(docs, local, lookup):
    words = {i: low_words(t) for i, t in zip(local.doc_id, local.text, strict=True)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    c = collections.Counter(w for i, own in words.items() if not held[i] for w in [*own, None])
    n, v = sum(c.values()), len(c)
    for r in score_texts(docs, lookup).collect():
        own = [*words[r.doc_id], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(c[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), abs=1e-6)
        assert r.score < 0


def test_mixture_learns(spark):
    out = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.avg("bits_per_byte")).first()[0]
    assert out < 2.5


def test_next_byte_probabilities_sum_to_one():
    from graphloom.llm import lm_mixing as M

    data = np.frombuffer(b"the cat sat on the mat. " * 40, np.uint8)
    key, _ = M.grams(data, np.array([0, len(data)]))
    counts = np.bincount(data, minlength=256)
    counts[M.END] = 1
    tree = M.huffman(counts)
    unique, times = np.unique(key, return_counts=True)
    bits = np.zeros((2, M.BASES[-1]), np.uint16)
    for b in M._predictors(tree)(iter([pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(times)], ["id", "n"])])):
        bits[0][b["slot"].to_numpy()], bits[1][b["slot"].to_numpy()] = b["n"].to_numpy(), b["m"].to_numpy()
    m = M.Mixture(bits, tree)
    m.learn(key)
    for context in (key[5], key[20], key[300]):
        every = (np.full(256, context) & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert (10 ** m.log10(every)).sum() == pytest.approx(1, abs=1e-9)
    assert -M.Scorer(m)(key).sum() / np.log10(2) / len(data) < 1.5


def test_mixer_and_map_learn_from_late_text(spark):
    """Every decision on the path of a byte that occurs, if only late in long documents, moves the map."""
    from graphloom.llm import lm_mixing as M

    rng = random.Random(6)
    rows = [(i, "a few words " * 400 + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=2000))) for i in range(30)]
    m = M.fit(spark.createDataFrame(rows, "doc_id long, text string"))[0]
    lengths, nodes, _ = m.tree
    met = {int(n) for b in set("".join(t for _, t in rows).encode()) for n in nodes[b, : lengths[b]]}
    grid = 1 / (1 + np.exp(-np.linspace(-14, 14, M.MAP_STEPS)))
    assert all((m.refine[n] != grid).any() for n in met)


def test_mixture_scores_equal_the_equations(spark):
    """Bit by bit in plain Python: counts by hashed context, gate, mixed logit, map."""
    from graphloom.llm import lm_mixing as M

    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "éé the"] * 5
    m = M.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))[0]
    lengths, nodes, bits = m.tree

    def score(text):
        out, raw = 0.0, [*text.encode(), M.END]
        for i, byte in enumerate(raw):
            context = sum(raw[i - k] << 8 * k for k in range(1, M.ORDERS) if i >= k)
            for k in range(lengths[byte]):
                node, bit = int(nodes[byte, k]), int(bits[byte, k])
                slots = [int(M._slots(np.array([context | 1 << 62], np.uint64), np.array([node]), o)[0]) for o in range(M.ORDERS)]
                n = [(int(m.counts[0][s]), int(m.counts[1][s])) for s in slots]
                x = [max(-12.0, min(12.0, math.log((b + 0.4) / (a + 0.4)))) for a, b in n] + [0.4]
                level = lambda c: min(4, int(math.log2(c + 1) / 2.5))
                gate = (level(sum(n[5])) * 5 + level(sum(n[4]))) * 3 + min(2, int(math.log2(sum(n[3]) + 1) / 4))
                z = max(-14.0, min(14.0, sum(w * v for w, v in zip(m.weights[gate], x, strict=True))))
                at = (z + 14) * (M.MAP_STEPS - 1) / 28
                low = min(int(at), M.MAP_STEPS - 2)
                p = 0.5 / (1 + math.exp(-z)) + 0.5 * (m.refine[node, low] * (1 - at + low) + m.refine[node, low + 1] * (at - low))
                p = max(1e-6, min(1 - 1e-6, p))
                out += math.log10(p if bit else 1 - p)
        return out

    for text in ("the cat", "", "zé the dog sat"):
        key, _ = M.grams(*T.buffer_of(pa.array([text])))
        assert M.Scorer(m)(key).sum() == pytest.approx(score(text), abs=1e-4)


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choices(["some", "short", "words", "in", "any", "order", f"n{i % 50}"], k=8))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({r.doc_id: (r.score, r.base_score) for r in score_texts(df.repartition(n)).collect()} for n in (5, 16))
    assert all(one[i] == pytest.approx(two[i], abs=1e-6) for i in one)


def test_large_bit_counts_keep_their_ratio(spark):
    from graphloom.llm import lm_mixing as M

    rows = [(10**10, 25 * 10**8), (0, 0), (65_535, 1), (65_536, 2), (3, 2**40)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "n long, m long").select(*M.halved("n", "m")).collect()]
    assert all(max(r) < 2**16 for r in got) and got[1:4] == [(0, 0), (65_535, 1), (32_768, 1)] and got[0][0] / got[0][1] == pytest.approx(4, rel=1e-3) and got[4][0] == 0


# classifiers


def test_language_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.98
    assert got.where("score < 0 OR score > 1").isEmpty()


def test_toxicity_on_held_out_rows(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = score_toxicity(d, lab).join(lab, "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() / got.count() > 0.9


def test_toxicity_learns_an_interaction(spark):
    """Neither word tells; both together do."""
    rng = random.Random(4)
    rows = []
    for i in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices([f"filler{k}" for k in range(30)], k=6) + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), 1, int(a and b or not a and not b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    got = score_toxicity(df.select("doc_id", "text"), df).join(df, "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() / got.count() > 0.9


def test_toxicity_learns_a_pair_among_thousands_of_commoner_terms(spark):
    """An insult beside a group is toxic, either alone is not; 2,000 words are commoner than both."""
    rng = random.Random(5)
    fillers, rows = [f"word{k:04d}x" for k in range(2000)], []
    for i in range(3000):
        insult, group = rng.random() < 0.12, rng.random() < 0.12
        if rng.random() < 0.1:
            insult = group = True
        words = rng.sample(fillers, 400) + ["zinsult"] * insult + ["qgroup"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), 1, int(insult and group)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    got = score_toxicity(df.select("doc_id", "text"), df).join(df, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.97
    assert sum(r.predicted for r in got if r.toxic) > 0.9 * sum(r.toxic for r in got)


def test_toxicity_scores_equal_the_equation(spark, docs):
    """bias, weights and pairs written out."""
    from graphloom.llm import toxicity as X

    rng, texts = np.random.default_rng(3), ["you idiot, idiot!", "", "Größe und Idiot", "x " * 40 + "you"]
    buckets = np.unique(np.concatenate([X._terms(*T.buffer_of(pa.array([t])))[0] for t in texts]))[::2]
    m = X.FactorizationMachine(buckets, -0.3, rng.normal(size=len(buckets)), rng.normal(size=(len(buckets), 3)))
    got = {r.doc_id: r.score for r in X.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()}
    place = {int(b): i for i, b in enumerate(buckets)}
    for i, t in enumerate(texts):
        own = sorted({place[b] for b in X._terms(*T.buffer_of(pa.array([t])))[0].tolist() if b in place})
        z = m.bias + sum(m.linear[k] for k in own) + sum(float(m.factors[a] @ m.factors[b]) for n, a in enumerate(own) for b in own[n + 1 :])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_toxicity_without_features(spark):
    """Too few documents share a term: every score is the share of label 1."""
    rows = [(i, f"only{i} here{i}", i % 2) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {round(r.score, 6) for r in score_toxicity(df, df).collect()}
    assert len(got) == 1 and 0 < got.pop() < 1


def test_discoveries_equal_the_definition():
    from graphloom.llm import toxicity as X

    rng = np.random.default_rng(2)
    z = np.concatenate([rng.normal(size=400), rng.normal(5, 1, 20)])
    p = sorted((math.erfc(max(x, 0) / math.sqrt(2)), i) for i, x in enumerate(z))
    k = max((k for k, (x, _) in enumerate(p, 1) if x <= 0.1 * k / len(z)), default=0)
    assert set(np.flatnonzero(X.discoveries(z, len(z))).tolist()) == {i for _, i in p[:k]}


def test_quality_rejects_junk_and_keeps_clean(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = Q.select_quality(d, lab).join(lab, "doc_id").groupBy("quality", "selected").count().collect()
    n = {(r.quality, r.selected): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.03 * n[1, True] and n[0, False] > 0.7 * (n[0, False] + n.get((0, True), 0))


def test_importance_weights_equal_the_equations(spark):
    """Counts, ratios and weights in plain Python, over the same buckets."""
    texts = ["Good words, good text.", "bad bad !!! bad", "", "Good words again and some more", "bad words"]
    good = {0, 3}
    own = [Q._buckets(*T.buffer_of(pa.array([t])))[0].tolist() for t in texts]
    raw, target = collections.Counter(b for x in own for b in x), collections.Counter(b for i in good for b in own[i])
    total = sum(raw.values()) + 0.5 * Q.BUCKETS

    def ratio(b):
        p = (raw[b] + 0.5) / total
        r = math.log((target[b] + Q.PRIOR * p) / (sum(target.values()) + Q.PRIOR)) - math.log(p)
        return r if r >= 0 else min(0.0, r + Q.DOUBT * math.sqrt(1 / (target[b] + Q.PRIOR * p) + 1 / (raw[b] + 0.5)))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Q.fit(docs, spark.createDataFrame([(i,) for i in good], "doc_id long"))
    assert all(got[b] == pytest.approx(ratio(b), abs=1e-12) for x in own for b in x)
    rows = {r.doc_id: r for r in Q.resample(docs, got, k=2).collect()}
    assert all(rows[i].log_weight == pytest.approx(sum(ratio(b) for b in x), abs=1e-9) and rows[i].n_terms == len(x) for i, x in enumerate(own))
    assert [rows[i].selected for i in rows] == [rows[i].gumbel_key >= sorted((r.gumbel_key for r in rows.values()), reverse=True)[1] for i in rows]


def test_language_scores_equal_the_equations(spark):
    """Convolution, maximum, softmax and the mean over windows, in plain Python."""
    from graphloom.llm import language_id as L

    rng = np.random.default_rng(4)
    d, f = 8, 12
    net = L.ByteConvNet(["a", "b", "c"], rng.normal(0, 0.5, (256, d)), [rng.normal(0, 0.3, (w, d, f)) for w in L.WIDTHS], [rng.normal(size=f) for _ in L.WIDTHS], rng.normal(0, 0.3, (f * len(L.WIDTHS), 3)), rng.normal(size=3))
    net.embedding[0] = 0
    texts = ["Some words of a text", "Größe " * 200, "x"]

    def window(raw):
        e = [net.embedding[b] for b in raw.ljust(L.WINDOW, b"\0")]
        h = []
        for w, bias in zip(net.filters, net.biases, strict=True):
            for j in range(f):
                h.append(max(0.0, max(sum(float(e[i + k] @ w[k][:, j]) for k in range(len(w))) for i in range(L.WINDOW - len(w) + 1)) + float(bias[j])))
        z = [sum(x * float(c) for x, c in zip(h, net.dense[:, o], strict=True)) + float(net.offset[o]) for o in range(3)]
        total = sum(math.exp(x) for x in z)
        return [math.exp(x) / total for x in z]

    got = {r.doc_id: r for r in L.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for i, t in enumerate(texts):
        start, length, _ = L.cut_windows(*T.buffer_of(pa.array([t])))
        p = np.array([np.array(window(t.encode()[s : s + n])) * n for s, n in zip(start.tolist(), length.tolist(), strict=True)]).sum(0) / len(t.encode())
        assert got[i].lang_pred == net.labels[int(p.argmax())] and got[i].score == pytest.approx(p.max(), abs=1e-4)


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(8)
    values = [int(x) for x in rng.integers(-(2**62), 2**62, 500)] + [5, 5, 5, -7, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 250, 253, len(values)):
        assert Q.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_gumbel_draws_follow_the_weights(spark):
    """Of equal texts but two weights, the heavier is drawn in proportion."""
    df = spark.createDataFrame([(i, "good" if i % 2 else "bad") for i in range(20_000)], "doc_id long, text string")
    ratio = np.zeros(Q.BUCKETS)
    bucket, _ = Q._buckets(*T.buffer_of(pa.array(["good"])))
    ratio[bucket[0]] = math.log(3)
    got = Q.resample(df, ratio, k=200).where("selected")
    share = got.where("log_weight > 0").count() / 200
    assert got.count() == 200 and 0.65 < share < 0.85


# benchmark leaks


def test_leaks_equal_shared_windows(docs, local, spark):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    norm = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    at = collections.defaultdict(set)
    for i, t in bench.collect():
        w = norm(t)
        for k in range(len(w) - 12):
            at[tuple(w[k : k + 13])].add(i)
    want = {(d, i) for d, t in zip(local.doc_id, local.text, strict=True) for w in [norm(t)] for k in range(len(w) - 12) for i in at.get(tuple(w[k : k + 13]), ())}
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()}
    assert want <= got and len(got - want) <= 1


def test_other_numbers_and_names_are_caught(spark):
    items = spark.createDataFrame([(1, "A train leaves the station at 60 km and meets Anna after 3 hours, then Anna travels back at 60 km to the old town.")], "item_id long, text string")
    texts = [
        "Question: A train leaves the station at 75 km and meets Peter after 4 hours, then Peter travels back at 75 km to the old town. Answer",
        "A train leaves the station at 60 km and meets Anna after 3 hours, then Anna travels back at 60 km to the old town.",
        "so a train leaves the station at 75 km and meets Peter after 4 hours, then Maria travels back at 80 km to the old town.",
        "A bus leaves the harbour at 75 km and finds Peter after 4 hours, then he walks home.",
        "so a train departs the station at 75 km and meets Peter after 4 hours, then Maria travels back at 80 km to the old town.",
    ]
    got = {r.doc_id: r for r in find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items).collect()}
    assert set(got) == {0, 1} and got[1].exact and not got[0].exact and got[0].slots == 8


def test_windows_equal_brute_force(docs, local, spark):
    """Templates, windows and runs in plain Python; the items hold no values here, so each window that matches counts."""
    from graphloom.llm import decontaminate as D

    def words(t):
        t = re.sub(D.NUMBERS, D.NUMBER, t)
        t = re.sub(D.AFTER_NUMBER, lambda m: f"{m[1]} {D.UNIT} ", t)
        t = re.sub(D.NAMES, lambda m: f"{m[1]} {D.NAME} ", t).replace(D.NUMBER, f" {D.NUMBER} ")
        return [w for w in re.split(D.GAPS, t.lower()) if w]

    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    at = collections.defaultdict(list)
    for i, t in bench.collect():
        own = words(t)
        assert len(own) >= 8 and not {D.NUMBER, D.UNIT, D.NAME} & set(own)
        for k in range(len(own) - 7):
            at[tuple(own[k : k + 8])].append((i, k))
    runs = collections.defaultdict(set)
    for d, t in zip(local.doc_id, local.text, strict=True):
        own = words(t or "")
        for k in range(len(own) - 7):
            for i, j in at.get(tuple(own[k : k + 8]), ()):
                runs[d, i, k - j].add(j)
    want = collections.defaultdict(lambda: (0, 0))
    for (d, i, _), met in runs.items():
        want[d, i] = want[d, i][0] + len(met), max(want[d, i][1], max(met) + 8 - min(met))
    assert {(r.doc_id, r.item_id): (r.windows, r.words) for r in find_leaks(docs, bench).collect()} == dict(want)


def test_slots_may_merge_and_a_stray_one_costs_only_its_windows(spark):
    apples = "Tom thinks that a basket on the table has 3 apples and his sister buys 5 more of them today."
    passage = "the tank holds 60 litres of clean water when full and the pump in the cellar moves all of it up to the roof, where the other tank of 60 litres stands next to the old chimney of the house"
    items = spark.createDataFrame([(1, apples), (2, passage)], "item_id long, text string")
    texts = [apples.replace("3", "4").replace("5", "4"), passage[::-1].replace("06", "57", 1)[::-1], passage.replace("60", "75"), passage.replace("60", "75", 1).replace("60", "80", 1)]
    got = {(r.doc_id, r.item_id): r for r in find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items).collect()}
    assert set(got) == {(0, 1), (1, 2), (2, 2), (3, 2)} and not any(r.exact for r in got.values())
    whole = got[2, 2].windows
    assert got[1, 2].windows == whole - 8 and 0 < got[3, 2].windows < got[1, 2].windows


def test_items_of_numbers_are_found(spark):
    """Windows of few words: verbatim, and re-parameterised where a longer template has words enough."""
    texts = ["What is 15 % of 240 plus 3 / 4 of 96?", "Add 12 + 7 + 30 + 4.5 + 81 + 6 now", "Compute 15 % of 240"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    found = ["so what is 15 % of 240 plus 3 / 4 of 96? Well", "What is 20 % of 110 plus 1 / 2 of 48?", "add 12 + 7 + 30 + 4.5 + 81 + 6 now", "add 11 + 8 + 20 + 3.5 + 71 + 5 now", "compute 15 % of 240 please", "compute 16 % of 240 please"]
    got = {(r.doc_id, r.item_id): r.exact for r in find_leaks(spark.createDataFrame(list(enumerate(found)), "doc_id long, text string"), items).collect()}
    assert got == {(0, 0): True, (1, 0): False, (2, 1): True, (4, 2): True}


# WARC


def test_warc_records_parse_and_link(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = warc.record_bytes(warc.derive(warc.responses_of(pages))).collect()
    parsed = list(warc.parse_records(b"".join(bytes(r["record"]) for r in rows)))
    assert len(parsed) == len(rows) == 2 * pages.count()
    html = {r.url: r.html for r in pages.collect()}
    for (head, block), r in zip(parsed, rows, strict=True):
        assert head["WARC-Refers-To"] == r["record_id"] and int(head["Content-Length"]) == len(block)
        assert head["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        assert head["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(html[head["WARC-Target-URI"]].encode()).hexdigest()
        if head["WARC-Type"] == "metadata":
            assert b"source-content-type: text/html; charset=utf-8\r\n" in block and b"source-content-length: " in block
        else:
            assert b"<script" not in block and b"track(" not in block
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab"))
