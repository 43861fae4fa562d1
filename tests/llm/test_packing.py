import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from textkin.llm import queries, token_ids
from textkin.llm.packing import Plan, assemble, combinations, nnls, pack
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, part int, n string"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def whole(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, 2]


def check(pieces, want, window):
    """Exact round trip, sequences without gaps, and no padding."""
    texts, sequences = {}, {}
    for r in pieces:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        texts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        used = sum(n for _, n in own)
        assert used == window or used < window and used & (used - 1) == 0
    assert sum(sum(n for _, n in s) < window for s in sequences.values()) <= 12
    found = Counter()
    for (doc, n), parts in texts.items():
        parts.sort()
        copies = sum(s == 0 for s, _ in parts)
        assert copies * n == sum(len(x) for _, x in parts)
        if copies == 1:
            assert [s for s, _ in parts] == [sum(len(x) for _, x in parts[:i]) for i in range(len(parts))]
            found[doc, tuple(i for _, x in parts for i in x)] += 1
        else:
            found[doc, n] += copies
    for (doc, key), n in found.items():
        assert sum(d == doc and (ids == key if isinstance(key, tuple) else len(ids) == key) for d, ids in want) == n
    assert sum(found.values()) == len(want)


def test_words_give_the_ids_of_whole_texts(plain):
    rng = np.random.default_rng(3)
    signs = list("aZ .é'–1,9̸Σßs't \n\u0085中x=ǅİ") + ["<|endoftext|>", "it's ", "the ", "The, "]
    texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(1500)] + [None, "", "it's we'll 'S 's.'t x'.s", "a<|startoftext|>b", "w " * 50_000]
    own = token_ids.encoder(PATH)
    assert own.by_words
    for size in (1, 97, 2000):
        for k in range(0, len(texts) if size > 1 else 50, size):
            ids, ends = own.encode(pa.array(texts[k:k + size], pa.string()))
            for i, text in enumerate(texts[k:k + size]):
                assert [*ids[ends[i]:ends[i + 1]].tolist(), 2] == whole(plain, text)


def test_forgotten_words_are_encoded_again(plain, monkeypatch):
    monkeypatch.setattr(token_ids, "KNOWN_WORDS", 20)
    own = token_ids.Encoder(PATH)
    for k in range(30):
        text = " ".join(f"w{chr(97 + i)}ord." for i in range(k % 26)) + " shared"
        assert [*own.encode(pa.array([text]))[0].tolist(), 2] == whole(plain, text) and len(own.known) < 80


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = token_ids.encoder(path)
    assert not own.by_words
    ids, ends = own.encode(pa.array(["Two words.", None, " x"]))
    want = [t.ids for t in Tokenizer.from_file(path).encode_batch(["Two words.", "", " x"], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want


def test_all_documents_of_a_table(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = [(r.doc_id, tuple(whole(plain, r.text))) for r in docs.collect()]
    pieces = pack(docs, PATH, 2).collect()
    check(pieces, want, 4096)
    got = sorted(map(tuple, queries.op11_packing(spark, sf).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    assert got == sorted((r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens) for r in pieces)


def test_nulls_repeats_and_long_texts(spark, plain):
    rows = [(None, None), (None, "a b"), (1, ""), (1, ""), (2, "x " * 70_000), (3, "same text of a copy")] + [(3, "same text of a copy")] * 500
    df = spark.createDataFrame([(*r, "x", 0, "y") for r in rows], SCHEMA).repartition(3)
    want = [(i, tuple(whole(plain, t))) for i, t in rows]
    for window in (64, 4096):
        check(pack(df, PATH, 2, window=window).collect(), want, window)
    assert pack(df.where("false"), PATH, 2).collect() == []


def test_assembled_sequences(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = pack(docs, PATH, 2)
    rows = assemble(pieces).collect()
    assert all(len(r.ids) // 4 in (4096, r.n_tokens) for r in rows)
    total = sum(len(whole(plain, r.text)) for r in docs.collect())
    assert sum(r.n_tokens for r in rows) == total and len(rows) <= total // 4096 + 12


def test_least_squares_against_all_active_sets():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.normal(size=(5, 4)), rng.normal(size=5)
        best = min((np.linalg.norm(a @ x - b) for m in range(16) for x in [np.zeros(4)]
                    for on in [[j for j in range(4) if m >> j & 1]]
                    for _ in [x.__setitem__(on, np.linalg.lstsq(a[:, on], b, rcond=None)[0]) if on else None] if (x >= -1e-12).all()))
        x = nnls(a, b)
        assert (x >= 0).all() and abs(np.linalg.norm(a @ x - b) - best) < 1e-8


def test_plans_use_every_place_once():
    rng = np.random.default_rng(7)
    assert all(sum(c) == 64 for c in combinations()) and (32, 32) in combinations() and (4,) * 16 in combinations()
    for n, hot in ((3, 0), (400, 0), (400, 5000), (0, 999)):
        histogram = {k: int(v) for k, v in Counter(rng.integers(1, 256, n).tolist()).items()} | ({200: hot} if hot else {})
        plan = Plan(histogram, 256)
        filled = {}
        for length, count in histogram.items():
            for place in range(count):
                own = list(plan.of(length, place))
                assert sum(m for _, m, _, _ in own) == length and own[0][0] == 0
                for _, m, q, o in own:
                    filled.setdefault(q, []).append((o, m))
        assert sorted(filled) == list(range(plan.sequences))
        for own in filled.values():
            own.sort()
            assert all(a + m == b for (a, m), (b, _) in zip(own, own[1:])) and own[0][0] == 0
        sizes = [sum(m for _, m in own) for own in filled.values()]
        assert all(s == 256 or s & (s - 1) == 0 for s in sizes) and sum(s < 256 for s in sizes) <= 8
    big = Plan({k: 10_000 * k for k in range(1, 256)}, 256)
    assert big.steps < 5000 and big.solved > 0.5 * big.sequences
