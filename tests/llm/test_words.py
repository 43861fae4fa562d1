import pyarrow as pa

from textkin.llm.words import blocks, shingle_sets, windows, words_of

TEXTS = ["a b  c", None, "", "ab", "b\tc\nd ", " x", "ünï cödé A", " nb sp", "tail\x0b\x0cend"]


def test_words_are_split_like_ascii_white_space():
    w = words_of(pa.array(TEXTS))
    got = [[bytes(w.data[s:e]) for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [(t or "").encode().split() for t in TEXTS]
    assert w.left().tolist() == [len(g) - i for g in got for i in range(len(g))]


def test_hashes_depend_on_words_alone():
    a = words_of(pa.array(["x Some words", "here"])).hashes()
    b = words_of(pa.array(["here and Some more words", "x"])).hashes()
    assert a[3] == b[0] and a[1] == b[2] and a[2] == b[4] and a[0] == b[5] and len(set(a.tolist())) == 4
    assert words_of(pa.array(["ABC Ü"])).hashes(lower=True).tolist() == words_of(pa.array(["abc Ü"])).hashes().tolist()
    assert words_of(pa.array(["ü"])).hashes(lower=True)[0] != words_of(pa.array(["Ü"])).hashes(lower=True)[0]


def test_slices_of_arrays_and_very_long_texts():
    long = "lorem ipsum " * 400_000
    arr = pa.array(["skip me", "a b", long])
    w = words_of(arr.slice(1))
    assert w.counts().tolist() == [2, 800_000]
    h = w.hashes()
    assert h[2] == h[4] and h[-1] == h[3]
    parts = list(blocks(iter(pa.Table.from_pydict({"t": ["x" * 10, None, "y" * 30, "z" * 5]}).to_batches()), "t", 20))
    assert [p.num_rows for p in parts] == [2, 1, 1]


def test_shingle_sets():
    texts = ["a b c d e f a b c d e", "A B C D E", "a b", "a b c", "", None, "b a"]
    sets = shingle_sets(words_of(pa.array(texts)))
    assert [len(s) for s in sets] == [6, 1, 1, 1, 0, 0, 1]
    assert sets[1][0] in sets[0] and len({s[0] for s in (sets[2], sets[3], sets[6])}) == 3
    assert len(windows(words_of(pa.array(["a b"])).hashes(), 3)) == 0
