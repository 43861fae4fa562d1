"""Removal of word sequences that an earlier document holds too, by level-wise doubling of repeated windows.

A word is covered if some window of ``length`` consecutive words around it also starts in a document with a smaller id;
covered words go. Windows are judged on the input. Words are compared unchanged and whole texts are read.

Lengths run from a short one to ``length``, each about twice the one before (13: 7, 13). Only windows that are repeated
at one length are looked at at the next:

1. A window of the second length holds several windows of the first; it is represented by the one with the smallest
   hash, which equal windows share. These representatives, a quarter of all positions, are the first level.
2. At every further level a window is a candidate if what it was doubled from is repeated; candidates are hashed again.
3. Windows repeated at the last length carry the smallest id they start in.

Documents are dealt once to blocks of about ``BLOCK_BYTES`` of text; every level sends each distinct hash of a block once,
so a passage in a third of all documents costs one entry per block. Hashes meet in buckets whose number grows with the
text. The first levels only exclude windows; the last takes 95 bits of hash.

Nulls and edges: null texts have no words. Rows with a null id lose nothing and are no source. Rows with one id are one
document: none is earlier than another. Copies of an id are never a source for each other. No rows, no rows. Other
columns are not read.
"""

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.llm.words import U64, mix, windows, words_of

LENGTH = 13
SHORTEST = 7
BLOCK_BYTES = 2_000_000
#: Text whose hashes share a bucket.
BUCKET_BYTES = 32_000_000

ENTRIES = "bucket long, block long, entries binary"
REPEATED = "block long, entries binary"
KEPT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,stop:long>>"

#: An entry of the levels that only exclude: 63 bits of hash, and in the lowest bit whether several documents of the block hold it.
HINT = np.dtype([("h", "<u8")])
#: An entry of the last level: hash, 31 further bits with the same lowest bit, smallest id.
FULL = np.dtype([("h", "<u8"), ("x", "<u4"), ("first", "<i8")])
_FLAG = U64(1)


def levels(length=LENGTH, shortest=SHORTEST) -> list[int]:
    """Window lengths of the levels, the last being ``length``."""
    out = [length]
    while out[0] > shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _sliding_min(x, width):
    """Minimum of each ``width`` consecutive values."""
    done, n = 1, len(x) - width + 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x[:n]


class _Block:
    """Words of a block's documents; documents come in the order of their ids."""

    def __init__(self, docs: pa.Table):
        docs = docs.take(pc.sort_indices(docs["doc_id"])).combine_chunks()
        self.ids = docs["doc_id"].to_numpy()
        self.texts = docs["text"].combine_chunks() if docs.num_rows else pa.array([], pa.string())
        if isinstance(self.texts, pa.ChunkedArray):
            self.texts = self.texts.chunk(0)
        self.words = words_of(self.texts)
        self.h = self.words.hashes()
        self.left = self.words.left()
        self.doc = np.repeat(self.ids, self.words.counts())

    def at(self, k):
        """Start positions of the windows of ``k`` words that lie in one document, and their hashes."""
        w = windows(self.h, k)
        p = np.flatnonzero(self.left[:len(w)] >= k)
        return p, w


def _within(values, sorted_):
    if not len(sorted_):
        return np.zeros(len(values), bool)
    i = np.searchsorted(sorted_, values)
    i[i == len(sorted_)] = 0
    return sorted_[i] == values


def _read(back: pa.Table, kind):
    return np.concatenate([np.empty(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in back["entries"]]])


def _representatives(block, short, long):
    """Start positions of the windows of ``long`` words, and the smallest hash of the ``short`` windows in each."""
    p, _ = block.at(long)
    low = _sliding_min(windows(block.h, short), long - short + 1)
    return p, low[p] & ~_FLAG


def _candidates(block, steps, level, back):
    """Positions and hashes of the windows of ``steps[level]`` words that the level below doesn't exclude."""
    known = np.sort(_read(back, HINT)["h"] & ~_FLAG)
    if level == 1:
        p, low = _representatives(block, steps[0], steps[1])
        p = p[_within(low, known)]
        return p, windows(block.h, steps[1])[p]
    p, w = block.at(steps[level])
    part = _within(windows(block.h, steps[level - 1]) & ~_FLAG, known)
    p = p[part[p] & part[p + steps[level] - steps[level - 1]]]
    return p, w[p]


def _distinct(h, doc):
    """Each distinct hash once, with the flag. Positions come in the order of ids, so equal hashes do too."""
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    last = np.append(at[1:], len(h)) - 1
    out = np.empty(len(at), HINT)
    out["h"] = h[at] | (doc[at] != doc[last]).astype(U64)
    return out


def _dealt(block_no, entries, buckets):
    """Rows of a block's entries by bucket. Low hashes are as even as high ones only in their lower bits."""
    bucket = (entries["h"] >> U64(8)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    bucket, entries = bucket[order], entries[order]
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    blobs = [entries[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(bucket)))]
    return pa.table({"bucket": pa.array(bucket[at], pa.int64()), "block": pa.array([block_no] * len(at), pa.int64()),
                     "entries": pa.array(blobs, pa.binary())})


def _level(steps, level, buckets):
    """What a block sends at a level; above the first it knows what was repeated below."""
    last = level == len(steps) - 1

    def send(docs, back=None):
        block = _Block(docs)
        if level == 0:
            p, h = _representatives(block, steps[0], steps[min(1, len(steps) - 1)])
        else:
            p, h = _candidates(block, steps, level, back)
        if not last:
            entries = _distinct(h & ~_FLAG, block.doc[p])
        else:
            entries = _final(h, _check(block, p, steps[level]), block.doc[p])
        return _dealt(docs["block"][0].as_py() if docs.num_rows else 0, entries, buckets)

    return (lambda docs: send(docs)) if level == 0 else (lambda docs, back: send(docs, back))


def _check(block, p, k):
    """31 bits of a second, independent hash of the windows."""
    return (windows(mix(block.h ^ U64(0xA0761D6478BD642F)), k)[p] >> U64(33)).astype(np.uint32) << np.uint32(1)


def _final(h, check, doc):
    order = np.lexsort((check, h))  # stable: ids stay in order
    h, check, doc = h[order], check[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])]) if len(h) else np.empty(0, bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(h)) - 1
    out = np.empty(len(at), FULL)
    out["h"], out["x"], out["first"] = h[at], check[at] | (doc[at] != doc[last]).astype(np.uint32), doc[at]
    return out


def _meet(kind):
    """Of a bucket's entries those that several documents hold, sent back to the blocks they came from."""

    def run(rows):
        blobs = [np.frombuffer(x.as_buffer(), kind) for x in rows["entries"]]
        every = np.concatenate(blobs)
        if kind is HINT:
            key = every["h"] >> _FLAG
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            several = (every["h"] & _FLAG).astype(bool)
        else:
            a, b = every["h"], every["x"] >> np.uint32(1)
            order = np.lexsort((b, a))
            new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
            several = (every["x"] & np.uint32(1)).astype(bool)
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(order)))
        hit = np.repeat((count > 1) | np.logical_or.reduceat(several[order], at), count)
        repeated = np.empty(len(order), bool)
        repeated[order] = hit
        out = every.copy()
        if kind is FULL:
            out["first"][order] = np.repeat(np.minimum.reduceat(every["first"][order], at), count)
        ends = np.cumsum([len(x) for x in blobs])
        back = [out[a:b][repeated[a:b]].tobytes() for a, b in zip(ends - [len(x) for x in blobs], ends)]
        full = [i for i, x in enumerate(back) if x]
        return pa.table({"block": rows["block"].combine_chunks().take(pa.array(full, pa.int64())) if full else pa.array([], pa.int64()),
                         "entries": pa.array([back[i] for i in full], pa.binary())})

    return run


def _kept(ids, texts, words, covered):
    """Result rows: words that stay, joined by a space, and the spans of words that go."""
    counts, first = words.counts(), words.first
    before = np.concatenate([[0], np.cumsum(covered)])
    gone = before[first[1:]] - before[first[:-1]]
    kept = []
    keep = ~covered
    for text, a, b, n in zip(texts.to_pylist(), first[:-1].tolist(), first[1:].tolist(), gone.tolist()):
        own = (text or "").encode().split()
        kept.append(b" ".join(compress(own, keep[a:b].tolist()) if n else own).decode())
    begins, ends = covered.copy(), covered.copy()
    if len(covered):
        heads = first[:-1][counts > 0]
        begins[1:] &= keep[:-1]
        begins[heads] = covered[heads]
        ends[:-1] &= keep[1:]
        ends[first[1:][counts > 0] - 1] = covered[first[1:][counts > 0] - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    at = np.searchsorted(start, first)
    base = np.repeat(first[:-1], np.diff(at))
    spans = pa.StructArray.from_arrays([pa.array(start - base), pa.array(stop - base)], ["start", "stop"])
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                     "kept": pa.array(kept, pa.string()), "spans": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans)})


def _remove(steps):
    length = steps[-1]

    def run(docs, back):
        block = _Block(docs)
        known = _read(back, FULL)
        known = known[np.lexsort((known["x"], known["h"]))]
        p, w = block.at(length)
        h = w[p]
        some = _within(h, known["h"])
        p, h = p[some], h[some]
        x = _check(block, p, length) >> np.uint32(1)
        pair = np.empty(len(p), [("h", "<u8"), ("x", "<u4")])
        first = np.full(len(p), np.iinfo(np.int64).max)
        low, high = np.searchsorted(known["h"], h, "left"), np.searchsorted(known["h"], h, "right")
        for step in range(int((high - low).max(initial=0))):  # more than one only if 64 bits of different windows agree
            i = np.minimum(low + step, len(known) - 1)
            same = (low + step < high) & (known["x"][i] >> np.uint32(1) == x)
            first[same] = known["first"][i][same]
        p = p[first < block.doc[p]]
        change = np.zeros(len(block.h) + 1, np.int64)
        np.add.at(change, p, 1)
        np.add.at(change, p + length, -1)
        return _kept(block.ids, block.texts, block.words, np.cumsum(change)[:-1] > 0)

    return run


def _untouched(batches):
    for batch in batches:
        words = words_of(batch["text"])
        out = _kept([None] * batch.num_rows, batch["text"], words, np.zeros(len(words), bool))
        yield from out.to_batches()


def remove_repeats(docs: DataFrame, id="doc_id", text="text", length=LENGTH, shortest=SHORTEST) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, spans)`` per row: the words that stay, and the word spans that go."""
    steps = levels(length, shortest)
    if len(steps) == 1:  # no shorter length to start from: windows represent themselves
        steps = [length, length]
    spark = docs.sparkSession
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    known = texts.where("doc_id is not null").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    by_block = known.groupBy("block")
    back = None
    for level in range(len(steps)):
        send, kind = _level(steps, level, buckets), FULL if level == len(steps) - 1 else HINT
        held = by_block if back is None else by_block.cogroup(back.groupBy("block"))
        sent = held.applyInArrow(send, ENTRIES)
        back = sent.groupBy("bucket").applyInArrow(_meet(kind), REPEATED)
    done = by_block.cogroup(back.groupBy("block")).applyInArrow(_remove(steps), KEPT)
    return done.unionByName(texts.where("doc_id is null").mapInArrow(_untouched, KEPT))
