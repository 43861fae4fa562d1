"""Benchmark decontamination: size-partitioned MinHash containment search, confirmed on full shingle sets.

An item is contained in a document if at least ``percent`` % of its distinct 5-word shingles (ASCII lower case) are among the
document's. An item of one to four words is contained where these words stand in a row.

1. Items are partitioned by size, at powers of two. A partition has one signature length, three quarters of its smallest size, up to
   ``SLOTS``: the shingles with the smallest and with the largest hash values (MinHash by bottom and top k of one
   permutation, so that they differ). Items of fewer than ``SMALLEST`` shingles, too few to choose from, keep all.
2. Each item has its own threshold of signature shingles that a document must hold. A document that contains it lacks at most
   ``n - ceil(n * percent / 100)`` of its n shingles; where the signature is longer than that, the rest of it must be
   there and nothing is missed. Longer items (from 128 shingles at 75 %) ask for the share less 6.5 standard deviations of
   a draw, which misses less than 1e-9, but for one shingle at least.
3. Documents pass a bit filter of all signature shingles, whose size is bounded; the few hits are joined with the
   signatures. Documents with too few words for an item are no candidates.
4. Candidates are confirmed on the full sets of item and document.

Nulls and edges: null or empty items and documents have no shingles and take part in nothing. Rows with a null id are not
searched; they stay in ``decontaminate``. Rows that repeat an id count as one. No rows, no rows. Other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.llm.tables import join_lookup
from textkin.llm.words import U64, blocks, mix, shingle_sets, windows, words_of
from textkin.session import cut

SHINGLE = 5
PERCENT = 75
#: Most shingles of a signature, and the size from which items have one.
SLOTS, SMALLEST = 64, 8
#: Bits of the filter per signature shingle, and its bounds in bytes.
FILTER_BITS = 32
FILTER_BYTES = (1 << 13, 1 << 26)
FILTER_TASKS = 4
HASHES = 4
PERMUTATION = 0x3C79AC492BA7B653

ITEMS = "item long, item_id long, n_item long, short int, need int, picked array<long>, shingles binary"
HITS = "doc_id long, n_words long, shingle long"
FOUND = "doc_id long, item_id long, shared long, n_item long"


def slots(n: int) -> int:
    """Signature length of the size partition of an item of ``n`` shingles."""
    low = 1 << (n.bit_length() - 1)
    return n if n < SMALLEST else min(SLOTS, 3 * low // 4)


def needed(n: int, percent=PERCENT) -> int:
    """Signature shingles that a document must hold to be a candidate for an item of ``n`` shingles."""
    k, lacking, p = slots(n), n + (-percent * n // 100), percent / 100
    return max(1, k - lacking, int(np.floor(k * p - 6.5 * np.sqrt(k * p * (1 - p)))) if n >= SMALLEST else 1)


def picked(shingles: np.ndarray) -> np.ndarray:
    """The signature: shingles with the smallest and the largest values under a permutation."""
    k = slots(len(shingles))
    order = np.argsort(mix(shingles ^ U64(PERMUTATION)), kind="stable")
    return shingles[np.concatenate([order[:k - k // 2], order[len(order) - k // 2:]])]


def _items(percent):
    def run(batches):
        for batch in blocks(batches, "text"):
            words = words_of(batch["text"])
            for item, item_id, n, s in zip(batch["item"].to_pylist(), batch["item_id"].to_pylist(), words.counts().tolist(), shingle_sets(words, SHINGLE)):
                if len(s):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([item], pa.int64()), pa.array([item_id], pa.int64()), pa.array([len(s)], pa.int64()),
                        pa.array([n if n < SHINGLE else 0], pa.int32()), pa.array([needed(len(s), percent)], pa.int32()), pa.array([picked(s).view(np.int64)], pa.list_(pa.int64())),
                        pa.array([s.tobytes()], pa.binary())], ["item", "item_id", "n_item", "short", "need", "picked", "shingles"])
    return run


def _bit(shingles, k, size):
    """The ``k``-th bit position of each shingle in a filter of ``size`` bits, a power of two."""
    return mix(shingles + U64(k)) >> U64(64 - size.bit_length() + 1)


def _filter(picked_rows: DataFrame, n: int) -> np.ndarray:
    """Bit filter of all signature shingles; its size follows their number up to a fixed bound."""
    size = 8 * FILTER_BYTES[0]
    while size < min(FILTER_BITS * n, 8 * FILTER_BYTES[1]):
        size *= 2

    def partial(batches):
        bits = np.zeros(size, bool)
        for batch in batches:
            for k in range(HASHES):
                bits[_bit(batch["shingle"].to_numpy().view(U64), k, size)] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits).tobytes()]})

    out = np.zeros(size // 8, np.uint8)
    for row in picked_rows.select("shingle").coalesce(FILTER_TASKS).mapInArrow(partial, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out


def _runs(words, hashes, k):
    """Hashes of all runs of ``k`` words that lie in one text, as ``shingle_sets`` gives them, and their texts."""
    w = windows(hashes, k)
    own = np.flatnonzero(words.left()[:len(w)] >= k)
    return w[own] ^ U64(k if k < SHINGLE else 0), np.repeat(np.arange(len(words.first) - 1), words.counts())[own]


def _search(held, lengths):
    """Signature shingles in documents; ``lengths``: numbers of words of the short items."""
    def run(batches):
        bits = held.value
        size = 8 * len(bits)
        for batch in blocks(batches, "text"):
            words = words_of(batch["text"])
            h, counts = words.hashes(lower=True), words.counts()
            values, docs = map(np.concatenate, zip(*[_runs(words, h, k) for k in [SHINGLE, *lengths]]))
            for k in range(HASHES):
                hit = _bit(values, k, size)
                keep = (bits[hit >> U64(3)] >> (U64(7) - (hit & U64(7))).astype(np.uint8) & 1).astype(bool)
                values, docs = values[keep], docs[keep]
            if len(values):
                rows = np.unique(np.stack([docs.astype(U64), values]), axis=1)
                i = rows[0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(i)), pa.array(counts[i]), pa.array(rows[1].view(np.int64))],
                                                 ["doc_id", "n_words", "shingle"])
    return run


def _confirm(percent):
    def run(batches):
        for batch in blocks(batches, "text"):
            words = words_of(batch["text"])
            h, sets = words.hashes(lower=True), shingle_sets(words, SHINGLE)
            for i, k in enumerate(batch["short"].to_pylist()):
                if k:
                    own = h[words.first[i]:words.first[i + 1]]
                    sets[i] = np.unique(windows(own, k) ^ U64(k))
            shared = np.array([len(np.intersect1d(s, np.frombuffer(x.as_buffer(), U64), assume_unique=True))
                               for s, x in zip(sets, batch["shingles"])], np.int64)
            keep = pa.array(100 * shared >= percent * batch["n_item"].to_numpy())
            out = pa.RecordBatch.from_arrays([batch["doc_id"], batch["item_id"], pa.array(shared), batch["n_item"]],
                                             ["doc_id", "item_id", "shared", "n_item"])
            yield out.filter(keep)
    return run


def contained_items(docs: DataFrame, bench: DataFrame, id="doc_id", text="text", item_id="item_id", item_text="text", percent=PERCENT) -> DataFrame:
    """``(doc_id, item_id, shared, n_item)`` of the items that a document contains, with the shingles they share."""
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    items = bench.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    items = cut(items.distinct().withColumn("item", F.xxhash64("item_id", "text")).mapInArrow(_items(percent), ITEMS), "items")
    signature = items.select("item", "n_item", "need", F.explode("picked").alias("shingle"))
    n = signature.count()
    lengths = sorted(r["short"] for r in items.where("short > 0").select("short").distinct().collect())  # at most four
    held = docs.sparkSession.sparkContext.broadcast(_filter(signature, n))
    hits = texts.mapInArrow(_search(held, lengths), HITS)
    met = join_lookup(hits, signature, "shingle", "inner", "item_signatures").where(F.col("n_words") >= F.col("n_item") * percent / 100)
    met = met.dropDuplicates(["doc_id", "item", "shingle"]).groupBy("doc_id", "item").agg(F.count("*").alias("held"), F.first("need").alias("need"))
    candidates = met.where("held >= need").select("doc_id", "item")
    wanted = join_lookup(candidates, items.select("item", "item_id", "n_item", "short", "shingles"), "item", "inner", "item_sets")
    found = join_lookup(texts, wanted, "doc_id", "inner", "candidates").select("doc_id", "text", "item_id", "n_item", "short", "shingles")
    best = found.mapInArrow(_confirm(percent), FOUND).groupBy("doc_id", "item_id").agg(
        F.max(F.struct((F.col("shared") / F.col("n_item")).alias("part"), "shared", "n_item")).alias("best"))
    return best.select("doc_id", "item_id", "best.shared", "best.n_item")


def decontaminate(docs: DataFrame, bench: DataFrame, id="doc_id", **options) -> DataFrame:
    """``docs`` without the documents that contain an item."""
    gone = contained_items(docs, bench, id=id, **options).select(F.col("doc_id").alias(id)).distinct()
    return docs.join(gone, id, "left_anti").select(*docs.columns)
