"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct 5-word shingles (``words.shingle_sets``: ASCII lower case; a shorter text is one
shingle; no words, no shingles, no links). Two documents are linked if ``100 * |A & B| >= percent * |A | B|``.

1. Each set gets 64 permutations and keeps the minimum and the maximum under each: 128 signature values for 64 hash
   evaluations. Both are unbiased, and as they exclude each other a little, their mean varies less than that of 128
   minima. Bands of four values from four different permutations: at a similarity of 0.75 all 32 miss with 5e-6.
2. Equal sets become one node, so copies cost nothing further on.
3. Nodes that share a band's bucket are compared by their sketch (a byte of each signature value); those that may
   reach the threshold are joined to clusters. A bucket of any size is cut into blocks and worked off as pairs of
   blocks; a pair of blocks returns a spanning forest, never its pairs.
4. Within a cluster, again in pairs of blocks, full sets are compared exactly. Links found make the components.

Nulls and edges: rows with a null id are kept, without a component. Rows that repeat an id count as one document and
stay or go together. Null and empty texts have 0 shingles and stand alone. Other columns are not read. No rows, no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.llm.words import U64, blocks, mix, shingle_sets, words_of
from textkin.operators.graph import connected_components
from textkin.session import cut

SHINGLE = 5
PERCENT = 75
PERMUTATIONS = 64
BAND = 4
#: Share of sketch bytes that must agree: 0.75 less five standard deviations of 64 independent draws.
PLAUSIBLE = 0.48
#: Nodes of a block in the comparison of sketches, and of full sets.
SKETCH_BLOCK, SET_BLOCK = 1024, 256
#: Columns of a 0/1 matrix of shingles that one product takes.
CHUNK = 8192

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)

SIGNATURES = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"


def min_max(sets):
    """Minima and maxima of non-empty sets under every permutation: two ``(sets, permutations)`` arrays."""
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    x = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    low, high = (np.empty((len(sets), PERMUTATIONS), np.uint32) for _ in range(2))
    for p in range(PERMUTATIONS):
        v = x * _MUL[p] + _ADD[p]
        low[:, p] = np.minimum.reduceat(v, at)
        high[:, p] = np.maximum.reduceat(v, at)
    return low, high


def band_keys(low, high):
    """Bucket of each band: four minima of neighbouring permutations, or four maxima of distant ones."""
    n, per = len(low), PERMUTATIONS // BAND
    rows = np.concatenate([low.reshape(n, per, BAND), high.reshape(n, BAND, per).transpose(0, 2, 1)], axis=1).astype(U64)
    number = (np.arange(2 * per, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    return mix(mix((rows[..., 0] << U64(32) | rows[..., 1]) + number) + (rows[..., 2] << U64(32) | rows[..., 3]))


def _sign(batches):
    for batch in blocks(batches, "text"):
        sets = shingle_sets(words_of(batch["text"]), SHINGLE)
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        keys = np.zeros((2, len(sets)), np.int64)
        bands, lengths, sketch = np.empty(0, np.int64), np.zeros(len(sets), np.int32), [None] * len(sets)
        if len(full):
            held = [sets[i] for i in full]
            at = np.cumsum([0, *sizes[full][:-1]])
            every = np.concatenate(held)
            for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                keys[k, full] = np.add.reduceat(mix(every ^ U64(salt)), at).view(np.int64)
            low, high = min_max(held)
            bands = band_keys(low, high).view(np.int64).ravel()
            lengths[full] = 2 * PERMUTATIONS // BAND
            marks = np.concatenate([low, high], axis=1).astype(np.uint8)
            for row, i in enumerate(full.tolist()):
                sketch[i] = marks[row].tobytes()
        yield pa.RecordBatch.from_arrays([
            batch["doc_id"], pa.array(sizes), pa.array(keys[0]), pa.array(keys[1]),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(bands)),
            pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"])


def _groups(batches):
    """Whole groups of rows sorted by group (``g``, ``i``, ``j``): arrays node and data, and the groups' starts."""
    kept = None

    def told(table):
        g = np.stack([table[c].to_numpy() for c in ("g", "i", "j")])
        return np.concatenate([[0], np.flatnonzero((g[:, 1:] != g[:, :-1]).any(axis=0)) + 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        kept = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        starts = told(kept)
        if len(starts) > 1:
            yield kept.slice(0, starts[-1]), starts[:-1]
            kept = kept.slice(starts[-1])
    if kept is not None:
        yield kept, np.zeros(1, np.int64)


class _Forest:
    """Union-find over rows; ``edges`` holds the pairs that joined two trees."""

    def __init__(self, n):
        self.above, self.edges = list(range(n)), []

    def top(self, x):
        above = self.above
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    def join(self, x, y):
        a, b = self.top(x), self.top(y)
        if a != b:
            self.above[max(a, b)] = min(a, b)
            self.edges.append((x, y))

    def tops(self):
        return np.array([self.top(x) for x in range(len(self.above))])


def _edges(node, forest):
    pairs = np.array(forest.edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], ["src", "dst"])


def _plausible(batches):
    """Spanning forests of the pairs within a group whose sketches agree often enough."""
    for table, starts in _groups(batches):
        n = table.num_rows
        node = table["node"].to_numpy()
        marks = np.frombuffer(b"".join(table["data"].to_pylist()), np.uint8).reshape(n, -1)
        size = np.diff(np.append(starts, n))
        end = np.repeat(starts + size, size)
        forest, least = _Forest(n), PLAUSIBLE * marks.shape[1]
        tops = np.arange(n)
        for d in range(1, int(size.max())):
            x = np.flatnonzero(np.arange(n) + d < end)
            x = x[(tops[x] != tops[x + d]) & (node[x] != node[x + d])]
            for part in np.array_split(x, len(x) // 50_000 + 1):
                for y in part[(marks[part] == marks[part + d]).sum(axis=1) >= least].tolist():
                    forest.join(y, y + d)
            if d & (d - 1) == 0 or d % 64 == 0:
                tops = forest.tops()
        yield _edges(node, forest)


def shared_counts(sets):
    """Matrix of the numbers of elements that each two sorted sets share."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.concatenate([[True], every[1:] != every[:-1]])
    number = np.cumsum(first) - 1
    often = np.bincount(number)[number] > 1
    owner, number = owner[often], number[often]
    number = np.unique(number, return_inverse=True)[1] if len(number) else number
    out = np.zeros((m, m), np.int64)
    for low in range(0, int(number.max(initial=-1)) + 1, CHUNK):
        a, b = np.searchsorted(number, [low, low + CHUNK])
        x = np.zeros((m, min(CHUNK, int(number[b - 1]) - low + 1)), np.float32)
        x[owner[a:b], number[a:b] - low] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def _confirmed(percent):
    def run(batches):
        for table, starts in _groups(batches):
            node, data = table["node"].to_numpy(), table["data"]
            forest = _Forest(len(node))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(node)]):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(x.as_buffer(), U64) for x in data.slice(a, b - a)]
                size = np.array([len(s) for s in sets])
                both = shared_counts(sets)
                linked = 100 * both >= percent * (size[:, None] + size[None] - both)
                for x, y in np.argwhere(np.triu(linked, 1)).tolist():
                    forest.join(a + x, a + y)
            yield _edges(node, forest)
    return run


def _in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows ``(g, n, node, data)`` of groups of ``n`` nodes, dealt to the pairs of blocks of their group, in order.

    A group of at most ``size`` nodes is one block, and so one pair.
    """
    rows = rows.withColumn("b", F.ceil(F.col("n") / F.lit(size)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("b")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda o: F.struct(
        F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = rows.select("g", "node", "data", "b", F.explode(pairs).alias("p"))
    # A block's own pairs are compared wherever it meets another block.
    dealt = dealt.where("b = 1 or p.i <> p.j").select("g", "p.i", "p.j", "node", "data")
    return dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")


def near_duplicates(docs: DataFrame, id="doc_id", text="text", percent=PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    ``component_id`` is the smallest id that links reach; ``kept`` marks the document that has it.
    """
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signs = cut(texts.mapInArrow(_sign, SIGNATURES), "signatures")
    classes = signs.where("doc_id is not null and n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    whole = signs.join(classes, ["k1", "k2"], "left")
    rep = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("rep")).otherwise(F.col("doc_id"))
    first = (F.col("rep") == F.col("doc_id")) & (F.col("n_shingles") > 0)
    keyed = cut(whole.withColumn("rep", rep).select(
        "doc_id", "n_shingles", "rep", F.when(first, F.col("bands")).alias("bands"), F.when(first, F.col("sketch")).alias("sketch")),
        "classes", replaces=[signs])

    nodes = keyed.where("bands is not null")
    held = nodes.select(F.explode("bands").alias("g"), F.col("doc_id").alias("node"))
    shared = held.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    members = held.join(shared, "g").join(nodes.select(F.col("doc_id").alias("node"), F.col("sketch").alias("data")), "node")
    maybe = _in_blocks(members, SKETCH_BLOCK).mapInArrow(_plausible, "src long, dst long")
    clusters = cut(connected_components(maybe), "clusters")

    sizes = clusters.groupBy("label").agg(F.count("*").alias("n"))
    wanted = clusters.join(sizes, "label").select(F.col("id").alias("doc_id"), F.col("label").alias("g"), "n")
    # Texts are always dealt out by id: ids of all clusters are no bounded broadcast.
    sets = texts.join(wanted.hint("merge"), "doc_id").mapInArrow(_full_sets, "g long, n long, node long, data binary")
    links = _in_blocks(sets, SET_BLOCK).mapInArrow(_confirmed(percent), "src long, dst long")
    many = keyed.where("n_shingles > 0").select("doc_id", "rep").distinct()
    several = many.groupBy("doc_id").agg(F.min("rep").alias("src"), F.max("rep").alias("top")).where("src < top")
    repeated = many.join(several, "doc_id").select("src", F.col("rep").alias("dst"))
    labels = connected_components(links.unionByName(repeated)).toDF("rep", "label")
    found = F.coalesce("label", "rep")
    return keyed.join(labels, "rep", "left").select(
        "doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def _full_sets(batches):
    for batch in blocks(batches, "text"):
        sets = shingle_sets(words_of(batch["text"]), SHINGLE)
        yield pa.RecordBatch.from_arrays([batch["g"], batch["n"], batch["doc_id"], pa.array([s.tobytes() for s in sets], pa.binary())],
                                         ["g", "n", "node", "data"])


def drop_near_duplicates(docs: DataFrame, id="doc_id", text="text", percent=PERCENT) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; rows with a null id stay."""
    gone = near_duplicates(docs, id, text, percent).where("not kept").select(F.col("doc_id").alias(id)).distinct()
    return docs.join(gone, id, "left_anti").select(*docs.columns)
