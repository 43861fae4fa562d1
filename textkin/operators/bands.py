"""Neighbour search by bands of random hyperplanes: the candidates of a very large collection by equi-joins.

The sides on which a vector lies of seeded random hyperplanes are cut into bands; vectors that agree in all bits of a band
meet in its bucket and are compared exactly there. Vectors at an angle agree in a bit with probability 1 - angle / pi,
whatever they are, so the largest distance alone gives the width of the bands and how many are needed to miss a pair
at that distance with ``MISSED`` at most. What is found never depends on the size of a table.

Vectors that share a large part, as averaged word vectors do, all lie on the same sides. Where the mean of the unit vectors is longer
than ``OFFSET`` it is subtracted: distances stay, while directions spread. The angle of a pair at the largest distance then
follows from how far the vectors are from the mean, so vectors are put into layers by that length, each with
bands of its own. A pair's lengths differ by its distance at most: a vector is a guest in the lower layers within that
reach, where guests are compared with owners only. Near the mean, and for distances at which bands would say nothing (they
would need more than ``MAX_BANDS`` or bring more than ``MET`` of all pairs together), all vectors are one bucket and every pair is compared.
Where that holds of the whole table (``says_nothing``), the exact search does it (``operators/exact.py``).

A bucket of any size is cut into blocks and worked off as pairs of blocks; buckets of one vector, or of guests only, are
dropped before any vector is sent.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.session import cut

#: Vectors of a block, and bytes of them as doubles: the less of the two. A vector of a large bucket is sent once per other block.
BLOCK, BLOCK_BYTES = 16384, 8 << 20
#: Distances that are held at once.
TILE = 1 << 22
#: Share of pairs at the largest distance that a choice of bands may miss, most bands, and widest bands.
MISSED, MAX_BANDS, MAX_WIDTH = 0.01, 128, 16
#: Largest share of unrelated pairs that a choice of bands may bring together.
MET = 0.25
#: Vectors that are as dear to compare with as one more band is to send a vector to.
MEETINGS = 2048
#: Length of the mean unit vector from which it is subtracted.
OFFSET = 0.75
#: Lengths at which layers begin, from the outermost down, are these times the powers of the step.
OUTERMOST, LAYER_STEP = 0.9, 0.5 ** 0.5
SEED = 20240517


def bands_for(angle: float, missed=MISSED):
    """``(bits per band, bands)`` that miss a pair at ``angle`` with probability ``missed`` at most, or ``None``.

    Of all widths the one that sends and compares least.
    """
    agree, options = 1 - angle / np.pi, []
    for width in range(4, MAX_WIDTH + 1):
        bands = int(np.ceil(np.log(missed) / np.log1p(-agree ** width)))
        if bands <= MAX_BANDS and bands <= MET * 2 ** width:
            options.append((bands * (1 + MEETINGS / 2 ** width), width, bands))
    return min(options)[1:] if options else None


def layers(max_dist: float, centred: bool) -> list[tuple]:
    """``(length from which it holds, bits per band, bands)`` of each layer, outermost first; the last one is the rest, without bands."""
    out = []
    if not centred:
        chosen = bands_for(2 * np.arcsin(min(1.0, max_dist / 2)))
        return [(0.0, *chosen)] if chosen else [(0.0, 0, 1)]
    low = OUTERMOST
    while max_dist < low and (chosen := bands_for(np.arcsin(max_dist / low))):
        out.append((low, *chosen))
        low *= LAYER_STEP
    return [*out, (0.0, 0, 1)]


def says_nothing(max_dist: float) -> bool:
    """Whether every pair is compared at this distance, wherever the mean lies."""
    return all(not width for centred in (False, True) for _, width, _ in layers(max_dist, centred))


def planes(dims: int, n: int) -> np.ndarray:
    """Normals of the first ``n`` hyperplanes for vectors of ``dims`` components."""
    return np.random.default_rng([SEED, dims]).standard_normal((n, dims)).round(2)


def unit_vectors(vecs):
    """Unit vectors as rows, and which have a direction."""
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vecs])
    good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
    m[~good] = 1
    return m / np.sqrt((m * m).sum(axis=1))[:, None], good


def mean_direction(members: DataFrame, dims: int) -> np.ndarray:
    """Mean of all unit vectors, to three decimals."""

    def partial(batches):
        total, n = np.zeros(dims), 0
        for batch in batches:
            if batch.num_rows:
                m, good = unit_vectors(batch["vec"].to_pylist())
                total, n = total + m[good].sum(axis=0), n + int(good.sum())
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(dims)), "total": pa.array(total), "n": pa.array(np.full(dims, n))})

    rows = members.select("vec").mapInArrow(partial, "at long, total double, n long").groupBy("at").agg(F.sum("total").alias("s"), F.sum("n").alias("n"))
    out = np.zeros(dims)
    for r in rows.collect():  # one row per component
        out[r["at"]] = r["s"] / max(1, r["n"])
    return out.round(3)


def band_keys(vec, dims: int, max_dist: float, centre=None):
    """Array of the buckets of a vector (empty for vectors without direction): ``2 * bucket``, plus 1 where the vector owns it."""
    found = layers(max_dist, centre is not None)
    normals = planes(dims, max(w * b for _, w, b in found))

    @F.pandas_udf("array<long>")
    def keys(vecs: pd.Series) -> pd.Series:
        m, good = unit_vectors(vecs)
        if centre is not None:
            m = m - centre
        length = np.sqrt((m * m).sum(axis=1))
        side = np.round(m @ normals.T, 4) > 0
        out, above = [[] for _ in range(len(m))], np.inf
        for k, (low, width, bands) in enumerate(found):
            bits = side[:, :width * bands].reshape(len(m), bands, width) @ (1 << np.arange(width, dtype=np.int64))
            cell = (bits + ((np.arange(bands, dtype=np.int64) + (k << 10)) << 32)) * 2
            own = (length >= low) & (length < above)
            guest = (length >= above) & (length - max_dist < above)
            for rows, mark in ((own, 1), (guest, 0)):
                for i in np.flatnonzero(rows & good).tolist():
                    out[i] += (cell[i] + mark).tolist()
            above = low
        return pd.Series(out)

    return keys(vec)


def _compare(n, max_dist, digits, rep_cols):
    """The best ``n`` corpus vectors of every target within one group of a sorted stream."""

    def group(t):
        vecs = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        vecs /= np.sqrt((vecs * vecs).sum(axis=1))[:, None]
        left, right, own = (t[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("t", "c", "own"))
        # Guests meet owners only.
        for a, b in ((left & own, right), (left & ~own, right & own)):
            a, b = np.flatnonzero(a), np.flatnonzero(b)
            if not len(a) or not len(b):
                continue
            step = max(1, TILE // len(b))
            for first in range(0, len(a), step):
                part = a[first:first + step]
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (vecs[part] @ vecs[b].T))).round(digits)
                d[part[:, None] == b[None]] = np.inf  # itself is known
                limit = np.full(len(part), max_dist)
                if len(b) > n:
                    limit = np.minimum(limit, np.partition(d, n - 1, axis=1)[:, n - 1])
                rows, cols = np.nonzero(d <= limit[:, None])
                at = pa.array(b[cols])
                yield pa.table({"tvid": t["vid"].take(pa.array(part[rows])), "mvid": t["vid"].take(at), "dist": pa.array(d[rows, cols]),
                                **{c: t[c].take(at) for c in rep_cols}})

    def run(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([batch])
            kept = batch if kept is None else pa.concat_tables([kept, batch])
            key = np.stack([kept[c].to_numpy() for c in ("cell", "i", "j")])
            starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])
            for a, b in zip(starts[:-1], starts[1:]):
                for found in group(kept.slice(a, b - a)):
                    yield from found.to_batches()
            kept = kept.slice(starts[-1])
        if kept is not None:
            for found in group(kept):
                yield from found.to_batches()

    return run


def buckets(members: DataFrame, max_dist: float, dims: int, keep=("vid", "t", "c")) -> DataFrame:
    """``keep`` of ``members`` with their buckets; see ``band_keys``."""
    centre = mean_direction(members, dims)
    if np.sqrt((centre * centre).sum()) < OFFSET:
        centre = None
    return members.select(*keep, band_keys(F.col("vec"), dims, max_dist, centre).alias("cells"))


def banded_hits(members: DataFrame, n: int, max_dist: float, rep_cols, dims: int, digits: int) -> DataFrame:
    """``(tvid, mvid, dist, rep...)`` of the pairs of ``members(vid, vec, t, c, rep...)`` that share a bucket and lie within ``max_dist``.

    ``t`` and ``c`` mark targets and corpus; a table that ``cut`` wrote goes once its buckets are written. A target takes at most ``n`` from a pair of blocks. Every target that is in the
    corpus finds itself.
    """
    # Written once; a vector goes by its number, not its id, until it meets its blocks. Bits of ``mark``: target, corpus, owner.
    numbered = members.withColumn("no", F.monotonically_increasing_id())
    keyed = cut(buckets(numbered, max_dist, dims, numbered.columns), "keyed", [members] if hasattr(members, "cut_path") else [])
    block = max(1, min(BLOCK, BLOCK_BYTES // (8 * dims)))
    flags = F.when(F.col("t"), 1).otherwise(0) + F.when(F.col("c"), 2).otherwise(0)
    held = keyed.select("no", flags.alias("flags"), F.explode("cells").alias("key")).select(
        F.shiftright("key", 1).alias("cell"), "no", (F.col("flags") + F.when(F.col("key") % 2 == 1, 4).otherwise(0)).cast("byte").alias("mark"))
    sizes = held.groupBy("cell").agg(F.count("*").alias("n"), F.bit_or("mark").alias("marks")).where("n > 1 AND marks = 7")
    met = held.join(sizes.select("cell", "n"), "cell").select("cell", "no", (F.col("mark") >= 4).alias("own"), F.ceil(F.col("n") / block).cast("int").alias("b"))
    met = met.withColumn("at", F.pmod(F.xxhash64("no"), F.col("b")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda o: F.struct(F.least("at", o).alias("i"), F.greatest("at", o).alias("j")))
    dealt = met.select("cell", "no", "own", "b", F.explode(pairs).alias("p")).where("b = 1 OR p.i <> p.j").select("cell", "p.i", "p.j", "no", "own")
    rows = dealt.join(keyed.drop("cells"), "no").select("cell", "i", "j", "vid", "vec", "t", "c", "own", *rep_cols)
    rows = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    types = {f.name: f.dataType.simpleString() for f in members.schema}
    schema = "tvid string, mvid string, dist double" + "".join(f", {r} {types[r]}" for r in rep_cols)
    found = rows.mapInArrow(_compare(n, max_dist, digits, rep_cols), schema)
    itself = keyed.where((F.size("cells") > 0) & F.col("t") & F.col("c")).select(
        F.col("vid").alias("tvid"), F.col("vid").alias("mvid"), F.lit(0.0).alias("dist"), *rep_cols)
    return found.unionByName(itself).dropDuplicates(["tvid", "mvid"])


def bands_sql(dims: int, max_dist: float, vec="vec") -> str:
    """The same buckets as an SQL list (DuckDB), for vectors whose mean is not subtracted."""
    (_, width, bands), = layers(max_dist, False)
    normals, parts = planes(dims, width * bands).tolist(), []
    scale = f"sqrt(list_dot_product({vec}::DOUBLE[], {vec}::DOUBLE[]))"
    for b in range(bands):
        bits = [f"CASE WHEN round(list_dot_product({vec}::DOUBLE[], {normals[width * b + k]}::DOUBLE[]) / {scale}, 4) > 0 THEN {1 << k} ELSE 0 END"
                for k in range(width)]
        parts.append(" + ".join([f"{b << 32}::BIGINT", *bits]))
    return "[" + ", ".join(parts) + "]"
