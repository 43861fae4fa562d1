"""Exact nearest neighbours between blocks: each target's own block bounds what other blocks it has to meet.

Corpus vectors are put into the cells of their nearest pivots, and the cells cut into rings by the distance to the pivot. A ring's
block keeps, for its own pivot and for ``REFERENCES`` pivots that all blocks share, the interval in which the distances of its members lie.

1. Every target is compared with the block it would lie in. The distance of the last place it could fill there is an upper
   bound.
2. By the triangle inequality, the distance to a pivot and a block's interval bound the distance to all of its members from
   below; so does the plane between two pivots. A target has to meet only blocks whose bound is not above its own.
3. Targets of neighbouring blocks make up a run, and so do corpus blocks. A pair of runs is a unit: its corpus is what some target of the
   run has to meet, and goes by in a stream while a task keeps the best of each target. So a target is sent once per run of the corpus,
   a corpus vector once per run of targets, and only the best leave a task.

Blocks of more than ``BLOCK_ROWS`` vectors, where rings are full of ties, are split by hash, and so are their targets. A task holds ``TARGETS``
targets with their best and the ids of ``CORPUS`` corpus vectors. What the driver holds is bounded by ``MAX_CELLS * RINGS`` intervals.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.session import cut

BLOCK_ROWS = 2048
#: Most targets and most corpus vectors of a unit, targets that are compared at a time, and most partitions of units.
TARGETS, CORPUS, TILE, MAX_PARTS = 1 << 15, 1 << 17, 1024, 1 << 12
MAX_CELLS, RINGS, REFERENCES = 1024, 32, 16
SLACK = 1e-6


def unit_rows(m: np.ndarray):
    norms = np.sqrt((m * m).sum(axis=1))
    ok = np.isfinite(norms) & (norms > 0)
    m[ok] /= norms[ok, None]
    m[~ok] = 0
    return m, ok


def stacked(series: pd.Series):
    return unit_rows(np.stack([np.asarray(v, dtype=np.float64) for v in series]))


def chord(a, b):
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class Blocks:
    """Cells, rings and intervals of a corpus ``(vid, vec, ...)``, which is written with them."""

    def __init__(self, corpus: DataFrame, pivots: np.ndarray):
        self.pivots = pivots[:MAX_CELLS]
        self.references = self.pivots[:REFERENCES]
        at = self._place()(F.col("vec"))
        placed = cut(corpus.withColumn("a", at).select(*corpus.columns, "a.*").where("cell >= 0"), "cells")
        counts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("d", [k / RINGS for k in range(1, RINGS)], 1000).alias("edges"))
        # At most MAX_CELLS rows.
        self.edges = {}
        for r in counts.collect():
            rings = min(RINGS, -(-r["n"] // BLOCK_ROWS))
            self.edges[r["cell"]] = np.array([r["edges"][k * RINGS // rings - 1] for k in range(1, rings)])
        blocked = placed.withColumn("block", self._ring()(F.col("cell"), F.col("d")))
        sides = [f(F.col("refs")[k]).alias(f"{name}{k}") for k in range(len(self.references)) for f, name in ((F.min, "lo"), (F.max, "hi"))]
        # At most MAX_CELLS * RINGS rows.
        rows = blocked.groupBy("block").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), *sides).orderBy("block").collect()
        self.blocks = np.array([r["block"] for r in rows], dtype=np.int64)
        self.sizes = np.array([r["n"] for r in rows], dtype=np.int64)
        self.slots = np.array([-(-r["n"] // BLOCK_ROWS) for r in rows], dtype=np.int64)
        own = [[r[s] for s in ("lo", "hi")] for r in rows]
        shared = [[[r[f"lo{k}"], r[f"hi{k}"]] for k in range(len(self.references))] for r in rows]
        self.own = np.array(own, dtype=np.float64).reshape(len(rows), 2)
        self.shared = np.array(shared, dtype=np.float64).reshape(len(rows), len(self.references), 2)
        self.corpus = self._units(blocked)

    def _place(self):
        pivots, n = self.pivots, len(self.references)

        @F.pandas_udf("struct<cell:int,d:double,refs:array<double>>")
        def place(vecs: pd.Series) -> pd.DataFrame:
            m, ok = stacked(vecs)
            d = chord(m, pivots)
            cell = d.argmin(axis=1)
            return pd.DataFrame({"cell": np.where(ok, cell, -1).astype("int32"), "d": d[np.arange(len(cell)), cell], "refs": list(d[:, :n])})

        return place

    def _ring(self):
        edges = self.edges

        @F.pandas_udf("long")
        def ring(cells: pd.Series, d: pd.Series) -> pd.Series:
            none = np.empty(0)
            return pd.Series([c * RINGS + int(np.searchsorted(edges.get(c, none), x)) for c, x in zip(cells, d)], dtype="int64")

        return ring

    def _units(self, rows: DataFrame) -> DataFrame:
        """``block`` and ``slot``: the piece of the block in which a vector lies."""
        blocks, slots = self.blocks, self.slots

        @F.pandas_udf("long")
        def pieces(block: pd.Series) -> pd.Series:
            at = np.minimum(np.searchsorted(blocks, block.to_numpy()), max(0, len(blocks) - 1))
            return pd.Series(np.where(blocks[at] == block.to_numpy(), slots[at], 1) if len(blocks) else np.ones(len(block), dtype=np.int64))

        return rows.withColumn("slot", F.pmod(F.xxhash64("vid"), pieces(F.col("block"))))

    def place(self, targets: DataFrame) -> DataFrame:
        """``(vid, vec, block, slot)`` of targets that are not in the corpus."""
        at = self._place()(F.col("vec"))
        rows = targets.withColumn("a", at).select("vid", "vec", "a.cell", "a.d").where("cell >= 0")
        return self._units(rows.withColumn("block", self._ring()(F.col("cell"), F.col("d"))))

    def chain(self) -> np.ndarray:
        """Places of all blocks, those of each cell after those of the nearest one that is not yet in the chain."""
        cells = self.blocks // RINGS
        present = np.unique(cells)
        between, order = chord(self.pivots, self.pivots), []
        left = np.zeros(len(self.pivots), dtype=bool)
        left[present] = True
        at = present[0] if len(present) else None
        while at is not None:
            order.append(at)
            left[at] = False
            at = int(np.where(left, between[at], np.inf).argmin()) if left.any() else None
        rank = np.zeros(len(self.pivots), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return np.lexsort((self.blocks, rank[cells])) if len(cells) else np.empty(0, dtype=np.int64)

    def place_of(self):
        """Place of a block among all; of one without members, the next."""
        blocks = self.blocks

        @F.pandas_udf("long")
        def place(block: pd.Series) -> pd.Series:
            return pd.Series(np.minimum(np.searchsorted(blocks, block.to_numpy()), max(0, len(blocks) - 1)), dtype="int64")

        return place

    def reach(self):
        """Which blocks can hold a vector within ``bound`` of a target: a matrix of targets and blocks."""
        pivots, blocks, own, shared, n = self.pivots, self.blocks, self.own, self.shared, len(self.references)
        between = chord(pivots, pivots)
        cell = blocks // RINGS

        def held(m, bounds):
            d = chord(m, pivots)
            to = d[:, cell]
            low = np.maximum(to - own[:, 1], own[:, 0] - to)
            for k in range(n):
                np.maximum(low, d[:, k, None] - shared[:, k, 1], out=low)
                np.maximum(low, shared[:, k, 0] - d[:, k, None], out=low)
            home = d.argmin(axis=1)
            gap = 2.0 * between[home]
            plane = np.divide(d * d - d[np.arange(len(d)), home, None] ** 2, gap, out=np.zeros_like(d), where=gap > 1e-9)
            return np.maximum(low, plane[:, cell]) <= bounds[:, None] + SLACK

        return held

    def open_blocks(self):
        """Blocks (and their numbers of pieces) that can hold a vector within ``bound`` of a target."""
        blocks, slots, reach = self.blocks, self.slots, self.reach()

        @F.pandas_udf("array<struct<block:long,slots:long>>")
        def probe(vecs: pd.Series, bounds: pd.Series) -> pd.Series:
            m, _ = stacked(vecs)
            return pd.Series([[{"block": int(b), "slots": int(s)} for b, s in zip(blocks[row], slots[row])] for row in reach(m, bounds.to_numpy())])

        return probe


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(table.num_rows, -1)


class _Best:
    """The nearest corpus vectors so far of the targets of one unit, as the corpus goes by in (rep) order."""

    def __init__(self, vid, m, limit, n, digits, rep_cols):
        self.vid, self.n, self.digits, self.rep_cols = vid, n, digits, rep_cols
        (self.m, ok), self.limit = unit_rows(m), limit.copy()
        self.limit[~ok] = -1.0
        self.near = self.m.astype(np.float32)
        self.found = [(np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64))] * -(-len(m) // TILE)
        self.names, self.seen = [], 0

    def meet(self, rows: pa.Table):
        names = rows.select(["vid", *self.rep_cols])
        for at in range(0, rows.num_rows, 2 * TILE):
            part = rows.slice(at, 2 * TILE)
            c, ok = unit_rows(_matrix(part))
            near, used = c.astype(np.float32), []
            # Single precision only says which pairs need not be looked at.
            slack = 1e-6 * (10 + c.shape[1])
            for k in range(len(self.found)):
                rows_k = slice(k * TILE, (k + 1) * TILE)
                limit, t = self.limit[rows_k], self.m[rows_k]
                least = np.where(limit < 0, np.inf, 1.0 - limit * limit / 2 - slack).astype(np.float32)
                held = (self.near[rows_k] @ near.T >= least[:, None]) & ok
                i, j = np.nonzero(held)
                if len(i) > held.size // 32:
                    d = chord(t, c).round(self.digits)
                    d[:, ~ok] = np.inf
                    if d.shape[1] > self.n:
                        limit = np.minimum(limit, np.partition(d, self.n - 1, axis=1)[:, self.n - 1])
                    i, j = np.nonzero(d <= limit[:, None])
                    d = d[i, j]
                else:
                    d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", t[i], c[j]))).round(self.digits)
                    good = d <= limit[i]
                    i, j, d = i[good], j[good], d[good]
                if len(i):
                    self._add(k, i, d, j + self.seen)
            self.seen += part.num_rows
        self.names.append(names)

    def _add(self, k, i, d, j):
        old_i, old_d, old_j = self.found[k]
        i, d, j = np.concatenate([old_i, i]), np.concatenate([old_d, d]), np.concatenate([old_j, j])
        order = np.lexsort((j, d, i))
        i, d, j = i[order], d[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        keep = place < self.n
        last = place == self.n - 1
        limit = self.limit[k * TILE:(k + 1) * TILE]
        limit[i[last]] = np.minimum(limit[i[last]], d[last])
        self.found[k] = i[keep], d[keep], j[keep]

    def hits(self):
        if not self.names:
            return
        names = pa.concat_tables(self.names).combine_chunks()
        for k, (i, d, j) in enumerate(self.found):
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                to = pa.array(j[part])
                yield pa.table({"tvid": self.vid.take(pa.array(i[part] + k * TILE)), "mvid": names["vid"].take(to), "dist": pa.array(d[part]),
                                **{c: names[c].take(to) for c in self.rep_cols}})

    def bounds(self):
        """The distance of every target's ``n``-th neighbour, or its limit."""
        return np.maximum(self.limit, 0.0)


def _searched(n, max_dist, digits, rep_cols):
    """Best ``n`` corpus vectors of every target within its own bound, from a stream sorted by unit, targets first, corpus by rep."""
    most = 4.0 if max_dist is None else float(max_dist)

    def start(targets):
        rows = pa.concat_tables(targets)
        vid = rows["vid"].combine_chunks()
        return _Best(vid, _matrix(rows), np.minimum(rows["bound"].to_numpy(), most), n, digits, rep_cols)

    def run(batches):
        unit, targets, best = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            units = table["unit"].to_numpy()
            kinds = table["corpus"].to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.concatenate([[0], np.flatnonzero((units[1:] != units[:-1]) | (kinds[1:] != kinds[:-1])) + 1, [len(units)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if units[a] != unit:
                    if best is not None:
                        for found in best.hits():
                            yield from found.to_batches()
                    unit, targets, best = units[a], [], None
                if not kinds[a]:
                    targets.append(table.slice(a, b - a))
                elif targets:
                    best = best or start(targets)
                    best.meet(table.slice(a, b - a))
        if best is not None:
            for found in best.hits():
                yield from found.to_batches()

    return run


def unit_hits(targets: DataFrame, corpus: DataFrame, units: int, n: int, max_dist, rep_cols, digits: int) -> DataFrame:
    """``(tvid, mvid, dist, rep...)``: the best ``n`` of every target in each of its units.

    ``targets``: ``(unit, vid, vec, bound)``; ``corpus``: ``(unit, vid, vec, rep...)``; units are numbered from 0. A task holds the
    targets of a unit and their best so far while the unit's corpus goes by, so no hit leaves it that a better one pushes out.
    """
    types = {f.name: f.dataType.simpleString() for f in corpus.schema}
    reps = ", ".join(f"{r} {types[r]}" for r in rep_cols)
    rows = targets.select("unit", F.lit(False).alias("corpus"), "vid", "vec", "bound", *[F.lit(None).cast(types[r]).alias(r) for r in rep_cols]).unionByName(
        corpus.select("unit", F.lit(True).alias("corpus"), "vid", "vec", F.lit(0.0).alias("bound"), *rep_cols))
    rows = rows.repartitionById(max(1, min(MAX_PARTS, units)), F.pmod(F.col("unit"), F.lit(MAX_PARTS)).cast("int"))
    return rows.sortWithinPartitions("unit", "corpus", *rep_cols).mapInArrow(
        _searched(n, max_dist, digits, rep_cols), f"tvid string, mvid string, dist double, {reps}")


def targets_per_unit(spark, n: int) -> int:
    """So many that every core has a few units, and a task stays small; below four blocks, sending the corpus costs more than comparing."""
    return max(4 * BLOCK_ROWS, min(TARGETS, -(-n // (3 * spark.sparkContext.defaultParallelism))))


def _bounder(n, most, digits, rep_cols):
    """Targets of one piece with the distance of the last of ``n`` places that they could fill in it."""

    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        best = _Best(left["vid"], _matrix(left), np.full(left.num_rows, most), n, digits, rep_cols)
        if right.num_rows:
            best.meet(right)
        at = left.schema.get_field_index("bound")
        return left.set_column(at, "bound", pa.array(best.bounds()))

    return bound


class Dealt:
    """Blocks in a chain of neighbours, dealt into runs of about ``size`` rows; a block of more rows is dealt into several by hash."""

    def __init__(self, found: "Blocks", counts: np.ndarray, size: int):
        self.first, self.parts = np.zeros(len(counts), dtype=np.int64), np.maximum(1, -(-counts // size))
        self.runs, room = 0, 0
        for b in found.chain():
            if self.parts[b] > 1 or counts[b] > room or not self.runs:
                self.first[b] = self.runs
                self.runs += self.parts[b]
                room = 0 if self.parts[b] > 1 else size
            else:
                self.first[b] = self.runs - 1
            room -= counts[b] if self.parts[b] == 1 else 0

    def run_of(self, block, at):
        """The run of a vector, from the place of its block and the hash of its id."""
        first, parts = self.first, self.parts

        @F.pandas_udf("long")
        def run(places: pd.Series, hashes: pd.Series) -> pd.Series:
            b = places.to_numpy()
            return pd.Series(first[b] + np.mod(hashes.to_numpy(), parts[b]), dtype="int64")

        return run(block, at)


def open_pairs(found: Blocks, targets: DataFrame, bounds: DataFrame) -> DataFrame:
    """``(vid, vec, bound, home, block, slot)``: the pieces of blocks that a target has to meet besides its own, ``home``."""
    rows = targets.join(bounds.select(F.col("tvid").alias("vid"), "bound"), "vid")
    rows = rows.withColumn("b", F.explode(found.open_blocks()(F.col("vec"), F.col("bound"))))
    rows = rows.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b.slots") - 1)))
    return rows.where("b.block <> block OR s <> slot").select(
        "vid", "vec", "bound", F.struct("block", "slot").alias("home"), F.col("b.block").alias("block"), F.col("s").alias("slot"))


def _opened(found: Blocks):
    """Distinct ``(run, place)`` per task: the blocks that some target of a run has to meet."""
    reach, n = found.reach(), len(found.blocks)
    most = max(1, (1 << 22) // max(1, n))

    def run(batches):
        seen = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            m, _ = unit_rows(_matrix(pa.Table.from_batches([batch])))
            bounds, runs = batch["bound"].to_numpy(), batch["run"].to_numpy()
            for at in range(0, len(m), most):
                held = reach(m[at:at + most], bounds[at:at + most])
                part = runs[at:at + most]
                for r in np.unique(part):
                    any_held = held[part == r].any(axis=0)
                    seen[r] = seen[r] | any_held if r in seen else any_held
        for r, held in seen.items():
            places = np.flatnonzero(held)
            yield pa.RecordBatch.from_pydict({"run": pa.array(np.full(len(places), r, dtype=np.int64)), "place": pa.array(places.astype(np.int64))})

    return run


def exact_hits(corpus: DataFrame, targets, pivots: np.ndarray, want: int, max_dist, rep_cols, digits: int):
    """``(assigned, hits)``: the corpus with its blocks, and ``(tvid, mvid, dist, rep...)`` with the best ``want`` of every target.

    ``corpus``: distinct vectors ``(vid, vec, rep...)``; ``targets``: ``(vid, vec)``, or ``None`` for the corpus itself.
    """
    spark = corpus.sparkSession
    found = Blocks(corpus, pivots)
    most = 4.0 if max_dist is None else float(max_dist)
    held = found.corpus.select("vid", "vec", *rep_cols, "block", "slot")
    asked = (held if targets is None else found.place(targets)).select("vid", "vec", "block", "slot", F.lit(most).alias("bound"))
    if int(found.slots.sum()) > 1:
        asked = cut(_bounded(asked, held, targets is None, want, most, digits, rep_cols), "bounded")
    place = found.place_of()
    sizes = found.sizes if len(found.blocks) else np.zeros(1, dtype=np.int64)
    counts = sizes if targets is None else np.zeros_like(sizes)
    if targets is not None:
        for r in asked.groupBy(place(F.col("block")).alias("place")).count().collect():  # at most one row per block
            counts[r["place"]] += r["count"]
    t_runs = Dealt(found, counts, targets_per_unit(spark, int(counts.sum())))
    c_runs = Dealt(found, sizes, max(BLOCK_ROWS, CORPUS))
    hashed = F.xxhash64("vid")
    asked = asked.withColumn("run", t_runs.run_of(place(F.col("block")), hashed))
    members = held.withColumn("place", place(F.col("block"))).withColumn("c_run", c_runs.run_of(F.col("place"), hashed))
    open_runs = cut(asked.select("vec", "bound", "run").mapInArrow(_opened(found), "run long, place long").distinct(), "open_runs")
    unit = (F.col("run") * F.lit(int(c_runs.runs)) + F.col("c_run")).alias("unit")
    # A block of several runs is in each of them; runs of targets have a few hundred members of corpus runs at most.
    lies = F.explode(F.sequence(F.element_at(F.lit(c_runs.first.tolist()), F.col("place").cast("int") + 1), F.element_at(
        F.lit((c_runs.first + c_runs.parts - 1).tolist()), F.col("place").cast("int") + 1))) if len(found.blocks) else F.lit(0).cast("long")
    met = open_runs.withColumn("c_run", lies).select("run", "c_run").distinct()
    hits = unit_hits(asked.join(met, "run").select(unit, "vid", "vec", "bound"),
                     members.join(open_runs, "place").select(unit, "vid", "vec", *rep_cols),
                     int(t_runs.runs * c_runs.runs), want, max_dist, rep_cols, digits)
    return found.corpus, hits


def _bounded(asked, held, same, want, most, digits, rep_cols):
    """Targets with the bounds that their own blocks give; large pieces of targets meet theirs by the thousand."""
    keys = ["block", "slot"]
    schema = asked.schema
    if not same:
        parts = asked.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
        asked = asked.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts"))).drop("parts")
        held = held.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).drop("parts")
        keys, schema = [*keys, "part"], asked.schema
    bound = _bounder(want, most, digits, rep_cols)
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(bound, schema)
