"""Exact component-wise medians of vectors per group, without a row per component.

Vectors are shuffled whole. A group of up to ``SLOT_ROWS`` is one slot, whose columns are sorted in one step. A larger group is
spread over slots, written with sorted columns, and its middle values are found digit by digit: of every component a slot
counts the values by their next ``DIGIT`` bits below the digits found so far, and the counts are arrays that add up before they
are shuffled. The bits are those of the doubles in an order that compares like the numbers, so the result is exact after
64 / ``DIGIT`` passes.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.session import cut, remove

SLOT_ROWS = 1024
DIGIT = 4

U64 = np.uint64
_SIGN = U64(1 << 63)


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order."""
    u = x.astype(np.float64).view(U64)
    return np.where(u & _SIGN, ~u, u | _SIGN)


def unordered(u: np.ndarray) -> np.ndarray:
    return np.where(u & _SIGN, u ^ _SIGN, ~u).view(np.float64)


def _matrix(table):
    flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(table.num_rows, -1)


def _between(low, high):
    return low + (high - low) * 0.5


def digits_below(columns: np.ndarray, prefix: np.ndarray, shift: int) -> np.ndarray:
    """``[2, components, 2 ** DIGIT]``: values of sorted columns that have the digits of ``prefix`` and, below them, each next digit."""
    out = np.zeros((2, columns.shape[1], 1 << DIGIT), np.int64)
    steps = (np.arange(1 << DIGIT, dtype=U64) << U64(shift)) + U64((1 << shift) - 1)
    for c in range(columns.shape[1]):
        for r in range(2):
            upto = np.searchsorted(columns[:, c], prefix[r, c] + steps, "right")
            out[r, c] = np.diff(upto, prepend=np.searchsorted(columns[:, c], prefix[r, c], "left"))
    return out


def _state(blob):
    """Digits found so far and places left, each for the lower and the upper middle value of every component."""
    x = np.frombuffer(blob, U64).reshape(2, 2, -1)
    return x[0].copy(), x[1].view(np.int64).copy()


def _pack(prefix, rank):
    return np.concatenate([prefix.ravel(), rank.ravel().view(U64)]).tobytes()


def median_vectors(df: DataFrame, keys, vec="vec") -> DataFrame:
    """``(keys, vec)`` with the medians as doubles. Null vectors are left out; those of one group have one length."""
    rows = df.where(F.col(vec).isNotNull()).select(F.struct(*keys).alias("k"), F.col(vec).cast("array<double>").alias("vec"))
    kind = rows.schema["k"].dataType.simpleString()
    sizes = rows.groupBy("k").agg(F.ceil(F.count("*") / SLOT_ROWS).cast("long").alias("slots"))
    dealt = rows.join(sizes, "k")

    def whole(t: pa.Table) -> pa.Table:
        m = np.sort(_matrix(t), axis=0)
        return pa.table({"k": t["k"].slice(0, 1), "vec": pa.array([_between(m[(len(m) - 1) // 2], m[len(m) // 2])], pa.list_(pa.float64()))})

    def sorted_slot(t: pa.Table) -> pa.Table:
        m = np.sort(ordered(_matrix(t)), axis=0)
        return pa.table({"k": t["k"].slice(0, 1), "n": pa.array([len(m)]), "dims": pa.array([m.shape[1]]), "blob": pa.array([m.tobytes()], pa.binary())})

    small = dealt.where("slots = 1").select("k", "vec").groupBy("k").applyInArrow(whole, f"k {kind}, vec array<double>")
    spread = dealt.where("slots > 1").withColumn("slot", F.pmod(F.monotonically_increasing_id(), F.col("slots"))).select("k", "slot", "vec")
    slots = cut(spread.groupBy("k", "slot").applyInArrow(sorted_slot, f"k {kind}, n long, dims long, blob binary"), "slots")

    def start(batches):
        for b in batches:
            states = [_pack(np.zeros((2, d), U64), np.repeat(np.array([[(n - 1) // 2], [n // 2]], np.int64), d, axis=1))
                      for n, d in zip(b["n"].to_pylist(), b["dims"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["k"], pa.array(states, pa.binary())], ["k", "state"])

    def counts(shift):
        def run(batches):
            for b in batches:
                found = []
                for blob, state, n in zip(b["blob"].to_pylist(), b["state"].to_pylist(), b["n"].to_pylist()):
                    found.append(digits_below(np.frombuffer(blob, U64).reshape(n, -1), _state(state)[0], shift).ravel().astype(np.float64))
                yield pa.RecordBatch.from_arrays([b["k"], pa.array(found, pa.list_(pa.float64()))], ["k", "counts"])
        return run

    def narrowed(shift):
        def run(batches):
            for b in batches:
                states = []
                for state, found in zip(b["state"].to_pylist(), b["counts"].to_pylist()):
                    prefix, rank = _state(state)
                    upto = np.cumsum(np.array(found).astype(np.int64).reshape(2, -1, 1 << DIGIT), axis=2)
                    digit = (upto <= rank[..., None]).sum(axis=2)
                    before = np.take_along_axis(np.concatenate([np.zeros((*rank.shape, 1), np.int64), upto], axis=2), digit[..., None], axis=2)[..., 0]
                    states.append(_pack(prefix | digit.astype(U64) << U64(shift), rank - before))
                yield pa.RecordBatch.from_arrays([b["k"], pa.array(states, pa.binary())], ["k", "state"])
        return run

    def decoded(batches):
        for b in batches:
            found = [unordered(_state(s)[0]) for s in b["state"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["k"], pa.array([_between(*f) for f in found], pa.list_(pa.float64()))], ["k", "vec"])

    out = small
    if not slots.isEmpty():
        state = slots.groupBy("k").agg(F.sum("n").alias("n"), F.first("dims").alias("dims")).mapInArrow(start, f"k {kind}, state binary")
        state = cut(state, "medians")
        for shift in range(64 - DIGIT, -1, -DIGIT):
            each = slots.join(state, "k").select("k", "n", "blob", "state").mapInArrow(counts(shift), f"k {kind}, counts array<double>")
            total = each.groupBy("k").agg(vector_to_array(Summarizer.sum(array_to_vector("counts"))).alias("counts"))
            state = cut(state.join(total, "k").select("k", "state", "counts").mapInArrow(narrowed(shift), f"k {kind}, state binary"), "medians", replaces=[state])
        out = out.unionByName(state.mapInArrow(decoded, f"k {kind}, vec array<double>"))
    else:
        remove(df.sparkSession, slots.cut_path)
    return out.select("k.*", F.col("vec").alias(vec))
