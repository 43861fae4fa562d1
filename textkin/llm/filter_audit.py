"""Filter interaction audit: what each filter of a cleaning sequence removes, for every order of the filters.

Every document gets one boolean per filter (true: it fails). Documents of a part are counted into a contingency tensor with one
axis of two (pass, fail) per filter and one axis of measures: documents, good ones, toxic ones. One ``einsum`` contracts
all axes with the selectors pass, fail and all; every count of every order and step is a cell of the result:

* ``removed``: earlier filters pass, own one fails, later ones all; ``kept``: earlier and own pass, later ones all
* ``redundant``: own fails, the rest all, less ``removed``; ``unique_fails``: own fails, the rest pass
* ``shapley``: ``removed`` of a filter, summed over all orders

Only counts leave the tasks that read texts: one row per document without its text, then at most 2^k rows per part, counted
before the shuffle, and one tensor per part. Parts are contracted in Arrow batches, so their number is not bounded.

Whether a text repeats is decided over the whole table by its SHA-256: the smallest id of equal texts passes. Rows join on ids,
not on texts, so a text that a third of all rows share is no hot key.

Nulls and edges: a null text is an empty one, a null part an empty string. Rows without id are counted, have no labels, and
are neither copies nor originals. Rows that repeat the smallest id of a text all pass, others fail. Repeated labels of an id
count once, as 1 if one of them is 1. No rows, no rows. Other columns are not read.
"""

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.session import cut

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
SYMBOLS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

FILTERS = "ABCDE"
MEASURES = ("docs", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
PASS, FAIL, ALL = 0, 1, 2
_SELECT = np.array([[1, 0], [0, 1], [1, 1]], np.int64)  # pass, fail, all


def text_failures(text) -> dict:
    """Failure conditions A to D of a text column."""
    text = F.coalesce(text, F.lit(""))
    # One array of the words gives both numbers: a transform of one element keeps Spark from matching twice.
    words = F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"))),
                        lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))[0]
    size = F.length(text).cast("long")
    capitals = size - F.length(F.translate(text, CAPITALS, ""))
    return {"words": words, "C": 100 * capitals > MAX_CAPITAL_PERCENT * size, "D": text.rlike(SYMBOLS)}


def flag_documents(docs: DataFrame, labels: DataFrame, id="doc_id", text="text", part="source", good="quality", toxic="toxic") -> DataFrame:
    """``(part, A, B, C, D, E, good, toxic)`` of every row of ``docs``: true where the filter fails it."""
    f = text_failures(F.col(text))
    read = docs.select(F.col(id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), f["words"].alias("w"),
                       f["C"].alias("C"), f["D"].alias("D"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"))
    slim = cut(read.select("id", "part", (F.col("w.n") < MIN_WORDS).alias("A"),
                           (100 * F.col("w.distinct") < MIN_DISTINCT_PERCENT * F.col("w.n")).alias("B"), "C", "D", "digest"), "flags")
    first = slim.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumnRenamed("digest", "own")
    known = labels.select(F.col(id).alias("id"), (F.col(good) == 1).cast("long").alias("good"), (F.col(toxic) == 1).cast("long").alias("toxic"))
    known = known.where("id is not null").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # An id may be the first one of several texts, where rows repeat it.
    met = slim.where("id is not null").alias("s").join(first.alias("f"), F.expr("s.id = f.id and s.digest = f.own"), "left")
    met = met.select("s.*", F.col("f.id").isNull().alias("E")).join(known, "id", "left")
    odd = slim.where("id is null").select("*", F.lit(False).alias("E"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return met.unionByName(odd).select("part", *FILTERS, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def contract(tensors: np.ndarray, k: int) -> np.ndarray:
    """Tensors ``[part, 2, ..., 2, measure]`` with every axis selected as pass, fail and all: ``[part, 3, ..., 3, measure]``."""
    axes = "abcdefgh"[:k]
    picks = [f"{x.upper()}{x}" for x in axes]
    return np.einsum(f"p{axes}m,{','.join(picks)}->p{axes.upper()}m", tensors, *[_SELECT] * k, optimize=True)


def steps(filters: str) -> list[tuple[str, int, dict]]:
    """``(order, step, selectors per count)`` of all orders."""
    out = []
    for order in permutations(filters):
        for i, own in enumerate(order):
            earlier = {f: PASS for f in order[:i]}

            def cell(rest, **picked):
                return tuple(picked.get(f, rest) for f in filters)

            out.append(("".join(order), i + 1, {
                "kept": cell(ALL, **earlier, **{own: PASS}), "removed": cell(ALL, **earlier, **{own: FAIL}),
                "fails": cell(ALL, **{own: FAIL}), "unique_fails": cell(PASS, **{own: FAIL})}))
    return out


def audit(flagged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``(part, filter_order, step)`` with the counts, from rows of ``flag_documents``; up to 8 filters of one letter each."""
    k = len(filters)
    cell = sum((F.col(f).cast("int") * (1 << (k - 1 - i)) for i, f in enumerate(filters)), F.lit(0))
    counted = flagged.groupBy("part", cell.alias("cell")).agg(
        F.count("*").alias("docs"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    # At most 2^k entries per part.
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("cell", *MEASURES)).alias("cells"))
    rows = steps(filters)
    place = {name: np.array([np.ravel_multi_index(r[2][name], (3,) * k) for r in rows]) for name in rows[0][2]}
    own = np.array([filters.index(order[step - 1]) for order, step, _ in rows])
    orders, numbers = [r[0] for r in rows], np.array([r[1] for r in rows], np.int32)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                n = some.num_rows
                tensors = np.zeros((n, 1 << k, len(MEASURES)), np.int64)
                for i, cells in enumerate(some["cells"].to_pylist()):
                    for c in cells:
                        tensors[i, c["cell"]] += [c[m] for m in MEASURES]
                y = contract(tensors.reshape(n, *[2] * k, len(MEASURES)), k).reshape(n, 3 ** k, len(MEASURES))
                removed = y[:, place["removed"]]
                share = np.stack([removed[:, own == f, 0].sum(axis=1) for f in range(k)], axis=1)
                counts = {"kept": y[:, place["kept"], 0], "removed": removed[..., 0], "redundant": y[:, place["fails"], 0] - removed[..., 0],
                          "unique_fails": y[:, place["unique_fails"], 0], "good_lost": removed[..., 1], "toxic_lost": removed[..., 2],
                          "shapley": share[:, own]}
                yield pa.RecordBatch.from_arrays(
                    [some["part"].take(pa.array(np.repeat(np.arange(n), len(rows)))), pa.array(orders * n), pa.array(np.tile(numbers, n)),
                     *[pa.array(counts[c].ravel()) for c in COUNTS]], ["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
