"""Mixing by iterative proportional fitting, in DataFrame functions alone.

Tokens are summed per cell (one value of every dimension, by default source x language x topic). Raking scales the cells
until their sums follow a target for each dimension in turn; the factor of a cell is its raked weight divided by its
tokens. A document is sampled with probability min(1, c * factor), where c makes the expected tokens the part ``keep`` of all.
Where a cell would need more than all its documents, they count more than once: ``weight`` = c * factor / p, which is 1 elsewhere.
Expected weighted token shares of the sample are those of the raked table.

Nulls and edges: a null dimension is a category of its own (``NO_VALUE``). A document without words has no tokens; its
cell counts ``SMALLEST`` tokens if it holds nothing else, so it takes part. Documents with one id are drawn together
(null ids share one draw). Tables without rows give no rows. Other columns pass through, whatever their names. Targets that
contradict the data can't be met; ``gap`` is the largest difference of a share from its target after the last round.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.llm.tables import fresh, join_lookup
from textkin.session import cut

DIMENSIONS = ("source", "lang", "topic")
FLATTEN = 0.5
KEEP = 0.5
ROUNDS = 8
NO_VALUE = "(none)"
SMALLEST = 1e-3
SEED = "mix"


def token_count(text):
    """Words separated by ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text):
    """A coarse topic from the text alone: what its form says it is about."""
    return (F.when(text.isNull(), NO_VALUE).when(text.contains(" | "), "table")
            .when(text.contains("http") | text.contains("@"), "contact")
            .when(text.contains("icense"), "legal")
            .when(text.rlike("[#$%&*]{3}"), "markup")
            .when(~text.rlike("[a-z]"), "shouted").otherwise("prose"))


def cells_of(docs: DataFrame, dims: dict, tokens) -> DataFrame:
    """Token sums per cell. ``dims``: column expression by name."""
    tagged = docs.select(*[F.coalesce(e.cast("string"), F.lit(NO_VALUE)).alias(d) for d, e in dims.items()], tokens.alias("tokens"))
    return tagged.groupBy(*dims).agg(F.greatest(F.sum("tokens").cast("double"), F.lit(SMALLEST)).alias("n"))


def flat_targets(cells: DataFrame, dims, flatten=FLATTEN) -> dict:
    """Targets ``(value, share)`` per dimension: shares of tokens raised to ``flatten`` and brought to 1 again.

    1 keeps the shares as they are, 0 makes all values equal.
    """
    out = {}
    for d in dims:
        own = cells.groupBy(d).agg(F.pow(F.sum("n"), F.lit(flatten)).alias("flat"))
        whole = own.agg(F.sum("flat")).first()[0] or 1.0
        out[d] = own.select(F.col(d).alias("value"), (F.col("flat") / F.lit(whole)).alias("share"))
    return out


def rake(cells: DataFrame, targets: dict, rounds=ROUNDS) -> DataFrame:
    """``cells`` with the raked weight ``w``; weights sum to 1.

    Each round fits every dimension once: cells are summed by it (partial sums before the shuffle) and joined with their
    factor. Rounds are written to the shared folder. Values without a target keep their weight.
    """
    whole = cells.agg(F.sum("n")).first()[0] or 1.0
    w = cut(cells.withColumn("w", F.col("n") / F.lit(whole)), "rake")
    targets = {d: cut(t, "target") for d, t in targets.items()}
    for _ in range(rounds):
        new = w
        for d, target in targets.items():
            sums = new.groupBy(d).agg(F.sum("w").alias("have"))
            factor = sums.join(target, F.col(d) == F.col("value"), "left").select(
                F.col(d).alias("value"), F.coalesce(F.col("share") / F.col("have"), F.lit(1.0)).alias("factor"))
            new = cut(new.join(factor, F.col(d) == F.col("value")).select(
                *cells.columns, (F.col("w") * F.col("factor")).alias("w")), "rake", replaces=[new])
        w = new
    return w


def gap(raked: DataFrame, targets: dict) -> float:
    """Largest difference of a share of the raked table from its target."""
    parts = [raked.groupBy(F.col(d).alias("value")).agg(F.sum("w").alias("w")).join(t, "value", "left")
             .agg(F.max(F.abs(F.col("w") - F.col("share"))).alias("gap")) for d, t in targets.items()]
    return reduce(DataFrame.unionByName, parts).agg(F.max("gap").alias("gap")).first()["gap"] or 0.0


def calibrate(factors: DataFrame, keep=KEEP) -> float:
    """c, so that the sum of tokens * min(1, c * factor) is ``keep`` of all tokens.

    Cells that c fills are set aside and c is found for the rest, until no further cell is filled; c only grows.
    """
    whole = factors.agg(F.sum("n")).first()[0]
    if not whole:
        return 1.0
    c = 0.0
    while True:
        full = F.col("factor") * F.lit(c) >= 1
        r = factors.agg(F.sum(F.when(full, F.col("n")).otherwise(0.0)).alias("full"),
                        F.sum(F.when(full, 0.0).otherwise(F.col("n") * F.col("factor"))).alias("rest")).first()
        new = (keep * whole - r["full"]) / r["rest"] if r["rest"] else c
        if new <= c * (1 + 1e-12):
            return c
        c = new


def draw(key, seed=SEED):
    """A uniform number in [0, 1) that depends on the key and the seed alone: 52 bits of an md5."""
    bits = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(bits, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_to_targets(docs: DataFrame, id="doc_id", text="text", dims=None, targets=None, flatten=FLATTEN, keep=KEEP, rounds=ROUNDS,
                   seed=SEED) -> DataFrame:
    """``docs`` with ``tokens``, one column per dimension that is not among them, ``p``, ``weight`` and ``sampled``.

    ``dims``: name -> column expression, by default source, lang and a topic of the text. ``targets``: name ->
    DataFrame ``(value, share)`` with shares that sum to 1; by default the flattened shares of the documents.
    """
    dims = dims or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col(text))}
    tokens = token_count(F.col(text))
    cells = cut(cells_of(docs, dims, tokens), "cells")
    raked = rake(cells, targets or flat_targets(cells, dims, flatten), rounds)
    keys = {d: fresh(docs, f"cell_{d}") for d in dims}
    own = {d: fresh(docs, f"own_{d}") for d in dims}
    p, weight, n, sampled = (fresh(docs, c) for c in ("p", "weight", "tokens", "sampled"))
    factors = cut(raked.withColumn("factor", F.col("w") / F.col("n")), "factors")
    c = calibrate(factors, keep)
    rate = F.col("factor") * F.lit(c)
    lookup = factors.select(*[F.col(d).alias(keys[d]) for d in dims], F.least(rate, F.lit(1.0)).alias(p),
                            F.greatest(rate, F.lit(1.0)).alias(weight))
    tagged = docs.withColumns({n: tokens} | {own[d]: F.coalesce(e.cast("string"), F.lit(NO_VALUE)) for d, e in dims.items()})
    same = reduce(lambda a, b: a & b, [F.col(own[d]) == F.col(keys[d]) for d in dims])
    joined = join_lookup(tagged, lookup, same, "inner", "rates")
    new = [F.col(own[d]).alias(d) for d in dims if d.lower() not in {c.lower() for c in docs.columns}]
    return joined.select(*docs.columns, n, *new, p, weight).withColumn(sampled, draw(F.col(id), seed) < F.col(p))
