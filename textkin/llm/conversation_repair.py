"""Conversation structure repair: the cheapest edits to legal turns, by dynamic programming over grammar-compressed rows.

A conversation's rows, in the order of (turn, nulls first; role; text), become symbols: the role's initial (s, u, a or another) with
or without a cut end, or a row that must go (blank, or role and text seen earlier). Edits keep, rerole or delete rows
and insert empty ones; the initials of what is left must read ``(s?(ua)+)?``. A symbol is a min-plus transfer matrix between
the four states of that automaton, whose entries hold the cost and, as a rope, the edits' initials; of equal costs the
ASCII-least. Edits and state fix the role that is written, so the initials say all.

1. Faults are found by native expressions; the earliest of equal rows by a count per (conversation, digest).
2. Rows are dealt by range of (conversation, turn, ...) and written as segments of at most ``SEGMENT`` rows, so that a conversation of
   any length is spread over tasks.
3. Re-Pair: pairs of symbols are counted over all distinct segments; the most frequent pairs become rules, round by round.
4. One matrix per rule is made bottom-up from those of its two sides. Segments in the grammar's symbols are evaluated with
   them, equal segments of a task once.
5. A conversation of several segments needs the states at their borders: costs of the rest by a pass from its end, states
   by a pass from its start, both over one short row per segment. Of ends of equal cost the ASCII-least edits of the segment
   decide; where one is the beginning of the other, the shorter one, since what the longer one inserts the rest may insert too.

Nulls and edges: a null role or text is one space. Rows without conversation id are one conversation. Rows of one turn are
ordered by role and text. A role without initial can't be kept. Conversations without rows appear where ``convs`` names them, with zeros, no edits and
no text. No rows and no names, no rows. Other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textkin.session import cut

#: Rows and bytes of text that a segment holds at most (a longer text is a segment of its own).
SEGMENT, SEGMENT_BYTES = 1024, 4_000_000
#: Grammar: most rules and rounds, fewest uses of a rule, and the share of all symbols that a rule must save.
MAX_RULES, ROUNDS, LEAST, GAIN = 256, 16, 2, 0.0005
#: Results of equal segments that a task remembers.
REMEMBERED = 50_000

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1  # costs; CUT is added for a row with a cut end that is not deleted
START, SYSTEM, USER, ASSISTANT = range(4)
#: Next state of each state for a row of a role's initial, and the state and role that follow where none is given.
LEGAL = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
FOLLOWS = [USER, USER, ASSISTANT, USER]
ROLES = {USER: "user", ASSISTANT: "assistant"}
GONE = "x"
SYMBOLS = "suaoSUAO" + GONE  # capitals: cut ends
NEVER = 1 << 50
RULE = 0x4E00  # rules are written as the characters from here on


class Rope:
    """Edits of a path as a tree over the edits of its parts, joined when they are compared or read."""

    __slots__ = ("parts", "text")

    def __init__(self, text=None, parts=()):
        self.text, self.parts = text, parts

    def __str__(self):
        if self.text is None:
            out, stack = [], [self]
            while stack:
                r = stack.pop()
                if r.text is None:
                    stack += reversed(r.parts)
                else:
                    out.append(r.text)
            self.text, self.parts = "".join(out), ()
        return self.text


EMPTY = (0, Rope(""))
NONE = (NEVER, Rope(""))


def best(options):
    """The cheapest of ``(cost, rope)``; ropes are only read where costs are equal."""
    top = NONE
    for o in options:
        if o[0] < top[0] or (o[0] == top[0] < NEVER and str(o[1]) < str(top[1])):
            top = o
    return top


def join(a, b):
    return (a[0] + b[0], Rope(parts=(a[1], b[1]))) if a[0] + b[0] < NEVER else NONE


def product(x, y):
    return [[best(join(x[i][k], y[k][j]) for k in range(4)) for j in range(4)] for i in range(4)]


def _inserts():
    """From state to state by inserts alone."""
    out = [[EMPTY if i == j else NONE for j in range(4)] for i in range(4)]
    for i in range(4):
        at = i
        for n in range(1, 3):
            at = FOLLOWS[at]
            out[i][at] = best([out[i][at], (INSERT * n, Rope("I" * n))])
    return out


INSERTS = _inserts()
#: Cost and edits from each state to the end of a conversation.
END = [best([INSERTS[i][START], INSERTS[i][ASSISTANT]]) for i in range(4)]


def symbol_matrix(symbol: str):
    """Inserts, then the edits of one row."""
    own = [[NONE] * 4 for _ in range(4)]
    for i in range(4):
        own[i][i] = (DELETE, Rope("D"))
        if symbol != GONE:
            extra = CUT if symbol.isupper() else 0
            to = FOLLOWS[i]
            own[i][to] = best([own[i][to], (REROLE + extra, Rope("R"))])
            to = LEGAL.get((symbol.lower(), i))
            if to is not None:
                own[i][to] = best([own[i][to], (KEEP + extra, Rope("K"))])
    return product(INSERTS, own)


class Grammar:
    """Rules ``[(left, right)]`` in the order they were made, with the matrix of every symbol and rule."""

    def __init__(self, rules):
        self.rules = rules
        self.matrices = {s: symbol_matrix(s) for s in SYMBOLS}
        for i, (a, b) in enumerate(rules):
            m = product(self.matrices[a], self.matrices[b])
            self.matrices[chr(RULE + i)] = [[(c, Rope(str(r))) for c, r in row] for row in m]

    def compress(self, symbols: str) -> str:
        for i, (a, b) in enumerate(self.rules):
            symbols = symbols.replace(a + b, chr(RULE + i))
        return symbols

    def walk(self, compressed: str, entry: int):
        """Cheapest ``(cost, edits)`` from ``entry`` to each state."""
        v = [EMPTY if i == entry else NONE for i in range(4)]
        for s in compressed:
            m = self.matrices[s]
            v = [best(join(v[i], m[i][j]) for i in range(4) if v[i][0] < NEVER) for j in range(4)]
        return [(c, str(r)) for c, r in v]


def whole(grammar, symbols):
    """``(cost, edits)`` of a conversation that is one segment."""
    v = grammar.walk(grammar.compress(symbols), START)
    return min((c + END[j][0], r + str(END[j][1])) for j, (c, r) in enumerate(v) if c < NEVER)


def edited(audit, roles, texts, state=START):
    """Lines ``role:text`` that the edits leave, from a state."""
    out, at = [], 0
    for e in audit:
        if e == "I":
            state = FOLLOWS[state]
            out.append(ROLES[state] + ":")
            continue
        role, text = roles[at], texts[at]
        at += 1
        if e == "K":
            state = LEGAL[role[:1], state]
            out.append(f"{role}:{text}")
        elif e == "R":
            state = FOLLOWS[state]
            out.append(f"{ROLES[state]}:{text}")
    return "\n".join(out)


# ---- rows, faults, segments ----


def faults(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """``(conv, turn, role, text, fault, symbol, uid)``: fault ``b`` blank, ``d`` duplicate, ``t`` truncated, ``-`` none."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    # Row numbers are fixed by writing the rows.
    rows = cut(rows.withColumn("uid", F.monotonically_increasing_id()), "turns")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    first = rows.groupBy("conv", digest.alias("digest")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "uid")).alias("x")).select(F.col("x.uid").alias("uid"), F.lit(False).alias("seen"))
    rows = rows.join(first, "uid", "left")
    ink = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (F.when(ink == "", "b").when(F.col("seen").isNull(), "d").when(~F.substring(ink, -1, 1).isin(".", "!", "?"), "t").otherwise("-"))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    rows = rows.select("conv", "turn", "role", "text", "uid", fault.alias("fault"), initial.alias("initial"))
    return rows.withColumn("symbol", F.when(F.col("fault").isin("b", "d"), GONE).when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial")))


NUMBERS = ["blank", "duplicate", "truncated", "illegal", "turns"]
SLIM = "seg long, symbols string, first string, last string, low long, high long, " + ", ".join(f"{n} long" for n in NUMBERS)
LEGAL_PAIRS = {("s", "u"), ("u", "a"), ("a", "u")}


def segments(rows: DataFrame, size=SEGMENT) -> DataFrame:
    """Runs of at most ``size`` rows of a conversation with their symbols and counts; ``seg`` rises along it."""
    kind = rows.schema["conv"].dataType.simpleString()
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    rows = rows.select("conv", "turn", "role", "text", "uid", "fault", "initial", "symbol")
    rows = rows.repartitionByRange(*order, F.substring("text", 1, 32).asc(), F.col("uid").asc()).sortWithinPartitions(*order, "text", "uid")

    def run(batches):
        part, made = TaskContext.get().partitionId() << 32, 0
        held, held_bytes, own = [], 0, None

        def segment():
            conv, turn, role, text, fault, initial, symbol = zip(*held)
            known = [t for t in turn if t is not None]
            return {"conv": conv[0], "seg": part + made, "symbols": "".join(symbol), "first": initial[0], "last": initial[-1],
                    "low": min(known, default=None), "high": max(known, default=None), "blank": fault.count("b"), "duplicate": fault.count("d"),
                    "truncated": fault.count("t"), "illegal": sum(p not in LEGAL_PAIRS for p in zip(initial, initial[1:])),
                    "turns": len(set(known)), "roles": role, "texts": text}

        for batch in batches:
            out, columns = [], [batch[c].to_pylist() for c in ("conv", "turn", "role", "text", "fault", "initial", "symbol")]
            for row in zip(*columns):
                if held and (row[0] != own or len(held) == size or held_bytes + len(row[3]) > SEGMENT_BYTES):
                    out.append(segment())
                    made, held, held_bytes = made + 1, [], 0
                own = row[0]
                held.append(row)
                held_bytes += len(row[3])
            if out:
                yield _batch(out, batch.schema.field("conv").type)
            types = batch.schema.field("conv").type
        if held:
            yield _batch([segment()], types)

    return cut(rows.mapInArrow(run, f"conv {kind}, {SLIM}, roles array<string>, texts array<string>"), "segments")


_ARROW = {"seg": pa.int64(), "symbols": pa.string(), "first": pa.string(), "last": pa.string(), "low": pa.int64(), "high": pa.int64(),
          **{n: pa.int64() for n in NUMBERS}, "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string())}


def _batch(rows, conv):
    types = {"conv": conv, **_ARROW}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], list(types))


# ---- grammar ----


def learn(found: DataFrame, max_rules=MAX_RULES, rounds=ROUNDS, least=LEAST, gain=GAIN) -> Grammar:
    """Re-Pair over the symbols of all segments. A round makes rules of the most frequent pairs that share no symbol."""
    seqs = cut(found.groupBy("symbols").agg(F.count("*").alias("n")), "sequences")
    total = seqs.agg(F.sum(F.length("symbols") * F.col("n"))).first()[0] or 0
    rules = []

    def count(batches):
        grammar = Grammar(rules)
        for batch in batches:
            pairs = {}
            for s, n in zip(batch["symbols"].to_pylist(), batch["n"].to_pylist()):
                s = grammar.compress(s)
                for p in {s[i:i + 2] for i in range(len(s) - 1)}:
                    pairs[p] = pairs.get(p, 0) + n * s.count(p)
            if pairs:
                yield pa.RecordBatch.from_pydict({"pair": pa.array(list(pairs)), "n": pa.array(list(pairs.values()), pa.int64())})

    for _ in range(rounds):
        # Pairs of at most 9 + max_rules symbols.
        counted = seqs.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        used, made = set(), 0
        for r in counted.where(F.col("n") >= max(least, gain * total)).orderBy(F.desc("n"), "pair").limit(max_rules).collect():
            if len(rules) < max_rules and not used & set(r["pair"]):
                used |= set(r["pair"])
                rules.append(tuple(r["pair"]))
                made += 1
        if not made:
            break
    return Grammar(rules)


# ---- repair ----


def _stream(rows: DataFrame, step, fresh_state, fields, back=False) -> DataFrame:
    """One pass over the rows of every conversation in the order of ``seg``; ``step(state, row)`` returns state and output."""
    way = F.col("seg").desc() if back else F.col("seg").asc()
    schema = rows.schema["conv"].dataType.simpleString()

    def run(batches):
        own, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["conv"] != own:
                    own, state, begun = row["conv"], fresh_state(), True
                state, made = step(state, row)
                out.append({"conv": own, **made})
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in [("conv", batch.schema.field("conv").type), *fields.values()]],
                                                 ["conv", *[n for n, _ in fields.values()]])

    ddl = ", ".join([f"conv {schema}", *fields])
    return rows.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), way).mapInArrow(run, ddl)


def _borders(long: DataFrame, grammar: Grammar) -> DataFrame:
    """``(seg, entry, goal, final)`` of every segment of conversations that have several."""

    def matrices(batches):
        for batch in batches:
            costs, ranks = [], []
            for s in batch["symbols"].to_pylist():
                m = [grammar.walk(grammar.compress(s), i) for i in range(4)]
                costs.append([c for row in m for c, _ in row])
                ranks.append([sorted(r for _, r in row).index(x) for row in m for _, x in row])
            yield pa.RecordBatch.from_arrays([batch["conv"], batch["seg"], pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32()))],
                                             ["conv", "seg", "costs", "ranks"])

    def from_end(after, row):
        c = np.array(row["costs"]).reshape(4, 4)
        ways = np.minimum(c + np.array(after[0])[None], NEVER)
        # The next state on the best way from each entry: cheapest, then ASCII-least.
        follow = np.lexsort((np.array(row["ranks"]).reshape(4, 4), ways))[:, 0]
        return ([int(x) for x in ways.min(axis=1)], False), {"seg": row["seg"], "follow": follow.tolist(), "final": after[1]}

    def from_start(entry, row):
        goal = row["follow"][entry]
        return goal, {"seg": row["seg"], "entry": entry, "goal": goal, "final": row["final"]}

    kind = long.schema["conv"].dataType.simpleString()
    made = cut(long.select("conv", "seg", "symbols").mapInArrow(matrices, f"conv {kind}, seg long, costs array<long>, ranks array<int>"), "matrices")
    seg, final = ("seg", pa.int64()), ("final", pa.bool_())
    follow = _stream(made, from_end, lambda: ([c for c, _ in END], True),
                     {"seg long": seg, "follow array<int>": ("follow", pa.list_(pa.int32())), "final boolean": final}, back=True)
    return cut(_stream(follow, from_start, lambda: START,
                       {"seg long": seg, "entry int": ("entry", pa.int32()), "goal int": ("goal", pa.int32()), "final boolean": final}), "borders").drop("conv")


def repair(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text", size=SEGMENT) -> DataFrame:
    """Edits and repaired lines, one row per segment: ``(conv, seg, alone, cost, audit, repaired)``, the counts of faults, and ``low``,
    ``high`` and ``turns`` (different known turns that no earlier segment has). ``alone``: the conversation has no other segment."""
    found = segments(faults(turns, conv, turn, role, text), size)
    grammar = learn(found)
    # A segment's neighbours tell whether it is alone, and what happens at its borders.
    line = W.partitionBy("conv").orderBy("seg")
    near = found.select("conv", "seg", "first", "low", F.lag("last").over(line).alias("before"), F.lag("high").over(line).alias("past"),
                        F.lead("seg").over(line).alias("next"))
    near = near.select("seg", (F.col("before").isNull() & F.col("next").isNull()).alias("alone"),
                       F.when(F.col("before").isNotNull() & ~F.concat("before", "first").isin(*["".join(p) for p in LEGAL_PAIRS]), 1).otherwise(0).alias("odd"),
                       F.coalesce((F.col("low") == F.col("past")).cast("int"), F.lit(0)).alias("same"))
    several = cut(near.where("not alone"), "several")
    borders = _borders(found.join(several.select("seg"), "seg", "left_semi"), grammar).join(several, "seg")
    told = found.join(borders, "seg", "left")
    kind = found.schema["conv"].dataType.simpleString()

    def run(batches):
        known = {}
        for batch in batches:
            cols = {c: batch[c].to_pylist() for c in ("symbols", "entry", "goal", "final", "roles", "texts")}
            cost, audit, repaired = [], [], []
            for symbols, entry, goal, final, roles, texts in zip(*cols.values()):
                key = (symbols, entry, goal, final)
                got = known.get(key)
                if got is None:
                    if entry is None:
                        got = whole(grammar, symbols)
                    else:
                        got = grammar.walk(grammar.compress(symbols), entry)[goal]
                        if final:
                            got = got[0] + END[goal][0], got[1] + str(END[goal][1])
                    if len(known) < REMEMBERED:
                        known[key] = got
                cost.append(got[0])
                audit.append(got[1])
                repaired.append(edited(got[1], roles, texts, entry or START))
            yield pa.RecordBatch.from_arrays(
                [batch["conv"], batch["seg"], pa.array([e is None for e in cols["entry"]], pa.bool_()), pa.array(cost, pa.int64()), pa.array(audit, pa.string()),
                 pa.array(repaired, pa.string()), batch["low"], batch["high"], *[batch[n] for n in NUMBERS]],
                ["conv", "seg", "alone", "cost", "audit", "repaired", "low", "high", *NUMBERS])

    told = told.select("conv", "seg", "symbols", "entry", "goal", "final", "roles", "texts", "low", "high", "blank", "duplicate", "truncated",
                       (F.col("illegal") + F.coalesce("odd", F.lit(0))).alias("illegal"), (F.col("turns") - F.coalesce("same", F.lit(0))).alias("turns"))
    return told.mapInArrow(run, f"conv {kind}, seg long, alone boolean, cost long, audit string, repaired string, low long, high long, "
                           + ", ".join(f"{n} long" for n in NUMBERS))


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def summarise(pieces: DataFrame, convs: DataFrame, conv="conv_id") -> DataFrame:
    """One row for every id of ``convs``: the counts, ``cost``, ``audit`` and ``repaired_sha256``.

    A conversation of several segments is hashed in one pass over them, without putting them together.
    """
    pieces = cut(pieces, "repaired")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    one = pieces.where("alone").select("conv", gaps, *sums, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))
    parts = pieces.where("not alone")

    def add(state, row):
        if row["repaired"]:
            state[0].update(("\n" if state[1] else "").encode() + row["repaired"].encode())
            state[1] = True
        return state, {"seg": row["seg"], "sha": state[0].hexdigest()}

    hashed = _stream(parts.select("conv", "seg", "repaired"), add, lambda: [hashlib.sha256(), False],
                     {"seg long": ("seg", pa.int64()), "sha string": ("sha", pa.string())})
    hashed = hashed.groupBy("conv").agg(F.max_by("sha", "seg").alias("repaired_sha256"))
    many = parts.groupBy("conv").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"), *[F.sum(s).alias(s) for s in sums],
                                     F.array_sort(F.collect_list(F.struct("seg", "audit"))).alias("audits"))
    many = many.alias("m").join(hashed.alias("h"), F.expr("m.conv <=> h.conv")).select(
        "m.conv", gaps, *sums, F.array_join("audits.audit", "").alias("audit"), "repaired_sha256")
    done = one.unionByName(many)
    ids = convs.select(F.col(conv).alias("id")).distinct()
    return ids.join(done, F.expr("id <=> conv"), "left").select(
        F.col("id").alias(conv), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in RESULT], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
