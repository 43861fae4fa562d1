"""Chat transcripts: speaker roles by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines ``(conv, major, minor, line)`` in the order of (major, minor). A state is a role that
begins a turn or goes on with it. Observed of a line: its speaker marker (``User:``, ``<|bot|>``, ``### Reply``, ``[Q]``; markers are learned,
not listed), its length, its last sign, and whether the line before was blank. Viterbi finds the best sequence of states; a
turn is a begin with what goes on from it, rendered as ``<|role|>``, its lines without the marker, ``<|end|>``.

Transcripts of any length are decoded exactly. Lines are cut into segments of ``SEGMENT`` majors; a segment is the
max-plus product of its steps, a small matrix from states before to states after. Products are combined ``FAN`` at a time to
one matrix per transcript; on the way back each level fixes the states at the borders of the level below, and segments are decoded
between them. Turns are counted per segment, and added up over segments.

Nulls and edges: a null line is an empty one. Rows without transcript id or major come back as turns of their own with a
null role. Repeated rows are lines of their own. Transcripts without lines don't exist; no rows, no rows. A model that was
fitted on nothing knows no role, so every line has a null role. Other columns are not read.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textkin.session import cut

SEGMENT, FAN = 64, 256
#: Markers and roles that are told apart; the rarer ones are one value, ``*``.
MAX_MARKERS, MAX_ROLES = 200, 200
SMOOTHING = 0.5
MARKER = r"^\s*(?:<\|\s*(\p{L}+)\s*\|>|#{2,}\s*(\p{L}+)\s*:?|\[(\p{L}+)\]|(\p{L}+)\s*:)"
LENGTHS = (1, 20, 80, 160, 320, 640, 1280)
NONE, RARE = "", "*"

_MARKER = re.compile(MARKER.replace(r"\p{L}", r"[^\W\d_]"))
DECODED = "conv long, major long, minor long, line string, role string, begins int, local int, seg long"


def marker_of(line: str) -> tuple[str, int]:
    """The lower-cased speaker marker of a line and where the text after it starts."""
    m = _MARKER.match(line)
    return (next(x for x in m.groups() if x).lower(), m.end()) if m else (NONE, 0)


def features(line: str, after_blank: bool) -> tuple[str, int, str, int]:
    marker, at = marker_of(line)
    text = line[at:].strip()
    end = text[-1:] if text[-1:] in ".?!:" else ("" if not text else "x")
    return marker, sum(len(text) >= n for n in LENGTHS), end, int(after_blank)


@dataclass
class Model:
    roles: list  # state 2 * r begins a turn of role r, 2 * r + 1 goes on
    start: np.ndarray  # log-probabilities by state
    move: np.ndarray  # [state, next state]
    emit: list  # per feature {value: log-probabilities by state}; ``None`` is any other value

    def steps(self, lines, after_blank=False):
        """Log-probability of each line under each state."""
        out = np.zeros((len(lines), len(self.start)))
        for i, line in enumerate(lines):
            for table, value in zip(self.emit, features(line, after_blank)):
                out[i] += table.get(value, table[None])
            after_blank = not line.strip()
        return out


def _logs(counts, axis):
    p = counts + SMOOTHING
    return np.log(p / p.sum(axis=axis, keepdims=True))


def fit(turns: DataFrame, conv="conv", turn="turn", role="role", lines="lines") -> Model:
    """A model from turns ``(conv, turn, role, lines)`` whose ``lines`` are as transcripts have them.

    Only counts reach the driver: of states and moves, and of feature values per state, the rarest markers being one value, as
    are the rarest roles. Of rows that repeat a turn each one counts, but only one, the last in order, stands before the next turn.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(lines).alias("lines"))
    rows = rows.where("conv is not null and turn is not null and role is not null and size(lines) > 0")
    ranked = rows.groupBy("role").count().orderBy(F.desc("count"), "role").limit(MAX_ROLES + 1).collect()
    roles = sorted(r["role"] for r in ranked[:MAX_ROLES])
    if len(ranked) > MAX_ROLES:
        rows = rows.withColumn("role", F.when(F.col("role").isin(*roles), F.col("role")).otherwise(RARE))
        roles = sorted({*roles, RARE})
    place, n = {r: i for i, r in enumerate(roles)}, 2 * len(roles)
    start, move = np.zeros(n), np.zeros((n, n))
    # Moves within turns depend on the number of lines; moves between turns need the turn before, by an equi-join.
    for r in rows.groupBy("role").agg(F.sum((F.size("lines") > 1).cast("long")).alias("one"), F.sum(F.greatest(F.size("lines") - 2, F.lit(0))).alias("on")).collect():
        b = 2 * place[r["role"]]
        move[b, b + 1] += r["one"]
        move[b + 1, b + 1] += r["on"]
    # One row per turn, so that a turn that many rows repeat is joined once.
    closing = rows.groupBy("conv", (F.col("turn") + 1).alias("turn")).agg(
        F.max(F.struct(F.col("role").alias("last"), (F.size("lines") > 1).alias("long"), (F.trim(F.element_at("lines", -1)) == "").alias("blank"))).alias("x"))
    ends = closing.select("conv", "turn", "x.last", "x.long")
    pairs = rows.select("conv", "turn", "role").join(ends, ["conv", "turn"], "left").groupBy("role", "last", "long").count()
    for r in pairs.collect():
        to = 2 * place[r["role"]]
        if r["last"] is None:
            start[to] += r["count"]
        else:
            move[2 * place[r["last"]] + int(r["long"]), to] += r["count"]

    def observe(batches):
        for batch in batches:
            seen = {}
            for who, own, before in zip(batch["role"].to_pylist(), batch["lines"].to_pylist(), batch["blank"].to_pylist()):
                for i, line in enumerate(own):
                    for k, v in enumerate(features(line or "", before)):
                        key = (2 * place[who] + (i > 0), k, str(v))
                        seen[key] = seen.get(key, 0) + 1
                    before = not (line or "").strip()
            if seen:
                s, k, v = zip(*seen)
                yield pa.RecordBatch.from_pydict({"state": pa.array(s, pa.int32()), "feature": pa.array(k, pa.int32()), "value": pa.array(v), "n": pa.array(list(seen.values()), pa.int64())})

    # The line before a turn is the last one of the turn before; it is blank if that turn ends so.
    last = closing.select("conv", "turn", "x.blank")
    told = rows.join(last, ["conv", "turn"], "left").select("role", "lines", F.coalesce("blank", F.lit(False)).alias("blank"))
    counted = told.mapInArrow(observe, "state int, feature int, value string, n long").groupBy("state", "feature", "value").agg(F.sum("n").alias("n"))
    counted = cut(counted, "observations")
    common = counted.where(f"feature = 0 and value <> '{NONE}'").groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(MAX_MARKERS)
    known = {NONE} | {r["value"] for r in common.collect()}
    value = F.when((F.col("feature") != 0) | F.col("value").isin(*known), F.col("value")).otherwise(RARE)
    tables = [{}, {}, {}, {}]
    for r in counted.groupBy("state", "feature", value.alias("value")).agg(F.sum("n").alias("n")).collect():
        kind = str if r["feature"] in (0, 2) else int
        tables[r["feature"]].setdefault(kind(r["value"]), np.zeros(n))[r["state"]] += r["n"]
    emit = []
    for table in tables:
        values = sorted(table)
        logs = _logs(np.stack([table[v] for v in values] + [table.get(RARE, np.zeros(n))]), 0) if n else np.zeros((len(values) + 1, 0))
        emit.append({v: logs[i] for i, v in enumerate(values)} | {None: logs[-1]})
    return Model(roles, _logs(start, 0) if n else start, _logs(move, 1) if n else move, emit)


# ---- max-plus algebra; row -1 of a product is the start of a transcript ----


def product(model: Model, steps) -> np.ndarray:
    """Best log-probability from each state before the lines (last row: the start) to each state of the last line."""
    out = np.vstack([model.move, model.start]) + steps[0]
    for e in steps[1:]:
        out = (out[:, :, None] + model.move[None]).max(axis=1) + e
    return out


def chain(products) -> np.ndarray:
    out = products[0]
    for p in products[1:]:
        out = (out[:, :, None] + p[None, :-1]).max(axis=1)
    return out


def _path(first, links, goal):
    """Best states through ``links`` after ``first`` (scores by state) to the state ``goal``; ``None`` leaves the last state free."""
    score, back = first, []
    for link in links:
        options = score[:, None] + link
        back.append(options.argmax(axis=0))
        score = options.max(axis=0)
    state = int(score.argmax()) if goal is None else goal
    path = [state]
    for b in reversed(back):
        state = int(b[state])
        path.append(state)
    return path[::-1]


def borders(products, entry, goal):
    """States at the ends of consecutive segments, entered from ``entry`` and left in ``goal``."""
    return _path(products[0][entry], [p[:-1] for p in products[1:]], goal)


def decode(model, steps, entry=-1, goal=None):
    links = [model.move + e for e in steps[1:]]
    return _path(np.vstack([model.move, model.start])[entry] + steps[0], links, goal)


def _square(blob, n):
    return np.frombuffer(blob, np.float64).reshape(n + 1, n)


def _ordered(table):
    return table.sort_by([("major", "ascending"), ("minor", "ascending")])


def recover_roles(lines: DataFrame, model: Model, conv="conv", major="major", minor="minor", line="line", segment=SEGMENT, fan=FAN) -> DataFrame:
    """``(conv, major, minor, line, turn, role, begins)`` of every line; ``turn`` counts the recovered turns from 0."""
    rows = lines.select(F.col(conv).cast("long").alias("conv"), F.col(major).cast("long").alias("major"),
                        F.coalesce(F.col(minor).cast("long"), F.lit(0)).alias("minor"), F.coalesce(F.col(line), F.lit("")).alias("line"))
    odd = rows.where("conv is null or major is null").select("*", F.lit(0).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(True).alias("begins"))
    if not model.roles:
        return odd.unionByName(rows.where("conv is not null and major is not null").select(
            "*", F.lit(0).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(True).alias("begins")))
    rows = rows.where("conv is not null and major is not null").withColumn("seg", F.floor(F.col("major") / segment))
    # Transcripts of one segment are decoded as they are; those of several need the states at the segments' borders first.
    several = rows.select("conv", "seg").distinct().groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    several = cut(several, "several")

    def found(table, entry, goal, before):
        text = table["line"].to_pylist()
        path = decode(model, model.steps(text, before), entry, goal)
        begins = np.array([s % 2 == 0 for s in path])
        if entry == -1:
            begins[0] = True
        return pa.table({"conv": table["conv"], "major": table["major"], "minor": table["minor"], "line": table["line"],
                         "role": pa.array([model.roles[s // 2] for s in path]), "begins": pa.array(begins.astype(np.int32)),
                         "local": pa.array(np.cumsum(begins).astype(np.int32)), "seg": table["seg"]})

    turn = F.col("local").cast("long") - 1
    out = rows.join(several, "conv", "left_anti").select("conv", "major", "minor", "line", "seg").groupBy("conv", "seg").applyInArrow(
        lambda t: found(_ordered(t), -1, None, False), DECODED).withColumn("turn", turn)

    long = rows.join(several, "conv", "left_semi")
    # What stands before a segment's first line: whether it is blank.
    last = long.groupBy("conv", "seg").agg(F.max(F.struct("major", "minor", (F.trim("line") == "").alias("blank"))).alias("x"))
    before = last.select("conv", "seg", "x.blank").withColumn("blank", F.lag("blank", 1, False).over(W.partitionBy("conv").orderBy("seg")))
    long = cut(long.join(before, ["conv", "seg"]), "lines")
    states = _border_states(long, model, fan)
    decoded = cut(long.join(states, ["conv", "seg"]).groupBy("conv", "seg").applyInArrow(
        lambda t: found(_ordered(t), t["entry"][0].as_py(), t["goal"][0].as_py(), t["blank"][0].as_py()), DECODED), "decoded")
    per = decoded.groupBy("conv", "seg").agg(F.sum("begins").alias("n"))
    offset = per.select("conv", "seg", (F.sum("n").over(W.partitionBy("conv").orderBy("seg")) - F.col("n")).alias("off"))
    far = decoded.join(offset, ["conv", "seg"]).withColumn("turn", turn + F.col("off")).drop("off")
    out = out.unionByName(far).select("conv", "major", "minor", "line", "turn", "role", (F.col("begins") == 1).alias("begins"))
    return out.unionByName(odd.select(out.columns))


def _border_states(rows, model, fan):
    """``(conv, seg, entry, goal)``: the state before and at the end of every segment on the best path."""
    kind = "conv long, seg long, blob binary"

    def segment(t):
        t = _ordered(t)
        m = product(model, model.steps(t["line"].to_pylist(), t["blank"][0].as_py()))
        return pa.table({"conv": t["conv"].slice(0, 1), "seg": t["seg"].slice(0, 1), "blob": pa.array([m.tobytes()], pa.binary())})

    def combine(t):
        t = t.sort_by("seg")
        n = len(model.start)
        m = chain([_square(b, n) for b in t["blob"].to_pylist()])
        return pa.table({"conv": t["conv"].slice(0, 1), "seg": t["up"].slice(0, 1), "blob": pa.array([m.tobytes()], pa.binary())})

    def fix(t):
        t = t.sort_by("seg")
        n = len(model.start)
        goal = t["goal"][0].as_py()
        entry = t["entry"][0].as_py()
        states = borders([_square(b, n) for b in t["blob"].to_pylist()], entry, None if goal < 0 else goal)
        return pa.table({"conv": t["conv"], "seg": t["seg"], "entry": pa.array([entry, *states[:-1]], pa.int32()), "goal": pa.array(states, pa.int32())})

    levels = [cut(rows.groupBy("conv", "seg").applyInArrow(segment, kind), "products")]
    while levels[-1].groupBy("conv").count().where("count > 1").limit(1).count():
        up = levels[-1].withColumn("up", F.floor(F.col("seg") / fan))
        levels.append(cut(up.groupBy("conv", "up").applyInArrow(combine, kind), "products"))
    states = levels[-1].select("conv", "seg", F.lit(-1).alias("entry"), F.lit(-1).alias("goal"))
    for level in reversed(levels[:-1]):
        above = states.withColumnRenamed("seg", "up")
        down = level.withColumn("up", F.floor(F.col("seg") / fan)).join(above, ["conv", "up"])
        states = cut(down.groupBy("conv", "up").applyInArrow(fix, "conv long, seg long, entry int, goal int"), "borders")
    return states


def render(recovered: DataFrame) -> DataFrame:
    """``(conv, turn, role, n_lines, rendered)``: one canonical turn per row. Rows without transcript id or major are turns of their own."""
    marker = F.regexp_replace("line", MARKER, "")
    text = F.when(F.col("begins"), F.trim(marker)).otherwise(F.col("line"))
    # Rows without transcript or major get a number of their own to be grouped by; a union would decode all lines twice.
    own = F.when(F.col("conv").isNull() | F.col("major").isNull(), F.monotonically_increasing_id())
    # A turn's lines are joined in order; a turn is no larger than the row it becomes.
    rows = recovered.withColumn("own", own).groupBy("conv", "turn", "role", "own").agg(
        F.array_sort(F.collect_list(F.struct("major", "minor", text.alias("text")))).alias("lines"))
    return rows.select("conv", "turn", "role", F.size("lines").cast("long").alias("n_lines"),
                       F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.array_join("lines.text", "\n"), F.lit("\n<|end|>")).alias("rendered"))
