"""Packing documents into sequences of at most ``window`` tokens: non-negative least squares over the histogram of lengths.

A document's ids, with the end id, fill whole windows of their own; what is left over, shorter than a window, is packed.

1. Texts become token ids, written once. A task numbers its documents per left-over length, so that a document's place among all of
   its length is its own number plus what earlier tasks counted: no length, however frequent, is collected in one place.
2. The histogram of left-over lengths has at most ``window`` entries. Shallow combinations of length classes (``UNITS`` of them) that
   fill a window are enumerated, their repeats solved for by non-negative least squares against the histogram, in tokens, and rounded down.
3. The plan turns combinations into exact lengths, always the longest that are there. Gaps are filled with a left-over of that length,
   else by cutting the longest. What the solution leaves is packed greedily by the same rule. All of it works on lengths with
   multiplicities, so the plan has at most some thousands of steps at any size of the data.
4. Every document looks its pieces up by length and place, and cuts its ids.

Sequences are full but for the last few: tokens that fill no window are cut to powers of two, which need no padding.

Nulls and edges: a null text is empty, so that its ids are the end id. Null ids and repeated rows are documents of their own.
Texts of any length are encoded whole. No rows, no rows. Other columns are not read.
"""

from bisect import bisect_right
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textkin.llm.token_ids import encoder
from textkin.llm.words import blocks
from textkin.session import cut

WINDOW = 4096
#: Length classes of a window, most pieces of a combination, and most of one with two different lengths.
UNITS, DEPTH, REPEATS = 64, 4, 16
BLOCK = 4_000_000
#: Sequence numbers: those of the plan are below 2**36, those of whole windows are (task + 1) * 2**36 + number.
TASK_BITS = 36


def combinations(units=UNITS, depth=DEPTH, repeats=REPEATS) -> list[tuple]:
    """Multisets of class sizes, largest first, that fill a window: of ``depth`` pieces, or of two sizes and ``repeats`` pieces."""
    out = set()

    def extend(head, left, most):
        if not left:
            out.add(head)
        elif len(head) < depth:
            for q in range(min(most, left), 0, -1):
                extend((*head, q), left - q, q)

    extend((), units, units)
    for a in range(1, units):
        for b in range(1, a + 1):
            for m in range(1, units // a + 1):
                n, rest = divmod(units - m * a, b)
                if not rest and m + n <= repeats:
                    out.add((a,) * m + (b,) * n)
    return sorted(out, reverse=True)


def nnls(a: np.ndarray, b: np.ndarray, tolerance=1e-9) -> np.ndarray:
    """The ``x >= 0`` with the smallest ``|a x - b|`` (active sets)."""
    x = np.zeros(a.shape[1])
    free = np.zeros(a.shape[1], bool)
    limit = tolerance * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(10 * a.shape[0] + 10):
        gain = np.where(free, -np.inf, a.T @ (b - a @ x))
        if gain.max(initial=-np.inf) <= limit:
            break
        free[gain.argmax()] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (z <= 0)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
        x = z
    return x


class Plan:
    """Where the left-overs of every length go: ``pieces[length, start]`` holds, by place, lengths, sequences and offsets."""

    def __init__(self, histogram: dict, window=WINDOW, units=UNITS):
        self.window, self.unit = window, max(1, -(-window // units))
        self.counts = np.zeros(window + 1, np.int64)
        self.items = defaultdict(deque)  # length -> runs [left-over length, first place, number, start]
        for length, n in histogram.items():
            if n:
                self.counts[length] = n
                self.items[length].append([length, 0, n, 0])
        self.sequences, self.steps, self.solved = 0, 0, 0
        self.found = defaultdict(list)
        for combination, n in self.solve(units):
            self.repeat(combination, n)
        while self.tokens() >= window:
            slots, k = self.compose(window, [])
            self.put(slots, k)
        left = self.tokens()
        for bit in reversed(range(left.bit_length())):
            if left >> bit & 1:
                self.put(*self.compose(1 << bit, [], 1))
        self.pieces = {key: tuple(np.array(c) for c in zip(*sorted(v))) for key, v in self.found.items()}

    def tokens(self):
        return int(self.counts @ np.arange(len(self.counts)))

    def solve(self, units):
        """Combinations and their rounded repeats, most tokens first."""
        sizes = np.add.reduceat(self.counts[1:], np.arange(0, self.window, self.unit)).astype(float)
        options = [c for c in combinations(len(sizes)) if all(sizes[q - 1] for q in c)]
        if not options:
            return []
        a = np.zeros((len(sizes), len(options)))
        for j, c in enumerate(options):
            for q in c:
                a[q - 1, j] += q
        x = np.floor(nnls(a, sizes * np.arange(1, len(sizes) + 1)) + 1e-6).astype(np.int64)
        self.solved = int(x.sum())
        return sorted(((options[j], int(x[j])) for j in np.flatnonzero(x)), key=lambda r: (-r[1], r[0]))

    def longest(self, low, high, used):
        """The longest length within the bounds of which there are more than ``used``; 0: none."""
        for length in (np.flatnonzero(self.counts[low:high + 1]) + low)[::-1].tolist():
            if self.counts[length] > used.get(length, 0):
                return length
        return 0

    def compose(self, gap, slots, most=None):
        """Slots ``(length, taken)`` that fill ``gap`` more tokens, and how often they can be repeated."""
        slots, used = list(slots), {}
        for length, _ in slots:
            used[length] = used.get(length, 0) + 1
        while gap:
            fits = self.longest(1, gap, used)
            if fits * 2 < gap:  # rather cut one piece than add many
                fits = self.longest(gap, self.window, used) or fits
            if not fits:
                return slots, 0
            take = min(fits, gap)
            slots.append((fits, take))
            used[fits] = used.get(fits, 0) + 1
            gap -= take
        k = min(int(self.counts[length]) // n for length, n in used.items())
        return slots, k if most is None else min(k, most)

    def repeat(self, combination, n):
        """The combination ``n`` times, or as often as its classes have lengths."""
        while n:
            slots, used = [], {}
            for q in combination:
                length = self.longest((q - 1) * self.unit + 1, min(q * self.unit, self.window), used)
                if not length:
                    return
                slots.append((length, length))
                used[length] = used.get(length, 0) + 1
            slots, k = self.compose(self.window - sum(t for _, t in slots), slots, n)
            if not k:
                return
            self.put(slots, k)
            n -= k

    def put(self, slots, k):
        """``k`` sequences of these slots; what is cut off goes back to the lengths."""
        offset, rests = 0, []
        for length, take in slots:
            runs, need = self.items[length], k
            self.counts[length] -= k
            while need:
                run = runs[0]
                n = min(need, run[2])
                self.found[run[0], run[3]].append((run[1], take, self.sequences + k - need - run[1], offset))
                if take < length:
                    rests.append((length - take, [run[0], run[1], n, run[3] + take]))
                run[1], run[2], need = run[1] + n, run[2] - n, need - n
                if not run[2]:
                    runs.popleft()
            offset += take
        for length, run in rests:
            self.items[length].append(run)
            self.counts[length] += run[2]
        self.sequences += k
        self.steps += 1

    def of(self, length: int, place: int):
        """``(start, length, sequence, offset)`` of the pieces of a left-over."""
        start = 0
        while start < length:
            first, take, base, offset = self.pieces[length, start]
            i = bisect_right(first, place) - 1
            yield start, int(take[i]), int(base[i]) + place, int(offset[i])
            start += int(take[i])


PIECES = "doc_id {0}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, window=WINDOW, id="doc_id", text="text") -> DataFrame:
    """``(id, n, part, place, windows, rest, ids)`` of every row, written: number of ids, task, number among its rows of the same
    left-over length, whole windows of its rows before, left-over length, and the ids."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        part, own = TaskContext.get().partitionId(), encoder(tokenizer)
        dtype = np.uint32 if end_id >= 1 << 16 else own.dtype
        counts, windows = np.zeros(window, np.int64), 0
        for batch in blocks(batches, "text", BLOCK):
            ids, ends = own.encode(batch["text"])
            n = np.diff(ends) + 1
            rest, whole = n % window, n // window
            place = np.empty(len(n), np.int64)
            for i, r in enumerate(rest.tolist()):
                place[i] = counts[r]
                counts[r] += 1
            before = windows + np.cumsum(whole) - whole
            windows += int(whole.sum())
            blob = [ids[a:b].astype(dtype).tobytes() + dtype(end_id).tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n), pa.array(np.full(len(n), part)), pa.array(place), pa.array(before), pa.array(rest),
                                              pa.array(blob, pa.binary())], ["id", "n", "part", "place", "windows", "rest", "ids"])

    return cut(rows.mapInArrow(run, f"id {kind}, n long, part long, place long, windows long, rest long, ids binary"), "tokens")


def pack(docs: DataFrame, tokenizer: str, end_id: int, window=WINDOW, id="doc_id", text="text") -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``; ``ids`` are little-endian unsigned 32-bit numbers.

    ``tokenizer`` is the path of a ``tokenizers`` file that every executor can read.
    """
    tokens = tokenize(docs, tokenizer, end_id, window, id, text)
    counted = tokens.groupBy("part", "rest").agg(F.count("*").alias("count"))
    histogram = {r["rest"]: r["count"] for r in counted.groupBy("rest").agg(F.sum("count").alias("count")).collect()}  # at most ``window`` rows
    histogram.pop(0, None)
    plan = Plan(histogram, window)
    held = tokens.sparkSession.sparkContext.broadcast(plan)
    before = W.partitionBy("rest").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counted.select("part", "rest", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    told = tokens.join(offsets, ["part", "rest"]).select("id", "n", "part", "windows", "rest", (F.col("place") + F.col("earlier")).alias("place"), "ids")
    kind = tokens.schema["id"].dataType.simpleString()

    def run(batches):
        plan = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows, starts, lengths, sequences, offset, blobs = [], [], [], [], [], []
                columns = [some[c].to_pylist() for c in ("n", "part", "windows", "rest", "place", "ids")]
                for i, (n, part, windows, rest, place, blob) in enumerate(zip(*columns)):
                    ids = np.frombuffer(blob, np.dtype(f"<u{len(blob) // n}")).astype("<u4")
                    base = n - rest
                    own = [(w * window, window, ((part + 1) << TASK_BITS) + windows + w, 0) for w in range(base // window)]
                    own += [(base + s, m, q, o) for s, m, q, o in plan.of(rest, place)]
                    for s, m, q, o in own:
                        rows.append(i)
                        starts.append(s)
                        lengths.append(m)
                        sequences.append(q)
                        offset.append(o)
                        blobs.append(ids[s:s + m].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [some["id"].take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary()),
                     some["n"].take(pa.array(rows, pa.int64())), pa.array(sequences, pa.int64()), pa.array(offset, pa.int64())],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return told.mapInArrow(run, PIECES.format(kind))


def assemble(pieces: DataFrame, window=WINDOW, pad_id=0) -> DataFrame:
    """``(sequence_id, n_tokens, ids)``: the sequences, padded to ``window`` unless their tokens number a power of two."""
    parts = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    pad = np.uint32(pad_id).tobytes().hex()
    ids = F.reduce("parts", F.unhex(F.lit("")), lambda out, p: F.concat(out, p["ids"]))
    missing = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(window - F.col("n_tokens"))
    return parts.select("sequence_id", "n_tokens", F.concat(ids, F.unhex(F.repeat(F.lit(pad), missing.cast("int")))).alias("ids"))
