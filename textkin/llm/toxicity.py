"""Toxicity of documents by a weighted finite-state pattern grammar.

Tokens are runs of letters (``str.isalpha``) in lower case, character by character; each is one symbol: insult, threat, target (who is spoken to), negation, reported speech, or
other. Five transducers read a clause (tokens between ``. ! ? ;`` and line ends) in a row:

* insult: the first insult of a clause as it is, further ones as pile-up,
* threat: a threat counts as one only if a target stands before or right after it,
* target: insults and threats that follow a target are aimed,
* negation: within three tokens after a negation they are denied,
* reported speech: after a verb of saying they are reported, up to the end of the clause.

They are composed into one deterministic machine. Its arcs carry weights, and a document's score is the logistic function
of a bias and the weights of the paths of its matched clauses; clauses without insult or threat match nothing.

Fitted on labelled rows: the insult lexicon (words and word beginnings that nearly only toxic texts hold) and the arc
weights (logistic regression with the grammar's own weights as its prior). The sample takes about ``MAX_ROWS`` rows per
class by a hash of their ids; fewer are all taken. Only texts enter a score.

Nulls and edges: null and empty texts match nothing and get the bias alone, below 0.5 unless most of the sample is toxic. Without
labels of both classes the lexicon is empty and the prior holds. Rows repeat as often as they are given; labels that
repeat an id count once, the larger one. Columns in ``keep`` pass through; new columns get underscores where a name is taken.
"""

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.llm.tables import fresh
from textkin.llm.words import U64, blocks, words_of
from textkin.session import cut

MAX_ROWS = 2000
FIT_TASKS = 8
#: A lexicon entry: different words before it in toxic rows, as a share of these rows and in number at least, and toxic share of such words
#: with classes of equal size.
SUPPORT, LEAST, PRECISION = 0.01, 3, 0.97
BEGINNINGS = (4, 5, 6)

THREATS = "kill hurt destroy beat burn shoot stab crush strangle töten umbringen verletzen schlagen tuer frapper blesser matar golpear herir".split()
TARGETS = "you your yours u they them these those du dich dir ihr euch sie tu toi te vous vos tú ti usted ustedes vosotros".split()
NEGATIONS = "not no never neither nor nobody isn aren don doesn didn nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún ninguna".split()
REPORTS = ("said says say called calls claimed wrote writes told quoted quote sagte sagt nannte schrieb dit disait écrit "
           "appelé dijo dice llamó escribió").split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# ---- transducers: state 0 starts; arcs[state][symbol] = (state, symbol out) ----


@dataclass
class Transducer:
    """``arcs[state]["*"]`` is the state after any other symbol, by default the same; such symbols pass unchanged."""

    arcs: dict

    def step(self, state, symbol):
        row = self.arcs.get(state, {})
        return row.get(symbol) or (row.get("*", state), symbol)


def insult_machine():
    return Transducer({0: {"insult": (1, "insult")}, 1: {"insult": (1, "pile")}})


def threat_machine():
    """``threat`` without a target before it waits one token for one; what is never aimed is dropped to ``other``."""
    return Transducer({0: {"threat": (2, "other"), "target": (1, "target")}, 1: {"threat": (1, "threat")},
                       2: {"target": (1, "threat"), "threat": (2, "other"), "*": 0}})


def target_machine():
    marks = {x: (1, f"aimed {x}") for x in ("insult", "pile", "threat")}
    return Transducer({0: {"target": (1, "other"), "threat": (1, "aimed threat")}, 1: {"target": (1, "other"), **marks}})


def _marking(mark, trigger, span):
    """After ``trigger`` every match is marked: for ``span`` tokens, or to the end of the clause."""
    base = [f"{a}{x}" for a in ("", "aimed ") for x in ("insult", "pile", "threat")]
    base += [f"denied {x}" for x in base] if mark == "reported" else []
    arcs = {0: {trigger: (span or 1, "other")}}
    for state in range(1, (span or 1) + 1):
        to = state - 1 if span else 1
        arcs[state] = {x: (to, f"{mark} {x}") for x in base} | {trigger: (span or 1, "other"), "*": to}
    return Transducer(arcs)


def negation_machine():
    return _marking("denied", "negation", 3)


def report_machine():
    return _marking("reported", "report", 0)


def compose(*machines):
    """One machine over the product of the states, which starts in 0: table[state][symbol] = (state, output)."""
    symbols = ("other", "insult", "threat", "target", "negation", "report")
    numbers, todo, table = {(0,) * len(machines): 0}, [(0,) * len(machines)], []
    while len(table) < len(todo):
        states, row = todo[len(table)], []
        for symbol in symbols:
            to, out = [], symbol
            for machine, state in zip(machines, states):
                state, out = machine.step(state, out)
                to.append(state)
            to = tuple(to)
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row.append((numbers[to], out))
        table.append(row)
    return table


#: Weight of each kind of match before labels are seen; marks multiply.
BASE = {"insult": 1.5, "pile": 1.5, "threat": 2.0}
MARKS = {"aimed": 1.3, "denied": 0.2, "reported": 0.3}
BIAS = -2.5


def prior_weight(output):
    *marks, kind = output.split()
    return reduce(lambda w, m: w * MARKS[m], marks, BASE[kind])


@dataclass
class Grammar:
    words: np.ndarray  # sorted hashes of insult words
    beginnings: dict  # bytes -> sorted hashes of insult beginnings
    outputs: list
    weights: np.ndarray
    bias: float

    def fields(self):
        """What is broadcast: arrays and lists, from which tasks build the grammar again."""
        return self.words, self.beginnings, self.outputs, self.weights, self.bias

    def __post_init__(self):
        self.table = machine()
        place = {o: i for i, o in enumerate(self.outputs)}
        self.arcs = [[(to, place.get(out, -1)) for to, out in row] for row in self.table]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How often each output occurs in the matched clauses of each text."""
        words = words_of(letters(texts), _NOT_LETTER)
        out = np.zeros((len(texts), len(self.outputs)))
        symbols = self.symbols(words)
        hits = np.flatnonzero((symbols == INSULT) | (symbols == THREAT))
        if not len(hits):
            return out
        breaks = np.cumsum(_BREAK[words.data])[words.starts]
        doc = np.repeat(np.arange(len(texts)), words.counts())
        new = np.flatnonzero(np.concatenate([[True], (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])]))
        clauses = np.unique(np.searchsorted(new, hits, "right") - 1)
        ends = np.append(new[1:], len(symbols))
        for a, b in zip(new[clauses].tolist(), ends[clauses].tolist()):
            state, own = 0, out[doc[a]]
            for symbol in symbols[a:b].tolist():
                state, o = self.arcs[state][symbol]
                if o >= 0:
                    own[o] += 1
        return out

    def symbols(self, words):
        hashed = words.prefixes(lower=True)
        whole = hashed(None)
        out = np.zeros(len(words), np.int8)
        for symbol, known in _FIXED.items():
            out[_among(whole, known)] = symbol
        insult = _among(whole, self.words)
        size = words.ends - words.starts
        for k, known in self.beginnings.items():
            insult |= _among(hashed(k), known) & (size > k)
        out[insult] = INSULT
        return out

    def scores(self, texts):
        x = self.counts(texts) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def machine():
    return compose(insult_machine(), threat_machine(), target_machine(), negation_machine(), report_machine())


def outputs():
    return sorted({out for row in machine() for _, out in row if out.split()[-1] in BASE})


class _Characters:
    """A table that a process fills for itself; functions that are sent to tasks take an empty one along."""

    found = None

    def __reduce__(self):
        return type(self), ()

    def table(self):
        if self.found is None:
            self.found = np.fromiter(map(self._one, range(0x110000)), np.int64, 0x110000)
        return self.found

    @staticmethod
    def _one(code):
        c = chr(code)
        if code < 128 or not c.isalpha():
            return 0
        low = c.lower()
        return ord(low) if len(low) == 1 and len(low.encode()) == len(c.encode()) else code


_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: For ``bytes.translate``: letters in lower case, the rest of ASCII as spaces.
_PLAIN = bytes(0x20 if _NOT_LETTER[b] else b | 0x20 if b < 128 else b for b in range(256))
_BREAK = np.zeros(256, np.int64)
_BREAK[[ord(c) for c in ".!?;\n"]] = 1


#: Of every character outside ASCII: its lower case if that is as long in UTF-8, else itself; 0 for what is no letter.
_CHARACTERS = _Characters()


def letters(texts: pa.Array) -> pa.Array:
    """The texts with characters outside ASCII in lower case, or as spaces where they are no letters; nulls are empty.

    Every character keeps its bytes, so offsets hold. ASCII stays as it is.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return texts
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    if data.max() < 128:
        return texts
    data, known = data.copy(), _CHARACTERS.table()
    # Lead bytes of characters of two, three and four bytes, and the bits of the character in them.
    for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        at = np.flatnonzero((data >= low) & (data < high))
        at = at[at + size <= len(data)]
        if not len(at):
            continue
        code = (data[at] - low).astype(np.int64)
        for i in range(1, size):
            code = code << 6 | data[at + i] & 0x3F
        to = known[np.minimum(code, len(known) - 1)]
        none = to == 0
        for i in range(size - 1, 0, -1):
            data[at + i] = np.where(none, 0x20, 0x80 | to & 0x3F)
            to = to >> 6
        data[at] = np.where(none, 0x20, low | to)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data))


def _hashes(items):
    items = pa.array(list(items), pa.string())
    return np.sort(words_of(letters(items), _NOT_LETTER).hashes(lower=True)) if len(items) else np.empty(0, U64)


def _among(values, known):
    if not len(known):
        return np.zeros(len(values), bool)
    i = np.searchsorted(known, values)
    i[i == len(known)] = 0
    return known[i] == values


_FIXED = {THREAT: _hashes(THREATS), TARGET: _hashes(TARGETS), NEGATION: _hashes(NEGATIONS), REPORT: _hashes(REPORTS)}


# ---- fitting ----


def sample(docs: DataFrame, labels: DataFrame, id="doc_id", text="text", label="toxic", max_rows=MAX_ROWS) -> DataFrame:
    """``(text, toxic)`` of about ``max_rows`` labelled rows of each class, written to the shared folder."""
    known = labels.select(F.col(id).alias("key"), F.col(label).cast("int").alias("toxic")).where("key is not null and toxic in (0, 1)")
    known = known.groupBy("key").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    part = F.when(F.col("toxic") == 1, max_rows / sizes.get(1, 1)).otherwise(max_rows / sizes.get(0, 1))
    chosen = known.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < part * 1_000_000)
    texts = docs.select(F.col(id).alias("key"), F.col(text).alias("text")).where("text is not null")
    return cut(texts.join(F.broadcast(chosen), "key").select("text", "toxic").repartition(FIT_TASKS), "sample")


def _words(batches):
    """Every word of a text once for each word that it follows, split as scores split it."""
    for batch in blocks(batches, "text"):
        for toxic, text in zip(batch["toxic"].to_pylist(), letters(batch["text"])):
            words = text.as_buffer().to_pybytes().translate(_PLAIN).split()
            pairs = sorted(set(zip(words, [b"", *words])))
            if pairs:
                entry, after = (pa.array(x, pa.binary()).cast(pa.string()) for x in zip(*pairs))
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(pairs), pa.int32()), entry, after], ["toxic", "entry", "after"])


def lexicon(rows: DataFrame) -> list[tuple[str, bool]]:
    """``(letters, is a beginning)`` of the insult entries.

    An entry is counted by the different words it follows; the sample bounds how many reach the support. Insults follow any word; the rare words of a passage that
    toxic texts copied from each other always follow the same one and prove nothing.
    """
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return []
    each = cut(rows.mapInArrow(_words, "toxic int, entry string, after string").distinct(), "words")

    def chosen(each):
        counted = each.groupBy("entry").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
        bad, good = F.col("bad") / totals[1], F.col("good") / totals[0]
        found = counted.where((F.col("bad") >= max(LEAST, SUPPORT * totals[1])) & (bad / (bad + good) >= PRECISION))
        return found.select("entry")

    whole = cut(chosen(each), "insults")
    # Beginnings must earn their place with words that are no entries yet.
    rest = each.join(F.broadcast(whole), "entry", "left_anti")
    begins = F.array_compact(F.array(*[F.when(F.length("entry") > k, F.substring("entry", 1, k)) for k in BEGINNINGS]))
    begins = chosen(rest.select("toxic", "after", F.explode(begins).alias("entry")).distinct())
    return [(r["entry"], False) for r in whole.collect()] + [(r["entry"], True) for r in begins.collect()]


def _grammar(entries, weights=None, bias=BIAS):
    beginnings = {}
    for letters, begins in entries:
        if begins:
            beginnings.setdefault(len(letters.encode()), []).append(letters)
    names = outputs()
    return Grammar(_hashes(x for x, begins in entries if not begins), {k: _hashes(v) for k, v in beginnings.items()},
                   names, np.array([prior_weight(o) for o in names]) if weights is None else weights, bias)


def regress(x, y, weight, prior, bias, strength=1.0, steps=100):
    """Weights and bias of a logistic regression whose weights are drawn to ``prior`` (Newton's method)."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    centre = np.append(prior, bias)
    pull = np.append(np.full(len(prior), strength), 1e-3)
    b = centre.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ b, -30, 30)))
        step = np.linalg.solve((x1 * (weight * p * (1 - p))[:, None]).T @ x1 + np.diag(pull) + 1e-9 * np.eye(len(b)),
                               x1.T @ (weight * (p - y)) + pull * (b - centre))
        b -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return np.maximum(b[:-1], 0), b[-1]


def fit(docs: DataFrame, labels: DataFrame, id="doc_id", text="text", label="toxic", max_rows=MAX_ROWS) -> Grammar:
    rows = sample(docs, labels, id, text, label, max_rows)
    grammar = _grammar(lexicon(rows))
    held = rows.sparkSession.sparkContext.broadcast(grammar.fields())
    fields = ", ".join(["toxic int", *[f"`{o}` double" for o in grammar.outputs]])

    def count(batches):
        own = Grammar(*held.value)
        for batch in blocks(batches, "text"):
            x = own.counts(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["toxic"], *[pa.array(c) for c in x.T]], ["toxic", *own.outputs])

    # Rows with equal counts are one row with their number; the sample bounds how many there are.
    seen = rows.mapInArrow(count, fields).groupBy("toxic", *[F.col(f"`{o}`") for o in grammar.outputs]).count().collect()
    y = np.array([r["toxic"] for r in seen], float)
    if len(set(y)) < 2:
        return grammar
    x = np.array([[r[o] for o in grammar.outputs] for r in seen], float)
    order = np.lexsort((*x.T, y))  # sums in one order, whatever the order of rows
    x, y, n = x[order], y[order], np.array([r["count"] for r in seen], float)[order]
    n = n / np.where(y == 1, n[y == 1].sum(), n[y == 0].sum()) * n.sum() / 2  # classes of equal size
    grammar.weights, grammar.bias = regress(x, y, n, grammar.weights, grammar.bias)
    return grammar


def score(docs: DataFrame, grammar: Grammar, text="text", keep=("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with ``score`` and ``predicted``."""
    held = docs.sparkSession.sparkContext.broadcast(grammar.fields())
    kept = docs.select(*keep)
    names = [fresh(kept, n) for n in ("score", "predicted")]
    source = text if text in keep else fresh(kept, "text")

    def run(batches):
        own = Grammar(*held.value)
        for batch in blocks(batches, source):
            s = own.scores(batch[source])
            yield pa.RecordBatch.from_arrays([batch[c] for c in keep] + [pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*keep, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    read = kept if text in keep else docs.select(*keep, F.col(text).alias(source))
    return read.mapInArrow(run, f"{fields}, `{names[0]}` double, `{names[1]}` int")
