"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every 2- and 3-gram of their characters falls into one of ``BUCKETS`` columns. A model holds the
log-probability of each column per language and the log-prior. It is broadcast; a batch is scored as a sparse matrix (the
column of every n-gram, row by row) against each language's vector. The score is the posterior of the predicted language.

The model is fitted on a sample of the labelled rows of about ``MAX_CHARS`` characters, chosen by a hash of the text;
fewer are all taken. It has (languages x ``BUCKETS``) floats, for which ``MAX_LANGS`` is the bound. Only text and label are read.

Nulls and edges: null texts and texts without a letter are ``und`` with score 0, and so is everything if no labelled row is
there. Ties go to the language that sorts first. Rows repeat as often as they are given; no rows, no rows. Columns in
``keep`` pass through; new columns get underscores where a name is taken.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.llm.tables import fresh
from textkin.llm.words import blocks

BUCKETS = 1 << 16
SMOOTHING = 0.1
MAX_CHARS = 24_000_000
MAX_LANGS = 500
FIT_TASKS = 8
UNKNOWN = "und"

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _columns(texts):
    """Columns of the 2-grams and of the 3-grams of all texts, and per text the start of its row in either."""
    lowered = [t.lower() for t in texts]
    c = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in lowered])
    out = []
    for n in (2, 3):
        if len(c) < n:
            out.append((np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)))
            continue
        h = np.full(len(c) - n + 1, n, np.uint32)
        for i in range(n):
            h = (h ^ c[i:len(c) - n + 1 + i]) * _FACTORS[i]
            h ^= h >> np.uint32(15)
        within = np.ones(len(h), bool)  # n-grams that run into the next text go
        for back in range(1, n):
            at = ends[:-1] - back
            within[at[(at >= 0) & (at < len(h))]] = False
        rows = np.concatenate([[0], np.cumsum(within)])
        out.append((h[within] >> np.uint32(16), rows[np.minimum(np.concatenate([[0], ends]), len(h))]))
    return out


def _row_sums(values, rows):
    """Sum of each row's values; empty rows have 0."""
    sums = np.add.reduceat(np.append(values, 0), rows[:-1], dtype=np.float64) if len(rows) > 1 else np.empty(0)
    sums[rows[1:] == rows[:-1]] = 0
    return sums


@dataclass
class Model:
    langs: list
    weights: np.ndarray  # (languages, BUCKETS) log-probabilities
    prior: np.ndarray

    def posteriors(self, texts) -> np.ndarray:
        scores = np.tile(self.prior, (len(texts), 1))
        for columns, rows in _columns(texts):
            for k in range(len(self.langs)):
                scores[:, k] += _row_sums(np.take(self.weights[k], columns), rows)
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)


def _count(batches):
    counts, rows = {}, {}
    for batch in blocks(batches, "text"):
        texts, labels = batch["text"].to_pylist(), batch["label"].to_pylist()
        for lang in set(labels):
            own = [t for t, x in zip(texts, labels) if x == lang]
            total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for columns, _ in _columns(own):
                total += np.bincount(columns, minlength=BUCKETS)
            rows[lang] = rows.get(lang, 0) + len(own)
    for lang in counts:
        yield pa.RecordBatch.from_pydict({"lang": [lang], "n": [rows[lang]], "counts": [counts[lang].tobytes()]},
                                         pa.schema([("lang", pa.string()), ("n", pa.int64()), ("counts", pa.binary())]))


def _total(rows):
    counts = sum(np.frombuffer(x.as_buffer(), np.int64) for x in rows["counts"])
    return pa.table({"lang": rows["lang"].combine_chunks().slice(0, 1), "n": pa.array([sum(rows["n"].to_pylist())], pa.int64()),
                     "counts": pa.array([counts.tobytes()], pa.binary())})


def fit(labelled: DataFrame, text="text", label="lang", max_chars=MAX_CHARS) -> Model:
    """A model of the labels of ``labelled``; rows without text or label are left out."""
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where("text is not null and label is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > max_chars:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * max_chars / size))
    schema = "lang string, n long, counts binary"
    found = rows.repartition(FIT_TASKS).mapInArrow(_count, schema).groupBy("lang").applyInArrow(_total, schema)
    found = sorted(found.limit(MAX_LANGS + 1).collect())  # one row per language
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} labels")
    counts = np.stack([np.frombuffer(x["counts"], np.int64) for x in found]) if found else np.empty((0, BUCKETS))
    weights = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    n = np.array([x["n"] for x in found], float)
    return Model([x["lang"] for x in found], weights.astype(np.float32), np.log(n / n.sum()) if len(n) else n)


def predict(docs: DataFrame, model: Model, text="text", keep=("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with ``lang_pred`` and ``score``."""
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.prior))
    kept = docs.select(*keep)
    pred, score, source = fresh(kept, "lang_pred"), fresh(kept, "score"), text if text in keep else fresh(kept, "text")
    read = kept if text in keep else docs.select(*keep, F.col(text).alias(source))

    def run(batches):
        model = Model(*held.value)
        for batch in blocks(batches, source):
            texts = [t or "" for t in batch[source].to_pylist()]
            known = np.array([any(map(str.isalpha, t)) for t in texts], bool) & bool(model.langs)
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known.any():
                p = model.posteriors([texts[i] for i in np.flatnonzero(known)])
                scores[known] = p.max(axis=1)
                for i, k in zip(np.flatnonzero(known), p.argmax(axis=1)):
                    langs[i] = model.langs[k]
            yield pa.RecordBatch.from_arrays([batch[c] for c in keep] + [pa.array(langs), pa.array(scores)], [*keep, pred, score])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return read.mapInArrow(run, f"{fields}, `{pred}` string, `{score}` double")
