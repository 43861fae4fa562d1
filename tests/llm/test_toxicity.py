import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textkin.llm import toxicity
from textkin.llm.toxicity import _grammar, fit, outputs, score


def clause_outputs(text, insults=(("blorp", False),)):
    g = _grammar(insults)
    counts = g.counts(pa.array([text]))[0]
    return {o: int(n) for o, n in zip(g.outputs, counts) if n}


def test_the_composed_machine_marks_matches():
    assert clause_outputs("a Blorp, again blorp. blorp") == {"insult": 2, "pile": 1}
    assert clause_outputs("you are a blorp") == {"aimed insult": 1}
    assert clause_outputs("you are not really a blorp") == {"denied aimed insult": 1}
    assert clause_outputs("it is not in any way such a blorp") == {"insult": 1}
    assert clause_outputs("they said it is a blorp") == {"reported aimed insult": 1}
    assert clause_outputs("she said: it is no blorp") == {"reported denied insult": 1}
    assert clause_outputs("kill you") == {"aimed threat": 1} and clause_outputs("you they kill") == {"aimed threat": 1}
    assert clause_outputs("kill time") == {} and clause_outputs("nothing here") == {}
    assert clause_outputs("blorpy", [("blor", True)]) == {"insult": 1} and clause_outputs("blor", [("blor", True)]) == {}


KINDS = {"blorp": "insult", "kill": "threat", "you": "target", "not": "negation", "said": "report", "stone": "other"}


def by_hand(tokens):
    """The grammar's rules on one clause, each over the whole clause in turn."""
    kinds = [KINDS[t] for t in tokens]
    found, insults, targets, denied, reported = {}, 0, False, 0, False
    for i, kind in enumerate(kinds):
        match, seen = None, "target" in kinds[:i]
        if kind == "insult":
            match, insults = "pile" if insults else "insult", insults + 1
            match = f"aimed {match}" if targets else match
        elif kind == "threat" and seen or kind == "target" and not seen and i and kinds[i - 1] == "threat":
            match = "aimed threat"  # a threat without a target before it counts at one right after it
        targets = targets or kind == "target"
        if match:
            match = f"denied {match}" if denied else match
            match = f"reported {match}" if reported else match
            found[match] = found.get(match, 0) + 1
        denied = 3 if kind == "negation" else max(0, denied - 1)
        reported = reported or kind == "report"
    return found


def test_the_machine_follows_the_rules_on_random_clauses():
    rng = random.Random(5)
    for _ in range(1500):
        clauses = [rng.choices(list(KINDS), k=rng.randrange(1, 9)) for _ in range(rng.randrange(1, 4))]
        want = {}
        for c in clauses:
            for k, n in by_hand(c).items():
                want[k] = want.get(k, 0) + n
        text = rng.choice([". ", "! ", "\n", ";"]).join(" ".join(c) for c in clauses)
        assert clause_outputs(text) == want, text


def test_typographic_signs_separate_and_capitals_count():
    for text in ("you \u201cblorp\u201d", "you\u00a0blorp", "you \u2014blorp\u2014", "you\u2009blorp\u2026", "you \U0001f600blorp\U0001f600", "YOU BLORP"):
        assert clause_outputs(text) == {"aimed insult": 1}, text
    german = (("\u00e4rger", False),)
    for text in ("du \u00e4rger", "du \u00c4rger", "DU \u00c4RGER", "du \u201e\u00c4rger\u201c"):
        assert clause_outputs(text, german) == {"aimed insult": 1}, text
    assert clause_outputs("du \u0411\u041b\u041e", (("\u0431\u043b\u043e", False),)) == {"aimed insult": 1}
    assert clause_outputs("du b\u00e4rger", german) == {}


def test_letters_are_those_of_each_character():
    rng = random.Random(8)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x600), rng.randrange(0x2000, 0x2100), rng.randrange(0x10000, 0x10400)]))
                     for _ in range(200)) for _ in range(30)] + ["", "plain"]
    for text, got in zip(texts, toxicity.letters(pa.array([None, *texts]).slice(1)).to_pylist()):
        want = "".join(c if c < "\x80" else " " * len(c.encode()) if not c.isalpha()
                       else c.lower() if len(c.lower()) == 1 and len(c.lower().encode()) == len(c.encode()) else c for c in text)
        assert got == want


def test_entries_are_words_as_scores_see_them(spark):
    rows = [(1, " ".join(f"w{chr(97 + i)}q \u201c\u00c4rgerling\u201d." for i in range(6)))] * 3 + [(0, "calm words here")] * 3
    found = toxicity.lexicon(spark.createDataFrame(rows, "toxic int, text string"))
    assert ("\u00e4rgerling", False) in found


def test_held_out_labels_of_the_given_documents(spark):
    """Scores of the documents that are left out of learning rank toxic ones first."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    grammar = fit(docs, labels.where(~held))
    rows = score(docs.where(held), grammar).join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    bad, good = ([r.score for r in rows if r.toxic == t] for t in (1, 0))
    assert len(bad) > 20 and len(good) > 200
    auc = np.mean([(b > g) + (b == g) / 2 for b in bad for g in good])
    caught = np.mean([r.predicted for r in rows if r.toxic == 1])
    wrong = np.mean([r.predicted for r in rows if r.toxic == 0])
    assert auc > 0.9 and caught > 0.75 and wrong < 0.05


def test_marks_lower_or_raise_the_prior():
    w = dict(zip(outputs(), map(toxicity.prior_weight, outputs())))
    assert w["denied insult"] < w["insult"] < w["aimed insult"] and w["reported denied insult"] < w["reported insult"]


def labelled(n=120, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{rng.randrange(400)}x".replace("0", "o") for _ in range(60)]
        w = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 6))) for _ in w]
        bad = i % 3 == 0
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["blorp", "znargle"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_insults_are_learned_and_edges_defined(spark):
    rows, labels = labelled()
    rows += [(1000, None), (1001, ""), (None, "blorp znargle blorp you blorp"), (1002, "clean words " * 300_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    known = spark.createDataFrame(labels + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    grammar = fit(docs, known)
    out = score(docs, grammar, keep=("doc_id", "score"))
    assert out.columns == ["doc_id", "score", "score_", "predicted"]
    got = {r.doc_id: r.predicted for r in out.collect()}
    assert [got[i] for i, _ in labels] == [x for _, x in labels]
    assert got[1000] == got[1001] == got[1002] == 0 and got[None] == 1
    assert score(docs.limit(0), grammar).collect() == []


def test_without_labels_the_prior_holds(spark):
    docs = spark.createDataFrame([(1, "kill you " * 3), (2, "fine")], "doc_id long, text string")
    grammar = fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.doc_id: r.predicted for r in score(docs, grammar).collect()} == {1: 1, 2: 0}


def test_regression_moves_from_the_prior_to_the_data():
    x = np.array([[0, 0], [1, 0], [0, 1], [2, 0]], float)
    w, b = toxicity.regress(x, np.array([0, 1, 0, 1.0]), np.full(4, 25.0), np.array([0.5, 0.5]), -1)
    assert w[0] > 2 and w[1] < 0.2 and b < -0.5
