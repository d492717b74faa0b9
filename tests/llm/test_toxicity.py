"""Toxicity scores against a plain reading of the grammar, by distances between words."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from biblion.llm import registry, toxicity

SF = "/root/testdata/sf0.01"


def classes(word, lexicon):
    """(class, lexicon weight) of a word: the lexicon first, then threats, reports, negations, targets."""
    weight = lexicon.words.get(word) or max((w for p, w in lexicon.prefixes.items() if word.startswith(p)), default=0.0)
    if weight:
        return "insult", weight
    named = [("threat", toxicity.THREATS), ("report", toxicity.REPORTS), ("negation", toxicity.NEGATIONS), ("target", toxicity.TARGETS)]
    return next((name for name, words in named if word.decode(errors="replace") in words), ""), 0.0


def clause_weight(words, lexicon):
    """Sum over the words of a clause, each judged by what stands before it."""
    kinds = [classes(w, lexicon) for w in words]

    def before(i, kind, most):
        return any(kinds[j][0] == kind for j in range(max(0, i - most - 1), i))

    total = 0.0
    for i, (kind, value) in enumerate(kinds):
        if (kind == "threat" and before(i, "target", 2)) or (kind == "target" and before(i, "threat", 2)):
            value = 2.0
        if kind == "insult" and before(i, "target", 1):
            value *= 1.25
        if before(i, "negation", 1):
            value /= 3
        if before(i, "report", len(words)):
            value /= 2
        total += value
    return total


def plain_score(text, model):
    low = text.lower().encode()
    scores = [clause_weight(re.findall(rb"[a-z\x80-\xff]+", c), model.lexicon) for c in re.split(rb"[.!?;:\n|]", low)]
    total, most, n = sum(scores), max(scores), len(re.findall(rb"[a-z\x80-\xff]+", low))
    x = [1.0, float(total > 0), math.log1p(total), math.log1p(most), math.log1p(100 * total / max(n, 1))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("crc32(cast(doc_id as string)) % 5 != 0")
    return toxicity.train(toxicity.sample(docs, seen, toxicity.SAMPLE_ROWS))


def test_scores_of_the_query(spark, model):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = registry.queries()["op5_toxicity"](spark, SF).collect()
    assert len(found) == len(texts) and len({round(r["score"], 6) for r in found}) > 20
    for r in found:
        assert math.isclose(r["score"], plain_score(texts[r["doc_id"]], model), rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_scores_of_made_clauses(model):
    rng = random.Random(5)
    lexicon = [w.decode() for w in model.lexicon.words] + [p.decode() + end for p in model.lexicon.prefixes for end in ("", "a", "xyz")]
    pools = [lexicon, toxicity.THREATS, toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTS, "time house rain the été 12".split()]
    texts = ["", "...", *("".join(rng.choice(rng.choice(pools)) + rng.choice([" ", " ", " ", ", ", ". ", "\n", "|"]) for _ in range(rng.randint(1, 60))) for _ in range(2000))]
    got = model.scores([t.lower().encode() for t in texts])
    assert np.allclose(got, [plain_score(t, model) for t in texts], rtol=1e-9, atol=0)


def test_lexicon_by_counting(spark, model):
    """Every learned word marks toxic documents by plain counts, and has more than one surrounding."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.sample(docs, labels.where("crc32(cast(doc_id as string)) % 5 != 0"), toxicity.SAMPLE_ROWS)
    sizes = [sum(t == k for _, t in rows) for k in (0, 1)]
    assert model.lexicon.words or model.lexicon.prefixes
    for table, is_in in ((model.lexicon.words, lambda t, w: w in t), (model.lexicon.prefixes, lambda t, w: any(x.startswith(w) and x != w for x in t))):
        for term, weight in table.items():
            docs_of = [sum(is_in(set(re.findall(rb"[a-z\x80-\xff]+", t.lower().encode())), term) for t, k in rows if k == kind) for kind in (0, 1)]
            odds = math.log((docs_of[1] + 0.5) / (sizes[1] + 1)) - math.log((docs_of[0] + 0.5) / (sizes[0] + 1))
            assert docs_of[1] >= toxicity.LEAST_DOCS and odds >= toxicity.LEAST_ODDS
            assert math.isclose(weight, min(odds, 6.0), rel_tol=1e-9)


def test_contradicting_labels_are_toxic(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    rows = [(0, 0), (0, 1), (1, 1), (1, 0), (2, 0), (2, 0), (3, 1), (4, None), (None, 1), (5, 7)]
    for part in (rows, rows[::-1]):
        labels = spark.createDataFrame(part, "doc_id long, toxic int")
        assert sorted(toxicity.sample(docs, labels, 100)) == [("text 0", 1), ("text 1", 1), ("text 2", 0), ("text 3", 1)]
