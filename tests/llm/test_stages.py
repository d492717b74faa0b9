"""Each stage of the pipeline against a brute-force version on the same input."""

import hashlib
import math
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from biblion.llm import crf_langid

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """The small table with near copies, shared passages, benchmark passages and odd rows."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in table.collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 150").first()["text"]
    rng = random.Random(4)
    long = [r for r in rows if r[1] and len(r[1].split()) > 200][:6]
    top = max(r[0] for r in rows)
    extra = []
    for k, r in enumerate(long):
        words = r[1].split(" ")
        words[rng.randrange(len(words))] = "änderung"
        extra.append((top + 1 + 4 * k, " ".join(words), *r[2:]))
        extra.append((top + 2 + 4 * k, f"Fresh start number {k}. " + r[1][200:700] + f" and an end {k} of its own.", *r[2:]))
        extra.append((top + 3 + 4 * k, f"{rng.random()} ".join(r[1].split(" ")[:120]) + " " + item, *r[2:]))
    extra += [(top + 90, None, "en", "s", 0), (top + 91, "12 34 ½ !!", "en", "s", 10), (7, "a text of another row of one id", "en", "s", 31), (None, "no id here at all", "en", "s", 17), rows[3], rows[3]]
    made = spark.createDataFrame(rows + extra, table.schema)
    path = str(tmp_path_factory.mktemp("stages") / "documents")
    made.write.parquet(path)
    return spark.read.parquet(path)


def of(frame):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in frame.collect())


def marginals(words, model):
    """Mean posteriors of one text, word by word in plain Python."""
    step, labels = model.step, len(model.languages)
    total = np.zeros(labels)
    for at in range(0, len(words), crf_langid.CHAIN):
        psi = [np.exp(e - e.max()) for e in (model.emissions([w])[0] for w in words[at : at + crf_langid.CHAIN])]
        forward = [psi[0]]
        for x in psi[1:]:
            forward.append((forward[-1] @ step) * x / forward[-1].sum())
        backward = np.ones(labels)
        for k in reversed(range(len(psi))):
            post = forward[k] * backward
            total += post / post.sum()
            backward = step @ (psi[k] * backward)
            backward /= backward.sum()
    return total / len(words)


def test_language_id(spark, docs, monkeypatch):
    kept = of(STAGES["language_id"](spark, docs, SF))
    model = crf_langid.train(crf_langid.sample(docs, crf_langid.SAMPLE_ROWS))
    want = []
    for r in docs.collect():
        text = (r["text"] or "").lower()
        words = re.findall(rb"[a-z\x80-\xff]+", text.encode())
        if any(c.isalpha() for c in text) and marginals(words, model).max() >= 0.3:
            want.append((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]))
    assert kept == sorted(want)


def test_near_dedup(spark, docs):
    rows = [(i, t) for i, t in of(docs)]
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", folded(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] >= 0 and rows[b][0] >= 0 and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    firsts = {}
    for k, (i, _) in enumerate(rows):
        firsts.setdefault(root(k), []).append(i)
    kept = of(STAGES["near_dedup"](spark, docs, SF))
    assert sorted(i for i, _ in kept) == sorted(min(v) for v in firsts.values())
    assert len({root(rows.index(x)) for x in kept}) == len(kept)


def test_suffix_array_dedup(spark, docs):
    tie = lambda t: int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little")
    rows = sorted(((i, (t or "").encode()) for i, t in of(docs)), key=lambda r: (r[0], tie(r[1])))
    seen, want = set(), []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        if i >= 0:
            for a in range(len(t) - 99):
                if (w := t[a : a + 100]) in seen:
                    gone[a : a + 100] = True
                seen.add(w)
        left = bytes(x for x, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore") if gone.any() else t.decode()
        if left or not gone.any():
            want.append((i, left))
    assert of(STAGES["suffix_array_dedup"](spark, docs, SF)) == sorted(want)


def test_benchmark_decontamination(spark, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(folded(r["text"]))
        grams |= {tuple(w[k : k + 10]) for k in range(max(len(w) - 9, 1))} - {()}
    sizes = {len(g) for g in grams}
    want = []
    for i, t in of(docs):
        spans = [m.span() for m in word.finditer(folded(t))]
        w = [folded(t)[a:b] for a, b in spans]
        hit = np.zeros(len(w), bool)
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit[k : k + n] = True
        if hit.sum() > 0.5 * len(w):
            continue
        out, at = [], 0
        for k in np.flatnonzero(hit).tolist():
            if not k or not hit[k - 1]:
                out.append(t[at : spans[k][0]])
            at = spans[k][1]
        want.append((i, "".join([*out, t[at:]])))
    assert of(STAGES["benchmark_decontamination"](spark, docs, SF)) == sorted(want)


def test_best_fit_packing(spark, docs):
    from biblion.llm import packing
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.default_vocabulary())
    want = []
    for i, t in of(docs):
        n = len(exact.encode(t, add_special_tokens=False).ids) + 1
        cuts = [0, *range(n % 2048 or 2048, n + 1, 2048)]
        want += [(i, k, a, b - a) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows = STAGES["best_fit_packing"](spark, docs, SF).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"]) for r in rows) == sorted(want)
    bins = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert bins.get(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 2048 and len(bins) <= math.ceil(sum(w[3] for w in want) / 2048) + 1


def test_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    one, whole = corpus_pipeline.best_fit_packing(spark, docs, SF), corpus_pipeline.run(spark, SF)
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[c] for c in columns) for r in whole.collect()) == sorted(tuple(r[c] for c in columns) for r in one.collect())
