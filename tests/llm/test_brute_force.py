"""Models, sketches and counts against plain-Python versions."""

import hashlib
import importlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from biblion.llm import common, fingerprints, interpolated_lm, registry, setsketch, sharding, suffix_dedup, tally
from biblion.llm.components import components
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def brute_model(texts, training):
    """Scores of the interpolated model, from dictionaries of n-grams."""
    lm = interpolated_lm
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), "</s>"] for i, t in texts.items()}
    one, two, three = Counter(), Counter(), Counter()
    ends = sum(training(i) for i in tokens)
    for i, ws in tokens.items():
        if training(i):
            s = ["<s>", *ws]
            one.update(ws)
            two.update(zip(s, s[1:], strict=False))
            three.update(zip(s, s[1:], s[2:], strict=False))
    n, v = sum(one.values()), len(one)

    def counts(ws):
        s = ["<s>", *ws]
        out = []
        for k, w in enumerate(ws):
            pair = two[s[k], w]
            out.append((ends if not k else two[s[k - 1], s[k]], pair if not k else three[s[k - 1], s[k], w], ends if not k else one[s[k]], pair, one[w]))
        return np.array(out)

    left = np.concatenate([counts(ws) for i, ws in tokens.items() if training(i)]) - 1
    low = lm.learn_weights(Counter(lm._cell(left[:, 2], left[:, 3], left[:, 4] / max(n - 1, 1)).tolist()), 1 / (v + 1))
    under = lm.lower_order(low, left[:, 2], left[:, 3], left[:, 4], n - 1, v)
    top = lm.learn_weights(Counter(lm._cell(left[:, 0], left[:, 1], under).tolist()), None)[:, 0]
    out = {}
    for i, ws in tokens.items():
        x = counts(ws)
        t = top[lm.bucket_of(x[:, 0])]
        out[i] = np.log10(t * x[:, 1] / np.maximum(x[:, 0], 1) + (1 - t) * lm.lower_order(low, x[:, 2], x[:, 3], x[:, 4], n, v)).sum()
    return out


def test_lm_scores_equal_the_model(spark, texts, monkeypatch):
    want = brute_model(texts, lambda i: zlib.crc32(str(i).encode()) % 5 != 1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    training = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    for block, per_part, bucket in ((4 << 20, 4096, 8 << 20), (1 << 15, 2, 1 << 13)):  # one part, and many that fold first
        monkeypatch.setattr(interpolated_lm, "BLOCK_BYTES", block)
        monkeypatch.setattr(tally, "BLOCKS_PER_PART", per_part)
        got = {r["doc_id"]: r["score"] for r in interpolated_lm.score_documents(docs, training, bucket).collect()}
        assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_lm_weights_raise_the_likelihood():
    rng = np.random.default_rng(0)
    context = rng.integers(0, 30, 5000)
    count = np.minimum(rng.integers(0, 10, 5000), context)
    cells = Counter(interpolated_lm._cell(context, count, rng.random(5000)).tolist())

    def likelihood(w):
        total = 0.0
        for c, m in cells.items():
            b, high, low = c // (42 * 66), c // 66 % 42, c % 66
            total += m * math.log(max(w[b] @ [2.0 ** (-high / 2) if high < 41 else 0, 2.0 ** (-low / 2) if low < 65 else 0], 1e-300))
        return total

    scores = [likelihood(interpolated_lm.learn_weights(cells, None, rounds)) for rounds in (1, 3, 10, 60)]
    assert scores == sorted(scores)


def brute_sketch(text, scale):
    words = re.split(r"[ \t\n\x0B\f\r]+", text.lower().strip(" \t\n\x0B\f\r"))
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    out = set()
    for k in range(max(len(words) - 4, 1)):
        h = 42
        for x in hashes[k : k + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", x), h)
        h = h - (1 << 64) if h >> 63 else h
        if scale == 1 or h < -(1 << 63) + (1 << 64) // scale:
            out.add(h)
    return out


def test_fingerprints_and_likeness(spark, texts):
    out = {r["doc_id"]: r for r in registry.queries()["op7_fingerprints"](spark, SF).collect()}
    ids = sorted(texts, reverse=True)
    errors = []
    for k, i in enumerate(ids):
        a, b = texts[i], texts[ids[(k + 1) % len(ids)]]
        h = len(a) // 2
        edited = a[: len(a) - h] + b[:h]
        for other, print_, near in ((edited, "edited_fingerprint", "near_edited"), (b, None, "near_next")):
            s, t = brute_sketch(a, 4), brute_sketch(other, 4)
            if print_:
                assert out[i]["fingerprint"] == ".".join(f"{x & (1 << 64) - 1:X}" for x in sorted(s))
                assert out[i][print_] == ".".join(f"{x & (1 << 64) - 1:X}" for x in sorted(t))
            full = brute_sketch(a, 1), brute_sketch(other, 1)
            exact = len(full[0] & full[1]) / len(full[0] | full[1])
            want = exact if len(s | t) < fingerprints.LEAST_UNION else len(s & t) / len(s | t)
            assert math.isclose(out[i][near], want)
            errors.append(abs(want - exact))
    assert np.mean(errors) < 0.03


def test_short_texts_have_no_likeness_by_chance(spark):
    docs = spark.createDataFrame([(i, f"word{i} other{i}") for i in range(40)], "doc_id long, text string")
    assert max(r["near_next"] for r in fingerprints.edited_fingerprints(docs).collect()) == 0.0


def test_neighbours_of_ids_of_any_span(spark):
    ids = sorted({-(1 << 63), (1 << 63) - 1, 0, 5, -3, 1 << 62, 1 << 53, (1 << 53) + 1, *range(100, 250)})
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "n1"), (None, "n2"), (None, "n2")], "doc_id long, text string")
    got = {r["text"]: r["next_text"] for r in fingerprints.with_next(docs, rows_per_range=7).collect()}
    assert got == {f"t{i}": f"t{ids[k - 1]}" for k, i in enumerate(ids)} | {"n1": "n1", "n2": "n2"}


def test_sharding_table_by_brute_force(spark):
    """Turns taken one by one over whole permutations."""
    hash_ = lambda t: int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")
    names, size = sharding.SHARDS, sharding.TABLE_SIZE
    orders = [iter([(hash_(f"offset:{s}") + k * (hash_(f"step:{s}") % (size - 1) + 1)) % size for k in range(size)]) for s in names]
    table: dict[int, int] = {}
    while len(table) < size:
        for i, order in enumerate(orders):
            if len(table) < size:
                table[next(x for x in order if x not in table)] = i
    assert sharding.lookup_table(names) == [table[k] for k in range(size)]
    docs = spark.createDataFrame([(1, "x", 2, 3), (None, "y", 2, 3)], "doc_id long, shard string, _slot0 int, _shard0 int")
    out = sharding.assign_shards(docs).collect()
    assert [r["_slot0"] for r in out] == [2, 2] and {r["shard"] for r in out} <= set(names)


@pytest.mark.parametrize("held", [2_000_000, 20, 0])
def test_components_by_brute_force(spark, monkeypatch, held):
    """Settled in one task, in several chunks, or by the star steps."""
    monkeypatch.setattr(importlib.import_module("biblion.llm.components"), "CONTRACT_EDGES", held)
    monkeypatch.setattr(importlib.import_module("biblion.llm.components"), "CONTRACT_BYTES", 1 << 12 if held else 64)
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i + 1000, i + 1001) for i in range(40)]
    of: dict[int, int] = {}

    def root(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        of[max(x, y)] = min(x, y)
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == want


def thue_morse(k):
    s = "a"
    for _ in range(k):
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_unlike_words_of_equal_sums(spark):
    """A word and its complement: a polynomial modulo 2**64 cannot tell them apart."""
    swap = str.maketrans("ab", "ba")
    rows = [(2 * k + i, w) for k in range(9, 13) for i, w in enumerate((thue_morse(k), thue_morse(k).translate(swap)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["component_id"] == r["doc_id"] for r in setsketch.near_duplicates(docs).collect())
    scored = {r["doc_id"]: r["n_known"] for r in interpolated_lm.score_documents(docs, F.col("doc_id") % 2 == 0).collect()}
    assert [scored[i] for i, _ in rows] == [2, 1] * 4  # the end token is known


def test_links_are_confirmed_on_words(spark, monkeypatch):
    """With a hash that is the same for all words, only the words themselves can refuse a link."""
    docs = spark.createDataFrame([(i, " ".join(f"{chr(97 + i)}{k}" for k in range(6))) for i in range(4)], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")
    classes = spark.createDataFrame([(i, bytes([i]), (i, 0)) for i in range(4)], "rep long, set_hash binary, first struct<doc_id:long,text_key:long>")
    texts = spark.createDataFrame([(i, f"x y z {i // 3}".encode()) for i in range(4)], "rep long, value binary")
    monkeypatch.setattr(setsketch, "_members", lambda *_: texts)
    assert [tuple(r) for r in setsketch._verified(pairs, docs, classes, 85, 3).collect()] == [(0, 1)]


def test_tally_adds_up_in_any_number_of_parts(spark):
    rng = np.random.default_rng(5)
    blocks = {b: rng.choice(rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2) + np.uint64(1), 200) for b in range(3)}
    pool = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    blocks = {b: rng.choice(pool, 150) for b in range(12)}
    want = Counter(k for x in blocks.values() for k in x.tolist())
    for parts in (1, 5):
        keys = {b: tally.Keys(x, 7) for b, x in blocks.items()}
        rows = [r for b, k in keys.items() for r in k.requests(b, [np.bincount(k.place), np.ones(len(k))], parts)]
        found = tally.totals(spark.createDataFrame([tuple(bytes(c) if isinstance(c, bytes) else c for c in r) for r in rows], tally.REQUEST), 7, parts, 2).collect()
        for b, x in blocks.items():
            totals = keys[b].totals([r.asDict() for r in found if r["block_id"] == b], 2)
            assert [want[k] for k in x.tolist()] == totals[0][keys[b].place].tolist()
        assert sum(r["types"] for r in found) == sum(k >= 1 << 63 for k in want)


def brute_removed(rows):
    seen, out = set(), []
    for i, t in rows:
        gone = set()
        for a in range(len(t) - 99):
            if (w := t[a : a + 100]) in seen:
                gone.update(range(a, a + 100))
            seen.add(w)
        out.append((i, len(gone)))
    return out


def test_repeats_of_hot_strings(spark):
    """A common line, a common passage and whole copies, with every k-mer counted as hot or none."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    line, passage = text(60), text(260)
    rows = [(i, text(rng.randrange(0, 200)) + (line if i % 2 else passage) + text(rng.randrange(0, 200))) for i in range(60)]
    rows += [(60 + i, rows[i][1]) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (20_000, 30, 1):
        got = suffix_dedup.digest(suffix_dedup.repeated_spans(docs, hot_over=hot)).collect()
        assert sorted((r["doc_id"], r["n_removed"]) for r in got) == brute_removed(rows)


def test_anchors_of_a_long_text_do_not_depend_on_its_cuts(monkeypatch):
    rng = random.Random(2)
    data = [bytes(rng.choices(range(97, 110), k=n)) for n in (5000, 99, 100, 0, 1700)]
    whole = suffix_dedup.anchors(data)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 700)
    parts = suffix_dedup.anchors(data)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True)) and len(whole[0]) > 100


def test_word_hashes_follow_the_words():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcXYZé") for _ in range(n)) for n in (*range(1, 40), 255, 256, 257, 300, 5000)]
    batch = common.WordBatch([" ".join(words).encode(), " ".join(reversed(words)).encode()], common.SPACED)
    n = len(words)
    assert batch.hashes[:n].tolist() == batch.hashes[n:][::-1].tolist()
    assert len(set(batch.hashes.tolist())) == len({w.encode().lower() for w in words})
    assert batch.word(38) == words[38].encode().lower()


def test_word_hashes_tell_all_words_apart(spark):
    pairs = ["america. american", "persona, personal", "romania. romanian", "thinkin' thinking", "responsibiliwvcn responsibiliwvc."]
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r["text"]]
    digits = ["".join(p) for p in itertools.product("0189anz.", repeat=5)]
    words = sorted({w for t in (*pairs, *texts) for w in t.encode().lower().split()} | {f"abc{d}{t}".encode() for d in digits for t in ("", "longer-tail", ".onger-tail")})
    batch = common.WordBatch([b" ".join(words)], common.SPACED)
    for hashes in (batch.hashes, batch.other_hashes()):
        assert len(np.unique(hashes)) == len(words)


def test_words_that_used_to_collide(spark):
    rows = [(1, "in america. we trust in american we trust"), (2, " ".join(f"responsibiliwvcn w{i}" for i in range(3))), (3, " ".join(f"responsibiliwvc. w{i}" for i in range(3)))]
    found = {r["doc_id"]: r for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["n_shingles"] == 6 and all(r["kept"] for r in found.values())
    train, held = (next(i for i in range(1, 99) if (zlib.crc32(str(i).encode()) % 5 == 1) == out) for out in (False, True))
    docs = spark.createDataFrame([(train, "the america. thinkin' persona, x"), (held, "the american thinking personal y")], "doc_id long, text string")
    scored = {r["doc_id"]: r for r in interpolated_lm.score_documents(docs, common.crc_mod("doc_id", 5) != 1).collect()}
    assert scored[held]["n_known"] == 2 and scored[held]["n_tokens"] == 6
