"""The whole job where a shortcut once cut it: against brute force or an uncut run."""

import random

import numpy as np
from biblion.llm import crf_langid, decontaminate, fingerprints, setsketch, suffix_dedup


def test_repeats_across_a_seam_of_two_earlier_documents(spark):
    """Windows over the seam of P+L and L+Q occur first in P+L+Q, whose contexts are all covered."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for k in range(40):
        p, line, q = text(400), text(60 + k), text(400)
        side = (100 - len(line)) // 2
        quote = p[len(p) - side :] + line + q[: 100 - side - len(line)]
        rows += [(4 * k + i, t) for i, t in enumerate((p + line, line + q, p + line + q, text(200) + quote + text(200)))]
    seen: set[str] = set()
    want = {}
    for i, t in rows:
        gone = set()
        for a in range(len(t) - 99):
            if (w := t[a : a + 100]) in seen:
                gone.update(range(a, a + 100))
            seen.add(w)
        want[i] = len(gone)
    assert all(want[4 * k + 3] >= 100 for k in range(40))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.digest(suffix_dedup.repeated_spans(docs)).collect()}
    assert got == want


ITEMS = "item_id long, text string"
WORDS = [f"w{i}" for i in range(200)]


def run_of(a, b):
    return " ".join(WORDS[a:b])


def test_slices_keep_rows_apart(spark):
    """Repeated and null doc_ids: one row out per row in, however many slices."""
    items = spark.createDataFrame([(1, run_of(0, 12)), (2, run_of(20, 32)), (3, run_of(40, 44))], ITEMS)
    rows = [(1, f"x {run_of(0, 12)} y"), (1, f"x {run_of(20, 32)}"), (1, "clean"), (None, run_of(0, 12)), (None, f"a b {run_of(40, 44)}"), (None, None), (2, f"{run_of(0, 12)} {run_of(20, 32)}"), (2, f"{run_of(0, 12)} {run_of(20, 32)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted(map(str, decontaminate.digest(decontaminate.contamination(docs, items, max_windows=m)).collect())) for m in (1000, 1))
    assert len(one) == len(rows) and many == one


def test_slices_cut_once_on_the_text_as_given(spark):
    """Overlapping items, words that meet only over a cut, and a share that two slices reach together."""
    items = spark.createDataFrame([(1, run_of(0, 12)), (2, run_of(8, 22)), (3, run_of(60, 64) + " " + run_of(70, 76)), (4, run_of(100, 110))], ITEMS)
    rest = run_of(120, 160)
    rows = [
        (1, f"{rest} {run_of(0, 22)} end"),  # item 2 overlaps item 1
        (2, f"{rest} {run_of(60, 64)} {run_of(0, 12)} {run_of(70, 76)} end"),  # item 3 only once item 1 is cut
        (3, f"{run_of(0, 10)} {run_of(100, 110)} {run_of(120, 135)}"),  # 10 and 10 of 35 words
        (3, "clean Text"),
        (None, None),
        (None, f"{rest}, {run_of(0, 12)}."),
    ]
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    one, many = (sorted(map(str, decontaminate.remove_contamination(docs, items, max_windows=m).collect())) for m in (1000, 1))
    assert many == one and len(one) == 5
    assert any(run_of(70, 76) in r for r in one)


def test_long_documents_do_not_starve_a_rare_language(monkeypatch):
    assert (crf_langid.SAMPLE_ROWS, crf_langid.MAX_CHAINS) == (1500, 20_000)
    monkeypatch.setattr(crf_langid, "MAX_CHAINS", 60)
    rng = random.Random(1)
    texts = {k: [" ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n)) for n in sizes] for k, letters, sizes in (("a", "abcdef", [20_000] * 5), ("b", "uvwxyz", [10] * 3))}
    model = crf_langid.train([(k, t) for k, ts in texts.items() for t in ts], epochs=10)
    labelled = [x for x, _, _ in crf_langid.decide([t.encode() for t in texts["b"]], model)]
    assert labelled == ["b"] * 3


def test_each_row_keeps_a_chain():
    sizes, code = np.array([2000, 1, 300, 0, 1, 5]), np.array([0, 0, 0, 0, 1, 2])
    kept = crf_langid.chains_kept(sizes, code, 100)
    assert kept.sum() <= 100 and (kept[sizes > 0] >= 1).all() and kept.tolist()[3:] == [0, 1, 5]
    assert crf_langid.chains_kept(sizes, code, 3000).tolist() == sizes.tolist()
    assert crf_langid.chains_kept(sizes, code, 2).tolist() == [1, 1, 1, 0, 1, 1]


def test_stage_takes_five_words_at_four_fifths(spark):
    """A 200-word text with 44 words appended: 196 / 240 five-word shingles, 198 / 242 of three words."""
    words = [f"x{i}" for i in range(5000)]
    rows = [(2 * k + i, " ".join(words[300 * k : 300 * k + size])) for k in range(10) for i, size in enumerate((200, 244))]
    rows += [(100, " ".join(words[4000:4200])), (101, " ".join(words[4000:4255]))]  # 196 / 251: not near
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in setsketch.keep_one(docs).collect()) == [*range(0, 20, 2), 100, 101]
    assert setsketch.near_duplicates(docs).where("kept").count() == 22


def test_stage_links_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        base = [f"b{k // 20}_{i}" for i in range(120)]
        for _ in range(rng.randrange(7)):
            base[rng.randrange(120)] = f"e{rng.random()}"
        rows.append((k, " ".join(base)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
    least = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for small, few in ((24, 16_384), (1, 16_384), (1, 0)):
        monkeypatch.setattr(setsketch, "SMALL_BUCKET", small)
        monkeypatch.setattr(setsketch, "FEW_HOT", few)
        assert sorted(r["doc_id"] for r in setsketch.keep_one(docs).collect()) == sorted(set(least))


def test_sample_holds_every_language(spark):
    rows = [(i, f"lang{i % 250}", f"text {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = crf_langid.sample(docs, 1500)
    assert len({lang for lang, _ in got}) == 250 and len(got) == 1500
    assert len(crf_langid.sample(docs, 100)) == 100


def test_empty_sketches_of_unlike_texts(spark):
    docs = spark.createDataFrame([(i, f"short text {i // 2}") for i in range(80)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert any(rows[i]["fingerprint"] == rows[i - 1]["fingerprint"] == "" for i in range(2, 80, 2))
    assert [rows[i]["near_next"] for i in range(1, 80)] == [float(i % 2) for i in range(1, 80)]
