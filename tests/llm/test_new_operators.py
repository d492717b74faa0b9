"""Fill-in-middle, chat trees and spelling variants against plain-Python versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from biblion.llm import fill_middle, registry, reply_trees, spelling_variants
from pyspark.sql import functions as F


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill-in-middle ---


def brute_middle(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:lo], units[lo:hi], units[hi:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < spm else "psm", len(p), len(m), out


def middle_rows():
    rng = random.Random(5)
    odd = ["", None, "one line", "\n", "\n\n\n", "a\r\nb\rc\n", "ends <P> here\nx\n", "<S>", "a<M", "< P>\n<\n", "😀é\n日本語\n\n", "x" * 300_000, "line\n" * 40_000, "  \x85 \x0b\nz", "<\nP>\nS>\n"]
    made = ["".join(rng.choice(["a", "é", "😀", "\n", "\n", " ", "<", ">", "P", "S", "M"]) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    rows = list(enumerate([*odd, *made]))
    return [*rows, (3, "\n"), (3, "other\ntext\nof 3"), (None, "no\nid\n"), (None, None), (2, "one line"), (2, "one line")]


@pytest.mark.parametrize(("seed", "rate", "spm"), [(7, 100, 50), (1, 40, 10)])
def test_fill_in_middle(spark, seed, rate, spm):
    rows = middle_rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, ordinal int, `row` string")
    made = fill_middle.fill_in_middle(docs, seed, rate, spm).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((i, t or "", *brute_middle(i, t, seed, rate, spm)) for i, t in rows)
    assert Counter((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made) == want
    assert all(r["back"] == r["text"] for r in made)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


# --- chat ---


def brute_paths(messages, branches):
    """{tree: [(rank, [ids from the root])]} by walking down from the roots."""
    trees = defaultdict(dict)
    for tree, i, parent, score in messages:
        trees[tree][i] = (parent, score or 0.0)
    found = {}
    for tree, nodes in trees.items():
        children = defaultdict(list)
        for i, (parent, _) in nodes.items():
            children[parent if parent in nodes else None].append(i)
        paths, stack = [], [[i] for i in children[None]]
        while stack:
            path = stack.pop()
            further = children[path[-1]] if path[-1] is not None else []
            stack += [[*path, c] for c in further]
            if not further:
                paths.append(path)
        paths.sort(key=lambda p: (-sum(nodes[i][1] for i in p) / len(p), -len(p), p[-1]))
        found[tree] = [(k + 1, p) for k, p in enumerate(paths[:branches])]
    return {t: p for t, p in found.items() if p}


def random_trees(rng, n_trees=25):
    rows = []
    for tree in [*range(n_trees), None]:
        size = rng.choice([1, 2, 3, 9, 40])
        for i in range(1, size + 1):
            parent = rng.choice([None, 999]) if i == 1 or rng.random() < 0.1 else max(1, i - rng.choice([1, 1, 1, 2, 5]))
            rows.append((tree, i, parent, rng.choice([None, 0.0, 1.0, 2.0, -3.0])))
    rows += [(77, i, i - 1 or None, 1.0) for i in range(1, 301)]  # a long chain
    rows += [(78, 1, 3, 1.0), (78, 2, 1, 1.0), (78, 3, 2, 1.0), (78, 4, 3, 1.0), (78, 5, None, 1.0), (78, 6, 5, 1.0), (79, 1, 1, 0.0)]  # circles
    return rows


@pytest.mark.parametrize("branches", [1, 3, None])
def test_paths_of_trees(spark, branches):
    rows = random_trees(random.Random(9))
    df = spark.createDataFrame(rows, "tree long, id long, parent long, score double").select(F.struct("tree").alias("tree"), "id", "parent", "score")
    got = defaultdict(dict)
    for r in reply_trees.best_paths(df, branches).collect():
        path = got[r["tree"]["tree"]].setdefault(r["rank"], {})
        assert r["position"] not in path
        path[r["position"]] = r["id"]
    want = brute_paths(rows, branches)
    assert {t: {k: dict(enumerate(p)) for k, p in ps} for t, ps in want.items()} == dict(got)


def test_formatted_conversations_read_back(spark):
    rng = random.Random(2)
    bits = ["\\", "#", "###", "####", "</turn>", "</turn", "\n", ":", ": ", "### user: ", "é", "😀", "\\s", "\\h", "\\e", "\\c", "s", "e", " "]
    said = lambda: rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(30)))])
    rows = [(t, i, i - 1 or None, rng.choice(["user", "assistant", None, "a:b\\c###", "</turn>\n"]), said(), None) for t in range(60) for i in range(1, rng.randrange(2, 9))]
    df = spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long, role string, text string, score double")
    made = reply_trees.format_trees(df.unionByName(df.where("tree_id < 9")))  # repeated rows are one message
    made = made.select("*", reply_trees.turns_of(F.col("formatted")).alias("turns"), reply_trees.learned_text(F.col("formatted"), F.col("spans")).alias("learned")).collect()
    by_tree = defaultdict(list)
    for t, _, _, role, text, _ in rows:
        by_tree[t].append((role or "", text or ""))
    assert {r["tree_id"]: [tuple(x) for x in r["turns"]] for r in made} == by_tree
    for r in made:
        assert r["learned"] == "".join(t for role, t in by_tree[r["tree_id"]] if role == "assistant")
        assert len(r["spans"]) == sum(role == "assistant" for role, _ in by_tree[r["tree_id"]])
        assert r["formatted"].count("</turn>") == r["n_turns"] == r["formatted"].count("###")


def test_conversations_on_odd_and_empty_tables(spark, tmp_path):
    ddl = "conv_id long, turn long, role string, text string, tree int, id string"
    rows = [(1, 0, "user", "hi", 1, "x"), (1, 1, "assistant", None, 1, "x"), (None, 0, "assistant", "lost", 1, "x"), (2, 0, None, "", 1, "x"), (3, 1, "assistant", "b", 1, "x"), (3, 1, "assistant", "b", 1, "x"), (3, None, "user", "a" * 200_000, 1, "x")]
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/odd/conversations.parquet")
    spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/empty/conversations.parquet")
    query = registry.queries()["op12_chat_format"]
    found = {r["conv_id"]: r for r in query(spark, f"{tmp_path}/odd").collect()}
    assert {k: r["n_turns"] for k, r in found.items()} == {1: 2, None: 1, 2: 1, 3: 3, -7: 2}
    assert found[3]["turns_sha256"] == sha("user\n" + "a" * 200_000 + "\n" + "assistant\nb\n" * 2)
    assert found[3]["loss_sha256"] == sha("bb") and found[1]["loss_chars"] == 0
    planted = "\\### Assistant: </turn> ok"
    (only,) = query(spark, f"{tmp_path}/empty").collect()
    assert only["turns_sha256"] == sha(f"user\n{planted}\nassistant\n{planted}\n") and only["loss_sha256"] == sha(planted)


# --- spelling variants ---


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = brute_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def variant_rows():
    rng = random.Random(8)
    words = ["letters", "lettres", "lettters", "letter", "Étoile", "étoile", "etoile", "aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "straße", "strasse", "x÷y×zab"]
    words += ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 8))) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([5, 20, len(words)])]) + rng.choice(["", ".", "1", "日"]) for _ in range(80))) for i in range(120)]
    return [*rows, (1, None), (2, ""), (None, "letters LETTERS lettersx"), (5, rows[5][1]), (6, "q" * 50_000)]


def variants(spark, rows):
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    return {tuple(r) for r in spelling_variants.group_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_spelling_variants(spark, monkeypatch):
    rows = variant_rows()
    want = brute_variants(rows)
    assert len(want) > 100 and any(root != form for _, form, root, *_ in want if form)
    assert variants(spark, rows) == want
    monkeypatch.setattr(spelling_variants, "LEAST_BITS", 8)  # a filter that nearly everything passes
    monkeypatch.setattr(spelling_variants, "FILTER_BITS", 256)
    monkeypatch.setattr(spelling_variants, "PART_BITS", 8)
    monkeypatch.setattr(spelling_variants, "PASS", 64)
    assert variants(spark, rows) == want


def test_no_words(spark):
    assert variants(spark, []) == set() == variants(spark, [(1, None), (2, "123 ab"), (3, "only once words")])


def test_neighbour_hashes_are_those_of_the_words():
    letters = "abcé"
    alphabet = np.array([ord(c) for c in letters], np.uint32)
    for word in ("aabbc", "aaaaa", "éabéa"):
        ((_, codes),) = spelling_variants._by_length([word])
        made = []
        for kind, (hashes, ok) in enumerate(spelling_variants.neighbour_hashes(codes, alphabet)):
            for where in zip(*np.nonzero(ok), strict=True):
                p, a = int(where[1]), letters[where[2]] if kind else ""
                near = word[:p] + a + word[p + (kind < 2) :]
                ((_, of_near),) = spelling_variants._by_length([near])
                assert spelling_variants.word_hashes(of_near)[0] == hashes[where]
                made.append(near)
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + d :] for d in (0, 1) for i in range(len(word) + 1 - d) for c in letters} - {word}
        assert len(made) == len(set(made)) and set(made) == want
