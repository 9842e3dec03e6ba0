import math
import random
from collections import Counter

import cases
import numpy as np
import pytest

from windowmatch.llm import pq_dedup, suffix_tree
from windowmatch.llm.shared import table

SF = "/root/testdata/sf0.01"

# Suffix tree


def words(text):
    return (text or "").encode().lower().split() + [b""]


def corpus():
    rng = random.Random(2)
    names = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(300):
        text, at = [], rng.choice(names)
        for _ in range(rng.randint(0, 40)):
            text.append(at)
            at = names[(names.index(at) * 7 + 3) % 30] if rng.random() < 0.6 else rng.choice(names)
            if len(text) > 1 and text[-2:] == ["w3", "w24"]:
                at = "w5"
        texts.append(" ".join(text))
    return texts + [None, "", "a rare word"]


def reference_tree(texts):
    """The tree of the definition, by dictionaries: log probability of a token after its context."""
    grams = [Counter(), Counter(), Counter()]
    for text in texts:
        w = words(text)
        for n in (1, 2, 3):
            grams[n - 1].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total, size = sum(grams[0].values()), len(grams[0])
    kept = [{g: c for g, c in grams[0].items() if c >= suffix_tree.LEAST_WORD}]
    for n in (1, 2):
        kept.append({g: c for g, c in grams[n].items() if c >= suffix_tree.LEAST_GRAM and g[:-1] in kept[n - 1] and g[1:] in kept[n - 1]})
    states = {}

    def log_p(context, word):
        while context and context not in states:
            context = context[1:]
        if not context:
            return math.log((grams[0].get((word,), 0) + 0.5) / (total + 0.5 * (size + 1)))
        explicit, weight = states[context]
        return explicit[word] if word in explicit else weight + log_p(context[1:], word)

    for n in (1, 2):
        for context in kept[n - 1]:
            if len(context) != n:
                continue
            count = kept[n - 1][context]
            after = {g[-1]: c for g, c in kept[n].items() if g[:-1] == context}
            explicit = {}
            for w, c in after.items():
                own = math.log((c - suffix_tree.DISCOUNT) / count)
                if c * (own - log_p(context[1:], w)) >= suffix_tree.GAIN:
                    explicit[w] = own
            if not explicit:
                continue
            weight = math.log((1 - sum(map(math.exp, explicit.values()))) / (1 - sum(math.exp(log_p(context[1:], w)) for w in explicit)))
            ratio = sum(after[w] * (own - log_p(context[1:], w)) for w, own in explicit.items())
            if ratio + (count - sum(after[w] for w in explicit)) * weight >= suffix_tree.DIVERGENCE:
                states[context] = (explicit, weight)
    return grams[0], log_p, states


@pytest.mark.parametrize("largest", [suffix_tree.LARGEST, 10, 0])
def test_scores_equal_the_definition(spark, monkeypatch, largest):
    """Broadcast, too large at a later level, and too large at once."""
    monkeypatch.setattr(suffix_tree, "LARGEST", largest)
    monkeypatch.setattr(suffix_tree, "BLOCK", 2_000)
    texts = corpus()
    counts, log_p, states = reference_tree(texts)
    assert {len(s) for s in states} == {1, 2}
    learned = spark.createDataFrame([(None if t is None else bytearray(t.encode()),) for t in texts], "text binary")
    tree, words_table = suffix_tree.train(learned)
    assert isinstance(tree, suffix_tree.Tree) == (largest > 10)
    docs = spark.createDataFrame(list(enumerate([*texts, "w3 w24 w5 unknown w7", "Unknown THINGS"])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_tree.score(docs, tree, words_table.frame).collect()}
    total, size = sum(counts.values()), len(counts)
    for r in docs.collect():
        w = words(r["text"])
        row = got[r["doc_id"]]
        base = sum(math.log10((counts.get((x,), 0) + 0.5) / (total + 0.5 * (size + 1))) for x in w)
        want = sum(log_p(tuple(w[max(0, i - 2) : i]), x) for i, x in enumerate(w)) / math.log(10)
        assert row["n_tokens"] == len(w) and row["n_known"] == sum((x,) in counts for x in w) and row["train_tokens"] == total
        assert math.isclose(row["base_score"], base, rel_tol=1e-9) and math.isclose(row["score"], want, rel_tol=1e-9)
    # a distribution over all words and one unknown word, after any context
    for context in [(), *list(states)[:5]]:
        mass = sum(math.exp(log_p(context, w)) for (w,) in counts) + math.exp(log_p(context, b"?"))
        assert math.isclose(mass, 1, rel_tol=1e-9)


@pytest.mark.parametrize("largest", [0, 31])
def test_slices_give_the_scores_of_the_tree(spark, monkeypatch, largest):
    """Levels of many slices, too large at once and when symbols and pairs are counted already; texts and
    n-grams stay in their tasks."""
    texts = corpus()
    learned = spark.createDataFrame([(None if t is None else bytearray(t.encode()),) for t in texts], "text binary")
    docs = spark.createDataFrame(list(enumerate([*texts, "w3 w24 w5 unknown w7", "Unknown THINGS"])), "doc_id long, text string")
    tree, counts = suffix_tree.train(learned)
    assert isinstance(tree, suffix_tree.Tree) and len(tree.levels[0].keys) == 31 < len(tree.levels[1].keys)
    want = {r["doc_id"]: r for r in suffix_tree.score(docs, tree, counts.frame).collect()}
    for name, value in (("LARGEST", largest), ("SLICE", 7), ("WIDE", 500)):
        monkeypatch.setattr(suffix_tree, name, value)
    sliced, counts = suffix_tree.train(learned)
    assert not isinstance(sliced, suffix_tree.Tree) and all(len(level) > 1 for level in sliced.levels)
    found = suffix_tree.score(docs, sliced, counts.frame)
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: r for r in found.collect()}
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert got[i][1:4] == row[1:4]
        assert math.isclose(got[i]["base_score"], row["base_score"], rel_tol=1e-9) and math.isclose(got[i]["score"], row["score"], rel_tol=1e-9)


def test_held_out_text_gains(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    seen = docs.where("doc_id % 5 <> 1").selectExpr("CAST(text AS BINARY) AS text")
    tree, counts = suffix_tree.train(seen)
    row = suffix_tree.score(docs.where("doc_id % 5 = 1"), tree, counts.frame).selectExpr("sum(score)", "sum(base_score)").first()
    assert row[0] > row[1] + 0.02 * abs(row[1])


@pytest.mark.parametrize("largest", [suffix_tree.LARGEST, -1])
def test_scores_of_defined_cases(spark, monkeypatch, largest):
    monkeypatch.setattr(suffix_tree, "LARGEST", largest)
    docs = cases.documents(spark)
    tree, counts = suffix_tree.train(docs.selectExpr("CAST(text AS BINARY) AS text"))
    got = suffix_tree.score(docs, tree, counts.frame).collect()
    assert sorted(repr((r["doc_id"], r["n_tokens"])) for r in got) == sorted(repr((i, len(words(t)))) for i, t, _ in cases.TEXTS)
    assert suffix_tree.score(cases.empty(spark), tree, counts.frame).count() == 0
    nothing, none = suffix_tree.train(cases.empty(spark).selectExpr("CAST(text AS BINARY) AS text"))
    assert {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in suffix_tree.score(docs, nothing, none.frame).collect()} == {(0, 0, 0.0, 0.0)}


# Embeddings


def brute_force(rows):
    able = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        able[i, label, tuple(v)] = np.array(v, float) / np.linalg.norm(v)
    links = []
    keys = list(able)
    for label in {k[1] for k in keys}:
        mine = [k for k in keys if k[1] == label]
        size = max(len(k[2]) for k in keys)
        for a, k in enumerate(mine):
            for m in mine[a + 1 :]:
                same = k[2] == m[2]
                if same or len(k[2]) == len(m[2]) == size and able[k] @ able[m] >= pq_dedup.LEAST:
                    links.append((k[0], m[0]))
    return links


def clusters(seed, n, spread, size=24):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            v = np.array(rows[int(rng.integers(len(rows)))][1]) + rng.normal(size=size) * spread
        else:
            v = rng.normal(size=size)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    rows += [(n + i, rows[5][1], rows[5][2]) for i in range(40)]
    return rows


@pytest.mark.parametrize(("seed", "spread"), [(1, 0.05), (2, 0.2), (3, 0.3)])
def test_recall_and_precision_against_brute_force(spark, seed, spread):
    rows = clusters(seed, 700, spread)
    links = brute_force(rows)
    counts = Counter(x for link in links for x in link)
    got = {r["vec_id"]: r for r in pq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert set(got) == {r[0] for r in rows}
    assert all(got[i]["n_links"] <= counts[i] for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(counts.values())
    roots = cases.union_find(list(got), links)
    assert all(roots[r["component_id"]] == roots[i] and r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "BLOCK", 50)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in centre + 0.02 * rng.normal(size=16)], 1) for i in range(400)]
    got = pq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(399, 0)}


def test_embeddings_of_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0),
        (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [None, 1.0], 0), (9, [], 0), (None, [1.0, 0.0], 0), (10, [1.0], 0),
        (11, [1.0], 0), (12, [1.0, 0.0], 1), (13, [-1.0, 0.0], 0), (14, [1.0, 0.1], 0),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, rep string, n int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pq_dedup.near_duplicates(frame).collect()), key=repr)
    linked = {1: (2, 1, True), 2: (2, 1, False), 14: (2, 1, False), 10: (1, 10, True), 11: (1, 10, False)}
    want = [(i, *linked.get(i, (0, i, True))) for i, _, _ in rows]
    assert got == sorted(want, key=repr)
    assert pq_dedup.near_duplicates(frame.where("false")).count() == 0
    assert pq_dedup.near_duplicates(frame.where("vec_id = 4")).count() == 1


def test_vectors_of_every_length_are_searched(spark):
    rows = clusters(4, 700, 0.05)
    rows += [(1000 + i, v, label) for i, v, label in clusters(5, 600, 0.05, 16)]
    rows += [(2000 + i, v, label) for i, v, label in clusters(6, 60, 0.05, 8)] + [(3000, [1.0] * 30, 1)]
    counts = Counter(x for n in (24, 16, 8, 30) for link in brute_force([r for r in rows if len(r[1]) == n]) for x in link)
    got = {r["vec_id"]: r["n_links"] for r in pq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert all(n <= counts[i] for i, n in got.items())
    for low in (0, 1000, 2000):
        mine = [i for i in got if low <= i < low + 1000]
        assert sum(got[i] for i in mine) >= 0.9 * sum(counts[i] for i in mine) > 0
    assert all(got[i] == counts[i] for i in got if i >= 2000)


def test_links_do_not_depend_on_the_lengths_of_vectors(spark):
    lengths = [1e-200, 1e200, 1.0, 5e-320, 1e-160]
    rows = [(i, [n, n * 0.05], "a") for i, n in enumerate(lengths)] + [(9, [1e200, 1e200], "a"), (10, [1.0, 0.05], "b")]
    got = {r["vec_id"]: r for r in pq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert [got[i]["n_links"] for i in range(5)] == [4] * 5 and got[4]["component_id"] == 0
    assert got[9]["n_links"] == got[10]["n_links"] == 0
