from hashlib import sha256

import cases
import pytest
from pyspark.sql import functions as F

from windowmatch.llm import merkle


def h(*inputs):
    return sha256("".join(inputs).encode()).hexdigest()


def plain_leaf(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_tree(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 8]) for i in range(0, len(below), 8)])
    return levels


def plain_way(levels, at):
    way = []
    for nodes in levels[:-1]:
        run = range(at // 8 * 8, min(at // 8 * 8 + 8, len(nodes)))
        way.append((at - run.start, [nodes[i] for i in run if i != at]))
        at //= 8
    return way


def brute_force(rows, altered=lambda row: row["text"]):
    first = lambda v: (v is not None, v if v is not None else 0)
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row["lang"], []).append(row)
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        leaves = sorted((first(r["doc_id"]), plain_leaf(r, r["text"]), plain_leaf(r, altered(r)), r["doc_id"]) for r in by_lang[lang])
        trees.append((leaves, plain_tree([leaf[1] for leaf in leaves])))
    top = plain_tree([levels[-1][0] for _, levels in trees])
    out = []
    for i, (leaves, levels) in enumerate(trees):
        for at, (_, leaf, other, key) in enumerate(leaves):
            way = plain_way(levels, at) + plain_way(top, i)
            node = other
            for place, others in way:
                node = h(*others[:place], node, *others[place:])
            out.append((key, leaf, levels[-1][0], top[-1][0], h(*(d for _, others in way for d in others)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_proofs_equal_brute_force(spark, depth):
    rows = [(i, f"Text {i % 37} É", ["en", "de", None, "fr", "é"][0 if i < 700 else i % 5]) for i in range(1_100)]
    docs = cases.documents(spark, rows, partitions=5)
    text = F.when(F.col("doc_id") % 4 == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    changed = lambda r: "".join(c.lower() if c.isascii() else c for c in r["text"]) if r["doc_id"] % 4 == 0 else r["text"]
    got = found(merkle.prove(docs, text, depth=depth))
    assert got == brute_force(docs.collect(), changed)
    assert {r[0] for r in got if not r[-1]} == {i for i in range(1_100) if i % 4 == 0}


def test_odd_rows_equal_brute_force(spark):
    docs = cases.documents(spark)
    got = found(merkle.prove(docs, depth=1))
    assert got == brute_force(docs.collect()) and all(r[-1] for r in got)


def test_many_languages_and_single_leaves(spark):
    rows = [(i, "x", f"lang{i % 75}") for i in range(90)]
    docs = cases.documents(spark, rows)
    for depth in (1, 4):
        assert found(merkle.prove(docs, depth=depth)) == brute_force(docs.collect())
    one = cases.documents(spark, [(5, "only", "en")])
    row = merkle.prove(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == h()
    assert merkle.prove(cases.empty(spark)).collect() == []


def test_paths_lead_to_the_root(spark):
    docs = cases.documents(spark, [(i, f"t{i}", "en" if i % 3 else "de") for i in range(100)])
    for row in merkle.prove(docs, paths=True, depth=1).collect():
        way = [(step["at"], step["others"]) for step in row["path"]]
        assert merkle.fold(row["leaf"], way) == row["root"]
        assert merkle.fold(row["leaf"][::-1], way) != row["root"]


@pytest.mark.parametrize("first,last,size", [(0, 0, 1), (0, 7, 8), (5, 70, 600), (512, 575, 600), (0, 599, 600), (599, 599, 600)])
def test_missing_nodes_are_the_least_that_proofs_need(first, last, size):
    leaves = [h(str(i)) for i in range(size)]
    levels = plain_tree(leaves)
    needed = merkle.missing(first, last, size)
    known = merkle.derive(first, leaves[first : last + 1], size, {(lv, p): levels[lv][p] for lv, p in needed})
    for at in {first, last, (first + last) // 2}:
        assert known.siblings(at) == plain_way(levels, at)
    # none can be left out
    for gone in needed:
        with pytest.raises(KeyError):
            merkle.derive(first, leaves[first : last + 1], size, {(lv, p): levels[lv][p] for lv, p in needed if (lv, p) != gone})
