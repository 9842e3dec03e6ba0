import random
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from windowmatch.llm import chat

PIECES = st.sampled_from(["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<s>", "</s>", "[INST]", "[/ROLE]", " ", "a", "\n", "é", "]"])
TEXTS = st.lists(PIECES, max_size=12).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXTS), TEXTS), max_size=6))
def test_formatted_turns_are_read_back(turns):
    text, mask = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns
    assert [chat.unescape(text[s:e]) for s, e in mask] == [t for role, t in turns if role == "assistant"]


@given(TEXTS)
def test_escaped_texts_hold_no_control_string(text):
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)
    assert chat.unescape(chat.escape(text)) == text


def plain_branches(rows, most):
    """(tree, rank) -> the nodes from the root to the leaf."""
    trees = defaultdict(dict)
    for tree, node, parent, score in rows:
        trees[tree][node] = (parent, score or 0.0)
    out = {}
    for tree, nodes in trees.items():
        parents = {p for p, _ in nodes.values()}
        ways = []
        for leaf in nodes.keys() - parents:
            way, seen = [leaf], {leaf}
            while nodes[way[-1]][0] in nodes:
                way.append(nodes[way[-1]][0])
                if way[-1] in seen:
                    way = None
                    break
                seen.add(way[-1])
            if way:
                ways.append((-sum(nodes[n][1] for n in way), -len(way), leaf, way[::-1]))
        for rank, (*_, way) in enumerate(sorted(ways)[:most], 1):
            out[tree, rank] = way
    return out


def forest(seed, trees=12, nodes=40):
    rng = random.Random(seed)
    rows = []
    for tree in [None, *range(trees)]:
        size = 1 if tree == 0 else rng.randint(1, nodes)
        for n in range(size):
            # one tree is a chain, one a star, one has several roots and a parent that is no node
            parent = n - 1 if tree == 1 else 0 if tree == 2 else rng.choice([None, 999, *range(n)]) if tree == 3 else rng.randrange(n) if n else None
            parent = None if n == 0 else parent
            rows.append((tree, n, parent, rng.choice([None, 0.5, 1.0, -2.0])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, score double").repartition(5)


def nodes_of(found):
    out = defaultdict(list)
    for r in found.collect():
        out[r["tree"], r["rank"]].append((r["place"], r["node"]))
    assert all([p for p, _ in sorted(way)] == list(range(len(way))) for way in out.values())
    return {k: [n for _, n in sorted(way)] for k, way in out.items()}


@pytest.mark.parametrize("most", [1, 3, None])
def test_branches_equal_brute_force(spark, most):
    rows = forest(most or 0)
    assert nodes_of(chat.branches(frame(spark, rows), most)) == plain_branches(rows, most)


def test_cycles_are_on_no_branch(spark):
    rows = [(1, 1, 3, 1.0), (1, 2, 1, 1.0), (1, 3, 2, 1.0), (1, 4, 3, 9.0), (1, 5, None, 1.0), (1, 6, 5, 1.0), (2, 1, 1, 1.0)]
    rows += [(3, n, n - 1 if n else None, 1.0) for n in range(9)]
    assert nodes_of(chat.branches(frame(spark, rows), None)) == {(1, 1): [5, 6], (3, 1): list(range(9))}


@pytest.mark.parametrize("most_nodes", [chat.MOST_NODES, 5])
def test_formatted_trees_equal_brute_force(spark, most_nodes):
    rows = forest(5)
    told = {(t, n): (["user", "assistant", None, "tool"][n % 4], None if n % 7 == 3 else f"text {t} {n} [INST]") for t, n, _, _ in rows}
    texts = spark.createDataFrame([(t, n, *told[t, n]) for t, n, *_ in rows] * 2, "tree long, node long, role string, text string")
    got = chat.format_branches(chat.branches(frame(spark, rows), 2), texts, most_nodes).collect()
    want = plain_branches(rows, 2)
    assert len(got) == len(want)
    for r in got:
        turns = [tuple(v or "" for v in told[r["tree"], n]) for n in want[r["tree"], r["rank"]]]
        assert chat.parse_turns(r["formatted"]) == turns
        assert chat.format_turns(turns) == (r["formatted"], [tuple(m) for m in r["mask"]])


def test_format_trees_reads_named_columns_only(spark):
    rows = [("a", 1, None, "user", "q", 1.0, "x"), ("a", 2, 1, "assistant", "bad", 0.0, "x"), ("a", 3, 1, "assistant", "good", 5.0, "x"), ("a", None, 1, "user", "?", 1.0, "x")]
    names = "thread string, id long, parent long, role string, text string, score double, rank string"
    messages = spark.createDataFrame(rows + rows[:2], names)
    (row,) = chat.format_trees(messages, "thread", "id", score="score").collect()
    assert row["formatted"] == "<s>[INST] q [/INST] good</s>" and chat.parse_turns(row["formatted"])[1] == ("assistant", "good")
    empty = messages.where("false")
    assert chat.format_trees(empty, "thread", "id").collect() == []


def test_threads_with_nulls_ties_and_copies(spark):
    long = "word " * 50_000
    rows = [(1, 1, "user", "b"), (1, 0, "system", None), (1, 2, "assistant", long), (None, 5, None, "x"), (None, None, "user", "y")]
    rows += [(2, 3, "user", "same")] * 3 + [(3, n, "assistant" if n % 2 else "user", f"t{n}") for n in range(100)]
    table = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, node string")
    got = {r["tree"]: chat.parse_turns(r["formatted"]) for r in chat.format_threads(table).collect()}
    assert got[1] == [("system", ""), ("user", "b"), ("assistant", long)]
    assert got[None] == [("user", "y"), ("", "x")] and got[2] == [("user", "same")] * 3
    assert got[3] == [("assistant" if n % 2 else "user", f"t{n}") for n in range(100)] and len(got) == 4
    assert chat.format_threads(table.where("false")).collect() == []


def test_texts_are_shuffled_once(spark):
    table = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    found = chat.format_threads(table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    back = found.select(chat.read_back(F.col("formatted"), F.col("mask")).alias("b")).select("b.*").first()
    assert back["n_turns"] == 2 and back["loss_chars"] == 1
