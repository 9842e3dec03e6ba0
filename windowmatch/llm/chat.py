"""Reply trees as conversations in a chat format.

A reply tree has one node per message, linked with the message it answers. Each path from a root to a
leaf is a branch; the best branches of a tree are formatted, one conversation each.

* **Paths.** A table gives every node the node some steps above it. Joined with itself it gives the node
  twice as many steps above: after k joins all nodes at most ``2 ** k`` deep know their depth and the
  score of their branch up to them. Only keys take part, no texts, and each round is written.
* **Branches.** Leaves are ranked by the sum of the scores on their path. The nodes of the chosen
  branches are enumerated from the same tables, half of the distances at a time; a tree with a single
  leaf is its own branch.
* **Format.** Texts are shuffled once, by tree, next to the places of their nodes; trees too
  large for one task are joined node by node instead.

The template is that of instruction-tuned models: ``<s>[INST] question [/INST] answer</s>``. Control strings
inside a text or a role get a backslash behind their first character, one more if there are some already,
so they are no control strings any more, and taking one away gives the text back. Other texts do not change.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowmatch.llm.shared import Staged

#: The strings that a text must not contain as they are.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYSTEM]", "[/SYSTEM]", "[ROLE]", "[/ROLE]")
START = "<s>"
#: What stands before and behind the text of a turn; any other role is named.
MARKS = {
    "system": ("[SYSTEM] ", " [/SYSTEM]"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": (" ", "</s>"),
}
ROLE, TEXT, END = "[ROLE] ", " [/ROLE] ", "</s>"
LEARNED = "assistant"

#: Nodes of a tree that one task takes together; a larger tree is dealt out node by node.
MOST_NODES = 10_000

_BODIES = "|".join(re.escape(c[1:]) for c in CONTROLS)
_RAW = re.compile(rf"([<\[])(\\*)(?={_BODIES})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_BODIES})")


def escape(text: str) -> str:
    return _RAW.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the places of the escaped texts that are learned."""
    parts, at, mask = [START], len(START), []
    for role, text in turns:
        before, behind = MARKS.get(role) or (f"{ROLE}{escape(role)}{TEXT}", END)
        body = escape(text)
        if role == LEARNED:
            mask.append((at + len(before), at + len(before) + len(body)))
        parts += before, body, behind
        at += len(before) + len(body) + len(behind)
    return "".join(parts), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], len(START)
    while at < len(formatted):
        role, before, behind = next(
            ((r, *m) for r, m in MARKS.items() if formatted.startswith(m[0], at)), (None, ROLE, END)
        )
        at += len(before)
        if role is None:
            stop = formatted.index(TEXT, at)
            role, at = unescape(formatted[at:stop]), stop + len(TEXT)
        stop = formatted.index(behind, at)
        turns.append((role, unescape(formatted[at:stop])))
        at = stop + len(behind)
    return turns


KEYS = ["tree", "node"]


def _raised(step: DataFrame) -> DataFrame:
    """From the table of ancestors some steps up, that of twice as many: tree, node, up, total, depth."""
    above = step.select(
        F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("over"),
        F.col("total").alias("more"), F.col("depth").alias("further"),
    )
    on = F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))
    higher = step.where("up IS NOT NULL").join(above, on).select(
        *KEYS, F.col("over").alias("up"), (F.col("total") + F.col("more")).alias("total"),
        (F.col("depth") + F.col("further")).alias("depth"),
    )
    return step.where("up IS NULL").unionByName(higher)


def _is_parent(links: DataFrame) -> DataFrame:
    return links.where("parent IS NOT NULL").select(F.col("tree").alias("t"), F.col("parent").alias("n")).distinct()


def branches(links: DataFrame, most: int | None = 1) -> DataFrame:
    """The nodes of the best branches of each tree: tree, rank (from 1 on), place (0 is the root), node.

    ``links``: tree, node, parent, score, each node of a tree once. A branch is better if the sum of its
    scores is larger, then if it is longer, then if its leaf is smaller; NULL scores count 0. A parent that
    is no node of the tree makes a root. Nodes on a cycle, and what hangs below them, are on no branch.
    ``most``: so many branches of each tree, None for all.
    """
    links = Staged(links.select(*KEYS, "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "links")
    own = links.frame
    nodes = own.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    on = F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n"))
    first = own.join(nodes, on, "left").select(
        *KEYS, F.col("n").alias("up"), F.col("score").alias("total"),
        F.when(F.col("n").isNotNull(), 1).otherwise(0).cast("long").alias("depth"),
    )
    steps = [Staged(first, "steps")]
    waiting = steps[-1].frame.where("up IS NOT NULL").count()
    while waiting:
        steps.append(Staged(_raised(steps[-1].frame), "steps"))
        left = steps[-1].frame.where("up IS NOT NULL").count()
        if left == waiting:
            # a tree has nodes of every depth up to its own: what never gets nearer to a root is cyclic
            break
        waiting = left
    ended = steps[-1].frame.where("up IS NULL").drop("up")
    on = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    leaves = ended.join(_is_parent(own), on, "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(best))
    ranked = Staged(ranked.where(F.col("rank") <= most) if most else ranked, "leaves")
    # the only leaf of a tree: all nodes are on its branch, at their depth
    alone = leaves.groupBy("tree").agg(F.count("*").alias("n")).where("n = 1").select(F.col("tree").alias("t"))
    alone = Staged(alone, "chains")
    same = F.col("tree").eqNullSafe(F.col("t"))
    whole = ended.join(alone.frame, same, "left_semi").select("tree", F.lit(1).alias("rank"), F.col("depth").alias("place"), "node")
    several = ranked.frame.join(alone.frame, same, "left_anti")
    found = Staged(several.select("tree", "rank", F.col("depth").alias("place"), "node"), "found")
    if found.frame.limit(1).count():
        for k, step in enumerate(steps[:-1]):
            up = step.frame.where("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
            own_place, higher = F.struct("place", "node"), F.struct((F.col("place") - 2**k).alias("place"), F.col("up").alias("node"))
            both = F.when(F.col("up").isNull(), F.array(own_place)).otherwise(F.array(own_place, higher))
            wider = found.frame.join(up, on, "left").select("tree", "rank", F.explode(both).alias("on")).select("tree", "rank", "on.*")
            found, before = Staged(wider, "found"), found
            before.drop()
    result = Staged(whole.unionByName(found.frame), "branches")
    for used in (links, ranked, alone, found, *steps):
        used.drop()
    return result.frame


FORMATTED = "struct<formatted: string, mask: array<struct<start: int, end: int>>>"


def _formatted(turns: Column) -> Column:
    """Text and mask of an array of turns (place, role, text) in order."""

    @F.arrow_udf(FORMATTED)
    def build(lists: pa.Array) -> pa.Array:
        made = (format_turns([(t["role"], t["text"]) for t in turns]) for turns in lists.to_pylist())
        rows = [{"formatted": text, "mask": [{"start": s, "end": e} for s, e in mask]} for text, mask in made]
        kind = pa.struct(
            [("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        )
        return pa.array(rows, kind)

    return build(turns)


def format_branches(chosen: DataFrame, texts: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """One row per branch: tree, rank, formatted, mask (start and end of each learned text).

    ``chosen``: tree, rank, place, node, as ``branches`` gives them. ``texts``: tree, node, role, text; a
    NULL role or text is empty, of several texts of a node one counts. A conversation is one value, so its
    turns come together in one task; nothing else of a tree does.
    """
    texts = texts.select(*KEYS, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    large = chosen.groupBy("tree").agg(F.count("*").alias("n")).where(F.col("n") > most_nodes)
    large = Staged(large.select(F.col("tree").alias("t")), "large")
    same = F.col("tree").eqNullSafe(F.col("t"))
    if large.frame.limit(1).count():
        far, on = large.frame, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
        some = texts.join(far, same, "left_semi").dropDuplicates(KEYS).withColumnsRenamed({"tree": "t", "node": "n"})
        dealt = chosen.join(far, same, "left_semi").join(some, on).select("tree", "rank", "place", "role", "text")
        chosen, texts = chosen.join(far, same, "left_anti"), texts.join(far, same, "left_anti")
    else:
        dealt = None
    # a text and the places of its node meet in the partition of their tree, which the groups keep
    told = texts.select(*KEYS, F.struct("role", "text").alias("turn"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("long").alias("place"))
    places = chosen.select(*KEYS, F.lit(None).cast(told.schema["turn"].dataType).alias("turn"), "rank", "place")
    together = told.unionByName(places).repartition("tree")
    node = Window.partitionBy(*KEYS).orderBy(F.col("turn").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = together.withColumn("turn", F.first("turn", ignorenulls=True).over(node)).where("rank IS NOT NULL")
    placed = placed.where("turn IS NOT NULL").select("tree", "rank", "place", "turn.role", "turn.text")
    turns = F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns")
    found = placed.groupBy("tree", "rank").agg(turns)
    if dealt is not None:
        found = found.unionByName(dealt.groupBy("tree", "rank").agg(turns))
    return found.select("tree", "rank", _formatted(F.col("turns")).alias("made")).select("tree", "rank", "made.*")


def format_trees(
    messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role",
    text: str = "text", score: str | None = None, most: int | None = 1,
) -> DataFrame:
    """The best branches of the reply trees in ``messages``, as ``format_branches`` gives them.

    Rows without a node are left out; repeated rows of a node count once, and of different ones the one
    with the smallest parent and greatest score links it. NULL is a tree like any other. An empty
    table gives an empty result; columns that are not named are not read.
    """
    named = messages.where(F.col(f"`{node}`").isNotNull())
    rated = F.col(f"`{score}`").cast("double") if score else F.lit(0.0)
    keys = [F.col(f"`{tree}`").alias("tree"), F.col(f"`{node}`").alias("node")]
    links = named.select(*keys, F.col(f"`{parent}`").alias("parent"), rated.alias("score"))
    links = links.groupBy(*KEYS).agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    texts = named.select(*keys, F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    return format_branches(branches(links, most), texts)


def format_threads(rows: DataFrame, thread: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One formatted conversation per thread, whose rows follow each other by turn: chains as trees.

    Rows of one turn are ordered by a hash of role and text, a NULL turn comes first, repeated rows are
    turns of their own. NULL is a thread like any other; a NULL role or text is empty.
    """
    keys = [F.col(f"`{thread}`").alias("tree"), F.col(f"`{turn}`").alias("turn")]
    told = rows.select(*keys, F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    told = told.withColumn("hash", F.xxhash64("role", "text"))
    # copies of a row are one row until they are numbered
    each = told.groupBy("tree", "turn", "hash").agg(F.count("*").alias("n"))
    each = each.select("tree", "turn", "hash", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    order = Window.partitionBy("tree").orderBy("turn", "hash", "copy")
    chain = each.withColumn("place", F.row_number().over(order).cast("long"))
    chain = Staged(chain.drop("copy"), "chain")
    parent = F.when(F.col("place") > 1, F.col("place") - 1)
    links = chain.frame.select("tree", F.col("place").alias("node"), parent.alias("parent"), F.lit(0.0).alias("score"))
    chosen = branches(links).withColumnsRenamed({"tree": "t", "place": "at"})
    on = F.col("tree").eqNullSafe(F.col("t")) & (F.col("place") == F.col("node"))
    key = F.struct("turn", "hash").alias("node")
    of = chain.frame.join(chosen, on).select("tree", "rank", F.col("at").alias("place"), key)
    return format_branches(of, told.select("tree", key, "role", "text"))


DIGESTS = "struct<n_turns: long, turns_sha256: string, loss_chars: long, loss_sha256: string, formatted_chars: long>"


def read_back(formatted: Column, mask: Column) -> Column:
    """What a formatted conversation and its mask hold: turns, their digest, the learned text and its digest."""

    @F.arrow_udf(DIGESTS)
    def read(texts: pa.Array, masks: pa.Array) -> pa.Array:
        out = []
        for text, places in zip(texts.to_pylist(), masks.to_pylist()):
            turns = parse_turns(text)
            learned = "".join(unescape(text[p["start"] : p["end"]]) for p in places)
            out.append(
                {
                    "n_turns": len(turns),
                    "turns_sha256": sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                    "loss_chars": len(learned),
                    "loss_sha256": sha256(learned.encode()).hexdigest(),
                    "formatted_chars": len(text),
                }
            )
        kind = pa.struct(
            [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        )
        return pa.array(out, kind)

    return read(formatted, mask)
