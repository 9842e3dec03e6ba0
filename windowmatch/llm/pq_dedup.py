"""Near-duplicate embeddings by product quantisation.

Vectors are compared by cosine within a label and number of components; every number of components
has its own quantiser; that of a number which few vectors have is fitted and searched within one task. Equal vectors are one class before anything is compared.
A coarse quantiser deals the classes into inverted lists; the residual of a vector to its centroid is
coded by the nearest codeword in each of ``SUBSPACES`` subspaces, and the norm of what the code misses
is kept. A vector probes the lists nearest to it. In a list, distances come from table lookups of its
codes (asymmetric: the query is not coded). A member is a candidate if that distance is at most the
radius of the wanted cosine plus the member's own coding error; by the triangle inequality this drops
no neighbour. Candidates are reranked by the exact cosine in double precision.

What can be missed is a neighbour in a list that is not probed from either side. Lists grow with the
square root of the table, but are no finer than the radius, so that dense groups stay whole; probes
grow with the lists. Tests measure the recall against brute force.

Lists are cut into blocks of at most about ``BLOCK`` members and queries, so that a list with a third
of all vectors is many tasks. A block returns one row per linked vector: how many vectors it links and
the smallest one it reaches within the block. No list of pairs is ever made.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowmatch.llm.components import components
from windowmatch.llm.shared import Staged, by_hash

LEAST = 0.93
SUBSPACES, CODEWORDS = 8, 256
#: Bound of the training sample, and iterations of k-means.
SAMPLE, ROUNDS = 20_000, 8
MOST_LISTS = 4096
#: Up to so many vectors of one number of components are one task instead of jobs of their own.
FEW = 256
BLOCK = 4096

_ROWS = "rep long, n long, label string, home int, probes array<int>, codes binary, error double, vector array<double>"
_FOUND = "rep long, root long, links long"


@dataclass(frozen=True)
class Quantiser:
    """Coarse centroids, codewords by subspace (subspace, codeword, component), probes of a query."""

    centroids: np.ndarray
    codewords: np.ndarray
    probes: int
    radius: float

    @property
    def size(self) -> int:
        return self.centroids.shape[1]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1), 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        nearest = _distances(x, centres).argmin(1)
        sizes = np.bincount(nearest, minlength=k)
        sums = np.stack([np.bincount(nearest, x[:, d], k) for d in range(x.shape[1])], 1)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _padded(x: np.ndarray) -> np.ndarray:
    """Zeros behind, so that the subspaces are equally wide; no distance changes."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % SUBSPACES)))


def fit(sample: np.ndarray, total: int, least: float = LEAST, seed: int = 5) -> Quantiser:
    """Train on normalised vectors; ``total`` is the number of vectors to be indexed."""
    rng = np.random.default_rng(seed)
    lists = int(min(MOST_LISTS, max(1, len(sample) // 16), max(16, np.sqrt(total) / 2)))
    x = _padded(sample)
    radius = float(np.sqrt(2 - 2 * least))
    centroids = _apart(_kmeans(x, lists, rng), radius)
    lists = len(centroids)
    residuals = x - centroids[_distances(x, centroids).argmin(1)]
    width = x.shape[1] // SUBSPACES
    words = min(CODEWORDS, len(x))
    codewords = np.stack([_kmeans(residuals[:, s * width : (s + 1) * width], words, rng) for s in range(SUBSPACES)])
    return Quantiser(centroids, codewords, max(8, lists // 8), radius)


def _apart(centroids: np.ndarray, least: float) -> np.ndarray:
    """Centroids without those nearer than ``least`` to one before: lists finer than the radius would
    part the vectors of a dense group, of which each links with all others."""
    near = _distances(centroids, centroids) < least**2
    kept: list[int] = []
    for i in range(len(centroids)):
        if not near[i, kept].any():
            kept.append(i)
    return centroids[kept]


def assign(model: Quantiser, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Home list, probed lists, codes and coding error of normalised vectors.

    A list is not probed if no vector within the radius can be in it: the query is farther than that
    from the plane that parts the list's cell from its home.
    """
    x = _padded(x)
    near = _distances(x, model.centroids)
    home = near.argmin(1)
    order = np.argpartition(near, min(model.probes, near.shape[1]) - 1, axis=1)[:, : model.probes]
    apart = np.sqrt(_distances(model.centroids, model.centroids))
    margin = np.take_along_axis(near, order, 1) - near.min(1)[:, None]
    reach = margin <= 2 * model.radius * apart[home[:, None], order] + 1e-9
    residual = x - model.centroids[home]
    width = x.shape[1] // SUBSPACES
    codes = np.empty((len(x), SUBSPACES), np.uint8)
    missed = np.zeros(len(x))
    for s in range(SUBSPACES):
        far = _distances(residual[:, s * width : (s + 1) * width], model.codewords[s])
        codes[:, s] = far.argmin(1)
        missed += far.min(1)
    return home, [o[r] for o, r in zip(order, reach)], codes, np.sqrt(missed)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1. The greatest component goes first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(1)[:, None]
    return scaled / np.sqrt((scaled**2).sum(1))[:, None]


def usable(vector: str, label: str):
    """The label is known and the vector is not NULL, not empty, finite in every component, not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(label).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


class _Block:
    """Linked vectors of one block: counts and the smallest vector reached."""

    def __init__(self, reps: np.ndarray):
        self.reps = np.unique(reps)
        self.links = np.zeros(len(self.reps), np.int64)
        self.roots = np.arange(len(self.reps))

    def place(self, reps: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.reps, reps)

    def link(self, one: int, others: np.ndarray) -> None:
        roots = np.unique(self.roots[np.append(others, one)])
        if len(roots) > 1:
            self.roots[np.isin(self.roots, roots)] = roots[0]

    def rows(self) -> pd.DataFrame:
        linked = np.flatnonzero(self.links)
        return pd.DataFrame({"rep": self.reps[linked], "root": self.reps[self.roots[linked]], "links": self.links[linked]})


def search_block(model: Quantiser, rows: pd.DataFrame, least: float = LEAST) -> pd.DataFrame:
    """Links between the queries and the members of one block of one list."""
    queries, members = rows[rows["query"]], rows[~rows["query"]]
    if queries.empty or members.empty:
        return pd.DataFrame({"rep": [], "root": [], "links": []}, dtype="int64")
    here = int(members["list"].iloc[0])
    block = _Block(np.concatenate([queries["rep"], members["rep"]]))
    x, y = np.stack(queries["vector"].to_list()), np.stack(members["vector"].to_list())
    codes = np.frombuffer(b"".join(members["codes"]), np.uint8).reshape(-1, SUBSPACES)
    bound = (model.radius + members["error"].to_numpy() + 1e-9) ** 2
    rep, home, size = (queries[c].to_numpy() for c in ("rep", "home", "n"))
    member_rep, member_size = members["rep"].to_numpy(), members["n"].to_numpy()
    # homes that a member probes itself: a pair found from both sides counts in the smaller list
    probes = members["probes"].to_list()
    owner = np.repeat(np.arange(len(probes)), [len(p) for p in probes])
    probed = np.zeros((len(probes), len(model.centroids)), bool)
    probed[owner, np.concatenate(probes)] = True
    residual = _padded(x) - model.centroids[here]
    width = residual.shape[1] // SUBSPACES
    tables = np.stack(
        [_distances(residual[:, s * width : (s + 1) * width], model.codewords[s]) for s in range(SUBSPACES)], 1
    )
    spots, member_spots = block.place(rep), block.place(member_rep)
    for q in range(len(x)):
        far = tables[q, 0][codes[:, 0]]
        for s in range(1, SUBSPACES):
            far = far + tables[q, s][codes[:, s]]
        near = far <= bound
        if home[q] == here:
            near &= member_rep > rep[q]
        elif home[q] < here:
            near &= ~probed[:, home[q]]
        candidates = np.flatnonzero(near)
        if not len(candidates):
            continue
        found = candidates[y[candidates] @ x[q] >= least]
        if len(found):
            block.links[spots[q]] += member_size[found].sum()
            np.add.at(block.links, member_spots[found], size[q])
            block.link(spots[q], member_spots[found])
    return block.rows()


def search_few(rows: pd.DataFrame, least: float = LEAST) -> pd.DataFrame:
    """Links between the few vectors of one number of components, by a quantiser of their own. Every list
    is probed that may hold a neighbour, so none is missed."""
    x = _unit(np.stack(rows["vector"].to_list()))
    model = fit(x, len(x), least)
    model = replace(model, probes=len(model.centroids))
    home, probes, codes, error = assign(model, x)
    placed = rows.assign(home=home, probes=probes, codes=[c.tobytes() for c in codes], error=error, vector=list(x))
    members = placed.assign(list=placed["home"], query=False)
    queries = placed.assign(list=placed["probes"], query=True).explode("list").astype({"list": "int64"})
    both = pd.concat([members, queries], ignore_index=True)
    return pd.concat([search_block(model, block, least) for _, block in both.groupby(["label", "list"])])


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Defined cases: rows that cannot be compared (see ``usable``) link with nothing, nor do rows with a
    NULL id; vectors with different numbers of components do not link;
    repeated rows are one vector and come back as often as they are given; an empty table gives an
    empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("string").alias("label"))
    rows = rows.withColumn("able", usable("vector", "label") & F.col("vec_id").isNotNull())
    rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    same = F.when(F.col("able"), F.struct(F.xxhash64("vector", "label"), F.hash("vector")).cast("string"))
    keyed = rows.withColumn("same", same)
    able = keyed.where("able")
    classes = able.groupBy("label", "same").agg(
        F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("n"), F.first("vector").alias("vector")
    )
    classes = Staged(classes, "vector_classes").frame
    width = F.size("vector")
    totals = {r["width"]: r["count"] for r in classes.groupBy(width.alias("width")).count().collect()}
    large = sorted(w for w, n in totals.items() if n > FEW)
    parts = [_search(classes.where(width == w), totals[w], least) for w in large]
    if len(large) < len(totals):
        few = classes.where(~width.isin(large)) if large else classes
        few = few.select("rep", "n", "label", "vector", width.alias("width")).groupBy("width")
        parts.append(Staged(few.applyInPandas(lambda rows: search_few(rows, least), _FOUND), "few_links").frame)
    found = reduce(DataFrame.union, parts) if parts else None
    sizes = classes.select("label", "same", "rep", "n")
    if found is None:
        linked = sizes.withColumn("links", F.lit(0)).withColumn("component_id", F.col("rep"))
    else:
        counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
        roots = components(found.select("rep", "root")).frame.toDF("rep", "component_id")
        linked = sizes.join(counts, "rep", "left").join(roots, "rep", "left").select(
            "label", "same", "rep", "n", "links", F.coalesce("component_id", "rep").alias("component_id")
        )
    linked = linked.where("n > 1 OR links > 0").select(
        F.col("label").alias("other_label"), F.col("same").alias("other"), "component_id",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
    )
    linked = Staged(linked, "linked").frame
    ids = keyed.select("vec_id", "label", "same")
    joined = ids.join(linked, (F.col("label") == F.col("other_label")) & (F.col("same") == F.col("other")), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _search(classes: DataFrame, total: int, least: float) -> DataFrame:
    """Links of the classes by block: rep, root, links."""
    spark = classes.sparkSession
    some = classes.where(by_hash(F.col("rep"), min(1.0, SAMPLE / total))).orderBy(F.xxhash64("rep")).limit(SAMPLE)
    sample = np.array([r["vector"] for r in some.select("vector").collect()])
    if not len(sample):
        sample = np.array([r["vector"] for r in classes.limit(1).select("vector").collect()])
    model = spark.sparkContext.broadcast(fit(_unit(sample), total, least))

    def place(batches):
        for batch in batches:
            if len(batch):
                x = _unit(np.stack(batch["vector"].to_list()))
                home, probes, codes, error = assign(model.value, x)
                yield pd.DataFrame({
                    "rep": batch["rep"], "n": batch["n"], "label": batch["label"], "home": home.astype("int32"),
                    "probes": [p.astype("int32") for p in probes], "codes": [c.tobytes() for c in codes],
                    "error": error, "vector": list(x),
                })

    placed = Staged(classes.select("rep", "n", "label", "vector").mapInPandas(place, _ROWS), "placed").frame
    members = placed.withColumn("list", F.col("home")).withColumn("query", F.lit(False))
    queries = placed.withColumn("list", F.explode("probes")).withColumn("query", F.lit(True))
    n_members = members.groupBy("label", "list").agg(F.count("*").alias("n_members"))
    n_queries = queries.groupBy("label", "list").agg(F.count("*").alias("n_queries"))
    # at most lists x labels rows
    cells = Staged(n_members.join(n_queries, ["label", "list"]), "cells").frame
    split = cells.select(
        "label", "list", F.ceil(F.col("n_members") / BLOCK).alias("m_blocks"), F.ceil(F.col("n_queries") / BLOCK).alias("q_blocks")
    )
    own = F.pmod(F.xxhash64("rep", F.lit("block")), F.when(F.col("query"), F.col("q_blocks")).otherwise(F.col("m_blocks")))
    others = F.when(F.col("query"), F.col("m_blocks")).otherwise(F.col("q_blocks"))
    columns = ["rep", "n", "label", "home", "list", "query", "vector"]
    nothing = F.lit(None)
    both = members.select(*columns, "probes", "codes", "error").unionByName(
        queries.select(*columns, nothing.cast("array<int>").alias("probes"), nothing.cast("binary").alias("codes"), nothing.cast("double").alias("error"))
    )
    dealt = both.join(split, ["label", "list"]).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    dealt = dealt.withColumn("m_block", F.when(F.col("query"), F.col("other")).otherwise(F.col("own")))
    dealt = dealt.withColumn("q_block", F.when(F.col("query"), F.col("own")).otherwise(F.col("other")))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        return search_block(model.value, rows, least)

    dealt = dealt.select(*columns, "probes", "codes", "error", "m_block", "q_block")
    found = dealt.groupBy("label", "list", "m_block", "q_block").applyInPandas(search, _FOUND)
    return Staged(found, "vector_links").frame
