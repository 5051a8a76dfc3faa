"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one kept vector a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import staged, table
from tickloom.llm.components import components
from tickloom.llm.registry import query

C = F.col
#: Vectors the cells are fitted on, the size a cell aims at, the most cells, and the rows of a block.
FIT_ROWS, CELL_ROWS, MAX_CELLS, BLOCK = 20_000, 2048, 1024, 2048


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; an empty cell is moved to the row that fits its centroid worst."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        products = x @ centers.T
        own = products.argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1)
        worst = np.argsort(products[np.arange(len(x)), own], kind="stable")
        for i, j in enumerate(np.flatnonzero(norms < 1e-12)):
            sums[j] = x[worst[i % len(x)]]
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


def _unit(frame: pd.DataFrame, dims: int) -> np.ndarray:
    x = np.zeros((len(frame), dims))
    if all(len(v) == dims for v in frame["vector"]):
        x[:] = np.stack(frame["vector"].to_numpy()) if len(frame) else x
    else:
        for i, v in enumerate(frame["vector"]):
            x[i, : len(v)] = v
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _stars(links: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each row of a symmetric link matrix."""
    root = np.full(len(links), -1)
    for i in range(len(links)):
        if root[i] < 0:
            reached = np.zeros(len(links), bool)
            reached[i] = True
            new = reached
            while new.any():
                new = links[new].any(0) & ~reached
                reached |= new
            root[reached] = i
    return root


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: ``vec_id, n_links, component_id, kept``.

    Vectors link when their labels are equal and not null, their lengths agree and their cosine, in double precision, is
    ``threshold`` or more. Null or zero vectors and those with a null or non-finite component link with nothing, and neither
    do rows without an id, whose component is null and which are not kept. Rows that share an id are one node, whose links are those of its rows.

    Equal vectors are first folded to one row with a count. Every label of twice ``CELL_ROWS`` vectors or more has cells of its own, fitted on its part of ``FIT_ROWS``
    vectors; they take all of them, and a smaller label is one cell. A vector is also a guest of every cell before its own it can have a link
    into: one whose bisector with its own cell lies within the threshold's angle, and whose radius reaches it. So a pair meets in its
    common cell or in the first one's and none is lost. Cells are cut into blocks of ``BLOCK`` rows by a hash, and every pair of blocks is
    one bounded group, which gives counts and a spanning star for each of its local groups, never its pairs.
    """
    usable = (C("label").isNotNull() & C("vec_id").isNotNull() & (F.size("vector") > 0)
              & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vector", lambda v: v != 0))
    rows = staged(vectors.select(C(id_col).cast("long").alias("vec_id"), C(vector_col).alias("vector"), C(label_col).alias("label")).withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")
    spark = rows.sparkSession
    folded = rows.where("usable").groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    folded = staged(folded.withColumn("dims", F.size("vector")), "vector-classes")
    size = folded.agg(F.count("*"), F.max("dims")).first()
    if not size[0]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), C("vec_id").alias("component_id"), C("vec_id").isNotNull().alias("kept"))
    n, dims = int(size[0]), int(size[1])

    # Labels of many vectors only: at most one for twice CELL_ROWS rows, and MAX_CELLS / 2 of them.
    large = folded.groupBy("label").agg(F.count("*").alias("n")).where(C("n") >= 2 * CELL_ROWS)
    large = {r["label"]: r["n"] for r in large.orderBy(F.desc("n"), "label").limit(MAX_CELLS // 2).collect()}
    wanted = sum(m // CELL_ROWS for m in large.values())
    centers = {}
    if large:
        sample = folded.where(C("label").isin(list(large))).select("label", "vector").orderBy(F.xxhash64("rep", "label")).limit(FIT_ROWS).toPandas()
        for label, part in sample.groupby("label"):
            k = large[label] // CELL_ROWS if wanted <= MAX_CELLS else max(1, large[label] // CELL_ROWS * MAX_CELLS // wanted)
            centers[label] = spherical_kmeans(_unit(part, dims), min(k, len(part)))
    angle = float(np.arccos(threshold)) + 1e-7

    def of_labels(frame: pd.DataFrame):
        """Positions of each label that has cells, their products with its centroids, and these."""
        for label, at in frame.groupby("label").indices.items():
            if label in centers:
                yield label, at, np.clip(_unit(frame.iloc[at], dims) @ centers[label].T, -1, 1), centers[label]

    def nearest(batches):
        for frame in batches:
            home, off = np.zeros(len(frame), np.int32), np.zeros(len(frame))
            for _, at, products, _ in of_labels(frame):
                home[at] = products.argmax(1)
                off[at] = np.arccos(products[np.arange(len(at)), home[at]])
            yield frame.assign(home=home, off=off)

    schema = ", ".join(f.simpleString().replace(":", " ", 1) for f in folded.schema)
    homed = staged(folded.mapInPandas(nearest, schema + ", home int, off double"), "vector-homes")
    # At most MAX_CELLS rows.
    reach = {label: np.full(len(c), -1.0) for label, c in centers.items()}
    if centers:
        for r in homed.where(C("label").isin(list(centers))).groupBy("label", "home").agg(F.max("off").alias("r")).collect():
            reach[r["label"]][r["home"]] = r["r"]

    def cells(batches):
        for frame in batches:
            row, cell = [np.arange(len(frame))], [frame["home"].to_numpy()]
            for label, at, products, c in of_labels(frame):
                own = frame["home"].to_numpy()[at]
                gaps = np.linalg.norm(c[:, None] - c[None], axis=2)
                margin = products[np.arange(len(at)), own][:, None] - products
                near = (margin <= np.sin(angle) * gaps[own] + 1e-9) & (np.arccos(products) <= reach[label][None] + angle)
                near &= np.arange(len(c))[None] < own[:, None]
                i, j = np.nonzero(near)
                row.append(at[i])
                cell.append(j)
            row, cell = np.concatenate(row), np.concatenate(cell)
            yield frame.iloc[row].drop(columns=["home", "off"]).assign(cell=cell, own=np.arange(len(row)) < len(frame))

    placed = staged(homed.mapInPandas(cells, schema + ", cell int, own boolean"), "vector-cells")
    key = ["cell", "label", "dims"]
    blocks = placed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("rep"), C("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), C("blocks") - 1))
    sides = placed.where("own").select(*key, "rep", "vector", "copies", C("block").alias("a"), every.alias("b"), F.lit(True).alias("left")).unionByName(
        placed.select(*key, "rep", "vector", "copies", every.alias("a"), C("block").alias("b"), F.lit(False).alias("left"), "own"), allowMissingColumns=True)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame["left"]], frame[~frame["left"]]
        x, y = (np.stack([np.asarray(v, np.float64) for v in f["vector"]]) if len(f) else np.zeros((0, dims)) for f in (left, right))
        a, b = left["rep"].to_numpy(), right["rep"].to_numpy()
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        cosine = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None])
        links = (cosine >= threshold) & (a[:, None] != b[None])
        counts = links @ right["copies"].to_numpy()
        # Two vectors of the cell are left once each; a guest is only here.
        guest = ~right["own"].to_numpy(bool)
        guests = pd.DataFrame({"rep": b[guest], "links": links[:, guest].T @ left["copies"].to_numpy(), "root": b[guest]})
        # Both sides as one graph, rows by id, so that a group's first row is its smallest.
        ids, at = np.unique(np.r_[a, b], return_inverse=True)
        graph = np.zeros((len(ids), len(ids)), bool)
        i, j = np.nonzero(links)
        graph[at[i], at[len(a) + j]] = graph[at[len(a) + j], at[i]] = True
        linked = np.flatnonzero(graph.any(0))
        root = ids[linked][_stars(graph[np.ix_(linked, linked)])] if len(linked) else ids[:0]
        stars = pd.DataFrame({"rep": ids[linked], "links": 0, "root": root})
        stars = stars[stars["rep"] != stars["root"]]
        return pd.concat([pd.DataFrame({"rep": a, "links": counts, "root": a}), guests, stars]).astype("int64")

    found = staged(sides.groupBy(*key, "a", "b").applyInPandas(compare, "rep long, links long, root long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where(C("rep") != C("root")).select(C("rep").alias("u"), C("root").alias("v")))
    classes = folded.join(counts, "rep", "left").join(roots, C("rep") == C("node"), "left").select(
        C("label").alias("l"), C("vector").alias("v"), (C("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = rows.join(classes, C("usable") & (C("label") == C("l")) & (C("vector") == C("v")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == C("vec_id"), F.lit(False)).alias("kept"))


@query("op4_embedding_dedup")
def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
