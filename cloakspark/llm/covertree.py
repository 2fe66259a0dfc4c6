"""Near-duplicate embeddings: cover trees traversed in pairs, exact at a cosine threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspark.llm.common import connected_components, spanning, write_table

#: Distinct vectors in a block; larger cells are split by hash.
BLOCK = 4096
#: Vectors of the sample from which a large label's top nodes are taken, and how many nodes at most: one a block.
SAMPLE, TOPS, LABELS = 2048, 32, 256
LEAF = 64


class Node:
    """Vectors ``rows`` within ``radius`` of ``center``; kids cover them at half the radius."""

    __slots__ = ("rows", "center", "radius", "kids")

    def __init__(self, x: np.ndarray, rows: np.ndarray, center: np.ndarray, level: float):
        self.rows, self.center = rows, center
        d = np.sqrt(np.maximum(((x[rows] - center) ** 2).sum(1), 0))
        self.radius, self.kids = float(d.max()), []
        if len(rows) <= LEAF or self.radius < 1e-9:
            return
        level = min(level, 2 ** np.ceil(np.log2(self.radius))) / 2
        rest, groups = np.arange(len(rows)), []
        while len(rest):
            if len(groups) * 4 > len(rows):
                return  # kids would hold under four vectors each: comparing outright is cheaper
            c = center if not groups else x[rows[rest[0]]]  # levels are nested: the node's own centre comes first
            near = ((x[rows[rest]] - c) ** 2).sum(1) <= level * level
            if near.any():
                groups.append((rest[near], c))
            elif groups:
                near[0] = True
                groups.append((rest[near], c))
            else:
                center = x[rows[rest[0]]]
                continue
            rest = rest[~near]
        self.kids = [Node(x, rows[g], c, level) for g, c in groups]


def dual_traversal(a: Node, b: Node, eps: float):
    """Pairs of leaves' rows that may hold vectors within ``eps``; the rest is excluded by covering radii."""
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        if np.sqrt(((p.center - q.center) ** 2).sum()) > p.radius + q.radius + eps:
            continue
        if p.kids and (not q.kids or p.radius >= q.radius):
            stack += [(k, q) for k in p.kids]
        elif q.kids:
            stack += [(p, k) for k in q.kids]
        else:
            yield p.rows, q.rows


def _cells(spark: SparkSession, v: DataFrame, block: int) -> dict:
    """Top nodes of labels with over ``block`` vectors, of LABELS labels at most: a bounded table, made by one job.

    About SAMPLE vectors of a label, chosen by hash, are fitted in one task; LABELS * TOPS vectors come to the driver.
    """
    big = v.groupBy("label", "dim").count().where(F.col("count") > block).orderBy(F.desc("count"), "label", "dim").limit(LABELS)
    part = 1 << 30
    some = v.join(F.broadcast(big), ["label", "dim"]).where(F.pmod(F.xxhash64("rep"), F.lit(part)) * F.col("count") < SAMPLE * part)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("rep").x.to_numpy())
        x /= np.linalg.norm(x, axis=1)[:, None]
        tops, d = [0], ((x - x[0]) ** 2).sum(1)
        while len(tops) < min(TOPS, -(-int(pdf["count"].iloc[0]) // block)) and d.max() > 1e-6:
            tops.append(int(d.argmax()))
            d = np.minimum(d, ((x - x[tops[-1]]) ** 2).sum(1))
        return pd.DataFrame({"label": [pdf.label.iloc[0]], "dim": [pdf.dim.iloc[0]], "tops": [x[tops].ravel()]})

    kind = v.schema["label"].dataType.simpleString()
    found = some.groupBy("label", "dim").applyInPandas(fit, f"label {kind}, dim int, tops array<double>").collect()
    return {(r["label"], r["dim"]): np.array(r["tops"]).reshape(-1, r["dim"]) for r in found}


def embedding_links(spark: SparkSession, vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector; links join equal labels at cosine >= ``threshold``.

    Equal vectors of a label are compared once and counted as often as they occur. A label above ``block`` vectors is
    cut into cells by the top nodes of a cover tree (fitted on SAMPLE vectors; any nodes give the same links), cells into
    blocks by hash; pairs of cells, and rows that no cell of the pair can hold a partner of, are left out by covering
    radii. A task takes two blocks and traverses their cover trees in pairs; it returns counts and a spanning forest.
    A vector that is null, zero, empty or holds null or non-finite parts links with nothing, nor does one with a null
    label; it is its own component. Repeated rows are vectors of their own. Vectors of other lengths never link. A null
    vec_id links as others do; a component has the least id that is not null, or null if there is none, and of that id
    (or null) all rows are kept. An empty table gives an empty result.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    usable = F.col("label").isNotNull() & F.coalesce(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("x", lambda e: e != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").alias("label"), x.alias("x"))
    good = rows.where(usable).withColumn("x", F.transform("x", lambda e: e + F.lit(0.0)))
    # Distinct vectors have numbers of their own, so that those without an id link as well.
    v = good.groupBy("label", "x").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("dim", F.size("x"))
    every = write_table(spark, v.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    v = every.select("label", "x", "rep", "n", "dim")
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    tops = _cells(spark, v, block)

    def place(batches):
        """Each vector's cell and its distance to the cell's centre."""
        for pdf in batches:
            cell, far = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            for key, at in pdf.groupby(["label", "dim"]).indices.items():
                if key in tops:
                    y = np.stack(pdf.x.iloc[at].to_numpy())
                    y = y / np.linalg.norm(y, axis=1)[:, None]
                    d = np.sqrt(np.maximum(2 - 2 * y @ tops[key].T, 0))
                    cell[at], far[at] = d.argmin(1), d.min(1)
            yield pdf.assign(cell=cell, far=far)

    kind = v.schema["label"].dataType.simpleString()
    placed = v if not tops else v.mapInPandas(place, f"label {kind}, x array<double>, rep long, n long, dim int, cell int, far double")
    if not tops:
        placed = v.withColumn("cell", F.lit(0)).withColumn("far", F.lit(0.0))
    if len(tops) == LABELS:  # further large labels are one cell each, cut into blocks by hash
        m = v.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        placed = placed.join(m, ["label", "dim"])
    else:
        placed = placed.withColumn("blocks", F.lit(1))
    sizes = {}
    for r in placed.where(F.col("label").isin([k for k, _ in tops])).groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect() if tops else []:
        sizes[r["label"], r["dim"], r["cell"]] = (-(-r["n"] // block), r["r"])  # LABELS * TOPS rows at most

    def pair_up(batches):
        """A row for each pair of blocks that a vector takes part in: of its own cell, and of those that may hold a partner."""
        for pdf in batches:
            out = []
            for (label, dim), at in pdf.groupby(["label", "dim"]).indices.items():
                part = pdf.iloc[at]
                key = (label, dim)
                h = (part.rep.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                if key not in tops:
                    k = int(part.blocks.iloc[0])
                    s = h % k
                    for t in range(k):
                        out.append(part[s <= t].assign(c1=0, s1=s[s <= t], c2=0, s2=t, own=True))
                        out.append(part[s > t].assign(c1=0, s1=t, c2=0, s2=s[s > t], own=False))
                    continue
                y = np.stack(part.x.to_numpy())
                y = y / np.linalg.norm(y, axis=1)[:, None]
                d = np.sqrt(np.maximum(2 - 2 * y @ tops[key].T, 0))
                gap = np.sqrt(np.maximum(((tops[key][:, None] - tops[key][None]) ** 2).sum(2), 1e-300))
                cell = part.cell.to_numpy()
                for c in np.unique(cell):
                    k, r = sizes[label, dim, c]
                    mine = (cell == c).nonzero()[0]
                    for o in range(len(tops[key])):
                        if (label, dim, o) not in sizes:
                            continue
                        ko, ro = sizes[label, dim, o]
                        if gap[c, o] > r + ro + eps and o != c:
                            continue
                        near = mine if o == c else mine[(d[mine, o] <= ro + eps) & ((d[mine, o] ** 2 - d[mine, c] ** 2) / (2 * gap[c, o]) <= eps + 1e-9)]
                        if not len(near):
                            continue
                        sub = part.iloc[near]
                        s = h[near] % k
                        for t in range(ko):
                            if o > c:
                                out.append(sub.assign(c1=c, s1=s, c2=o, s2=t, own=True))
                            elif o < c:
                                out.append(sub.assign(c1=o, s1=t, c2=c, s2=s, own=False))
                            else:
                                out.append(sub[s <= t].assign(c1=c, s1=s[s <= t], c2=c, s2=t, own=True))
                                out.append(sub[s > t].assign(c1=c, s1=t, c2=c, s2=s[s > t], own=False))
            if out:
                yield pd.concat(out)[names].astype({q: "int32" for q in ("c1", "s1", "c2", "s2")})

    names = ["label", "dim", "c1", "s1", "c2", "s2", "own", "x", "rep", "n"]
    schema = f"label {kind}, dim int, c1 int, s1 int, c2 int, s2 int, own boolean, x array<double>, rep long, n long"

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.stack(pdf.x.to_numpy())
        norm = np.sqrt((y * y).sum(1))
        rep, n, own = pdf.rep.to_numpy(), pdf.n.to_numpy(), pdf.own.to_numpy()
        unit = y / norm[:, None]
        same = own.all()
        at = np.arange(len(y))
        grow = lambda rows: Node(unit, rows, unit[rows[0]], 2.0)
        if same:
            if not (pdf.c1.iloc[0] == pdf.c2.iloc[0] and pdf.s1.iloc[0] == pdf.s2.iloc[0]):
                return pd.DataFrame({"kind": [], "a": [], "b": []}).astype({"kind": "int32", "a": "int64", "b": "int64"})
            left = right = grow(at)
        elif not own.any():
            return pd.DataFrame({"kind": [], "a": [], "b": []}).astype({"kind": "int32", "a": "int64", "b": "int64"})
        else:
            left, right = grow(at[own]), grow(at[~own])
        labels, links = at.copy(), np.zeros(len(y), np.int64)
        for p, q in dual_traversal(left, right, eps):
            for k in range(0, len(p), 512):
                g = p[k : k + 512]
                cos = (y[g] @ y[q].T) / (norm[g][:, None] * norm[q][None])
                near = cos >= threshold
                for i, j in zip(*(np.abs(cos - threshold) < 1e-12).nonzero(), strict=True):
                    near[i, j] = float(y[g[i]] @ y[q[j]]) / (norm[g[i]] * norm[q[j]]) >= threshold
                if same:
                    near &= g[:, None] != q[None]
                links[g] += near @ n[q]
                if not same:
                    links[q] += n[g] @ near
                spanning(labels, len(y), ((g[i], q[near[i]]) for i in near.any(1).nonzero()[0]))
        low = np.full(len(y), np.iinfo(np.int64).max)
        np.minimum.at(low, labels, rep)
        to = low[labels]
        some, moved = links > 0, to != rep
        return pd.DataFrame({"kind": np.repeat(np.array([0, 1], np.int32), [some.sum(), moved.sum()]), "a": np.concatenate((rep[some], rep[moved])), "b": np.concatenate((links[some], to[moved]))})

    found = write_table(spark, placed.mapInPandas(pair_up, schema).groupBy("label", "dim", "c1", "s1", "c2", "s2").applyInPandas(compare, "kind int, a long, b long"), "links")
    comp = connected_components(spark, found.where("kind = 1").select("a", "b"), "vectors")
    count = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("others"))
    v = every.join(count, F.col("rep") == F.col("a"), "left").join(comp, F.col("rep") == F.col("node"), "left")
    v = write_table(spark, v.select("label", "x", "least", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c")), "linked")
    names = v.groupBy("c").agg(F.min("least").alias("component_id"))
    v = v.join(names, "c").select("label", "x", "n_links", "component_id")
    linked = good.join(v, ["label", "x"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
