"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, sufficient probes, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.ann import usable
from attestor.llm.graph import components
from attestor.llm.shared import bounded_sample, stage, unstage

#: Rows of a list, and of its queries, that one task holds at a time.
BLOCK = 2048
#: Slack for rounding in bounds, so that they never drop a pair at the threshold.
SLACK = 1e-6


@dataclass
class Model:
    """``coarse``: list centres; ``books``: for each subspace its code vectors for residuals; ``radius``: the farthest that linked unit vectors are apart."""

    coarse: np.ndarray
    books: list[np.ndarray]
    radius: float

    def nearest(self, u: np.ndarray) -> np.ndarray:
        return _squares(u, self.coarse).argmin(1)

    def probes(self, u: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """Lists that a vector within the radius of ``u`` can be in.

        A vector of list c' is no nearer to ``u`` than the plane halfway between c' and any other centre, as
        far as ``u`` is on that centre's side; a list is needed only if all these planes are within the radius.
        """
        d = _squares(u, self.coarse)
        apart = np.sqrt(_squares(self.coarse, self.coarse))
        np.fill_diagonal(apart, np.inf)
        need = np.ones(d.shape, bool)
        for other in range(len(self.coarse)):
            beyond = (d - d[:, other : other + 1]) / (2 * np.maximum(apart[:, other], 1e-9))
            need &= beyond <= self.radius + SLACK
        need[np.arange(len(u)), own] = True
        return [np.flatnonzero(n) for n in need]

    def encode(self, u: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error): codes of the residual by subspace, and how far the coded vector is from ``u``."""
        rest, codes, error, at = u - self.coarse[own], [], np.zeros(len(u)), 0
        for book in self.books:
            part = rest[:, at : at + book.shape[1]]
            code = _squares(part, book).argmin(1)
            codes.append(code.astype("u1"))
            error += ((part - book[code]) ** 2).sum(1)
            at += book.shape[1]
        return np.stack(codes, 1), np.sqrt(error)

    def distances(self, q: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of ``q`` to coded vectors of list ``own``, summed from lookup tables."""
        rest, total, at = q - self.coarse[own], np.zeros((len(q), len(codes))), 0
        for i, book in enumerate(self.books):
            total += _squares(rest[:, at : at + book.shape[1]], book)[:, codes[:, i]]
            at += book.shape[1]
        return np.sqrt(np.maximum(total, 0))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def _means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    c = x[np.random.default_rng(0).permutation(len(x))[:k]]
    for _ in range(rounds):
        own = _squares(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return np.unique(c, axis=0)


def _unit(v: list) -> np.ndarray:
    x = np.stack(v).astype("f8")
    x /= np.abs(x).max(1, keepdims=True)  # so that squares of very large or small components stay in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(points: DataFrame, threshold: float, sample: int = 10_000, most_probes: float = 8.0, subspaces: int = 8, codes: int = 64) -> Model | None:
    """Learn from at most ``sample`` rows of (id, v), the same ones at each run. None without rows.

    The number of lists doubles while the sample's rows need no more than ``most_probes`` lists on average.
    """
    rows = bounded_sample(points, F.col("id"), sample).select("id", "v").collect()
    if not rows:
        return None
    u = _unit([r.v for r in rows])
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    coarse = _means(u, 1)
    while 2 * len(coarse) <= min(4096, len(u) // 8):
        more = Model(_means(u, 2 * len(coarse)), [], radius)
        few = u[:500]
        if len(more.coarse) <= len(coarse) or np.mean([len(p) for p in more.probes(few, more.nearest(few))]) > most_probes:
            break
        coarse = more.coarse
    rest = u - coarse[Model(coarse, [], radius).nearest(u)]
    width = -(-u.shape[1] // subspaces)
    return Model(coarse, [_means(rest[:, i : i + width], codes) for i in range(0, u.shape[1], width)], radius)


class _Links:
    """Counts of links by vector, and a forest that joins what is linked."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, at = np.unique(ids, return_inverse=True)
        self.at, self.links, self.parent = at, np.zeros(len(self.ids), "i8"), np.arange(len(self.ids))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, a: int, others: np.ndarray) -> None:
        for b in others:
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)


def _meet(model: Model, threshold: float, group: pd.DataFrame) -> pd.DataFrame:
    """Link one block of queries with one block of a list: tables first, then the exact cosine.

    A pair is looked at where the query has the smaller id. The coded vector is off by a known error, so a table
    distance above radius plus error rules a pair out, and no other pair is dropped.
    """
    q = group["q"].to_numpy(bool)
    ids, copies = group["id"].to_numpy(), group["copies"].to_numpy()
    empty = pd.DataFrame({"id": pd.Series(dtype="i8"), "root": pd.Series(dtype="i8"), "links": pd.Series(dtype="i8")})
    if q.all() or not q.any():
        return empty
    u = _unit(group["v"].tolist())
    found, cell = _Links(ids), int(group["cell"].iloc[0])
    members, asked = np.flatnonzero(~q), np.flatnonzero(q)
    codes, error = model.encode(u[members], np.full(len(members), cell))
    for first in range(0, len(asked), 256):
        some = asked[first : first + 256]
        near = model.distances(u[some], cell, codes) <= model.radius + error + SLACK
        near &= ids[some][:, None] < ids[members]
        if not near.any():
            continue
        if near.mean() > 0.02:
            linked = near & (u[some] @ u[members].T >= threshold)
            rows, columns = np.nonzero(linked)
        else:
            rows, columns = np.nonzero(near)
            exact = np.concatenate([(u[some[rows[i : i + 65536]]] * u[members[columns[i : i + 65536]]]).sum(1) for i in range(0, len(rows), 65536)]) >= threshold
            rows, columns = rows[exact], columns[exact]
        a, b = some[rows], members[columns]
        np.add.at(found.links, found.at[a], copies[b])
        np.add.at(found.links, found.at[b], copies[a])
        for i in np.unique(rows):
            found.join(found.at[some[i]], found.at[members[columns[rows == i]]])
    some = np.flatnonzero(found.links)
    return pd.DataFrame({"id": found.ids[some], "root": [found.ids[found.root(x)] for x in some], "links": found.links[some]}) if len(some) else empty


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row: links are pairs of equal label with a cosine of ``threshold`` or more.

    Vectors that are not :func:`usable`, or have no label, link with nothing; vectors of different lengths are
    never compared. Rows of one id are rows of their own, and link with each other like any, as do rows with a null id; these have the
    component of what they link with and are not kept, but for components without any id. Equal
    vectors of one label are brought together first, as one point with its number of copies. ``component_id`` is
    the least id reachable by links, ``kept`` says that a row is its own. Other columns are ignored.

    Every vector is in one list of its label and asks all lists that a linked vector can be in, in
    blocks of bounded size, so the result is exact; no pairs leave a task, only counts and a forest.
    """
    label = F.col(label_col) if label_col else F.lit(0)
    given = stage(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), label.alias("label"), (usable(vector_col) & label.isNotNull()).alias("ok")))
    whole = given.where("ok").select("id", F.concat_ws(":", F.size("v"), "label").alias("label"), F.col("v"))
    # a point has a number of its own, which ids need not be; staging fixes it
    points = stage(whole.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()))
    sizes = [r[0] for r in points.select(F.size("v")).distinct().collect()]
    met = None
    for size in sorted(sizes):
        same = points.where(F.size("v") == size)
        linked = _linked(same, threshold, fit(same, threshold))
        met = linked if met is None else met.unionByName(linked)
    if met is None:
        return given.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    met = stage(met)
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    rooted = points.join(links, "id", "left").join(components(met, "id", "root").withColumnRenamed("node", "id"), "id", "left")
    rooted = stage(rooted.select("label", "v", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    answer = stage(rooted.join(least, "root").select("label", "v", "links", "copies", "component"))
    unstage(points, met, rooted)
    keyed = given.withColumn("label", F.when(F.col("ok"), F.concat_ws(":", F.size("v"), "label")))
    return keyed.join(answer, ["label", "v"], "left").select(
        "id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component", "id")).alias("kept"),
    )


def _linked(points: DataFrame, threshold: float, model: Model) -> DataFrame:
    """(id, root, links) of points (id, label, v, copies) of one length that link with others."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 1024):
                part = batch.slice(first, 1024)
                u = _unit(part.column("v").to_pylist())
                own = model.nearest(u)
                lists = pa.array([p.tolist() for p in model.probes(u, own)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.int32()), lists], names=[*part.schema.names, "own", "lists"])

    kind = dict(points.dtypes)["v"]
    columns = points.select("id", "label", "v", "copies")
    placed = stage(columns.mapInArrow(assign, f"id long, label string, v {kind}, copies long, own int, lists array<int>"))
    asking = placed.select("id", "label", "v", "copies", F.explode("lists").alias("cell"))
    members = placed.groupBy("label", F.col("own").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("mb"))
    queries = placed.select("label", F.explode("lists").alias("cell")).groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qb"))
    grid = stage(members.join(queries, ["label", "cell"]))
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    listed = placed.select("id", "label", "v", "copies", F.col("own").alias("cell")).join(grid, ["label", "cell"])
    listed = listed.select("id", "label", "v", "copies", "cell", (spread % F.col("mb")).cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("n"), F.lit(False).alias("q"))
    asked = asking.join(grid, ["label", "cell"])
    asked = asked.select("id", "label", "v", "copies", "cell", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), (spread % F.col("qb")).cast("int").alias("n"), F.lit(True).alias("q"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        return _meet(model, threshold, group)

    return listed.unionByName(asked).groupBy("label", "cell", "m", "n").applyInPandas(meet, "id long, root long, links long")
