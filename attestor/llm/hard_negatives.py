"""Hard negatives by branch and bound over ball trees: a tree a partition, nodes bounded from above and below by inner product."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.ann import matrix
from attestor.llm.shared import bounded_sample, stage, unstage
from attestor.llm.vector_dedup import _means

#: Rows of a tree and of its leaves; anchors that meet a tree in one task; cells that rows are dealt to at most, learned from so many rows.
SHARD, LEAF, BLOCK, CELLS, SAMPLE = 8192, 64, 1024, 256, 20_000
#: Slack for rounding in bounds, as a share of what they are made of.
SLACK = 1e-9


@dataclass
class Node:
    """A ball around ``centre`` that holds the rows ``at``; a leaf has no children."""

    centre: np.ndarray
    radius: float
    at: np.ndarray
    children: list[Node] = field(default_factory=list)

    def bounds(self, q: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most): no inner product of a row of the ball with ``q`` is outside."""
        middle, reach = q @ self.centre, norm * self.radius
        slack = SLACK * (norm * (np.sqrt(self.centre @ self.centre) + self.radius)) + SLACK
        return middle - reach - slack, middle + reach + slack


def tree(x: np.ndarray, at: np.ndarray | None = None) -> Node:
    """Split rows at the median of their place between two that are far apart, until a leaf's rows are left."""
    at = np.arange(len(x)) if at is None else at
    centre = x[at].mean(0)
    far = ((x[at] - centre) ** 2).sum(1)
    node = Node(centre, float(np.sqrt(far.max())), at)
    if len(at) > LEAF and node.radius > 0:
        one = x[at[far.argmax()]]
        other = x[at[((x[at] - one) ** 2).sum(1).argmax()]]
        order = np.argsort(x[at] @ (other - one), kind="stable")
        node.children = [tree(x, at[half]) for half in np.array_split(order, 2)]
    return node


class Search:
    """The best ``k`` rows of a tree for each of many questions: an anchor's vector, and a window of scores.

    ``x`` are the rows' vectors, ``order`` their place among equal scores; ``q`` the questions' vectors, ``low`` and ``high`` their windows.
    ``allowed(questions, rows)`` says which pairs may meet.
    """

    def __init__(self, x: np.ndarray, order: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        self.x, self.order, self.q, self.low, self.high, self.k, self.allowed = x, order, q, low, high, k, allowed
        exact = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) ** 2 * x.shape[1] < 2**53
        self.exact_x, self.exact_q = (x, q) if exact else (x.astype("i8"), q.astype("i8"))  # doubles hold smaller whole numbers exactly
        self.norm = np.sqrt((q * q).sum(1))
        self.score = np.full((len(q), k), np.iinfo("i8").min)
        self.row = np.full((len(q), k), -1)
        self.seen = np.zeros(len(q), "i8")

    def begin(self, node: Node, asked: np.ndarray) -> None:
        """Look at the leaf that each question's best bounds lead to, so that there is a ``k``-th to prune by."""
        if not len(asked):
            return
        if node.children:
            tops = np.stack([child.bounds(self.q[asked], self.norm[asked])[1] for child in node.children])
            for i, child in enumerate(node.children):
                self.begin(child, asked[tops.argmax(0) == i])
        else:
            self.seen[asked] = id(node)
            self.look(node.at, asked)

    def run(self, node: Node, asked: np.ndarray) -> None:
        """Leave out questions whose window the ball misses, or whose current ``k``-th is strictly above all of it."""
        least, most = node.bounds(self.q[asked], self.norm[asked])
        need = (most >= self.low[asked]) & (least <= self.high[asked]) & (most >= self.score[asked, -1])
        asked = asked[need]
        if not len(asked):
            return
        if not node.children:
            self.look(node.at, asked[self.seen[asked] != id(node)])
            return
        tops = [child.bounds(self.q[asked], self.norm[asked])[1].mean() for child in node.children]
        for i in np.argsort(tops)[::-1]:
            self.run(node.children[i], asked)

    def look(self, rows: np.ndarray, asked: np.ndarray) -> None:
        score = (self.exact_q[asked] @ self.exact_x[rows].T).astype("i8")
        ok = (score >= self.low[asked, None]) & (score <= self.high[asked, None]) & (score >= self.score[asked, -1:])
        a, b = np.nonzero(ok & self.allowed(asked, rows))
        if not len(a):
            return
        changed, own = np.unique(a, return_inverse=True)
        of = asked[changed]
        key = np.concatenate([np.repeat(np.arange(len(of)), self.k), own])
        value = np.concatenate([self.score[of].reshape(-1), score[a, b]])
        row = np.concatenate([self.row[of].reshape(-1), rows[b]])
        place = np.where(row >= 0, self.order[row], len(self.x))
        sort = np.lexsort((place, -value.astype("f8") if np.abs(value[row >= 0]).max() < 2**53 else ~value, key))
        first = np.flatnonzero(np.concatenate([[True], np.diff(key[sort]) != 0]))
        best = sort[(first[:, None] + np.arange(self.k)).reshape(-1)]  # each has ``k`` entries at least
        self.score[of], self.row[of] = value[best].reshape(-1, self.k), row[best].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, row, score) of all that was found."""
        at, nth = np.nonzero(self.row >= 0)
        return at, self.row[at, nth], self.score[at, nth]


#: What comes together in a task: rows of the index and questions (``q``), these with a window.
MET = "n long, id long, label string, v array<double>, q boolean, positive long, low long, high long"
NAMES = [c.split()[0] for c in MET.split(", ")]
SHAPE = "anchor long, positive long, n long, id long, score long"


def _meet(k: int, same: bool) -> Callable[[pa.Table], pa.Table]:
    """Search a group's rows for its questions: rows of the same label as the anchor, or of others."""

    def run(group: pa.Table) -> pa.Table:
        q = group.column("q").to_numpy()
        n, positive = group.column("n").to_numpy(), group.column("positive").fill_null(-1).to_numpy()
        none = np.zeros(0, "i8")
        at, row, score, rows, asked = none, none, none, np.flatnonzero(~q), np.flatnonzero(q)
        ids = group.column("id")
        if len(rows) and len(asked):
            x = matrix(group.column("v"))
            _, label = np.unique(np.array(group.column("label").to_pylist(), object).astype(str), return_inverse=True)
            known = ids.fill_null(np.iinfo("i8").max).to_numpy()
            order = np.empty(len(rows), "i8")
            order[np.lexsort((n[rows], known[rows], ids.is_null().to_numpy()[rows]))] = np.arange(len(rows))
            low, high = (group.column(c).fill_null(0).to_numpy()[asked] for c in ("low", "high"))

            def allowed(some: np.ndarray, held: np.ndarray) -> np.ndarray:
                alike = label[asked[some]][:, None] == label[rows[held]]
                return (alike == same) & (n[asked[some]][:, None] != n[rows[held]])

            search = Search(x[rows], order, x[asked], low, high, k, allowed)
            root, questions = tree(search.x), np.arange(len(asked))
            search.begin(root, questions)
            search.run(root, questions)
            at, row, score = search.found()
        at, row = asked[at], rows[row]
        return pa.table({"anchor": n[at], "positive": positive[at], "n": n[row], "id": ids.take(pa.array(row)), "score": score})

    return run


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of each key: higher scores, then smaller ids; ``rank`` counts from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "n")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _spread(parts: Column) -> Column:
    return F.pmod(F.xxhash64("n"), parts).cast("int")


def _each(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))


ANY = (-(1 << 62), 1 << 62)
LIMIT = float(1 << 57)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    Components become ``floor(scale * x)``, a score is the integer inner product with the anchor; higher scores come first, ties by smaller id. An
    anchor's positives are its first ``positives`` other rows of its label; negatives are the first ``negatives`` rows of other labels whose score is within
    ``low`` and ``high`` percent of the positive's. A positive with a negative score has an empty window.

    Rows with a null label or vector, or a null or non-finite component, take no part, nor do rows whose components are so large that scores would pass 64 bits
    (number of components times the square of the largest scaled one, 2 to the 57th or more). Zero and empty vectors take part; vectors of different
    lengths never meet. Repeated rows, and rows that share an id, are rows of their own: anchors each, positives and negatives each. A null id is after all others. Empty
    tables give no rows; other columns are ignored, whatever their names.

    Every row is in a tree of bounded size; trees of one label are searched for positives. For negatives rows are dealt to cells around centres learned from a
    bounded sample, and an anchor goes only to cells whose ball can hold a score within its windows, there to trees of bounded size.
    """
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector_col).alias("raw"), v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    bad = F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = F.size("v") * F.pow(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)), 2)
    rows = raw.where(F.col("label").isNotNull() & F.col("raw").isNotNull() & ~bad).where(size < LIMIT).drop("raw")
    rows = stage(rows.withColumn("n", F.monotonically_increasing_id()))
    out = None
    for length in sorted(r[0] for r in rows.select(F.size("v")).distinct().collect()):
        part = _mine(rows.where(F.size("v") == length), positives, negatives, low, high)
        out = part if out is None else out.unionByName(part)
    return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if out is None else out


def _mine(rows: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    null, blank = (lambda *c: [F.lit(None).cast("long").alias(x) for x in c]), ["n", "id", "label", "v"]
    held = [*blank, F.lit(False).alias("q"), *null("positive", "low", "high")]
    anchors = rows.where("asks")
    # positives: trees of one label
    counted = rows.groupBy("label").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"), F.ceil(F.count_if("asks") / BLOCK).cast("int").alias("blocks")).where("blocks > 0")
    listed = rows.join(counted, "label").select(*held, _spread(F.col("parts")).alias("part"), _each(F.col("blocks")).alias("block"))
    asking = [*blank, F.lit(True).alias("q"), F.lit(None).cast("long").alias("positive"), F.lit(ANY[0]).alias("low"), F.lit(ANY[1]).alias("high")]
    asked = anchors.join(counted, "label").select(*asking, _each(F.col("parts")).alias("part"), _spread(F.col("blocks")).alias("block"))
    near = listed.unionByName(asked).groupBy("label", "part", "block").applyInArrow(_meet(positives, True), SHAPE)
    pairs = stage(_best(near, ["anchor"], positives).select("anchor", F.col("n").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # negatives: cells of rows with all labels
    total = rows.count()
    sample = bounded_sample(rows.select("n", "v"), F.col("n"), SAMPLE).select("v").toArrow().column("v")
    centres = _means(matrix(sample), max(1, min(CELLS, total // SHARD)))
    dealt = stage(rows.drop("asks").mapInArrow(_placed(centres), "n long, id long, label string, v array<double>, cell int, far double"))
    cells = dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / SHARD).cast("int").alias("parts")).collect()  # CELLS rows at most
    share = lambda c, p: F.expr(f"{c}((cast({p} as decimal(20,0)) * positive_score) / 100)").cast("long")
    windows = pairs.select("anchor", "positive", share("ceil", low).alias("low"), share("floor", high).alias("high")).where("low <= high")
    windows = windows.join(anchors.select(F.col("n").alias("anchor"), "id", "label", "v"), "anchor").withColumnRenamed("anchor", "n")
    sent = stage(windows.mapInArrow(_bounded(centres, {r.cell: r.radius for r in cells}), "n long, id long, label string, v array<double>, positive long, low long, high long, cell int"))
    blocks = sent.groupBy("cell").agg(F.ceil(F.count_distinct("n") / BLOCK).cast("int").alias("blocks"))
    many = rows.sparkSession.createDataFrame([(r.cell, r.parts) for r in cells], "cell int, parts int")
    grid = F.broadcast(many.join(blocks, "cell"))  # a row a cell
    listed = dealt.join(grid, "cell").select(*held, "cell", _spread(F.col("parts")).alias("part"), _each(F.col("blocks")).alias("block"))
    asked = sent.join(grid, "cell").select(*blank, F.lit(True).alias("q"), "positive", "low", "high", "cell", _each(F.col("parts")).alias("part"), _spread(F.col("blocks")).alias("block"))
    hard = listed.unionByName(asked).groupBy("cell", "part", "block").applyInArrow(_meet(negatives, False), SHAPE)
    best = stage(_best(hard, ["anchor", "positive"], negatives).select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))
    unstage(dealt, sent)
    found = best.join(pairs, ["anchor", "positive"]).join(anchors.select(F.col("n").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _placed(centres: np.ndarray):
    """Add each row's nearest centre and how far it is."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("v"))
            far = np.stack([((x - c) ** 2).sum(1) for c in centres], 1) if len(x) else np.zeros((0, len(centres)))
            own = far.argmin(1) if len(x) else np.zeros(0, "i8")
            out = [batch.column(c) for c in ("n", "id", "label", "v")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(own.astype("i4")), pa.array(np.sqrt(far[np.arange(len(x)), own]))], names=["n", "id", "label", "v", "cell", "far"])

    return run


def _bounded(centres: np.ndarray, radius: dict[int, float]):
    """Questions, once for each cell whose ball can hold a score within the window."""
    balls = {cell: Node(centres[cell], far, np.zeros(0, "i8")) for cell, far in radius.items()}

    def run(batches):
        for batch in batches:
            q = matrix(batch.column("v"))
            norm, low, high = np.sqrt((q * q).sum(1)), batch.column("low").to_numpy(), batch.column("high").to_numpy()
            for cell, ball in balls.items():
                least, most = ball.bounds(q, norm)
                some = pa.array(np.flatnonzero((most >= low) & (least <= high)))
                out = [batch.column(c).take(some) for c in ("n", "id", "label", "v", "positive", "low", "high")]
                yield pa.RecordBatch.from_arrays([*out, pa.array(np.full(len(some), cell, "i4"))], names=["n", "id", "label", "v", "positive", "low", "high", "cell"])

    return run
