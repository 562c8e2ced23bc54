"""Hard negatives of anchors by cover trees over norm-augmented candidates.

One more component brings every candidate of a tree to the same norm, so that inner products follow distances. A
node holds a centre and the radius that covers its points; the angle between anchor and centre, widened by that of
the radius, bounds every inner product below the node from both sides. Nodes outside a window of scores are
skipped level by level; the leaves that stay are visited best first until no bound reaches the tenth score found,
and are verified by exact products.

Candidates are dealt into trees of bounded size by label and by the signs of their components, and each group of
trees meets the anchors as one stream, so that neither side is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duewise.llm.common import Workspace, table
from duewise.llm.registry import query

#: Rows of a tree, points of a leaf, children of a node, most trees that one task holds at a time, anchors per search.
TREE_ROWS, LEAF, CHILDREN, GROUP_TREES, SEARCH_ROWS = 4096, 64, 8, 16, 1024
#: Leading components whose signs place a row among the trees of its label.
SIGNS = 16
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least 30 and at most 90 hundredths of the positive's.
LEAST, MOST = 30, 90

_LONG = np.iinfo(np.int64)


@dataclass
class CoverTree:
    """Points in the order of the leaves, and nodes with parents before children."""

    ids: np.ndarray
    points: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    size: np.ndarray
    leaf: np.ndarray
    norm: float

    ARRAYS = (("ids", np.int64), ("points", np.float64), ("centre", np.int32), ("radius", np.float64), ("parent", np.int32), ("first", np.int32), ("size", np.int32), ("leaf", np.bool_))

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, seed: int = 3) -> CoverTree:
        """Halve the covering radius level by level; centres of a level lie further apart than its radius.

        A node has at most ``CHILDREN`` centres; points that they do not cover go to the nearest of them, so a
        node's own radius is measured, never assumed. A node of equal points is a leaf whatever its size.
        """
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        squares = np.einsum("ij,ij->i", points, points)
        norm = float(np.sqrt(squares.max()))
        wide = np.concatenate([points, np.sqrt(np.maximum(norm * norm - squares, 0))[:, None]], axis=1)
        rng, nodes, placed = np.random.default_rng(seed), [], []
        todo = [(np.arange(len(ids)), 0, -1, None)]
        while todo:
            own, centre, parent, level = todo.pop()
            away = _distances(wide, own, centre)
            radius, me, first = float(away.max()), len(nodes), sum(map(len, placed))
            leaf = len(own) <= LEAF or radius == 0
            nodes.append([centre, radius, parent, first, len(own), leaf])
            if leaf:
                placed.append(own)
                continue
            parts, level = _parted(wide, own, min(level or radius, radius) / 2, rng)
            todo += [(part, c, me, level) for part, c in parts]
        placed = np.concatenate(placed)
        back = np.empty(len(placed), np.int64)
        back[placed] = np.arange(len(placed))
        centre, radius, parent, first, size, leaf = (np.array(x) for x in zip(*nodes, strict=True))
        return cls(ids[placed], points[placed], back[centre].astype(np.int32), radius, parent.astype(np.int32), first.astype(np.int32), size.astype(np.int32), leaf, norm)

    def to_row(self) -> dict:
        return {n: getattr(self, n).astype(t).tobytes() for n, t in self.ARRAYS} | {"norm": self.norm}

    @classmethod
    def from_row(cls, row: dict) -> CoverTree:
        arrays = {n: np.frombuffer(row[n], t) for n, t in cls.ARRAYS}
        arrays["points"] = arrays["points"].reshape(len(arrays["ids"]), -1)
        return cls(**arrays, norm=row["norm"])

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that each anchor can have with a point of each node."""
        lengths = np.sqrt(np.einsum("ij,ij->i", anchors, anchors))
        reach = (lengths * self.norm)[:, None]
        cosine = np.divide(anchors @ self.points[self.centre].T, reach, out=np.zeros((len(anchors), len(self.centre))), where=reach > 0)
        angle = np.arccos(np.clip(cosine, -1, 1))
        spread = 2 * np.arcsin(np.clip(self.radius / (2 * self.norm), 0, 1)) if self.norm else np.zeros(len(self.radius))
        slack = 1e-6 * reach + 1
        return reach * np.cos(np.minimum(angle + spread, np.pi)) - slack, reach * np.cos(np.maximum(angle - spread, 0)) + slack

    def search(self, anchors: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor number, id and score of each anchor's best ``k`` points with low <= score <= high, other than ``own``.

        Higher scores come first, equal ones by smaller id.
        """
        anchors, points = _same_width(anchors, self.points)
        tree = self if points is self.points else CoverTree(self.ids, points, self.centre, self.radius, self.parent, self.first, self.size, self.leaf, self.norm)
        least, most = tree.bounds(anchors)
        alive = (most >= low[:, None]) & (least <= high[:, None])
        for node in range(1, len(self.parent)):
            alive[:, node] &= alive[:, self.parent[node]]
        leaves = np.flatnonzero(self.leaf)
        best = np.where(alive[:, leaves], np.minimum(most[:, leaves], high[:, None].astype(np.float64)), -np.inf)
        order = np.argsort(-best, axis=1, kind="stable")
        floor, left = low.astype(np.int64).copy(), np.arange(len(anchors))
        found = (np.zeros(0, np.int64),) * 3
        for turn in range(len(leaves)):
            at = order[left, turn]
            going = best[left, at] >= floor[left]
            left, at = left[going], at[going]
            if not len(left):
                break
            new = [found]
            for place in np.unique(at):
                who = left[at == place]
                a = self.first[leaves[place]]
                b = a + self.size[leaves[place]]
                scores = _products(anchors[who], points[a:b])
                good = (scores >= floor[who, None]) & (scores <= high[who, None]) & (self.ids[a:b] != own[who, None])
                q, p = np.nonzero(good)
                new.append((who[q], self.ids[a:b][p], scores[q, p]))
            if len(new) > 1:
                found = _best_of(*(np.concatenate(x) for x in zip(*new, strict=True)), k)
                count = np.bincount(found[0], minlength=len(anchors))
                full = np.flatnonzero(count >= k)
                last = np.cumsum(count)[full] - 1
                floor[full] = found[2][last]
        return found


def _distances(wide: np.ndarray, own: np.ndarray, centre: int) -> np.ndarray:
    apart = wide[own] - wide[centre]
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


def _parted(wide: np.ndarray, own: np.ndarray, level: float, rng: np.random.Generator) -> tuple[list[tuple[np.ndarray, int]], float]:
    """Points by the nearest of the centres of a level, the level halved until there are two centres or more."""
    shuffled = own[rng.permutation(len(own))]
    first = int(shuffled[0])
    nearest, away = np.full(len(own), first), _distances(wide, own, first)
    while not (away > level).any():
        level /= 2
    chosen = 1
    while chosen < CHILDREN and (away > level).any():
        # The next centre is any point that the level does not cover yet.
        open_points = own[away > level]
        centre = int(open_points[rng.integers(len(open_points))])
        new = _distances(wide, own, centre)
        closer = new < away
        nearest[closer], away = centre, np.minimum(away, new)
        chosen += 1
    return [(own[nearest == c], int(c)) for c in np.unique(nearest)], level


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many components: missing ones are zero."""
    width = max(a.shape[1], b.shape[1])
    fill = lambda x: x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
    return fill(a), fill(b)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits they stop at the ends of the range."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a) @ whole(b).T
    return np.array([[max(_LONG.min, min(_LONG.max, x)) for x in row] for row in exact], np.int64).reshape(len(a), len(b))


def _best_of(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each anchor, by falling score and rising id; ``~`` turns the order of longs around."""
    order = np.lexsort((ids, ~scores, who))
    who, ids, scores = who[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
    place = np.arange(len(who)) - np.repeat(starts, np.diff(np.append(starts, len(who))))
    keep = place < k
    return who[keep], ids[keep], scores[keep]


def labelled_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, q: the rows that take part, one for each vec_id, with whole-number components."""
    x = F.col("embedding")
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    usable = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(~broken)
    rows = usable.select(
        F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("double")).alias("q"),
    )
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")


_TREE_FIELDS = ", ".join(f"{n} binary" for n, _ in CoverTree.ARRAYS) + ", norm double"


def build_trees(vectors: DataFrame, ws: Workspace) -> DataFrame:
    """One row per cover tree: label, block and the arrays of the tree.

    Rows of a label are laid out by the signs of their first components and cut every ``TREE_ROWS`` places; rows of
    equal signs, however many, take places by the hash of their id, so no tree grows with a group.
    """
    code = sum((F.when(F.coalesce(F.get("q", F.lit(j)), F.lit(0.0)) >= 0, 1 << j).otherwise(0) for j in range(SIGNS)), F.lit(0))
    coded = vectors.withColumn("code", code)
    before = W.partitionBy("label").orderBy("code").rowsBetween(W.unboundedPreceding, -1)
    cells = coded.groupBy("label", "code").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = F.col("before") + F.pmod(F.xxhash64("vec_id"), "n")
    placed = coded.join(cells, ["label", "code"]).select("label", F.floor(place / TREE_ROWS).cast("long").alias("block"), "vec_id", "q")

    def build(rows: pa.Table) -> pa.Table:
        ids = rows.column("vec_id").to_numpy()
        tree = CoverTree.build(ids, _matrix(rows.column("q").combine_chunks()))
        return pa.Table.from_pylist([{"label": rows.column("label")[0].as_py(), "block": rows.column("block")[0].as_py(), **tree.to_row()}])

    return ws.stage(placed.groupBy("label", "block").applyInArrow(build, f"label long, block long, {_TREE_FIELDS}"), "trees")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal width from lists of numbers; missing components are zero."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    ends = lists.offsets.to_numpy()
    flat, sizes = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def search_trees(trees: DataFrame, anchors: DataFrame, same_label: bool, k: int) -> DataFrame:
    """anchor_id, goal, id, score: each goal's best ``k`` of every tree of the anchor's label, or of the other labels.

    ``anchors`` has anchor_id, label, q and goals, an array of positive scores; a goal's window of scores follows
    from it, and null has none. Anchors are copied once per group of trees, not per tree; a group's trees come
    first in its stream and its anchors follow in Arrow batches.
    """
    spark = trees.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-trees.count() // GROUP_TREES), min(parts, trees.count()))
    fields = [n for n, _ in CoverTree.ARRAYS]
    left = trees.select(F.pmod(F.xxhash64("label", "block"), F.lit(groups)).alias("group"), F.lit(0).alias("kind"), "label", *fields, "norm")
    right = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), F.lit(1).alias("kind"), "label", "anchor_id", "q", "goals")
    both = left.unionByName(right, allowMissingColumns=True).repartition(groups, "group").sortWithinPartitions("group", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            numbers, kinds = batch.column("group").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
                if numbers[a] != group:
                    held, group = [], numbers[a]
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held += [(row["label"], CoverTree.from_row(row)) for row in part.select(["label", *fields, "norm"]).to_pylist()]
                    continue
                for c in range(0, part.num_rows, SEARCH_ROWS):
                    yield from _answers(held, part.slice(c, SEARCH_ROWS), same_label, k)

    return both.mapInArrow(run, "anchor_id long, goal int, id long, score long")


def _answers(held: list, part: pa.RecordBatch, same_label: bool, k: int) -> Iterator[pa.RecordBatch]:
    ids, labels, vectors = part.column("anchor_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("q"))
    asked = [(i, g, *_window(score)) for i, goals in enumerate(part.column("goals").to_pylist()) for g, score in enumerate(goals)]
    if not asked:
        return
    who, goal = np.array([x[0] for x in asked]), np.array([x[1] for x in asked], np.int32)
    low, high = np.array([x[2] for x in asked], np.int64), np.array([x[3] for x in asked], np.int64)
    for label, tree in held:
        some = np.flatnonzero((labels[who] == label) == same_label)
        if len(some):
            q, found, scores = tree.search(vectors[who[some]], ids[who[some]], low[some], high[some], k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[who[some]][q]), pa.array(goal[some][q]), pa.array(found), pa.array(scores)], names=["anchor_id", "goal", "id", "score"])


def _window(positive: int | None) -> tuple[int, int]:
    return (_LONG.min, _LONG.max) if positive is None else (-(-LEAST * positive // 100), MOST * positive // 100)


def mine(embeddings: DataFrame, anchors: DataFrame, ws: Workspace, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the ``anchors`` (vec_id).

    Rows with a null vec_id take no part, nor do those with a null label, a null vector or a component that is null
    or not finite. Of rows that repeat a vec_id, the one of the least label and vector counts. Vectors of different
    lengths are compared with missing components as zero; scores beyond 64 bits stop at the ends of the range. Only
    vec_id, embedding and label are read, so further columns may have any name. Equal vectors, however many, are
    dealt over trees. An empty table, anchors that do not take part and labels of one row give no rows.
    """
    vectors = ws.stage(labelled_vectors(embeddings), "vectors")
    trees = build_trees(vectors, ws)
    wanted = vectors.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi").withColumnRenamed("vec_id", "anchor_id")
    first = search_trees(trees, wanted.withColumn("goals", F.array(F.lit(None).cast("long"))), True, positives)
    by_score = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = first.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= positives)
    chosen = ws.stage(near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("positives")), "positives")
    queries = wanted.join(chosen, "anchor_id").select("anchor_id", "label", "q", F.col("positives.score").alias("goals"))
    second = search_trees(trees, queries, False, negatives)
    order = W.partitionBy("anchor_id", "goal").orderBy(F.desc("score"), "id")
    ranked = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    positive = F.get("positives", F.col("goal"))
    return ranked.join(chosen, "anchor_id").select(
        "anchor_id", positive["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )


ORACLE = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as q
    from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
    select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
    from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
    select anchor_id, id as positive_id, score as positive_score from pairs where same
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.id)::int as rank,
    n.id as negative_id, p.positive_score, n.score as negative_score
from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same
where 30 * p.positive_score <= 100 * n.score and 100 * n.score <= 90 * p.positive_score
qualify rank <= 10
"""


@query("op12_hard_negatives", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100, against all rows."""
    embeddings = table(spark, sf_dir, "embeddings")
    return mine(embeddings, embeddings.where(F.col("vec_id") % 100 == 0), Workspace(spark, "hard-negatives"))
