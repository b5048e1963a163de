"""Hard negatives: best-first search in R-trees packed by sort-tile-recursive.

Rows are dealt into tiles of about ``TILE`` rows by ranges of their first
coordinates (the first sort of the packing, done by Spark), anchors into blocks;
a unit compares one block with one tile, so memory is bounded by their sizes
and the stated queries meet all rows.  In a unit the rows of each label and
length are packed into a tree: they are sorted by one coordinate after another and cut
into slabs, the leaves hold up to ``LEAF`` rows, and every node keeps its minimum
bounding box.  A box and an anchor give an interval for each coordinate's
product and, summed, for the score.  A queue pops the box with the highest
upper end; boxes outside every window of scores still wanted, or strictly below
the kth score found in it, are left out.  A unit's first rows are merged with
the other units' by a ranking that keeps only the first k of each anchor.

Components become floor(256 * x) and scores are exact: in doubles while all sums
stay below 2^53, in Python integers beyond.

Defined results: rows with a null id, label or vector, or with a null, non-finite
or (after scaling) infinite component take no part; rows equal in id, label and
vector count once; other rows with one id are rows of their own, ties between
them go by a hash of label and vector; vectors of different lengths never meet, an empty
vector scores 0; a score outside 64 bits counts as the nearest long; an anchor
without positives, or a positive without a negative in its window, gives
no rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written

SCALE, ANCHOR_EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
TILE, BLOCK, LEAF, FANOUT = 8192, 8192, 128, 16
PARTITIONS = 4096  # of a comparison, at most


def pages(x: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Sort-tile-recursive: row numbers of ``x`` in pages of at most ``leaf`` rows."""
    d = x.shape[1]

    def cut(rows, dim):
        n = math.ceil(len(rows) / leaf)
        if n <= 1 or dim == d:
            return [rows[k : k + leaf] for k in range(0, len(rows), leaf)]
        slabs = math.ceil(n ** (1 / (d - dim)))
        rows = rows[np.argsort(x[rows, dim], kind="stable")]
        size = leaf * math.ceil(n / slabs)
        return [page for k in range(0, len(rows), size) for page in cut(rows[k : k + size], dim + 1)]

    return cut(np.arange(len(x)), 0)


class Tree:
    """A packed R-tree; nodes are numbered from the leaves up, the root comes last."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, marks: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        got = pages(x, leaf)
        self.leaves = [(x[p], ids[p], marks[p]) for p in got]
        low = np.array([x[p].min(axis=0) for p in got]).reshape(len(got), x.shape[1])
        high = np.array([x[p].max(axis=0) for p in got]).reshape(len(got), x.shape[1])
        self.low, self.high = [low], [high]
        self.children: list[range] = [range(0)] * len(got)
        start, n = 0, len(got)
        while n > 1:
            groups = [range(k, min(k + fanout, n)) for k in range(0, n, fanout)]
            low = np.array([low[g.start : g.stop].min(axis=0) for g in groups])
            high = np.array([high[g.start : g.stop].max(axis=0) for g in groups])
            self.low.append(low)
            self.high.append(high)
            self.children += [range(start + g.start, start + g.stop) for g in groups]
            start, n = start + n, len(groups)
        self.low, self.high = np.concatenate(self.low), np.concatenate(self.high)
        self.root = len(self.children) - 1

    def bounds(self, nodes: range, up: np.ndarray, down: np.ndarray):
        """Lower and upper ends of the scores in each node for an anchor's parts above and below 0."""
        low, high = self.low[nodes.start : nodes.stop], self.high[nodes.start : nodes.stop]
        return low @ up + high @ down, high @ up + low @ down


class Best:
    """The first ``k`` scores between ``low`` and ``high``; ties by id, then by mark."""

    __slots__ = ("low", "high", "k", "rows")

    def __init__(self, low, high, k: int):
        self.low, self.high, self.k = low, high, k
        self.rows: list[tuple] = []

    def least(self):
        """No score below this can come in."""
        return max(self.low, -self.rows[-1][0]) if len(self.rows) == self.k else self.low

    def wants(self, low, high) -> bool:
        return low <= self.high and high >= self.least()

    def add(self, rows: list[tuple]) -> None:
        self.rows = sorted(self.rows + rows)[: self.k]


def search(trees: list[Tree], q: np.ndarray, wanted: list[Best], own: tuple | None = None) -> None:
    """Fills ``wanted`` with the best rows of all trees; ``own`` (id, mark) is left out."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    queue: list[tuple] = []

    def push(t, nodes):
        low, high = trees[t].bounds(nodes, up, down)
        for node, a, b in zip(nodes, low.tolist(), high.tolist()):
            if any(w.wants(a, b) for w in wanted):
                heapq.heappush(queue, (-b, t, node, a))

    for t, tree in enumerate(trees):
        push(t, range(tree.root, tree.root + 1))
    while queue:
        high, t, node, low = heapq.heappop(queue)
        if not any(w.wants(low, -high) for w in wanted):
            continue
        tree = trees[t]
        if tree.children[node]:
            push(t, tree.children[node])
            continue
        x, ids, marks = tree.leaves[node]
        scores = x @ q
        if scores.dtype == object:
            scores = np.array([_whole(s) for s in scores], dtype=object)
        at = np.flatnonzero((scores >= min(w.least() for w in wanted)) & (scores <= max(w.high for w in wanted)))
        rows = [(-s, i, m) for s, i, m in zip(scores[at].tolist(), ids[at].tolist(), marks[at].tolist())]
        if own is not None:
            rows = [r for r in rows if r[1:] != own]
        for w in wanted:
            least = w.least()
            if got := [r for r in rows if least <= -r[0] <= w.high]:
                w.add(got)


def _matrices(table) -> dict[int, tuple]:
    """{length: (scaled rows, row numbers)} of an Arrow table's ``embedding``."""
    out = {}
    column = table.column("embedding").combine_chunks()
    offsets = column.offsets.to_numpy()
    values = np.floor(SCALE * column.values.to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = np.diff(offsets)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        out[d] = values[offsets[at][:, None] + np.arange(d)], at
    return out


def _scaled(x: np.ndarray, y: np.ndarray):
    """The matrices as doubles where all sums of products are exact, else as Python integers."""
    top = (np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    if max(1.0, top[0]) * max(1.0, top[1]) * max(1, x.shape[1]) < 2**53 / 100:
        return x, y
    return tuple(np.array([[int(v) for v in row] for row in m.tolist()], dtype=object).reshape(m.shape) for m in (x, y))


def _whole(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, int(score)))


def _compare(anchors, rows, wants) -> list[tuple]:
    """Rows found in one unit.  ``wants`` maps (anchor's place, its label) to
    (whether rows of the anchor's label are searched, the list of ``Best``)."""
    mine, theirs = _matrices(anchors), _matrices(rows)
    out = []
    ids, marks, labels = (anchors.column(c).to_numpy() for c in ("vec_id", "mark", "label"))
    row_ids, row_marks, row_labels = (rows.column(c).to_numpy() for c in ("vec_id", "mark", "label"))
    for d in mine.keys() & theirs.keys():
        (q, q_at), (x, x_at) = mine[d], theirs[d]
        q, x = _scaled(q, x)
        trees = {}
        for label in np.unique(row_labels[x_at]).tolist():
            at = row_labels[x_at] == label
            trees[label] = Tree(x[at], row_ids[x_at[at]], row_marks[x_at[at]])
        for v, at in zip(q, q_at.tolist()):
            label = int(labels[at])
            same, wanted = wants(at)
            chosen = [t for k, t in trees.items() if (k == label) == same]
            own = (int(ids[at]), int(marks[at]))
            search(chosen, v, wanted, own if same else None)
            out += [(*own, k, i, m, -s) for k, w in enumerate(wanted) for s, i, m in w.rows]
    return out


FOUND = "vec_id long, mark long, place int, found_id long, found_mark long, score long"


def _found(rows: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*rows)) if rows else [()] * 6
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    cols = [*cols[:5], [int(s) for s in cols[5]]]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)],
                    names=["vec_id", "mark", "place", "found_id", "found_mark", "score"])


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, tiles: int, work) -> DataFrame:
    """``work`` on every block of anchors with every tile of rows."""
    ship(rows.sparkSession)
    n = min(blocks * tiles, PARTITIONS)
    left = anchors.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).repartition(n, "block", "tile")
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(n, "block", "tile")
    return left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(work, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("vec_id", "mark", "place").orderBy(F.desc("score"), "found_id", "found_mark")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def relabelled(embeddings: DataFrame) -> DataFrame:
    """Labels moved on by one where the id is divisible by 7."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", label.alias("label"), "embedding")


def mine(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         every: int = ANCHOR_EVERY, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """Hard negatives of ``vectors`` (vec_id, label, embedding) for the anchors, the
    rows whose id is divisible by ``every``."""
    scaled = F.lit(SCALE) * F.col("v").cast("double")
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(F.lit(SCALE) * v.cast("double")) == float("inf")))
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding") \
        .where("vec_id is not null and label is not null and embedding is not null").where(~odd) \
        .dropDuplicates().withColumn("mark", F.xxhash64("label", "embedding"))
    clean = written(clean, "negatives-rows")
    sizes = clean.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    tiles, blocks = max(1, -(-sizes[0] // tile)), max(1, -(-sizes[1] // block))
    rows = written(clean.repartitionByRange(tiles, F.get("embedding", F.lit(0)), F.get("embedding", F.lit(1)), "vec_id", "mark")
                   .withColumn("tile", F.spark_partition_id()), "negatives-tiles")
    # columns of their own, as anchors meet the rows they come from
    anchors = rows.toDF(*rows.columns).where(F.col("vec_id") % every == 0).drop("tile") \
        .withColumn("block", F.pmod(F.xxhash64("vec_id", "mark"), F.lit(blocks)).cast("int"))

    def near(left, right):
        if not len(left) or not len(right):
            return _found([])
        return _found(_compare(left, right, lambda at: (True, [Best(-math.inf, math.inf, positives)])))

    best = _first(_met(anchors, rows, blocks, tiles, near), positives).select(
        "vec_id", "mark", "rank", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = written(best, "negatives-positives")
    bounds = best.groupBy("vec_id", "mark").agg(
        F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("wanted"))  # at most ``positives``

    def far(left, right):
        if not len(left) or not len(right):
            return _found([])
        wanted = left.column("wanted").to_pylist()

        def windows(at):
            scores = [w["positive_score"] for w in wanted[at]]
            return False, [Best(-(-low * s // 100), high * s // 100, negatives) for s in scores]

        got = _compare(left, right, windows)
        return _found([(i, m, wanted_rank + 1, *rest) for i, m, wanted_rank, *rest in got])

    found = _first(_met(anchors.join(bounds, ["vec_id", "mark"]), rows, blocks, tiles, far), negatives)
    return found.join(best.withColumnRenamed("rank", "place"), ["vec_id", "mark", "place"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = f"""
WITH scaled AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM scaled a JOIN scaled b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
