"""Near-duplicate vectors by p-stable hashing.

Vectors are normalised, so a cosine of at least ``COSINE`` is a Euclidean distance
of at most c = sqrt(2 - 2 * COSINE).  A table concatenates k quantised random
projections floor((a.x + u) / WIDTH) with Gaussian a, which is 2-stable; vectors at
distance c share one such value with probability p(c), known in closed form.
k grows with the logarithm of the number of vectors, so that a vector meets
about a quarter of a stranger in a table, and the number of tables follows from k
for a recall of at least ``RECALL`` at the threshold itself (more above it).

Vectors that meet in a bucket are compared exactly in double precision.  A
bucket is dealt into blocks of about ``block`` vectors and every pair of blocks is
compared in a unit of its own, so no task holds a large bucket.  A pair that
already met in an earlier table is not counted again; the earlier tables' buckets
are recomputed where the pair is found.  Equal vectors are collapsed first and
counted by their number.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without an id, link with nothing; vectors of different
lengths do not link; repeated rows are vectors of their own that link with
each other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .graph import components

COSINE = 0.95
WIDTH = 2.0
RECALL = 0.95
SEED = 20


def chance(distance: float, width: float = WIDTH) -> float:
    """The probability that vectors at this distance share a quantised projection."""
    r = width / distance
    tail = math.erfc(r / math.sqrt(2))
    return 1 - tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(projections in a table, tables) for ``n`` vectors."""
    near, far = chance(math.sqrt(2 - 2 * cosine)), chance(math.sqrt(2))
    k = max(4, math.ceil(math.log(4 * max(n, 4)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near ** k))


class Tables:
    """The random projections for vectors of one length."""

    def __init__(self, d: int, k: int, tables: int):
        rng = np.random.default_rng([SEED, d])
        self.a = rng.standard_normal((d, k * tables))
        self.u = rng.uniform(0, WIDTH, k * tables)
        self.mix = rng.integers(1, 2**63, (tables, k), dtype=np.uint64) | np.uint64(1)
        self.k, self.tables, self.d = k, tables, d

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """A 64-bit bucket for each unit vector and table."""
        q = np.floor((unit @ self.a + self.u) / WIDTH).astype(np.int64).astype(np.uint64)
        q = q.reshape(len(unit), self.tables, self.k)
        h = (q * self.mix).sum(axis=2, dtype=np.uint64) + np.uint64(self.d)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))).view(np.int64)


class Drawn(dict):
    """The projections for each length, drawn when it first comes up."""

    def __init__(self, k: int, tables: int):
        super().__init__()
        self.k, self.tables = k, tables

    def __missing__(self, d: int) -> Tables:
        self[d] = Tables(d, self.k, self.tables)
        return self[d]


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _compare(side, i, j, unit, own, sig, copies, t, cosine):
    """Links of the unit of blocks i and j: (links counted here for each row,
    edges of a forest).  ``side`` is each row's block."""
    n = len(unit)
    counted = np.zeros(n, dtype=np.int64)
    linked = np.zeros((n, n), dtype=bool)
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    near = unit[left] @ unit[right].T >= cosine
    if i == j:
        near &= np.arange(n)[:, None] < np.arange(n)[None, :]
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    linked[a, b] = linked[b, a] = True
    for k in range(0, len(a), 100_000):
        x, y = a[k:k + 100_000], b[k:k + 100_000]
        new = ~(sig[x, :t] == sig[y, :t]).any(axis=1) if t else np.ones(len(x), dtype=bool)
        counted += np.bincount(x[new], weights=copies[y[new]], minlength=n).astype(np.int64)
        counted += np.bincount(y[new], weights=copies[x[new]], minlength=n).astype(np.int64)
    edges, free = [], linked.any(axis=1)
    while free.any():
        root = int(np.flatnonzero(free)[0])
        free[root] = False
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & free)
            free[front] = False
            edges += [(own[root], own[f]) for f in front]
    return counted, edges


def _links(units: DataFrame, k: int, tables: int, cosine: float) -> DataFrame:
    """(gid, links, other) from the rows of all units, sorted by unit."""
    import pyarrow as pa

    def run(batches):
        drawn = Drawn(k, tables)

        def unit_of(rows: "pa.Table"):
            at, i, j = (rows.column(c)[0].as_py() for c in ("t", "i", "j"))
            u = _unit(_matrix(rows.column("v").combine_chunks()))
            own = rows.column("gid").to_numpy()
            return own, *_compare(rows.column("side").to_numpy(), i, j, u, own, drawn[u.shape[1]].buckets(u)[:, :at],
                                  rows.column("copies").to_numpy().astype(np.float64), at, cosine)

        def out(rows):
            own, counted, edges = unit_of(rows)
            some = counted > 0
            gid = np.r_[own[some], np.array([e[0] for e in edges], dtype=np.int64)]
            links = np.r_[counted[some], np.zeros(len(edges), dtype=np.int64)]
            other = [None] * int(some.sum()) + [int(e[1]) for e in edges]
            return pa.RecordBatch.from_arrays([pa.array(gid, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64())],
                                              names=["gid", "links", "other"])

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            key = [rows.column(c).to_numpy() for c in ("t", "b", "d", "i", "j")]
            new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in key])) + 1
            cuts = [0, *new.tolist()]
            for lo, hi in zip(cuts, cuts[1:]):
                yield out(rows.slice(lo, hi - lo))
            rest = rows.slice(cuts[-1])
        if rest is not None:
            yield out(rest)

    return small_batches(units, 4096).mapInArrow(run, "gid long, links long, other long")


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 cosine: float = COSINE, block: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``."""
    import pyarrow as pa

    spark = vectors.sparkSession
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    fit = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(id_col).alias("own"),
                          F.when(fit, F.transform(v, lambda x: x.cast("double"))).alias("v"))
    keyed = rows.withColumns({"k1": F.when(F.col("v").isNotNull(), F.xxhash64("v")),
                              "k2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))})
    groups = written(keyed.where("v is not null").groupBy("k1", "k2").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
        .withColumn("gid", F.monotonically_increasing_id()), "vectors")
    n = groups.count()
    k, tables = plan(n, cosine)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    block = block or min(4096, max(256, n * tables // (8 * parts)))

    def hashed(batches):
        drawn = Drawn(k, tables)
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                b = drawn[d].buckets(_unit(_matrix(part.column("v"))))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.arange(tables, dtype=np.int32), len(b))), pa.array(b.reshape(-1)),
                    pa.array(np.full(b.size, d, dtype=np.int32)),
                    pa.array(np.repeat(part.column("gid").to_numpy(), tables))], names=["t", "b", "d", "gid"])

    met = small_batches(groups.select("gid", "v"), 4096).mapInArrow(hashed, "t int, b long, d int, gid long")
    full = met.groupBy("t", "b", "d").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("long")
    units = (met.join(full, ["t", "b", "d"])
             .withColumn("side", F.pmod(F.xxhash64("gid"), blocks))
             .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
             .select("t", "b", "d", "gid", "side", F.least("side", "with").alias("i"), F.greatest("side", "with").alias("j")))
    sent = (units.join(groups.select("gid", "copies", "v"), "gid")
            .repartition(parts, "t", "b", "d", "i", "j").sortWithinPartitions("t", "b", "d", "i", "j"))
    found = written(_links(sent, k, tables, cosine), "vector-links")
    degree = found.groupBy("gid").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("gid").alias("a"), F.col("other").alias("b")), "vector-edges")
    named = groups.select("k1", "k2", "gid", "id", "copies").join(roots.withColumnRenamed("node", "gid"), "gid", "left") \
        .join(degree, "gid", "left")
    least = named.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    each = named.join(least, "root", "left").select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("least", "id").alias("component_id"))
    return keyed.select("id", "own", "k1", "k2").join(each, ["k1", "k2"], "left").select(
        F.col("own").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        (F.col("id") == F.coalesce("component_id", "id")).alias("kept"))
