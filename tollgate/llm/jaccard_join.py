"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set is its distinct ``SHINGLE``-word shingles, as 64-bit hashes; two
sets link when 100 * intersection >= 75 * union, that is when they share at least
T = ceil(3 (|A| + |B|) / 7) shingles.  An inverted list holds the documents of one
shingle.  A document that occurs T times in the lists of a query occurs at least
T - L times in all but the L longest of them; so the short lists are merged for
candidates and the long ones only probed.

Across the cluster the short lists are those of the |A| - ceil(3 |A| / 4) + 1
rarest shingles of each set, by one order of all shingles.  A first pass counts
all shingles of all texts; the ``FREQUENT`` most frequent come last in the order,
by their counts, the others go by hash.  The order decides only how much work
there is, not the result.  Spark merges these lists:

1. Equal sets are one node.  Shingles in one short list only are dropped where
   they meet; what is left are rows (shingle, node) of lists of two and more.
2. In each list all nodes pair with one, so a group of k similar sets gives about
   k pairs and not k squared.  It is the node with the fewest rarer shingles: an
   edited copy holds shingles of its own, the text it was made from none, so
   copies that do not link with each other meet in it.  Pairs that share enough
   short lists are searched, and the links found joined into components.  While
   the lists left hold over ``DENSE`` pairs of components a row, they go through
   this again with another node, up to ``STARS`` times.
3. Nodes of *different* components that share a short list are paired, through
   (shingle, component) groups so that no pair inside a component is made.  The
   rarest shingle that linked sets share has T - 1 more behind it in both, so
   only lists with T places left in both sets pair them.  All these pairs are
   searched.  After this every link lies inside a component, which is all that
   components need.

The search takes one query set and a block of at most ``BLOCK`` others in a task,
builds the inverted lists of the block, merges the short ones by a heap and
probes the long ones by binary search.

Defined results: a null text, or one without words, has an empty set and links
with nothing; fewer words than a shingle are one shingle, the whole sequence;
rows without an id link with nothing; rows that repeat an id are documents of
their own under that id; other columns are ignored (``link``) or carried
(``keep_one``, ``keep_first``); an empty table gives an empty result.  Sets are compared by
64-bit hashes.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLD, discard, released, small_batches, written
from .graph import components

SHINGLE = 5
BLOCK = 256
#: How many of the most frequent shingles the order knows, and from which count.
FREQUENT, LEAST = 1 << 20, 4
#: Shingles that a task counts or packs together.
CHUNK = 250_000
#: Bytes of all texts for each target that the shingles are dealt to by hash; a task
#: holds one target at a time.
TARGET = 16 << 20
#: How often lists pair with one of their nodes before all pairs are made, and
#: from how many pairs of components a row again.  Neither changes the result.
STARS, DENSE = 4, 16
#: Bytes of text hashed together (a longer text alone): the sums and powers of a
#: piece take some 80 times as much in a worker.
PIECE = 1 << 18
#: Bytes of an Arrow batch here: packed blocks are held by Spark, as a batch and as rows.
BATCH = 4 << 20
#: Shares of a target that are counted one after another.
SHARES = 16
#: Cells of the table of wanted ids; it drops most other texts before they are
#: read again, and its size is fixed.
CELLS = 1 << 22
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class TextSets:
    """The sets of texts.  Words are hashed without being cut out: with powers of
    an odd number as weights, a word's sum of weighted bytes is a difference of
    running sums, and multiplied by the inverse power of its start it does not
    depend on its place."""

    def __init__(self):
        rng = np.random.default_rng(5)
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.blank = np.zeros(256, dtype=bool)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True
        self.value[self.blank] = 0
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted hashes of each text's distinct shingles."""
        out, piece, size = [], [], 0
        for t in texts:
            raw = t.encode("utf-8", "surrogatepass") if t else b""
            if piece and size + len(raw) > PIECE:
                out += self._piece(piece)
                piece, size = [], 0
            piece.append(raw)
            size += len(raw) + 1
        return out + (self._piece(piece) if piece else [])

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of every word of a text that ends with a blank."""
        a = np.frombuffer(raw, dtype=np.uint8)
        if len(a) > len(self.power):
            n = 1 << max(16, (len(a) - 1).bit_length())
            self.power, self.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, dtype=np.uint64)])
                                        for x in (_P, np.uint64(pow(int(_P), -1, 1 << 64))))
        blank = self.blank[a]
        edge = np.flatnonzero(np.r_[True, blank[:-1]] != blank)  # starts and ends in turn
        start, end = edge[::2], edge[1::2]
        sums = np.cumsum(self.value[a] * self.power[:len(a)])
        before = np.where(start > 0, sums[start - 1], np.uint64(0))
        h = (sums[end - 1] - before) * self.inverse[start]
        h = (h ^ (h >> np.uint64(32))) * _Q
        return h ^ (h >> np.uint64(29)), start, end

    def _piece(self, raws: list[bytes]) -> list[np.ndarray]:
        h, start, _ = self.words((b" ".join(raws) + b" ").translate(FOLD))
        stops = np.cumsum([len(r) + 1 for r in raws])
        cuts = np.r_[0, np.searchsorted(start, stops)]
        n = len(h) - SHINGLE + 1
        s = self._mixed(h, SHINGLE) if n > 0 else h[:0]
        out = []
        for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
            x = np.sort(s[lo:hi - SHINGLE + 1] if hi - lo >= SHINGLE else self._mixed(h[lo:hi], hi - lo))
            out.append(x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x)
        return out

    @staticmethod
    def _mixed(h: np.ndarray, width: int) -> np.ndarray:
        """The hash of each stretch of ``width`` words."""
        if not width:
            return h
        n = len(h) - width + 1
        s = h[:n] + np.uint64(width)
        for k in range(1, width):
            s = (s ^ (s >> np.uint64(29))) * _P + h[k:k + n]
        s = (s ^ (s >> np.uint64(32))) * _Q
        return s ^ (s >> np.uint64(32))


def node_of(s: np.ndarray) -> int:
    """One 64-bit hash of a whole set."""
    x = (s ^ (s >> np.uint64(31))) * _P
    h = int(x.sum(dtype=np.uint64)) ^ (len(s) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ h >> 29) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
    return (h ^ h >> 32) - (1 << 63)


def overlap(a: Column, b: Column) -> Column:
    """T: the shingles that sets of these sizes must share."""
    return F.ceil((a + b) * 3 / F.lit(7)).cast("long")


def _short(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def enough(a: Column, b: Column) -> Column:
    """T - L: the short lists that linked sets of these sizes share at least;
    L is the number of other lists of the larger set."""
    rest = F.ceil(F.greatest(a, b) * 3 / F.lit(4)) - 1
    return F.greatest(F.lit(1), overlap(a, b) - rest)


def sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 4 >= F.greatest(a, b) * 3


# ---------------------------------------------------------------------------
# The search in one block
# ---------------------------------------------------------------------------


def divide_skip(lists: list[np.ndarray], needed: np.ndarray) -> np.ndarray:
    """How often each record occurs in the lists, for records that reach their
    ``needed`` count (0 for the others).  A list holds record numbers in order."""
    out = np.zeros(len(needed), dtype=np.int64)
    least = int(needed.min())
    if len(lists) < least:
        return out
    lists = sorted(lists, key=len)
    # the usual choice of L: the longer the longest list, the fewer are skipped
    longest = max(2, len(lists[-1])) if lists else 2
    skip = min(least - 1, int(least / (0.0085 * math.log2(longest) + 1)))
    short, long = lists[:len(lists) - skip], lists[len(lists) - skip:]
    count = np.zeros(len(needed), dtype=np.int64)
    for record in heapq.merge(*(x.tolist() for x in short)):
        count[record] += 1
    found = np.flatnonzero((count > 0) & (count >= needed - skip))
    total = count[found]
    for x in long:
        at = np.searchsorted(x, found)
        total += x[np.minimum(at, len(x) - 1)] == found
    reached = total >= needed[found]
    out[found[reached]] = total[reached]
    return out


def search(query: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which of the sets link with the query set."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    needed = -(-3 * (len(query) + sizes) // 7)
    record = np.repeat(np.arange(len(sets)), sizes)
    h = np.concatenate(sets)
    order = np.argsort(h, kind="stable")  # records of one shingle stay in order
    h, record = h[order], record[order]
    lo, hi = np.searchsorted(h, query, "left"), np.searchsorted(h, query, "right")
    return divide_skip([record[a:b] for a, b in zip(lo.tolist(), hi.tolist()) if b > a], needed) > 0


# ---------------------------------------------------------------------------
# The passes over the texts
# ---------------------------------------------------------------------------


def _key(h: np.ndarray, parts: int) -> np.ndarray:
    """What the counts know a shingle by: its target and upper half."""
    return (h >> np.uint64(32)) << np.uint64(31) | h % np.uint64(parts)


def _dealt(at: np.ndarray, parts: int, *columns: np.ndarray):
    """(target, the columns' rows for it) for each target."""
    order = np.argsort(at.astype(np.uint16) if parts <= 1 << 16 else at, kind="stable")
    at = at[order]
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
    moved = [c[order] for c in columns]
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):
        yield int(at[a]), [c[a:b] for c in moved]


def _shares(single: list[np.ndarray], many: list[np.ndarray]):
    """(shingles found once, those found more often, their counts) of a target's blocks, a
    range of the shingles at a time; blocks hold them in order."""
    edges = np.arange(1, SHARES, dtype=np.uint64) * np.uint64((1 << 32) // SHARES)
    cuts = [np.r_[0, np.searchsorted(x, edges.astype("<u4")), len(x)] for x in single]
    more = [np.r_[0, np.searchsorted(m[0], edges.astype("<u4")), m.shape[1]] for m in many]
    none = np.empty(0, "<u4")
    for k in range(SHARES):
        yield (np.concatenate([none, *(x[c[k]:c[k + 1]] for x, c in zip(single, cuts))]),
               np.concatenate([none, *(m[0, c[k]:c[k + 1]] for m, c in zip(many, more))]),
               np.concatenate([none, *(m[1, c[k]:c[k + 1]] for m, c in zip(many, more))]))


def counts_of(once: np.ndarray, often: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, count) of those found ``LEAST`` times in all."""
    x = np.concatenate([once, often])
    c = np.concatenate([np.ones(len(once), dtype=np.int64), c.astype(np.int64)])
    order = np.argsort(x, kind="stable")
    x, c = x[order], c[order]
    cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    c = np.add.reduceat(c, cut) if len(x) else c
    some = c >= LEAST
    return x[cut][some], c[some]


def _targets(docs: DataFrame) -> int:
    """How many targets shingles are dealt to: in proportion to the texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(parts, -(-size // TARGET))


def _in_turn(blocks: DataFrame) -> DataFrame:
    """Blocks dealt by target; a task gets its targets one after another."""
    return blocks.repartition("at").sortWithinPartitions("at")


def _first_pass(docs: DataFrame, parts: int) -> DataFrame:
    """Rows with an id or without: (id, set size n, node) of each text; and with
    ``key``: the count n of each shingle found at least ``LEAST`` times.

    A task counts its own shingles and sends each target one packed block of those
    found once (their upper halves) and one of those found more often, so a very
    frequent shingle is a pair of numbers from each task."""
    import pyarrow as pa

    kind = docs.schema["id"].dataType.simpleString()

    def sent(batches):
        sets, seen, kept, held = TextSets(), set(), [], 0

        def rows(at, ids=None, n=None, node=None, once=None, often=None):
            nulls = lambda t: pa.nulls(len(at), t)
            return pa.RecordBatch.from_arrays([
                pa.array(at, pa.int32()), nulls(arrow) if ids is None else ids,
                nulls(pa.int64()) if n is None else pa.array(n, pa.int64()),
                nulls(pa.int64()) if node is None else pa.array(node, pa.int64()),
                nulls(pa.binary()) if once is None else pa.array(once, pa.binary()),
                nulls(pa.binary()) if often is None else pa.array(often, pa.binary())],
                names=["at", "id", "n", "node", "once", "often"])

        def counted():
            h = np.sort(np.concatenate(kept))
            cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            c = np.diff(np.r_[cut, len(h)]).astype("<u4")
            h = h[cut]
            at, upper = (h % np.uint64(parts)).astype(np.int64), (h >> np.uint64(32)).astype("<u4")
            one = c == 1
            got = [(k, x.tobytes()) for k, (x,) in _dealt(at[one], parts, upper[one])]
            yield rows([k for k, _ in got], once=[x for _, x in got])
            got = [(k, np.concatenate([x, y]).tobytes()) for k, (x, y) in _dealt(at[~one], parts, upper[~one], c[~one])]
            yield rows([k for k, _ in got], often=[x for _, x in got])

        turn = 0
        for batch in batches:
            arrow = batch.column("id").type
            found = sets.of(batch.column("text").to_pylist())
            nodes = [node_of(x) if len(x) else None for x in found]
            for x, node in zip(found, nodes):
                if node is not None and node not in seen:
                    seen.add(node)
                    kept.append(x)
                    held += len(x)
            turn += 1
            first = (nodes[0] or 0) + turn
            yield rows([(first + k) % parts for k in range(len(nodes))], batch.column("id"), [len(x) for x in found], nodes)
            if held > CHUNK:
                yield from counted()
                seen, kept, held = set(), [], 0
        if kept:
            yield from counted()

    def totals(at, single, many, arrow):
        found = [counts_of(x, upper, c) for x, upper, c in _shares(single, many)]
        key = np.concatenate([x for x, _ in found]).astype(np.int64) << 31 | at
        return pa.RecordBatch.from_arrays([pa.nulls(len(key), arrow), pa.array(np.concatenate([c for _, c in found])),
                                           pa.nulls(len(key), pa.int64()), pa.array(key)], names=["id", "n", "node", "key"])

    def summed(batches):
        now, single, many = None, [], []
        for batch in batches:
            plain = batch.filter(pa.array([a is None and b is None for a, b in zip(
                batch.column("once").to_pylist(), batch.column("often").to_pylist())], pa.bool_()))
            yield pa.RecordBatch.from_arrays([plain.column(c) for c in ("id", "n", "node")] + [pa.nulls(plain.num_rows, pa.int64())],
                                             names=["id", "n", "node", "key"])
            arrow = batch.column("id").type
            for at, a, b in zip(*(batch.column(c).to_pylist() for c in ("at", "once", "often"))):
                if a is None and b is None:
                    continue
                if at != now and (single or many):
                    yield totals(now, single, many, arrow)
                    single, many = [], []
                now = at
                if a is not None:
                    single.append(np.frombuffer(a, "<u4"))
                else:
                    many.append(np.frombuffer(b, "<u4").reshape(2, -1))
        if single or many:
            yield totals(now, single, many, arrow)

    blocks = small_batches(docs, 512, BATCH).mapInArrow(released(sent), f"at int, id {kind}, n long, node long, once binary, often binary")
    return _in_turn(blocks).mapInArrow(released(summed), f"id {kind}, n long, node long, key long")


def _frequent(first: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, counts) of the ``FREQUENT`` most frequent shingles."""
    top = first.where("key is not null").select("key", "n").orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    key, c = top.column("key").to_numpy().astype(np.uint64), top.column("n").to_numpy().astype(np.int64)
    order = np.argsort(key)
    return key[order], c[order]


def _short_lists(docs: DataFrame, frequent, parts: int) -> DataFrame:
    """(shingle, node, n, i): the rows of all short lists of two nodes and more;
    i is the shingle's place in the order of the node's set.

    Rows travel in packed blocks, one for each target and task, so that the many
    shingles that occur once cost little.  A frequent shingle is known to be kept:
    its rows stay in the blocks of the task that made them and are never brought
    together here."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # bounded by FREQUENT

    def block(got, known):
        return pa.RecordBatch.from_arrays([
            pa.array([k for k, _ in got], pa.int32()), pa.array([known] * len(got), pa.bool_()),
            *(pa.array([c[x].tobytes() for _, c in got], pa.binary()) for x in range(4))],
            names=["at", "known", "h", "node", "n", "i"])

    def make(batches):
        keys, counts = shared.value
        likely = np.zeros(1 << 22, dtype=bool)
        likely[(keys >> np.uint64(41)).astype(np.int64)] = True  # the upper 22 bits of the shingle
        sets, seen, rare, known, held, turn = TextSets(), set(), [], [], 0, 0

        def flush():
            for rows, is_known in ((rare, False), (known, True)):
                if rows:
                    sizes = [len(r[0]) for r in rows]
                    h = np.concatenate([r[0] for r in rows])
                    node = np.repeat(np.array([r[1] for r in rows], dtype=np.int64), sizes)
                    n = np.repeat(np.array([r[2] for r in rows], dtype="<u4"), sizes)
                    i = np.concatenate([np.arange(r[3], r[3] + k, dtype="<u4") for r, k in zip(rows, sizes)])
                    if is_known:
                        yield block([(turn % parts, [h, node, n, i])], True)
                    else:
                        yield block(list(_dealt((h % np.uint64(parts)).astype(np.int64), parts, h, node, n, i)), False)
                rows.clear()

        for batch in batches:
            for s in sets.of(batch.column("text").to_pylist()):
                node = node_of(s) if len(s) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                turn = turn or node % (1 << 31) + 1
                p = _short(len(s))
                maybe = np.flatnonzero(likely[(s >> np.uint64(42)).astype(np.int64)])
                often = np.zeros(len(s), dtype=bool)
                if len(maybe):
                    key = _key(s[maybe], parts)
                    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    hit = keys[place] == key
                    often[maybe[hit]] = True
                few = s[~often][:p].copy()  # not a view of the whole set
                rare.append((few, node, len(s), 0))
                if len(few) < p:
                    more = s[often][np.argsort(counts[place[hit]], kind="stable")][:p - len(few)]
                    known.append((more, node, len(s), len(few)))
                held += p
            if held > CHUNK:
                yield from flush()
                held, turn = 0, turn + 1
                if len(seen) > CHUNK:
                    seen = set()
        yield from flush()

    def merged(batches):
        now, rest = None, []

        def out(h, node, n, i):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node), pa.array(n.astype(np.int64)),
                                               pa.array(i.astype(np.int64))], names=["h", "node", "n", "i"])

        def repeated(rows):
            h, node, n, i = (np.concatenate([r[k] for r in rows]) for k in range(4))
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            order = order[np.r_[False, same] | np.r_[same, False]]  # shingles that come again
            h, node, n, i = h[order], node[order], n[order], i[order]
            order = np.lexsort((node, h))
            h, node, n, i = h[order], node[order], n[order], i[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])] if len(h) else np.empty(0, bool)
            h, node, n, i = h[new], node[new], n[new], i[new]
            same = h[1:] == h[:-1]
            keep = np.r_[False, same] | np.r_[same, False] if len(h) else np.empty(0, bool)
            return out(h[keep], node[keep], n[keep], i[keep])

        for batch in batches:
            for at, known, h, node, n, i in zip(*(batch.column(c).to_pylist() for c in ("at", "known", "h", "node", "n", "i"))):
                row = (np.frombuffer(h, "<u8"), np.frombuffer(node, "<i8"), np.frombuffer(n, "<u4"), np.frombuffer(i, "<u4"))
                if known:
                    yield out(*row)
                    continue
                if at != now and rest:
                    yield repeated(rest)
                    rest = []
                now = at
                rest.append(row)
        if rest:
            yield repeated(rest)

    blocks = small_batches(docs, 512, BATCH).mapInArrow(released(make), "at int, known boolean, h binary, node binary, n binary, i binary")
    return _in_turn(blocks).mapInArrow(released(merged), "h long, node long, n long, i long")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) for the nodes in ``wanted``, from one text each."""
    import pyarrow as pa

    def cell(c):
        return F.pmod(F.xxhash64(c), F.lit(CELLS)).cast("int")

    ids = wanted.join(nodes, "node").select(cell(F.col("least")).alias("cell")).distinct().toArrow()
    table = np.zeros(CELLS, dtype=bool)
    table[ids.column("cell").to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(batches):
        bits = np.unpackbits(shared.value).astype(bool)
        sets, seen = TextSets(), set()
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column("cell").to_numpy()]))
            keep, blobs = [], []
            for s in sets.of(batch.column("text").to_pylist()):
                node = node_of(s) if len(s) else None
                if node is not None and node not in seen:
                    seen.add(node)
                    keep.append(node)
                    blobs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(blobs, pa.binary())], names=["node", "set"])

    rows = docs.where("id is not null").select("text", cell(F.col("id")).alias("cell"))
    made = small_batches(rows, 512, BATCH).mapInArrow(released(run), "node long, set binary")
    return made.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, written; what led to them is deleted."""
    import pyarrow as pa

    pairs = written(pairs.select("a", "b"), "jaccard-pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(_sets(docs, nodes, wanted), "jaccard-sets")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    others = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"),
                                            F.col("b").alias("node"), F.lit(1).alias("role"))
    queries = others.select("a", "block").distinct().select("a", "block", F.col("a").alias("node"), F.lit(0).alias("role"))
    rows = (others.unionByName(queries).join(sets, "node")
            .repartition("a", "block").sortWithinPartitions("a", "block", "role"))

    def run(batches):
        key, query, own, sets = None, None, [], []

        def links():
            if query is None or not own:
                return
            hit = search(query, sets)
            got = [n for n, h in zip(own, hit.tolist()) if h]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(got), pa.int64()), pa.array(got, pa.int64())],
                                                 names=["a", "b"])

        for batch in batches:
            for a, block, role, node, s in zip(*(batch.column(c).to_pylist() for c in ("a", "block", "role", "node", "set"))):
                if key != (a, block):
                    yield from links()
                    key, query, own, sets = (a, block), None, [], []
                s = np.frombuffer(s, "<u8")
                if role == 0:
                    query = s
                else:
                    own.append(node)
                    sets.append(s)
                    if len(own) >= 2 * BLOCK:  # a block that the hash made large
                        yield from links()
                        own, sets = [], []
        yield from links()

    out = written(small_batches(rows, 512, BATCH).mapInArrow(released(run), "a long, b long"), "jaccard-links")
    discard(pairs)
    discard(sets)
    return out


def _mixed(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(h, node, n, c) of the lists that hold nodes of several components c."""
    placed = lists.join(roots, "node", "left").select("h", "node", "n", "i", F.coalesce("root", "node").alias("c"))
    mixed = placed.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h")
    return placed.join(mixed, "h", "left_semi")


def _pairs_left(lists: DataFrame) -> float:
    """Pairs of components in all lists."""
    k = lists.select("h", "c").distinct().groupBy("h").agg(F.count(F.lit(1)).cast("double").alias("k"))
    return k.agg(F.sum(F.expr("k * (k - 1) / 2"))).first()[0] or 0.0


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = _targets(docs)
    first = written(_first_pass(docs, parts), "jaccard-rows")
    rows = first.where("key is null").select("id", "n", F.when(F.col("id").isNotNull(), F.col("node")).alias("node"))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    named = docs.where("id is not null")
    lists = written(_short_lists(named, _frequent(first), parts).distinct(), "jaccard-lists")

    # pairs with one node of each list, another one each time
    links = roots = None
    left = lists.withColumn("c", F.col("node"))
    for turn in range(STARS):
        first_by = F.struct(F.lit(0) if turn else F.col("i"), F.xxhash64(F.lit(turn), "node"))
        heads = left.groupBy("h").agg(F.min_by(F.struct("node", "n", "c"), first_by).alias("head"))
        star = (left.join(heads, "h").where("c <> head.c")
                .groupBy(F.col("head.node").alias("a"), F.col("node").alias("b"))
                .agg(F.max("head.n").alias("na"), F.max("n").alias("nb"), F.count(F.lit(1)).alias("shared"))
                .where(sizes_fit(F.col("na"), F.col("nb")) & (F.col("shared") * 2 >= enough(F.col("na"), F.col("nb")))))
        new = _verified(star, named, nodes)
        links = new if links is None else links.unionByName(new)
        roots = components(links, "jaccard-star")
        before, left = left, written(_mixed(lists, roots), "jaccard-mixed")
        discard(before)
        if _pairs_left(left) <= DENSE * left.count():
            break

    # pairs across the components found so far
    groups = left.groupBy("h", "c").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.expr("n - i")).alias("rest"))
    other = groups.select("h", F.col("c").alias("d"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("rest").alias("rest2"))
    meet = (groups.join(other, "h").where("c < d and 4 * hi >= 3 * lo2 and 4 * hi2 >= 3 * lo")
            .where(F.least("rest", "rest2") >= overlap(F.col("lo"), F.col("lo2"))).select("h", "c", "d"))
    one = left.select("h", "c", F.col("node").alias("a"), F.col("n").alias("na"), F.expr("n - i").alias("ra"))
    two = left.select("h", F.col("c").alias("d"), F.col("node").alias("b"), F.col("n").alias("nb"), F.expr("n - i").alias("rb"))
    across = (meet.join(one, ["h", "c"]).join(two, ["h", "d"])
              .where(sizes_fit(F.col("na"), F.col("nb")) & (F.least("ra", "rb") >= overlap(F.col("na"), F.col("nb"))))
              .select("a", "b").distinct())
    more = _verified(across, named, nodes)
    discard(lists)
    discard(left)
    roots = components(links.unionByName(more), "jaccard-all")

    # from nodes back to documents
    placed = nodes.join(roots, "node", "left")
    least = placed.where("root is not null").groupBy("root").agg(F.min("least").alias("smallest"))
    final = placed.join(least, "root", "left").select("node", F.coalesce("smallest", "least").alias("component_id"))
    return rows.join(final, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows that
    repeat an id stay or go together, rows without an id stay."""
    gone = link(docs, id_col, text_col).where(f"component_id <> `{id_col}`").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies: the first by id, rows without an id
    last, then by the text's hash; one of those that are equal in both.  It goes by
    rows, so an id that repeats with another text stays.  Rows without words are in
    no group and stay."""
    words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    row = "row"
    while row in docs.columns:
        row += "_"
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                   F.xxhash64(text_col).alias("text"), F.xxhash64(F.lit(1), text_col).alias("again"))
    named = docs.where(words).withColumn(row, key)
    first = link(named, row, text_col).where(F.col("component_id") == F.col(row)).select(row).distinct()
    return named.dropDuplicates([row]).join(first, row, "left_semi").select(docs.columns).unionByName(docs.where(~words))


#: Components of the exact join in DuckDB.
ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [list_aggregate(w, 'string_agg', ' ')]
        else list_transform(generate_series(1, len(w) - 4), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) end)) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as x from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b
      where 100 * x >= 75 * (na.n + nb.n - x)),
r as (select doc_id as a, doc_id as c from documents union select l.b, r.c from r join l on l.a = r.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.c) as component_id
from documents d left join n on n.doc_id = d.doc_id join r on r.a = d.doc_id group by 1, 2
"""
