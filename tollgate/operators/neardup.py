"""Token statistics and near-duplicate pairs (Jaccard >= 0.82).

Token sets hold every token of a row's feature texts.  The similarity join is
an equi-join, so no nested loop ever appears in the plan:

1. rows with at least 5 tokens collapse to distinct token sets (a set
   repeated a million times is one row with multiplicity m) that name the place of
   one row's tokens; only hashes of tokens leave that place;
2. sizes fall into classes, each bound at least 1/0.82 times the one before, so that
   similar sets lie in one class or in two neighbours.  Two similar sets of which the
   larger lies in a class with sizes up to u differ in at most D = 36 u / 182 tokens.
   A hash of the token deals the tokens into P = D + 1 + D / 2 parts; each token that
   differs spoils one part, so similar sets agree in at least P - D parts.  Of the
   parts of a set, those with the most tokens first, the first D + 1 + x must hold the
   first 1 + x that both sets have in common (x at most 3).  Their hashes are the set's
   signatures: of its own class, and of the next one, for larger partners.  No count of
   tokens over the table is needed, and a signature stands for several tokens, so that
   its list of sets stays short where a single token's grows with the table;
3. places (release, signature, set, k) of one slice of the signatures at a time go as arrays to a task
   for each share of the signatures, are sorted into lists there, and those of one set, as most are,
   dropped.  The pairs of the lists, of one slice of the left sets at a time, that have 1 + x common
   signatures are kept, and verified once, in integers, against the tokens, hashed where they are compared;
4. signatures with ``DENSE`` sets or more, as groups of alike rows make (found in a share of
   the sets; which ones they are changes the way, not the result), have long lists.  A list
   is dealt into blocks of about ``BLOCK`` sets, and every two blocks are a unit:
   its sets are compared by products of 0/1 matrices, and a pair counts in the
   unit of its first common signature only, and in none if it shares a short list, so no
   pair is made twice, nothing is made distinct, and no task gets a long list whole.
   A pair that shares a short list needs fewer short ones in 3 by the long ones it may share.

Pairs are counted without enumerating rows: sum m_A*m_B over similar set pairs,
plus C(m,2) minus the equal-fingerprint pairs inside each set.  The sums are kept
for each left set; of pairs only the candidates from short lists are written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import JACCARD_DEN, JACCARD_NUM, MIN_NEAR_TOKENS
from ..functions.tokens import exact, jaccard_ok, pairs_of, percent_text
from ..session import ship
from .findings import bounded_broadcast, evidence_rows, finding_rows, plural, top_k
from .prepare import Prepared

#: Sets with a signature from which on its list is compared in blocks, and a block's size.
DENSE, BLOCK = 256, 512

#: One set in so many is looked at to find the long lists.
DEAL = 16

#: Common signatures asked for beyond the first.
EXTRA = 3

#: Pairs of one set from which on its group is compared in two tasks.
LARGE = 64

#: Sets whose candidates are compared at a time, and the most slices: each reads the texts once.
SLICE_SETS, SLICES = 100_000, 8

#: Sets that are signed, whose signatures are sorted into lists, and whose pairs are counted, at a time.
LIST_SETS = 1_000_000

#: Sets with long lists that are compared at a time.
DENSE_SETS = 50_000

#: Places of signatures, and pairs of lists, that go to one task as arrays: about so many.
PACKED = 1 << 19

#: Pairs of short lists that are made, or counted together, at a time.
PAIRS_AT_ONCE = 1 << 20

#: Tokens whose parts are hashed at a time.
TOKENS_AT_ONCE = 1 << 20

#: Bytes of texts whose tokens are hashed at a time, and of a token from which on it is hashed on its own.
BYTES_AT_ONCE, LONG_TOKEN = 1 << 17, 256

# ---------------------------------------------------------------------------
# Token statistics
# ---------------------------------------------------------------------------

def token_stats(prep: Prepared) -> DataFrame:
    """Per release: rows, rows with >= 5 tokens, rows at the token limit
    (none without a limit), and the row pairs with an eligible left row, in one
    aggregate."""
    eligible = F.col("k") >= MIN_NEAR_TOKENS
    agg = prep.df.groupBy("release_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(eligible).alias("eligible_rows"),
        F.count_if(F.col("at_limit")).alias("rows_at_token_limit"),
        F.coalesce(F.sum(F.when(eligible, F.col("_row"))), F.lit(0)).alias("__s"),
    )
    return agg.select(
        "release_id", "rows", "eligible_rows", "rows_at_token_limit",
        (exact(F.col("eligible_rows")) * exact(F.col("rows") - 1) - exact(F.col("__s")))
        .cast("bigint")
        .alias("total_comparisons"))


# ---------------------------------------------------------------------------
# The join
# ---------------------------------------------------------------------------

def _eligible_rows(prep: Prepared) -> DataFrame:
    return prep.df.where(F.col("k") >= MIN_NEAR_TOKENS).select("release_id", "_row", "fp_feature", "k", "set_key", "place")


def _subgroups(prep: Prepared) -> DataFrame:
    """(set, fingerprint) subgroups: rows, first row and the place of a row's tokens."""
    return prep.memo("near_subgroups", lambda: (
        _eligible_rows(prep).groupBy("release_id", "set_key", "fp_feature")
        .agg(F.count(F.lit(1)).alias("c"), F.min("_row").alias("first"), F.max("k").alias("k"),
             F.min("place").alias("place"))), columns=True)


def token_sets(prep: Prepared) -> DataFrame:
    """Distinct token sets: multiplicity m, equal-fingerprint pairs inside,
    first row, size and the place of the tokens."""
    return prep.memo("near_sets", lambda: (
        _subgroups(prep).groupBy("release_id", "set_key")
        .agg(F.sum("c").alias("m"), F.sum(pairs_of(F.col("c"))).alias("same_fp_pairs"),
             F.min("first").alias("first_row"), F.max("k").alias("k"), F.min("place").alias("place"))), columns=True)


_POWERS: dict = {}


def _powers(n: int):
    """(a random number for each byte, the first ``n`` powers of an odd number, those of its inverse)."""
    import numpy as np

    if len(_POWERS.get("up", ())) < n:
        odd = 0x9E3779B97F4A7C15
        for name, base in (("up", odd), ("down", pow(odd, -1, 1 << 64))):
            powers = np.full(max(n, BYTES_AT_ONCE + 1), base, np.uint64)
            powers[0] = 1
            _POWERS[name] = np.cumprod(powers, dtype=np.uint64)
        _POWERS["byte"] = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return _POWERS["byte"], _POWERS["up"], _POWERS["down"]


def token_ids(texts):
    """(64-bit hashes of the tokens, their number for each text) of an array of ``token_text``: sums of a
    number for each byte times a power for its place in the token, mixed with the length."""
    import hashlib

    import numpy as np

    n = len(texts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = texts.buffers()
    wide = np.int64 if str(texts.type).startswith("large") else np.int32
    ends = np.frombuffer(offsets, wide)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    ids, counts, start = [], np.zeros(n, np.int64), 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + BYTES_AT_ONCE, side="right")) - 1)
        held, cuts = data[ends[start]:ends[stop]], ends[start:stop + 1] - ends[start]
        byte, up, down = _powers(len(held) + 1)
        sums = np.zeros(len(held) + 1, np.uint64)
        np.cumsum(byte[held] * up[:len(held)], out=sums[1:])
        blanks = np.flatnonzero(held == 32)
        first, last = np.sort(np.concatenate([cuts[:-1], blanks + 1])), np.sort(np.concatenate([blanks, cuts[1:]]))
        size = last - first
        found = _mix((sums[last] - sums[first]) * down[first] + size.astype(np.uint64)).view(np.int64)
        for i in np.flatnonzero(size >= LONG_TOKEN):
            found[i] = int.from_bytes(hashlib.blake2b(held[first[i]:last[i]].tobytes(), digest_size=8).digest(), "little", signed=True)
        counts[start:stop] = 1 + np.diff(np.searchsorted(blanks, cuts))
        ids.append(found)
        start = stop
    return np.concatenate(ids), counts


# ---------------------------------------------------------------------------
# Signatures
# ---------------------------------------------------------------------------

def _bounds() -> list[int]:
    """Smallest sizes of the classes."""
    out = [MIN_NEAR_TOKENS]
    while out[-1] < 1 << 32:
        out.append(-(-out[-1] * JACCARD_DEN // JACCARD_NUM))
    return out


BOUNDS = _bounds()


def _mix(x):
    """A bijection of unsigned 64-bit integers that spreads every bit."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(ids, sizes, up: int):
    """(signatures, their number for each set) of sets whose hashed tokens lie one after
    the other, in the scheme of each set's class (``up`` 0) or of the next one (1)."""
    import numpy as np

    sizes = np.asarray(sizes, np.int64)
    bounds = np.array(BOUNDS, np.int64)
    scheme = np.searchsorted(bounds, sizes, side="right") - 1 + up
    differ = 2 * (bounds[scheme + 1] - 1) * (JACCARD_DEN - JACCARD_NUM) // (JACCARD_DEN + JACCARD_NUM)
    parts = differ + 1 + differ // 2
    first = np.cumsum(parts) - parts  # of each set's parts
    mixed = _mix(np.ascontiguousarray(ids).view(np.uint64))
    each = np.repeat(np.arange(len(sizes)), sizes)
    place = first[each] + ((mixed >> np.uint64(32)) % parts[each].astype(np.uint64)).astype(np.int64)
    total = int(parts.sum())
    held = np.bincount(place, minlength=total)
    value = np.zeros(total, np.uint64)
    np.add.at(value, place, _mix(mixed + np.uint64(1)))
    owner = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(total) - first[owner]
    value = _mix(value + _mix((scheme[owner] << 40 | number).astype(np.uint64)) + held.astype(np.uint64)).view(np.int64)
    # the fullest parts of each set first, equal ones by their hash: one order, as one number while it has room for the sets
    full, by = 4095 - np.minimum(held, 4095), value.view(np.uint64) >> np.uint64(32)
    if len(sizes) < 1 << 20:
        order = np.argsort((owner << 12 | full).astype(np.uint64) << np.uint64(32) | by, kind="stable")
    else:
        order = np.lexsort((by, full, owner))
    n = differ + 1 + np.minimum(differ // 2, EXTRA)
    kept = order[number < n[owner]]  # the order keeps each set's parts where they are
    return value[kept], n


def needed(k: Column, up: Column) -> Column:
    """Signatures that similar sets have in common in the scheme of a set of size ``k``."""
    out = F.lit(1 + EXTRA)
    for least, end in reversed([*zip(BOUNDS, BOUNDS[1:])]):
        extra = 2 * (end - 1) * (JACCARD_DEN - JACCARD_NUM) // (JACCARD_DEN + JACCARD_NUM) // 2
        if extra < EXTRA:
            out = F.when(k < F.when(up, least).otherwise(end), F.lit(1 + extra)).otherwise(out)
    return out


def _signed(batches):
    """Rows (release_id, s, k, place, own, above) for batches of (release_id, s, k, place, token_text): the
    signatures in the scheme of the set's class, and in the next one's if it may have partners there."""
    import numpy as np
    import pyarrow as pa

    bounds = np.array(BOUNDS, np.int64)
    for batch in batches:
        ends = np.cumsum(batch.column("k").to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + TOKENS_AT_ONCE, side="right")))
            part = batch.slice(start, stop - start)
            start = stop
            k = part.column("k").to_numpy(zero_copy_only=False).astype(np.int64)
            values, sizes = token_ids(part.column("token_text"))
            may = k * JACCARD_DEN >= bounds[np.searchsorted(bounds, k, side="right")] * JACCARD_NUM
            lists = []
            for up, which in ((0, np.ones(len(k), bool)), (1, may)):
                sigs, n = signatures(values[np.repeat(which, sizes)], sizes[which], up)
                each = np.zeros(len(k), np.int64)
                each[which] = n
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32)), pa.array(sigs)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("release_id", "s", "k", "place")), *lists],
                                             names=["release_id", "s", "k", "place", "own", "above"])


def signed_sets(prep: Prepared) -> DataFrame:
    """The signatures of every set: (release_id, s, k, place, own, above), kept: made in slices of
    the places, so that the texts sorted for one are gone before the next."""
    of = _list_slices(prep)

    def build(which: int) -> DataFrame:
        ship(prep.df.sparkSession)
        mine = F.pmod(F.xxhash64("place"), F.lit(of)) == which
        held = token_sets(prep).where(mine).join(prep.texts.where(mine), "place").select(
            "release_id", F.col("first_row").alias("s"), "k", "place", "token_text")
        return held.mapInArrow(_signed, "release_id string, s long, k int, place long, own array<long>, above array<long>")

    return reduce(DataFrame.unionByName, [prep.memo(f"near_signed:{k}", lambda k=k: build(k), columns=True) for k in range(of)])


def _places(signed: DataFrame) -> DataFrame:
    """A row for each signature of each set, those of the next class's scheme marked ``up``."""
    at = F.posexplode(F.concat("own", "above")).alias("pos", "tok")
    return signed.select("release_id", "s", "k", F.size("own").alias("n"), at).select(
        "release_id", "s", "k", (F.col("pos") >= F.col("n")).alias("up"), "tok")


def _dense(prep: Prepared) -> tuple[DataFrame, int]:
    """The signatures (release_id, tok) whose lists are long, judged by one set in ``DEAL``, and
    their number."""
    dense = prep.memo("near_dense", lambda: (
        _places(signed_sets(prep).where(F.pmod(F.xxhash64("place"), F.lit(DEAL)) == 0))
        .groupBy("release_id", "tok").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") * DEAL >= DENSE).select("release_id", "tok")))
    return dense, _counted(prep, "near_dense", dense)


def _counted(prep: Prepared, name: str, kept: DataFrame) -> int:
    """Rows of a kept frame."""
    if name not in prep.counts:
        prep.counts[name] = kept.count()
    return prep.counts[name]


def _touched(prep: Prepared) -> tuple[DataFrame, int]:
    """The sets with long lists (release_id, s) and the signatures that have them, and their number."""
    dense, n = _dense(prep)
    touched = prep.memo("near_touched", lambda: (
        _places(signed_sets(prep)).join(bounded_broadcast(dense, n), ["release_id", "tok"])
        .groupBy("release_id", "s").agg(F.array_sort(F.collect_list(F.when(~F.col("up"), F.col("tok")))).alias("own_long"),
                                        F.array_sort(F.collect_list(F.when(F.col("up"), F.col("tok")))).alias("above_long"))))
    return touched, _counted(prep, "near_touched", touched)


def similar_sets(prep: Prepared, lefts: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """Pairs of distinct token sets with Jaccard >= 0.82, named by their first
    rows (``sa`` < ``sb``); with ``lefts`` (release_id, sa) only those, from the candidates that
    are kept; with ``first`` at least the first pairs of each release."""
    if lefts is None:
        short = _verified(prep, _candidates(prep))
    else:
        kept = prep.memo(f"near_beside:{prep.limits.evidence_per_finding}",
                         lambda: _candidates(prep).join(lefts, ["release_id", "sa"], "left_semi"), columns=True)
        short = _verified(prep, kept, _texts_of(prep, kept, f"near_beside_places:{prep.limits.evidence_per_finding}"))
    dense = _by_dense_lists(prep, lefts, first)
    return short if dense is None else short.unionByName(dense)


PAIR = ["release_id", "sa", "sb", "ma", "mb", "a_key", "b_key", "inter", "ka", "kb"]


def _packed(release, key, buckets: int, columns: dict):
    """A batch (release_id, bucket, columns as arrays) of rows with a release and a 64-bit key each: a row
    for each release and each of ``buckets`` shares of the keys."""
    import numpy as np
    import pyarrow as pa

    names = release.dictionary_encode()
    codes = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    bucket = ((_mix(key.view(np.uint64)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    at = codes * buckets + bucket
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(first, len(at)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [release.take(pa.array(order[first])).cast(pa.string()), pa.array(bucket[order[first]].astype(np.int32)),
         *(pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns.values())], names=["release_id", "bucket", *columns])


def _packed_places(batches, which: int, of: int, buckets: int):
    """The places (tok, s, k, up, long) of slice ``which`` of ``of`` of the signatures, without the long lists, packed, for batches
    of (release_id, s, k, own, above, own_long, above_long); ``long`` is the number of long lists of the set in that scheme."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        start = 0
        while start < batch.num_rows:  # a few sets at a time, as their signatures are many
            sizes = np.diff(batch.column("own").offsets.to_numpy()) + np.diff(batch.column("above").offsets.to_numpy())
            stop = max(start + 1, start + int(np.searchsorted(np.cumsum(sizes[start:]), 2 * PACKED, side="right")))
            part = batch.slice(start, stop - start)
            start = stop
            s, k = part.column("s").to_numpy(), part.column("k").to_numpy(zero_copy_only=False).astype(np.int32)
            release = part.column("release_id")
            codes = release.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            tok, owner, up, long, longs, of_long = [], [], [], [], [], []
            for scheme, name in enumerate(("own", "above")):
                column, held = part.column(name), part.column(f"{name}_long")
                n, beside = np.diff(column.offsets.to_numpy()), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                tok.append(column.flatten().to_numpy(zero_copy_only=False))
                owner.append(np.repeat(np.arange(len(s)), n))
                up.append(np.full(len(tok[-1]), bool(scheme)))
                long.append(np.repeat(beside.astype(np.int32), n))
                longs.append(held.flatten().to_numpy(zero_copy_only=False))
                of_long.append(np.repeat(codes, beside))
            tok, owner, up, long, longs, of_long = (np.concatenate(x) for x in (tok, owner, up, long, longs, of_long))
            kept = np.mod(tok, of) == which
            for code in np.unique(of_long):
                kept &= (codes[owner] != code) | ~np.isin(tok, np.unique(longs[of_long == code]))
            tok, owner, up, long = tok[kept], owner[kept], up[kept], long[kept]
            yield _packed(release.take(pa.array(owner)), tok, buckets, {"tok": tok, "s": s[owner], "k": k[owner], "up": up, "long": long})


def _opened(batches):
    """For batches of packed rows sorted by ``bucket`` a batch of plain rows for each bucket."""
    import numpy as np
    import pyarrow as pa

    def rows(parts):
        packed = pa.Table.from_batches(parts)
        lists = [c for c in packed.column_names if c not in ("release_id", "bucket")]
        each = np.concatenate([np.diff(p.column(lists[0]).offsets.to_numpy()) for p in parts])
        flat = [pa.concat_arrays([p.column(c).flatten() for p in parts]) for c in lists]
        names = packed.column("release_id").combine_chunks().take(pa.array(np.repeat(np.arange(len(each)), each)))
        return pa.RecordBatch.from_arrays([names, *flat], names=["release_id", *lists])

    held, bucket = [], None
    for batch in batches:
        start, of = 0, batch.column("bucket").to_numpy()
        for end in [*(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]:
            if end == start:
                continue
            if held and of[start] != bucket:
                yield rows(held)
                held = []
            bucket = of[start]
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield rows(held)


def _sorted_places(batches):
    """Places that were packed, sorted by signature, a bucket at a time."""
    import numpy as np
    import pyarrow as pa

    for rows in _opened(batches):
        yield rows.take(pa.array(np.argsort(rows.column("tok").to_numpy(), kind="stable")))


def _lists(batches):
    """Rows (release_id, s, k, up, ...) of arrays, one for each signature of two sets or more with one of
    its own class, in the order of the sets, for batches of (release_id, tok, s, k, up, ...) sorted by signature."""
    import numpy as np
    import pyarrow as pa

    def lists(rows):
        rows = rows.combine_chunks()
        tok, s, up = (rows.column(c).to_numpy() for c in ("tok", "s", "up"))
        release = rows.column("release_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((s, release, tok))
        tok, release, up = tok[order], release[order], up[order]
        first = np.flatnonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (release[1:] != release[:-1])]))
        n = np.diff(np.append(first, len(tok)))
        kept = (n > 1) & ~np.logical_and.reduceat(up, first)
        held = rows.take(pa.array(order[np.repeat(kept, n)])).combine_chunks()
        ends = np.cumsum(n[kept])
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        kinds = ["s", "k", "up", *(c for c in held.column_names if c not in ("release_id", "tok", "s", "k", "up"))]
        column = {c: held.column(c).combine_chunks() for c in ("release_id", *kinds)}
        return pa.RecordBatch.from_arrays(
            [column["release_id"].take(pa.array(ends - 1)), *(pa.ListArray.from_arrays(offsets, column[c]) for c in kinds)],
            names=["release_id", *kinds])

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tok = batch.column("tok").to_numpy()
        last = int(np.searchsorted(tok, tok[-1]))  # the last list may go on in the next batch
        if last or (held and held[-1].column("tok")[-1].as_py() != tok[-1]):
            yield lists(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield lists(pa.Table.from_batches(held))


def list_pairs(batches, which: int, of: int):
    """Rows (release_id, sa, sb, ua, ub, need, shared): the pairs of lists (release_id, s, k, up, need, long)
    that come in the order of their releases, with the number of lists that hold them, counted as far as they come
    together; ``need`` is less by the long lists that both may share.  Of ``of`` slices of the left sets only those of slice ``which``."""
    import numpy as np
    import pyarrow as pa

    def counted(parts):
        a, b, need, shared = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((b, a))
        a, b, need, shared = a[order], b[order], need[order], shared[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[first], b[first], np.minimum.reduceat(need, first), np.add.reduceat(shared, first)

    def rows(release, parts):
        a, b, need, shared = parts
        return pa.RecordBatch.from_arrays(
            [pa.array([release], pa.string()).take(pa.array(np.zeros(len(a), np.int32))), pa.array(a), pa.array(b >> 2),
             pa.array((b & 2) > 0), pa.array((b & 1) > 0), pa.array(need.astype(np.int32)), pa.array(shared)],
            names=["release_id", "sa", "sb", "ua", "ub", "need", "shared"])

    release, parts, held = None, [], 0
    for batch in batches:
        names = batch.column("release_id").to_pylist()
        sizes = np.diff(batch.column("s").offsets.to_numpy())
        need_of = batch.column("need").to_numpy().astype(np.int64)
        s, k, up = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("s", "k", "up"))
        k = k.astype(np.int64)
        long = batch.column("long").flatten().to_numpy(zero_copy_only=False) if "long" in batch.schema.names else np.zeros(len(s), np.int32)
        in_slice = (_mix(s.astype(np.uint64)) >> np.uint64(32)) % np.uint64(of) == which
        starts = np.cumsum(sizes) - sizes
        turns = [i for i, x in enumerate(names) if i == 0 or x != names[i - 1]]
        for begin, end in zip(turns, [*turns[1:], len(names)]):
            if parts and names[begin] != release:
                yield rows(release, counted(parts))
                parts, held = [], 0
            release = names[begin]
            for n in np.unique(sizes[begin:end]).tolist():
                at = begin + np.flatnonzero(sizes[begin:end] == n)
                block = max(1, PAIRS_AT_ONCE // n)
                for lefts in (np.arange(i, min(i + block, n - 1)) for i in range(0, n - 1, block)):
                    x_in, y_in = np.repeat(lefts, n - 1 - lefts), np.concatenate([np.arange(i + 1, n) for i in lefts])
                    many = max(1, PAIRS_AT_ONCE // len(x_in))
                    for chunk in (at[i:i + many] for i in range(0, len(at), many)):
                        x, y = (starts[chunk][:, None] + x_in).ravel(), (starts[chunk][:, None] + y_in).ravel()
                        need = np.repeat(need_of[chunk], len(x_in))
                        mine = in_slice[x] & ~(up[x] & up[y])  # two sets of one class meet in its own scheme
                        x, y, need = x[mine], y[mine], need[mine]
                        good = (s[x] < s[y]) & (np.minimum(k[x], k[y]) * JACCARD_DEN >= np.maximum(k[x], k[y]) * JACCARD_NUM)
                        if not good.any():
                            continue
                        x, y = x[good], y[good]
                        parts.append((s[x], s[y] << 2 | up[x].astype(np.int64) << 1 | up[y], need[good] - np.minimum(long[x], long[y]),
                                      np.ones(len(x), np.int64)))
                        held += len(parts[-1][0])
                        if held >= PAIRS_AT_ONCE:
                            one = counted(parts)
                            parts, held = [one], len(one[0])
                            if held >= PAIRS_AT_ONCE // 2:
                                yield rows(release, one)
                                parts, held = [], 0
    if parts:
        yield rows(release, counted(parts))


def _list_slices(prep: Prepared) -> int:
    return min(SLICES, 1 + _counted(prep, "near_sets", token_sets(prep)) // LIST_SETS)


def _buckets(prep: Prepared, of: int) -> int:
    """Tasks for one of ``of`` slices of the signatures, of which a set has at most about 0.54 for each token and 8."""
    if "near_tokens" not in prep.counts:
        prep.counts["near_tokens"] = token_sets(prep).agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long")).first()[0]
    places = prep.counts["near_tokens"] * 54 // 100 + 8 * _counted(prep, "near_sets", token_sets(prep))
    return 1 + places // of // PACKED


def _short_lists(prep: Prepared) -> DataFrame:
    """The short lists of two sets or more (release_id, s, k, up, long), kept: made in slices of the
    signatures, so that the arrays dealt out for one are gone before the next."""
    n = _dense(prep)[1]
    of = _list_slices(prep)

    buckets = _buckets(prep, of)

    def build(which: int) -> DataFrame:
        ship(prep.df.sparkSession)
        signed, none = signed_sets(prep).drop("place"), F.lit(None).cast("array<long>")
        if n:
            signed = signed.join(bounded_broadcast(*_touched(prep)), ["release_id", "s"], "left")
        else:
            signed = signed.select("*", none.alias("own_long"), none.alias("above_long"))
        arrays = "s array<long>, k array<int>, up array<boolean>, long array<int>"
        packed = signed.select("release_id", "s", "k", "own", "above", "own_long", "above_long").mapInArrow(
            lambda batches: _packed_places(batches, which, of, buckets), f"release_id string, bucket int, tok array<long>, {arrays}")
        return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
            lambda batches: _lists(_sorted_places(batches)), f"release_id string, {arrays}")

    return reduce(DataFrame.unionByName, [prep.memo(f"near_lists:{k}", lambda k=k: build(k), columns=True) for k in range(of)])


def _candidates(prep: Prepared) -> DataFrame:
    """Pairs of sets (release_id, sa, sb) with enough common signatures, at least one of them
    with a short list; kept, in slices of the left sets: fewer than ``DENSE`` thin rows for each set and list."""
    of = _list_slices(prep)
    return reduce(DataFrame.unionByName, [prep.memo(f"near_candidates:{k}", lambda k=k: _candidates_of(prep, k, of), columns=True)
                                          for k in range(of)])


def _packed_pairs(batches, buckets: int):
    """Pairs of ``list_pairs`` as arrays: every pair in the same bucket wherever it comes from."""
    import numpy as np

    for batch in batches:
        sa, sb, ua, ub, need, shared = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sa", "sb", "ua", "ub", "need", "shared"))
        b = sb << 2 | ua.astype(np.int64) << 1 | ub
        yield _packed(batch.column("release_id"), (_mix(sa.view(np.uint64)) + b.view(np.uint64)).view(np.int64), buckets,
                      {"sa": sa, "b": b, "need": need, "shared": shared.astype(np.int32)})


def _enough(batches):
    """The pairs (release_id, sa, sb) of packed ones that have as many lists in common as they need."""
    import numpy as np
    import pyarrow as pa

    for rows in _opened(batches):
        sa, b, need, shared = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("sa", "b", "need", "shared"))
        release = rows.column("release_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((b, sa, release))
        x = [c[order] for c in (release, sa, b)]
        first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in x], axis=0)]))
        kept = np.add.reduceat(shared[order], first) >= np.minimum.reduceat(need[order], first)
        at = order[first[kept]]
        yield pa.RecordBatch.from_arrays([rows.column("release_id").take(pa.array(at)), pa.array(sa[at]), pa.array(b[at] >> 2)],
                                         names=["release_id", "sa", "sb"])


def _candidates_of(prep: Prepared, which: int, of: int) -> DataFrame:
    """The candidates of one slice of the left sets."""
    # lists with one first set lie together: they hold much the same pairs
    lists = _short_lists(prep).withColumn("first", F.col("s")[0]).repartition("release_id", "first").sortWithinPartitions("release_id", "first")
    ship(prep.df.sparkSession)
    buckets = _buckets(prep, of)
    found = lists.select("release_id", "s", "k", "up", "long", needed(F.col("k")[0], F.col("up")[0]).alias("need")).mapInArrow(
        lambda batches: _packed_pairs(list_pairs(batches, which, of), buckets),
        "release_id string, bucket int, sa array<long>, b array<long>, need array<int>, shared array<int>")
    return found.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_enough, "release_id string, sa long, sb long")


def _candidate_groups(prep: Prepared) -> DataFrame:
    """The kept candidates with their groups, as thin rows."""
    return prep.memo("near_grouped", lambda: _grouped(prep, _candidates(prep)), columns=True)


def _texts_of(prep: Prepared, pairs: DataFrame, name: str) -> DataFrame:
    """The texts of the sets that occur in ``pairs`` (release_id, sa, sb); their places are kept as ``name``."""
    named = pairs.select("release_id", F.col("sa").alias("first_row")).unionByName(
        pairs.select("release_id", F.col("sb").alias("first_row"))).distinct()
    of = prep.memo(name, lambda: token_sets(prep).join(named, ["release_id", "first_row"], "left_semi")
                   .select("place").distinct(), columns=True)
    return prep.texts.join(bounded_broadcast(of, _counted(prep, name, of)), "place", "left_semi")


def _beside(prep: Prepared, lefts: DataFrame) -> tuple[DataFrame, int]:
    """Of ``_touched`` the sets that share a long list with one of ``lefts``: no other set is in
    a pair with these."""
    touched, _ = _touched(prep)
    name = f"near_touched:{prep.limits.evidence_per_finding}"

    def build() -> DataFrame:
        lists = touched.select("release_id", "s", F.explode(F.concat("own_long", "above_long")).alias("tok"))
        shared = lists.join(lefts.withColumnRenamed("sa", "s"), ["release_id", "s"], "left_semi").select("release_id", "tok").distinct()
        sets = lists.join(shared, ["release_id", "tok"], "left_semi").select("release_id", "s").distinct()
        return touched.join(sets, ["release_id", "s"], "left_semi")

    kept = prep.memo(name, build, columns=True)
    return kept, _counted(prep, name, kept)


def _verified(prep: Prepared, found: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The pairs of ``found`` that are similar, compared token by token; ``texts`` are those
    of the places that occur, by default all."""
    return _compared(_grouped(prep, found), prep.texts if texts is None else texts)


GROUP = ["release_id", "group", "part"]


def _grouped(prep: Prepared, found: DataFrame) -> DataFrame:
    """The pairs of ``found`` with their groups, sizes and places."""
    sets = token_sets(prep)

    def side(x: str) -> DataFrame:
        return sets.select("release_id", F.col("first_row").alias(f"s{x}"), F.col("m").alias(f"m{x}"), F.col("k").alias(f"k{x}"),
                           F.col("set_key").alias(f"{x}_key"), F.col("place").alias(f"p{x}"))

    # a group of alike sets goes by its smallest one, so that a text travels once for each group, not for each pair
    both = found.select("release_id", F.col("sa").alias("s"), F.col("sa").alias("near")).unionByName(
        found.select("release_id", F.col("sb").alias("s"), F.col("sa").alias("near")))
    group = both.groupBy("release_id", "s").agg(F.min("near").alias("group"), F.count(F.lit(1)).alias("beside"))
    # a large group's pairs in two tasks; each part more sends its texts again
    part = F.when(F.col("beside") >= LARGE, F.pmod(F.xxhash64("pa"), F.lit(2))).otherwise(F.lit(0).cast("long"))
    return (found.join(group.withColumnRenamed("s", "sa"), ["release_id", "sa"])
            .join(side("a"), ["release_id", "sa"]).join(side("b"), ["release_id", "sb"])
            .select("release_id", "group", part.alias("part"), "sa", "sb", "ma", "mb", "a_key", "b_key", "ka", "kb", "pa", "pb"))


def _wanted(pairs: DataFrame) -> DataFrame:
    """The places of each group."""
    return pairs.select(*GROUP, F.explode(F.array("pa", "pb")).alias("place")).distinct()


def _compared(pairs: DataFrame, texts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The similar ones of such pairs, compared token by token; ``wanted`` are their places."""
    wanted = _wanted(pairs) if wanted is None else wanted
    held = wanted.join(texts, "place").select(
        F.col("release_id").alias("in_release"), F.col("group").alias("in_group"), F.col("part").alias("in_part"), "place", "token_text")
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    ship(pairs.sparkSession)
    schema = ", ".join(f"{c} int" if c == "inter" else f"{c} {kinds[c]}" for c in PAIR)
    return (pairs.groupBy(*GROUP).cogroup(held.groupBy("in_release", "in_group", "in_part")).applyInArrow(compare_pairs, schema)
            .where(jaccard_ok(F.col("inter"), F.col("ka"), F.col("kb"))))


def compare_pairs(pairs, held):
    """The pairs with ``inter``, the number of tokens that the sets at their places share."""
    import numpy as np
    import pyarrow as pa

    inter = np.zeros(pairs.num_rows, np.int32)
    if pairs.num_rows:
        values, sizes = token_ids(held.column("token_text").combine_chunks())
        known, values = np.unique(values, return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        places = held.column("place").to_numpy()
        order = np.argsort(places)
        at = {c: order[np.searchsorted(places[order], pairs.column(c).to_numpy())] for c in ("pa", "pb")}
        marked = np.zeros(len(known), np.uint8)
        turns = np.argsort(at["pa"], kind="stable")
        lefts = at["pa"][turns]
        cuts = np.flatnonzero(np.concatenate([[True], lefts[1:] != lefts[:-1], [True]]))
        for begin, end in zip(cuts.tolist(), cuts[1:].tolist()):
            a = lefts[begin]
            mine = values[starts[a]:starts[a] + sizes[a]]
            marked[mine] = 1
            for i in turns[begin:end].tolist():
                b = at["pb"][i]
                inter[i] = np.count_nonzero(marked[values[starts[b]:starts[b] + sizes[b]]])
            marked[mine] = 0
    return pairs.append_column("inter", pa.array(inter)).select(PAIR)


def _in_slice(turn: tuple[int, int] | None) -> Column:
    """Whether the list of ``tok`` belongs to slice ``turn`` = (which, of how many)."""
    return F.lit(True) if turn is None else F.pmod(F.xxhash64("release_id", "tok"), F.lit(turn[1])) == turn[0]


def _turned(prep: Prepared, turn: tuple[int, int]) -> tuple[DataFrame, int]:
    """Of ``_touched`` the sets with a list of that slice."""
    touched, n = _touched(prep)
    if turn[1] == 1:
        return touched, n
    name = f"near_touched_slice:{turn[0]}"
    kept = prep.memo(name, lambda: touched.join(
        touched.select("release_id", "s", F.explode(F.concat("own_long", "above_long")).alias("tok")).where(_in_slice(turn))
        .select("release_id", "s").distinct(), ["release_id", "s"], "left_semi"), columns=True)
    return kept, _counted(prep, name, kept)


def _by_dense_lists(prep: Prepared, lefts: DataFrame | None, first: int | None = None, sums: bool = False,
                    turn: tuple[int, int] | None = None) -> DataFrame | None:
    """Pairs that share signatures with long lists only: all, or the
    ``first`` of each unit.  With ``sums`` the row pairs (release_id, sa, pairs) of
    each left set in each unit instead, with ``turn`` those of one slice of the lists.
    None where no list is long."""
    dense, n = _dense(prep)
    if not n:
        return None
    sets = token_sets(prep)
    if turn is not None:
        touched, sets_touched = _turned(prep, turn)
    else:
        touched, sets_touched = _touched(prep) if lefts is None else _beside(prep, lefts)
    parts = signed_sets(prep).join(bounded_broadcast(touched, sets_touched), ["release_id", "s"]).join(
        sets.select("release_id", F.col("first_row").alias("s"), "m", "set_key"), ["release_id", "s"])
    of = touched.select("release_id", F.col("s").alias("first_row"))
    of = sets.select("release_id", "first_row", "place").join(bounded_broadcast(of, sets_touched), ["release_id", "first_row"]).select("place").distinct()
    texts = prep.texts.join(bounded_broadcast(of, sets_touched), "place", "left_semi")
    base = parts.join(texts, "place").select(
        "release_id", "s", "m", "set_key", "k", "token_text",
        F.explode(F.array(F.struct(F.lit(False).alias("up"), F.col("own").alias("sigs"), F.col("own_long").alias("long")),
                          F.struct(F.lit(True).alias("up"), F.col("above").alias("sigs"), F.col("above_long").alias("long")))).alias("x"))
    base = base.select("release_id", "s", "m", "set_key", "k", "token_text", "x.up", "x.sigs", "x.long")
    if lefts is None:
        base = base.withColumn("left", F.lit(True))
    else:
        base = base.join(lefts.select("release_id", F.col("sa").alias("s"), F.lit(True).alias("left")),
                         ["release_id", "s"], "left").withColumn("left", F.coalesce("left", F.lit(False)))
    # signatures with short lists first: the pairs that share one are found by them
    short = F.array_except("sigs", "long")
    places = base.withColumn("sigs", F.concat(short, "long")).withColumn("rare", F.size(short)).select(
        "release_id", "s", "m", "set_key", "k", "token_text", "sigs", "up", "left", "rare", F.posexplode("long").alias("at", "tok")) \
        .where(_in_slice(turn)) \
        .withColumn("pos", F.col("rare") + F.col("at"))
    lists = places.groupBy("release_id", "tok").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("g"), F.max("left").alias("any"), F.count(F.lit(1)).alias("n")) \
        .where("any and n > 1").select("release_id", "tok", "g")
    own = F.pmod(F.xxhash64("s"), F.col("g")).cast("int")
    units = places.join(lists, ["release_id", "tok"]).withColumn("own", own).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")).select(
        "release_id", "tok", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
        "s", "m", "set_key", "k", "pos", "left", "token_text", "sigs", "up")
    kinds = {f.name: f.dataType.simpleString() for f in sets.schema.fields}
    out = (f"release_id string, sa long, sb long, ma {kinds['m']}, mb {kinds['m']}, a_key {kinds['set_key']}, b_key {kinds['set_key']}, "
           "inter int, ka int, kb int")
    if sums:
        out = "release_id string, sa long, pairs decimal(38,0)"
    return units.groupBy("release_id", "tok", "i", "j").applyInArrow(
        lambda key, table: compare_unit(key, table, first, sums), out)


def _products(rows: list, cols: list, same: bool = False):
    """The numbers of common elements of every two arrays, one from each side; if both sides are the
    ``same``, of every two different ones."""
    import numpy as np

    sizes, other = np.array([len(r) for r in rows]), np.array([len(c) for c in cols])
    values, place = np.unique(np.concatenate([*rows, *cols]), return_inverse=True)
    split = int(sizes.sum())
    x, y = place[:split], place[split:]
    both = np.zeros(len(values), bool)
    both[x] = True
    shared = np.zeros(len(values), bool)
    shared[y] = True
    shared &= both  # elements of one side only are in no product
    if same:
        shared &= np.bincount(x, minlength=len(values)) > 1  # nor those of one array
    number = np.cumsum(shared) - 1
    rx, ry = np.repeat(np.arange(len(rows)), sizes)[shared[x]], np.repeat(np.arange(len(cols)), other)[shared[y]]
    x, y = number[x[shared[x]]], number[y[shared[y]]]
    out = np.zeros((len(rows), len(cols)), np.float32)
    total = int(shared.sum())
    for start in range(0, total, 4096):
        width = min(4096, total - start)
        a, b = np.zeros((len(rows), width), np.float32), np.zeros((len(cols), width), np.float32)
        at, bt = (x >= start) & (x < start + width), (y >= start) & (y < start + width)
        a[rx[at], x[at] - start] = 1
        b[ry[bt], y[bt] - start] = 1
        out += a @ b.T
    return out.astype(np.int64)


def compare_unit(key, table, first: int | None = None, sums: bool = False):
    """The similar pairs of two blocks of a list (or inside one) whose first common
    element it is: of ``sigs`` where the table has them, else of ``ids``."""
    from decimal import Decimal

    import numpy as np
    import pyarrow as pa

    release, _, i, j = (k.as_py() for k in key)
    s, k, pos, own, left = (table.column(c).to_numpy() for c in ("s", "k", "pos", "own", "left"))
    signed = "sigs" in table.column_names

    def arrays(column: str, at) -> list:
        """The arrays of the rows ``at``: of ``ids`` those of the tokens where the table has texts."""
        held = table.column("token_text" if signed and column == "ids" else column).take(pa.array(at)).combine_chunks()
        if pa.types.is_list(held.type):
            values, sizes = held.flatten().to_numpy(), np.diff(held.offsets.to_numpy())
        else:
            values, sizes = token_ids(held)
        return np.split(values, np.cumsum(sizes)[:-1])

    if signed:
        up = table.column("up").to_numpy()
    rows, cols = (np.flatnonzero(own == i), np.flatnonzero(own == j))
    ka, kb = k[rows][:, None].astype(np.int64), k[cols][None, :].astype(np.int64)
    # left sets come first: s of the left side is the smaller one
    need = ((ka + kb) * JACCARD_NUM + (JACCARD_NUM + JACCARD_DEN - 1)) // (JACCARD_NUM + JACCARD_DEN)
    forward = s[rows][:, None] < s[cols][None, :]
    if signed:  # two sets of one class meet in its own scheme
        may = (np.minimum(ka, kb) >= need) & ~(up[rows][:, None] & up[cols][None, :])
    else:
        may = np.minimum(ka - pos[rows][:, None], kb - pos[cols][None, :]) >= need
    may &= np.where(forward, left[rows][:, None], left[cols][None, :])
    may &= forward if i == j else s[rows][:, None] != s[cols][None, :]
    x, y = np.nonzero(may)
    if len(x):
        heads = "sigs" if signed else "ids"
        before = _products([h[:n] for h, n in zip(arrays(heads, rows), pos[rows])], [h[:n] for h, n in zip(arrays(heads, cols), pos[cols])], i == j)
        may &= before == 0
        # most pairs have met in a list before: the tokens of the others only
        at, bt = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        if i == j:
            at = bt = np.union1d(at, bt)
        x, y = np.nonzero(may[np.ix_(at, bt)])
        if len(x):
            inter = np.zeros(may.shape, np.int64)
            inter[np.ix_(at, bt)] = _products(arrays("ids", rows[at]), arrays("ids", cols[bt]), i == j and np.array_equal(at, bt))
            x, y = np.nonzero(may & (inter * (JACCARD_NUM + JACCARD_DEN) >= (ka + kb) * JACCARD_NUM))
    a, b = rows[x], cols[y]
    swap = s[a] > s[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    shared = inter[x, y].astype(np.int32) if len(x) else np.zeros(0, np.int32)
    if sums:
        m = table.column("m").to_numpy().astype(np.int64)
        lefts, place = np.unique(a, return_inverse=True)
        total = np.zeros(len(lefts), np.int64)
        np.add.at(total, place, m[b])
        return pa.table([pa.array([release] * len(lefts), pa.string()), pa.array(s[lefts]), pa.array(
            [Decimal(int(m[r]) * int(n)) for r, n in zip(lefts, total)], pa.decimal128(38, 0))], names=["release_id", "sa", "pairs"])
    if first is not None and len(a) > first:
        order = np.lexsort((s[b], s[a]))[:first]
        a, b, shared = a[order], b[order], shared[order]
    take = lambda c, at: table.column(c).combine_chunks().take(pa.array(at))
    return pa.table([pa.array([release] * len(a), pa.string()), take("s", a), take("s", b), take("m", a), take("m", b),
                     take("set_key", a), take("set_key", b), pa.array(shared), pa.array(k[a].astype(np.int32)), pa.array(k[b].astype(np.int32))],
                    names=PAIR)


def _left_sums(prep: Prepared) -> DataFrame:
    """For each set with a similar set after it, the row pairs with all of those:
    at most one row for each set.  Groups of candidates are compared in slices, one after the
    other, so that the texts dealt out for one are gone before the next."""
    def of(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("release_id", "sa", (exact(F.col("ma")) * exact(F.col("mb"))).cast("decimal(38,0)").alias("pairs"))
        return pairs.groupBy("release_id", "sa").agg(F.sum("pairs").alias("pairs"))

    def slice_of(k: int, n: int) -> DataFrame:
        own = _candidate_groups(prep).where(F.pmod(F.xxhash64("release_id", "group"), F.lit(n)) == k)
        name = f"near_compared:{k}"
        wanted = prep.memo(name, lambda: _wanted(own), columns=True)
        # few enough, they go to the texts, and only the tokens' hashes are dealt out
        return of(_compared(own, prep.texts, bounded_broadcast(wanted, _counted(prep, name, wanted))))

    def sums() -> DataFrame:
        n = min(SLICES, 1 + _counted(prep, "near_sets", token_sets(prep)) // SLICE_SETS)
        parts = [prep.memo(f"near_left:{k}", lambda k=k: slice_of(k, n), columns=True) for k in range(n)]
        if _dense(prep)[1]:
            n = min(SLICES, 1 + _touched(prep)[1] // DENSE_SETS)
            parts += [prep.memo(f"near_dense_left:{k}", lambda k=k: _by_dense_lists(prep, None, sums=True, turn=(k, n))
                                    .groupBy("release_id", "sa").agg(F.sum("pairs").alias("pairs")), columns=True)
                      for k in range(n)]
        both = reduce(DataFrame.unionByName, parts)
        return both.groupBy("release_id", "sa").agg(F.sum("pairs").alias("pairs"))

    return prep.memo("near_left", sums, columns=True)


def near_pairs(prep: Prepared) -> DataFrame:
    """Near-duplicate row pairs per release."""
    cross = _left_sums(prep).groupBy("release_id").agg(F.sum("pairs").alias("cross"))
    within = token_sets(prep).groupBy("release_id").agg(
        F.sum(pairs_of(F.col("m")) - F.col("same_fp_pairs")).alias("within"))
    return (within.join(cross, "release_id", "left")
            .select("release_id",
                    (F.coalesce("within", F.lit(0)) + F.coalesce("cross", F.lit(0)))
                    .cast("bigint").alias("pairs")))


def _near_evidence(prep: Prepared) -> DataFrame:
    """The first k row pairs (l, r) over all similar pairs.

    Every row pair comes from one source: a similar set pair, or one set
    whose rows carry different fingerprints.  Only the k sources with the
    smallest first pair can contribute, and those have their left set among the
    first k that have any; from a set pair only each side's first k rows matter;
    inside a set only the first k rows of its first k+1 fingerprint subgroups.
    All are top-k selections.
    """
    k = prep.limits.evidence_per_finding
    n = prep.n_releases
    lefts = top_k(_left_sums(prep).select("release_id", "sa"), ["release_id"], [F.col("sa")], k, "__lf")
    lefts = bounded_broadcast(lefts.select("release_id", "sa"), k * n)
    sp_top = prep.memo(f"near_first:{k}", lambda: top_k(
        similar_sets(prep, lefts, k), ["release_id"], [F.col("sa"), F.col("sb")], k, "__sp"), k * n)
    subs = _subgroups(prep)
    sub_rank = top_k(subs.select("release_id", "set_key", "fp_feature", "first"),
                     ["release_id", "set_key"], [F.col("first")], k + 1, "__sg")
    within_first = (sub_rank.where(F.col("__sg") <= 2)
                    .groupBy("release_id", "set_key")
                    .agg(F.min("first").alias("__l"), F.max("first").alias("__r"),
                         F.count(F.lit(1)).alias("__n"))
                    .where(F.col("__n") == 2))
    ws_top = top_k(within_first, ["release_id"], [F.col("__l"), F.col("__r")], k, "__ws")
    chosen = (sp_top.select("release_id", F.col("a_key").alias("set_key"))
              .unionByName(sp_top.select("release_id", F.col("b_key").alias("set_key")))
              .unionByName(ws_top.select("release_id", "set_key"))
              .distinct())
    chosen = bounded_broadcast(chosen, 3 * k * n)
    sub_keep = bounded_broadcast(sub_rank.join(chosen, ["release_id", "set_key"])
                                 .select("release_id", "set_key", "fp_feature"),
                                 3 * k * (k + 1) * n)
    rows = (_eligible_rows(prep).select("release_id", "set_key", "fp_feature", "_row", "k")
            .join(sub_keep, ["release_id", "set_key", "fp_feature"]))
    rows = prep.memo(f"near_rows:{k}", lambda: top_k(
        rows, ["release_id", "set_key", "fp_feature"], [F.col("_row")], k, "__rr")
        .select("release_id", "set_key", "fp_feature", "_row", "k"), 3 * k * k * (k + 1) * n)
    x, y = rows.alias("x"), rows.alias("y")
    within_pairs = (x.join(y, (F.col("x.release_id") == F.col("y.release_id"))
                           & (F.col("x.set_key") == F.col("y.set_key"))
                           & (F.col("x.fp_feature") != F.col("y.fp_feature"))
                           & (F.col("x._row") < F.col("y._row")))
                    .join(bounded_broadcast(ws_top.select(F.col("release_id").alias("__wr"),
                                                          F.col("set_key").alias("__wk")), k * n),
                          (F.col("x.release_id") == F.col("__wr"))
                          & (F.col("x.set_key") == F.col("__wk")))
                    .select(F.col("x.release_id").alias("release_id"),
                            F.col("x._row").alias("l"), F.col("y._row").alias("r"),
                            F.col("x.k").alias("inter"), F.col("x.k").alias("ka"), F.col("x.k").alias("kb")))
    first = bounded_broadcast(sp_top.select("release_id", "a_key", "b_key", "inter", "ka", "kb"), k * n)
    cross_pairs = (first.join(x, (first.release_id == F.col("x.release_id"))
                              & (first.a_key == F.col("x.set_key")))
                   .join(y, (first.release_id == F.col("y.release_id"))
                         & (first.b_key == F.col("y.set_key")))
                   .select(first.release_id.alias("release_id"),
                           F.least("x._row", "y._row").alias("l"),
                           F.greatest("x._row", "y._row").alias("r"),
                           first.inter.alias("inter"), first.ka.alias("ka"), first.kb.alias("kb")))
    top = top_k(within_pairs.unionByName(cross_pairs), ["release_id"], [F.col("l"), F.col("r")], k)
    return top.select("release_id", (F.col("l") + 1).alias("l"), (F.col("r") + 1).alias("r"),
                      (F.col("inter") / (F.col("ka") + F.col("kb") - F.col("inter"))).alias("sim"),
                      "__rank")


def near_evidence(prep: Prepared) -> DataFrame:
    return evidence_rows(
        _near_evidence(prep), "near-duplicates",
        F.concat_ws(":", F.lit("near"), F.col("l").cast("string"), F.col("r").cast("string")),
        row=F.col("l"), other_row=F.col("r"),
        detail=F.concat(F.lit("The token sets agree by "), percent_text(F.col("sim")),
                        F.lit("%.")),
        ordinal=F.col("__rank"))


def near_findings(prep: Prepared) -> tuple[DataFrame, DataFrame]:
    p = near_pairs(prep).where(F.col("pairs") > 0)
    summary = F.concat(F.lit("Rows with nearly the same tokens: "), F.col("pairs").cast("string"),
                       plural(F.col("pairs"), " pair.", " pairs."))
    return finding_rows(p, "near-duplicates", F.col("pairs"), summary), near_evidence(prep)
