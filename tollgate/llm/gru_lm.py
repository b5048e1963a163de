"""Scores of a gated recurrent language model with a class-factored softmax.

Tokens are words and one end for each text.  ``base`` is a smoothed unigram over
all training tokens of the whole corpus, counted by Spark.  The recurrent model
knows the ``WORDS`` most frequent of them; they fall into classes of ``WIDTH`` by
frequency, and P(word) = P(class | state) P(word | class, state).  All other words
share one entry, within which they keep the ratios of their base probabilities,
so the model is a distribution over the same tokens as the base.

The model is trained on all training tokens, in numpy, by truncated
backpropagation through time.  Texts are cut into segments of ``SEGMENT`` words,
dealt by hash into shards of about ``SHARD_TOKENS``; in each of ``ROUNDS`` rounds
every shard starts from the common model and takes its own steps, and the models
are averaged by tokens, in groups first and then on the driver.  The rounds go
through disjoint slices that are all segments together, whatever the number of
tokens (``passes_of``).  In training the state is carried from
window to window until a segment ends, and the next one begins with the word
before it; in scoring until the text ends, so a text's score is the
log-likelihood of all of it however long it is.

Texts are cut into words once to be counted and once to be numbered.  Counts of
the ``LISTED`` most frequent tokens go to every task; only occurrences of rarer
tokens travel, one row for each text and token, to be joined with the counts.

Defined results: a null or empty text is its end alone; a null id counts as the
empty text for the fold; equal texts get equal scores; without training tokens
both scores are those of the smoothed unigram over nothing (0); other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_number, small_batches, words_of, written

END = b""  # no word is empty
WORDS, WIDTH = 2048, 64
HIDDEN = 16
LISTED = 100_000
WINDOW, LANES, EPOCHS, RATE = 32, 48, 4, 0.006
SEGMENT, SHARD_TOKENS, ROUNDS = 1024, 4_000_000, 4
SEED = 3


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class Gru:
    """x: input rows of each word for the three gates; u: recurrence; c, w and
    their biases: class and word outputs."""

    x: np.ndarray
    u: np.ndarray
    c: np.ndarray
    cb: np.ndarray
    w: np.ndarray
    wb: np.ndarray

    @staticmethod
    def new(words: int, hidden: int = HIDDEN) -> "Gru":
        rng = np.random.default_rng(SEED)
        classes = -(-words // WIDTH)
        f = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        m = Gru(f(words, 3 * hidden), f(hidden, 3 * hidden), f(hidden, classes), np.zeros(classes, np.float32),
                f(classes, hidden, WIDTH), np.zeros((classes, WIDTH), np.float32))
        m.x[:, :hidden] += 1.0  # states last from the start
        m.wb[-1, words - (classes - 1) * WIDTH:] = -1e9  # places of the last class without a word
        return m

    def arrays(self) -> list[np.ndarray]:
        return [self.x, self.u, self.c, self.cb, self.w, self.wb]

    def step(self, ids, h):
        k = h.shape[1]
        gx, gu = self.x[ids], h @ self.u
        zr = _sigmoid(gx[:, :2 * k] + gu[:, :2 * k])
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(gx[:, 2 * k:] + r * gu[:, 2 * k:])
        return n + z * (h - n), (z, r, n, gu[:, 2 * k:])

    def logs(self, states, words) -> np.ndarray:
        """log P of each word in its state."""
        cls, place = words // WIDTH, words % WIDTH
        logits = states @ self.c + self.cb
        top = logits.max(axis=1)
        out = logits[np.arange(len(words)), cls] - top - np.log(np.exp(logits - top[:, None]).sum(axis=1))
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(len(self.cb) + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            rows = order[cuts[k]:cuts[k + 1]]
            inner = states[rows] @ self.w[k] + self.wb[k]
            top = inner.max(axis=1)
            out[rows] += inner[np.arange(len(rows)), place[rows]] - top - np.log(np.exp(inner - top[:, None]).sum(axis=1))
        return out

    def window(self, ids, words, fresh, h):
        """Gradients of the mean loss of one window (time, lane), and its last
        state.  ``fresh`` marks where a text begins; words below 0 are no targets."""
        steps, k = len(ids), h.shape[1]
        states, caches, before = [], [], []
        for t in range(steps):
            h = np.where(fresh[t][:, None], np.float32(0), h)
            before.append(h)
            h, cache = self.step(ids[t], h)
            states.append(h)
            caches.append(cache)
        s, y = np.concatenate(states), words.reshape(-1)
        ok = np.flatnonzero(y >= 0)
        grads = [np.zeros_like(a) for a in self.arrays()]
        gx, gu, gc, gcb, gw, gwb = grads
        ds = np.zeros_like(s)
        if len(ok):
            sv, yv = s[ok], y[ok]
            cls, place = yv // WIDTH, yv % WIDTH
            logits = sv @ self.c + self.cb
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(ok)), cls] -= 1
            p /= len(ok)
            gc += sv.T @ p
            gcb += p.sum(axis=0)
            d = p @ self.c.T
            order = np.argsort(cls, kind="stable")
            cuts = np.searchsorted(cls[order], np.arange(len(self.cb) + 1))
            for j in np.flatnonzero(np.diff(cuts)).tolist():
                rows = order[cuts[j]:cuts[j + 1]]
                inner = sv[rows] @ self.w[j] + self.wb[j]
                q = np.exp(inner - inner.max(axis=1, keepdims=True))
                q /= q.sum(axis=1, keepdims=True)
                q[np.arange(len(rows)), place[rows]] -= 1
                q /= len(ok)
                gw[j] += sv[rows].T @ q
                gwb[j] += q.sum(axis=0)
                d[rows] += q @ self.w[j].T
            ds[ok] = d
        ds = ds.reshape(steps, -1, k)
        dx = np.empty((*ids.shape, 3 * k), dtype=s.dtype)
        dh = np.zeros_like(h)
        for t in reversed(range(steps)):
            dh = dh + ds[t]
            z, r, n, un = caches[t]
            prev = before[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (prev - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            dx[t, :, :k], dx[t, :, k:2 * k], dx[t, :, 2 * k:] = dz, dr, dn
            du = np.concatenate([dz, dr, dn * r], axis=1)
            gu += prev.T @ du
            dh = np.where(fresh[t][:, None], np.float32(0), dh * z + du @ self.u.T)
        order = np.argsort(ids, axis=None, kind="stable")
        used, cuts = np.unique(ids.reshape(-1)[order], return_index=True)
        gx[used] = np.add.reduceat(dx.reshape(-1, 3 * k)[order], cuts, axis=0)
        return grads, h


def _lanes(texts: list[np.ndarray], lanes: int, leads: list[int] | None = None):
    """Texts laid out in lanes of about equal length, long ones first:
    (inputs, targets, text, begins), each (time, lane), lanes longest first; no
    target is -1.  An input is the word before, at first the text's lead or else
    the end of a text."""
    sizes = np.array([len(t) for t in texts])
    lanes = max(1, min(lanes, len(texts)))
    loads, own = [0] * lanes, [[] for _ in range(lanes)]
    import heapq

    heap = [(0, k) for k in range(lanes)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, k = heapq.heappop(heap)
        own[k].append(i)
        loads[k] = load + int(sizes[i])
        heapq.heappush(heap, (loads[k], k))
    rank = sorted(range(lanes), key=lambda k: -loads[k])
    deep = max(loads)
    ids, words = np.ones((deep, lanes), dtype=np.int64), np.full((deep, lanes), -1, dtype=np.int64)
    text, fresh = np.zeros((deep, lanes), dtype=np.int64), np.zeros((deep, lanes), dtype=bool)
    for col, k in enumerate(rank):
        at = 0
        for i in own[k]:
            n = len(texts[i])
            ids[at, col] = leads[i] if leads else 1
            ids[at + 1:at + n, col] = texts[i][:-1]
            words[at:at + n, col] = texts[i]
            text[at:at + n, col] = i
            fresh[at, col] = True
            at += n
    return ids, words, text, fresh


def _begin(model: Gru, seen: np.ndarray) -> Gru:
    """The output biases of ``model`` set to the words' counts."""
    words = len(seen)
    cls = np.bincount(np.arange(words) // WIDTH, weights=seen)
    model.cb[:] = np.log(cls / cls.sum())
    model.wb.reshape(-1)[:words] = np.log(seen / np.repeat(cls, WIDTH)[:words])
    return model


def _learn(model: Gru, texts: list[np.ndarray], leads: list[int] | None = None, epochs: int = 1, seed: int = SEED,
           last: bool = True) -> Gru:
    """Adam on windows of ``WINDOW`` steps in ``LANES`` lanes; changes ``model``.
    ``last``: the last epoch is the last of all and takes smaller steps."""
    rng = np.random.default_rng(seed)
    first, second = [np.zeros_like(a) for a in model.arrays()], [np.zeros_like(a) for a in model.arrays()]
    turn = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        ids, tgt, _, fresh = _lanes([texts[i] for i in order], LANES, [leads[i] for i in order] if leads else None)
        h = np.zeros((ids.shape[1], HIDDEN), dtype=np.float32)
        for t in range(0, len(ids), WINDOW):
            grads, h = model.window(ids[t:t + WINDOW], tgt[t:t + WINDOW], fresh[t:t + WINDOW], h)
            turn += 1
            norm = math.sqrt(sum(float((g * g).sum()) for g in grads))
            shrink = min(1.0, 1.0 / max(norm, 1e-9))
            rate = RATE * min(1.0, turn / 20) * (0.4 if last and epoch == epochs - 1 else 1.0)
            for a, g, m, v in zip(model.arrays(), grads, first, second):
                g *= shrink
                m += 0.1 * (g - m)
                v += 0.002 * (g * g - v)
                a -= rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.998 ** turn)) + 1e-7)
    return model


def train(texts: list[np.ndarray], words: int, epochs: int = EPOCHS) -> Gru:
    """A model of the given texts, in one place."""
    model = Gru.new(words)
    if not texts:
        return model
    return _learn(_begin(model, np.bincount(np.concatenate(texts), minlength=words) + 0.5), texts, epochs=epochs)


def likelihoods(model: Gru, texts: list[np.ndarray], lanes: int = 512) -> np.ndarray:
    """The natural log-likelihood of each whole text."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    ids, words, text, fresh = _lanes(texts, lanes)
    active = (words >= 0).sum(axis=1)
    h = np.zeros((ids.shape[1], model.u.shape[0]), dtype=np.float32)
    for t0 in range(0, len(ids), WINDOW):
        states, targets, owners = [], [], []
        for t in range(t0, min(t0 + WINDOW, len(ids))):
            n = int(active[t])  # lanes are longest first, so the rest has ended
            h = h[:n]
            if fresh[t, :n].any():
                h = np.where(fresh[t, :n][:, None], np.float32(0), h)
            h, _ = model.step(ids[t, :n], h)
            states.append(h)
            targets.append(words[t, :n])
            owners.append(text[t, :n])
        logs = model.logs(np.concatenate(states), np.concatenate(targets))
        out += np.bincount(np.concatenate(owners), weights=logs, minlength=len(texts))
    return out


def _counts(docs: DataFrame, folds: int, limit: int = 500_000) -> DataFrame:
    """(token, c) over the training texts."""
    import pyarrow as pa

    def run(batches):
        sums: Counter = Counter()

        def out():
            keys = list(sums)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([sums[k] for k in keys], pa.int64())],
                                              names=["token", "c"])

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if fold_number(i) % folds:
                    sums.update(words_of(text))
                    sums[END] += 1
            if len(sums) > limit:
                yield out()
                sums.clear()
        if sums:
            yield out()

    return (small_batches(docs, 512).mapInArrow(run, "token binary, c long")
            .groupBy("token").agg(F.sum("c").alias("c")))


def _cut(ids: np.ndarray) -> list[bytes]:
    """A text in segments of ``SEGMENT`` words, each after the word before it."""
    ids = np.concatenate([[1], ids]).astype("<u2")
    return [ids[k:k + SEGMENT + 1].tobytes() for k in range(0, len(ids) - 1, SEGMENT)]


def _join(segments: list[bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(s, "<u2")[1:] for s in segments]).astype(np.int64)


def passes_of(total: int) -> int:
    """How often training goes through all of ``total`` tokens: once, however many they are."""
    return 1


def dealt(texts: DataFrame, total: int, turn: int) -> DataFrame:
    """(at, segment) of the slice of ``texts`` (row, segments) that round ``turn``
    trains on; its partitions are the shards."""
    place = [F.col("row"), F.col("pos")]
    return (texts.select("row", F.posexplode("segments").alias("pos", "segment"))
            .where(F.pmod(F.xxhash64(F.lit("slice"), *place) - turn, F.lit(ROUNDS // passes_of(total))) == 0)
            .select(F.xxhash64(*place).alias("at"), "segment")
            .repartition(max(1, -(-total // SHARD_TOKENS)), "at"))


def _merged(rows: list[tuple]) -> tuple[int, int, np.ndarray]:
    """(first shard, tokens, mean model) of such rows, added in the order of shards."""
    rows = sorted(rows, key=lambda r: r[0])
    tokens = sum(r[1] for r in rows)
    mean = np.zeros(len(rows[0][2]) // 4)
    for r in rows:
        mean += np.frombuffer(r[2], "<f4") * (r[1] / tokens)
    return rows[0][0], tokens, mean


def _fit(texts: DataFrame, total: int, model: Gru) -> Gru:
    """``model`` trained on all segments of ``texts`` (row, segments)."""
    import pyarrow as pa

    schema = "shard long, tokens long, mean binary"
    groups = math.isqrt(max(1, -(-total // SHARD_TOKENS)) - 1) + 1

    def packed(shard, tokens, mean):
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([tokens], pa.int64()),
                                           pa.array([mean.astype("<f4").tobytes()], pa.binary())], names=["shard", "tokens", "mean"])

    def merge(batches):
        rows = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
        if rows:
            yield packed(*_merged(rows))

    for turn in range(ROUNDS):
        common = texts.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS

        def learn(batches, turn=turn, common=common):
            from pyspark import TaskContext

            held = []
            for batch in batches:
                held += zip(batch.column("at").to_pylist(), batch.column("segment").to_pylist())
            if held:
                own = [np.frombuffer(s, "<u2").astype(np.int64) for _, s in sorted(held)]
                mine = Gru(*[a.copy() for a in common.value.arrays()])
                _learn(mine, [x[1:] for x in own], [int(x[0]) for x in own], seed=SEED + turn, last=turn == ROUNDS - 1)
                yield packed(TaskContext.get().partitionId(), sum(len(x) - 1 for x in own),
                             np.concatenate([a.reshape(-1) for a in mine.arrays()]))

        means = small_batches(dealt(texts, total, turn), 512).mapInArrow(learn, schema)
        rows = [tuple(r) for r in means.repartition(groups).mapInArrow(merge, schema).collect()]  # the root of the shards
        if rows:
            cuts = np.cumsum([a.size for a in model.arrays()])[:-1]
            parts = np.split(_merged(rows)[2].astype(np.float32), cuts)
            model = Gru(*[x.reshape(a.shape) for x, a in zip(parts, model.arrays())])
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    import pyarrow as pa

    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = written(_counts(docs, folds), "lm-counts")
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    whole = n + 0.1 * (v + 1)
    top = counts.where(F.col("token") != F.lit(END)).orderBy(F.desc("c"), "token").limit(LISTED).toArrow()
    ends = counts.where(F.col("token") == F.lit(END)).first()
    listed = [END, *top.column("token").to_pylist()]
    seen = np.r_[ends.c if ends else 0, top.column("c").to_numpy()].astype(np.float64)
    known = min(WORDS - 1, len(listed))
    # entry 0 is every other word, entry 1 the end, then by frequency
    rest = max(1e-12, 1.0 - float(((seen[:known] + 0.1) / whole).sum()))
    index = {t: k for k, t in enumerate(listed)}

    def ids_of(ranks: np.ndarray) -> np.ndarray:
        return np.where((ranks >= 0) & (ranks < known), ranks + 1, 0)

    shared = docs.sparkSession.sparkContext.broadcast((listed, seen))  # bounded by LISTED
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        tokens, c = shared.value
        rank = {t: k for k, t in enumerate(tokens)}
        log = np.log10((c + 0.1) / whole)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            base, hits, sizes, other, texts = [], [], [], [], []
            rare_row, rare_token, rare_n = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                r = np.fromiter(map(rank.get, words, repeat(-1)), dtype=np.int64, count=len(words))
                missing = Counter(w for w, k in zip(words, (r < 0).tolist()) if k) if (r < 0).any() else {}
                r = np.append(r, 0)
                own = r[r >= 0]
                sizes.append(len(r))
                base.append(float(log[own].sum()))
                hits.append(int((c[own] > 0).sum()))
                ids = ids_of(r)
                # what the shared entry's words outside of the list add comes later
                shared_words = own[own >= known]
                other.append(float(log[shared_words].sum()) - int((ids == 0).sum()) * math.log10(rest))
                texts.append(_cut(ids))
                rare_row += [row + len(sizes) - 1] * len(missing)
                rare_token += missing.keys()
                rare_n += missing.values()
            k = len(sizes)
            held = [fold_number(i) % folds == 0 for i in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array(range(row, row + k), pa.int64()), batch.column("id"), pa.array(held, pa.bool_()),
                pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()),
                pa.array(other, pa.float64()), pa.array(texts, segments), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], names=names)
            m = len(rare_row)
            if m:
                yield pa.RecordBatch.from_arrays([
                    pa.array(rare_row, pa.int64()), pa.nulls(m, batch.column("id").type), pa.nulls(m, pa.bool_()),
                    pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()),
                    pa.nulls(m, segments), pa.array(rare_token, pa.binary()), pa.array(rare_n, pa.int64())], names=names)
            row += k

    segments = pa.list_(pa.binary())
    names = ["row", "id", "held_out", "n_tokens", "hits", "base", "other", "segments", "token", "n"]
    fields = f"row long, id {kind}, held_out boolean, n_tokens long, hits long, base double, other double"
    rows = written(small_batches(docs, 512).mapInArrow(run, f"{fields}, segments array<binary>, token binary, n long"), "lm-rows")
    texts = rows.where("token is null")
    model = None
    if n:
        # entry 0 is every other word and has what the listed ones leave
        counted = np.r_[max(0.0, n - seen[:known].sum()), seen[:known]] + 0.5
        model = _fit(texts.where("not held_out").select("row", "segments"), n, _begin(Gru.new(known + 1), counted))
    common = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS

    def rate(batches):
        for batch in batches:
            made = batch.column("base")
            if common.value:
                logs = likelihoods(common.value, [_join(t) for t in batch.column("segments").to_pylist()])
                made = pa.array(logs / math.log(10) + batch.column("other").to_numpy(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), made], names=[*kept, "made"])

    kept = names[:6]
    made = written(small_batches(texts.select(*names[:8]), 512).mapInArrow(
        rate, f"{fields.rpartition(',')[0]}, made double"), "lm-scores")
    each = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(whole))
    rare = (rows.where("token is not null").select("row", "token", "n").join(counts, "token", "left")
            .groupBy("row").agg(F.sum(F.col("n") * each).alias("more"),
                                F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("found")))
    more = F.coalesce("more", F.lit(0.0))
    return made.join(rare, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("hits") + F.coalesce("found", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
        (F.col("made") + more).alias("score"))
