"""Language identification by interpolated Kneser-Ney character models.

Each language has a character model of order ``ORDER`` over words in a leading
and a closing space.  Lower orders count distinct left neighbours, as
Kneser-Ney does; n-grams that begin a word have no left neighbour and keep their
counts.  The models of all languages share, for each order, one array of sorted
64-bit n-gram hashes with a column of interpolated log-probabilities for each
language, and one of context hashes with their back-off weights; a lookup is a
binary search.  A text's cross-entropy for each character follows from its
words, whose sums are kept for frequent words.  The lowest cross-entropy wins.

Calibration uses sampled documents that the models have not counted: a
temperature turns the entropies into probabilities (``score``), and for each
language the spread of its own documents' entropy gives the limit beyond which
a text is ``rejected`` as being in none of the learned languages.

The models are fitted on a bounded sample: for each language the ``FIT_DOCS``
documents (fewer where there are fewer) of the smallest hashes of id and text among
rows whose ``lang`` is set and which are not held out; equal rows count once.  Where
they have more than ``FIT_CHARS`` characters, the longest give ``PIECES`` pieces,
spread over the text, of as many characters as leave room for all.  All
documents are classified, each in its own task: no shuffle.

Defined results: a null text, one without letters and every text where nothing
could be learned get ``und``, score 0 and are rejected; equal texts get equal
results; a tie goes to the language first in order; other columns are ignored
(``identify``) or carried (``keep_known``); an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_number, map_arrow, written

ORDER = 4
DISCOUNT = 0.75
FIT_DOCS = 400
FIT_CHARS = 1_200_000
PIECES = 8
#: A share of the sample calibrates instead of being counted.
CALIBRATE_EVERY = 4
LETTER = re.compile(r"[^\W\d_]")
_P = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def split_words(text: str) -> list[str]:
    return text.lower().split()


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """The characters of the words in spaces, their place in their word, their
    hashes H[k] of the k characters that end there, and each one's word."""
    text = "".join(f" {w} " for w in words)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes = [np.full(len(chars), 1, dtype=np.uint64)]
    for k in range(ORDER):
        before = np.full(len(chars), k + 1, dtype=np.uint64) if k == 0 else np.r_[np.uint64(0), hashes[k][:-1]]
        h = (before ^ (before >> _SHIFT)) * _P + (chars + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        hashes.append(h ^ (h >> np.uint64(32)))
    return chars, place, hashes, word


def _one_model(counts: dict[str, int], alphabet: int) -> list[tuple]:
    """For each order (gram hashes, log P, context hashes, log back-off)."""
    words = sorted(counts)
    weight = np.array([counts[w] for w in words], dtype=np.float64)
    _, place, H, word = _grams(words)
    w = weight[word]
    out = []
    lower = lower_keys = None
    for k in range(1, ORDER + 1):
        ok = place >= max(k - 1, 1)  # the leading space is given, not predicted
        key, end = H[k][ok], np.flatnonzero(ok)
        grams, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        n = np.bincount(inverse, weights=w[end], minlength=len(grams))
        if k < ORDER:
            left = place[end] >= k  # there is a character to the left
            longer, at = np.unique(H[k + 1][end[left]], return_index=True)
            kinds = np.bincount(np.searchsorted(grams, key[left][at]), minlength=len(grams)).astype(np.float64)
            begins = np.zeros(len(grams), dtype=bool)
            begins[inverse[~left]] = True
            n = np.where(begins, n, np.maximum(kinds, 1))
        last = end[first]
        context = H[k - 1][last - 1] if k > 1 else np.ones(len(grams), dtype=np.uint64)
        contexts, which = np.unique(context, return_inverse=True)
        total = np.bincount(which, weights=n)
        types = np.bincount(which)
        backoff = DISCOUNT * types / total
        if k == 1:
            below = np.full(len(grams), 1.0 / alphabet)
        else:
            below = lower[np.searchsorted(lower_keys, H[k - 1][last])]
        p = np.maximum(n - DISCOUNT, 0) / total[which] + backoff[which] * below
        out.append((grams, np.log(p), contexts, np.log(backoff)))
        lower, lower_keys = p, grams
    return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], fill: float) -> tuple[np.ndarray, np.ndarray]:
    """One sorted array of the keys of all languages and a column for each."""
    keys = np.unique(np.concatenate([k for k, _ in parts]))
    values = np.full((len(keys), len(parts)), fill)
    for c, (k, v) in enumerate(parts):
        values[np.searchsorted(keys, k), c] = v
    return keys, values


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key, or -1."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Model:
    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    backoffs: list[tuple[np.ndarray, np.ndarray]]
    floor: float
    scale: float = 1.0
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None

    def word_logs(self, words: list[str]) -> np.ndarray:
        """log P of each word and its closing space, a column for each language."""
        out = np.zeros((len(words), len(self.languages)))
        if not words:
            return out
        _, place, H, word = _grams(words)
        logs = np.full((len(place), len(self.languages)), self.floor)
        for k in range(1, ORDER + 1):
            ok = np.flatnonzero(place >= max(k - 1, 1))
            if not len(ok):
                continue
            keys, weights = self.backoffs[k - 1]
            at = _find(keys, H[k - 1][ok - 1] if k > 1 else np.ones(len(ok), dtype=np.uint64))
            now = logs[ok] + np.where((at >= 0)[:, None], weights[at], 0.0)
            keys, values = self.grams[k - 1]
            at = _find(keys, H[k][ok])
            seen = values[at]
            logs[ok] = np.where((at >= 0)[:, None] & ~np.isnan(seen), seen, now)
        logs[place == 0] = 0.0
        for c in range(logs.shape[1]):
            out[:, c] = np.bincount(word, weights=logs[:, c], minlength=len(words))
        return out


class Entropies:
    """Cross-entropies of texts, with the sums of words kept."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit = model, limit
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(entropy for each character and language, characters)."""
        split = [split_words(t) for t in texts]
        if len(self.index) > self.limit:
            self.index, self.rows = {}, self.rows[:0]
        new = [w for w in set().union(*split) if w not in self.index] if split else []
        blocks, size, block = [], 0, []
        for w in new:  # bounded arrays, however long the words are
            block.append(w)
            size += len(w)
            if size > 100_000:
                blocks.append(self.model.word_logs(block))
                block, size = [], 0
        blocks.append(self.model.word_logs(block))
        self.index.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.rows = np.concatenate([self.rows, *blocks])
        sums = np.zeros((len(texts), len(self.model.languages)))
        chars = np.ones(len(texts))
        get = self.index.__getitem__
        for k, words in enumerate(split):
            if words:
                sums[k] = self.rows[np.fromiter(map(get, words), dtype=np.int64, count=len(words))].sum(axis=0)
                chars[k] = sum(map(len, words)) + len(words)
        return -sums / chars[:, None], chars


def train(texts: dict[str, list[str]]) -> Model | None:
    """The calibrated models of ``{language: whole texts}``."""
    languages = sorted(k for k, v in texts.items() if any(split_words(t) for t in v))
    if not languages:
        return None
    counted: dict[str, dict[str, int]] = {k: {} for k in languages}
    held: list[tuple[int, str]] = []
    for c, lang in enumerate(languages):
        for k, t in enumerate(texts[lang]):
            if k % CALIBRATE_EVERY == CALIBRATE_EVERY - 1:
                held.append((c, t))
            else:
                for w in split_words(t):
                    counted[lang][w] = counted[lang].get(w, 0) + 1
        if not counted[lang]:
            for w in (w for t in texts[lang] for w in split_words(t)):
                counted[lang][w] = counted[lang].get(w, 0) + 1
    alphabet = len(set().union(*(set(w) for d in counted.values() for w in d))) + 2
    models = [_one_model(counted[k], alphabet) for k in languages]
    model = Model(languages, [_merged([m[k][:2] for m in models], np.nan) for k in range(ORDER)],
                  [_merged([m[k][2:] for m in models], 0.0) for k in range(ORDER)], float(np.log(1.0 / alphabet)))
    held = [(c, t) for c, t in held if split_words(t)] or [(c, t) for c, k in enumerate(languages) for t in texts[k] if split_words(t)]
    true = np.array([c for c, _ in held])
    entropy, chars = Entropies(model).of([t for _, t in held])
    best = np.inf
    for scale in (0.05, 0.1, 0.2, 0.5, 1.0):
        post = posterior(entropy, chars, scale)
        loss = -np.log(np.maximum(post[np.arange(len(true)), true], 1e-12)).mean()
        if loss < best - 1e-9:
            best, model.scale = loss, scale
    own = entropy[np.arange(len(true)), true]
    hit = entropy.argmin(axis=1) == true
    model.centre, model.spread = np.empty(len(languages)), np.empty(len(languages))
    for c in range(len(languages)):
        mine = (true == c) & hit if ((true == c) & hit).any() else np.ones(len(true), dtype=bool)
        model.centre[c] = np.median(own[mine])
        z = np.abs(own[mine] - model.centre[c]) * np.sqrt(np.minimum(chars[mine], 400))
        model.spread[c] = max(2.0 * float(z.max()), 6.0)
    return model


def posterior(entropy: np.ndarray, chars: np.ndarray, scale: float) -> np.ndarray:
    """Probabilities from entropies: a likelihood of at most 400 characters."""
    x = -entropy * np.minimum(chars, 400)[:, None] * scale
    x -= x.max(axis=1, keepdims=True)
    e = np.exp(x)
    return e / e.sum(axis=1, keepdims=True)


def room(sizes: list[int], total: int) -> int:
    """The most characters that each text may give so that all of them together
    give at most ``total``; no fewer than one."""
    for k, n in enumerate(sizes := sorted(sizes)):
        share = total // (len(sizes) - k)
        if n > share:
            return max(1, share)
        total -= n
    return max(1, sizes[-1]) if sizes else 1


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           held_out_mod: int | None = 5, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> dict[str, list[str]]:
    """Texts by language.  At most ``fit_docs`` documents and ``fit_chars`` characters of each language
    leave the executors; every language that has words gives some."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(key.alias("key"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(
        F.col("l").isNotNull() & F.col("t").rlike(r"(?U)\S"))
    if held_out_mod:
        rows = rows.where(F.crc32(F.encode("key", "UTF-8")) % held_out_mod != 0)
    rows = rows.withColumn("h", F.xxhash64(F.lit("langid"), "key").bitwiseAND(F.lit((1 << 63) - 1))).withColumn("th", F.xxhash64("t"))
    thin = written(rows.select("l", "h", "th", F.length("t").alias("n")).groupBy("l", "h", "th").agg(F.max("n").alias("n")), "langid-rows")
    # counts by steps of the hash, a fifth each, say how small it is for the first fit_docs: no language's rows meet in one task
    thin = thin.withColumn("step", F.floor(4 * (63 - F.log2(F.col("h") + F.lit(1.0)))).cast("int"))
    steps: dict[str, int] = {}
    held: dict[str, int] = {}
    for r in sorted(thin.groupBy("l", "step").count().collect(), key=lambda r: -r.step):
        if held.get(r.l, 0) < fit_docs:
            steps[r.l], held[r.l] = r.step, held.get(r.l, 0) + r["count"]
    if not steps:
        return {}
    least = F.broadcast(spark.createDataFrame(sorted(steps.items()), "l string, least int"))
    seen: dict[str, list] = {}
    for r in thin.join(least, "l").where("step >= least").select("l", "h", "th", "n").collect():
        seen.setdefault(r.l, []).append(r)
    picked = [r for found in seen.values() for r in sorted(found, key=lambda r: (r.h, r.th))[:fit_docs]]
    sizes: dict[str, list[int]] = {}
    for r in picked:
        sizes.setdefault(r.l, []).append(r.n)
    most = {lang: room(n, fit_chars) for lang, n in sizes.items()}
    chosen = spark.createDataFrame([(r.l, r.h, r.th, most[r.l]) for r in picked], "l string, h long, th long, most int")
    text = F.trim(F.regexp_replace("t", r"(?U)\s+", " "))
    size = f"(cast(most / {PIECES} as int) - 1)"  # and a space
    pieces = F.expr(f"transform(sequence(0, {PIECES - 1}), i -> substring(t, 1 + cast(i * ((length(t) - {size}) / {PIECES - 1}) as int), {size}))")
    given = (rows.join(F.broadcast(chosen), ["l", "h", "th"]).select("l", "key", "h", "th", "most", text.alias("t"))
             .select("l", "key", "h", "th", F.when(F.length("t") <= F.col("most"), F.col("t"))
                     .when(F.expr(f"{size} < 1"), F.expr("substring(t, 1, most)")).otherwise(F.concat_ws(" ", pieces)).alias("t"))
             .dropDuplicates(["l", "h", "th"]))
    texts: dict[str, list[str]] = {}
    for _, _, lang, t in sorted((zlib.crc32(r.key.encode()), r.key, r.l, r.t) for r in given.select("l", "key", "t").collect()):
        texts.setdefault(lang, []).append(t)
    return texts


def fit(docs: DataFrame, **where) -> Model | None:
    return train(sample(docs, **where))


def _classifier(model):
    entropies = Entropies(model.value) if model.value else None

    def classify(texts: list[str | None]) -> tuple[list, list, list, list]:
        n = len(texts)
        lang, score, rejected, entropy = ["und"] * n, [0.0] * n, [True] * n, [None] * n
        rows = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if entropies else []
        if rows:
            m = model.value
            H, chars = entropies.of([texts[k] for k in rows])
            best = H.argmin(axis=1)
            post = posterior(H, chars, m.scale)[np.arange(len(rows)), best]
            low = H[np.arange(len(rows)), best]
            far = (low - m.centre[best]) * np.sqrt(np.minimum(chars, 400)) > m.spread[best]
            for k, b, p, h, f in zip(rows, best.tolist(), post.tolist(), low.tolist(), far.tolist()):
                lang[k], score[k], rejected[k], entropy[k] = m.languages[b], p, f, h
        return lang, score, rejected, entropy

    return classify


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
             held_out_mod: int = 5) -> DataFrame:
    """(id, held_out, lang_pred, score, rejected, entropy) for each row."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def make():
        classify = _classifier(shared)

        def work(batch):
            lang, score, rejected, entropy = classify(batch.column(text_col).to_pylist())
            return {id_col: batch.column(id_col),
                    "held_out": [fold_number(i) % held_out_mod == 0 for i in batch.column(id_col).to_pylist()],
                    "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()),
                    "rejected": pa.array(rejected, pa.bool_()), "entropy": pa.array(entropy, pa.float64())}

        return work

    return map_arrow(docs.select(id_col, text_col), make,
                     "held_out boolean, lang_pred string, score double, rejected boolean, entropy double", [id_col])


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text", records: int = 512) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not rejected."""
    import pyarrow as pa

    from .common import released, small_batches

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        classify = _classifier(shared)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array([not r for r in classify(batch.column(text_col).to_pylist())[2]]))

    return small_batches(docs, records).mapInArrow(released(run), docs.schema)
