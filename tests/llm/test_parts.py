"""Parts of the operators that need no Spark."""

from __future__ import annotations

import math
import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from tollgate.llm import gru_lm, html_paths, jaccard_join, langid_kn, license_scan, packing, pii_gbt, pstable, spaced_seeds


@pytest.mark.parametrize("text,grade,labels", [
    ("MIT", 1.0, "mit"), ("MIT OR GPL-3.0-only", 1.0, "gpl-3,mit"), ("mit and gpl-3.0-or-later", 0.3, "gpl-3,mit"),
    ("GPL-2.0 WITH Classpath-exception-2.0", 0.5, "gpl-2"), ("(MIT OR Zlib) AND CC-BY-NC-4.0", 0.2, "cc-by-nc,mit,zlib"),
    ("MIT AND GPL-3.0 OR Apache-2.0", 1.0, "apache-2,gpl-3,mit"), ("MIT AND (GPL-3.0 OR Apache-2.0)", 1.0, "apache-2,gpl-3,mit"),
    ("MIT the rest is text", 1.0, "mit"), ("MIT AND", 1.0, "mit"), ("(MIT OR GPL-3.0", 1.0, "gpl-3,mit"), ("own-1.0", 0.1, "own-1")])
def test_licence_expressions(text, grade, labels):
    got = license_scan.Scanner().scan(f"// SPDX-License-Identifier: {text}\nmore")
    assert (got[-1], got[-2]) == (grade, labels)


def test_licence_places():
    s = license_scan.Scanner()
    assert s.scan("Under the MIT-License; under the mit license. CC BY NC") == (11, 3, 0, 8, "cc-by-nc,mit", "cc-by-nc,mit", 0.2)
    assert s.scan(None) == s.scan("") == (0, 0, None, None, "", "", 0.0)
    assert s.scan("SPDX-License-Identifier: and and")[5] == ""


def test_masks_hit_every_tolerated_overlap():
    for n in range(spaced_seeds.LEAST, spaced_seeds.WINDOW + 1):
        w, allowed = spaced_seeds.window_of(n)
        for wrong in combinations(range(w), allowed):
            assert any(all(at + o not in wrong for o in m) for m in spaced_seeds.MASKS for at in range(w - m[-1]))


def test_seeds_against_brute_force():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(rnd.choices(words, k=rnd.choice([3, 8, 10, 13, 20, 40])))) for k in range(30)]
    texts = []
    for _ in range(150):
        t = rnd.choices(words, k=rnd.randint(0, 60))
        if rnd.random() < 0.7:
            part = rnd.choice(items)[1].split()
            a = rnd.randrange(len(part))
            part = part[a:a + rnd.randint(5, 30)]
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                part[rnd.randrange(len(part))] = "other"
            t = t[:20] + part + t[20:]
        texts.append(" ".join(t))
    texts += [None, "", texts[0]]
    want = set()
    for d, t in enumerate(texts):
        x = (t or "").split()
        for k, item in items:
            y = item.split()
            if len(y) < spaced_seeds.LEAST:
                continue
            w, allowed = spaced_seeds.window_of(len(y))
            if any(sum(a != b for a, b in zip(x[i:i + w], y[j:j + w])) <= allowed
                   for i in range(len(x) - w + 1) for j in range(len(y) - w + 1)):
                want.add((d, k))
    index = spaced_seeds.Index(items)
    got = {(d, index.keys[k]) for d, k, *_ in index.scan(texts)}
    assert got == want and len(want) > 10


def test_divide_skip_counts():
    rnd = random.Random(1)
    for _ in range(60):
        n, records = rnd.randint(1, 30), rnd.randint(1, 12)
        lists = [np.array(sorted(rnd.sample(range(records), rnd.randint(1, records)))) for _ in range(n)]
        needed = np.array([rnd.randint(1, n + 2) for _ in range(records)])
        count = np.zeros(records, dtype=int)
        for x in lists:
            count[x] += 1
        assert (jaccard_join.divide_skip(lists, needed) == np.where(count >= needed, count, 0)).all()


def test_sets_of_texts():
    texts = ["A b\tc  d e f", "a B c d e F", "a b c d e", "a b c", "", None, "c b a", "é b c d e", "x " * 3000 + "y", "  ", "\x85 a"]
    sets = jaccard_join.TextSets().of(texts)
    plain = []
    for t in texts:
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", (t or "").lower()) if x]
        plain.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for (s, p), (u, q) in combinations(list(zip(sets, plain)), 2):
        assert len(np.intersect1d(s, u)) == len(p & q)
    many = jaccard_join.TextSets().of(texts[::-1])[::-1]  # a set does not depend on its neighbours
    assert all((a == b).all() for a, b in zip(sets, many))


def test_collision_chance():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(200_000) * 0.3
    u = rng.uniform(0, pstable.WIDTH, 200_000)
    met = (np.floor(u / pstable.WIDTH) == np.floor((u + x) / pstable.WIDTH)).mean()
    assert abs(met - pstable.chance(0.3)) < 0.01


def test_gradients():
    rng = np.random.default_rng(2)
    m = gru_lm.Gru.new(70, hidden=5)
    for k, a in enumerate(m.arrays()):
        a[...] = np.where(a < -1e8, a, rng.standard_normal(a.shape) * 0.3)
    m = gru_lm.Gru(*[a.astype(np.float64) for a in m.arrays()])
    ids, fresh = rng.integers(0, 70, (6, 3)), rng.random((6, 3)) < 0.2
    words = rng.integers(-1, 70, (6, 3))
    start = rng.standard_normal((3, 5))

    def loss():
        h, states = start, []
        for t in range(6):
            h, _ = m.step(ids[t], np.where(fresh[t][:, None], 0, h))
            states.append(h)
        y = words.reshape(-1)
        return -m.logs(np.concatenate(states)[y >= 0], y[y >= 0]).mean()

    grads, _ = m.window(ids, words, fresh, start)
    for a, g in zip(m.arrays(), grads):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in a.shape)
            if a[at] < -1e8:
                continue
            old = a[at]
            a[at] = old + 1e-6
            up = loss()
            a[at] = old - 1e-6
            down = loss()
            a[at] = old
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_likelihood_is_a_distribution_and_carries_state():
    rng = np.random.default_rng(5)
    texts = [np.r_[rng.integers(2, 90, n), 1] for n in (1, 5, 200, 63, 64, 65, 0)]
    m = gru_lm.train(texts, 90, epochs=1)
    h = np.zeros((1, gru_lm.HIDDEN), dtype=np.float32)
    h, _ = m.step(np.array([1]), h)
    total = np.exp(m.logs(np.repeat(h, 90, axis=0), np.arange(90))).sum()
    assert abs(total - 1) < 1e-4
    alone = [float(gru_lm.likelihoods(m, [t])[0]) for t in texts]
    assert np.allclose(gru_lm.likelihoods(m, texts, lanes=2), alone, rtol=1e-4)
    slow = 0.0
    h = np.zeros((1, gru_lm.HIDDEN), dtype=np.float32)
    for before, word in zip([1, *texts[2][:-1]], texts[2]):
        h, _ = m.step(np.array([before]), h)
        slow += float(m.logs(h, np.array([word]))[0])
    assert abs(slow - alone[2]) < 1e-2


def test_language_models_are_distributions():
    texts = {"aa": ["abba baba abab " * 20, "ab ba"] * 4, "bb": ["cddc dcdc cdcd " * 20] * 5}
    m = langid_kn.train(texts)
    letters = sorted(set("".join(t for v in texts.values() for t in v)) | {" "})
    H, _ = langid_kn.Entropies(m).of(["abab", "cdcd"])
    assert H.argmin(axis=1).tolist() == [0, 1]
    # after a context, the letters and the end of the word share at most 1
    for c in range(2):
        base = m.word_logs(["ab"])[0, c]
        assert np.isfinite(base) and np.exp(m.word_logs([x for x in letters if x != " "])[:, c]).sum() <= 1 + 1e-9
    assert langid_kn.train({}) is None and langid_kn.train({"a": ["", " "]}) is None


@pytest.mark.parametrize("cut", [True, False])
def test_packing_limits(cut):
    rnd = random.Random(7)
    packer = packing.Packer(5 << 40, cut, tokens=64, segments=5, loss=40)
    sizes = [rnd.choice([0 if not cut else 1, 1, 2, 7, 30, 64, 65, 200]) for _ in range(300)]
    for k, n in enumerate(sizes):
        loss = np.array([rnd.random() < 0.5 for _ in range(n)], dtype=bool)
        packer.add(k, np.arange(n, dtype="<u4") + 1000 * k, loss)
        if len(packer.pool) > 50:
            packer.pack(20)
    packer.pack(0)
    by_doc, by_seq = {}, {}
    for piece, seq, offset in packer.rows:
        by_doc.setdefault(piece.key, []).append(piece)
        by_seq.setdefault(seq, []).append((offset, piece))
    assert not packer.pool and sorted(by_doc) == list(range(300))
    for k, pieces in by_doc.items():
        pieces.sort(key=lambda p: p.start)
        assert [p.start for p in pieces] == np.cumsum([0, *[len(p.ids) for p in pieces[:-1]]]).tolist()
        assert np.concatenate([p.ids for p in pieces]).tolist() == [1000 * k + i for i in range(sizes[k])]
        assert cut or len(pieces) == 1 or sizes[k] > 64 or len(pieces) == -(-sizes[k] // 64) or sizes[k] > 40
    padding = 0
    for rows in by_seq.values():
        rows.sort(key=lambda r: r[0])
        at = 0
        for offset, p in rows:
            assert offset == at
            at += len(p.ids)
        assert at <= 64 and len(rows) <= 5 and sum(int(p.loss.sum()) for _, p in rows) <= 40
        padding += 0 if at & (at - 1) == 0 else 64 - at
    if cut:
        assert padding == 0


def test_ids_equal_the_tokenizers():
    e = packing.DocumentIds()
    texts = ["It's the Gull's 12 oars!", "ÀÉ  naïve\u00a0x\u3000y", "a\x1cb", "<|endoftext|> x", "ΣΑΣ İi", "e\u0301 \u0301", "😀 ok" * 3,
             "", None, "x" * 3000, "don't   won'T\n\tI'LL", "\x85a"]
    for t, ids in zip(texts, e.of(texts)):
        assert ids.tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert zlib.crc32(ids.tobytes()) == zlib.crc32(np.array(ids, "<u4").tobytes())


ARTICLE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><a href=1>Home</a></nav>
<div class="cookie-notice">We use cookies</div><div id=main-12 class="post-77 content">
<h1>A &amp; B</h1><p>One <b>bold</b>,\n two&nbsp;three<br>four<p>Five<script>var x="</p>"; if (a<b) {}</script>
<ul><li>six<li>seven</ul><aside>no</aside><form>no</form><div class=advert>no</div><div hidden>no</div>
<section id="comments"><p>reader says</p></section><!-- <p>no</p> --><p title="a>b">eight</div>
<footer>&copy; x</footer></body></html>"""


def test_page_blocks():
    page = html_paths.Page(ARTICLE)
    assert page.best()[0].endswith("div.content.post-#")
    assert page.text([]) == "A & B\nOne bold, two three four\nFive\nsix\nseven\neight"
    for odd in (None, "", "<", "<p", "</p></p>", "<div><div class=ad>x", "<script>", "<a '<a '<a '", "<!--", "a<b", "<td>1<td>2"):
        html_paths.Page(odd).text(["/x"])
    assert html_paths.Page("plain <b>text</b>").text([]) == "plain text"


@pytest.mark.parametrize("around", ["<div class='layout no-sidebar'>", "<div class='with-sidebar'>", "<div class='has-header'>",
                                    "<div id='comments-open'>", "<div class='ads-free share-enabled'>", "<div class='sidebar'>",
                                    "<form action=x>", "<div aria-hidden=true><div class=overlay>", "<div class=header><article>"])
def test_layouts_are_read(around):
    tail = "<aside>no</aside><div class='sidebar'>side</div><section class='comments'><p>reader says</p></section>"
    page = html_paths.Page(f"<body><nav>{'<a href=1>Home page</a> ' * 40}</nav>{around}<p>A long <span class='hidden-xs'>main</span> text</p>{tail}")
    assert page.text([]) == "A long main text" and page.best()


def test_what_is_dropped_and_kept():
    page = html_paths.Page("<main><p>Let <math><mi>x</mi></math> be</p><noscript><p>plain</p></noscript><map>m</map><object>o</object>"
                           "<dialog>no</dialog><dialog open>yes</dialog><svg>no</svg><audio>no</audio></main>"
                           "<div class=comments><article>A comment longer than all of the text that the page itself has</article></div>")
    assert page.text([]) == "Let x be\nplain\nmo\nyes"
    cards = "<div class=related><article>card</article></div><div class=post><p>The text of the page is in no article</p></div>"
    assert html_paths.Page(cards).text([]) == "The text of the page is in no article"


def test_boosting_and_calibration():
    counts = [((k, a, 0, 0, 0, 0, c), n if c else 0, n) for k in range(4) for a in range(8) for c in range(2) for n in (40,)]
    m = pii_gbt.boost(counts)
    assert all((m.margin(x) > 0) == (p > 0) for x, p, _ in counts)
    pii_gbt.calibrate(m, counts)
    assert set(m.threshold) == set(range(6)) and m.threshold[4] == m.threshold[5] == math.log(0.95 / (1 - 0.95))
    assert all((m.margin(x) >= m.threshold[x[0]]) == (p > 0) for x, p, _ in counts)
    assert pii_gbt.boost([]).trees == []


def test_shingles_are_counted_in_shares_of_a_target():
    """A worker holds a share of a target's shingles at a time, and sums over a small piece of the texts."""
    from collections import Counter

    rng = np.random.default_rng(11)
    want, single, many = Counter(), [], []
    for k in range(40):
        x = np.unique(np.r_[rng.integers(0, 1 << 32, 3000, dtype=np.uint64), rng.integers(0, 512, 50, dtype=np.uint64) << np.uint64(23),
                            np.uint64(0), np.uint64((1 << 32) - 1)]).astype("<u4")
        if k % 4:
            single.append(x)
            want.update(x.tolist())
        else:
            c = rng.integers(2, 9, len(x)).astype("<u4")
            many.append(np.concatenate([x, c]).reshape(2, -1))
            want.update(dict(zip(x.tolist(), c.tolist())))
    shares = list(jaccard_join._shares(single, many))
    assert max(len(x) + len(y) for x, y, _ in shares) < 40 * 3050 // 8
    got = Counter()
    for x, y, c in shares:
        got.update(dict(zip(*(v.tolist() for v in jaccard_join.counts_of(x, y, c)))))
    assert got == Counter({x: n for x, n in want.items() if n >= jaccard_join.LEAST})
    none = np.empty(0, "<u4")
    assert [len(v) for v in jaccard_join.counts_of(none, none, none)] == [0, 0]
    sets = jaccard_join.TextSets()
    sets.of([f"some words of text {k}" * 40 for k in range(3000)])
    assert len(sets.power) <= 1 << 18
