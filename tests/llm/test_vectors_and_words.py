"""Spelling variants, near embeddings and hard negatives against brute force on small tables with odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import embedding_dedup, hard_negatives, spelling

VECTORS = "vec_id long, embedding array<double>, label int, node long, w string"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    count = Counter()
    for doc_id, text in rows:
        word = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                word += c.lower() if c.isascii() else c
            elif word:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
                if h % 97 == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
                count[word] += 1
                word = ""
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    form, near = {}, {}
    for w, n in words.items():
        close = sorted((x for x in words if one_edit(w, x)), key=lambda x: (-words[x], x))
        near[w] = len(close)
        form[w] = close[0] if close and words[close[0]] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, near[w], words.get(form[w])))
    return out


def test_spelling_variants(spark):
    rnd = np.random.default_rng(3)
    base = ["".join(rnd.choice(list("abcé×"), rnd.integers(4, 9))) for _ in range(60)]
    rows = [(None, "Gardén gardén, GARDÉN"), (1, None), (2, ""), (3, "ab 12 !?"), (4, "x" * 3000 + " " + "x" * 3001), (4, "x" * 3000 + " " + "x" * 3001), (5, "x" * 3000 + " " + "x" * 3001)]
    for i in range(6, 60):
        words = [str(rnd.choice(base)) for _ in range(80)]
        words = [w[: (j := rnd.integers(len(w)))] + w[j + rnd.integers(2) :] for w in words]
        rows.append((i, " ".join(w.upper() if rnd.random() < 0.2 else w for w in words)))
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, n int, word string")
    got = {tuple(r) for r in spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = brute_variants(rows)
    assert got == want and len([w for w in want if w[1]]) > 20 and any(w[1] != w[2] and w[1] for w in want)
    assert spelling.spelling_variants(df.where("doc_id > 1000")).count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_blocks_of_hot_ranges(spark, block):
    rnd = np.random.default_rng(5)
    words = {"".join(rnd.choice(list("abÿ"), rnd.integers(5, 8))) for _ in range(500)}
    words = {w: int(rnd.integers(3, 9)) for w in sorted(words)}
    got = {r.word: (r.n_near, r.top_n, r.top) for r in spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), block).collect()}
    want = {}
    for w in words:
        close = sorted((x for x in words if one_edit(w, x)), key=lambda x: (-words[x], x))
        if close:
            want[w] = (len(close), words[close[0]], close[0])
    assert got == want


def brute_links(rows, threshold=0.93):
    fine = {r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])}
    fine, width = sorted(fine), max(len(r[1]) for r in fine)
    x = np.array([list(r[1]) + [0.0] * (width - len(r[1])) for r in fine])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    label = np.array([r[2] for r in fine])
    linked = (x @ x.T >= threshold) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    least = np.array([r[0] for r in fine])
    while (nxt := np.minimum(least, np.where(linked, least[None, :], 1 << 60).min(axis=1))).tolist() != least.tolist():
        least = nxt
    out = {(r[0], int(n), int(c), r[0] == c) for r, n, c in zip(fine, linked.sum(axis=1), least, strict=True)}
    return out | {(r[0], 0, r[0], None if r[0] is None else True) for r in rows if r[0] not in {f[0] for f in fine}}


def vectors(rnd, n):
    """A third of all rows is one group of near copies, another group is loose, and there are equal vectors and odd rows."""
    hub, loose = rnd.standard_normal(12), rnd.standard_normal(12)
    rows = []
    for i in range(n):
        kind = i % 6
        v = hub + 0.1 * rnd.standard_normal(12) if kind < 2 else loose + 0.34 * rnd.standard_normal(12) if kind == 2 else rnd.standard_normal(12)
        rows.append((i, tuple(np.round(v, 6).tolist()), int(kind < 3 or i % 4)))
    rows += [(n + i, rows[5][1], rows[5][2]) for i in range(4)] + [rows[7], rows[7]]
    odd = [(n + 10, None, 1), (n + 11, (1.0, None), 1), (n + 12, (0.0,) * 12, 1), (n + 13, (float("nan"),) * 12, 1), (n + 14, rows[0][1], None), (None, rows[0][1], 1), (n + 15, (), 1)]
    return rows + odd + [(n + 16, (1e300, 2e300), 1), (n + 17, (1e-200, 2e-200), 1), (n + 18, (5.0, 5.0), 0)]


def test_near_embeddings(spark):
    rows = vectors(np.random.default_rng(2), 420)
    df = spark.createDataFrame([(*r[:1], None if r[1] is None else list(r[1]), r[2], 1, "x") for r in rows], VECTORS)
    got = [tuple(r) for r in embedding_dedup.near_embeddings(df).select("vec_id", "n_links", "component_id", "kept").collect()]
    want = brute_links(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(w[1] for w in want) > 130  # the group of near copies was counted, not listed
    assert embedding_dedup.near_embeddings(df.where("vec_id < 0")).count() == 0


def test_groups_with_many_outer_members(spark):
    """Components too loose for their mean are compared in blocks, over several cells."""
    rnd = np.random.default_rng(4)
    angle = np.sort(rnd.uniform(0, 3, 300))
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    df = spark.createDataFrame([(7, i, i % 3 + 1, v.tolist()) for i, v in enumerate(x)], "component long, node long, w long, v array<double>")
    got = {r.node: r.n_links for r in embedding_dedup._dense_counts(df, 2, 0.93, embedding_dedup.Tables(spark), block=64).collect()}
    linked, w = x @ x.T >= 0.93, np.arange(300) % 3 + 1
    assert got == {i: int((linked[i] * w).sum() - 1) for i in range(300)}


def brute_negatives(rows, anchors, k=5):
    rows = sorted({(i, tuple(int(np.floor(256 * c)) for c in v), (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(c is not None and np.isfinite(c) for c in v)})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, v, lab in rows:
        if i % anchors:
            continue
        same = sorted((-dot(v, b), j) for j, b, other in rows if other == lab and j != i)[:k]
        for p, j in same:
            hard = sorted((-dot(v, b), m) for m, b, other in rows if other != lab and 80 * -p <= 100 * dot(v, b) <= 100 * -p)[:k]
            out += [(i, j, r + 1, m, -p, -s) for r, (s, m) in enumerate(hard)]
    return sorted(out)


def test_hard_negatives(spark):
    rnd = np.random.default_rng(6)
    rows = []
    for i in range(400):
        v = rnd.standard_normal(70) if i % 3 else np.ones(70) + 0.5 * rnd.standard_normal(70)
        rows.append((i, v.tolist(), i % 3 if i % 5 else 1))
    rows += [(400 + i, rows[3][1], i % 3) for i in range(8)] + [rows[9], rows[9], (500, [2.0, 3.0], 1), (501, None, 1), (502, [1.0, None], 1), (503, rows[3][1], None), (None, rows[3][1], 1), (504, [float("inf")] * 70, 2), (505, [0.0] * 70, 8), (510, [], 0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    vecs = hard_negatives.labelled_vectors(df)
    mined = hard_negatives.mine(vecs, F.col("id") % 10 == 0, cell_rows=100, cell_anchors=20)
    got = sorted(tuple(r) for r in mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    want = brute_negatives(rows, 10)
    assert got == want and len(want) > 300
    assert hard_negatives.mine(vecs.where("id < 0"), F.col("id") % 10 == 0).count() == 0


def test_bounds_hold_and_pass_most_rows_over():
    rnd = np.random.default_rng(8)
    x, q = rnd.integers(-300, 300, (2000, 64)), rnd.integers(-300, 300, (5, 64))
    codes, align, rest = hard_negatives.encode(x, 4)
    anchors, true = hard_negatives.Anchors(q, 4), q @ x.T
    for i in range(5):
        seen = []

        def keep(least, most, seen=seen):
            seen.append((least, most))
            return np.ones(len(least), bool)

        anchors.survivors(i, np.arange(2000), codes, align, rest, keep)
        for least, most in seen:
            assert (least <= true[i]).all() and (true[i] <= most).all()
        floor = np.sort(true[i])[-5]
        assert len(anchors.survivors(i, np.arange(2000), codes, align, rest, lambda least, most: most >= floor)) < 400  # noqa: B023
