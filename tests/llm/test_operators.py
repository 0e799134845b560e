"""Operators on awkward rows, and against brute force."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import decontamination, html_extraction, induced_sort, language, line_dedup, mixing, near_duplicates, nearest, pii, quality, substring_dedup
from tessella.llm.html_blocks import blocks
from tessella.session import Tables

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 911}x{i % 37}" for i in range(20_000))
BASE = " ".join(f"tok{i}" for i in range(300))
ROWS = [
    (1, BASE, "en", "a", 9),
    (2, BASE + " more", "en", "a", 9),
    (3, None, "en", None, None),
    (4, "", None, "a", 0),
    (5, LONG, "de", "b", 1),
    (5, LONG, "de", "b", 1),
    (None, BASE, "en", "a", 9),
    (7, "mail a.b@c.org or +1 (212) 555-0100, card 4111 1111 1111 1111, host 10.0.0.255", "en", None, 3),
    (8, BASE, "en", "c", 9),
    (9, "x", None, "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = "score double, n_words int, slot string, component_id string, lines_removed int, kept string"
    return spark.createDataFrame([(*r, 0.5, 1, "s", "c", 7, "k") for r in ROWS], f"{DOCS}, {extra}").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")


def test_near_duplicates_edges(docs, empty):
    got = {r.doc_id: r for r in near_duplicates.near_duplicate_groups(docs).collect()}
    assert (got[1].component_id, got[2].component_id, got[8].component_id) == (1, 1, 1)
    assert got[1].kept and not got[2].kept and not got[8].kept
    assert got[3].n_shingles == got[4].n_shingles == 0 and got[3].kept and got[9].n_shingles == 1
    assert got[None].component_id is None and got[None].kept
    assert near_duplicates.near_duplicate_groups(empty).count() == 0


def test_near_duplicates_brute_force(spark):
    rng = random.Random(3)
    base = [f"t{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(120):
        words = list(base) if i % 3 else [f"u{rng.randrange(5000)}" for _ in range(60)]
        for _ in range(rng.randrange(14)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[1000:]
    sig = near_duplicates.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 2000), 2, 200)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.12
    assert len(np.unique(near_duplicates.superminhash(pool[:3], np.zeros(3, int), 1, 80))) > 3


def test_pii(docs, empty):
    rows = pii.digest(pii.find_pii(docs)).collect()
    got = {r.doc_id: r for r in rows}
    r = got[7]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.spans.split(",")[0] == "email:5:14"
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert got[3].spans == "" and len(rows) == len(ROWS)
    assert pii.find_pii(empty).count() == 0


def test_pii_method_spans(spark):
    texts = ["IBAN GB82WEST12345698765432 ok", "iban GB82WEST12345698765433", 'token = "abcdefghij0123456789"', "ssn 123-45-6789", "no 123-45-6789 here", "9" * 20000]
    got = [r.spans for r in pii.digest(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()]
    assert got == ["iban:5:27", "", "secret:9:29", "ssn:4:15", "", ""]


def test_quality_edges(docs, empty, labels):
    rows = quality.digest(quality.classify(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.classify(empty, labels).count() == 0
    assert len(quality.classify(docs, labels.limit(0)).collect()) == len(ROWS)
    assert set(quality.keep_good(docs, labels).columns) == set(docs.columns)


def test_quality_learns(spark):
    rows = [(i, ("calm words in order %d " % i) * 6 if i % 2 else "BUY!! NOW!! %d " % i * 9, "en", "s", 1) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = quality.digest(quality.classify(spark.createDataFrame(rows, DOCS), labels)).where("held_out").collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) > 0.95 * len(got)


def test_line_dedup(spark, docs, empty):
    block = ["one two", "three four", "five six", "seven eight"]
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(1, "\n".join(["a"] + block + ["b"])), (2, "\n".join(["c"] + block[:2] + [""] + block[2:] + ["d"])), (3, "e\n" + long), (4, long + "\nf"), (5, "one two\nthree four"), (6, None), (7, "")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "c\nd" and got[2].lines_removed == 5
    assert got[3].text == rows[2][1] and got[4].text == "f" and got[5].text == rows[4][1]
    assert got[6].text is None and got[7].text == ""
    out = line_dedup.dedup_lines(docs)
    assert out.count() == len(ROWS) and line_dedup.dedup_lines(empty).count() == 0
    many = spark.createDataFrame([(1, "same line\n" * 200_000), (2, "\n".join(f"{i % 7} x {i // 70_000}" for i in range(200_000)))], "doc_id long, text string")
    start, got = time.time(), {r.doc_id: r for r in line_dedup.dedup_lines(many).select("doc_id", "lines_removed").collect()}
    assert got[1].lines_removed > 199_990 and got[2].lines_removed > 199_900 and time.time() - start < 30


def _direct(rows, large):
    """Lines left by a search of every window of lines that an earlier place has too."""
    seen, out = set(), {}
    for d, text in rows:
        at = [(i, tuple(x.lower().split())) for i, x in enumerate(text.split("\n")) if x.split()]
        gone = set()
        for p in range(len(at)):
            for q in range(p + 1, min(len(at), p + 8) + 1):
                run = tuple(x for _, x in at[p:q])
                if large(run):
                    if run in seen:
                        gone.update(range(p, q))
                    seen.add(run)
        lines = [i for p in gone for i in range(at[p][0], at[p + 1][0] if p + 1 in gone else at[p][0] + 1)]
        out[d] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in lines)
    return out


def test_line_dedup_finds_runs_by_context(spark):
    block = ["one two", "three four", "five six", "seven eight"]
    rows = [(i, f"{x}\nalone {i}") for i, x in enumerate(block)] + [(10, "\n".join(["a"] + block)), (11, "\n".join(block + ["b"]))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {11: "b"}
    rng = random.Random(8)
    pool = ["common line"] + [f"l{i} x" for i in range(5)] + [" ".join(f"v{i}_{j}" for j in range(55)) for i in range(2)]
    rows = [(d, "\n".join(rng.choice([*pool, "", f"u{rng.random()}"]) for _ in range(rng.randrange(1, 30)))) for d in range(80)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == _direct(rows, lambda run: len(run) >= line_dedup.LINES or sum(map(len, run)) >= line_dedup.WORDS)


def test_line_dedup_counts_words_of_a_run(spark):
    part = [" ".join(f"w{i}_{j}" for j in range(n)) for i, n in enumerate((20, 24, 6, 30))]
    rows = [(1, "\n".join(["a", *part[:3], "b"])), (2, "\n".join(["c", *part[:2], "", part[2], "d"])), (3, "\n".join(part[:2])), (4, part[3]), (5, "\n".join(["e", part[3], part[1]])), (6, "\n".join([part[3], part[1], "f"]))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {2: "c\nd", 6: "f"}
    rng = random.Random(9)
    pool = [" ".join(f"v{i}_{j}" for j in range(rng.randrange(1, 40))) for i in range(9)]
    rows = [(d, "\n".join(rng.choice([*pool, "", f"u{rng.random()}"]) for _ in range(rng.randrange(1, 30)))) for d in range(80)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == _direct(rows, lambda run: len(run) >= line_dedup.LINES or sum(map(len, run)) >= line_dedup.WORDS)


def test_decontamination_edges(spark, docs, empty):
    bench = spark.createDataFrame([(1, " ".join(f"tok{i}" for i in range(20, 40))), (2, "Card 4111"), (3, None), (None, "x"), (4, "..")], "item_id long, text string")
    rows = decontamination.digest(decontamination.decontaminate(docs, bench)).collect()
    got = {r.doc_id: r for r in rows}
    assert got[1].n_hit == 20 and got[1].n_items == 1 and got[7].contaminated and not got[9].contaminated and got[3].n_words == 0
    small = {r.doc_id: r for r in decontamination.digest(decontamination.decontaminate(docs, bench, shard_bytes=60)).collect()}
    assert {k: tuple(v) for k, v in small.items()} == {k: tuple(v) for k, v in got.items()}
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).where("size(hit_words) > 0").count() == 0
    kept = {r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()}
    assert kept == {3, 4, 5, 9}
    span = decontamination.decontaminate(docs, bench).where("doc_id = 7").first().spans[0]
    assert ROWS[7][1][span.start : span.end] == "card 4111"


def test_substring_dedup_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7)))
    common = " ".join(word() for _ in range(60))
    rows = []
    for d in range(70):
        t = " ".join(word() for _ in range(rng.randrange(1, 90)))
        if d % 3 == 0:
            a = rng.randrange(len(common) - 20)
            t = t[: len(t) // 2] + common[a:] + t[len(t) // 2 :]
        if d % 10 == 0:
            t += "ab" * 120
        rows.append((d, t))
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, "é" * 40)]
    rows += [(200 + i, word() * 3 + common[:160] + word() * 3) for i in range(30)]
    seen, want = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\x01" * 100
            seen.add(w)
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        want[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest())
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for many, shard, memory in ((50_000, 4_000_000, 2_000_000), (3, 2_000, 2_000_000), (50_000, 4_000_000, 500)):
        monkeypatch.setattr(substring_dedup, "MANY", many)
        monkeypatch.setattr(substring_dedup, "SHARD_BYTES", shard)
        monkeypatch.setattr(induced_sort, "MEMORY", memory)
        got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.digest(substring_dedup.dedup_substrings(frame)).collect()}
        assert got == want


def test_substring_dedup_edges(docs, empty):
    got = substring_dedup.dedup_substrings(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].n_removed == by[None].n_removed == by[5].n_removed == 0 and by[8].n_removed == by[8].n_bytes
    assert substring_dedup.dedup_substrings(empty).count() == 0
    two = docs.where("doc_id is not null").unionByName(docs.where("doc_id = 8").withColumn("text", F.lit("z" * 300)))
    got = substring_dedup.dedup_substrings(two).where("doc_id = 8").collect()
    assert sorted(r.n_bytes for r in got) == sorted([300, len(BASE)]) and len([r for r in got if r.n_removed]) == 1


def _check_order(t: bytes, **more):
    s, got = np.append(np.frombuffer(t, np.uint8), np.uint8(0)), []
    spilled = induced_sort.visit_suffixes(s, lambda p, v: got.append((p.copy(), v.copy())), **more)
    pos, lcp, b = *(np.concatenate(x).tolist() for x in zip(*got)), s.tobytes()
    assert sorted(pos) == list(range(len(s)))
    for i in range(1, len(pos)):
        x, y = b[pos[i - 1] : pos[i - 1] + 100], b[pos[i] : pos[i] + 100]
        assert x >= y
        assert min(lcp[i], 100) == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
    return spilled


@pytest.mark.parametrize(("base", "chunk", "memory"), [(4_000_000, 1 << 16, None), (3, 1 << 16, None), (4_000_000, 16, 64), (3, 16, 64)])
def test_induced_sort(tmp_path, monkeypatch, base, chunk, memory):
    """Against direct sorting; with recursion down to 3 ranks, and with so little memory that nearly all tuples pass through files."""
    monkeypatch.setattr(induced_sort, "BASE", base)
    monkeypatch.setattr(induced_sort, "CHUNK", chunk)
    rng, spilled = np.random.default_rng(2), 0
    for trial in range(60):
        t = (rng.integers(0, rng.integers(1, 5), rng.integers(1, 250)) + 97).astype(np.uint8)
        t = np.tile(t[:17], 14) if trial % 4 == 0 else t
        t = np.concatenate([t, np.full(150, 97, np.uint8), t]) if trial % 9 == 0 else t
        spilled += _check_order(t.tobytes(), folder=f"file://{tmp_path}/spill" if memory else None, memory=memory)
    assert (spilled > 0) == bool(memory) and not list(tmp_path.rglob("queue-*"))


def test_language(docs, empty, spark):
    rows = [(i, "der hund und die katze sind im haus " * 3 if i % 2 else "the dog and the cat are in the house " * 3, "de" if i % 2 else "en", "s", 1) for i in range(60)]
    train = spark.createDataFrame(rows, DOCS)
    profiles = language.learn_profiles(train)
    assert set(profiles) == {"de", "en"}
    got = {r.doc_id: r.lang_pred for r in language.identify(train, profiles).collect()}
    assert all(got[i] == ("de" if i % 2 else "en") for i in range(60))
    out = {r.doc_id: r for r in language.digest(language.identify(docs, profiles)).collect()}
    assert out[3].lang_pred == out[4].lang_pred == "und" and len(out) == 9
    assert language.learn_profiles(empty) == {} and language.identify(empty, {}).count() == 0
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}


def test_nearest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (None, [1.0]), (50, rows[50][1]), (2050, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("s")).withColumn("embedding", F.col("embedding").cast("array<float>"))
    vectors = nearest.integer_vectors(frame)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest.top_k(vectors, F.col("id") % 50 == 0, cell_rows=20).collect()}
    split = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest.top_k(vectors, F.col("id") % 50 == 0, cell_rows=20, cell_queries=3).collect()}
    assert split == got
    vs = {r.id: list(r.v) for r in vectors.collect()}
    want = {}
    for q in vs:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(vs[q], v)), i) for i, v in vs.items() if i != q)[:5]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert nearest.top_k(vectors.limit(0), F.col("id") % 50 == 0).count() == 0


def test_mixing(spark, docs, empty):
    rows = [(i, "t", "en", "abc"[min(2, i % 7 // 3)] if i % 11 else None, 1) for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS), weights={"a": 3.0, "b": 2.0, "c": 1.0, "": 0.001}, block_rows=4).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    blocks_ = Counter((r.slot, r.source) for r in out)
    assert len(blocks_) == len({s for s, _ in blocks_}) and max(blocks_.values()) <= 4
    assert mixing.mix(docs).count() == len(ROWS) and mixing.mix(empty).count() == 0
    assert mixing.mix(docs).columns[-2:] == ["slot", "slot_row"]


def _edf(weights, blocks):
    """The schedule in one pass over all slots."""
    total, out, t = sum(weights), {}, 0
    left = {g: [0, n] for g, n in enumerate(blocks)}
    while any(k < n for k, n in left.values()):
        due = [((k + 1) * total + weights[g] - 1) // weights[g] for g, (k, _) in left.items()]
        pick = min(((due[g], g) for g, (k, n) in left.items() if k < n and k * total // weights[g] <= t), default=None)
        if pick:
            assert t < pick[0]
            out[pick[1] + 1, left[pick[1]][0]] = t
            left[pick[1]][0] += 1
        t += 1
    return out


@pytest.mark.parametrize("m", [1, 2, 5, 40])
def test_schedule_is_pfair(spark, monkeypatch, m):
    """Stretches scheduled apart give the schedule of one pass; deviation counts against the true weights."""
    monkeypatch.setattr(mixing, "FAN", 4)
    rng = random.Random(m)
    weights = [int(10 ** rng.uniform(0, 5)) for _ in range(m)]
    longest = 900
    blocks_ = [max(1, longest * w // sum(weights)) for w in weights] if m > 1 else [300]
    b = spark.createDataFrame([(g + 1, k) for g, n in enumerate(blocks_) for k in range(n)], "g int, k long")
    w = spark.createDataFrame([(g + 1, a) for g, a in enumerate(weights)], "g int, a long")
    got = {(r.g, r.k): r.slot for r in mixing.schedule(b, w, Tables(spark)).collect()}
    assert got == _edf(weights, blocks_)
    seen = Counter()
    for t, g in enumerate(g for _, g in sorted((slot, g) for (g, _), slot in got.items() if slot < min(s for (h, k), s in got.items() if k == blocks_[h - 1] - 1))):
        seen[g] += 1
        assert all(abs(seen[x + 1] - (t + 1) * a / sum(weights)) < 1 for x, a in enumerate(weights))


def test_default_weights_are_square_roots(spark):
    n = {"a": 90_000, "b": 7_000, "c": 2_500, "d": 3}
    frame = spark.range(sum(n.values())).select(F.when(F.col("id") < 90_000, "a").when(F.col("id") < 97_000, "b").when(F.col("id") < 99_500, "c").otherwise("d").alias("source"))
    got = {r.grp: r.a for r in mixing.target_weights(frame).collect()}
    assert all(abs(got[s] / sum(got.values()) - n[s] ** 0.5 / sum(x**0.5 for x in n.values())) < 1e-8 for s in n)


CLASH = ("b", "grp", "before", "share", "total", "ks", "d", "t", "cuts", "gone", "r", "k", "g", "slot", "a", "z", "e", "f", "n", "id", "x", "lines_removed")


def test_stages_take_any_names(spark, docs, labels):
    """Columns named like those used inside, and one of a type that Spark does not hash."""
    import corpus_pipeline

    own = docs.select(*DOCS.replace(" long", "").replace(" string", "").split(", "))
    wide = own.select("*", *[F.lit(f"v-{c}").alias(c) for c in CLASH], F.create_map(F.lit("k"), F.col("doc_id")).alias("m"))
    mixed = mixing.mix(wide)
    assert mixed.count() == len(ROWS) and {r.total for r in mixed.collect()} == {"v-total"}
    assert {r.lines_before for r in line_dedup.dedup_lines(wide).collect()} == {0, 1}
    for stage in (corpus_pipeline.dedup_lines, corpus_pipeline.dedup_near):
        out = stage(spark, wide, "")
        assert out.columns == wide.columns and out.count() > 3 and {r.lines_removed for r in out.collect()} == {"v-lines_removed"}


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>x";</script></head><body>
<header>Site head</header><nav><ul><li>Home</li></ul></nav><div class="ad">Buy</div><div class="cookie-notice">We use</div>
<main><article><h1>Head&nbsp;line</h1><p>First <b>bold</b>\n text &lt;ok&gt;.<p>Second<br>line<aside>Side</aside><form><input>Mail</form>
<div class="comments"><article><p>Nice!</p></article></div></article></main><footer>&copy; me</footer></body></html>"""


def test_html_blocks():
    assert [t for z, t in blocks(PAGE) if z == 0] == ["Head line", "First bold text <ok>.", "Second line"]
    assert blocks(None) == blocks("") == [] and [t for _, t in blocks("a<b")] == ["a"]


LEAKS = {
    "<article><p>one <svg class='i'/> two</p><p>three <svg> four</p></article>": ["one two", "three four"],
    "<article>x is <math><mi>a</mi><mo>+</mo><mn>1</mn></math> ok</article>": ["x is a+1 ok"],
    "<aside><article>Related card</article></aside><main>Own</main>": ["Own"],
    "<div hidden><article>Hidden</article></div><div data-hidden='1'><article>Seen</article></div>": ["Seen"],
    "<article><p>a</p><div class='ad-slot'>Buy</div><div class='cookie notice'>We</div><div id='comments'><p>Nice</p></div><select><option>o</select><p>b</article>": ["a", "b"],
    "<form><main><p>inside a form<input></main></form>": ["inside a form"],
}


def test_html_leaks():
    for page, want in LEAKS.items():
        assert [t for z, t in blocks(page) if z == 0] == want, page
    assert blocks("<article><div class='related-work'>See X</div></article>") == [(3, "See X")]


def test_html_reading_is_linear():
    """A page of a megabyte of broken markup takes seconds, whichever way it is broken."""
    broken = ["<iframe>x" * 110_000, "<div>x" * 80_000 + "<b>y" * 100_000, "<div>x" * 80_000 + "</p>" * 130_000, "<a \"'" * 200_000, "<script " * 130_000, "<" * 1_000_000, "<a '\"<b" * 140_000 + ">"]
    for page in broken:
        start = time.perf_counter()
        blocks(page)
        assert time.perf_counter() - start < 20, page[:20]


def test_html_brute_force(spark):
    """Pages without an article, and articles with blocks in doubt, against a direct search of repeated runs of tokens."""
    rng, run = random.Random(6), html_extraction.RUN
    words = [f"w{i}" for i in range(40)]
    boiler = [" ".join(rng.choice(words) for _ in range(rng.randrange(6, 25))) for _ in range(5)]
    pages = []
    for i in range(60):
        parts = [rng.choice(boiler) if rng.random() < 0.5 else " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6))]
        parts = [f"{p} {rng.choice(boiler)}" if rng.random() < 0.3 else p for p in parts]
        body = "".join(f"<div>{p}</div>" for p in parts)
        pages.append((i, f"http://h{i % 3}.org/{i}", f"<article>{boiler[0]}<p class='related-work'>{parts[0]}</p></article><p>{parts[-1]}</p>" if i % 5 == 0 else body))
    pages.append((60, "http://h1.org/copy", pages[1][2]))
    streams: dict = {}
    for _, url, html in pages:
        streams.setdefault((url.split("/")[2], html), [w for z, t in blocks(html) if z != 0 for w in t.split(" ")])
    where: dict = {}
    for (host, html), s in streams.items():
        for j in range(len(s) - run + 1):
            where.setdefault((host, *s[j : j + run]), set()).add(html)
    want = {}
    for i, url, html in pages:
        s, out, at = streams[url.split("/")[2], html], [], 0
        cover = {j + x for j in range(len(s) - run + 1) if len(where[(url.split("/")[2], *s[j : j + run])]) > 1 for x in range(run)}
        own = any(z in (0, 3) for z, _ in blocks(html))
        for z, t in blocks(html):
            w = t.split(" ")
            if z == 0:
                out.append(t)
                continue
            hit, left, j = [at + x in cover for x in range(len(w))], [], 0
            at += len(w)
            while j < len(w):
                e = j
                while e < len(w) and hit[e] == hit[j]:
                    e += 1
                if not hit[j] or (e - j < run and e - j < len(w)):
                    left += w[j:e]
                j = e
            if left and (z == 3 or not own):
                out.append(" ".join(left))
        want[i] = "\n\n".join(out)
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html_extraction.extract_main_text(frame).collect()} == want


def test_html_extraction(spark):
    nav = "menu home about contact imprint terms privacy help login "
    loose = lambda i: f"<body><div>{nav}</div><p>only text number {i} stands {'here ' * (i % 3)}on page {i}.</p></body>"
    rows = [(1, "http://a.org/x", PAGE), (2, "http://a.org/y", None), (3, None, ""), (4, "http://a.org/z", PAGE), (4, "http://a.org/z", PAGE)]
    rows += [(10 + i, "http://b.org/%d" % i, loose(i)) for i in range(5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    for size in (1_000_000, 20):
        html_extraction.SHARD_TOKENS = size
        got = html_extraction.extract_main_text(frame).collect()
        by = {r.page_id: r for r in got}
        assert len(got) == len(rows) and by[1].text == "Head line\n\nFirst bold text <ok>.\n\nSecond line" and by[1].n_chars == len(by[1].text)
        assert by[2].text == "" and by[3].text == "" and by[3].n_chars == 0
        assert by[12].text == "only text number 2 stands here here on page 2."
    html_extraction.SHARD_TOKENS = 1_000_000
    assert html_extraction.extract_main_text(frame.limit(0)).count() == 0


def test_html_articles_pass_the_array(spark):
    """Every block is judged by the array, those of articles too; markup then puts back what stands in an article."""
    notice = "we use cookies to make this site work better for you"
    alone = "<article><p>own words of page %d</p></article><footer>printed in %d by nobody in particular for readers of site %d</footer>"
    rows = [(i, "http://a.org/%d" % i, f"<article><p>text {i}</p><p>{notice}</p></article>" if i < 2 else f"<div>{notice}</div><p>page {i}</p>") for i in range(4)]
    rows += [(4, "http://b.org/4", f"<article><p>{notice}</p></article>"), (5, "http://a.org/5", alone % (5, 5, 5)), (6, "http://a.org/5", alone % (5, 5, 5)), (7, None, None)]
    got = {r.page_id: r for r in html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r.text for i, r in got.items()} == {i: f"text {i}\n\n{notice}" for i in (0, 1)} | {2: "page 2", 3: "page 3", 4: notice, 5: "own words of page 5", 6: "own words of page 5", 7: ""}
    assert {i: (r.n_restored, r.n_struck) for i, r in got.items()} == {0: (11, 0), 1: (11, 0), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (0, 12), 6: (0, 12), 7: (0, 0)}


def test_html_shards_agree(spark):
    """A run goes from all pages of its host, however they are dealt to shards."""
    menu = [f"menu{i} home about contact imprint terms privacy help login end{i}" for i in range(12)]
    body = lambda i: f"<div>{menu[i % 12]}</div><p>only {i}</p>" if i % 4 else f"<article>{menu[i % 12]}</article><div>{menu[(i + 1) % 12]}</div>"
    frame = spark.createDataFrame([(i, "http://a.org/%d" % i, body(i)) for i in range(36)], "page_id long, url string, html string").repartition(4)
    seen, tokens = [], html_extraction.SHARD_TOKENS
    for size in (tokens, 120, 60, 20):
        html_extraction.SHARD_TOKENS = size
        seen.append({tuple(r) for r in html_extraction.extract_main_text(frame).collect()})
    html_extraction.SHARD_TOKENS = tokens
    assert all(s == seen[0] for s in seen) and {r[2] for r in seen[0]} == {f"only {i}" for i in range(36) if i % 4} | {menu[i] for i in (0, 4, 8)}


def test_pipeline_brute_force(spark, tmp_path):
    """All stages but the classifier against direct searches on what it keeps."""
    import corpus_pipeline

    rng = random.Random(12)
    line = lambda n=14: " ".join(f"q{rng.randrange(4000)}" for _ in range(n))
    shared, rows = [[line() for _ in range(5)] for _ in range(3)], []
    for i in range(90):
        lines = [line() for _ in range(6)]
        if i % 6 == 0:
            lines[2:2] = rng.choice(shared)
        if i % 9 == 4:
            lines = rows[-1][1].split("\n")
            lines = [" ".join(w if rng.random() > 0.01 else f"z{rng.random()}" for w in x.split()) for x in lines]
        if i % 13 == 5:
            lines[3] += " " + " ".join(f"b{j}" for j in range(12))
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}", 1))
    rows += [(200, "NO!! GO!! " * 30, "en", "s1", 0), (201, None, "en", None, None), (202, "", "en", "s1", 0), (3, rows[3][1], "en", "s0", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(200, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, " ".join(f"b{i}" for i in range(12)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = {r.doc_id for r in quality.classify(docs, labels).where("score >= 0.3").collect()}
    left = {r[0]: r[1] for r in rows if r[0] in good}
    direct = _direct(sorted((d, t or "") for d, t in left.items()), lambda run: len(run) >= line_dedup.LINES or sum(map(len, run)) >= line_dedup.WORDS)
    left = {d: None if t is None else direct[d] for d, t in left.items() if direct[d] == (t or "") or direct[d].strip()}
    sets = {d: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for d, t in left.items() for w in [(t or "").lower().split()] if w}
    near = {d: {d} for d in left}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                both = near[a] | near[b]
                for x in both:
                    near[x] = both
    window = " " + " ".join(f"b{j}" for j in range(10))
    want = {d: t for d, t in left.items() if d == min(near[d]) and not (t and (window in t or " ".join(f"b{j}" for j in range(2, 12)) in t))}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    assert len({(r.slot, r.slot_row) for r in got}) == len(got)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    text = lambda: "\n".join(" ".join(f"q{rng.randrange(4000)}" for _ in range(30)) for _ in range(4))
    rows = [(i, text(), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, rows[0][1] + " tail", "en", "s0", 1), (101, None, "en", None, None), (102, "", "en", "s1", 0), (103, "NO!! GO!! " * 30, "en", "s1", 0), (104, text() + " " + " ".join(f"b{i}" for i in range(12)), "en", "s0", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(103, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, " ".join(f"b{i}" for i in range(12)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert 104 not in ids and set(range(40)) <= ids and [n for n, _ in corpus_pipeline.STAGES][1] == "line_dedup"
    assert T.StructType.fromDDL(DOCS).names == [c for c in out[0].asDict() if c not in ("slot", "slot_row")]
