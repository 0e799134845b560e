"""Spelling variants: words one edit apart, by dynamic programming over sorted vocabulary lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import chunks
from tessella.session import Tables, materialize

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def noisy_words(docs: DataFrame, every: int = 97) -> DataFrame:
    """``(word, n)``: every maximal run of letters of whole texts, A-Z lower-cased, with its number of occurrences.

    h is the crc32 of ``<doc_id>:<run>``; where ``every`` divides it, the run loses its code point h % length. A null text has
    no runs; a null id counts as the empty string; repeated rows count as often as they are there. A run of one code point that
    loses it is the empty word.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    plain = F.octet_length("run") == F.char_length("run")
    runs = runs.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return runs.groupBy(word.alias("word")).agg(F.count("*").alias("n"))


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of code points up to U+00FF as rows of bytes, zeros behind; and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.array(words, dtype=f"S{max(1, int(sizes.max(initial=1)))}").view(np.uint8).reshape(len(words), -1), sizes


def scan(listed: list[bytes], cell: np.ndarray, asked: list[bytes], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asked, listed) exactly one edit apart, of lists sorted inside cells of words whose lengths differ by one at most.

    Every asked word walks its cell's list from ``start`` to ``end``, all of them in step. Row d of the edit matrix against the listed
    word's first d letters is kept in a band of three: columns d - 1, d and d + 1. The next listed word reuses the rows of the
    prefix that it shares with the last; a row without a value of 0 or 1 skips all words that share that prefix.
    """
    if not listed or not asked:
        return start[:0], start[:0]
    w, size = _matrix(listed)
    q, length = _matrix(asked)
    g, width = w.shape
    q = np.pad(q, ((0, 0), (2, max(2, width - q.shape[1] + 2))))  # column j of a word is at j + 1
    same = (w[1:] == w[:-1]) & (np.arange(width)[None, :] < np.minimum(size[1:], size[:-1])[:, None])
    shared = np.zeros(g + 1, np.int64)
    shared[1:g] = np.where(cell[1:] == cell[:-1], np.cumprod(same, axis=1).sum(axis=1), 0)
    after = np.empty((width + 1, g), np.int32)  # the next place that doesn't share the first d letters
    for d in range(width + 1):
        stops = np.append(np.flatnonzero(shared[:g] < d), g)
        after[d] = stops[np.searchsorted(stops, np.arange(g), side="right")]
    band = np.full((3, len(asked), width + 1), 2, np.uint8)
    band[1, :, 0], band[2, :, 0] = 0, 1
    place, known = start.copy(), np.zeros(len(asked), np.int64)
    lanes = np.flatnonzero(place < end)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(lanes):
        at, depth = place[lanes], known[lanes]
        alive, last = np.ones(len(lanes), bool), size[at]
        going = np.flatnonzero(depth < last)
        while len(going):
            lane, d = lanes[going], depth[going] + 1
            letter, (a, b, c) = w[at[going], d - 1], band[:, lane, d - 1]
            here = b + (q[lane, d + 1] != letter)
            a = np.minimum(a + (q[lane, d] != letter), b + 1)
            b = np.minimum(np.minimum(here, c + 1), a + 1)
            c = np.minimum(c + (q[lane, d + 2] != letter), b + 1)
            band[0, lane, d], band[1, lane, d], band[2, lane, d] = a, b, c
            depth[going] = d
            ok = np.minimum(np.minimum(a, b), c) <= 1
            alive[going[~ok]] = False
            going = going[ok & (d < last[going])]
        full = np.flatnonzero(alive)
        lane, n = lanes[full], last[full]
        edits = band[1 + length[lane] - n, lane, n]
        near = edits == 1
        found.append((lane[near], at[full][near]))
        nxt = after[depth, at]
        nxt[full] = at[full] + 1
        place[lanes], known[lanes] = nxt, np.minimum(depth, shared[nxt])
        lanes = lanes[nxt < end[lanes]]
    return np.concatenate([f[0] for f in found] or [start[:0]]), np.concatenate([f[1] for f in found] or [start[:0]])


def _neighbours(keys: list[str], rows: int, cells: int):
    """Sorted cells -> per asked word the number of near words of that cell and the best of them."""

    def settle(t: pa.Table) -> pa.Table:
        word = [x.decode("utf8") for x in t["side"].cast(pa.binary()).to_pylist()]
        short, back, n = t["m"].to_numpy(), t["back"].to_numpy(), t["n"].to_numpy()
        asks, lists, cell = t["asks"].to_numpy(), t["lists"].to_numpy(), t["cell"].to_numpy()
        latin = [x.encode("latin-1") for x in word]
        li, qi = np.flatnonzero(lists), np.flatnonzero(asks)
        cells_of = cell[li]
        start, end = np.searchsorted(cells_of, cell[qi]), np.searchsorted(cells_of, cell[qi], side="right")
        a, b = scan([latin[i] for i in li], cells_of, [latin[i] for i in qi], start, end)
        a, b = qi[a], li[b]
        size = np.fromiter(map(len, latin), np.int64, len(latin))
        keep = (size[a] == short[a]) | (size[b] == short[b])  # two longer words meet in their own cell
        a, b = a[keep], b[keep]
        front = np.zeros(len(a), bool)  # pairs with equal fronts are found there
        x, _ = _matrix(latin)
        rev = np.flatnonzero(back[a])
        if len(rev):
            equal, half = np.ones(len(rev), bool), short[a[rev]] // 2
            for i in range(int(half.max())):
                more = i < half
                equal &= ~more | (x[a[rev], np.maximum(size[a[rev]] - 1 - i, 0)] == x[b[rev], np.maximum(size[b[rev]] - 1 - i, 0)])
            front[rev] = equal
        a, b = a[~front], b[~front]
        plain = np.array([w[::-1] if r else w for w, r in zip(word, back, strict=True)], object)
        order = np.lexsort((np.argsort(np.argsort(plain[b])) if len(b) else b, -n[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else a
        return pa.table({"word": pa.array(plain[a[first]], pa.string()), "near": np.diff(np.r_[first, len(a)]), "top_n": n[b[first]], "top": pa.array(plain[b[first]], pa.string())})

    def run(batches):
        held, held_rows = [], 0

        def flush(t: pa.Table):
            ids = np.zeros(t.num_rows, np.int64)
            for k in keys:
                v = t[k].combine_chunks()
                ids[1:] += np.asarray(pa.compute.not_equal(v[1:], v[:-1])).astype(np.int64)
            t = t.append_column("cell", pa.array(np.cumsum(ids > 0)))
            ends = np.append(np.flatnonzero(np.diff(t["cell"].to_numpy())) + 1, t.num_rows)
            starts = np.append(0, ends[:-1])
            longest = np.maximum.reduceat(t["m"].to_numpy(), starts) + 2 if t.num_rows else starts
            for i, j in chunks(((ends - starts) * longest).tolist(), cells):
                yield from settle(t.slice(starts[i], ends[j - 1] - starts[i])).to_batches()

        for batch in batches:
            held.append(batch)
            held_rows += batch.num_rows
            if held_rows < rows:
                continue
            t = pa.Table.from_batches(held)
            last = {k: t[k][-1].as_py() for k in keys}
            own = np.ones(t.num_rows, bool)
            for k in keys:
                own &= np.asarray(pa.compute.equal(t[k].combine_chunks(), last[k]))
            whole = t.num_rows - int(own.sum())  # the last cell may go on
            if whole:
                yield from flush(t.slice(0, whole))
            held, held_rows = t.slice(whole).to_batches(), t.num_rows - whole
        if held_rows:
            yield from flush(pa.Table.from_batches(held))

    return run


def near_words(words: DataFrame, block: int = 4096, tables: Tables | None = None) -> DataFrame:
    """``words(word, n)``, distinct -> ``(word, n_near, top_n, top)`` of words with near words: how many are one edit away, the
    largest n of them and the smallest such word.

    Two words one edit apart, the shorter of m code points, have equal first or equal last m // 2 code points. So each word is
    listed under its front and its back, as the shorter and as the longer of a pair; each such range of the sorted (or of the
    backwards sorted) vocabulary is a cell. Ranges of over ``block`` words are cut into blocks of asked and of listed words.
    The list of such ranges is one of ``tables``, if given.
    """
    size = F.char_length("word")
    side = F.explode(F.array(*[F.struct((size - i).alias("m"), F.lit(r).alias("back")) for i in (0, 1) for r in (False, True)]))
    keyed = words.select("word", "n", side.alias("k")).select("n", "k.*", F.when(F.col("k.back"), F.reverse("word")).otherwise(F.col("word")).alias("side"))
    keyed = keyed.withColumn("part", F.substring("side", F.lit(1), F.floor(F.col("m") / 2).cast("int")))
    range_of = ["m", "back", "part"]
    large = (tables.keep if tables else materialize)(keyed.groupBy(*range_of).agg(F.count("*").alias("rows")).where(F.col("rows") > block))
    keyed = keyed.join(large.hint("merge"), range_of, "left")
    blocks = F.ceil(F.coalesce("rows", F.lit(1)) / block).cast("int")
    own = F.pmod(F.hash("side"), blocks)
    every = F.sequence(F.lit(0), blocks - 1)
    pair = lambda a, b: F.struct(a.alias("ask"), b.alias("list"), (a == own).alias("asks"), (b == own).alias("lists"))
    spread = F.when(blocks == 1, F.array(pair(F.lit(0), F.lit(0)))).otherwise(F.concat(F.transform(every, lambda i: pair(own, i)), F.filter(F.transform(every, lambda i: pair(i, own)), lambda p: p["ask"] != own)))
    cells = keyed.select(*range_of, "side", "n", F.explode(spread).alias("c")).select(*range_of, F.col("c.ask"), F.col("c.list"), F.col("c.asks"), F.col("c.lists"), "side", "n")
    keys = [*range_of, "ask", "list"]
    cells = cells.repartition(*keys).sortWithinPartitions(*keys, "side")
    found = cells.mapInArrow(_neighbours(keys, 50_000, 4_000_000), "word string, near long, top_n long, top string")
    best = F.min(F.struct((-F.col("top_n")).alias("top_n"), "top"))
    out = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    return out.select("word", "n_near", (-F.col("best.top_n")).alias("top_n"), F.col("best.top").alias("top"))


def spelling_variants(docs: DataFrame, every: int = 97, length: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of the words of :func:`noisy_words` with ``length`` code points or more that occur
    ``least`` times or more.

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that n is ``times`` its own or more;
    root is where forms end, the word itself without a form. Forms grow in n, so they have no cycles; chains are followed by
    doubling. An empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession)
    words = tables.keep(noisy_words(docs, every).where((F.char_length("word") >= length) & (F.col("n") >= least)))
    near = near_words(words, tables=tables)
    ok = F.col("top_n") >= times * F.col("n")
    formed = words.join(near.hint("merge"), "word", "left").select(
        "word", F.when(ok, F.col("top")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(ok, F.col("top_n")).alias("form_n")
    )
    formed = tables.keep(formed)
    roots = tables.keep(formed.where("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(64):  # n at least doubles along a chain, and the steps double
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = tables.keep(roots.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            break
    out = formed.join(roots.hint("merge"), "word", "left")
    return tables.done(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
