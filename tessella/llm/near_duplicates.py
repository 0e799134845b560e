"""Near-duplicate detection: SuperMinHash signatures, banding, verification on full sets, union by components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.words import MULT, chunks, mix, shingles, utf8
from tessella.operators.graph import connected_components
from tessella.session import Tables

#: 28 bands of 5: a pair at similarity 0.85 shares no band with probability 7e-8, at 0.8 with 2e-5.
BANDS, ROWS = 28, 5
#: Longs that hold one bit of each slot; standard deviations below its expected agreement at which a pair is passed over.
LONGS, SIGMAS = -(-BANDS * ROWS // 64), 5.0
_LEVEL = np.int64(48)


def superminhash(values: np.ndarray, owner: np.ndarray, n_sets: int, size: int = BANDS * ROWS) -> np.ndarray:
    """Signatures of ``n_sets`` sets; ``values`` are 64-bit element hashes, ``owner`` the set of each.

    Each element draws a random permutation of the slots step by step; in step j it offers j plus a random fraction to its
    j-th slot, and a slot keeps the least offer. The ranks of one element are correlated (each slot once), which lowers the
    variance of plain MinHash. A set is done as soon as all its slots hold offers of steps up to j: later ones are larger.
    """
    best = np.full(n_sets * size, np.iinfo(np.int64).max, np.int64)
    state, slots, own = values, None, owner.astype(np.int64)
    for j in range(size):
        if not len(state):
            break
        state = mix(state + MULT)
        pick = j + ((state & np.uint64(0xFFFF)) * np.uint64(size - j) >> np.uint64(16)).astype(np.int64)
        offer = (np.int64(j) << _LEVEL) | (state >> np.uint64(16)).astype(np.int64)
        if slots is None:
            slot = pick
        else:
            rows = np.arange(len(state))
            slot = slots[rows, pick].astype(np.int64)
            slots[rows, pick] = slots[:, j]
        np.minimum.at(best, own * size + slot, offer)
        open_ = (best.reshape(n_sets, size).max(axis=1) >= (np.int64(j + 1) << _LEVEL))[own]
        if slots is None and open_.any():
            slots = np.tile(np.arange(size, dtype=np.uint8), (int(open_.sum()), 1))
            kept = pick[open_]
            slots[np.arange(len(kept)), kept] = 0  # step 0 swapped slot 0 with the pick
        elif slots is not None:
            slots = slots[open_]
        state, own = state[open_], own[open_]
    return best.reshape(n_sets, size)


def _signed(texts_to_sets, k: int):
    def run(batches):
        for batch in batches:
            texts = utf8(batch.column("text"))
            n, lo, hi, bands = (np.zeros(len(texts), np.int64) for _ in range(4))
            bands, bits = np.zeros((len(texts), BANDS), np.uint64), np.zeros((len(texts), LONGS), np.int64)
            for a, b in chunks([len(t or b"") // 6 + 1 for t in texts], 100_000):
                sets = [texts_to_sets(t, k) for t in texts[a:b]]
                n[a:b] = [len(s) for s in sets]
                values, owner = np.concatenate(sets), np.repeat(np.arange(b - a), n[a:b])
                for out, salt in ((lo, 1), (hi, 2)):  # 128 bits name a set
                    total = np.zeros(b - a, np.uint64)
                    np.add.at(total, owner, mix(values ^ np.uint64(salt * 0x5851F42D4C957F2D)))
                    out[a:b] = total.view(np.int64)
                sig = superminhash(values, owner, b - a).view(np.uint64)
                odd = np.zeros((b - a, LONGS * 64), np.uint8)
                odd[:, : BANDS * ROWS] = mix(sig) & np.uint64(1)
                bits[a:b] = np.packbits(odd, axis=1).view(np.int64)
                sig = sig.reshape(b - a, BANDS, ROWS)
                h = np.full((b - a, BANDS), 0, np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for i in range(ROWS):
                    h = mix(h * MULT + sig[:, :, i])
                bands[a:b] = h
            lists = [r if m else [] for r, m in zip(bands.view(np.int64).tolist(), n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(lo), pa.array(hi), pa.array(lists, pa.list_(pa.int64())), pa.array(list(bits), pa.list_(pa.int64()))],
                ["doc_id", "n", "lo", "hi", "bands", "bits"],
            )

    return run


def _linked(k: int, percent: int):
    """Keeps the pairs whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches):
        sets: dict = {}

        def of(key, raw):
            if key not in sets:
                if len(sets) > 2000:
                    sets.clear()
                sets[key] = shingles(raw, k)
            return sets[key]

        for batch in batches:
            us, vs = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            tu, tv = utf8(batch.column("tu")), utf8(batch.column("tv"))
            keep = []
            for i in range(len(us)):
                a, b = of((us[i], hash(tu[i])), tu[i]), of((vs[i], hash(tv[i])), tv[i])
                both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    keep.append(i)
            part = batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))
            yield part

    return run


def _differences(k: int, percent: int):
    """Each class against the hub of its group: whether they are linked, and the shingles that only one of them has."""

    def run(batches):
        hubs: dict = {}
        for batch in batches:
            tu, tv, vs = utf8(batch.column("tu")), utf8(batch.column("tv")), batch.column("v").to_pylist()
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for a, b, v in zip(tu, tv, vs):
                if v not in hubs:
                    if len(hubs) > 500:
                        hubs.clear()
                    hubs[v] = shingles(b, k)
                x, y = shingles(a, k), hubs[v]
                delta = np.setxor1d(x, y, assume_unique=True)
                union = (len(x) + len(y) + len(delta)) // 2
                far = 2 * len(delta) > union
                rows[0].append(len(y))
                rows[1].append(100 * (union - len(delta)) >= percent * union)
                rows[2].append(far)
                rows[3].append([] if far else delta.view(np.int64))
            kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), *[pa.array(r, t) for r, t in zip(rows, kinds)]], ["rep", "hub", "hub_n", "linked", "far", "delta"])

    return run


def near_duplicate_groups(docs: DataFrame, k: int = 3, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of distinct k-word shingles (see
    ``words.shingles``); a component is what links reach, named by its smallest id. Documents of equal sets form a class
    that is compared once. Classes that share a band of their signatures are candidates, and every link is confirmed on the
    full sets. In each shared bucket all classes are first compared with the smallest id in it, then with the hub of their group;
    whatever is by then in one component needs no further look, and every pair of a bucket that is still in two is looked at
    too. In a dense group, classes are described by what sets them apart from one hub, and only those that share a shingle in
    a rare-first prefix of it are compared; that is exact, so large groups cost a few comparisons a document. Before texts are fetched, a pair is passed over if its sizes rule
    a link out, or if one bit of each signature slot agrees SIGMAS standard deviations less than at the threshold: with
    probability below 1e-6 for a pair that is a link, and none at all for most pairs that only share a passage.

    Empty and null texts, and rows of null ids, are linked with nothing; a null id has no component and is kept. Rows that
    repeat an id are one document. Ids are integers. Other columns are not read.
    """
    tables = Tables(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sig = tables.keep(docs.mapInArrow(_signed(shingles, k), "doc_id long, n long, lo long, hi long, bands array<long>, bits array<long>"))
    some = sig.where("n > 0 and doc_id is not null")
    classes = tables.keep(some.groupBy("lo", "hi", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits")))
    words = [f"x{i}" for i in range(LONGS)]
    of = F.struct("rep", "n", *words)
    banded = classes.select("rep", "n", *[F.col("bits")[i].alias(w) for i, w in enumerate(words)], F.explode("bands").alias("band"))
    hub = banded.groupBy("band").agg(F.min(of).alias("a"), F.max("rep").alias("z")).where("a.rep < z")
    shared = tables.keep(banded.join(hub.hint("merge"), "band").select("band", "rep", "n", *words, "a"))
    wanted = shared.select(F.col("rep").alias("doc_id")).distinct()
    texts = tables.keep(docs.where("doc_id is not null").join(wanted.hint("merge"), "doc_id"))

    size = BANDS * ROWS
    agree = (1 + percent / 100) / 2
    differ = int(size * (1 - agree) + SIGMAS * (size * agree * (1 - agree)) ** 0.5) + 1

    def near(x: str, y: str) -> str:
        """By size and by signature bits, two classes may be similar enough."""
        bits = " + ".join(f"bit_count({x.format(w)} ^ {y.format(w)})" for w in words)
        return f"100 * least({x.format('n')}, {y.format('n')}) >= {percent} * greatest({x.format('n')}, {y.format('n')}) and {bits} <= {differ}"

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct()
        left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu"))
        right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv"))
        both = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").select("u", "v", "tu", "tv")
        return tables.keep(both.mapInArrow(_linked(k, percent), "u long, v long"))

    def still_apart(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of buckets whose classes are in several components, and the components."""
        comp = connected_components(links, tables=tables)
        own = rows.drop("comp").join(comp.select(F.col("node").alias("rep"), F.col("component").alias("c")).hint("merge"), "rep", "left")
        own = own.withColumn("comp", F.coalesce("c", "rep")).drop("c")
        split = own.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("band")
        return tables.keep(own.join(split.hint("merge"), "band")), comp

    links = confirm(shared.where("rep <> a.rep and " + near("{}", "a.{}")).select(F.col("rep").alias("u"), F.col("a.rep").alias("v")))
    apart, _ = still_apart(shared.drop("a"), links)
    # Dense groups: a class and the hub of its group differ in few shingles, D. For a link, two classes of one hub must
    # share so much of their D that a rare-first prefix of each D holds a common shingle; most edits are unique.
    crowd = apart.groupBy("band").agg(F.count("*").alias("c"))
    weight = apart.join(crowd.hint("merge"), "band").groupBy("rep").agg(F.sum("c").alias("weight"))
    heavy = apart.join(weight.hint("merge"), "rep")
    ends = heavy.groupBy("band").agg(F.max(F.struct("weight", "rep")).alias("z"))
    hubs = apart.join(ends.hint("merge"), "band").groupBy("rep").agg(F.max("z").alias("z")).select(F.col("rep").alias("u"), F.col("z.rep").alias("v")).where("u <> v")
    left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv"))
    both = hubs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").select("u", "v", "tu", "tv")
    diffs = tables.keep(both.mapInArrow(_differences(k, percent), "rep long, hub long, hub_n long, linked boolean, far boolean, delta array<long>").dropDuplicates(["rep"]))
    links = tables.keep(links.unionByName(diffs.where("linked").select(F.col("rep").alias("u"), F.col("hub").alias("v"))))
    apart, comp = still_apart(apart, links)
    own = apart.groupBy("rep").agg(F.first("n").alias("n"), F.first("comp").alias("comp"))
    comp = comp.select(F.col("node").alias("hub"), F.col("component").alias("hub_comp"))
    d = diffs.where("not far").join(own.hint("merge"), "rep").join(comp.hint("merge"), "hub", "left")
    share = (100 - percent) / (100 + percent)  # a link means: at most this share of both sizes together in one set only
    inside = F.col("comp") == F.coalesce("hub_comp", "hub")
    # a partner outside the hub's component differs from the hub in more than share * sizes; any partner in one shingle at least
    overlap = F.when(inside, F.floor((F.size("delta") + share * (F.col("hub_n") - F.col("n"))) / 2 - 1e-9) + 1).otherwise(
        F.ceil((F.size("delta") + 1 - share * F.col("n") * (1 + 100 / percent)) / 2 - 1e-9)
    )
    e = tables.keep(d.select("rep", "hub", "n", "comp", F.size("delta").alias("m"), (F.size("delta") - F.greatest(overlap, F.lit(1)) + 1).alias("prefix"), F.explode("delta").alias("x")))
    often = e.groupBy("hub", "x").agg(F.count("*").alias("f"))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("f", "x"))
    pre = e.join(often.hint("merge"), ["hub", "x"]).withColumn("r", rank).where("r <= prefix and f > 1").select("rep", "hub", "n", "comp", "m", "r", "x")
    pre = tables.keep(pre)
    other = pre.select("hub", "x", *[F.col(c).alias(f"{c}_2") for c in ("rep", "n", "comp", "m", "r")])
    # what comes after the first common shingle in both must suffice for the overlap that a link needs
    enough = f"1 + least(m - r, m_2 - r_2) >= (m + m_2 - {share!r} * (n + n_2)) / 2 - 1e-9"
    sized = f"100 * least(n, n_2) >= {percent} * greatest(n, n_2)"
    dense = pre.hint("merge").join(other, ["hub", "x"]).where("rep > rep_2 and comp <> comp_2 and " + sized + " and " + enough).select("rep", "rep_2")
    # all other pairs of a bucket, each in the first bucket that both have
    mine = apart.join(diffs.where("not far").select("rep", "hub").hint("merge"), "rep", "left").withColumn("hub", F.coalesce("hub", -F.col("rep") - 1))
    mine = mine.join(classes.select("rep", "bands").hint("merge"), "rep")
    other = mine.select("band", *[F.col(c).alias(f"{c}_2") for c in ("rep", "n", "comp", "hub", "bands", *words)])
    once = "case when " + near("{}", "{}_2") + " then band = array_min(array_intersect(bands, bands_2)) else false end"
    rest = mine.hint("merge").join(other, "band").where("rep > rep_2 and comp <> comp_2 and hub <> hub_2 and " + once)
    last = rest.select("rep", "rep_2").unionByName(dense)
    links = links.unionByName(confirm(last.select(F.col("rep").alias("u"), F.col("rep_2").alias("v"))))
    # copies of a class hang on its representative
    copies = some.join(classes.select("lo", "hi", "n", "rep").hint("merge"), ["lo", "hi", "n"]).where("doc_id <> rep")
    comp = connected_components(links.unionByName(copies.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))), tables=tables)
    found = sig.select("doc_id", "n").join(comp.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left")
    name = F.coalesce("component", "doc_id")
    return tables.done(found.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"), F.coalesce(F.col("doc_id") == name, F.lit(True)).alias("kept")))
