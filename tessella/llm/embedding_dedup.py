"""Near-duplicate embeddings: NN-descent inside labels, exact counts in dense groups, and an audit by brute force."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.nearest import _matrix
from tessella.operators.graph import connected_components
from tessella.session import Tables

#: What a product of single-precision unit vectors may be off; what lies so near the threshold is decided in double precision.
SLACK = 1e-5


def _doubles(rows, width: int) -> np.ndarray:
    """Rows padded with zeros and divided by a power of two, so that squares neither overflow nor vanish."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    top = np.abs(out).max(axis=1, initial=0)
    return np.ldexp(out, -np.frexp(np.where(top > 0, top, 1.0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _stack(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if isinstance(column, pa.ChunkedArray | pa.Array) else column), np.float32).reshape(-1, width)


def _classes(df: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors ``(id, label, v)`` that can link, and their classes of equal label and vector ``(node, label, v, cls, w)``."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    rows = tables.keep(rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), x.alias("v")).distinct())
    classes = rows.groupBy("label", "v").agg(F.min("id").alias("cls"), F.count("*").alias("w"))
    return rows, tables.keep(classes.withColumn("node", F.monotonically_increasing_id()))


def _seeds(units: DataFrame, n: int, width: int, first: int, turns: int, reach: int = 4, take: int = 3) -> DataFrame:
    """First neighbours: sorted by signs of random projections inside labels, ``turns`` times, a row meets those next to it."""
    bits = max(1, min(20, int(math.log2(max(2, n / 64)))))

    def keyed(batches):
        for t in batches:
            x = _stack(t["u"], width)
            for k in range(first, first + turns):
                y = x @ np.random.default_rng(7000 + k).standard_normal((width, bits + 1)).astype(np.float32)
                code = ((y[:, :bits] > 0) << np.arange(bits)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), t["label"], pa.array(code), pa.array(y[:, bits].astype(np.float64)), t["node"], t["u"]], ["turn", "label", "code", "at", "node", "u"])

    def beside(batches):
        for t in batches:
            x, node = _stack(t["u"], width), t["node"].to_numpy()
            place = pd.factorize(pd.MultiIndex.from_arrays([t["turn"].to_numpy(), t["label"].to_pylist()]))[0] if len(x) else np.zeros(0, int)
            best = np.full((len(x), 2 * reach), -2.0, np.float32)
            with_whom = np.full((len(x), 2 * reach), -1, np.int64)
            for j in range(1, min(reach, len(x) - 1) + 1):
                s = np.where(place[j:] == place[:-j], np.einsum("ij,ij->i", x[j:], x[:-j]), -2.0)
                best[j:, 2 * j - 2], with_whom[j:, 2 * j - 2] = s, node[:-j]
                best[:-j, 2 * j - 1], with_whom[:-j, 2 * j - 1] = s, node[j:]
            order = np.argsort(-best, axis=1)[:, :take]
            s, to = np.take_along_axis(best, order, 1), np.take_along_axis(with_whom, order, 1)
            i, c = np.nonzero(s > -2)
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(to[i, c]), pa.array(s[i, c].astype(np.float64))], ["node", "nbr", "sim"])

    parts = max(8, n * turns // 20_000)
    sort = ["turn", "label", "code", "at", "node"]
    spread = units.select("node", "label", "u").mapInArrow(keyed, "turn int, label string, code long, at double, node long, u binary")
    return spread.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).mapInArrow(beside, "node long, nbr long, sim double")


def _trim(edges: DataFrame, k: int, most: int, threshold: float) -> DataFrame:
    """The lists: the ``k`` nearest of a node; a list full of links grows to ``most``."""
    once = edges.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr"))).where(F.col("r") <= most)
    return ranked.where((F.col("r") <= k) | (F.col("sim") >= threshold - SLACK)).select("node", "nbr", "sim", "fresh")


def _round(lists: DataFrame, units: DataFrame, k: int, most: int, width: int, take: int = 3) -> DataFrame:
    """Neighbours of neighbours: the members of a node's list and some of those that list it meet each other, if one is fresh.
    Candidates ``(node, nbr, sim)`` better than the worst of a node's full list."""
    both = lists.select(F.col("node").alias("w"), F.col("nbr").alias("m"), "fresh").unionByName(lists.select(F.col("nbr").alias("w"), F.col("node").alias("m"), "fresh"))
    order = Window.partitionBy("w").orderBy(F.desc("fresh"), F.xxhash64("w", "m"), "m")
    both = both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
    floors = lists.groupBy("node").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("floor"))
    known = units.select("node", "u").join(floors.hint("merge"), "node").withColumnRenamed("node", "m")
    met = both.join(known.hint("merge"), "m").groupBy("w").agg(F.max("fresh").alias("any"), F.collect_list(F.struct("m", "fresh", "floor", "u")).alias("g")).where("any")

    def meet(batches):
        for t in batches:
            g = t["g"]
            sizes = np.diff(g.offsets.to_numpy())
            flat = g.flatten()
            m, fresh, floor = flat.field("m").to_numpy(), flat.field("fresh").to_numpy(zero_copy_only=False), flat.field("floor").to_numpy()
            x, starts = _stack(flat.field("u"), width), np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
            out: tuple[list, list, list] = ([], [], [])
            for size in np.unique(sizes[sizes > 1]):
                of = np.flatnonzero(sizes == size)
                for a in range(0, len(of), max(1, 4_000_000 // (size * width))):
                    at = starts[of[a : a + max(1, 4_000_000 // (size * width))], None] + np.arange(size)
                    s = x[at] @ x[at].transpose(0, 2, 1)
                    bad = (m[at][:, :, None] == m[at][:, None, :]) | ~(fresh[at][:, :, None] | fresh[at][:, None, :]) | (s <= floor[at][:, :, None])
                    s = np.where(bad, -2.0, s)
                    order = np.argsort(-s, axis=2)[:, :, :take]
                    best = np.take_along_axis(s, order, 2)
                    group, row, col = np.nonzero(best > -2)
                    out[0].append(m[at[group, row]])
                    out[1].append(m[at[group, order[group, row, col]]])
                    out[2].append(best[group, row, col].astype(np.float64))
            none = np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c or [none]).astype(kind)) for c, kind in zip(out, (np.int64, np.int64, np.float64), strict=True)], ["node", "nbr", "sim"])

    return met.select("g").mapInArrow(meet, "node long, nbr long, sim double")


def _true_links(edges: DataFrame, classes: DataFrame, width: int, threshold: float) -> DataFrame:
    """``(u, v)``, u < v: listed pairs whose cosine in double precision reaches the threshold."""
    near = edges.where(F.col("sim") >= threshold - SLACK).select(F.least("node", "nbr").alias("u"), F.greatest("node", "nbr").alias("v")).distinct()
    x = lambda n: classes.select(F.col("node").alias(n), F.col("v").alias(f"x{n}")).hint("merge")
    both = near.join(x("u"), "u").join(x("v"), "v").select("u", "v", "xu", "xv")

    def reach(batches):
        for pdf in batches:
            a, b = _doubles(pdf["xu"].tolist(), width), _doubles(pdf["xv"].tolist(), width)
            cosine = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            yield pdf.loc[cosine >= threshold, ["u", "v"]]

    return both.mapInPandas(reach, "u long, v long")


def _small_counts(members: DataFrame, width: int, threshold: float) -> DataFrame:
    """``members(component, node, w, v)`` -> ``(node, n_links)``, components of few members each in a row."""

    def compare(batches):
        for pdf in batches:
            for group in pdf["g"]:
                x, w = _unit(_doubles([m["v"] for m in group], width)), np.array([m["w"] for m in group])
                linked = x @ x.T >= threshold
                np.fill_diagonal(linked, False)
                yield pd.DataFrame({"node": [m["node"] for m in group], "n_links": linked @ w + w - 1})

    rows = members.groupBy("component").agg(F.collect_list(F.struct("node", "w", "v")).alias("g"))
    return rows.select("g").mapInPandas(compare, "node long, n_links long")


def _dense_counts(members: DataFrame, width: int, threshold: float, tables: Tables, block: int = 4096) -> DataFrame:
    """``members(component, node, w, v)`` -> ``(node, n_links)`` within components, without a row for a pair.

    Members within half the threshold's angle of their component's mean direction are all linked, by the triangle inequality of
    angles: they are counted, not compared. The others are compared with all of their component in blocks.
    """

    def sums(batches):
        for pdf in batches:
            x = _unit(_doubles(pdf["v"].tolist(), width))
            for c, i in pdf.groupby("component").indices.items():
                yield pd.DataFrame({"component": [c], "total": [x[i].sum(axis=0).tolist()]})

    def total(pdf):
        return pd.DataFrame({"component": pdf["component"].iloc[:1], "total": [np.sum(np.stack(pdf["total"].tolist()), axis=0).tolist()]})

    kinds = "component long, total array<double>"
    means = tables.keep(members.select("component", "v").mapInPandas(sums, kinds).groupBy("component").applyInPandas(total, kinds))
    half = math.cos(math.acos(threshold) / 2) + 1e-9

    def split(batches):
        for pdf in batches:
            x, mean = _unit(_doubles(pdf["v"].tolist(), width)), np.stack(pdf["total"].tolist())
            size = np.sqrt((mean * mean).sum(axis=1))
            yield pdf[["component", "node", "w", "v"]].assign(core=(x * mean).sum(axis=1) >= half * np.maximum(size, 1e-300))

    placed = tables.keep(members.join(means.hint("merge"), "component").mapInPandas(split, "component long, node long, w long, v array<double>, core boolean"))
    sizes = tables.keep(placed.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("w")).otherwise(0)).alias("inside"), F.count("*").alias("n"), F.count_if(~F.col("core")).alias("outer")))
    counted = placed.join(sizes.hint("merge"), "component")
    own = counted.select("node", F.when(F.col("core"), F.col("inside") - 1).otherwise(F.col("w") - 1).alias("n_links"))
    n_outer, n_all = F.ceil(F.col("outer") / block).cast("int"), F.ceil(F.col("n") / block).cast("int")
    left = counted.where("outer > 0").withColumn("a", F.pmod(F.hash("node"), n_all)).withColumn("b", F.explode(F.sequence(F.lit(0), n_outer - 1)))
    right = counted.where("not core").withColumn("b", F.pmod(F.hash("node"), n_outer)).withColumn("a", F.explode(F.sequence(F.lit(0), n_all - 1)))

    def compare(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"node": np.zeros(0, np.int64), "n_links": np.zeros(0, np.int64)})
        if len(rows) and len(outer):
            x, y = _unit(_doubles(rows["v"].tolist(), width)), _unit(_doubles(outer["v"].tolist(), width))
            linked = (x @ y.T >= threshold) & (rows["node"].to_numpy()[:, None] != outer["node"].to_numpy()[None, :])
            out = pd.DataFrame({"node": outer["node"], "n_links": rows["w"].to_numpy() @ linked})
            core = rows["core"].to_numpy()  # two of the others meet from either side
            out = pd.concat([out, pd.DataFrame({"node": rows["node"][core], "n_links": linked[core] @ outer["w"].to_numpy()})])
        return out

    cell, cols = ["component", "a", "b"], ["node", "w", "v", "core"]
    found = left.select(*cell, *cols).groupBy(*cell).cogroup(right.select(*[F.col(c).alias(c) for c in (*cell, *cols)]).groupBy(*cell)).applyInPandas(compare, "node long, n_links long")
    return tables.keep(own.unionByName(found).groupBy("node").agg(F.sum("n_links").alias("n_links")))


def _audit(classes: DataFrame, counts: DataFrame, n: int, width: int, threshold: float, sample: int) -> float:
    """Share of the true links of about ``sample`` nodes (twice as many at most) that were found; they are compared with all rows."""
    share = min(1.0, sample / max(n, 1))
    picked = classes.where(F.pmod(F.xxhash64("cls", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * sample)
    picked = picked.join(counts.hint("merge"), "node", "left").select("node", "label", "v", "w", F.coalesce("n_links", F.col("w") - 1).alias("n_links")).collect()
    if not picked:
        return 1.0
    y, names, nodes = _unit(_doubles([r.v for r in picked], width)), np.array([r.label for r in picked], object), np.array([r.node for r in picked])

    def count(batches):
        total = np.zeros(len(nodes), np.int64)
        for pdf in batches:
            linked = (_unit(_doubles(pdf["v"].tolist(), width)) @ y.T >= threshold) & (pdf["label"].to_numpy()[:, None] == names[None, :]) & (pdf["node"].to_numpy()[:, None] != nodes[None, :])
            total += pdf["w"].to_numpy() @ linked
        yield pd.DataFrame({"i": np.arange(len(nodes)), "links": total})

    true = {r.i: r.links for r in classes.select("node", "label", "v", "w").mapInPandas(count, "i long, links long").groupBy("i").agg(F.sum("links").alias("links")).collect()}
    want = sum(true[i] + r.w - 1 for i, r in enumerate(picked))
    return sum(min(r.n_links, true[i] + r.w - 1) for i, r in enumerate(picked)) / want if want else 1.0


def near_embeddings(df: DataFrame, threshold: float = 0.93, k: int = 8, rounds: int = 8, target: float = 0.99, sample: int = 400) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` from ``(vec_id, embedding, label)``: vectors of equal label whose cosine reaches
    ``threshold`` are linked.

    A row with a null id, label or vector, a null or non-finite component, or only zeros links with nothing; it has 0 links and its
    own id. Rows that repeat id, label and vector are one vector. Vectors of other lengths count as padded with zeros. Equal vectors
    of a label are one node that counts as often as it is there, so copies cost nothing more.

    NN-descent: sorted random projections give first neighbours; then members of a list meet each other and lists keep the nearest
    ``k``. A list full of links grows to 3 k. Threshold edges give components, and inside each all links are counted, in
    components of over 3 k members by :func:`_dense_counts`, so what lists leave out is lost only if it would join two components.
    Rounds end when they add less than a thousandth to the links.
    An audit compares about ``sample`` nodes with all rows; below ``target`` the lists grow and the search goes on, up to three times.
    """
    spark = df.sparkSession
    tables = Tables(spark)
    rows, classes = _classes(df, tables)
    stats = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = stats.n, max(1, stats.width or 1)

    def units_of(batches):
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "label": pdf["label"], "u": [x.tobytes() for x in _unit(_doubles(pdf["v"].tolist(), width)).astype(np.float32)]})

    units = tables.keep(classes.select("node", "label", "v").mapInPandas(units_of, "node long, label string, u binary"))
    lists, recall = None, 0.0
    for attempt in range(3):
        most = 3 * k
        seeds = _seeds(units, n, width, 4 * attempt, 4).withColumn("fresh", F.lit(True))
        lists = tables.keep(_trim(lists.unionByName(seeds) if lists is not None else seeds, k, most, threshold))
        before = 0
        for turn in range(rounds):
            met = _round(lists, units, k, most, width).withColumn("fresh", F.lit(True))
            lists = tables.keep(_trim(lists.withColumn("fresh", F.lit(False)).unionByName(met), k, most, threshold))
            # links of full lists are counted later, and better ones among them are no progress
            per_node = lists.groupBy("node").agg(F.count_if(F.col("sim") >= threshold).alias("links"), F.count_if("fresh").alias("fresh"))
            now = per_node.agg(F.sum(F.least("links", F.lit(most))).alias("links"), F.sum("fresh").alias("fresh")).first()
            links = now.links or 0
            if not now.fresh or turn and links - before <= links // 1000:
                break
            before = links
        edges = tables.keep(_true_links(lists, classes, width, threshold))
        comp = tables.keep(connected_components(edges, tables=tables))
        sizes = tables.keep(comp.groupBy("component").agg(F.count("*").alias("size")))
        members = tables.keep(comp.join(sizes.hint("merge"), "component").join(classes.select("node", "w", "v").hint("merge"), "node").select("component", "size", "node", "w", "v"))
        few = F.col("size") <= most
        counts = _small_counts(members.where(few), width, threshold).unionByName(_dense_counts(members.where(~few).drop("size"), width, threshold, tables))
        counts = tables.keep(counts)
        recall = _audit(classes, counts, n, width, threshold, sample)
        if recall >= target:
            break
        k *= 2
    else:
        warnings.warn(f"the audit found {recall:.3f} of the links", stacklevel=2)
    least = comp.join(classes.select("node", "cls").hint("merge"), "node").groupBy("component").agg(F.min("cls").alias("least"))
    placed = comp.join(least.hint("merge"), "component").select("node", "least")
    nodes = classes.join(placed.hint("merge"), "node", "left").join(counts.hint("merge"), "node", "left")
    nodes = nodes.select("label", "v", F.coalesce("least", "cls").alias("component_id"), F.coalesce("n_links", F.col("w") - 1).alias("n_links"))
    linked = rows.join(nodes.hint("merge"), ["label", "v"]).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    alone = df.select(F.col("vec_id").cast("long").alias("vec_id")).join(rows.select(F.col("id").alias("vec_id")).hint("merge"), "vec_id", "left_anti")
    alone = alone.distinct().select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return tables.done(out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")))
