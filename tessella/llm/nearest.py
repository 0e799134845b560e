"""Exact top-k inner-product search with a pivot-distance index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import Tables


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, more: tuple[str, ...] = ()) -> DataFrame:
    """``(id, v)`` and the columns ``more``, with every component x as floor(scale * x), x as double. Rows with a null id, a null vector, or a null or
    non-finite component take no part."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"), *more
    )


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where every partial sum is an exact integer, else in 64-bit integers."""
    top = (int(np.abs(q).max(initial=0)) or 1) * (int(np.abs(x).max(initial=0)) or 1) * max(1, q.shape[1])
    if top < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest scores, ties to the smaller id."""
    if len(score) > 8 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= cut)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))][:k]


def _search_cell(k: int, width: int):
    """One cell: its queries against its vectors, in blocks."""

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        if len(vectors) and len(queries):
            x, ids = _matrix(vectors["v"].tolist(), width), vectors["cls"].to_numpy()
            for a in range(0, len(queries), 256):
                part = queries.iloc[a : a + 256]
                scores = _products(_matrix(part["v"].tolist(), width), x)
                for i, q in enumerate(part["q"].to_numpy()):
                    best = _best(scores[i], ids, k)
                    out[0].extend([q] * len(best))
                    out[1].extend(ids[best].tolist())
                    out[2].extend(scores[i][best].tolist())
        return pd.DataFrame({"q": np.array(out[0], np.int64), "cls": np.array(out[1], np.int64), "score": np.array(out[2], np.int64)})

    return run


def _pivots(vectors: DataFrame, n: int, wanted: int, width: int, sample: int = 2000) -> np.ndarray:
    """Pivots far from each other, out of a sample of about ``sample`` vectors dealt by a hash, 2 * sample at most. Which they
    are decides how much is searched, not what is found."""
    share = min(1.0, sample / max(n, 1))
    rows = vectors.where(F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * sample)
    x = _matrix([r.v for r in sorted(rows.select("cls", "v").toLocalIterator(), key=lambda r: r.cls)], width).astype(np.float64)
    if not len(x):
        return np.zeros((1, width))
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(wanted, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    # one averaging step puts each pivot among its vectors
    c = x[chosen]
    near = ((c**2).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
    return np.array([x[near == i].mean(axis=0) for i in range(len(chosen)) if (near == i).any()])


def top_k(vectors: DataFrame, is_query, k: int = 5, cell_rows: int = 2000, rings: int = 6, most_pivots: int = 512, cell_queries: int = 2048) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest integer inner products of every query with every other id.

    ``vectors(id, v)`` comes from :func:`integer_vectors`; ``is_query`` is a condition on ``id``. Ties go to the smaller id.
    Vectors of other lengths count as padded with zeros; a repeated row counts once; equal vectors form a class that is
    searched once and answers with its k + 1 smallest ids, so groups of copies cost nothing more.

    Inner product becomes distance by one more component that gives all vectors one norm M: then
    d(q, x)^2 = |q|^2 + M^2 - 2 q.x. Each vector is keyed by its nearest pivot p and its ring of d(p, x). A query first
    searches the rings of its nearest pivot around its own distance, which bounds its (k + 1)-th score; then it visits only
    pivots, and of these only rings, where |d(q, p) - d(x, p)| <= d(q, x) leaves room for a score as high. The bound carries
    a margin for rounding. There are at most ``most_pivots`` pivots, a row each; larger tables have more rings a pivot.
    """
    tables = Tables(vectors.sparkSession)
    rows = vectors.dropDuplicates(["id", "v"])
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = tables.keep(
        rows.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("cls"), "ids", "v")
    )
    asked = tables.keep(rows.where(is_query).join(classes.select("cls", "v").hint("merge"), "v").select("id", F.col("cls").alias("q"), "v"))
    stats = classes.agg(
        F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("m2")
    ).first()
    n, width, m2 = stats.n, stats.width or 1, stats.m2 or 0.0
    pivots = _pivots(classes, n, int(min(most_pivots, max(8, n // (cell_rows * rings)))), width)
    norms = (pivots**2).sum(axis=1)

    def keyed(batches):
        # the added component is 0 in a pivot and in a query: both only need distances to vectors
        for pdf in batches:
            x = _matrix(pdf["v"].tolist(), width).astype(np.float64)
            own = (x**2).sum(axis=1)
            d2 = np.maximum(norms[None, :] + m2 - 2 * x @ pivots.T, 0)  # |x'|^2 = M^2
            near = d2.argmin(axis=1)
            yield pdf.assign(pivot=near.astype(np.int32), dist=np.sqrt(d2[np.arange(len(x)), near]), norm2=own)

    spread = classes.mapInPandas(keyed, "cls long, ids array<long>, v array<long>, pivot int, dist double, norm2 double")
    placed = tables.keep(spread)
    span = tables.keep(placed.groupBy("pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("n")))  # a row a pivot
    ends = np.full((2, len(pivots)), np.inf)
    for r in span.collect():  # at most most_pivots rows
        ends[:, r.pivot] = r.lo, r.hi
    ring = F.least(F.floor((F.col("dist") - F.col("lo")) / F.greatest((F.col("hi") - F.col("lo")) / F.ceil(F.col("n") / cell_rows), F.lit(1e-9))), F.ceil(F.col("n") / cell_rows)).cast("int")
    placed = placed.join(F.broadcast(span), "pivot").withColumn("ring", ring)
    sizes = placed.groupBy("pivot", "ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("size"))
    sizes = tables.keep(sizes)
    parts = F.ceil(F.col("size") / (4 * cell_rows)).cast("int")
    cells = tables.keep(
        placed.join(sizes.select("pivot", "ring", "size").hint("merge"), ["pivot", "ring"]).select("cls", "v", "pivot", "ring", F.pmod(F.hash("cls"), parts).alias("part"))
    )
    queries = asked.select("q", "v").dropDuplicates(["q"])

    def reach(floors: bool):
        def run(batches):
            for pdf in batches:
                q = _matrix(pdf["v"].tolist(), width).astype(np.float64)
                q2 = (q**2).sum(axis=1)
                d = np.sqrt(np.maximum(q2[:, None] + norms[None, :] - 2 * q @ pivots.T, 0))
                if floors:
                    away = np.maximum(np.maximum(ends[0] - d, d - ends[1]), 0) * (1 - 1e-9)
                    most = (q2[:, None] + m2 - away * away) / 2 * (1 + 1e-9) + 1
                    i, p = np.nonzero((most >= pdf["floor"].fillna(-np.inf).to_numpy(float)[:, None]) & np.isfinite(ends[0]))
                else:
                    i, p = np.arange(len(q)), np.where(np.isfinite(ends[0]), d, np.inf).argmin(axis=1)
                yield pd.DataFrame({"q": pdf["q"].to_numpy()[i], "pivot": p.astype(np.int32), "dq": d[i, p], "q2": q2[i]} | ({"floor": pdf["floor"].to_numpy(float)[i]} if floors else {}))

        return run

    kinds = "q long, pivot int, dq double, q2 double"
    away = F.greatest(F.col("lo") - F.col("dq"), F.col("dq") - F.col("hi"), F.lit(0.0)) * (1 - 1e-9)
    best = F.floor((F.col("q2") + m2 - away * away) / 2 * (1 + F.lit(1e-9)) + 1)
    rings_of = lambda df, *more: df.join(sizes.hint("merge"), "pivot").select("q", "pivot", "ring", "size", best.alias("most"), *more)
    order = Window.partitionBy("q").orderBy(F.desc("most"), "ring")
    seen = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = rings_of(queries.mapInPandas(reach(False), kinds)).withColumn("seen", seen)
    first = tables.keep(first.where(F.col("seen") < 2 * cell_rows).select("q", "pivot", "ring"))

    def search(which: DataFrame) -> DataFrame:
        # a ring's vectors are in parts and the queries that visit it in blocks: no cell has more than some thousands of either
        blocks = which.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / cell_queries).cast("int").alias("blocks"))
        asks = tables.keep(blocks.join(sizes.select("pivot", "ring", parts.alias("parts")).hint("merge"), ["pivot", "ring"]))
        wide = which.join(queries.hint("merge"), "q").join(asks.hint("merge"), ["pivot", "ring"])
        wide = wide.select("q", "v", "pivot", "ring", F.pmod(F.hash("q"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        held = cells.join(asks.hint("merge"), ["pivot", "ring"]).select("cls", "v", "pivot", "ring", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        keys = ["pivot", "ring", "part", "block"]
        found = held.groupBy(*keys).cogroup(wide.groupBy(*keys)).applyInPandas(_search_cell(k + 1, width), "q long, cls long, score long")
        top = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls"))
        return found.withColumn("r", top).where(F.col("r") <= k + 1)

    opening = tables.keep(search(first))
    floor = opening.where(F.col("r") == k + 1).select("q", F.col("score").cast("double").alias("floor"))
    asked_again = queries.join(floor.hint("merge"), "q", "left").mapInPandas(reach(True), f"{kinds}, floor double")
    rest = rings_of(asked_again, "floor").where("floor is null or most >= floor").join(first.hint("merge"), ["q", "pivot", "ring"], "left_anti")
    found = opening.drop("r").unionByName(search(tables.keep(rest.select("q", "pivot", "ring"))).drop("r"))
    top = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls"))
    found = found.withColumn("r", top).where(F.col("r") <= k + 1).join(classes.select("cls", "ids").hint("merge"), "cls")
    each = found.select("q", F.explode("ids").alias("vec_id"), "score")
    pairs = asked.select(F.col("id").alias("query_id"), "q").join(each.hint("merge"), "q").where("vec_id <> query_id")
    final = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return tables.done(pairs.withColumn("rank", final).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
