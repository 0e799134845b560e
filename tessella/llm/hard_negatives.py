"""Hard negatives by rotated one-bit codes with certain bounds on inner products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.nearest import _matrix, _products, integer_vectors
from tessella.session import Tables

#: Bits an anchor's component keeps in the popcount estimate.
PLANES = 5


def rotation(width: int, level: int) -> np.ndarray:
    """A fixed random orthogonal matrix of a level."""
    q, r = np.linalg.qr(np.random.default_rng(1000 + level).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, levels, words) of 64-bit words, alignments and the norms of what each level leaves (rows, levels).

    A level turns the rest by its rotation and keeps the signs b; the alignment is the inner product of rest and b / sqrt(width),
    and alignment times that unit vector is taken off. What is left shrinks by about 0.6 a level.
    """
    rest, width = x.astype(np.float64), x.shape[1]
    words = -(-width // 64)
    codes, align, left = np.zeros((len(x), levels, words), np.uint64), np.zeros((len(x), levels)), np.zeros((len(x), levels))
    for k in range(levels):
        turn = rotation(width, k)
        y = rest @ turn.T
        signs = np.where(y >= 0, 1.0, -1.0)
        bits = np.zeros((len(x), words * 64), np.uint8)
        bits[:, :width] = y >= 0
        codes[:, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        align[:, k] = (y * signs).sum(axis=1) / np.sqrt(width)
        rest = rest - (align[:, k, None] / np.sqrt(width) * signs) @ turn
        left[:, k] = np.sqrt((rest**2).sum(axis=1))
    return codes, align, left


class Anchors:
    """Anchors turned by each level's rotation and cut into bit planes; they bound inner products with codes."""

    def __init__(self, q: np.ndarray, levels: int):
        self.width, self.norm = q.shape[1], np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        self.levels = []
        for k in range(levels):
            y = q @ rotation(self.width, k).T
            low = y.min(axis=1, initial=0)
            step = np.maximum((y.max(axis=1, initial=0) - low) / ((1 << PLANES) - 1), 1e-12)
            whole = np.rint((y - low[:, None]) / step[:, None]).astype(np.int64)
            left = np.sqrt(((y - low[:, None] - step[:, None] * whole) ** 2).sum(axis=1))
            bits = np.zeros((len(q), PLANES, -(-self.width // 64) * 64), np.uint8)
            for p in range(PLANES):
                bits[:, p, : self.width] = whole >> p & 1
            self.levels.append((low, step, whole.sum(axis=1), left, np.packbits(bits, axis=2, bitorder="little").view(np.uint64)))

    def survivors(self, i: int, rows: np.ndarray, codes: np.ndarray, align: np.ndarray, rest: np.ndarray, keep) -> np.ndarray:
        """Those of ``rows`` that ``keep(least, most)`` leaves after every level, by certain bounds on the product with anchor ``i``.

        The product with a level's signs is counted from bits that anchor planes and code share; what planes leave of the anchor
        meets the unit code vector, and what codes leave of the row meets the anchor: both by Cauchy-Schwarz.
        """
        estimate, slack = np.zeros(len(rows)), np.zeros(len(rows))
        for k, (low, step, total, left, planes) in enumerate(self.levels):
            code = codes[rows, k]
            ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
            shared = np.zeros(len(rows), np.int64)
            for p in range(PLANES):
                shared += np.bitwise_count(code & planes[i, p]).sum(axis=1, dtype=np.int64) << p
            signed = low[i] * (2 * ones - self.width) + step[i] * (2 * shared - total[i])
            estimate = estimate + align[rows, k] / np.sqrt(self.width) * signed
            slack = slack + align[rows, k] * left[i]
            wide = (slack + rest[rows, k] * self.norm[i]) * (1 + 1e-9) + 1e-6 * (1 + np.abs(estimate))
            on = np.flatnonzero(keep(estimate - wide, estimate + wide))
            rows, estimate, slack = rows[on], estimate[on], slack[on]
        return rows


def _unpack(rows: pd.DataFrame, levels: int, width: int):
    codes = np.frombuffer(b"".join(rows["codes"]), np.uint64).reshape(len(rows), levels, -1)
    bounds = np.frombuffer(b"".join(rows["bounds"]), np.float64).reshape(len(rows), 2, levels)
    return _matrix(rows["v"].tolist(), width), codes, bounds[:, 0], bounds[:, 1]


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _positives(k: int, levels: int, width: int):
    """A cell's k best rows of the anchor's label."""

    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            x, *coded = _unpack(rows, levels, width)
            ids, label, q = rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(anchors["v"].tolist(), width)
            known = Anchors(q, levels)

            def keep(least, most):
                return most >= np.partition(least, len(least) - k)[len(least) - k] if len(least) > k else np.ones(len(least), bool)

            for i, (a, own, named) in enumerate(zip(anchors["a"], anchors["id"], anchors["label"], strict=True)):
                at = known.survivors(i, np.flatnonzero((label == named) & (ids != own)), *coded, keep)
                score = _products(q[i : i + 1], x[at])[0]
                best = _first(score, ids[at], k)
                out += [(a, j, s) for j, s in zip(ids[at][best].tolist(), score[best].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["a", "positive_id", "positive_score"])

    return run


def _negatives(k: int, low: int, levels: int, width: int):
    """A cell's k best rows of other labels within reach of every positive."""

    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            x, *coded = _unpack(rows, levels, width)
            ids, label, q = rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(anchors["v"].tolist(), width)
            known = Anchors(q, levels)
            for i, (a, named, positives) in enumerate(zip(anchors["a"], anchors["label"], anchors["positives"], strict=True)):
                reach = np.array(sorted({int(p) for p in positives if p >= 0}), np.int64)
                if not len(reach):
                    continue  # below 0, 80 % of a score is more than the score
                floor, top = reach[0] * low / 100, reach[-1]
                at = known.survivors(i, np.flatnonzero(label != named), *coded, lambda least, most: (most >= floor) & (least <= top))  # noqa: B023
                score = _products(q[i : i + 1], x[at])[0]
                for p in reach.tolist():
                    fits = np.flatnonzero((low * p <= 100 * score) & (score <= p))
                    best = fits[_first(score[fits], ids[at][fits], k)]
                    out += [(a, p, j, s) for j, s in zip(ids[at][best].tolist(), score[best].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["a", "positive_score", "negative_id", "negative_score"])

    return run


def labelled_vectors(df: DataFrame, every: int = 7) -> DataFrame:
    """``(id, v, label)``: rows with a label and whole vectors, see :func:`nearest.integer_vectors`; where ``every`` divides the id, the
    label becomes (label + 1) % 10. Rows that repeat all three count once."""
    label = F.col("label").cast("long")
    named = df.where(F.col("label").isNotNull()).select("vec_id", "embedding", F.when(F.col("vec_id") % every == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return integer_vectors(named, more=("label",))


def mine(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, levels: int = 4, cell_rows: int = 8192, cell_anchors: int = 4096) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from ``vectors(id, v, label)``.

    Anchors are the rows that meet ``is_anchor``, a condition on ``id``. An anchor's positives are its first ``positives`` rows of
    other ids and the same label by integer inner product, ties to the smaller id; for each, the first ``negatives`` rows of other
    labels whose score is ``low`` percent of the positive's at least and the positive's at most. Vectors of other lengths count as
    padded with zeros. An anchor without positives, or a positive without such rows, has no row in the result.

    Every row is coded once: ``levels`` one-bit codes by fixed rotations, each with its alignment. Rows are dealt by a hash of the id
    and anchors by blocks, whatever their labels; a cell bounds its products level by level and scores in integers what is left. A
    level cuts what is unknown of a row to about 0.6, so bounds of one code alone would leave nearly all rows.
    """
    tables = Tables(vectors.sparkSession)
    rows = tables.keep(vectors.dropDuplicates(["id", "v", "label"]))
    stats = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("v")).alias("width")).first()
    width = max(1, stats.width or 1)

    def coded(batches):
        for pdf in batches:
            codes, align, rest = encode(_matrix(pdf["v"].tolist(), width), levels)
            both = np.stack([align, rest], axis=1)
            yield pdf.assign(codes=[c.tobytes() for c in codes], bounds=[b.tobytes() for b in both])

    index = tables.keep(rows.mapInPandas(coded, "id long, v array<long>, label long, codes binary, bounds binary"))
    parts, blocks = -(-max(1, stats.n) // cell_rows), -(-max(1, stats.anchors) // cell_anchors)
    asked = tables.keep(rows.where(is_anchor).withColumn("a", F.monotonically_increasing_id()))
    cell = ["block", "part"]
    spread = index.withColumn("part", F.pmod(F.hash("id"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = lambda df: df.withColumn("block", F.pmod(F.hash("a"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    meet = lambda df, fn, kinds: spread.groupBy(*cell).cogroup(dealt(df).groupBy(*cell)).applyInPandas(fn, kinds)
    near = meet(asked, _positives(positives, levels, width), "a long, positive_id long, positive_score long")
    order = Window.partitionBy("a").orderBy(F.desc("positive_score"), "positive_id")
    near = tables.keep(near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives).drop("r"))
    scores = near.groupBy("a").agg(F.collect_set("positive_score").alias("positives"))
    hard = meet(asked.join(scores.hint("merge"), "a"), _negatives(negatives, low, levels, width), "a long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("a", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = near.join(hard.hint("merge"), ["a", "positive_score"]).join(asked.select("a", F.col("id").alias("anchor_id")).hint("merge"), "a")
    return tables.done(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
