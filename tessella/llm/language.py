"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
RANKS = 300


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of a text's letters, each word with one mark on either side. A code packs
    21 bits a character; grams with a mark in their middle, and the mark alone, are left out."""
    words = LETTERS.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(("\x01" + "\x01".join(words) + "\x01").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    gap = c == 1
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.unique(np.concatenate([c[~gap], two, three[~gap[1:-1]]]), return_counts=True)


def top_ranks(codes: np.ndarray, counts: np.ndarray, most: int = RANKS) -> np.ndarray:
    """The most frequent codes, ties to the smaller code."""
    return codes[np.argsort(-counts, kind="stable")[:most]]


def learn_profiles(docs: DataFrame, per_language: int = 2000, most: int = RANKS) -> dict[str, list[int]]:
    """Each language's ``most`` most frequent n-grams in rank order, over about ``per_language`` documents a language,
    dealt by a hash of the id, of those outside the held-out fifth that have a language. Null ids, texts and languages are
    not learned from; repeated rows count each time; ties go to the smaller code; an empty table gives no profile."""
    own = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(False))
    )
    n = {r.lang: r["count"] for r in own.groupBy("lang").count().toLocalIterator()}  # one row a language
    if not n:
        return {}
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1 << 20, int((1 << 20) * per_language / v) + 1))])
    sample = own.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20)) < share[F.col("lang")])

    def count(batches):
        for batch in batches:
            seen: dict[str, tuple[list, list]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                codes, counts = gram_counts(text)
                seen.setdefault(lang, ([], []))[0].append(codes)
                seen[lang][1].append(counts)
            for lang, (codes, counts) in seen.items():
                u, inverse = np.unique(np.concatenate(codes), return_inverse=True)
                total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u), pa.array(total)], ["lang", "gram", "n"])

    grams = sample.select("text", "lang").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[tuple[int, int]]] = {}
    for r in grams.withColumn("r", rank).where(F.col("r") <= most).toLocalIterator():  # at most 300 rows a language
        out.setdefault(r.lang, []).append((r.r, r.gram))
    return {k: [g for _, g in sorted(v)] for k, v in sorted(out.items())}


def identify(docs: DataFrame, profiles: dict[str, list[int]], most: int = RANKS) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``, from the whole text.

    A document's ``most`` most frequent n-grams are compared with each profile: the distance adds how far each gram's rank
    is out of place, ``most`` where the profile lacks it. The least distance wins, ties to the first language by name.
    ``score`` is 1 - distance / worst distance possible. ``und`` with score 0 for null texts, texts without a letter, and
    when nothing was learned. Repeated rows give repeated rows; other columns are not read.
    """
    names = list(profiles)
    known = np.unique(np.array([g for v in profiles.values() for g in v], np.int64))
    ranks = np.full((len(names), len(known) + 1), -1, np.int64)
    for i, v in enumerate(profiles.values()):
        ranks[i, np.searchsorted(known, np.array(v, np.int64))] = np.arange(len(v))

    def predict(text):
        top = top_ranks(*gram_counts(text), most)
        if not len(top) or not names:
            return "und", 0.0
        at = np.searchsorted(known, top)
        at[known[np.minimum(at, len(known) - 1)] != top] = len(known)
        r = ranks[:, at]
        far = np.where(r < 0, most, np.abs(r - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(far))
        return names[best], float(1 - far[best] / (most * len(top)))

    def run(batches):
        for batch in batches:
            got = [predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of :func:`identify`'s result."""
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
