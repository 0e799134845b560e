"""Line dedup: winnowed line hashes find what may repeat, their windows are joined by position, matches run on both ways."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import MULT, mix, utf8, word_hashes
from tessella.session import Tables

#: A repeated run goes if it has so many lines, or so many words in all its lines.
LINES, WORDS = 4, 50


def line_words(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, line number, words)`` of the lines that aren't blank; case of A-Z and white space around and between words don't count."""
    rows = [(i, line.lower().split()) for i, line in enumerate(text.split(b"\n"))] if text else []
    rows = [(i, words) for i, words in rows if words]
    h = word_hashes([b" ".join(w) for _, w in rows])
    return h.view(np.int64), np.array([i for i, _ in rows], np.int32), np.array([len(w) for _, w in rows], np.int64)


def windows(h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(first, last, fingerprint, hash, second hash)`` of every window of LINES lines, or of WORDS words together, that holds
    no smaller one at its first or at its last line: any line of a repeated run that is large enough lies in such a window
    inside that run. The fingerprint is the window's least line hash, the same in every copy."""
    u, out, large = h.view(np.uint64), [(np.zeros(0, np.int64), 0, np.zeros((3, 0), np.uint64))], {}
    total = np.concatenate([[0], np.cumsum(words)])
    for k in range(1, min(LINES, len(u)) + 1):
        n = len(u) - k + 1
        large[k] = (total[k:] - total[:-k] >= WORDS) | (k == LINES)
        left, right = large[k].copy(), large[k].copy()
        for j in range(1, k):
            left &= ~large[j][:n]
            right &= ~large[j][k - j : k - j + n]
        at = np.flatnonzero(left | right)
        g = np.full((2, len(at)), k, np.uint64)
        g[1] += MULT
        least = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
        for i in range(k):
            g = mix(g * MULT + u[at + i])
            least = np.minimum(least, u[at + i])
        out.append((at, k, np.concatenate([least[None], g])))
    first, g = np.concatenate([x[0] for x in out]), np.concatenate([x[2] for x in out], axis=1).view(np.int64)
    return first, np.concatenate([x[0] + x[1] - 1 for x in out]), g[0], g[1], g[2]


def _places(batches):
    for batch in batches:
        got = []
        for text in utf8(batch.column("text")):
            h, line, words = line_words(text)
            first, last, w, f, g = windows(h, words)
            after = np.append(line[1:], line[-1:] + 1)
            got.append((line[first], line[last], after[last], w, f, g))
        if got:
            at = pa.array(np.repeat(np.arange(len(got)), [len(x[0]) for x in got]))
            cols = [pa.array(np.concatenate([x[i] for x in got])) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column("d").take(at), batch.column("t").take(at), *cols], ["d", "t", "a", "z", "e", "w", "f", "g"])


def _flags(batches):
    """Matched windows of a document, joined to runs: whether each line goes, up to the last that does."""
    for batch in batches:
        out = []
        for c in batch.column("cuts").to_pylist():
            cuts = np.array(sorted((x["a"], x["z"], x["e"]) for x in c))
            flags, after = np.zeros(int(cuts[:, 1].max()) + 1, bool), -1
            for a, z, e in cuts.tolist():
                flags[(start if a <= after else a) : z + 1] = True
                start, after = (max(start, z) if a <= after else z), max(e, after)
            out.append(flags)
        yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("t"), pa.array(out, pa.list_(pa.bool_()))], ["d", "t", "flags"])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", before: str = "lines_before", removed: str = "lines_removed") -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` cleaned, and two more columns: lines before and lines removed.

    Documents are taken in order of id. A line goes if it lies in any run of lines, large enough to go, that stands at an
    earlier place too; a run is large enough with LINES lines, or with WORDS words in all its lines together. Runs may repeat
    earlier lines of their own document. Blank lines don't end a run; they go if the lines before and after them go.

    1. Winnowing: the least line hash of every window is its fingerprint. A repeated window repeats its fingerprint, so
       windows whose fingerprint stands in one window only are done.
    2. The positions of the others are joined by the whole window, so each match has its own first place and a frequent line
       does not hide it. Matches that overlap or meet are one run: every line that extends a match lies in a window too, and
       is looked up with it, to both sides.
    3. Runs go everywhere but at their first place.

    Null and empty texts stay as they are, and so do rows of null ids; rows that repeat an id and a text are one document and
    share its result; rows that share an id but not the text are told apart by a hash of it. Earlier columns of the two names
    are replaced; other columns may have any name but those beginning with __line.
    """
    docs = docs.drop(before, removed)
    tables = Tables(docs.sparkSession)
    key = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("text")).where("d is not null and text is not null")
    kind = f"d {docs.schema[doc_id].dataType.simpleString()}, t long"
    places = tables.keep(key.mapInArrow(_places, f"{kind}, a int, z int, e int, w long, f long, g long"))
    # rows that repeat a document repeat its places
    twice = places.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select(F.col("w").alias("w2"))
    some = tables.keep(places.join(twice.hint("merge"), F.col("w") == F.col("w2"), "left_semi").drop("w"))
    first = some.groupBy("f", "g").agg(F.min(F.struct("d", "t", "a")).alias("x"), F.count("*").alias("n")).where("n > 1").select("f", "g", "x")
    later = some.join(first.hint("merge"), ["f", "g"]).where("not (d = x.d and t = x.t and a = x.a)")
    flags = later.groupBy("d", "t").agg(F.collect_list(F.struct("a", "z", "e")).alias("cuts")).mapInArrow(_flags, f"{kind}, flags array<boolean>")
    flags = tables.done(flags.select(F.col("d").alias("__line_d"), F.col("t").alias("__line_t"), F.col("flags").alias("__line_flags")))
    same = (F.col(doc_id) == F.col("__line_d")) & (F.col("__line_h") == F.col("__line_t"))
    joined = docs.withColumn("__line_h", F.xxhash64(text)).join(flags.hint("merge"), same, "left")
    lines, hit = F.split(F.col(text), "\n", -1), F.col("__line_flags").isNotNull()
    kept = F.when(hit, F.filter(lines, lambda x, i: ~F.coalesce(F.get("__line_flags", i), F.lit(False))))
    joined = joined.withColumn("__line_kept", kept).withColumn("__line_n", F.when(F.col(text).isNotNull(), F.size(lines)).otherwise(0))
    gone = F.when(hit, F.col("__line_n") - F.size("__line_kept")).otherwise(0)
    clean = F.when(hit, F.array_join("__line_kept", "\n")).otherwise(F.col(text))
    return joined.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], F.col("__line_n").cast("long").alias(before), gone.cast("long").alias(removed))


def digest(cleaned: DataFrame) -> DataFrame:
    """A document's line counts and a hash of what is left of it (null: empty)."""
    return cleaned.select("doc_id", "lines_before", "lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
