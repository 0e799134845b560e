"""Exact removal of repeated byte strings: sampled candidates, then external suffix sorting of what may differ."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.induced_sort import visit_suffixes
from tessella.llm.words import MULT, chunks, mix, utf8
from tessella.session import Tables, shared_dir

#: Length of the strings, of the grams that sample them, and so how many grams each string holds.
LENGTH, GRAM = 100, 36
SPAN = LENGTH - GRAM + 1
#: Text of one shard of the suffix sort; text whose records share a bucket; different segments of one gram from which on the
#: gram's strings are dealt to many tasks, since its segments would fill a shard of their own.
SHARD_BYTES, BUCKET_BYTES, MANY = 4_000_000, 8_000_000, 50_000
_A, _B = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95)
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * MULT)
_POWERS: dict = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        both = []
        for b in (int(base), pow(int(base), -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        have = _POWERS[int(base)] = tuple(both)
    return have[0][:n], have[1][:n]


def _prefix(raw: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    up, back = _powers(base, len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODES[raw] * up, out=total[1:])
    return total, back


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``(doc index, anchor hash, segment hash, first start, starts)``: the 100-byte strings of each text in runs that share an
    anchor. A string's anchor is the gram of least hash in it, the first of equals: equal strings have equal anchors at equal
    places. A segment is all bytes of such a run's strings."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    n = len(raw)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int32, np.uint64, np.uint64, np.int64, np.int64))
    total, back = _prefix(raw, _A)
    grams = n - GRAM + 1
    g = mix((total[GRAM:] - total[:grams]) * back[:grams])
    least, width = np.arange(grams, dtype=np.int32), 1
    while width * 2 <= SPAN:
        left, right = least[:-width], least[width:]
        least = np.where(g[left] <= g[right], left, right)
        width *= 2
    if width < SPAN:
        shift = SPAN - width
        left, right = least[:-shift], least[shift:]
        least = np.where(g[left] <= g[right], left, right)
    starts = n - LENGTH + 1
    least = least[:starts]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    ok = doc[:starts] == doc[LENGTH - 1 :]
    key = np.where(ok, least, -1)
    cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:starts] != doc[: starts - 1])]))
    size = np.diff(np.concatenate([cut, [starts]]))
    keep = ok[cut]
    s0, size = cut[keep], size[keep]
    total, back = _prefix(raw, _B)
    seg = mix((total[s0 + size + LENGTH - 1] - total[s0]) * back[s0] + size.astype(np.uint64) * MULT)
    d = doc[s0]
    return d, g[least[s0]], seg, s0 - (ends - sizes)[d], size


_RECORDS = [("a", np.uint64), ("s", np.uint64), ("doc", np.int64), ("at", np.int64)]


def _pack(cols: dict[str, np.ndarray]) -> bytes:
    n = np.array([len(cols["a"])], np.int64).tobytes()
    return n + b"".join(np.ascontiguousarray(cols[k], t).tobytes() for k, t in _RECORDS)


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {k: [] for k, _ in _RECORDS}
    for b in blobs:
        n, at = int(np.frombuffer(b, np.int64, 1)[0]), 8
        for k, t in _RECORDS:
            parts[k].append(np.frombuffer(b, t, n, at))
            at += 8 * n
    return {k: np.concatenate(v) if v else np.zeros(0, t) for (k, t), v in zip(_RECORDS, parts.values())}


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _later(first: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Members of each run that stand elsewhere than its first one."""
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0)) if len(first) else np.zeros(0, np.int64)
    return ~first & ((doc != doc[head]) | (at != at[head]))


def _send(buckets: int):
    """Map side: the first of equal segments goes to its anchor's bucket; later ones are known to be repeats here."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), utf8(batch.column("text"))
            parts = []
            for a, b in chunks([len(t) for t in texts], 1 << 18):
                d, anchor, seg, s0, size = segments(texts[a:b])
                parts.append((anchor, seg, ids[a:b][d], (s0 << 7) | size))
            if not parts:
                continue
            a, s, doc, at = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((at, doc, s, a))
            a, s, doc, at = a[order], s[order], doc[order].astype(np.int64), at[order].astype(np.int64)
            first = _first_of_runs(a, s)
            again = np.flatnonzero(_later(first, doc, at))
            rows: tuple[list, list, list] = ([], [], [])
            if len(again):
                rows[0].append(int(again[0] * 7919 + len(a)) % buckets)
                rows[1].append(True)
                rows[2].append(_pack({"a": a[again], "s": s[again], "doc": doc[again], "at": at[again]}))
            a, s, doc, at = a[first], s[first], doc[first], at[first]
            to = ((a >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            for part in np.split(order, cuts) if len(order) else ():
                rows[0].append(int(to[part[0]]))
                rows[1].append(False)
                rows[2].append(_pack({"a": a[part], "s": s[part], "doc": doc[part], "at": at[part]}))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.bool_()), pa.array(rows[2], pa.large_binary())], ["bucket", "known", "blob"])

    return run


def _resolve(table: pa.Table) -> pa.Table:
    """One bucket: of equal segments all but the first are repeats; anchors with several segments are left to compare."""
    known = table.column("known").to_pylist()
    blobs = table.column("blob").to_pylist()
    gone = _unpack([b for b, k in zip(blobs, known) if k])
    x = _unpack([b for b, k in zip(blobs, known) if not k])
    order = np.lexsort((x["at"], x["doc"], x["s"], x["a"]))
    x = {k: v[order] for k, v in x.items()}
    first = _first_of_runs(x["a"], x["s"])
    one = {k: v[first] for k, v in x.items()}
    later = _later(first, x["doc"], x["at"])
    group = np.cumsum(_first_of_runs(one["a"])) - 1
    n = np.bincount(group, minlength=1)[group] if len(group) else np.zeros(0, np.int64)
    many = n > 1
    doc = np.concatenate([gone["doc"], x["doc"][later], one["doc"][many]])
    at = np.concatenate([gone["at"], x["at"][later], one["at"][many]])
    removed = len(gone["doc"]) + int(later.sum())
    anchor = np.concatenate([np.zeros(removed, np.int64), one["a"][many].view(np.int64)])
    kind = np.concatenate([np.zeros(removed, np.int8), np.where(n[many] > MANY, 2, 1).astype(np.int8)])
    return pa.table({"doc_id": doc, "at": at, "anchor": anchor, "kind": kind})


def _cut_out(batches):
    """The bytes of the segments that are left to compare."""
    for batch in batches:
        out: dict[str, list] = {"doc_id": [], "at": [], "anchor": [], "kind": [], "bytes": []}
        for d, raw, todo in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("todo").to_pylist()):
            for t in todo:
                s0, size = t["at"] >> 7, t["at"] & 127
                for k, v in zip(out, (d, t["at"], t["anchor"], t["kind"], raw[s0 : s0 + size + LENGTH - 1])):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([*[pa.array(out[k], pa.int64()) for k in ("doc_id", "at", "anchor")], pa.array(out["kind"], pa.int8()), pa.array(out["bytes"], pa.binary())], list(out))


class _Repeats:
    """Gets all suffixes of a shard in order; of those that share LENGTH characters all but the first in the text are repeats.
    A group that goes on in the next piece keeps only its first one, so memory doesn't grow with a group."""

    def __init__(self, inside):
        self.inside, self.open, self.found = inside, np.zeros(0, np.int32), []

    def seen(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        pos, new = np.concatenate([self.open, pos]), np.concatenate([np.ones(len(self.open), bool), lcp < LENGTH])
        head = np.flatnonzero(new) if len(self.open) or new[0] else np.concatenate([[0], np.flatnonzero(new)])
        least = np.minimum.reduceat(pos, head)
        again = pos[pos != np.repeat(least, np.diff(np.append(head, len(pos))))]
        self.found.append(again[self.inside(again)])
        self.open = least[-1:]


def _compare(folder: str):
    """One shard: suffix-sorts its segments; of the strings that share 100 bytes all but the first are repeats."""

    def run(table: pa.Table) -> pa.Table:
        at, doc = table.column("at").to_numpy(), table.column("doc_id").to_numpy()
        order = np.lexsort((at, doc))  # places in the text are in order of places in the corpus
        order = order[_first_of_runs(doc[order], at[order])]
        at, doc = at[order], doc[order]
        parts = table.column("bytes").to_pylist()
        parts = [parts[i] for i in order.tolist()]
        sizes, begin = at & 127, np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
        # UTF-8 has no byte above 244: bytes are moved up by 2, gaps become 1, and one 0 ends the text
        text = np.frombuffer(b"\xff".join([*parts, b""]) + b"\xfe", np.uint8) + np.uint8(2)
        del parts, table

        def inside(pos: np.ndarray) -> np.ndarray:
            owner = np.searchsorted(begin, pos, side="right") - 1
            return pos - begin[owner] < sizes[owner]

        repeats = _Repeats(inside)
        visit_suffixes(text, repeats.seen, LENGTH, folder)
        pos = np.sort(np.concatenate(repeats.found))
        owner = np.searchsorted(begin, pos, side="right") - 1
        d, s = doc[owner], (at[owner] >> 7) + pos - begin[owner]
        head = np.flatnonzero(_first_of_runs(d) | np.concatenate([[True], s[1:] != s[:-1] + 1])[: len(s)]) if len(s) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([head, [len(s)]]))
        return pa.table({"doc_id": d[head].astype(np.int64), "first": s[head].astype(np.int64), "n": n.astype(np.int64)})

    return run


def _windows(batches):
    """Each string of the segments of very common anchors."""
    for batch in batches:
        for d, at, raw in zip(batch.column("doc_id").to_pylist(), batch.column("at").to_pylist(), batch.column("bytes").to_pylist()):
            n = at & 127
            strings = pa.array([raw[i : i + LENGTH] for i in range(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([strings, pa.array(np.full(n, d, np.int64)), pa.array((at >> 7) + np.arange(n))], ["string", "doc_id", "first"])


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte runs covered by strings whose starts are ``(first, number)``."""
    out: list[list[int]] = []
    for s, n in sorted(spans):
        e = s + n - 1 + LENGTH
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _strip(batches):
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [])
        for raw, cuts in zip(utf8(batch.column("text")), batch.column("cuts").to_pylist()):
            raw = raw or b""
            runs = covered([(c["first"], c["n"]) for c in cuts or []])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            rows[0].append(len(raw))
            rows[1].append(sum(b - a for a, b in runs))
            rows[2].append(len(runs))
            rows[3].append(kept.hexdigest())
            rows[4].append([{"start": a, "end": b} for a, b in runs])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(r, k) for r, k in zip(rows, kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs"])


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, runs array<struct<start, end>>``.

    A byte goes if a 100-byte string of its document's UTF-8 bytes covers it that also starts earlier: in a document of
    smaller id, or before in the same one. Strings are judged on the input and never cross documents.

    1. Every string is assigned to the gram of least hash in it, so equal strings meet; about 3 % of positions are anchors. A
       string of an anchor that is nowhere else has no copy.
    2. Of wholly equal segments around an anchor (by a 128-bit name) all but the first are repeats: partial in each batch,
       then per bucket of anchors.
    3. Anchors whose segments differ, the edges of repeats, go to shards that are suffix-sorted on disk by recursive induction
       (``induced_sort``); strings sharing 100 bytes are repeats of the first. The strings of an anchor that would fill a
       shard alone (MANY segments) are dealt to many tasks and compared there by their bytes: the result is the same.

    Null and empty texts, and those below 100 bytes, lose nothing. Rows of null ids neither lose nor remove. Ids must be
    integers. Rows that repeat an id and a text are one document: its strings don't repeat themselves, and each row shows its
    result. Of rows that share an id but not the text, the text of least hash is the document; the others neither lose nor
    remove. Other columns are not read.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = docs.where("doc_id is not null and text is not null")
    none = docs.where("doc_id is null or text is null")
    mixed = tables.keep(own.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi")).where("lo < hi"))
    if not mixed.isEmpty():
        judged = own.join(mixed.select("doc_id", "lo").hint("merge"), "doc_id", "left").withColumn("one", F.coalesce(F.xxhash64("text") == F.col("lo"), F.lit(True)))
        own, none = judged.where("one").select("doc_id", "text"), none.unionByName(judged.where("not one").select("doc_id", "text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(8, total // BUCKET_BYTES + 1))
    sent = own.where(F.octet_length("text") >= LENGTH).mapInArrow(_send(buckets), "bucket int, known boolean, blob binary")
    found = tables.keep(sent.groupBy("bucket").applyInArrow(_resolve, "doc_id long, at long, anchor long, kind byte"))
    todo = found.where("kind > 0").groupBy("doc_id").agg(F.collect_list(F.struct("at", "anchor", "kind")).alias("todo"))
    cut = own.join(todo.hint("merge"), "doc_id").select("doc_id", "text", "todo").mapInArrow(_cut_out, "doc_id long, at long, anchor long, kind byte, bytes binary")
    cut = tables.keep(cut)
    left = cut.where("kind = 1").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("anchor"), F.lit(int(left // SHARD_BYTES + 1))).alias("shard")
    spill = f"{shared_dir(spark).rstrip('/')}/table-spill-{uuid.uuid4().hex}"
    repeats = cut.where("kind = 1").select(shard, "doc_id", "at", "bytes").groupBy("shard").applyInArrow(_compare(spill), "doc_id long, first long, n long")
    strings = cut.where("kind = 2").mapInArrow(_windows, "string binary, doc_id long, first long")
    best = strings.groupBy("string").agg(F.min(F.struct("doc_id", "first")).alias("b"), F.count("*").alias("c")).where("c > 1").select("string", "b")
    common = strings.join(best.hint("merge"), "string").where("not (doc_id = b.doc_id and first = b.first)").select("doc_id", "first", F.lit(1).cast("long").alias("n"))
    known = found.where("kind = 0").select("doc_id", F.expr("shiftright(at, 7)").alias("first"), F.expr("at & 127").alias("n"))
    cuts = tables.keep(known.unionByName(repeats).unionByName(common).groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("cuts")))
    joined = own.join(cuts.hint("merge"), "doc_id", "left").select("doc_id", "text", "cuts")
    none = none.select("doc_id", "text", F.lit(None).cast("array<struct<first:bigint,n:bigint>>").alias("cuts"))
    out = joined.unionByName(none).mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, runs array<struct<start:bigint,end:bigint>>")
    return tables.done(out, spill)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
