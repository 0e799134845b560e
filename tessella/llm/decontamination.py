"""Benchmark decontamination with an Aho-Corasick automaton over word windows."""

from __future__ import annotations

import re
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import utf8
from tessella.session import materialize

#: ASCII bytes other than digits and lower-case letters separate words; bytes of other characters belong to words.
SEPARATED = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

RESULT = "n_words bigint, hit_words array<int>, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(SEPARATED).split() if text else []


def _automaton(items: list[tuple[str, bytes]], window: int):
    """One automaton over sequences of word numbers; a pattern holds its length and the items it comes from."""
    import ahocorasick

    vocabulary: dict[bytes, int] = {}
    patterns: dict[tuple[int, ...], set[int]] = {}
    for at, (_, text) in enumerate(items):
        seq = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text))
        n = min(window, len(seq))
        for i in range(len(seq) - n + 1) if n else ():
            patterns.setdefault(seq[i : i + n], set()).add(at)
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for seq, who in patterns.items():
        machine.add_word(seq, (len(seq), tuple(who)))
    if patterns:
        machine.make_automaton()
    return vocabulary, machine if patterns else None


def _scan(items: list[tuple[str, bytes]], window: int, text_col: str):
    def run(batches):
        vocabulary, machine = _automaton(items, window)
        get = vocabulary.get
        for batch in batches:
            table = {k: [] for k in ("n_words", "hit_words", "items", "spans")}
            before_hits, before_items = batch.column("hit_words").to_pylist(), batch.column("items").to_pylist()
            for row, raw in enumerate(utf8(batch.column(text_col))):
                words = words_of(raw)
                hit, found = set(before_hits[row]), set(before_items[row])
                if machine is not None and words:
                    for end, (n, who) in machine.iter(tuple(map(get, words, repeat(0)))):
                        hit.update(range(end - n + 1, end + 1))
                        found.update(items[i][0] for i in who)
                hits = sorted(hit)
                table["n_words"].append(len(words))
                table["hit_words"].append(hits)
                table["items"].append(sorted(found))
                table["spans"].append(_spans(raw, hits) if hits else [])
            rest = [(n, batch.column(n)) for n in batch.schema.names if n not in table]
            types = {"n_words": pa.int64(), "hit_words": pa.list_(pa.int32()), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}
            made = [(n, pa.array(v, types[n])) for n, v in table.items()]
            yield pa.RecordBatch.from_arrays([a for _, a in rest + made], [n for n, _ in rest + made])

    return run


def _spans(raw: bytes, hits: list[int]) -> list[dict]:
    """Runs of hit words as code point offsets in the original text, end exclusive."""
    at = [m.span() for m in WORD.finditer(raw.decode("utf-8", "replace"))]
    out = []
    for i, w in enumerate(hits):
        if i and hits[i - 1] == w - 1:
            out[-1]["end"] = at[w][1]
        else:
            out.append({"start": at[w][0], "end": at[w][1]})
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shard_bytes: int = 4_000_000,
) -> DataFrame:
    """One row per document row: its id, text and ``n_words, hit_words, items, spans``.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. ``hit_words`` are the indexes of
    words inside any occurrence of a window, ``items`` the ids (as strings, sorted) of the items that occur, ``spans`` the
    hit runs as code point offsets. The automaton goes to every task, so its source is bounded: items are dealt to shards
    of at most ``shard_bytes`` of text (or one longer item) and each shard is scanned in a pass of its own.

    Null or empty texts have no words; null or empty items have no window; items with null ids take no part; repeated
    rows give repeated rows; repeated items count once by id. Other columns of either table are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null and t <> ''")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    none = F.array().cast("array<int>")
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"), none.alias("hit_words"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    )
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, text string, {RESULT}"
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == shard)
        own = sorted((r.i, r.t.encode("utf-8")) for r in part.toLocalIterator())  # at most about shard_bytes
        kept = kept.mapInArrow(_scan(own, window, "text"), schema)
        if shard < shards - 1:
            kept = materialize(kept)
    return kept


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of :func:`decontaminate`'s result."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_bytes: int = 4_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs; see :func:`decontaminate`."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null and t <> ''")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == shard)
        own = sorted((r.i, r.t.encode("utf-8")) for r in part.toLocalIterator())
        docs = docs.mapInArrow(_clean(own, window), docs.schema)
        if shard < shards - 1:
            docs = materialize(docs)
    return docs


def _clean(items: list[tuple[str, bytes]], window: int):
    def run(batches):
        vocabulary, machine = _automaton(items, window)
        get = vocabulary.get
        for batch in batches:
            texts = utf8(batch.column("text"))
            yield batch.filter(pa.array([machine is None or not t or next(machine.iter(tuple(map(get, words, repeat(0)))), None) is None if (words := words_of(t)) else True for t in texts], pa.bool_()))

    return run
