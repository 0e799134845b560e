"""Main text of web pages: a suffix array over each host's token streams judges every block, and a check by markup follows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.html_blocks import ARTICLE, HINTED, OPEN, blocks
from tessella.llm.words import MULT, mix, word_hashes
from tessella.session import Tables

#: Tokens of a repeated run at least, tokens of one shard of a host, and characters of html that count as a token.
RUN, SHARD_TOKENS, CHARS = 8, 1_000_000, 8


def suffix_groups(tokens: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of an integer stream to a depth of ``run`` (a power of two), by prefix doubling, and each suffix's group:
    suffixes of one group share their first ``run`` tokens."""
    _, rank = np.unique(tokens, return_inverse=True)
    width, order = 1, np.argsort(rank, kind="stable")
    while width < run:
        after = np.concatenate([rank[width:], np.full(min(width, len(rank)), -1)])[: len(rank)]
        pair = rank * (len(rank) + 1) + after + 1  # one number sorts faster than two
        order = np.argsort(pair)
        rank = np.empty(len(rank), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(pair[order]) != 0])) if len(order) else 0
        width *= 2
    return order, rank


def _tokens(found: list[tuple[int, str]], article: bool) -> np.ndarray:
    """The token stream of a page's article blocks, or of all its others."""
    return word_hashes([w.encode("utf-8", "surrogatepass") for z, t in found if (z == ARTICLE) == article for w in t.split(" ")]).view(np.int64)


def _joined(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Streams as one, with a token of its own after each: tokens, each place's stream, where each stream begins, and at which
    places a run of RUN tokens begins that stays inside its stream."""
    sizes = np.array([len(s) for s in streams], np.int64)
    stream = np.concatenate([np.append(s, g) for s, g in zip(streams, np.arange(len(streams), dtype=np.int64))])
    owner, begin = np.repeat(np.arange(len(streams)), sizes + 1), np.cumsum(sizes + 1) - sizes - 1
    return stream, owner, begin, np.arange(len(stream)) - begin[owner] + RUN <= sizes[owner]


def _grams(stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for i in range(RUN):
        h = mix(h * MULT + stream[at + i].view(np.uint64))
    return h.view(np.int64)


def _outside(batches):
    for batch in batches:
        tokens = [_tokens(blocks(h), False) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "shard", "hh")), pa.array(tokens, pa.list_(pa.int64()))], ["host", "shard", "hh", "tokens"])


def _runs(table: pa.Table) -> pa.Table:
    """One shard of a host: its pages' streams outside articles in one suffix array, and the runs with the least and the largest
    page that each is on."""
    pages, first = np.unique(table.column("hh").to_numpy(), return_index=True)
    tokens = table.column("tokens")
    stream, owner, _, fits = _joined([np.asarray(tokens[int(i)].as_py(), np.int64) for i in first])
    _, group = suffix_groups(stream)
    at = np.flatnonzero(fits)
    _, one, of = np.unique(group[at], return_index=True, return_inverse=True)
    least, most = np.full(len(one), len(pages)), np.full(len(one), -1)
    np.minimum.at(least, of, owner[at])
    np.maximum.at(most, of, owner[at])
    host = pa.array([table.column("host")[0].as_py()] * len(one), pa.string())
    return pa.table({"host": host, "gram": _grams(stream, at[one]), "a": pages[least], "b": pages[most]})


def _dropped(cover: np.ndarray) -> np.ndarray:
    """Words of a block that the array drops: repeated runs, but not what a run from the next block only touches."""
    gone = np.zeros(len(cover), bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a >= RUN or b - a == len(cover):
            gone[a:b] = True
    return gone


def _checked(found: list[tuple[int, str]], outside: np.ndarray, inside: np.ndarray) -> tuple[str, int, int]:
    """A page's text: what the array keeps of each block, after the check by markup; words of an article that the check puts back,
    and words that it strikes though no repeated run has them."""
    own = any(z in (ARTICLE, HINTED) for z, _ in found)
    kept, back, struck, places = [], 0, 0, {True: 0, False: 0}
    for zone, text in found:
        article, cover = zone == ARTICLE, inside if zone == ARTICLE else outside
        at = places[article]
        n = text.count(" ") + 1
        places[article] = at + n
        gone = _dropped(cover[at : at + n]) if cover[at : at + n].any() else None
        left = n if gone is None else n - int(gone.sum())
        if article:
            back += n - left
            kept.append(text)
        elif zone == HINTED or (zone == OPEN and not own):
            if left:
                kept.append(text if gone is None else " ".join(w for w, g in zip(text.split(" "), gone) if not g))
        else:
            struck += left
    return "\n\n".join(kept), back, struck


def _judge(pages: pa.Table, across: pa.Table) -> pa.Table:
    """One shard of a host: all text of its pages, articles too, in one suffix array. A run is boilerplate if two different pages
    have it outside their articles, here or in two shards (``across``)."""
    number: dict = {}
    rows = [number.setdefault(h, len(number)) for h in pages.column("html").to_pylist()]
    out = []
    if rows:
        found = [blocks(h) for h in number]
        stream, owner, begin, fits = _joined([_tokens(f, article) for f in found for article in (False, True)])
        _, group = suffix_groups(stream)
        least, most = np.full(len(stream), len(stream)), np.full(len(stream), -1)
        outside = fits & (owner % 2 == 0)
        np.minimum.at(least, group[outside], owner[outside])
        np.maximum.at(most, group[outside], owner[outside])
        at = np.flatnonzero(fits)
        hit = (most > least)[group[at]]
        if across.num_rows:
            hit |= np.isin(_grams(stream, at), across.column("gram").to_numpy())
        edges = np.zeros(len(stream) + RUN, np.int64)
        edges[at[hit]] += 1
        edges[at[hit] + RUN] -= 1
        covers = np.split(np.cumsum(edges[: len(stream)]) > 0, begin[1:])
        texts = [_checked(f, covers[2 * i], covers[2 * i + 1]) for i, f in enumerate(found)]
        out = [texts[i] for i in rows]
    named = {"text": pa.string(), "n_restored": pa.int64(), "n_struck": pa.int64()}
    return pa.table({"page_id": pages.column("page_id"), "url": pages.column("url"), **{c: pa.array([o[i] for o in out], t) for i, (c, t) in enumerate(named.items())}})


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars, n_restored, n_struck``.

    Every block of every page goes into its host's suffix array. Runs of RUN tokens or more that two different pages share
    outside their articles are boilerplate, wherever they stand; a block loses parts of RUN tokens at least, or all. A check by
    markup (zones of ``html_blocks``) follows: what stands in an article is main text as it is, however often it occurs, so
    words that the array dropped are put back (``n_restored``); what an element clearly sets apart goes, and so does all outside
    an article if the page has one (``n_struck``: such words that no run covers). So the array's word is the last one on pages without an article
    and on blocks in an article whose class only hints that they are none of it. Copies of one page's html count as one page.

    A host's pages are dealt to shards of about SHARD_TOKENS tokens, by the length of their html. Of a host with several, runs
    outside articles are compared across shards by their hashes, and those on two pages are given to each of its shards;
    so no task needs a whole host, only its boilerplate. Null or empty html gives an empty text; a null url or one without a
    host makes a host of its own; repeated rows give repeated rows; other columns are not read.
    """
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    base = base.select("page_id", "url", host.alias("host"), F.xxhash64("html").alias("hh"), "html")
    sizes = base.groupBy("host").agg(F.sum(F.length("html")).alias("n")).select("host", F.expr(f"int(n div {SHARD_TOKENS * CHARS} + 1)").alias("shards"))
    # a row for each host of several shards, so fewer than there are shards
    several = F.broadcast(Tables(pages.sparkSession).keep(sizes.where("shards > 1")))
    deal = F.pmod(F.hash("hh", "page_id", "url", F.spark_partition_id()), F.coalesce("shards", F.lit(1)))
    outside = base.join(several, "host").select("host", deal.alias("shard"), "hh", "html").mapInArrow(_outside, "host string, shard int, hh long, tokens array<long>")
    runs = outside.where(f"size(tokens) >= {RUN}").groupBy("host", "shard").applyInArrow(_runs, "host string, gram long, a long, b long")
    across = runs.groupBy("host", "gram").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a < b").select("host", "gram")
    across = across.join(several, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "gram")
    dealt = base.join(several, "host", "left").select("host", deal.alias("shard"), "page_id", "url", "html")
    shape = f"page_id {pages.schema[page_id].dataType.simpleString()}, url string, text string, n_restored long, n_struck long"
    text = dealt.groupBy("host", "shard").cogroup(across.groupBy("host", "shard")).applyInArrow(_judge, shape)
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_restored", "n_struck")
