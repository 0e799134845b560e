"""Personal data: patterns propose, checksums confirm, context words adjust. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns. Possessive repeats and the look-behinds match what the plain patterns match, leftmost and longest, and
# keep long runs linear: a match can only start where a run starts or where the match before ended (\G).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"(?:token|secret|password|passwd|api_key|apikey)[\x22']?[ ]{0,2}[=:][ ]{0,2}[\x22']?[A-Za-z0-9_/+.-]{16,}",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+", "ip": "."}
#: Words near a span that make it likelier, looked for within REACH characters before it.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment|account",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social|security|tax",
    "secret": "token|secret|password|key",
}
REACH = 40
#: Score of a proposal, what a passed checksum or range adds, what a context word adds, and the least score reported.
BASE, CONFIRMED, NEARBY, LEAST = 0.4, 0.4, 0.2, 0.5
BASE_KINDS = ("email", "ip", "card", "phone")

_DIGITS = "regexp_replace(m.value, '[^0-9]', '')"
_ALONE = "not m.before rlike '[A-Za-z0-9]' and not m.after rlike '[A-Za-z0-9]'"
#: (kept at all, confirmed) for a match m(value, before, after).
CHECKS = {
    "email": ("true", "true"),
    "ip": ("forall(split(m.value, '[.]'), p -> regexp_replace(p, '^0+', '') rlike '^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')", "true"),
    "card": (
        f"length({_DIGITS}) between 14 and 19 and aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + "
        f"case when (length({_DIGITS}) - i) % 2 = 0 then int(substring({_DIGITS}, i, 1)) "
        f"else element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), int(substring({_DIGITS}, i, 1)) + 1) end) % 10 = 0",
        "true",
    ),
    "phone": (f"length({_DIGITS}) between 10 and 15", "true"),
    "iban": (
        f"{_ALONE} and aggregate(split(concat(substring(m.value, 5), left(m.value, 4)), ''), 0, (r, c) -> case when c = '' then r "
        "when c between '0' and '9' then (r * 10 + int(c)) % 97 else (r * 100 + ascii(c) - 55) % 97 end) = 1",
        "true",
    ),
    "ssn": (f"{_ALONE} and not m.value rlike '^(?:000|666|9)' and not m.value rlike '-00-' and not m.value rlike '0000$'", "false"),
    "secret": ("true", "false"),
}


def _proposals(text: Column, kind: str) -> tuple[Column, Column]:
    """All matches, and the pieces of text between them: their lengths give the offsets in one pass."""
    pattern = PATTERNS[kind]
    may = text.isNotNull() if kind not in NEEDS else F.contains(text, F.lit(NEEDS[kind]))
    return F.when(may, F.regexp_extract_all(text, F.lit(pattern), 0)), F.when(may, F.split(text, pattern, -1))


def _located(kind: str) -> str:
    """SQL for the array of (start, end, value, before, after) of the matches, by a running sum of lengths."""
    m, p = f"m_{kind}", f"p_{kind}"
    kind_of = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    step = (
        f"(a, i) -> named_struct('at', a.at + length({p}[i]) + length({m}[i]), 'out', concat(a.out, array(named_struct("
        f"'start', a.at + length({p}[i]), 'end', a.at + length({p}[i]) + length({m}[i]), 'value', {m}[i], 'before', right({p}[i], 1), 'after', left({p}[i + 1], 1)))))"
    )
    return (
        f"case when coalesce(size({m}), 0) > 0 then aggregate(sequence(0, size({m}) - 1), named_struct('at', 0, 'out', cast(array() as {kind_of})), {step}, a -> a.out) "
        f"else cast(array() as {kind_of}) end"
    )


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text, spans array<struct<start, rank, end, kind, value, score>>`` in order of
    start and then kind; offsets are code points, end exclusive.

    Matches of one kind are leftmost and don't overlap; one that fails its check is dropped and not retried. The base kinds
    (email, ip, card, phone) always stay. The others need a score of at least LEAST: IBANs pass mod-97, social security
    numbers pass their number ranges and need a context word, secrets carry their own label. Null and empty texts have no
    spans; repeated rows give repeated rows; other columns are not read.
    """
    df = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    pairs = {k: _proposals(F.col("text"), k) for k in PATTERNS}
    df = df.select("*", *[c.alias(f"{n}_{k}") for k, both in pairs.items() for n, c in zip("mp", both)])
    df = df.select("doc_id", "text", *[F.expr(_located(k)).alias(f"l_{k}") for k in PATTERNS])
    spans = []
    for rank, kind in enumerate(PATTERNS):
        kept, confirmed = CHECKS[kind]
        near = f"lower(substring(text, greatest(1, m.start - {REACH - 1}), least(m.start, {REACH}))) rlike '{CONTEXT[kind]}'"
        start = "m.end - length(regexp_extract(m.value, '[A-Za-z0-9_/+.-]{16,}$', 0))" if kind == "secret" else "m.start"
        if kind == "secret":
            near = "true"
        least = 0 if kind in BASE_KINDS else LEAST
        spans.append(
            F.expr(
                f"filter(transform(filter(l_{kind}, m -> {kept}), m -> named_struct('start', {start}, 'rank', {rank}, 'end', m.end, 'kind', '{kind}', 'value', m.value, "
                f"'score', double({BASE}) + case when {confirmed} then {CONFIRMED} else 0 end + case when {near} then {NEARBY} else 0 end)), s -> s.score >= {least})"
            )
        )
    return df.select("doc_id", "text", F.array_sort(F.concat(*spans)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of :func:`find_pii`'s result."""
    line = "array_join(transform({0}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = f"filter(spans, s -> s.rank < {len(BASE_KINDS)})"
    return found.select(
        "doc_id",
        *[F.expr(f"bigint(size(filter(spans, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.expr(line.format(base)), 256).alias("base_sha256"),
        F.expr(line.format("spans")).alias("spans"),
    )
