"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.session import Tables

#: Slots of one stretch of the schedule, stretches (or groups of them) joined in one step, and hash ranges a group is numbered in.
STRETCH, FAN, RANGES = 128, 64, 4096
#: Units that a weight of 1 is cut into: target weights are whole numbers of them, and the schedule keeps to those exactly.
UNITS = 1_000_000

_JOB = "struct<d:bigint,g:int,r:bigint,k:bigint>"  # deadline, group number, release, block: in the order of the schedule's choice
# earliest deadline first over one stretch: in each slot the first job in order that is released
_EDF = f"""aggregate(sequence(id * {STRETCH}, (id + 1) * {STRETCH} - 1),
 named_struct('left', jobs, 'out', cast(array() as array<struct<t:bigint,j:{_JOB}>>)),
 (st, t) -> transform(array(try_element_at(filter(st.left, j -> j.r <= t), 1)),
  p -> if(p is null, st, named_struct('left', array_remove(st.left, p), 'out', concat(st.out, array(named_struct('t', t, 'j', p))))))[0])"""
# what comes in too many for a stretch displaces, of all that its end leaves a choice of, the latest deadlines
_POOL = "array_sort(concat(filter({c}, j -> j.d > kid.z), kid.x))"
_OVER = "greatest(0, size({c}) - kid.free)"
_KEPT = "slice({pool}, 1, cast(size({pool}) - {over} as int))"
_BACK = "array_sort(concat(kid.v, slice({pool}, cast(size({pool}) - {over} + 1 as int), cast({over} as int))))"


def _step(c: str) -> dict[str, str]:
    pool, over = _POOL.format(c=c), _OVER.format(c=c)
    return {"kept": _KEPT.format(pool=pool, over=over), "back": _BACK.format(pool=pool, over=over)}


def _joined() -> str:
    """Several stretches as one: free slots, served jobs whose deadline is after its end (x), jobs left over (v)."""
    s = _step("st.v")
    zero = f"named_struct('free', 0L, 'x', cast(array() as array<{_JOB}>), 'v', cast(array() as array<{_JOB}>))"
    step = f"named_struct('free', st.free + greatest(0, kid.free - size(st.v)), 'x', array_sort(concat(filter(st.x, j -> j.d > kid.z), {s['kept']})), 'v', {s['back']})"
    return f"aggregate(kids, {zero}, (st, kid) -> {step})"


def _handed_on() -> str:
    """What each of several stretches gets from the one before, given what the first gets (c)."""
    zero = f"named_struct('c', c, 'out', cast(array() as array<struct<id:bigint,c:array<{_JOB}>>>))"
    step = f"named_struct('c', {_step('st.c')['back']}, 'out', concat(st.out, array(named_struct('id', kid.id, 'c', st.c))))"
    return f"aggregate(kids, {zero}, (st, kid) -> {step}).out"


def target_weights(docs: DataFrame, group: str = "source", weights: dict | None = None) -> DataFrame:
    """``(grp, n, a)``: rows and target weight of each group, a whole number of 1/UNITS. Weights are given by name (a group
    without one, or with less than a unit, has one unit), or else the square root of a group's rows."""
    n = docs.groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("n"))
    if weights is None:
        w = F.sqrt("n")
    else:
        table = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (str(k), float(v))]) if weights else F.lit(None).cast("map<string,double>")
        w = F.coalesce(F.try_element_at(table, F.col("grp").cast("string")), F.lit(0.0))
    return n.select("grp", "n", F.greatest(F.lit(1).cast("long"), F.round(w * UNITS).cast("long")).alias("a"))


def schedule(blocks: DataFrame, groups: DataFrame, tables: Tables) -> DataFrame:
    """``(g, k, slot)`` of every block ``blocks(g, k)`` of groups ``groups(g, a)``.

    Block k of a group of weight a of A in all is released at floor(k A / a) and due at ceil((k + 1) A / a). Each slot takes
    the released block of the earliest deadline. Then every block keeps its deadline, and after any number of slots every
    group is less than a block off its target.

    The result is that of one pass over all slots, but stretches of slots are scheduled apart: first with their own releases
    only. What a stretch gets from the one before can only push out its latest deadlines, so a few jobs at its end say what it
    hands on, for a stretch as for many in a row. These are joined in a tree, FAN at a time, then handed down, and each
    stretch is scheduled again with what it gets. No task sees more than FAN stretches, nor more than two jobs a group in each.
    """
    groups = tables.keep(groups)
    sums = groups.agg(F.sum("a").alias("total"), F.count("*").alias("n")).first()
    total, ahead = sums.total or 1, -(-2 * sums.n // STRETCH) + 1
    wide = lambda k: f"cast({k} as decimal(20, 0)) * cast({total} as decimal(18, 0))"
    jobs = blocks.join(groups.hint("merge"), "g").select("g", "k", F.expr(f"({wide('k')}) div a").alias("r"), F.expr(f"({wide('k + 1')} + a - 1) div a").alias("d"))
    job = F.struct("d", F.col("g").cast("int").alias("g"), "r", "k")
    own = jobs.groupBy(F.expr(f"r div {STRETCH}").alias("id")).agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    own = tables.keep(own)
    # jobs can be handed on so far at most
    ids = own.select(F.explode(F.sequence("id", F.col("id") + ahead)).alias("id")).distinct()
    none = F.expr(f"cast(array() as array<{_JOB}>)")
    alone = tables.keep(ids.join(own.hint("merge"), "id", "left").select("id", F.coalesce("jobs", none).alias("jobs")))
    end = F.expr(f"(id + 1) * {STRETCH}")
    run = alone.select("id", end.alias("z"), F.expr(_EDF).alias("e"))
    level = run.select("id", "z", F.expr(f"cast({STRETCH} - size(e.out) as bigint)").alias("free"), F.expr("array_sort(filter(transform(e.out, o -> o.j), j -> j.d > z))").alias("x"), F.expr("e.left").alias("v"))
    up = []
    while True:
        kids = tables.keep(level.groupBy(F.expr(f"id div {FAN}").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "z", "free", "x", "v"))).alias("kids")))
        up.append(kids)
        if kids.count() <= 1:
            break
        level = kids.select("id", F.expr("kids[size(kids) - 1].z").alias("z"), F.expr(_joined()).alias("s")).select("id", "z", "s.*")
    got = up[-1].select("id", none.alias("c"))
    for kids in reversed(up):
        handed = kids.join(got.hint("merge"), "id").select(F.explode(F.expr(_handed_on())).alias("h"))
        got = tables.keep(handed.select("h.id", "h.c"))
    full = alone.join(got.hint("merge"), "id").select("id", F.expr(f"array_sort(concat(jobs, slice(c, 1, {STRETCH})))").alias("jobs"))
    return full.select(F.explode(F.expr(f"{_EDF}.out")).alias("o")).select(F.expr("o.j.g").alias("g"), F.expr("o.j.k").alias("k"), F.expr("o.t").alias("slot"))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns. Types that Spark does not hash go in as JSON."""

    def plain(t) -> bool:
        if isinstance(t, T.ArrayType):
            return plain(t.elementType)
        if isinstance(t, T.StructType):
            return all(plain(f.dataType) for f in t)
        return not isinstance(t, (T.MapType, T.VariantType))

    cols = [F.col(f"`{f.name}`") if plain(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema]
    return F.xxhash64(*cols)


def mix(docs: DataFrame, group: str = "source", doc_id: str = "doc_id", weights: dict | None = None, block_rows: int = 16, seed: str = "mix") -> DataFrame:
    """All rows of ``docs`` with two more columns: ``slot``, the place of the row's block in the interleaved order, and
    ``slot_row``, its place in the block. Reading by (slot, slot_row) meets every group in proportion to its weight: as long
    as all groups last, no group is a whole block ahead of or behind its target after any number of slots. A group that ends
    leaves its slots empty, and the others keep their proportions. No row is dropped or repeated.

    Rows of a group are put in the order of a hash of their id and cut into blocks of ``block_rows``. They are numbered in
    RANGES hash ranges a group with a running sum of range counts, so no task gets a whole group; see :func:`schedule` for the
    blocks. A null group is a group of its own; rows that repeat an id are told apart by a hash of all columns; equal rows are
    interchangeable. An empty table gives an empty one. Earlier columns named slot or slot_row are replaced; other columns may
    have any name but those beginning with __mix.
    """
    docs = docs.drop("slot", "slot_row")
    tables = Tables(docs.sparkSession)
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    rows = docs.withColumn("__mix_h", h).withColumn("__mix_b", F.substring("__mix_h", 1, 3)).withColumn("__mix_grp", F.col(group))
    ranges = tables.keep(rows.groupBy("__mix_grp", "__mix_b").agg(F.count("*").alias("n")))
    weighed = target_weights(docs, group, weights)
    order = Window.orderBy(F.coalesce(F.col("grp").cast("string"), F.lit("")), F.col("grp").isNull())  # a row a group
    groups = tables.keep(weighed.select("grp", "a", F.row_number().over(order).alias("g")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__mix_grp").orderBy("__mix_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = ranges.select("__mix_grp", "__mix_b", "n", before.alias("before")).join(groups.hint("merge"), F.col("__mix_grp").eqNullSafe(F.col("grp")))
    place = tables.keep(place.select(F.col("grp").alias("__mix_grp2"), F.col("__mix_b").alias("__mix_b2"), F.col("n").alias("__mix_n"), F.col("before").alias("__mix_before"), F.col("g").alias("__mix_g")))
    first, last = f"(__mix_before + {block_rows - 1}) div {block_rows}", f"(__mix_before + __mix_n - 1) div {block_rows}"
    blocks = place.where(f"{first} <= {last}").select(F.col("__mix_g").alias("g"), F.explode(F.expr(f"sequence({first}, {last})")).alias("k"))
    slots = schedule(blocks, groups.select("g", "a"), tables)
    slots = tables.done(slots.select(F.col("g").alias("__mix_sg"), F.col("k").alias("__mix_sk"), F.col("slot").alias("__mix_slot")), keep=[place])
    inside = F.row_number().over(Window.partitionBy("__mix_grp", "__mix_b").orderBy("__mix_h", row_hash(docs)))
    rows = rows.withColumn("__mix_r", inside - 1)
    here = F.col("__mix_grp").eqNullSafe(F.col("__mix_grp2")) & (F.col("__mix_b") == F.col("__mix_b2"))
    rows = rows.join(place.hint("merge"), here, "left").withColumn("__mix_r", F.col("__mix_r") + F.col("__mix_before"))
    rows = rows.withColumn("__mix_k", F.expr(f"__mix_r div {block_rows}"))
    rows = rows.join(slots.hint("merge"), (F.col("__mix_g") == F.col("__mix_sg")) & (F.col("__mix_k") == F.col("__mix_sk")), "left")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__mix_slot").alias("slot"), F.expr(f"int(__mix_r % {block_rows})").alias("slot_row"))
