"""Running values over an ordered table without a single-task window.

Budgets, shards, packs and series all depend on arrival order. A window ordered
over a whole table (or over a source that holds a third of it) would run in one
task. Here the order key is cut into *cells* of a bounded number of rows:

1. a hash-chosen sample of keys gives the cell borders. Spark sorts them, so a key may be of any sortable type and NULL.
   Up to ``FAN`` borders are a literal in the plan. More of them are a stored tree of two levels: the literal cuts the key into ranges, and each
   range's borders are one row of a table, made from that range's sample alone. The driver and every task
   see at most ``FAN`` borders and their sample, however many cells there are;
2. each row finds its cell by bisection, in the literal and then in its range's array, so the cell is a
   pure function of the key and a recomputed task gives the same answer;
3. cell totals are aggregated map-side first and summed up over the cells, in two steps when there are many;
4. a window per (group, cell) gives the local running value, the offset of the
   cell is joined on the same key and needs no further shuffle of the rows.

The order key must be unique within a group: a row whose key is that of the row before ends the job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.workspace import freeze

ROWS_PER_CELL = 1 << 20
#: Borders in one array, and ranges of the tree: it holds their square.
FAN = 1 << 10
#: Bytes of a tree that is sent to all tasks; a larger one is joined.
MOST_BROADCAST = 1 << 25
#: Groups whose cutoffs become filters.
MOST_CUTOFFS = 64
_SAMPLES_PER_CELL = 32
_HASH_SPAN = 1 << 31
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
CELL = "_cell"
_RANGE, _GROUP = "_range", "_group"


def _struct_of(names: Sequence[str]) -> Column:
    return F.struct(*[F.col(name).alias(f"k{i}") for i, name in enumerate(names)])


def _bisect(size: int, goes_before: Callable[[Column], Column]) -> Column:
    steps = [1 << p for p in reversed(range(max(1, size.bit_length())))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(goes_before(at + step - 1), at + step).otherwise(at),
    )


def bisect_right(bounds: Column, key: Column, size: int) -> Column:
    """Number of entries of the sorted array ``bounds`` that are <= ``key``.
    ``size`` is an upper limit for the length of the array."""
    return _bisect(size, lambda i: F.get(bounds, i) <= key)


def bisect_left(bounds: Column, key: Column, size: int) -> Column:
    """Number of entries of the sorted array ``bounds`` that are < ``key``."""
    return _bisect(size, lambda i: F.get(bounds, i) < key)


def with_salts(df: DataFrame, salts: int, name: str = "_salt") -> DataFrame:
    """Every row once for each salt: the small side of a join whose large side has
    hot keys, spread over the salts by another column."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def whole_div(value: Column, by: Column | int) -> Column:
    """Integer division of whole numbers, exact at any size."""
    return F.call_function("div", value, by if isinstance(by, Column) else F.lit(by))


def add_cells(df: DataFrame, order_by: Sequence[str], rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Add the column ``_cell``: consecutive ranges of the order key with about
    ``rows_per_cell`` rows each. Only key columns are read for the borders. Cells
    rise with the key; some numbers may be left out."""
    return _with_cells(df, order_by, rows_per_cell)[0]


def _spaced(sample: Column, cells: Column) -> Column:
    """Fewer than ``cells`` evenly spaced entries of a sorted array."""
    part = lambda i: whole_div(i.cast("bigint") * cells, F.size(sample))
    return F.filter(sample, lambda _, i: part(i) != part(i - 1))


def _chosen(order_by: Sequence[str], rate: float) -> Column:
    """A share of the keys by their hash."""
    return F.pmod(F.xxhash64(*order_by), F.lit(_HASH_SPAN)) < int(min(1.0, rate) * _HASH_SPAN)


def _literal(keys: DataFrame, order_by: Sequence[str], most: int) -> tuple[Column, int]:
    """The sorted keys, or fewer than ``most`` evenly spaced ones, as an array literal with its size."""
    sample = F.col("sample")
    row = (keys.agg(F.array_sort(F.collect_set(_struct_of(order_by))).alias("sample"))
           .select((_spaced(sample, F.lit(most)) if most else sample).alias("keys")).select(F.to_json("keys", _EXACT).alias("text"), F.size("keys").alias("n")).first())
    types = {f.name: f.dataType.simpleString() for f in keys.select(*order_by).schema}
    fields = ",".join(f"k{i}:{types[name]}" for i, name in enumerate(order_by))
    return F.from_json(F.lit(row["text"]), f"array<struct<{fields}>>", _EXACT), max(0, row["n"])


def _in_tree(df: DataFrame, key: Column, tree: DataFrame, found: Callable[[Column], Column], size: int = FAN) -> DataFrame:
    """``df`` (with ``_range``) with the cell that ``found`` makes of the position in its range's array of at most ``size`` keys; the
    tree has one row per range: ``_range``, ``_keys`` and what ``found`` needs."""
    held = F.broadcast(tree) if (tree.agg(F.sum(F.octet_length(F.to_json("_keys")))).first()[0] or 0) <= MOST_BROADCAST else tree
    at = F.coalesce(bisect_right(F.col("_keys"), key, size), F.lit(0))
    extra = [c for c in tree.columns if c != _RANGE]
    return df.join(held, _RANGE, "left").withColumn(CELL, found(at)).drop(_RANGE, *extra)


def _with_cells(df: DataFrame, order_by: Sequence[str], rows_per_cell: int) -> tuple[DataFrame, int]:
    """The table with its cells, and an upper limit for their number."""
    keys = df.select(*order_by)
    total = keys.count()
    cells = min(-(-total // rows_per_cell), FAN * FAN)
    if cells <= 1:
        return df.withColumn(CELL, F.lit(0)), 1
    key = _struct_of(order_by)
    top = min(cells, FAN)
    sample = keys.where(_chosen(order_by, top * _SAMPLES_PER_CELL / total))
    bounds, n = _literal(sample, order_by, top)
    if not n:
        return df.withColumn(CELL, F.lit(0)), 1
    place = F.coalesce(bisect_right(bounds, key, n), F.lit(0))
    if cells <= FAN:
        return df.withColumn(CELL, place), n + 1
    finer = keys.where(_chosen(order_by, cells * _SAMPLES_PER_CELL / total)).select(place.alias(_RANGE), key.alias("key"))
    arrays = finer.groupBy(_RANGE).agg(F.array_sort(F.collect_set("key")).alias("sample"))
    share = cells / min(total, cells * _SAMPLES_PER_CELL)  # cells per key of the sample
    tree = freeze(arrays.select(_RANGE, _spaced(F.col("sample"), F.least(
        F.ceil(F.size("sample") * share), F.lit(FAN))).alias("_keys")), "borders")
    rows = df.withColumn(_RANGE, place)
    return _in_tree(rows, key, tree, lambda at: F.col(_RANGE) * FAN + at), (FAN + 1) * FAN


def cells_by_weight(df: DataFrame, order_by: Sequence[str], weight: str, limit: int, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Add ``_cell`` and ``_before``: the cell of a row is its running weight before it, divided by ``limit``, and ``_before`` is the
    running weight before the cell's first row. No weight may exceed ``limit``, so a cell weighs less than twice the limit.

    The running weight is settled on the key and the weight alone. Each cell's first key goes into the stored tree of borders,
    so that wide rows find their cell by bisection and are not shuffled."""
    key, n = _struct_of(order_by), F.col(weight).cast("bigint")
    narrow = running_totals(df.select(*order_by, n.alias("_w")), order_by, {"_stop": F.col("_w")}, rows_per_cell=rows_per_cell)
    start = F.col("_stop") - F.col("_w")
    first = narrow.groupBy(whole_div(start, limit).alias("_no")).agg(F.min(F.struct(key.alias("key"), start.alias("start"))).alias("f"))
    firsts = freeze(first.select("_no", "f.key", "f.start"), "borders")
    cells = firsts.count()
    if cells <= 1:
        return df.withColumns({CELL: F.lit(0).cast("bigint"), "_before": F.lit(0).cast("bigint")})
    per = max(FAN, -(-cells // FAN))
    coarse = firsts.where((F.col("_no") % per == 0) & (F.col("_no") > 0)).select(*[F.col(f"key.k{i}").alias(name) for i, name in enumerate(order_by)])
    bounds, size = _literal(coarse, order_by, 0)
    entries = F.array_sort(F.collect_list(F.struct("key", "_no", "start")))
    tree = freeze(firsts.groupBy(whole_div(F.col("_no"), per).cast("int").alias(_RANGE)).agg(entries.alias("_entries")).select(
        _RANGE, F.transform("_entries", lambda e: e["key"]).alias("_keys"), "_entries"), "borders")
    place = F.coalesce(bisect_right(bounds, key, size), F.lit(0)) if size else F.lit(0)
    found = _in_tree(df.withColumn(_RANGE, place), key, tree, lambda at: F.get("_entries", at - 1), per)
    return found.withColumns({CELL: F.col(f"{CELL}._no"), "_before": F.col(f"{CELL}.start")})


def running_totals(
    df: DataFrame,
    order_by: Sequence[str],
    values: dict[str, Column],
    group_by: Sequence[str] = (),
    rows_per_cell: int = ROWS_PER_CELL,
    keep_cell: bool = False,
) -> DataFrame:
    """Add, for each entry of ``values``, its inclusive running sum in key order
    within the group. Other columns are carried along. With ``keep_cell`` the
    result stays hash-partitioned by group and ``_cell`` and keeps that column.
    Two rows of a group with one key end the job: their order would be left to chance."""
    groups = list(group_by)
    named = {f"_v{i}": expr for i, expr in enumerate(values.values())}
    rows, cells = _with_cells(df, order_by, rows_per_cell)
    # A struct is never NULL, so groups that hold NULL join like others, on the columns that the window has dealt out.
    group = [_GROUP] if groups else []
    rows = rows.withColumns({_GROUP: F.struct(*groups)} if groups else {})
    line = Window.partitionBy(*group, CELL).orderBy(*order_by)
    local = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = _struct_of(order_by)
    ties = F.when(F.lag(key).over(line) == key, F.raise_error(F.concat(F.lit("two rows have the order key "), key.cast("string"))).cast("bigint"))
    hidden = [*group, "_tie", *([] if keep_cell else [CELL])]

    def checked(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
        return df.withColumns({**sums, "_tie": ties}).where(F.col("_tie").isNull())

    if cells == 1:  # counted: everything fits one cell, there are no offsets
        return checked(rows, {out: F.sum(e).over(local) for out, e in values.items()}).drop(*hidden)
    totals = rows.groupBy(*group, CELL).agg(*[F.sum(e).alias(n) for n, e in named.items()])
    offsets = _offsets(totals, group, list(named), cells).select(
        *[F.col(g).alias(f"_o{g}") for g in group], F.col(CELL).alias("_o_cell"), *[F.col(n).alias(f"_o{n}") for n in named])
    same = F.col(CELL) == F.col("_o_cell")
    for g in group:
        same = same & (F.col(g) == F.col(f"_o{g}"))
    return (
        checked(rows, {name: F.sum(expr).over(local) for name, expr in named.items()})
        .join(offsets, same)
        .withColumns({out: F.col(n) + F.col(f"_o{n}") for out, n in zip(values, named)})
        .drop(*named, *[f"_o{n}" for n in named], *[f"_o{g}" for g in group], "_o_cell", *hidden)
    )


def _offsets(totals: DataFrame, group: list[str], names: list[str], cells: int) -> DataFrame:
    """What comes before each cell of ``totals``. Beyond ``FAN`` cells they are summed up within blocks first, and
    over the blocks then, so no task holds more than ``FAN`` of a group."""
    before = lambda *by: Window.partitionBy(*(by or [F.lit(0)]))
    prior = (Window.unboundedPreceding, -1)
    if cells <= FAN + 1:
        line = before(*group).orderBy(CELL).rowsBetween(*prior)
        return totals.select(*group, CELL, *[F.coalesce(F.sum(n).over(line), F.lit(0)).alias(n) for n in names])
    block = whole_div(F.col(CELL), FAN).alias("_block")
    blocks = totals.groupBy(*group, block).agg(*[F.sum(n).alias(n) for n in names])
    line = before(*group).orderBy("_block").rowsBetween(*prior)
    ahead = blocks.select(*[F.col(g).alias(f"_b{g}") for g in group], F.col("_block").alias("_b_block"),
                          *[F.coalesce(F.sum(n).over(line), F.lit(0)).alias(f"_b{n}") for n in names])
    inner = before(*group, "_block").orderBy(CELL).rowsBetween(*prior)
    own = totals.withColumn("_block", block).select(*group, CELL, "_block", *[F.coalesce(F.sum(n).over(inner), F.lit(0)).alias(n) for n in names])
    same = F.col("_block") == F.col("_b_block")
    for g in group:
        same = same & (F.col(g) == F.col(f"_b{g}"))
    return own.join(ahead, same).select(*group, CELL, *[(F.col(n) + F.col(f"_b{n}")).alias(n) for n in names])


def ordinals(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = (),
             name: str = "ord", rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Number the rows 1, 2, ... in key order within the group."""
    return running_totals(df, order_by, {name: F.lit(1).cast("bigint")}, group_by, rows_per_cell)


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in key order, as a top-k without a full sort."""
    return df.orderBy(*order_by).limit(n)


def _after_null(name: str, ahead: Column) -> Column:
    """NULL comes first in key order."""
    return F.col(name).isNull() | ahead


def up_to(order_by: Sequence[str], end: Sequence, types: dict[str, T.DataType]) -> Column:
    """Rows whose key is not behind ``end``, as plain comparisons: the first column's bound stands on its own, so it reaches
    the scan; a tie there is settled by the next column."""
    name, value = order_by[0], end[0]
    if value is None:
        same = F.col(name).isNull()
        return same & up_to(order_by[1:], end[1:], types) if len(order_by) > 1 else same
    bound = F.lit(value).cast(types[name])
    reach = _after_null(name, F.col(name) <= bound)
    if len(order_by) == 1:
        return reach
    return reach & (_after_null(name, F.col(name) < bound) | up_to(order_by[1:], end[1:], types))


def _types(df: DataFrame, order_by: Sequence[str]) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.select(*order_by).schema}


def prefix(df: DataFrame, n: int, order_by: Sequence[str],
           rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """The first ``n`` rows in key order for large ``n``: the n-th key is looked
    up on the key columns alone, then rows are filtered where they are read."""
    last = ordinals(df.select(*order_by), order_by, name="_ord", rows_per_cell=rows_per_cell).where(
        F.col("_ord") == n).first()
    if last is None:
        return df if n > 0 else df.limit(0)
    return df.where(up_to(order_by, [last[k] for k in order_by], _types(df, order_by)))


def key_cutoffs(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = ()) -> DataFrame:
    """Largest order key per group, one row each: an ordered prefix described by
    its end, so that wide rows can be filtered where they are read."""
    return df.groupBy(*group_by).agg(F.max(_struct_of(order_by)).alias("_cutoff"))


def take_prefix(df: DataFrame, cutoffs: DataFrame, order_by: Sequence[str],
                group_by: Sequence[str]) -> DataFrame:
    """Rows up to the cutoff of their group. ``cutoffs`` is a stored table with
    one row per source named in the mix or registry. Up to ``MOST_CUTOFFS`` of them become plain comparisons, each group's with its own
    key, which reach the scan; with more, the table is joined and the furthest key alone goes to the scan."""
    ends = cutoffs.limit(MOST_CUTOFFS + 1).collect()
    if not ends:
        return df.limit(0)
    types = _types(df, order_by)
    plain = not any(isinstance(t, (T.StructType, T.ArrayType)) for t in types.values())
    if len(ends) <= MOST_CUTOFFS and plain:
        chosen = []
        for row in ends:
            if all(row[g] is not None for g in group_by):  # a NULL group joins nothing
                own = [F.col(g) == F.lit(row[g]) for g in group_by]
                chosen.append(reduce(and_, [*own, up_to(order_by, list(row["_cutoff"]), types)]))
        return df.where(reduce(or_, chosen)) if chosen else df.limit(0)
    furthest = cutoffs.agg(F.max("_cutoff.k0")).first()[0] if plain else None
    near = df if furthest is None else df.where(up_to(order_by[:1], [furthest], types))
    return (
        near.join(cutoffs, list(group_by))
        .where(_struct_of(order_by) <= F.col("_cutoff"))
        .drop("_cutoff")
    )


def trailing_average(df: DataFrame, k: int, value: str, ordinal: str, group_by: Sequence[str],
                     name: str, rows_per_block: int = ROWS_PER_CELL) -> DataFrame:
    """Mean of the last ``k`` values (fewer at the head). ``ordinal`` is dense
    from 1. Blocks of ordinals are averaged apart; the last ``k - 1`` rows of a
    block are copied to the next one, so no run has to fit in one task."""
    if k <= 1:
        return df.withColumn(name, F.col(value))
    size = max(rows_per_block, k)
    index = F.col(ordinal) - 1
    block = whole_div(index, size)
    copies = F.when(index % size > size - k, F.array(block, block + 1)).otherwise(F.array(block))
    frame = Window.partitionBy(*group_by, "_block").orderBy(ordinal).rowsBetween(-(k - 1), 0)
    return (
        df.withColumn("_block", F.explode(copies))
        .withColumn(name, F.avg(value).over(frame))
        .where(F.col("_block") == block)
        .drop("_block")
    )


def exponential_average(df: DataFrame, decay: float, value: str, order_by: Sequence[str],
                        group: str, name: str, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``out = decay * previous + (1 - decay) * value``, started at the first
    value. Each cell is folded on its own; the fold is affine in the value it
    starts from, so the carry over the cells corrects it afterwards."""
    rows = add_cells(df, order_by, rows_per_cell)
    schema = T.StructType([*rows.schema, T.StructField("_local", T.DoubleType()), T.StructField("_seen", T.LongType())])
    keys = list(order_by)

    def fold(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(keys, kind="stable")
        cell["_local"] = cell[value].ewm(alpha=1.0 - decay, adjust=False).mean()
        cell["_seen"] = range(1, len(cell) + 1)
        return cell

    local = rows.groupBy(group, CELL).applyInPandas(fold, schema)
    place = F.struct(*keys)
    ends = local.groupBy(group, CELL).agg(
        F.min_by(value, place).alias("first"),
        F.max_by("_local", place).alias("last"),
        F.count(F.lit(1)).alias("n"),
    )
    # One row per cell: carry_next = last + decay^n * (carry - first).
    chain = F.array_sort(F.collect_list(F.struct(CELL, "first", "last", "n")))
    start = F.struct(F.lit(None).cast("double").alias("carry"),
                     F.array().cast("array<struct<cell:int,first:double,carry:double>>").alias("out"))

    def step(acc: Column, cell: Column) -> Column:
        shift = F.coalesce(acc["carry"] - cell["first"], F.lit(0.0))
        entry = F.struct(cell[CELL].cast("int").alias("cell"), cell["first"].alias("first"),
                         acc["carry"].alias("carry"))
        return F.struct(
            (cell["last"] + F.pow(F.lit(decay), cell["n"]) * shift).alias("carry"),
            F.concat(acc["out"], F.array(entry)).alias("out"),
        )

    carries = (
        ends.groupBy(group).agg(chain.alias("chain"))
        .select(F.col(group).alias("_g"), F.explode(F.aggregate("chain", start, step)["out"]).alias("e"))
        .select("_g", F.col("e.cell").alias("_c"),
                F.coalesce(F.col("e.carry") - F.col("e.first"), F.lit(0.0)).alias("_shift"))
    )
    fixed = F.col("_local") + F.pow(F.lit(decay), F.col("_seen")) * F.col("_shift")
    return (
        local.join(carries, F.col(group).eqNullSafe(F.col("_g")) & (F.col(CELL) == F.col("_c")))
        .withColumn(name, fixed)
        .drop("_g", "_c", "_shift", "_local", "_seen", CELL)
    )
