"""Ordered computations (running values, offsets, frames, positions) that hold when one group is huge.

A plain window sends a whole group to one task. That is fine for groups of bounded size, and Spark does the rest.
A group above a bound in rows (``spark.trialframe.chunkRows``) or in bytes of texts (``spark.trialframe.chunkBytes``) is cut into
consecutive chunks along its order: chunk borders are quantiles of the order columns over the rows of such groups, so a group
with a third of all rows is spread over many chunks. Every chunk is processed on its own, and a small table with one row per (group, chunk) carries totals forward.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.columns import as_list, col, is_nested, key_struct
from trialframe.session import cut, settled

DEFAULT_CHUNK_ROWS = 1_000_000
DEFAULT_CHUNK_BYTES = 64 << 20
#: so few rows are not measured
FEW_ROWS = 1_000
BROADCAST_GROUPS = 20_000
CHUNK = "__chunk"
PLACE = "__place"
GROUP = "__group"
LARGE = "__large"


# ---------------------------------------------------------------- order

@dataclass(frozen=True)
class OrderKey:
    """One sort column; missing values come last in either direction."""

    name: str
    ascending: bool = True

    def sort(self, reverse: bool = False) -> Column:
        c = col(self.name)
        if reverse:
            return c.desc_nulls_first() if self.ascending else c.asc_nulls_first()
        return c.asc_nulls_last() if self.ascending else c.desc_nulls_last()


def order_keys(order) -> list[OrderKey]:
    """Accepts names, ``-name`` for descending, ``(name, ascending)`` pairs and OrderKey objects."""
    keys = []
    for item in as_list(order):
        if isinstance(item, OrderKey):
            keys.append(item)
        elif isinstance(item, tuple):
            keys.append(OrderKey(item[0], bool(item[1])))
        elif item.startswith("-"):
            keys.append(OrderKey(item[1:], False))
        else:
            keys.append(OrderKey(item))
    if not keys:
        raise ValueError("an explicit order is needed: rows of a DataFrame have none of their own")
    return keys


def sort_columns(order, reverse: bool = False) -> list[Column]:
    return [k.sort(reverse) for k in order_keys(order)]


def chunk_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.trialframe.chunkRows", str(DEFAULT_CHUNK_ROWS)))


def chunk_bytes(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.trialframe.chunkBytes", str(DEFAULT_CHUNK_BYTES)))


def wide_bytes(df: DataFrame) -> Column | None:
    """Bytes of a row in columns of any length, nested ones as JSON; None without such columns."""
    parts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.octet_length(col(f.name)))
        elif is_nested(f.dataType):
            parts.append(F.octet_length(F.to_json(F.struct(col(f.name)))))
    return sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0).cast("bigint")) if parts else None


def measured(df: DataFrame, names: Sequence[str], rows: int | None) -> tuple[int, int]:
    """Rows of a frame, and the bytes of its columns of any length (0 for few rows)."""
    width = wide_bytes(df)
    if width is None:
        return (count_rows(df, names) if rows is None else rows), 0
    if rows is None:
        rows, size = df.agg(F.count(F.lit(1)), F.sum(width)).first()
        return rows, (size or 0) if rows > FEW_ROWS else 0
    return rows, (df.agg(F.sum(width)).first()[0] or 0) if rows > FEW_ROWS else 0


def rows_in_bounds(df: DataFrame, rows: int, size: int) -> int:
    """Rows of which one task holds no more than both bounds allow, at the frame's average width."""
    target, limit = chunk_rows(df), chunk_bytes(df)
    return target if size <= limit else max(1, min(target, rows * limit // size))


def count_rows(df: DataFrame, names: Sequence[str]) -> int:
    return df.select(*[col(n) for n in names]).count()


# ---------------------------------------------------------------- chunks

def with_chunks(df: DataFrame, order, rows: int, target: int, keys: Sequence[str] = ()) -> DataFrame:
    """Add a chunk number that grows with the order (below the keys) and holds about ``target`` of ``rows`` rows.

    Borders are quantiles of the whole order tuple, sampled by Spark's range partitioning, so any sortable type will
    do and texts count to their last byte; rows that agree in all order columns are told apart by a number of their own.
    The numbered frame is written once, as borders drawn again could differ.
    """
    pieces = max(1, -(-rows // target))
    tie = F.col("__tie")
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(
        pieces, *[col(k) for k in keys], *sort_columns(order), tie)
    return cut(ranged.withColumn(CHUNK, F.spark_partition_id().cast("bigint")).drop("__tie"))


def large_groups(df: DataFrame, keys: Sequence[str], target: int, limit: int) -> tuple[DataFrame, int, int]:
    """Keys of the groups above ``target`` rows or ``limit`` bytes, and how many rows and bytes they hold together.

    Sizes are counted with partial sums per task. The list is marked for a broadcast only while it is short.
    """
    width = wide_bytes(df)
    sizes = df.groupBy(key_struct(keys).alias(GROUP)).agg(
        F.count(F.lit(1)).alias("__size"), (F.lit(0).cast("bigint") if width is None else F.sum(width)).alias("__bytes"))
    many = (F.col("__size") > target) | ((F.col("__bytes") > limit) & (F.col("__size") > min(target, FEW_ROWS)))
    found = cut(sizes.filter(many))
    n, held, size = found.agg(F.count(F.lit(1)), F.sum("__size"), F.sum("__bytes")).first()
    listed = found.select(GROUP, F.lit(True).alias(LARGE))
    return F.broadcast(listed) if n <= BROADCAST_GROUPS else listed, held or 0, size or 0


def in_bounds(df: DataFrame, keys: Sequence[str], rows: int, size: int | None = None) -> bool:
    """Can every group be left to one task?"""
    target, limit = chunk_rows(df), chunk_bytes(df)
    if rows <= target and (measured(df, keys, rows)[1] if size is None else size) <= limit:
        return True
    return bool(keys) and large_groups(df, keys, target, limit)[1] == 0


# ---------------------------------------------------------------- running values

@dataclass(frozen=True)
class Scan:
    """A running value: how it runs in a chunk, what a chunk passes on, and how both are put together."""

    kind: str
    column: str | None = None
    exclusive: bool = False

    def value(self) -> Column:
        return F.lit(1) if self.column is None else col(self.column)

    def aggregate(self, c: Column) -> Column:
        return {
            "count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "product": F.product,
            "last": lambda x: F.last(x, ignorenulls=True),
        }[self.kind](c)

    def carry(self, total: Column, window) -> Column:
        if self.kind == "count":
            return F.sum(total).over(window)
        return self.aggregate(total).over(window)

    def merge(self, before: Column, here: Column) -> Column:
        if self.kind == "count":
            return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
        if self.kind == "sum":
            return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
        if self.kind == "product":
            return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before * here)
        if self.kind == "min":
            return F.least(before, here)
        if self.kind == "max":
            return F.greatest(before, here)
        return F.coalesce(here, before)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order,
    scans: dict[str, Scan],
    reverse: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Add running values per group in the given order (from its end with ``reverse``)."""
    names = [k.name for k in order_keys(order)]
    rows, size = measured(df, names, rows)
    split = rows > chunk_rows(df) or size > chunk_bytes(df)
    group = [col(k) for k in keys]
    if split:
        df = settled(df)
        if keys:
            found, rows, size = large_groups(df, keys, chunk_rows(df), chunk_bytes(df))
            split = rows > 0
    if split:
        target = rows_in_bounds(df, rows, size)
        if keys:
            marked = df.withColumn(GROUP, key_struct(keys)).join(found, GROUP, "left").drop(GROUP)
            large = with_chunks(marked.filter(F.col(LARGE)), order, rows, target, keys)
            df = large.unionByName(marked.filter(F.col(LARGE).isNull()).withColumn(CHUNK, F.lit(0).cast("bigint")))
        else:
            df = with_chunks(df, order, rows, target).withColumn(LARGE, F.lit(True))
        df = df.withColumn("__part", key_struct([*keys, CHUNK]))
        pieces = -(-rows // target)
        if 4 * pieces > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            # fewer tasks than chunks would hold several chunks each
            df = df.repartition(4 * pieces, F.col("__part"))
        group = [F.col("__part")]
    full = Window.partitionBy(*group).orderBy(*sort_columns(order, reverse))
    upto = full.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = full.rowsBetween(Window.unboundedPreceding, -1)

    def local(s: Scan) -> Column:
        return s.aggregate(s.value()).over(before if s.exclusive else upto)

    if not split:
        return df.withColumns({out: local(s) for out, s in scans.items()})

    source = df
    if any(s.kind == "last" for s in scans.values()):
        source = source.withColumn(PLACE, F.row_number().over(full))

    def total(s: Scan) -> Column:
        if s.kind == "last":
            return F.max_by(s.value(), F.when(s.value().isNotNull(), F.col(PLACE)))
        return s.aggregate(s.value())

    totals = source.filter(F.col(LARGE)).groupBy("__part").agg(
        *[F.first(col(k)).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.first(F.col(CHUNK)).alias("__order"),
        *[total(s).alias(f"__t{i}") for i, s in enumerate(scans.values())],
    )
    ahead = Window.partitionBy(*[F.col(f"__k{i}") for i in range(len(keys))]).orderBy(
        F.col("__order").desc() if reverse else F.col("__order").asc()
    ).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "__part", *[s.carry(F.col(f"__t{i}"), ahead).alias(f"__c{i}") for i, s in enumerate(scans.values())]
    )
    here = df.withColumns({f"__l{i}": local(s) for i, s in enumerate(scans.values())})
    joined = here.join(carried, "__part", "left")
    joined = joined.withColumns(
        {out: s.merge(F.col(f"__c{i}"), F.col(f"__l{i}")) for i, (out, s) in enumerate(scans.items())}
    )
    return joined.drop("__part", CHUNK, LARGE, *[f"__l{i}" for i in range(len(scans))], *[f"__c{i}" for i in range(len(scans))])


def positions(df: DataFrame, keys: Sequence[str], order, out: str = PLACE, rows: int | None = None) -> DataFrame:
    """Add the 0-based place of every row in its group."""
    counted = running(df, keys, order, {out: Scan("count")}, rows=rows)
    return counted.withColumn(out, col(out) - 1)


def dense_places(ids: DataFrame, parents: Sequence[str], order, out: str, rows: int | None = None) -> DataFrame:
    """0-based dense number of each distinct value of the order columns below its parent.

    ``ids`` may hold the value many times; it is made distinct first.
    """
    names = [k.name for k in order_keys(order)]
    distinct = ids.select(*[col(n) for n in dict.fromkeys([*parents, *names])]).distinct()
    return positions(distinct, parents, order, out, rows=rows)


# ---------------------------------------------------------------- frames over neighbouring rows

def framed(
    df: DataFrame,
    keys: Sequence[str],
    order,
    behind: int,
    ahead: int,
    build: Callable[..., dict[str, Column]],
    rows: int | None = None,
) -> DataFrame:
    """Add columns that look at most ``behind`` rows back and ``ahead`` rows on.

    ``build(window)`` gets a window partitioned and ordered already and returns the new columns. Large inputs are
    cut into blocks of consecutive places; the rows near a border are copied to the neighbouring block, so each
    block sees its whole neighbourhood, and the copies are removed afterwards.
    """
    names = [k.name for k in order_keys(order)]
    rows, held = measured(df, names, rows)
    if rows > chunk_rows(df) or held > chunk_bytes(df):
        df = settled(df)
    if in_bounds(df, keys, rows, held):
        window = Window.partitionBy(*[col(k) for k in keys]).orderBy(*sort_columns(order))
        return df.withColumns(build(window))
    size = max(rows_in_bounds(df, rows, held), behind, ahead, 1)
    placed = positions(df, keys, order, rows=rows)
    inner = F.col(PLACE) % F.lit(size)
    home = F.floor(F.col(PLACE) / F.lit(size)).cast("bigint")
    copies = F.array_compact(F.array(
        home,
        F.when(inner >= F.lit(size - behind), home + 1),
        F.when(inner < F.lit(ahead), home - 1),
    ))
    spread = placed.withColumn("__home", home).withColumn("__block", F.explode(copies))
    window = Window.partitionBy(*[col(k) for k in keys], F.col("__block")).orderBy(F.col(PLACE))
    done = spread.withColumns(build(window)).filter(F.col("__block") == F.col("__home"))
    return done.drop(PLACE, "__home", "__block")


# ---------------------------------------------------------------- first and last rows of a group

def edge_rows(df: DataFrame, keys: Sequence[str], order, n: int, last: bool = False) -> DataFrame:
    """The first (or last) ``n`` rows of each group.

    Spark cuts every map task down to ``n`` rows per group before the shuffle when ``n`` is small; a large ``n``
    goes through exact places instead.
    """
    if n <= 1000:
        window = Window.partitionBy(*[col(k) for k in keys]).orderBy(*sort_columns(order, reverse=last))
        ranked = df.withColumn("__rn", F.row_number().over(window))
        return ranked.filter(F.col("__rn") <= n).drop("__rn")
    scans = {PLACE: Scan("count")}
    return running(df, keys, order, scans, reverse=last).filter(F.col(PLACE) <= n).drop(PLACE)


# ---------------------------------------------------------------- exact quantiles

def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    rows: int | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one output column per entry of ``probabilities``.

    A large group is never held in one aggregation state: values are counted first, a running count over the
    distinct values gives every value its interval of places, and the two places next to each quantile are picked.
    """
    rows = count_rows(df, [value]) if rows is None else rows
    if rows > chunk_rows(df):
        df = settled(df.select(*[col(k) for k in keys], col(value)))
    if in_bounds(df, keys, rows):
        wanted = F.array(*[F.lit(float(p)) for p in probabilities.values()])
        found = df.groupBy(*[col(k) for k in keys]).agg(F.percentile(col(value).cast("double"), wanted).alias("__q"))
        return found.select(*[col(k) for k in keys], *[F.col("__q")[i].alias(o) for i, o in enumerate(probabilities)])
    x = df.select(*[col(k) for k in keys], col(value).cast("double").alias("__v"))
    everyone = x.groupBy(*[col(k) for k in keys]).agg(F.count("__v").alias("__n"))
    counted = x.filter(F.col("__v").isNotNull()).groupBy(*[col(k) for k in keys], "__v").agg(
        F.count(F.lit(1)).alias("__m"))
    ranked = running(counted, keys, "__v", {"__hi": Scan("sum", "__m")})
    if keys:
        joint = "__key"
        placed = ranked.withColumn(joint, key_struct(keys)).join(
            everyone.withColumn(joint, key_struct(keys)).drop(*keys), joint, "inner").drop(joint)
    else:
        placed = ranked.withColumn("__n", F.lit(everyone.first()["__n"]))
    picks = []
    for i, p in enumerate(probabilities.values()):
        at = F.lit(float(p)) * (F.col("__n") - 1)
        for tag, place in (("f", F.floor(at)), ("c", F.ceil(at))):
            hit = (F.col("__hi") - F.col("__m") <= place) & (place < F.col("__hi"))
            picks.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{tag}{i}"))
    picked = placed.groupBy(*[col(k) for k in keys], "__n").agg(*picks)
    outputs = []
    for i, (out, p) in enumerate(probabilities.items()):
        at = F.lit(float(p)) * (F.col("__n") - 1)
        low, high = F.col(f"__f{i}"), F.col(f"__c{i}")
        outputs.append((low + (high - low) * (at - F.floor(at))).alias(out))
    found = picked.select(*[col(k) for k in keys], *outputs)
    if not keys:
        return found
    joint = "__key"
    return everyone.drop("__n").withColumn(joint, key_struct(keys)).join(
        found.withColumn(joint, key_struct(keys)).drop(*keys), joint, "left").drop(joint)


def column_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probabilities: Sequence[float],
    name: Callable[[str, float], str],
    rows: int | None = None,
) -> DataFrame:
    """Exact quantiles of several columns; ``name(column, probability)`` gives the output names.

    All columns go through one pass in long form instead of one pass each.
    """
    if len(columns) == 1:
        only = columns[0]
        return quantiles(df, keys, only, {name(only, p): p for p in probabilities}, rows=rows)
    cells = F.array(*[
        F.struct(F.lit(i).alias("__column"), col(c).cast("double").alias("__value")) for i, c in enumerate(columns)])
    long = df.select(*[col(k) for k in keys], F.inline(cells))
    marks = {f"__p{j}": p for j, p in enumerate(probabilities)}
    total = None if rows is None else rows * len(columns)
    found = quantiles(long, [*keys, "__column"], "__value", marks, rows=total)
    return found.groupBy(*[col(k) for k in keys]).agg(*[
        F.max(F.when(F.col("__column") == i, F.col(mark))).alias(name(c, p))
        for i, c in enumerate(columns) for mark, p in marks.items()
    ])


# ---------------------------------------------------------------- ranks

def ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    method: str = "average",
    ascending: bool = True,
    pct: bool = False,
    order=None,
    rows: int | None = None,
) -> DataFrame:
    """Rank of each row's value in its group; missing values get no rank."""
    if method not in ("average", "min", "max", "first", "dense"):
        raise ValueError(f"unknown rank method {method!r}")
    rows = count_rows(df, [value]) if rows is None else rows
    if rows > chunk_rows(df):
        df = settled(df)
    key = OrderKey(value, ascending)
    present = col(value).isNotNull()
    if method == "first":
        df = positions(df, keys, [key, *order_keys(order)], "__place0", rows=rows)
        base = F.col("__place0") + 1
        extra = ["__place0"]
        if pct:
            sizes = df.groupBy(*[col(k) for k in keys]).agg(F.count(col(value)).alias("__n"))
            df = _attach(df, sizes, keys)
            extra.append("__n")
    elif in_bounds(df, keys, rows):
        group = Window.partitionBy(*[col(k) for k in keys])
        ordered = group.orderBy(key.sort())
        low = F.rank().over(ordered)
        ties = F.count(F.lit(1)).over(Window.partitionBy(*[col(k) for k in keys], col(value)))
        base = {
            "min": low, "max": low + ties - 1, "average": low + (ties - 1) / F.lit(2.0),
            "dense": F.dense_rank().over(ordered),
        }[method]
        extra = []
        if pct:
            n = F.max(F.when(present, F.dense_rank().over(ordered))) if method == "dense" else F.count(col(value))
            if method == "dense":
                df = df.withColumn("__dense", F.when(present, F.dense_rank().over(ordered)))
                n = F.max("__dense")
                extra.append("__dense")
            df = df.withColumn("__n", n.over(group))
            extra.append("__n")
    else:
        counts = df.filter(present).groupBy(*[col(k) for k in keys], col(value)).agg(F.count(F.lit(1)).alias("__m"))
        scans = {"__hi": Scan("sum", "__m"), "__dense": Scan("count")}
        counts = running(counts, keys, key, scans)
        if pct:
            top = F.max("__dense") if method == "dense" else F.sum("__m")
            counts = _attach(counts, counts.groupBy(*[col(k) for k in keys]).agg(top.alias("__n")), keys)
        df = _attach(df, counts, [*keys, value], "left")
        low = F.col("__hi") - F.col("__m") + 1
        base = {
            "min": low, "max": F.col("__hi"), "average": (low + F.col("__hi")) / F.lit(2.0), "dense": F.col("__dense"),
        }[method]
        extra = ["__hi", "__m", "__dense"] + (["__n"] if pct else [])
    result = base.cast("double")
    if pct:
        result = result / F.col("__n")
    return df.withColumn(out, F.when(present, result)).drop(*extra)


def _attach(df: DataFrame, values: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    if not keys:
        row = values.first()
        return df.withColumns({c: F.lit(row[c]) for c in values.columns})
    joint = "__key"
    right = values.withColumn(joint, key_struct(keys)).drop(*keys)
    return df.withColumn(joint, key_struct(keys)).join(right, joint, how).drop(joint)
