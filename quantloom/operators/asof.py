"""As-of joins by union and ordered scans: no pair of rows is ever compared with all others (J01-J07, J14).

Without ``span`` each group of ``by`` is one ordered scan. With it (a width in the unit of the keys: microseconds for
times, days for dates), a group is cut into ranges that are scanned in parallel; the last hit of the ranges before, one
small row a range, is carried in. Use it where a group is long or there is no ``by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000  # microseconds


def _union(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], values: list[str], right_first: bool) -> DataFrame:
    packed = F.struct(*left.columns)
    kind = F.struct(F.col(right_on).alias("key"), *values)
    a = left.select(*by, F.col(left_on).alias("__at"), F.lit(1 if right_first else 0).alias("__side"), packed.alias("__row"), F.lit(None).cast(right.select(kind.alias("x")).schema["x"].dataType).alias("__hit"))
    b = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("__at"), F.lit(0 if right_first else 1).alias("__side"), F.lit(None).cast(left.select(packed.alias("x")).schema["x"].dataType).alias("__row"), kind.alias("__hit"))
    return a.unionByName(b)


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    return F.unix_micros(F.col(name).cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(F.col(name)) if kind == "date" else F.col(name)


def _scan(both: DataFrame, by: list[str], columns: list[str], span: int | None, ahead: bool, tie: list[str]) -> DataFrame:
    """``columns`` of each row: their last (first, ``ahead``) values that are there, at or before (after) the row.

    Looking ahead is looking back from the end: a frame that reaches to the end is read anew for each row.
    """
    order = ["__at", "__side", *tie]
    turned = F.desc if ahead else F.asc
    w = Window.orderBy(*map(turned, order)).rowsBetween(Window.unboundedPreceding, 0)
    if span is None:
        return both.withColumns({c: F.last(c, ignorenulls=True).over(w.partitionBy(*by)) for c in columns})
    ranged = both.withColumn("__range", F.floor(_number(both, "__at") / F.lit(span)).cast("long"))
    keys = [*by, "__range"]
    far = F.min_by if ahead else F.max_by
    edges = ranged.groupBy(*keys).agg(*[far(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])
    past = Window.partitionBy(*by).orderBy(turned("__range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*keys, *[F.last(c, ignorenulls=True).over(past).alias(f"__c_{i}") for i, c in enumerate(columns)])
    here = w.partitionBy(*keys)
    found = ranged.join(carried, keys, "left").withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(here), f"__c_{i}") for i, c in enumerate(columns)})
    return found.drop("__range", *[f"__c_{i}" for i in range(len(columns))])


def asof_backward(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], values: list[str], suffix: str = "", stale: Column | None = None, span: int | None = None) -> DataFrame:
    """Each left row with the latest right row whose key is at or before its own (J01).

    Of several right rows with the same key the one of the largest values wins. ``values`` come with ``suffix``, and the
    right key as ``asof_key``. Left rows without a match keep NULLs; with ``stale`` (a condition on the joined row that is
    true for matches too old), matches are dropped (J04).
    """
    both = _union(left, right, left_on, right_on, by, values, True)
    return _unpack(_scan(both, by, ["__hit"], span, False, ["__hit"]), left, values, suffix, stale)


def asof_forward(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], values: list[str], suffix: str = "", stale: Column | None = None, span: int | None = None) -> DataFrame:
    """Each left row with the earliest right row whose key is at or after its own (J02)."""
    both = _union(left, right, left_on, right_on, by, values, False)
    return _unpack(_scan(both, by, ["__hit"], span, True, ["__hit"]), left, values, suffix, stale)


def asof_columns(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], values: dict[str, Column], span: int | None = None) -> DataFrame:
    """Each left row with the latest value that is there of each of several columns, in one scan (J14, F087, F090): the
    state of many series at one time. ``values`` are expressions on ``right``; of equal keys the largest values win."""
    kinds = {n: right.select(v.alias("x")).schema["x"].dataType for n, v in values.items()}
    packed = F.struct(*left.columns)
    a = left.select(*by, F.col(left_on).alias("__at"), F.lit(1).alias("__side"), packed.alias("__row"), *[F.lit(None).cast(k).alias(n) for n, k in kinds.items()])
    b = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(packed.alias("x")).schema["x"].dataType).alias("__row"), *[v.alias(n) for n, v in values.items()])
    done = _scan(a.unionByName(b), by, list(values), span, False, list(values))
    return done.where(F.col("__row").isNotNull()).select("__row.*", *values)


def _unpack(joined: DataFrame, left: DataFrame, values: list[str], suffix: str, stale: Column | None) -> DataFrame:
    out = joined.where(F.col("__row").isNotNull()).select("__row.*", F.col("__hit.key").alias("asof_key"), *[F.col(f"__hit.{v}").alias(v + suffix) for v in values])
    if stale is None:
        return out
    keep = ~F.coalesce(stale, F.lit(False))
    return out.select(*left.columns, *[F.when(keep, F.col(c)).alias(c) for c in ["asof_key", *(v + suffix for v in values)]])
