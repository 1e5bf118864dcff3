"""Column helpers, written tables and the multi-level prefix sum."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a histogram that one task puts in order; a larger one is dealt into ranges of about so many.
RANGE_ROWS = 1 << 18
#: Ranges whose totals one task puts in order; more are summed in blocks of so many, and so on.
LEVEL = 1 << 12


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b) -> Column:
    """a / b as a double; null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def ratio0(a, b) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def r6(c) -> Column:
    """Rounded once, at output."""
    return F.round(col(c).cast("double"), 6)


def count_if(c: Column) -> Column:
    return F.count_if(c).cast("bigint")


def clean(c) -> Column:
    """NaN and null are one thing: null."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def corr(x, y) -> Column:
    """Pearson correlation over rows where both are there; null for a constant column."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def valid(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null or NaN; every order-based or probability measure starts here."""
    kinds = dict(df.dtypes)
    for c in columns:
        fine = F.col(c).isNotNull()
        df = df.where(fine & ~F.isnan(c) if kinds.get(c) in ("double", "float") else fine)
    return df


def join_on(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; the keys are kept once."""
    renamed = b.select(*[F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{i}"))
    return a.join(renamed, on, how).drop(*[f"_r_{i}" for i in range(len(keys))])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one in the warehouse where that is unset. On a cluster
    a warehouse in the machine's own files is refused, as other machines would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/failscope-shared"
        if base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return f"{base.rstrip('/')}/failscope-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once whatever reads it, and safe from lost executors. A table
    that this has written is taken as it is."""
    if getattr(df, "_failscope_written", False):
        return df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._failscope_written = True
    return out


def _ranged(table: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, int]:
    """table, written, with ``_r``, the number of the range its keys fall into, and how many ranges there are; a range has
    about so many rows. Small tables are one range, so nothing is shuffled for them."""
    table = written(table)
    ranges = math.ceil(table.count() / rows)  # from the footers
    if ranges <= 1:
        return table.withColumn("_r", F.lit(0)), 1
    return written(table.repartitionByRange(ranges, *keys).withColumn("_r", F.spark_partition_id())), ranges


def _earlier(totals: DataFrame, by: list[str], names: list[str], f, ranges: int, level: int, back: bool) -> DataFrame:
    """totals (by, _r, names) with each name's ``f`` over the earlier ranges of the group (later ones, if back), null where
    there are none: over the ranges of a block, and the same over blocks, until one task can hold a level."""
    span = (1, Window.unboundedFollowing) if back else (Window.unboundedPreceding, -1)
    if ranges <= level:
        own = Window.partitionBy(*by).orderBy("_r").rowsBetween(*span)
        return totals.select(*by, "_r", *[f(n).over(own).alias(n) for n in names])
    block = F.floor(F.col("_r") / level).cast("int")
    own = Window.partitionBy(*by, block).orderBy("_r").rowsBetween(*span)
    near = totals.select(*by, "_r", block.alias("_block"), *[f(n).over(own).alias(n) for n in names])
    blocks = totals.groupBy(*by, block.alias("_r")).agg(*[f(n).alias(n) for n in names])
    far = _earlier(blocks, by, names, f, math.ceil(ranges / level), level, back)
    far = far.select(*by, F.col("_r").alias("_block"), F.struct(*names).alias("_far"))
    both = join_on(near, far, [*by, "_block"])
    return both.select(*by, "_r", *[F.when(F.col(n).isNull(), F.col(f"_far.{n}")).when(F.col(f"_far.{n}").isNull(), F.col(n)).otherwise(_pair(f, n)).alias(n) for n in names])


def _pair(f, name: str) -> Column:
    return F.col(name) + F.col(f"_far.{name}") if f is F.sum else F.least(F.col(name), F.col(f"_far.{name}"))


def _scan(table: DataFrame, by: list[str], value: str, names: list[str], prefix: str, f, back: bool, rows: int, level: int) -> DataFrame:
    """table with ``<prefix>_<name>``: f (sum or min) over the rows of the group up to this value, or from it on if back.

    Rows are dealt into ranges of (by, value). What earlier ranges of a group add up to comes as one row more in each range,
    before the others, so a window inside ranges gives the whole result and nothing is joined.
    """
    ranged, ranges = _ranged(table, [*by, value], rows)
    order = [F.col("_carry").desc(), F.col(value).desc() if back else F.col(value).asc()]
    own = Window.partitionBy("_r", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if ranges > 1:
        totals = ranged.groupBy(*by, "_r").agg(*[f(n).alias(n) for n in names])
        carry = _earlier(totals, by, names, f, ranges, level, back).where(F.coalesce(*names).isNotNull())
        ranged = ranged.withColumn("_carry", F.lit(False)).unionByName(carry.withColumn("_carry", F.lit(True)), allowMissingColumns=True)
    else:
        ranged = ranged.withColumn("_carry", F.lit(False))
    out = ranged.withColumns({f"{prefix}_{n}": f(n).over(own) for n in names})
    return out.where("not _carry").drop("_carry", "_r")


def prefix_sums(hist: DataFrame, by: list[str], value: str, sums: list[str], rows: int = RANGE_ROWS, level: int = LEVEL) -> DataFrame:
    """Running sums (``cum_<name>``) along value in each group; a null group is a group like any other.

    The histogram is written once. The number of its ranges, which run side by side, grows with its rows; a group may hold
    all of them. Sums must not be null.
    """
    return _scan(hist, by, value, sums, "cum", F.sum, False, rows, level)


def suffix_min(hist: DataFrame, value: str, name: str, rows: int = RANGE_ROWS, level: int = LEVEL) -> DataFrame:
    """The least ``name`` (``min_<name>``) of this and all larger values, in ranges as in prefix_sums."""
    return _scan(hist, [], value, [name], "min", F.min, True, rows, level)


def quantiles(hist: DataFrame, by: list[str], value: str, at: list[float], rows: int = RANGE_ROWS) -> DataFrame:
    """(by, q): exact quantiles of each group by linear interpolation on n - 1, from a histogram (by, value, n).

    Order statistics come from prefix sums, so no task holds the values of a group; only the values at the two ranks of each
    quantile are kept.
    """
    hist = written(hist.where(F.col(value).isNotNull()))
    total = hist.groupBy(*by).agg(F.sum("n").alias("_n"))
    sums = prefix_sums(hist, by, value, ["n"], rows)
    sums = join_on(sums, total, by) if by else sums.crossJoin(F.broadcast(total))  # a row a group
    place = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    holds = lambda k: (k < F.col("cum_n")) & (k >= F.col("cum_n") - F.col("n"))
    ends = [F.max(F.when(holds(k), F.col(value))) for q in at for k in (F.floor(place(q)), F.ceil(place(q)))]
    got = sums.groupBy(*by).agg(F.first("_n").alias("_n"), *[e.alias(f"_e{i}") for i, e in enumerate(ends)])

    def one(i, q):
        lo, hi = F.col(f"_e{2 * i}"), F.col(f"_e{2 * i + 1}")
        return lo + (hi - lo) * (place(q) - F.floor(place(q)))

    return got.select(*by, F.array(*[one(i, q) for i, q in enumerate(at)]).alias("q"))
