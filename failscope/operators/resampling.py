"""Bootstrap intervals: every row has a vector of weights, one a replicate, and vectors are summed.

A row's weights are Poisson(1) draws from a hash of its key, so a run can be repeated on any partitioning, and no row is
copied for a replicate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import clean, r6, written

#: Rows whose weights are drawn at once.
AT_ONCE = 512
#: Rows of a range of values in which a quantile is looked for, and most ranges.
RANGE_ROWS, RANGES = 4096, 4096

# The chances of 0, 1, 2, ... of a Poisson variable of mean 1 are 1/e over the factorials.
_EDGES = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
#: The weight at each of 65536 equally likely draws.
_WEIGHTS = np.searchsorted(_EDGES, (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.uint8)


def weights(keys: np.ndarray, replicates: int) -> np.ndarray:
    """(keys, replicates) Poisson(1) weights from 64-bit keys; a mixed counter gives four draws of 16 bits each."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64)[:, None] + np.arange(1, (replicates + 3) // 4 + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return _WEIGHTS[x.view(np.uint16)][:, :replicates]


def _sums(rows: DataFrame, by: list[str], moments: int, replicates: int) -> DataFrame:
    """(by, replicate, s0, s1, ...) sums over rows (h, v) of weights and of weights times powers of v. A task sums its rows'
    vectors and sends one row a group and replicate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for group, own in batch.groupby(by, sort=False):
                h, v = own["h"].to_numpy(), own["v"].to_numpy(np.float64)
                powers = np.stack([v**k for k in range(moments)])
                total = held.setdefault(group, np.zeros((moments, replicates)))
                for at in range(0, len(h), AT_ONCE):
                    total += powers[:, at : at + AT_ONCE] @ weights(h[at : at + AT_ONCE], replicates).astype(np.float64)
        for group, total in held.items():
            yield pd.DataFrame(dict(zip(by, group)) | {"replicate": np.arange(replicates, dtype=np.int32)} | {f"s{k}": total[k] for k in range(moments)})

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "replicate int", *(f"s{k} double" for k in range(moments))])
    return rows.mapInPandas(run, schema).groupBy(*by, "replicate").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(moments)])


def _quantile(rows: DataFrame, q: float, replicates: int, range_rows: int) -> DataFrame:
    """(side, replicate, stat): the least value at which a replicate's running weight reaches q of its whole.

    Values are dealt into ranges. A replicate's weights by range (a histogram of its own) tell in which one its quantile lies;
    only there rows are put in order, for those replicates alone.
    """
    n = rows.count()
    ranges = max(1, min(RANGES, math.ceil(n / range_rows)))
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)]) if ranges > 1 else F.array(F.lit(0.5))
    bounds = np.unique(rows.agg(F.percentile_approx("v", at, 100 * ranges).alias("b")).first()["b"] or []) if ranges > 1 else np.zeros(0)  # RANGES numbers at most
    shared = rows.sparkSession.sparkContext.broadcast(bounds)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(range=np.searchsorted(shared.value, batch["v"].to_numpy(), side="left").astype(np.int32))

    rows = written(rows.mapInPandas(place, "h bigint, v double, side int, range int"))
    hist = written(_sums(rows, ["side", "range"], 1, replicates))
    own = Window.partitionBy("side", "replicate")
    run = F.sum("s0").over(own.orderBy("range"))
    hist = hist.select("side", "replicate", "range", "s0", run.alias("to"), (F.lit(q) * F.sum("s0").over(own)).alias("aim"))
    hit = hist.where((F.col("to") >= F.col("aim")) & (F.col("to") - F.col("s0") < F.col("aim")) | (F.col("aim") == 0) & (F.col("to") == F.col("s0")))
    wanted = hit.groupBy("side", "range").agg(F.sort_array(F.collect_list(F.struct("replicate", (F.col("aim") - F.col("to") + F.col("s0")).alias("rest")))).alias("wanted"))

    def look(key, part: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(want):
            return pd.DataFrame({"side": pd.Series(dtype="int32"), "replicate": pd.Series(dtype="int32"), "stat": pd.Series(dtype="float64")})
        part = part.sort_values("v", kind="stable")
        h, v = part["h"].to_numpy(), part["v"].to_numpy()
        reps = np.array([r["replicate"] for r in want["wanted"].iloc[0]], np.int32)
        rest = np.array([r["rest"] for r in want["wanted"].iloc[0]])
        stat, before = np.full(len(reps), np.nan), np.zeros(len(reps), np.int64)
        for at in range(0, len(h), AT_ONCE):
            run = before + weights(h[at : at + AT_ONCE], replicates)[:, reps].cumsum(axis=0, dtype=np.int64)
            there = (run >= rest - 1e-9) & (run > 0)
            new = np.isnan(stat) & there.any(axis=0)
            stat[new] = v[at + there[:, new].argmax(axis=0)]
            before = run[-1]
        return pd.DataFrame({"side": np.int32(key[0]), "replicate": reps, "stat": stat})

    return rows.groupBy("side", "range").cogroup(wanted.groupBy("side", "range")).applyInPandas(look, "side int, replicate int, stat double")


def replicated(df: DataFrame, value: str, key: str, group: str | None = None, a=None, b=None, statistic: str = "mean", q: float = 0.5, replicates: int = 2000, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(replicate, stat): the statistic in every replicate, of all rows or, with a group, of a's less b's."""
    side = F.lit(0) if group is None else F.when(F.col(group) == a, 0).when(F.col(group) == b, 1)
    rows = df.select(F.xxhash64(F.col(key).cast("string")).alias("h"), clean(value).alias("v"), side.cast("int").alias("side")).where("v is not null and side is not null")
    if statistic in ("median", "quantile"):
        each = _quantile(written(rows), 0.5 if statistic == "median" else q, replicates, range_rows)
    else:
        s = _sums(rows, ["side"], 3 if statistic in ("var", "std") else 2, replicates)
        mean = F.try_divide("s1", "s0")
        var = lambda: F.greatest(F.try_divide(F.col("s2") - F.col("s1") * mean, F.col("s0") - 1), F.lit(0.0))
        of = {"mean": lambda: mean, "sum": lambda: F.col("s1"), "var": var, "std": lambda: F.sqrt(var())}[statistic]()
        each = s.select("side", "replicate", of.alias("stat"))
    if group is None:
        return each.select("replicate", "stat")
    of = lambda k: F.max(F.when(F.col("side") == k, F.col("stat")))
    return each.groupBy("replicate").agg((of(0) - of(1)).alias("stat"))


def bootstrap(df: DataFrame, value: str, key: str, group: str | None = None, a=None, b=None, statistic: str = "mean", q: float = 0.5, replicates: int = 2000, level: float = 0.95) -> DataFrame:
    """HT9: percentile interval of a statistic (mean, sum, var, std, median, or quantile with its q) by a Poisson bootstrap;
    HT10 with group: of the difference between a and b, significant where 0 is outside.

    Rows whose value is null or NaN, or which are of no side, take no part. Rows of one key have one weight. ``estimate`` is
    of the rows as they are (quantiles: the least value that q of the rows do not exceed). Without rows all is null.
    """
    each = written(replicated(df, value, key, group, a, b, statistic, q, replicates)).where("stat is not null")
    v = lambda k: F.when(F.lit(True) if group is None else F.col(group) == k, clean(value))
    plain = {"mean": F.avg, "sum": F.sum, "var": F.var_samp, "std": F.stddev_samp}
    exact = lambda c: F.expr(f"percentile_disc({0.5 if statistic == 'median' else q}) within group (order by {c})")
    sides = df.select(v(a).alias("_a"), v(b).alias("_b"))
    one = lambda c: exact(c) if statistic in ("median", "quantile") else plain[statistic](c)
    estimate = sides.agg((one("_a") if group is None else one("_a") - one("_b")).alias("estimate"))
    tail = (1 - level) / 2
    ends = each.agg(F.percentile("stat", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))  # a row a replicate
    low, high = F.col("q")[0], F.col("q")[1]
    return estimate.crossJoin(F.broadcast(ends)).select(r6("estimate").alias("estimate"), r6(low).alias("low"), r6(high).alias("high"), ((low > 0) | (high < 0)).alias("significant"))
