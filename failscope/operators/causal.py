"""Causal estimates from weighted sums, and graph reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import corr, r6, ratio, valid, written


def effects(df: DataFrame, t="t", y="y", ps="ps") -> DataFrame:
    """CS1, CS3, CS4, CS6, CS9: naive difference, plain and normalised IPW, odds-weighted ATT (the latter two with standard
    errors and 95 % intervals) and overlap. Rows with a null or NaN treatment, outcome or propensity take no part.

    Standard errors are those of weighted means: sqrt(sum(w² (y - mean)²)) / sum(w) on each side, from sums of w, w y, w²,
    w² y and w² y², so one pass is enough.
    """
    df = valid(df, t, y, ps)
    T, Y, e = F.col(t), F.col(y).cast("double"), F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col(ps)))
    sides = {"a": F.when(T == 1, 1 / e).otherwise(0.0), "b": F.when(T == 0, 1 / (1 - e)).otherwise(0.0), "o": F.when(T == 0, e / (1 - e)).otherwise(0.0), "t": F.when(T == 1, 1.0).otherwise(0.0)}
    sums = [F.sum(x).alias(f"{n}{k}") for n, w in sides.items() for k, x in (("w", w), ("y", w * Y), ("v", w * w), ("u", w * w * Y), ("z", w * w * Y * Y))]
    g = df.agg((F.avg(F.when(T == 1, Y)) - F.avg(F.when(T == 0, Y))).alias("naive"), F.avg(T * Y / e - (1 - T) * Y / (1 - e)).alias("ipw"),
               F.avg((~F.col(ps).between(0.05, 0.95)).cast("double")).alias("outside"), F.min(ps).alias("ps_min"), F.max(ps).alias("ps_max"), *sums)
    mean = lambda n: F.try_divide(F.col(f"{n}y"), F.col(f"{n}w"))
    var = lambda n: F.try_divide(F.col(f"{n}z") - 2 * mean(n) * F.col(f"{n}u") + mean(n) * mean(n) * F.col(f"{n}v"), F.col(f"{n}w") * F.col(f"{n}w"))
    out = g.select("*", (mean("a") - mean("b")).alias("ipw_normalised"), F.sqrt(var("a") + var("b")).alias("ipw_se"), (mean("t") - mean("o")).alias("att"), F.sqrt(var("t") + var("o")).alias("att_se"))
    ends = [(F.col(c) + s * 1.959964 * F.col(f"{'ipw' if c[0] == 'i' else c}_se")).alias(f"{c}_{n}") for c in ("ipw_normalised", "att") for s, n in ((-1, "low"), (1, "high"))]
    out = out.select("*", *ends)
    shown = ["naive", "ipw", "ipw_normalised", "ipw_se", "ipw_normalised_low", "ipw_normalised_high", "att", "att_se", "att_low", "att_high", "outside", "ps_min", "ps_max"]
    return out.select(*[r6(c).alias(c) for c in shown], (F.col("outside") < 0.1).alias("valid_overlap"))


def diff_in_diff(df: DataFrame, t="t", post="post", y="y") -> DataFrame:
    """CS10: difference in differences from the four cell means."""
    cell = lambda a, b: F.avg(F.when((F.col(t) == a) & (F.col(post) == b), F.col(y)))
    return df.agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d")).select(r6("a").alias("treated_post"), r6("b").alias("treated_pre"), r6("c").alias("control_post"), r6("d").alias("control_pre"), r6(F.col("a") - F.col("b") - F.col("c") + F.col("d")).alias("did"))


def two_stage(df: DataFrame, z: str, t: str, y: str) -> DataFrame:
    """CS14: two-stage least squares by covariances, with the first stage's F."""
    s = df.agg(F.covar_samp(z, y).alias("zy"), F.covar_samp(z, t).alias("zt"), corr(z, t).alias("r"), F.count(F.lit(1)).alias("n"))
    r2 = F.col("r") * F.col("r")
    return s.select(r6(ratio("zy", "zt")).alias("effect"), F.round(r2 / (1 - r2) * (F.col("n") - 2), 2).alias("first_stage_f"))


def simpson(df: DataFrame, t="t", y="y", stratum="stratum") -> DataFrame:
    """CS15, CS16: effect and correlation in each stratum and over all (``whole``), in one rollup, with both verdicts: every
    stratum's correlation has the sign opposite to the whole's; more than one stratum has an effect, all of one sign, and
    the whole's is the other. A null stratum is a stratum; no sign is 0."""
    T, Y = F.col(t), F.col(y)
    g = df.rollup(stratum).agg(F.count(F.lit(1)).alias("n"), (F.avg(F.when(T == 1, Y)) - F.avg(F.when(T == 0, Y))).alias("effect"), corr(t, y).alias("r"), (F.grouping(stratum) == 1).alias("whole"))
    part, sign = ~F.col("whole"), lambda c: F.signum(F.col(c))
    v = g.agg(F.max(F.when(F.col("whole"), sign("r"))).alias("_r"), F.max(F.when(F.col("whole"), sign("effect"))).alias("_e"), *[f(F.when(part, sign(c))).alias(f"{n}{c}") for c in ("r", "effect") for n, f in (("lo", F.min), ("hi", F.max))], F.count_if(part & F.col("effect").isNotNull()).alias("k"))
    one = lambda c: (F.col(f"lo{c}") == F.col(f"hi{c}")) & (F.col(f"lo{c}") != 0)
    v = v.select(F.coalesce(one("r") & (F.col("lor") == -F.col("_r")), F.lit(False)).alias("paradox_by_correlation"), F.coalesce(one("effect") & (F.col("k") > 1) & (F.col("loeffect") != F.col("_e")), F.lit(False)).alias("paradox_by_effect"))
    return g.crossJoin(F.broadcast(v)).select("whole", F.col(stratum).alias("stratum"), "n", r6("effect").alias("effect"), r6("r").alias("r"), "paradox_by_correlation", "paradox_by_effect")


def roles(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """GR4, GR6: (x, y, node, role, advice) of the direct neighbours of the pairs (x, y): a parent of both is a confounder
    (adjust), a child of both a collider (do not adjust), a child of x that is a parent of y a mediator (do not adjust), any
    other parent of x is in the parent adjustment set (adjust)."""
    pairs = written(pairs.distinct())
    named = pairs.select(F.col("x").alias("a")).unionByName(pairs.select(F.col("y").alias("a"))).distinct()
    # up: node is a parent of a; down: a child. No table of all neighbours of all pairs is made
    ends = edges.select(F.col("dst").alias("a"), F.col("src").alias("node"), F.lit(True).alias("up")).unionByName(edges.select(F.col("src").alias("a"), F.col("dst").alias("node"), F.lit(False).alias("up")))
    near = ends.where("a is not null and node is not null").join(named, "a", "left_semi")
    near = written(near.groupBy("node", "a").agg(F.max("up").alias("up"), F.max(~F.col("up")).alias("down")))
    of = lambda c, u, d: near.select("node", F.col("a").alias(c), F.col("up").alias(u), F.col("down").alias(d))
    # every role needs a parent or a child of x: only parents have one without y, so children of x must be neighbours of y
    x, y = of("x", "px", "cx"), of("y", "py", "cy")
    parents = x.where("px").join(pairs, "x").join(y, ["y", "node"], "left").select("x", "y", "node", "px", "cx", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("py", "cy")])
    children = x.where("not px").join(pairs, "x").join(y, ["y", "node"]).select("x", "y", "node", "px", "cx", "py", "cy")
    g = parents.unionByName(children).where("node <> x and node <> y")
    role = F.when(F.col("px") & F.col("py"), "confounder").when(F.col("cx") & F.col("cy"), "collider").when(F.col("cx") & F.col("py"), "mediator").when(F.col("px"), "parent")
    return g.withColumn("role", role).where("role is not null").select("x", "y", "node", "role", F.when(F.col("role").isin("confounder", "parent"), "adjust").otherwise("do not adjust").alias("advice"))
