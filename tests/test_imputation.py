"""Chained imputation of numbers, classes and texts."""

import numpy as np
from pyspark.sql import functions as F

from failscope.operators import imputation as im

KIND = "row_id int, a double, b double, c string, y int, n bigint, none string"


def table(spark, n=900, seed=2):
    rng = np.random.default_rng(seed)
    rows, hidden = [], {}
    for i in range(n):
        a = float(rng.normal())
        b, c, y, k = 2 * a + 1 + 0.01 * float(rng.normal()), "abc"[int(np.digitize(a, [-0.6, 0.6]))], int(a > 0), round(10 * a)
        row = [i, a, b, c, y, k, None]
        hidden[i] = row[:]
        gap = rng.integers(0, 14)
        if gap in (2, 3, 4, 5):
            row[gap] = None if gap != 2 or i % 2 else float("nan")
        rows.append(tuple(row))
    return spark.createDataFrame(rows, KIND), rows, hidden


def test_planted_relations_are_recovered_and_types_kept(spark):
    df, rows, hidden = table(spark)
    out = im.impute(df, ["a", "b", "c", "y", "n", "none"])
    assert [t for t in out.dtypes] == [("row_id", "int"), ("a", "double"), ("b", "double"), ("c", "string"), ("y", "int"), ("n", "bigint"), ("none", "string")]
    got, off, right = {r.row_id: tuple(r) for r in out.collect()}, [], {3: [], 4: []}
    assert len(got) == len(rows) and all(r[6] is None for r in got.values())
    for row in rows:
        for at, v in enumerate(row[:6]):
            new = got[row[0]][at]
            if v is not None and v == v:
                assert new == v
            elif at in right:
                right[at].append(new == hidden[row[0]][at])
            elif at == 2:
                off.append(abs(new - hidden[row[0]][2]))
            else:
                assert isinstance(new, int) and abs(new - hidden[row[0]][at]) <= 2
    assert max(off) < 0.6 and np.mean(off) < 0.1  # the tail of c is drawn
    assert np.mean(right[4]) > 0.85 and np.mean(right[3]) > 0.75


def test_a_rerun_is_equal_and_imputations_differ(spark):
    df, rows, _ = table(spark, 300)
    cols = ["a", "b", "c", "y"]
    one = sorted(map(tuple, im.impute_many(df, cols, m=3, cycles=2).collect()))
    assert one == sorted(map(tuple, im.impute_many(df.repartition(5), cols, m=3, cycles=2).collect()))
    assert len(one) == 900 and {r[0] for r in one} == {0, 1, 2}
    gaps = [r[0] for r in rows if r[2] is None or r[2] != r[2]]
    by = {(r[0], r[1]): r for r in one}
    assert sum(by[0, i] != by[1, i] for i in gaps) > 0.9 * len(gaps)


def test_classes_are_drawn_by_their_chances(spark):
    rows = [(i, ["x", "y", "y", "y"][i % 4] if i % 2 or i % 8 < 4 else None) for i in range(4000)]
    seen = [c for _, c in rows if c]
    out = im.impute(spark.createDataFrame(rows, "row_id int, c string"), ["c"], cycles=1)
    drawn = [r.c for r in out.where(F.col("row_id") % 8 >= 4).where(F.col("row_id") % 2 == 0).collect()]
    assert abs(np.mean([c == "x" for c in drawn]) - seen.count("x") / len(seen)) < 0.04


def test_nothing_and_many_texts(spark):
    df = spark.createDataFrame([(i, f"t{i % 30}" if i % 5 else None, 1.0) for i in range(200)], "row_id int, t string, one double")
    got = im.impute(df, ["t", "one"], cycles=1)
    assert got.count() == 200 and got.where("t is null").count() == 0
    assert im.impute_many(df.limit(0), ["t", "one"]).count() == 0


def test_class_draws_name_each_score_once(spark):
    from pyspark.sql import functions as F

    from failscope.operators import imputation as im

    names = ["a", "b", "c"]
    d = spark.range(50).select(*[F.sin(F.col("id") * (i + 1)).alias(n) for i, n in enumerate(names)], (F.col("id") / 50).alias("_u"))
    d = d.withColumns({"_w": F.lit([[0.5, 1.0, -1.0], [2.0, 0.0, 0.3], [0.1, -0.4, 0.9], [1.0, 1.0, 1.0]]), "_b": F.array(*map(F.lit, [0.1, 0.2, -0.3, 0.0]))})
    whole = im.draw_steps(names, 4)
    for columns in whole:
        d = d.withColumns(columns)
    from failscope.operators.folds import probabilities

    p = probabilities(F.col("_w"), F.col("_b"), names, 4)
    drawn, total = F.lit(0.0), F.lit(0.0)
    for q in p[:-1]:
        total = total + q
        drawn = drawn + (F.col("_u") >= total).cast("double")
    assert d.where(F.col("_drawn") != drawn).count() == 0 and d.select("_drawn").distinct().count() > 1
    assert max(str(c).count("exp(") for columns in whole for c in columns.values()) <= 1
