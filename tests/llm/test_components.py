"""Union-find over edges ends as soon as they are stars."""

from failscope.llm import common


def test_stars_take_no_round_and_paths_take_no_last_one(spark, monkeypatch):
    written = []
    monkeypatch.setattr(common, "cut", lambda df, name, f=common.cut: written.append(name) or f(df, name))
    of = lambda pairs: dict(map(tuple, common.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()))
    assert of([(1, 5), (6, 1), (2, 9), (9, 2), (3, 3)]) == {1: 1, 5: 1, 6: 1, 2: 2, 9: 2} and len(written) == 1
    written.clear()
    assert of([(4, 7), (7, 9)]) == {4: 4, 7: 4, 9: 4} and len(written) == 2
    written.clear()
    assert of([(i, i + 1) for i in range(40)]) == dict.fromkeys(range(41), 0)
