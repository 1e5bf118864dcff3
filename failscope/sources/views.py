"""Audit inputs as views over the given tables: one SQL text each, read by Spark here and by the oracle as it is."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def draw(key: str, salt: str) -> str:
    """A draw in [0, 1) that depends on key and salt alone, equal in every SQL engine with md5."""
    hk = f"md5(concat(cast({key} as string), ':{salt}'))"
    digit = lambda i: f"(instr('0123456789abcdef', substr({hk}, {i}, 1)) - 1)"
    return f"(({digit(1)} * 4096 + {digit(2)} * 256 + {digit(3)} * 16 + {digit(4)}) / 65536e0)"


VIEWS = {
    "scored": f"""select o_orderkey as row_id, o_custkey as custkey, y_true, round(least(0.9999e0, 0.05e0 + 0.45e0 * {draw('o_orderkey', 'a')} + y_true * 0.5e0 * {draw('o_orderkey', 'b')}), 3) as y_prob,
        o_orderpriority as grp, o_orderdate as ts from (select *, case when o_orderstatus = 'F' then 1 else 0 end as y_true from {{orders}}) o""",
    "scored2": f"""select s.*, c_mktsegment as segment, case when y_prob >= 0.5e0 then 1 else 0 end as y_pred,
        case when {draw('row_id', 'c')} < 0.1e0 then 1 - (case when y_prob >= 0.5e0 then 1 else 0 end) else (case when y_prob >= 0.5e0 then 1 else 0 end) end as y_pred2
        from ({{scored}}) s join {{customer}} on custkey = c_custkey""",
    "regress": f"select o_orderkey as row_id, o_orderpriority as grp, cast(o_totalprice as double) as y, cast(o_totalprice as double) * (0.8e0 + 0.4e0 * {draw('o_orderkey', 'd')}) as yhat from {{orders}}",
    "multi": f"""select vec_id as row_id, label % 3 as y_true, w0 / (w0 + w1 + w2) as p0, w1 / (w0 + w1 + w2) as p1, w2 / (w0 + w1 + w2) as p2 from (
        select vec_id, label, {draw('vec_id', 'm0')} + (case when label % 3 = 0 then 1e0 else 0e0 end) + 0.001e0 as w0, {draw('vec_id', 'm1')} + (case when label % 3 = 1 then 1e0 else 0e0 end) + 0.001e0 as w1,
        {draw('vec_id', 'm2')} + (case when label % 3 = 2 then 1e0 else 0e0 end) + 0.001e0 as w2 from {{embeddings}}) m""",
    "noisy": f"select m.*, case when {draw('row_id', 'n')} < 0.15e0 then (y_true + 1) % 3 else y_true end as y_noisy from ({{multi}}) m",
    "gappy": f"""select row_id, custkey, case when {draw('row_id', 'g')} < 0.02e0 then null else y_true end as y_true, case when {draw('row_id', 'h')} < 0.02e0 then null when {draw('row_id', 'h')} < 0.03e0 then cast('nan' as double) else y_prob end as y_prob,
        case when {draw('row_id', 'i')} < 0.02e0 then null else grp end as grp, ts from ({{scored}}) s""",
    "cohorts": f"""select event_id as row_id, case when ts < timestamp '2024-01-16' then 'reference' else 'current' end as cohort, feature, case when {draw('event_id', 'q')} < (case when ts < timestamp '2024-01-16' then 0.01e0 else 0.09e0 end) then null
        when feature = 'value' then cast(value as double) * (case when ts < timestamp '2024-01-16' then 1e0 else 1.3e0 end) when feature = 'hour' then cast(extract(hour from ts) as double) else cast(user_id as double) end as value
        from {{events}} cross join (select 'value' as feature union all select 'hour' union all select 'user_id') f""",
    "study": f"""select row_id, t, y, x1, x2, stratum, ps, post, case when {draw('row_id', 's')} < 0.25e0 then 'test' else 'train' end as role, o_orderdate as ts from ({{treat}}) s join {{orders}} on row_id = o_orderkey""",
    "wide": """select event_id as row_id, case when ts < timestamp '2024-01-16' then 'reference' else 'current' end as cohort, cast(value as double) * (case when ts < timestamp '2024-01-16' then 1e0 else 1.3e0 end) as v, cast(extract(hour from ts) as double) as h, cast(user_id as double) as u from {events}""",
    "cat_cohorts": f"""select event_id as row_id, case when ts < timestamp '2024-01-16' then 'reference' else 'current' end as cohort,
        case when event_type = 'view' and ts >= timestamp '2024-01-16' and {draw('event_id', 'k')} < 0.3e0 then 'refund' else event_type end as category from {{events}}""",
    "gaps": f"""select c_custkey as row_id, case when {draw('c_custkey', 'm')} < 0.1e0 then null else cast(c_acctbal as double) end as acctbal,
        case when c_mktsegment = 'MACHINERY' and {draw('c_custkey', 'r')} < 0.5e0 then null else cast(c_nationkey as double) end as nation,
        case when c_acctbal > 8000 then null else cast(c_acctbal as double) end as balance, c_mktsegment as seg, case when c_acctbal > 5000 then 1 else 0 end as y from {{customer}}""",
    "treat": f"""select row_id, t, post, 2e0 * t + x1 / 1000e0 + {draw('row_id', 'e')} as y, x1, x2, stratum, ps from (
        select o_orderkey as row_id, case when {draw('o_orderkey', 't')} < (case when c_acctbal > 5000 then 0.7e0 else 0.3e0 end) then 1 else 0 end as t,
        case when o_orderdate >= timestamp '1998-01-01' then 1 else 0 end as post, cast(c_acctbal as double) as x1, cast(o_totalprice as double) as x2, c_mktsegment as stratum,
        case when c_acctbal > 5000 then 0.7e0 else 0.3e0 end as ps from {{orders}} join {{customer}} on o_custkey = c_custkey) s""",
    "edges": """select concat('R', cast(n_regionkey as string)) as src, concat('N', cast(n_nationkey as string)) as dst from {nation}
        union all select concat('N', cast(c_nationkey as string)), concat('C', cast(c_custkey as string)) from {customer}""",
    "trade": """select src, dst from ({edges}) e union all select concat('N', cast(s_nationkey as string)), concat('S', cast(s_suppkey as string)) from {supplier}
        union all select distinct concat('C', cast(o_custkey as string)), p_brand from {orders} join {lineitem} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey
        union all select distinct concat('S', cast(l_suppkey as string)), p_brand from {lineitem} join {part} on l_partkey = p_partkey""",
    "node_pairs": """select a.x, b.y from (select concat('N', cast(n_nationkey as string)) as x from {nation}) a join (select concat('N', cast(n_nationkey as string)) as y, 1 as same from {nation}
        union all select distinct p_brand, 0 from {part}) b on same = 0 or x < y""",
    "tests": f"select o_orderkey as test_id, pow({draw('o_orderkey', 'p')}, 3) as p_value from {{orders}}",
}


#: Rows that are known, for measures that leave out nulls and NaN.
KNOWN = {
    "gappy": "y_true is not null and y_prob is not null and not isnan(y_prob)",
    "cohorts": "value is not null",
}


def text(name: str) -> str:
    """The SQL of a view over the tables alone, for the oracle."""
    own = {v: f"({text(v)})" for v in VIEWS if f"({{{v}}})" in VIEWS[name]}
    out = VIEWS[name]
    for v, sql in own.items():
        out = out.replace(f"({{{v}}})", sql)
    for t in TABLES:
        out = out.replace(f"{{{t}}}", t)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A draw in the views' texts.
_DRAW = re.compile(re.escape(draw("KEY", "SALT")).replace("KEY", r"(?P<key>\w+)", 1).replace("SALT", r"(?P<salt>\w+)", 1).replace("KEY", "(?P=key)").replace("SALT", "(?P=salt)"))


def _one_digest(m: re.Match) -> str:
    """The same number from one digest: Spark evaluates the text's four."""
    return f"(cast(conv(substr(md5(concat(cast({m['key']} as string), ':{m['salt']}')), 1, 4), 16, 10) as int) / 65536e0)"


def load(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A view as a DataFrame. With ``spread`` its tables' rows are dealt out evenly first, so that its draws are made by all
    cores where a file has few splits."""
    sql = VIEWS[name]
    while any(f"({{{v}}})" in sql for v in VIEWS):
        for v in VIEWS:
            sql = sql.replace(f"({{{v}}})", f"({VIEWS[v]})")
    sql = _DRAW.sub(_one_digest, sql)
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
    if spread:
        used = {t: df.repartition(2 * spark.sparkContext.defaultParallelism) for t, df in used.items()}
    return spark.sql(sql, **used)
