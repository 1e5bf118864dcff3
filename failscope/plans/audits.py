"""More registered queries with their SQL, by part of the survey. p-values have no counterpart in the SQL and are left out of
those queries; tests hold them against known values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity as ac
from ..operators import attribution as xp
from ..operators import calibration as ca
from ..operators import calibrators as cb
from ..operators import causal as cs
from ..operators import charts as ch
from ..operators import drift as dr
from ..operators import estimates as es
from ..operators import evaluation as ev
from ..operators import fairness as fa
from ..operators import folds as fo
from ..operators import governance as gv
from ..operators import graphs as gr
from ..operators import imputation as im
from ..operators import leakage as lk
from ..operators import missing as md
from ..operators import models as bm
from ..operators import noise as ln
from ..operators import prep as pr
from ..operators import resampling as rs
from ..operators import slices as sl
from ..operators import splits as vs
from ..operators import stats as st
from ..operators import treeshap as ts
from ..sources import files as io
from ..sources.views import draw, load, table, text
from ..streaming import monitors as mon
from .registry import _B, _M, _R, BOUNDS, CONF, CUMS, GAPS, KS, P3, PSI, TABLE, THR, TWO, D, _add, _argmax, _put

r = "round({}, 6)".format
ARGMAX = "case when p0>=p1 and p0>=p2 then 0 when p1>=p2 then 1 else 2 end"

# evaluation
_add("ev5_kappa_any_classes", "multi", lambda d: ev.kappa(d.withColumn("y_pred", _argmax())), f"""
    with c as (select y_true a, {ARGMAX} p from {{v}}), t as (select count(*) n, sum(case when a=p then 1e0 else 0e0 end)/count(*) o from c),
    e as (select sum(na*np)/max(n*n) e from (select a k, cast(count(*) as double) na from c group by 1) x join (select p k, cast(count(*) as double) np from c group by 1) y using (k), t)
    select {r('o')} agreement, {r('e')} chance, {r('(o-e)/(1-e)')} kappa from t, e""")
_add("ev11_pr_points", "gappy", lambda d: ev.pr_points(ev.threshold_table(d)), f"select round(tp/{D('tp+fn')},6) recall, round(tp/{D('tp+fp')},6) as precision from ({TABLE}) union select 0e0, 1e0")
_add("ev13_pr_auc", "gappy", ev.pr_auc, f"""
    with p as (select threshold, tp/{D('ap')} r, tp/{D('tp+fp')} q from ({CUMS})),
    s as (select r - lag(r, 1, 0e0) over (order by threshold desc) w, (q + lag(q, 1, 1e0) over (order by threshold desc)) / 2 h from p) select {r('sum(w*h)')} pr_auc from s""")
REPORT = f"""with c as (select y_true a, {ARGMAX} p from {{v}}), r as (select a k, count(*) support, sum(case when a=p then 1e0 else 0e0 end) hit from c group by 1), q as (select p k, count(*) claimed from c group by 1),
    j as (select r.k, support, hit, hit/claimed p, hit/support r, 2*hit/(claimed+support) f from r join q on r.k=q.k)"""
_add("ev15_class_report", "multi", lambda d: ev.class_report(d.withColumn("y_pred", _argmax())), f"""{REPORT}
    select cast(k as varchar) as row, support, {r('p')} as precision, {r('r')} recall, {r('f')} f1 from j union all select 'macro', cast(sum(support) as bigint), {r('avg(p)')}, {r('avg(r)')}, {r('avg(f)')} from j
    union all select 'weighted', cast(sum(support) as bigint), {r('sum(p*support)/sum(support)')}, {r('sum(r*support)/sum(support)')}, {r('sum(f*support)/sum(support)')} from j
    union all select 'accuracy', cast(sum(support) as bigint), {r('sum(hit)/sum(support)')}, {r('sum(hit)/sum(support)')}, {r('sum(hit)/sum(support)')} from j""")
_add("ev16_summary", "gappy", lambda d: ev.summary(d).select("tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1", "f2", "mcc", "auc", "average_precision", "log_loss", "ece", "best_threshold", "best_f1"), f"""
    with k as (select {CONF} from (select y_true, case when y_prob>=0.5 then 1 else 0 end y_pred from {{v}})), m as ({CUMS}), l as (select *, lag(tp,1,0) over (order by threshold desc) lt, lag(fp,1,0) over (order by threshold desc) lf from m)
    select cast(tp as bigint) tp, cast(fp as bigint) fp, cast(tn as bigint) tn, cast(fn as bigint) fn, {r(f"(tp+tn)/{D('tp+fp+tn+fn')}")} accuracy, {r(f"tp/{D('tp+fp')}")} as precision, {r(f"tp/{D('tp+fn')}")} recall, {r(f"2e0*tp/{D('2*tp+fp+fn')}")} f1, {r(f"5e0*tp/{D('5*tp+4*fn+fp')}")} f2,
    {r(f"({D('tp')}*tn-{D('fp')}*fn)/sqrt({D('tp+fp')}*(tp+fn)*(tn+fp)*(tn+fn))")} mcc, (select {r(f"sum((fp-lf)*(tp+lt)/2e0)/max({D('ap')}*an)")} from l) auc, (select {r(f"sum((tp-lt)/{D('ap')}*tp/{D('tp+fp')})")} from l) average_precision,
    (select {r('-avg(case when y_true=1 then ln(greatest(1e-15,y_prob)) else ln(1-least(1-1e-15,y_prob)) end)')} from {{v}}) log_loss, (select {r('sum(n*abs(fp-mp))/sum(n)')} from ({_B('')})) ece, b.threshold best_threshold, b.f1 best_f1
    from k, (select threshold, round(round(2e0*tp/{D('2*tp+fp+fn')},6),4) f1 from ({TABLE}) order by f1 desc, threshold desc limit 1) b""")
_add("ev17_regression", "regress", lambda d: ev.regression(d, by=["grp"]), """
    select grp, n, round(mse,2) mse, round(sqrt(mse),4) rmse, round(mae,4) mae, round(mape,6) mape, round(smape,6) smape, round(1-mse/vy,6) r2, round(1-(mse/vy)*(n-1e0)/(n-2e0),6) adjusted_r2, round(me,3) mean_residual, round(se,3) std_residual, round(worst,4) max_abs_error,
    abs(me) > 2*se/sqrt(n) biased, round(1-ve/vy,6) explained_variance, round(medae,4) median_abs_error from (select grp, count(*) n, avg((y-yhat)*(y-yhat)) mse, avg(abs(y-yhat)) mae, avg(abs(y-yhat)/greatest(abs(y),1e-8)) mape, max(abs(y-yhat)) worst, quantile_cont(abs(y-yhat),0.5) medae,
    avg(2*abs(y-yhat)/greatest(abs(y)+abs(yhat),1e-8)) smape, var_pop(y) vy, var_pop(y-yhat) ve, avg(y-yhat) me, stddev_samp(y-yhat) se from {v} group by 1)""")
_add("ev21_compare_models", "scored2", lambda d: ev.compare_models(d, ["y_pred", "y_pred2"]), f"""
    with l as (select 'y_pred' model, y_true, y_pred from {{v}} union all select 'y_pred2', y_true, y_pred2 from {{v}}), t as (select model, {r(f"(tp+tn)/{D('tp+fp+tn+fn')}")} accuracy, {r(f"tp/{D('tp+fp')}")} as precision, {r(f"tp/{D('tp+fn')}")} recall, {r(f"2e0*tp/{D('2*tp+fp+fn')}")} f1
    from (select model, {CONF} from l group by 1)) select *, f1 = (select max(f1) from t) best from t""")
_add("ev23_confusion_patterns", "multi", lambda d: ev.confusion_patterns(d.withColumn("y_pred", _argmax())), f"""
    with c as (select y_true actual, {ARGMAX} predicted, count(*) n from {{v}} group by 1,2), t as (select *, round(n/sum(n) over (partition by actual),6) rate, round(sum(case when actual=predicted then n else 0 end) over (partition by actual)/{D('sum(n) over (partition by actual)')},6) recall,
    round(max(case when actual=predicted then n end) over (partition by actual)/{D('1')},6) hit from c), k as (select predicted p, sum(n) claimed from c group by 1)
    select actual, predicted, n, rate, rank, recall, round(hit/claimed,6) as precision from (select *, cast(row_number() over (partition by actual order by n desc, predicted) as integer) as rank from t where actual<>predicted) join k on k.p=actual where rank<=3""")

# calibration
_add("ca9_compare", "gappy", lambda d: ca.compare(d.withColumn("squared", F.col("y_prob") * F.col("y_prob")), "y_prob", "squared"), f"""
    with l as (select 'y_prob' score, y_true, y_prob p from {{v}} union all select 'squared', y_true, y_prob*y_prob from {{v}}), b as (select score, least(floor(p*10),9) bin, count(*) n, avg(p) mp, avg(cast(y_true as double)) fp from l group by 1,2),
    e as (select score, {r('sum(n*abs(fp-mp))/sum(n)')} ece, {r('max(abs(fp-mp))')} mce from b group by 1), s as (select score, {r('avg((p-y_true)*(p-y_true))')} brier, {r('1-avg((p-y_true)*(p-y_true))/var_pop(cast(y_true as double))')} skill from l group by 1), t as (select * from e join s using (score)),
    c as (select {', '.join(f"{r(f'a.{x}-b.{x}')} {x}_change" for x in ('ece', 'mce', 'brier', 'skill'))} from t a, t b where a.score='y_prob' and b.score='squared') select t.*, c.*, ece_change>0 improved from t, c""")
_add("ca10_by_group", "gappy", lambda d: ca.by_group(d, "grp"), f"""
    with e as (select grp, cast(sum(n) as bigint) n, sum(n*abs(fp-mp))/sum(n) ece from ({_B('grp,')}) group by 1) select grp, n, {r('ece')} ece, (select grp from e order by ece desc limit 1) worst_group, round((select max(ece)-min(ece) from e),6) ece_gap from e""")
halves = lambda d: (d.where(pr.draw_of("row_id", "cal") < 0.5), d.where(pr.draw_of("row_id", "cal") >= 0.5))
_add("ca6_platt", "gappy", lambda d: d.select("row_id", F.round(cb.platt_apply(F.nanvl("y_prob", F.lit(None).cast("double")), cb.platt(d)), 4).alias("p")))
_add("ca7_temperature", "gappy", lambda d: d.select("row_id", F.round(cb.temperature_apply(F.nanvl("y_prob", F.lit(None).cast("double")), cb.temperature(d)), 4).alias("p")))
_add("ca8_isotonic", "gappy", lambda d: d.select("row_id", F.round(cb.isotonic_apply(F.nanvl("y_prob", F.lit(None).cast("double")), cb.isotonic(d)), 4).alias("p")))
_add("ca12_auto_calibrate", "gappy", lambda d: cb.auto_calibrate(*halves(d)))

# charts and activity
_add("ch2_mean_by_category", "treat", lambda d: ch.mean_by_category(d, "stratum", "y"), "select stratum category, count(y) n, round(avg(y),6) mean from {v} group by 1")
_add("ch3_histogram", "cohorts", lambda d: ch.histogram(d, "value", ["feature", "cohort"]), """
    with e as (select feature, min(value) lo, max(value) hi from {v} group by 1) select v.feature, cohort, cast(least(floor((value-lo)*30/(hi-lo)),29) as integer) bin, count(*) n from {v} v join e on v.feature=e.feature group by 1,2,3""")
_add("ch4_boxes", "treat", lambda d: ch.boxes(d, "stratum", "y"), f"""
    with q as (select stratum, quantile_cont(y,0.25) a, quantile_cont(y,0.5) b, quantile_cont(y,0.75) c from {{v}} group by 1), w as (select v.stratum, a, b, c, y, y between a-1.5e0*(c-a) and c+1.5e0*(c-a) inside from {{v}} v join q on v.stratum=q.stratum)
    select stratum, {r('a')} p25, {r('b')} median, {r('c')} p75, {r('min(y) filter (inside)')} whisker_low, {r('max(y) filter (inside)')} whisker_high, count(*) filter (not inside) outliers from w group by stratum, a, b, c""")
_put("ch5_line", lambda s, d: ch.line(table(s, d, "orders").select("o_orderdate", F.col("o_totalprice").cast("double").alias("y")), "o_orderdate", "y"), "select o_orderdate, count(*) n, round(avg(cast(o_totalprice as double)),6) y from orders group by 1")
_add("ch7_calibration_residuals", "gappy", lambda d: ch.calibration_residuals(ca.reliability(d)), f"select bin, round(fp-mp,6) residual from ({_B('')})")
_add("ch8_ranked", "cohorts", lambda d: ch.ranked(dr.psi(d), "feature", "psi"), f"select feature, {r('psi')} psi, cast(row_number() over (order by {r('psi')} desc, feature) as integer) as rank from ({PSI})")
ISSUE = THR + ", f as (select *, case when m is null then own < (case label when 0 then t0 when 1 then t1 else t2 end) else confident<>label end is_issue from k)"
_add("ch9_label_integrity", "noisy", lambda d: ch.label_integrity(ln.confident(d, "y_noisy", P3)), ISSUE + " select case when is_issue then 'suspected' else 'clean' end status, count(*) n from f group by 1")
_put("wk1_daily_counts", lambda s, d: ac.daily_counts(table(s, d, "events")), """
    with l as (select max(cast(ts as date)) d from events) select strftime(s.day, '%Y-%m-%d') as day, count(e.ts) n from (select unnest(range(0,7)) k) r cross join l cross join lateral (select l.d - cast(r.k as integer) as day) s left join events e on cast(e.ts as date)=s.day group by 1""")
_put("wk2_active_users", lambda s, d: ac.active_users(table(s, d, "events"), "event_type", "user_id", F.lit("2024-01-16").cast("timestamp")), """
    select event_type status, count(*) n, count(distinct user_id) users, count(*) filter (ts >= timestamp '2024-01-16') n_since, count(distinct case when ts >= timestamp '2024-01-16' then user_id end) users_since from events group by 1""")
_put("wk3_search", lambda s, d: ac.search(table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"], "Mach", F.col("c_custkey")), "select c_custkey, c_name, c_mktsegment from customer where lower(c_name) like '%mach%' or lower(c_mktsegment) like '%mach%'")


def _usage(s, d):
    users = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"))
    uses = {"orders": table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts")), "events": table(s, d, "events").select("user_id", "ts")}
    out = ac.usage(users, "user_id", uses, "orders", "ts")
    return out.select("user_id", "n_orders", "n_events", F.array_join(F.transform("latest", lambda x: F.date_format(x, "yyyy-MM-dd")), ",").alias("latest"))


_put("wk4_usage", _usage, """
    select c_custkey user_id, coalesce(o.n,0) n_orders, coalesce(e.n,0) n_events, latest from customer left join (select o_custkey k, count(*) n, string_agg(strftime(o_orderdate,'%Y-%m-%d'), ',' order by o_orderdate desc) filter (i<=3) latest
    from (select *, row_number() over (partition by o_custkey order by o_orderdate desc) i from orders) group by 1) o on o.k=c_custkey left join (select user_id k, count(*) n from events group by 1) e on e.k=c_custkey""")

# statistics and tests
_add("ds4_correlations", "treat", lambda d: st.correlations(d, ["y", "x1", "t"]), " union all ".join(f"select '{a}' a,'{b}' b, round(corr({a},{b}),6) r, round(covar_samp({a},{b}),2) cov from {{v}}" for a, b in (("y", "y"), ("y", "x1"), ("y", "t"), ("x1", "x1"), ("x1", "t"), ("t", "t"))))
_add("ds6_describe", "gaps", lambda d: st.describe(d, ["acctbal", "nation"]), """
    select feature, n, round(m,4) mean, round(s,4) std, lo, round(q1,4) p25, round(q2,4) median, round(q3,4) p75, hi, round(q3-q1,4) iqr, round((c3-3*m*c2+2*m*m*m)/(s*s*s),4) skewness from (select feature, count(*) n, avg(v) m, stddev_samp(v) s, min(v) lo, max(v) hi,
    quantile_cont(v,0.25) q1, quantile_cont(v,0.5) q2, quantile_cont(v,0.75) q3, avg(v*v) c2, avg(v*v*v) c3 from (select 'acctbal' feature, acctbal v from {v} union all select 'nation', nation from {v}) where v is not null group by 1)""")
_add("ds10_split_gain", "treat", lambda d: st.split_gain(d, "x1", 5000.0, "t"), f"""
    with c as (select case when x1<=5000 then 'L' else 'R' end side, t, cast(count(*) as double) n from {{v}} group by 1,2), a as (select * from c union all select 'A', t, sum(n) from c group by 2), p as (select side, n, n/sum(n) over (partition by side) p from a),
    g as (select side, sum(n) n, 1-sum(p*p) gini, -sum(p*log2(p)) h from p group by 1), w as (select max(case when side='A' then n end) n, max(case when side='A' then gini end)-sum(case when side<>'A' then n*gini else 0 end)/max(case when side='A' then n end) gg,
    max(case when side='A' then h end)-sum(case when side<>'A' then n*h else 0 end)/max(case when side='A' then n end) ig from g) select {r('ig')} information_gain, {r('gg')} gini_reduction from w""")
_put("ds11_vector_norms", lambda s, d: st.vector_norms(table(s, d, "embeddings"), "embedding", "vec_id").select("vec_id", F.round("l1", 4).alias("l1"), F.round("l2", 4).alias("l2"), F.round(F.col("unit")[0], 4).alias("u0")), """
    select vec_id, round(list_sum(list_transform(embedding, lambda x: abs(cast(x as double)))),4) l1, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double)*cast(x as double)))),4) l2,
    round(cast(embedding[1] as double)/sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double)*cast(x as double)))),4) u0 from embeddings""")
_add("ht1_one_sample_z", "treat", lambda d: st.one_sample_z(d, "y", 5.0, 3.0, "stratum").drop("p"), f"select stratum, count(y) n, {r('avg(y)')} mean, {r('(avg(y)-5)/(3/sqrt(count(y)))')} z from {{v}} group by 1")
_add("ht2_two_sample_z", "treat", lambda d: st.two_sample_z(d, "y", "t", 1, 0, 3.0, 3.0).drop("p"), f"select {r('ma-mb')} diff, {r('(ma-mb)/sqrt(9e0/na+9e0/nb)')} z from ({TWO})")
Z = "1.959963984540054e0"
TQ = f"({Z} + (pow({Z},3)+{Z})/(4e0*df) + (5*pow({Z},5)+16*pow({Z},3)+3*{Z})/(96e0*df*df) + (3*pow({Z},7)+19*pow({Z},5)+17*pow({Z},3)-15*{Z})/(384e0*df*df*df))"
_add("ht3_one_sample", "treat", lambda d: pr.one_sample(d, "y", 5.0, "stratum").drop("p"), f"select stratum, n, {r('m')} mean, {r('(m-5)/e')} t, df, {r(f'm-{TQ}*e')} low, {r(f'm+{TQ}*e')} high from (select stratum, count(y) n, count(y)-1 df, avg(y) m, stddev_samp(y)/sqrt(count(y)) e from {{v}} group by 1)")
_add("ht4_two_sample", "treat", lambda d: st.two_sample(d, "y", "t", 1, 0), f"""
    select round(ma-mb,6) diff, round((ma-mb)/sqrt(va/na+vb/nb),6) welch_t, round((va/na+vb/nb)*(va/na+vb/nb)/(va/na*va/na/(na-1)+vb/nb*vb/nb/(nb-1)),4) welch_df, round((ma-mb)/sqrt(sp*(1e0/na+1e0/nb)),6) pooled_t, na+nb-2 pooled_df, round((ma-mb)/sqrt(sp),6) cohens_d,
    case when abs((ma-mb)/sqrt(sp))<0.2 then 'negligible' when abs((ma-mb)/sqrt(sp))<0.5 then 'small' when abs((ma-mb)/sqrt(sp))<0.8 then 'medium' else 'large' end magnitude from (select *, ((na-1)*va+(nb-1)*vb)/(na+nb-2) sp from ({TWO}))""")
_put("ht5_paired", lambda s, d: st.paired(load(s, d, "regress"), load(s, d, "regress").withColumn("y", F.col("yhat")), "row_id", "y").drop("p"), f"""
    select n, {r('m')} mean_diff, {r('s')} sd_diff, n-1 df, {r('m/(s/sqrt(n))')} t from (select count(*) n, avg(yhat-y) m, stddev_samp(yhat-y) s from ({text('regress')}))""")
_add("ht6_goodness_of_fit", "scored2", lambda d: st.goodness_of_fit(d, "segment", {"BUILDING": 1, "MACHINERY": 1, "AUTOMOBILE": 1, "FURNITURE": 1, "HOUSEHOLD": 2}).drop("p"), """
    with c as (select segment, count(*) n, case when segment='HOUSEHOLD' then 2e0 else 1e0 end w from {v} group by 1), e as (select n, w/6*(select sum(n) from c) e from c) select 4 df, min(e)<5 low_expected, round(sum((n-e)*(n-e)/e),4) chi2 from e""")
_add("ht9_bootstrap", "treat", lambda d: rs.bootstrap(d, "y", "row_id"))
_add("ht10_bootstrap_difference", "treat", lambda d: rs.bootstrap(d, "y", "row_id", "t", 1, 0))
_add("ht16_mean_interval", "treat", lambda d: st.mean_interval(d, "x2", "stratum"), f"select stratum, n, {r('m')} mean, {r(f'm-{TQ}*e')} low, {r(f'm+{TQ}*e')} high from (select stratum, count(x2) n, count(x2)-1 df, avg(x2) m, stddev_samp(x2)/sqrt(count(x2)) e from {{v}} group by 1)")


def _bayes(d):
    rows = d.select("row_id", "y_true", "grp", "segment")
    prior = rows.groupBy(F.col("y_true").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    prior = prior.crossJoin(rows.agg(F.count(F.lit(1)).alias("all"))).select("class", (F.col("n") / F.col("all")).alias("p"))
    evidence = rows.unpivot(["row_id", "y_true"], ["grp", "segment"], "feature", "value")
    c = evidence.groupBy(F.col("y_true").alias("class"), "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy("class", "feature").agg(F.sum("n").alias("t"))
    like = c.join(total, ["class", "feature"]).select("class", "feature", "value", (F.col("n") / F.col("t")).alias("p"))
    return st.bayes(prior, like, evidence.select("row_id", "feature", "value"))


_add("ht17_naive_bayes", "scored2", _bayes, f"""
    with v as (select row_id, y_true, grp, segment from {{v}}), p as (select y_true c, count(*)/cast((select count(*) from v) as double) p from v group by 1), g as (select y_true c, grp, count(*)/cast(sum(count(*)) over (partition by y_true) as double) l from v group by 1,2),
    s as (select y_true c, segment, count(*)/cast(sum(count(*)) over (partition by y_true) as double) l from v group by 1,2), j as (select row_id, p.c, ln(p.p)+ln(coalesce(g.l,1e-6))+ln(coalesce(s.l,1e-6)) s from v cross join p left join g on g.c=p.c and g.grp=v.grp left join s on s.c=p.c and s.segment=v.segment),
    e as (select row_id, c, exp(s-max(s) over (partition by row_id)) e from j), o as (select row_id, c, e/sum(e) over (partition by row_id) p from e) select row_id, c as class, {r('p')} posterior, row_number() over (partition by row_id order by p desc, c)=1 chosen from o""")

# preparation and splits
_add("pr4_binarise", "treat", lambda d: pr.binarise(d, "x2").join(pr.binarise(d, "stratum").withColumnRenamed("target", "coded"), "row_id"), """
    with k as (select stratum, dense_rank() over (order by stratum)-1 code from {v}), m as (select quantile_cont(cast(code as double),0.5) mid from k) select row_id, case when x2>(select quantile_cont(x2,0.5) from {v}) then 1 else 0 end target, case when c.code>mid then 1 else 0 end coded
    from {v} v join (select distinct stratum, code from k) c on c.stratum=v.stratum, m""")
_add("pr5_to_probability", "regress", lambda d: pr.to_probability(d, "yhat").select("row_id", F.col("probs")[1].alias("p")), "select row_id, round((yhat-(select min(yhat) from {v}))/((select max(yhat) from {v})-(select min(yhat) from {v})+1e-9),6) p from {v}")
_add("pr6_first_codes", "treat", lambda d: pr.first_codes(d, "stratum", "row_id"), "with f as (select stratum, cast(row_number() over (order by min(row_id))-1 as integer) code from {v} group by 1) select row_id, code from {v} v join f on f.stratum=v.stratum")
_add("pr7_label_codes", "treat", lambda d: pr.label_codes(d, "stratum"), "select row_id, cast(dense_rank() over (order by stratum)-1 as integer) code from {v}")
_add("pr8_fill", "gaps", lambda d: pr.fill(d.withColumn("seg", F.when(F.col("nation").isNotNull(), F.col("seg"))), ["acctbal", "nation"], ["seg"]), """
    with w as (select *, case when nation is not null then seg end sg from {v}), m as (select sg from w where sg is not null group by 1 order by count(*) desc, sg limit 1)
    select row_id, round(coalesce(acctbal,(select avg(acctbal) from w)),6) acctbal, round(coalesce(nation,(select avg(nation) from w)),6) nation, coalesce(sg,(select sg from m),'MISSING') seg from w""")
CUT = "(select o from (select {c} o, row_number() over (order by {c})-1 i, count(*) over () n from {{v}}) where i=cast(floor(n*{f}) as bigint))"
_add("pr10_ordered_split", "scored", lambda d: vs.ordered_split(d, "ts", 0.5).select("row_id", "part"), f"select row_id, case when ts<{CUT.format(c='ts', f='0.5')} then 'reference' else 'current' end part from {{v}}")
_add("vs5_temporal_holdout", "scored", lambda d: vs.ordered_split(d, "ts", 0.8).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first")), f"select case when ts<{CUT.format(c='ts', f='0.8')} then 'reference' else 'current' end part, count(*) n, strftime(min(ts),'%Y-%m-%d') as first from {{v}} group by 1")
_add("pr11_cohorts", "wide", lambda d: pr.cohorts(d.where("cohort='reference'"), d.where("cohort='current'")).select("row_id", "domain"), "select row_id, case when cohort='reference' then 0 else 1 end as domain from {v}")
_add("pr12_bin_labels", "cohorts", lambda d: dr.bin_labels(d, dr.quantile_bounds(d.where("cohort='reference'"), 4)).groupBy("feature", "label").agg(F.count(F.lit(1)).alias("n")), f"""
    with b as (select distinct feature, value from ({BOUNDS.replace('*1//10,n*2//10,n*3//10,n*4//10,n*5//10,n*6//10,n*7//10,n*8//10,n*9//10', '*1//4,n*2//4,n*3//4')}))
    select feature, label, count(*) n from (select v.feature, case when v.value is not null then concat(v.feature, '_bin', (select count(*) from b where b.feature=v.feature and b.value<=v.value)) end as label from {{raw}} v) group by 1,2""")
_add("pr14_inject_noise", "multi", lambda d: pr.inject_noise(d, "y_true", [[0.8, 0.15, 0.05], [0.1, 0.85, 0.05], [0.0, 0.2, 0.8]]).select("row_id", F.col("noisy").cast("int").alias("noisy")), f"""
    with u as (select row_id, y_true, {draw('row_id', 'noise')} u from {{v}}) select row_id, case y_true when 0 then case when u<0.8 then 0 when u<0.95 then 1 else 2 end when 1 then case when u<0.1 then 0 when u<0.95 then 1 else 2 end else case when u<0.2 then 1 else 2 end end noisy from u""")
_add("vs1_train_test", "scored", lambda d: vs.train_test(d).select("row_id", "role"), f"select row_id, case when {draw('row_id', 'split')}<0.2 then 'test' else 'train' end as role from {{v}}")
_add("vs3_stratified_folds", "scored", lambda d: vs.stratified_folds(d, "row_id", "y_true"), "select row_id, cast((row_number() over (partition by y_true order by h, row_id)-1) % 5 as integer) fold from (select row_id, y_true, md5(concat(cast(row_id as string), ':f')) h from {v})")
_add("vs4_time_series", "scored", lambda d: vs.time_series_splits(d, "ts", "row_id", 3, 5).groupBy("split", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids")), """
    with o as (select row_id, row_number() over (order by ts, row_id)-1 i, count(*) over ()//4 s from {v}), e as (select cast(k as integer) split, row_id, case when i < s*k-5 then 'train' when i >= s*k and i < s*(k+1) then 'test' end as role from o cross join (select unnest(range(1,4)) k))
    select split, role, count(*) n, cast(sum(row_id) as bigint) ids from e where role is not null group by 1,2""")
_add("vs6_cross_validate", "study", lambda d: vs.cross_validate(d, lambda t: _pipeline(t, ["x1", "x2", "y"], "t"), (F.col("t") == F.col("prediction")).cast("double"), k=5))
_add("vs7_nested", "study", lambda d: vs.nested(d, lambda t, g: _pipeline(t, ["x1", "x2", "y"], "t", **g), [{"reg": 0.0}, {"reg": 0.5}], (F.col("t") == F.col("prediction")).cast("double"), outer=5, inner=3))
_add("vs6_ridge_folds", "study", lambda d: fo.ridge_folds(d, ["x1", "x2"], "y", k=3, reg=0.1), f"""
    with f as (select cast(floor({draw('row_id', 'v')}*3) as integer) fold, x1, x2, y from {{v}}), t as (select i, avg(x1) m1, avg(x2) m2, avg(y) my, sqrt(covar_pop(x1,x1)) s1, sqrt(covar_pop(x2,x2)) s2, covar_pop(x1,x2) c12, covar_pop(x1,y) c1, covar_pop(x2,y) c2
        from f join (select unnest(range(0,3)) i) on fold<>i group by i), u as (select *, c12/s1/s2 q, c1/s1 a, c2/s2 b from t), w as (select i, (1.1e0*a-q*b)/(1.1e0*1.1e0-q*q)/s1 w1, (1.1e0*b-q*a)/(1.1e0*1.1e0-q*q)/s2 w2, m1, m2, my from u),
    e as (select fold, count(*) n, avg((y-my-w1*(x1-m1)-w2*(x2-m2))*(y-my-w1*(x1-m1)-w2*(x2-m2))) e, var_pop(y) s from f join w on i=fold group by 1), g as (select fold, n, sqrt(e) rmse, 1-e/s r2 from e), h as (select avg(rmse) mean, stddev_samp(rmse) std from g)
    select fold, n, {r('rmse')} rmse, {r('r2')} r2, {r('mean')} mean, {r('std')} std, {r('mean-1.96e0*std/sqrt(3e0)')} low, {r('mean+1.96e0*std/sqrt(3e0)')} high from g, h""")
_add("vs7_ridge_nested", "study", lambda d: fo.ridge_nested(d, ["x1", "x2", "ps"], "y", [0.0, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0]))


def _pipeline(train, features, label, reg=0.0):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, regParam=reg, maxIter=20)]).fit(train)


_add("vs8_scaling_leakage", "study", lambda d: vs.scaling_leakage(d.withColumn("z", (F.col("x1") - 4500) / 3175), ["x1", "z"]), f"""
    with l as (select role, 'x1' feature, x1 v from {{v}} union all select role, 'z', (x1-4500)/3175 from {{v}}), g as (select feature, avg(v) filter (role='train') a, avg(v) filter (role='test') b, stddev_samp(v) filter (role='train') s, stddev_samp(v) filter (role='test') q from l group by 1),
    t as (select feature, {r('a')} mean_train, {r('b')} mean_test, {r('abs(a-b)/s')} z_gap, abs(a)<=0.05 and abs(s-1)<=0.05 and abs(b)<=0.05 and abs(q-1)<=0.05 scaled from g) select *, (select case when count(*) filter (scaled)*2>count(*) then 'HIGH' when count(*) filter (scaled)>0 then 'MEDIUM' else 'LOW' end from t) risk from t""")
_add("vs9_target_leakage", "treat", lambda d: vs.target_leakage(d.withColumn("copy", F.col("y") * 2), ["x1", "x2", "copy"], "y"), " union all ".join(f"select '{n}' feature, round(abs(corr({c},y)),6) r, abs(corr({c},y))>=0.95 leaks from {{v}}" for n, c in (("x1", "x1"), ("x2", "x2"), ("copy", "y*2"))))
_add("vs10_temporal_order", "study", lambda d: vs.temporal_order(d, "ts").select(F.date_format("train_max", "yyyy-MM-dd").alias("train_max"), F.date_format("test_min", "yyyy-MM-dd").alias("test_min"), "overlap", "violation_rate", "ordered"), f"""
    with m as (select max(ts) filter (role='train') a, min(ts) filter (role='test') b from {{v}}), c as (select count(*) filter (role='test' and ts<=a) o, count(*) filter (role='test') n from {{v}}, m) select strftime(a,'%Y-%m-%d') train_max, strftime(b,'%Y-%m-%d') test_min, o overlap, {r(f"o/{D('n')}")} violation_rate, o=0 ordered from m, c""")
KSR = "(select max(abs(cr/nr-cc/nc)) d from (select sum(r) over (order by v) cr, sum(c) over (order by v) cc, sum(r) over () nr, sum(c) over () nc from (select {c} v, sum(case when role='train' then 1e0 else 0 end) r, sum(case when role='test' then 1e0 else 0 end) c from {{v}} group by 1)))"
SHARED = "(select count(*) from (select x1, x2, t from {v} where role='train' intersect select x1, x2, t from {v} where role='test'))"
_add("vs11_validate", "study", lambda d: vs.validate(d, ["x1", "x2"], "t"), f"""
    with g as (select avg(case when role='test' then 1e0 else 0 end) s, abs(avg(t) filter (role='test')-avg(t) filter (role='train')) p, (case when {KSR.format(c='x1')}>0.1 then 1e0 else 0 end)+(case when {KSR.format(c='x2')}>0.1 then 1e0 else 0 end) k, {D(SHARED)} o from {{v}})
    select 'test_share' "check", {r('s')} as value, s between 0.1 and 0.4 passed from g union all select 'label_gap', {r('p')}, p<0.05 from g union all select 'shifted_features', k, k=0 from g union all select 'shared_rows', o, o=0 from g""")
_add("vs12_overlap", "study", lambda d: vs.overlap(d, ["stratum", "t", "post"]), """
    with a as (select distinct stratum, t, post from {v} where role='train'), b as (select distinct stratum, t, post from {v} where role='test') select (select count(*) from a) train_rows, (select count(*) from b) test_rows, (select count(*) from (select * from a intersect select * from b)) shared""")

# fairness
FAIR = f"select max(sr)-min(sr) dp, max(tpr)-min(tpr) tp, max(fpr)-min(fpr) fp, max(ppv)-min(ppv) pp, min(sr)/max(sr) di, max(b)-min(b) b from (select *, {D('tp+fn')}/n b from ({_R('grp')}))"
_add("fa8_report", "scored2", fa.report, f"""
    with g as (select {r('dp')} dp, {r('greatest(tp,fp)')} eo, {r('tp')} tp, {r('pp')} pp, {r('di')} di, b from ({FAIR})), k as (select *, (dp>=0.1)::int+(eo>=0.1)::int+(tp>=0.1)::int+(pp>=0.1)::int+(di<0.8)::int violations from g),
    s as (select *, case violations when 0 then 'OK' when 1 then 'MEDIUM' when 2 then 'HIGH' else 'CRITICAL' end status from k)
    select criterion, value, passes, violations, status, b<0.05 base_rates_close from (select 'demographic_parity' criterion, dp as value, dp<0.1 passes, * from s union all select 'equalized_odds', eo, eo<0.1, * from s union all select 'equal_opportunity', tp, tp<0.1, * from s
    union all select 'predictive_parity', pp, pp<0.1, * from s union all select 'disparate_impact', di, di>=0.8, * from s)""")
_add("fa10_audit", "scored2", lambda d: fa.audit(d, ["grp", "segment"]), f"""
    with r as (select 'grp' axis, * from ({_R('grp')}) union all select 'segment', * from ({_R('segment')})), m as (select axis, avg(sr) m from r group by 1), w as (select axis, grp worst_group from (select r.axis, grp, row_number() over (partition by r.axis order by round(abs(sr-m),9) desc, grp desc) i from r join m on m.axis=r.axis) where i=1),
    t as (select axis, {r('max(sr)-min(sr)')} dp_gap, {r('greatest(max(tpr)-min(tpr),max(fpr)-min(fpr))')} eo_gap, {r('min(sr)/max(sr)')} di_ratio, cast(sum(case when n<30 then 1 else 0 end) as bigint) small_groups from r group by 1)
    select t.axis, dp_gap, eo_gap, di_ratio, case when dp_gap<=0.05 then 'LOW' when dp_gap<=0.1 then 'MEDIUM' when dp_gap<=0.2 then 'HIGH' else 'CRITICAL' end dp_severity, case when eo_gap<=0.05 then 'LOW' when eo_gap<=0.1 then 'MEDIUM' when eo_gap<=0.2 then 'HIGH' else 'CRITICAL' end eo_severity,
    case when di_ratio>=0.95 then 'LOW' when di_ratio>=0.9 then 'MEDIUM' when di_ratio>=0.8 then 'HIGH' else 'CRITICAL' end di_severity, worst_group, small_groups, (select axis from t order by greatest(dp_gap,eo_gap) desc, axis desc limit 1) worst_axis from t join w on w.axis=t.axis""")
_URGENT = "(select row_id, custkey, y_true, y_prob, grp, ts, segment, y_pred2, case when grp='1-URGENT' then 1 else y_pred end y_pred from {v})"
_add("fa12_recommendations", "scored2", lambda d: fa.recommendations(fa.report(d.withColumn("y_pred", F.when(F.col("grp") == "1-URGENT", 1).otherwise(F.col("y_pred"))))), f"""
    with g as (select {r('dp')} dp, {r('greatest(tp,fp)')} eo, {r('tp')} tp, {r('pp')} pp, {r('di')} di, b from ({FAIR.replace('{v}', _URGENT)})), k as (select *, (dp>=0.1)::int+(eo>=0.1)::int+(tp>=0.1)::int+(pp>=0.1)::int+(di<0.8)::int violations from g),
    s as (select *, case violations when 0 then 'OK' when 1 then 'MEDIUM' when 2 then 'HIGH' else 'CRITICAL' end status from k),
    t as (select criterion, value, status, miss from (select 'demographic_parity' criterion, dp as value, dp-0.1 miss, dp>=0.1 bad, status from s union all select 'equalized_odds', eo, eo-0.1, eo>=0.1, status from s union all select 'equal_opportunity', tp, tp-0.1, tp>=0.1, status from s
        union all select 'predictive_parity', pp, pp-0.1, pp>=0.1, status from s union all select 'disparate_impact', di, 0.8-di, di<0.8, status from s) where bad)
    select cast(row_number() over (order by miss desc, criterion) as integer) as rank, criterion, value, status, case criterion {' '.join(f"when '{k}' then '{v}'" for k, v in fa.ADVICE.items())} end advice from t""")
_add("fa7_individual", "scored", lambda d: fa.individual(d.withColumn("day", F.unix_timestamp("ts")), ["custkey", "day"], "y_prob", "row_id"), """
    with s as (select row_id k, y_prob y, cast(custkey as double) a, cast(epoch(ts) as double) b from {v}), e as (select min(a) la, max(a) ha, min(b) lb, max(b) hb from s), x as (select k, y, (a-la)/(ha-la) a, (b-lb)/(hb-lb) b from s, e),
    m as (select p.k, p.y, min_by(q.y, {'d': (p.a-q.a)*(p.a-q.a)+(p.b-q.b)*(p.b-q.b), 'k': q.k}, 5) near from x p join x q on p.k <> q.k group by 1, 2)
    select round(1-avg(g),6) consistency, 1-avg(g) >= 0.8 passes from (select list_avg(list_transform(near, lambda v: abs(v-y))) g from m)""", spread=True)
_add("fa14_fair_threshold", "gappy", lambda d: fa.fair_threshold(d), f"""
    with t as (select unnest(range(0,50)) i), c as (select i, grp, count(*) n, count(*) filter (k>=i) sel, sum(y_true) pos, coalesce(sum(y_true) filter (k>=i),0) tp from (select grp, y_true, least(greatest(floor((y_prob-0.01e0)/(0.98e0/49)+1e-9),-1),49) k from {{v}}) cross join t group by 1,2),
    g as (select i, {r(f"max(sel/{D('n')})-min(sel/{D('n')})")} gap, {r(f"2e0*sum(tp)/{D('sum(sel)+sum(pos)')}")} f1 from c group by 1) select round(0.01e0+i*(0.98e0/49),6) threshold, gap, f1 from g order by gap, f1 desc, i limit 1""")

# drift and root causes
KSP = f"""select feature, d, least(1e0,greatest(0e0,2*(select sum(pow(-1,k-1)*exp(-2e0*k*k*x*x)) from (select unnest(range(1,20)) k)))) p, mr, mc from (select feature, d, mr, mc, (sqrt(nr*nc/(nr+nc))+0.12e0+0.11e0/sqrt(nr*nc/(nr+nc)))*d x from ({KS}) join
    (select feature f, count(*) filter (cohort='reference')*1e0 nr, count(*) filter (cohort='current')*1e0 nc, avg(value) filter (cohort='reference') mr, avg(value) filter (cohort='current') mc from {{v}} group by 1) n on f=feature)"""
_add("dr1_ks", "cohorts", dr.ks, f"select feature, {r('d')} ks, {r('p')} p, case when d>0.2 then 'HIGH' when d>0.1 then 'MEDIUM' when d>0.05 then 'LOW' else 'NONE' end level, round(mr,4) mean_reference, round(mc,4) mean_current from ({KSP})")
CAT = "with c as (select category, sum(case when cohort='reference' then 1 else 0 end) r, sum(case when cohort='reference' then 0 else 1 end) c from {v} group by 1), t as (select *, sum(r) over () nr, sum(c) over () nc from c)"
_add("dr4_categorical", "cat_cohorts", dr.categorical, f"""{CAT}, p as (select *, coalesce((c-{D('r')}/nr*nc)*(c-{D('r')}/nr*nc)/nullif({D('r')}/nr*nc,0),0) x from t)
    select category, cast(r as bigint) as ref, cast(c as bigint) cur, round({D('r')}/nr,6) ref_share, round({D('c')}/nc,6) cur_share, round(x,4) chi2_part, round(sum(x) over (),4) chi2, count(*) over ()-1 df from p""")
_add("dr5_label_shares", "cat_cohorts", dr.label_shares, f"{CAT} select category as label, round({D('r')}/nr,6) ref_share, round({D('c')}/nc,6) cur_share, round({D('c')}/nc-{D('r')}/nr,6) change from t")
FEATURE = f"""select a.feature, {r('d')} ks, {r('p')} p, {r('psi')} psi, round(0.5*round(d,6)+0.5*round(psi,6),6) score, case when {r('psi')}>=0.25 or {r('d')}>=0.2 or {r('p')}<0.001 then 'DRIFT' when {r('psi')}>=0.1 or {r('d')}>=0.1 or {r('p')}<0.05 then 'WARN' else 'STABLE' end status
    from ({KSP}) a join ({PSI}) b on a.feature=b.feature"""
_add("dr12_per_feature", "cohorts", dr.per_feature, FEATURE)
_add("dr11_report", "cohorts", dr.report, f"with t as ({FEATURE}) select *, (select max(ks) from t) max_ks, (select max(psi) from t) max_psi, (select case when count(*) filter (psi>=0.25 or ks>0.2)*2>count(*) then 'CRITICAL' when count(*) filter (psi>=0.25 or ks>0.2)>0 then 'WARNING' when count(*) filter (psi>=0.1 or ks>0.1)>0 then 'MINOR' else 'NONE' end from t) overall from t")
_add("dr6_covariate_shift", "cohorts", dr.covariate_shift, f"with t as ({FEATURE}) select feature, ks, psi, score, score>0.1 shifted, cast(row_number() over (order by score desc, feature) as integer) as rank, (select case when count(*) filter (score>0.1)*2>count(*) or max(score)>0.3 then 'CRITICAL' when count(*) filter (score>0.1)>0 then 'WARNING' else 'NONE' end from t) overall from t")
_add("dr13_alerts", "cohorts", lambda d: dr.alerts(dr.per_feature(d)), f"with t as ({FEATURE}) select feature, status, case when status='DRIFT' then 'HIGH' else 'MEDIUM' end severity, (select case when count(*) filter (status='DRIFT')*2>count(*) then 'CRITICAL' when count(*) filter (status='DRIFT')>0 then 'HIGH' when count(*) filter (status='WARN')>0 then 'MEDIUM' else 'NONE' end from t) overall from t where status<>'STABLE'")
_add("dr14_by_method", "cohorts", lambda d: dr.by_method(d, "ks"), f"with t as (select feature, {r('d')} drift from ({KS})) select feature, drift, drift>0.1 alert, cast(row_number() over (order by drift desc, feature) as integer) as rank from t")
_add("dr7_domain_classifier", "wide", lambda d: bm.domain_classifier(d, ["v", "h", "u"]))
_add("dr8_pca_drift", "wide", lambda d: bm.pca_drift(d, ["v", "h", "u"]))
_add("dr9_kernel_drift", "wide", lambda d: bm.kernel_drift(d, ["v", "h", "u"]))
_add("dr10_unsupervised", "wide", lambda d: bm.unsupervised_drift(d, ["v", "h", "u"]))
CAUSES = f"""with g as (select feature, avg(case when cohort='reference' then value end) ar, avg(case when cohort='current' then value end) ac, quantile_cont(case when cohort='reference' then value end,0.25) q1, quantile_cont(case when cohort='reference' then value end,0.75) q3,
    avg(case when value is null then 1e0 else 0e0 end) filter (cohort='reference') mr, avg(case when value is null then 1e0 else 0e0 end) filter (cohort='current') mc from {{raw}} group by 1),
    t as (select feature, {r('mr')} missing_reference, {r('mc')} missing_current, case when mc-mr>0.05 and mc>0.2 then 'HIGH' when mc-mr>0.05 then 'MEDIUM' else 'NONE' end missing_level, {r('abs(ac-ar)/(abs(ar)+1e-9)')} mean_shift,
    case when abs(ac-ar)/(abs(ar)+1e-9)>0.25 then 'HIGH' when abs(ac-ar)/(abs(ar)+1e-9)>0.1 then 'MEDIUM' else 'NONE' end shift_level, {r('q3+1.5*(q3-q1)')} fence, (select count(*) from {{raw}} v where v.feature=g.feature and cohort='current' and value>q3+1.5*(q3-q1)) outliers,
    (select round(max(value),4) from {{raw}} v where v.feature=g.feature and cohort='current') worst from g)"""
_add("rc1_root_causes", "cohorts", dr.root_causes, f"{CAUSES} select * from t")
_put("rc5_correlation_change", lambda s, d: dr.correlation_change(load(s, d, "wide"), ["h", "u"], "v"), f"""
    {' union all '.join(f"select '{c}' feature, {r('a')} reference, {r('b')} as current, abs(a-b)>0.2 changed from (select corr({c},v) filter (cohort='reference') a, corr({c},v) filter (cohort='current') b from ({text('wide')}))" for c in 'hu')}""")
_put("rc6_ranked_causes", lambda s, d: dr.ranked_causes(load(s, d, "cohorts"), dr.new_categories(load(s, d, "cat_cohorts"))).select("rank", "feature", "cause", "confidence"), CAUSES.replace("{raw}", f"({text('cohorts')})") + f""",
    n as (select distinct category from ({text('cat_cohorts')}) where cohort='current' and category not in (select category from ({text('cat_cohorts')}) where cohort='reference')),
    a as (select feature, 'missing values' cause, case when missing_level='HIGH' then 90 else 75 end confidence from t where missing_level<>'NONE' union all select feature, 'mean shift', case when shift_level='HIGH' then 90 else 75 end from t where shift_level<>'NONE' union all select feature, 'outliers', 60 from t where outliers>0 union all select category, 'new category', 80 from n)
    select rank, feature, cause, confidence from (select *, cast(row_number() over (order by confidence desc, cause, feature) as integer) as rank from a) where rank<=5""")

# slices
_add("sl1_losses", "gappy", lambda d: sl.losses(d, "log").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 6).alias("loss")), f"select grp, count(*) n, {r('-avg(case when y_true=1 then ln(greatest(1e-15,y_prob)) else ln(1-least(1-1e-15,y_prob)) end)')} loss from {{v}} group by 1")
_loss = lambda d: d.withColumn("loss", (F.col("y_true") != F.col("y_pred")).cast("double"))
MEASURE = """select *, gs/n m, (s-gs)/(a-n) k, greatest(gq/n-(gs/n)*(gs/n),0) v, greatest((q-gq)/(a-n)-((s-gs)/(a-n))*((s-gs)/(a-n)),0) w from g, (select cast(count(*) as double) a, sum(l) s, sum(l*l) q from l0)"""
SHOWN = f"n::bigint n, {r('m')} mean_loss, {r('k')} rest_loss, {r('sqrt(2e0)*(m-k)/nullif(sqrt(v+w),0)')} effect"
WELCH = f"{r('(m-k)/nullif(sqrt(v/(n-1)+w/(a-n-1)),0)')} t, round((v/(n-1)+w/(a-n-1))*(v/(n-1)+w/(a-n-1))/nullif(v/(n-1)*v/(n-1)/(n-1)+w/(a-n-1)*w/(a-n-1)/(a-n-1),0),3) df"
L0 = "l0 as (select grp, segment, case when y_true<>y_pred then 1e0 else 0e0 end l from {v}), "
SINGLE = f"with {L0} g as (select feature, value, cast(count(*) as double) n, sum(l) gs, sum(l*l) gq from (select 'grp' feature, grp as value, l from l0 union all select 'segment', segment, l from l0) group by 1,2 having count(*)>=20)"
_add("sl2_slices", "scored2", lambda d: sl.slices(_loss(d), ["grp", "segment"], "loss"), f"{SINGLE} select feature, value, {SHOWN}, {WELCH} from ({MEASURE})")
_add("sl7_suggest", "scored2", lambda d: sl.suggest(_loss(d), ["grp", "segment"], "loss", effect=0.0).drop("t", "df"), f"{SINGLE}, x as (select feature, value, {SHOWN} from ({MEASURE})) select *, cast(row_number() over (order by effect desc, feature, value) as integer) as rank from x where effect>=0 qualify rank<=10")
_add("sl6_evaluate", "scored2", lambda d: sl.evaluate(_loss(d), {"segment": ["BUILDING", "MACHINERY"], "grp": "1-URGENT"}, "loss"), f"with {L0} g as (select cast(count(*) as double) n, sum(l) gs, sum(l*l) gq from l0 where segment in ('BUILDING','MACHINERY') and grp='1-URGENT') select {SHOWN}, {WELCH} from ({MEASURE})")
_add("sl8_refine", "scored2", lambda d: sl.refine(_loss(d), {"segment": "BUILDING"}, ["grp", "segment"], "loss").drop("t", "df"), f"""
    with l0 as (select grp, case when y_true<>y_pred then 1e0 else 0e0 end l from {{v}} where segment='BUILDING'), g as (select 'grp' feature, grp as value, cast(count(*) as double) n, sum(l) gs, sum(l*l) gq from l0 group by 1,2 having count(*)>=20),
    x as (select feature, value, {SHOWN} from ({MEASURE})) select *, cast(row_number() over (order by effect desc, feature, value) as integer) as rank from x qualify rank<=5""")
_worse = lambda d: d.withColumn("loss", F.when((F.col("segment") == "BUILDING") & (F.col("grp") == "1-URGENT"), 1.0).otherwise((F.col("y_true") != F.col("y_pred")).cast("double")))
_add("sl4_problematic", "scored2", lambda d: sl.problematic(sl.slices(_worse(d), ["grp", "segment"], "loss"), effect=0.05))
_add("sl5_search", "scored2", lambda d: sl.search(_worse(d), ["grp", "segment"], "loss"))
_add("sl9_report", "scored2", lambda d: sl.report(_worse(d), ["y_prob"], ["grp", "segment"], "loss"))
_add("sl10_error_clusters", "study", lambda d: sl.error_clusters(d.withColumn("hat", (F.col("ps") > 0.5).cast("int")), ["x1", "x2"], F.col("t") != (F.col("ps") > 0.5).cast("int"), "t", "hat"))
_add("sl11_error_embedding", "study", lambda d: sl.error_embedding(d, ["x1", "x2", "y"], F.col("t") != (F.col("ps") > 0.5).cast("int")).groupBy("wrong").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("pc1") * F.col("pc1")), 4).alias("spread1"), F.round(F.avg(F.col("pc2") * F.col("pc2")), 4).alias("spread2")))

# label noise
_flags = lambda d: ln.confident(d, "y_noisy", P3)
_add("ln1_thresholds", "noisy", lambda d: ln.noise_thresholds(d, "y_noisy", P3).select(*[F.round(f"t{k}", 6).alias(f"t{k}") for k in range(3)]), "select round(avg(p0) filter (y_noisy=0),6) t0, round(avg(p1) filter (y_noisy=1),6) t1, round(avg(p2) filter (y_noisy=2),6) t2 from {v}")
_add("ln2_joint", "noisy", lambda d: ln.joint(_flags(d)), THR + " select label, confident, count(*) n from k where confident is not null group by 1,2")
_add("ln3_label_errors", "noisy", _flags, ISSUE + " select row_id, label, confident, is_issue, round(own-greatest(case when label<>0 then p0 else -1 end,case when label<>1 then p1 else -1 end,case when label<>2 then p2 else -1 end),6) margin, round(own,6) quality from f")
_add("ln4_error_fraction", "noisy", lambda d: ln.error_fraction(_flags(d)), ISSUE + " select round(avg(case when is_issue then 1e0 else 0e0 end),6) fraction, count(*) filter (is_issue) issues from f")
TRANS = THR + f""", c as (select confident i, label j, count(*) n from k where confident is not null group by 1,2), z as (select cast(a as integer) i, cast(b as integer) j, coalesce(n,0) n from (select unnest(range(0,3)) a) cross join (select unnest(range(0,3)) b) left join c on c.i=a and c.j=b),
    tr as (select i, j, {r(f"case when sum(n) over (partition by i)=0 then case when i=j then 1e0 else 0e0 end else n/{D('sum(n) over (partition by i)')} end")} t from z)"""
_add("ln6_transitions", "noisy", lambda d: ln.transitions(ln.joint(_flags(d)), 3), TRANS + " select * from tr")
ASYM = "select round(stddev_pop(t) filter (i<>j),6) spread, stddev_pop(t) filter (i<>j)>0.05 \"asymmetric\", round(1-avg(t) filter (i=j),6) severity, (select i from tr where i=j order by t, i limit 1) noisiest from tr"
_add("ln7_asymmetry", "noisy", lambda d: ln.asymmetry(ln.transitions(ln.joint(_flags(d)), 3)), f"{TRANS} {ASYM}")
_add("ln9_cleaned", "noisy", lambda d: ln.cleaned(d, _flags(d)).select("row_id", "y_noisy"), ISSUE + " select row_id, label y_noisy from f where not coalesce(is_issue,false)")
_add("ln10_agreement", "noisy", lambda d: ln.agreement(_flags(d).where("is_issue"), d.where("y_noisy <> y_true")), ISSUE + f""", xa as (select row_id from f where is_issue), xb as (select row_id from {{v}} where y_noisy<>y_true), n as (select (select count(*) from xa) x, (select count(*) from xb) y, (select count(*) from (select * from xa intersect select * from xb)) z)
    select x n_first, y n_second, z n_both, {r(f"z/{D('x+y-z')}")} jaccard from n""")
_add("ln11_audit", "noisy", lambda d: ln.audit(_flags(d), 3, 100).withColumn("first_ids", F.array_join(F.transform("first_ids", lambda x: x.cast("string")), ",")), TRANS + f""", f as (select *, case when m is null then own < (case label when 0 then t0 when 1 then t1 else t2 end) else confident<>label end is_issue from k),
    g as (select count(*) n, count(*) filter (is_issue) issues, round(avg(round(own,6)),6) mean_quality from f), h as (select *, {r(f"issues/{D('n')}")} fraction from g) select h.*, s.spread, s."asymmetric", case when fraction>0.3 then 'CRITICAL' when fraction>0.15 then 'HIGH' when fraction>0.05 then 'MEDIUM' else 'LOW' end severity,
    (select string_agg(cast(row_id as varchar), ',' order by row_id) from (select row_id from f where is_issue order by row_id limit 100)) first_ids from h, ({ASYM}) s""")
_add("ln12_out_of_fold", "noisy", lambda d: ln.out_of_fold(d, "y_noisy", P3), f"select row_id, y_noisy as label, {ARGMAX} likeliest, {r('greatest(p0,p1,p2)')} p, {ARGMAX}<>y_noisy or greatest(p0,p1,p2)<0.5 is_issue from {{v}}")
_add("ln13_residual_noise", "regress", lambda d: ln.residual_noise(d), f"with e as (select row_id, abs(y-yhat) e from {{v}}) select row_id, {r('e')} residual, e>(select avg(e)+3*stddev_samp(e) from e) is_issue from e")
_add("ln12_found_out_of_fold", "noisy", lambda d: ln.found_out_of_fold(d, ["p0", "p1"], "y_noisy", 3))
_add("ln12_confident_out_of_fold", "noisy", lambda d: ln.confident_out_of_fold(d, ["p0", "p1"], "y_noisy", 3))
_add("ln13_residuals_out_of_fold", "study", lambda d: ln.residuals_out_of_fold(d, ["x1", "x2", "t"], "y"))
_add("ln14_noise_matrix", "noisy", lambda d: ln.noise_matrix(d, "y_true", "y_noisy", 3), "select y_true, round(avg(case when y_noisy=0 then 1e0 else 0e0 end),6) to0, round(avg(case when y_noisy=1 then 1e0 else 0e0 end),6) to1, round(avg(case when y_noisy=2 then 1e0 else 0e0 end),6) to2 from {v} group by 1")
_add("ln15_target_type", "noisy", lambda d: ln.target_type(d, "y_noisy").unionByName(ln.target_type(d, "p0")), "select count(distinct y_noisy) as values, 'classification' kind from {v} union all select count(distinct p0), 'regression' from {v}")

# leakage
MI = """select feature, sum(n/t*ln(n*t/(nb*nc))) mi from (select feature, n, sum(n) over (partition by feature) t, sum(n) over (partition by feature, bin) nb, sum(n) over (partition by feature, c) nc from (select feature, bin, c, cast(count(*) as double) n from (
    select l.feature, c, (select count(*) from bd where bd.feature=l.feature and bd.value<=l.value) bin from ll l) group by 1,2,3)) group by 1"""
LL = """with ll as (select 'x1' feature, x1 as value, t c from {v} union all select 'x2', x2, t from {v} union all select 'y', y, t from {v}), bd as (select distinct feature, value from (select feature, value, row_number() over (partition by feature order by value)-1 as i, count(*) over (partition by feature) n from ll)
    where i in (n*1//10,n*2//10,n*3//10,n*4//10,n*5//10,n*6//10,n*7//10,n*8//10,n*9//10))"""
_add("lk1_mutual_information", "treat", lambda d: lk.mutual_information(d, ["x1", "x2", "y"], "t"), f"{LL} select feature, {r('mi')} mi from ({MI})")
SCORES = f"{LL}, s as (select feature, {r('rr')} r, {r('mi')} mi from ({MI}) join (select 'x1' f, abs(corr(x1,t)) rr from {{v}} union all select 'x2', abs(corr(x2,t)) from {{v}} union all select 'y', abs(corr(y,t)) from {{v}}) on f=feature)"
_add("lk4_leakage_scores", "treat", lambda d: lk.scores(d, ["x1", "x2", "y"], "t"), f"""{SCORES}, m as (select max(mi) top from s) select feature, r, mi, round(0.7*r+0.3*least(1e0,mi),5) score, (mi>0.95*top and top>0) or r>0.9 suspect,
    case when mi>0.95*top and top>0 and r>0.9 then 'CRITICAL' when (mi>0.95*top and top>0) or r>0.9 then 'HIGH' else 'LOW' end risk from s, m""")
_add("lk5_over_time", "study", lambda d: lk.over_time(d, ["x1", "x2"], "y", "ts"), f"""
    with h as (select *, ts<{CUT.format(c='ts', f='0.5')} early from {{v}}), g as (select count(*) filter (early) n1, count(*) filter (not early) n2, abs(corr(x1,y) filter (early)) a1, abs(corr(x1,y) filter (not early)) b1, abs(corr(x2,y) filter (early)) a2, abs(corr(x2,y) filter (not early)) b2 from h)
    select 'x1' feature, {r('a1')} first_half, {r('b1')} second_half, b1>2*a1 and b1>0.7 and least(n1,n2)>=10 leaks from g union all select 'x2', {r('a2')}, {r('b2')}, b2>2*a2 and b2>0.7 and least(n1,n2)>=10 from g""")
_times = lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_shipdate", "l_receiptdate", "l_commitdate", "o_orderdate")
_put("lk7_future_features", lambda s, d: lk.future_features(table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_shipdate", F.col("o_orderdate").cast("timestamp").alias("at")), ["l_shipdate"], "at"), f"""
    select 'l_shipdate' feature, count(*) filter (cast(l_shipdate as timestamp) > cast(o_orderdate as timestamp)) late, {r(f"count(*) filter (cast(l_shipdate as timestamp) > cast(o_orderdate as timestamp))/{D('count(*)')}")} share from lineitem join orders on l_orderkey=o_orderkey""")
_add("lk8_temporal_report", "study", lambda d: lk.temporal_report(d, ["ts"], "ts"), """
    select 'split order' "check", count(*) filter (role='test' and ts<=(select max(ts) from {v} where role='train')) count, count(*) filter (role='test' and ts<=(select max(ts) from {v} where role='train'))>0 leaks from {v} union all select 'future ts', 0, false""")


def _encoded(d):
    """Even rows with the training encoding; of the others each third with a wrong one, the rest with that of all rows."""
    g = d.groupBy("stratum").agg(F.avg(F.when(F.col("role") == "train", F.col("y"))).alias("_a"), F.avg("y").alias("_b"))
    enc = F.when(F.col("row_id") % 2 == 0, F.col("_a")).when(F.col("row_id") % 3 == 0, F.col("_a") + 1.0).otherwise(F.col("_b"))
    return lk.encoding_audit(d.join(g, "stratum").withColumn("enc", enc), "stratum", "enc", "y")


_add("lk9_encoding_audit", "study", _encoded, """
    with g as (select stratum, avg(y) filter (role='train') a, avg(y) b from {v} group by 1), e as (select a, b, case when row_id % 2 = 0 then a when row_id % 3 = 0 then a+1e0 else b end enc from {v} join g using (stratum))
    select count(*) n, count(*) filter (abs(enc-a)<1e-9) train_only, count(*) filter (abs(enc-b)<1e-9 and not abs(enc-a)<1e-9) all_rows from e""")


def _windows(s, d):
    e = table(s, d, "events").select("user_id", "ts", F.col("value").cast("double").alias("value"))
    daily = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.col("day").cast("timestamp").cast("long")).rangeBetween(-3 * 86400, 3 * 86400)
    return lk.window_audit(daily.withColumn("given", F.avg("value").over(w)), "value", "given", "user_id", "day")


_put("lk9_window_audit", _windows, """
    with d as (select user_id, cast(ts as date) as dd, avg(cast(value as double)) v from events group by 1,2), w as (select avg(v) over (partition by user_id order by dd range between interval 3 days preceding and interval 1 days preceding) p, avg(v) over (partition by user_id order by dd range between interval 3 days preceding and interval 3 days following) a from d)
    select count(*) n, count(*) filter (abs(a-p)<1e-9) past_only, count(*) filter (not coalesce(abs(a-p)<1e-9,false)) look_ahead from w""")
_add("lk10_scan", "study", lambda d: lk.scan(d.withColumn("copy", F.col("t") * 2.0), ["x1", "x2", "copy"], "t", ["ts"], "ts"))
_add("lk6_importance_spikes", "study", lambda d: lk.importance_spikes(_permuted(d)), once=True)


def _model(d):
    return bm.tree(d, ["x1", "x2", "y"], "t", "classifier", depth=4)


def _permuted(d):
    return xp.permutation_importance(_model(d), d.select("row_id", "t", "x1", "x2", "y"), ["x1", "x2", "y"], (F.col("t") == F.col("prediction")).cast("double"), repeats=1)


# missing data
_add("md1_missing_profile", "gaps", lambda d: md.missing_profile(d, GAPS, "y"), "select feature, round(rate,6) missing_rate, round(r,6) target_corr, round(gap,6) target_gap, case when rate=0 then 'NONE' when gap>0.1 then 'MNAR' when gap>0.05 then 'MAR' else 'MCAR' end mechanism, abs(r)>=0.1 keep_indicator, abs(r)>0.2 signal, rate>0.3 high_missing from (" + " union all ".join(_M(c) for c in GAPS) + ")")
_add("md2_patterns", "gaps", lambda d: md.missing_patterns(d, GAPS), "select concat(case when acctbal is null then '1' else '0' end, case when nation is null then '1' else '0' end, case when balance is null then '1' else '0' end) pattern, count(*) n from {v} group by 1")
_add("md3_little_test", "gaps", lambda d: md.little_test(d, GAPS))
ASSOC = "select '{c}' feature, '{o}' other, abs(corr(case when {c} is null then 1e0 else 0e0 end, coalesce({o}, (select avg({o}) from {{v}})))) r from {{v}}"
_add("md4_association", "gaps", lambda d: md.association(d, GAPS), "with t as (" + " union all ".join(ASSOC.format(c=c, o=o) for c in GAPS for o in GAPS if o != c) + f") select feature, other, {r('r')} r from t where r is not null qualify row_number() over (partition by feature order by round(r,9) desc, other desc)=1")
_add("md6_mechanism", "gaps", lambda d: md.mechanism(d, GAPS, "y"))
_add("md8_association_tests", "gaps", lambda d: md.association_tests(d, ["acctbal", "nation"], ["seg", "y"]).drop("p", "mechanism"), " union all ".join(f"""
    select '{c}' feature, 'seg' other, 'chi2' test, {r('sum((a-ea)*(a-ea)/ea+(b-eb)*(b-eb)/eb)')} statistic, count(*)-1e0 df from (select a, b, (a+b)*ta/(ta+tb) ea, (a+b)*tb/(ta+tb) eb from (select *, sum(a) over () ta, sum(b) over () tb from (select seg, cast(count(*) filter ({c} is null) as double) a, cast(count(*) filter ({c} is not null) as double) b from {{v}} group by 1)))
    union all select '{c}', 'y', 't', {r('(ma-mb)/sqrt(va/na+vb/nb)')}, round((va/na+vb/nb)*(va/na+vb/nb)/(va/na*va/na/(na-1)+vb/nb*vb/nb/(nb-1)),4) from (select count(y) filter ({c} is null) na, avg(y) filter ({c} is null) ma, var_samp(y) filter ({c} is null) va, count(y) filter ({c} is not null) nb, avg(y) filter ({c} is not null) mb, var_samp(y) filter ({c} is not null) vb from {{v}})""" for c in ("acctbal", "nation")))
_add("md11_pattern_clusters", "gaps", lambda d: md.pattern_clusters(d, GAPS))
_add("md12_impute", "gaps", lambda d: im.impute(d.withColumn("part", F.when(F.col("row_id") % 7 > 0, F.col("seg"))), ["acctbal", "nation", "balance", "part"]))
_add("md14_pooled", "gaps", lambda d: md.pool(im.impute_many(d, ["acctbal", "nation"]).groupBy("imputation").agg(F.avg("acctbal").alias("estimate"), (F.var_samp("acctbal") / F.count("acctbal")).alias("variance"))))
_add("md15_audit", "gaps", lambda d: md.audit(md.missing_profile(d, GAPS, "y")), "with p as (select round(rate,6) rate, case when rate=0 then 'NONE' when gap>0.1 then 'MNAR' when gap>0.05 then 'MAR' else 'MCAR' end m from (" + " union all ".join(_M(c) for c in GAPS) + f"""))
    select {r('max(rate)')} max_rate, {r('avg(rate)')} cell_rate, count(*) filter (m='MNAR') mnar, case when max(rate)>0.2 or count(*) filter (m='MNAR')>0 then 'HIGH' when max(rate)>0.05 then 'MEDIUM' else 'LOW' end severity, case when avg(rate)>0.3 then 'HIGH' when avg(rate)>0.1 then 'MEDIUM' else 'LOW' end cell_severity from p""")

# causal estimates and graphs
SIDES = {"a": "case when t=1 then 1/ps else 0e0 end", "b": "case when t=0 then 1/(1-ps) else 0e0 end", "o": "case when t=0 then ps/(1-ps) else 0e0 end", "t": "case when t=1 then 1e0 else 0e0 end"}
WS = ", ".join(f"sum({w}*y)/sum({w}) m{k}, sqrt(sum(({w})*({w})*(y-u{k})*(y-u{k})))/sum({w}) e{k}" for k, w in SIDES.items())
MEANS = ", ".join(f"sum({w}*y) over ()/sum({w}) over () u{k}" for k, w in SIDES.items())
_add("cs3_effects", "treat", cs.effects, f"""
    with w as (select t, y, ps, {MEANS} from {{v}}), g as (select avg(y) filter (t=1)-avg(y) filter (t=0) naive, avg(t*y/ps-(1-t)*y/(1-ps)) ipw, {WS}, avg(case when ps between 0.05 and 0.95 then 0e0 else 1e0 end) outside, min(ps) lo, max(ps) hi from w),
    h as (select *, ma-mb n, sqrt(ea*ea+eb*eb) se, mt-mo att, sqrt(et*et+eo*eo) ae from g) select {r('naive')} naive, {r('ipw')} ipw, {r('n')} ipw_normalised, {r('se')} ipw_se, {r('n-1.959964e0*se')} ipw_normalised_low, {r('n+1.959964e0*se')} ipw_normalised_high,
    {r('att')} att, {r('ae')} att_se, {r('att-1.959964e0*ae')} att_low, {r('att+1.959964e0*ae')} att_high, {r('outside')} outside, {r('lo')} ps_min, {r('hi')} ps_max, outside<0.1 valid_overlap from h""")
_add("cs2_propensity", "study", lambda d: es.propensity(d, "t", ["x1", "x2"]).agg(F.count("ps").alias("n"), F.round(F.avg("ps"), 4).alias("mean_ps"), F.round(F.avg("t"), 4).alias("share")))
OLS1 = """select b, sqrt(case when n>k then (syy - b*sxy - c*szy)/(n-k) else null end * szz/(sxx*szz-sxz*sxz)) se, n-k df from (select *, (szz*sxy-sxz*szy)/(sxx*szz-sxz*sxz) b, (sxx*szy-sxz*sxy)/(sxx*szz-sxz*sxz) c, 3 k from (
    select count(*) n, covar_pop({x},y)*count(*) sxy, covar_pop({z},y)*count(*) szy, var_pop({x})*count(*) sxx, var_pop({z})*count(*) szz, covar_pop({x},{z})*count(*) sxz, var_pop(y)*count(*) syy from {{v}}))"""
_add("cs5_adjusted_effect", "treat", lambda d: es.adjusted_effect(d, "t", "y", ["x1"]).drop("p", "term"), f"select {r('b')} estimate, {r('se')} se, round(b/se,4) t, df, {r(f'b-{TQ}*se')} low, {r(f'b+{TQ}*se')} high from ({OLS1.format(x='t', z='x1')})")
_add("cs7_matching", "study", lambda d: es.matching(d.withColumn("score", F.col("x1") + F.col("x2") / 1e6), "t", "y", "score"), f"""
    with s as (select row_id, t, y, x1+x2/1e6 s from {{v}}), l as (select *, max(case when t=0 then s end) over (order by s) lc, min(case when t=0 then s end) over (order by s range between current row and unbounded following) rc, max(case when t=1 then s end) over (order by s) lt,
    min(case when t=1 then s end) over (order by s range between current row and unbounded following) rt from s), f as (select t, s, arg_min(y, row_id) y from s group by 1,2),
    p as (select row_id, t, y, case when t=1 then case when rc is null or abs(s-lc)<=abs(rc-s) then lc else rc end else case when rt is null or abs(s-lt)<=abs(rt-s) then lt else rt end end m from l),
    d as (select p.t, case when p.t=1 then p.y-f.y else f.y-p.y end d from p join f on f.t=1-p.t and f.s=p.m) select {r('avg(d)')} ate, {r('avg(d) filter (t=1)')} att, count(d) n from d""")
_add("cs11_did_regression", "treat", lambda d: es.did_regression(d, "t", "y", F.col("post") == 1).select("estimate", "df"), f"select {r('avg(y) filter (t=1 and post=1)-avg(y) filter (t=1 and post=0)-avg(y) filter (t=0 and post=1)+avg(y) filter (t=0 and post=0)')} estimate, count(*)-4 df from {{v}}")
_add("cs12_parallel_trends", "study", lambda d: es.parallel_trends(d.withColumn("year", F.year("ts")), "t", "y", "year", F.col("post") == 0), f"""
    with m as (select t, cast(year(ts) as double) p, avg(y) m from {{v}} where post=0 group by 1,2) select {r('regr_slope(m,p) filter (t=1)')} treated_slope, {r('regr_slope(m,p) filter (t=0)')} control_slope, {r('(regr_slope(m,p) filter (t=1))-(regr_slope(m,p) filter (t=0))')} difference from m""")
_add("cs13_event_study", "study", lambda d: es.event_study(d.withColumn("rel", F.year("ts") - 1998), "t", "y", "rel"), f"""
    with g as (select cast(year(ts)-1998 as integer) period, avg(y) filter (t=1)-avg(y) filter (t=0) gap, count(*) n from {{v}} group by 1) select period, n, {r('gap-(select gap from g where period=-1)')} effect from g""")
_add("cs16_simpson", "treat", cs.simpson, f"""
    with g as (select grouping(stratum)=1 whole, stratum, count(*) n, avg(y) filter (t=1)-avg(y) filter (t=0) e, corr(t,y) r from {{v}} group by rollup(stratum)), v as (select max(sign(r)) filter (whole) wr, max(sign(e)) filter (whole) we, min(sign(r)) filter (not whole) lr, max(sign(r)) filter (not whole) hr, min(sign(e)) filter (not whole) le,
    max(sign(e)) filter (not whole) he, count(e) filter (not whole) k from g) select whole, stratum, n, {r('e')} effect, {r('r')} r, lr=hr and lr<>0 and lr=-wr paradox_by_correlation, le=he and le<>0 and k>1 and le<>we paradox_by_effect from g, v""")
_add("cs17_refuted", "study", lambda d: es.refuted(d, "t", "y", ["x1", "x2"]), once=True)
_add("cs18_audit", "treat", lambda d: es.audit(d.withColumn("ps", F.when(F.col("x1") > 8000, 0.99).otherwise(F.col("ps")))), "select 'overlap' finding, 'MEDIUM' severity from {v} group by () having avg(case when x1>8000 then 1e0 else 0e0 end)>=0.1")
_put("gr1_reach", lambda s, d: gr.reach(load(s, d, "edges"), load(s, d, "edges").select(F.col("src").alias("root")).distinct()), f"with recursive e as (select * from ({text('edges')})), d(root,node) as (select src,dst from e union select root,dst from d join e on node=src) select root, node from d")
_loop = lambda s, d: load(s, d, "edges").unionByName(table(s, d, "supplier").select(F.concat(F.lit("C"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("dst")))
LOOP = f"select src, dst from ({text('edges')}) union all select concat('C', cast(s_suppkey as string)), concat('N', cast(s_nationkey as string)) from supplier"
_put("gr2_cycles", lambda s, d: gr.cycles(_loop(s, d)), f"with recursive e as (select distinct * from ({LOOP})), d(root,node) as (select src,dst from e union select root,dst from d join e on node=src) select distinct node from d where root=node")
_put("gr6_roles", lambda s, d: cs.roles(load(s, d, "trade"), load(s, d, "node_pairs")), f"""
    with e as (select distinct * from ({text('trade')})), p as (select distinct * from ({text('node_pairs')})), k as (select x, y, src node, 'px' k from p join e on dst=x union all select x, y, dst, 'cx' from p join e on src=x union all select x, y, src, 'py' from p join e on dst=y union all select x, y, dst, 'cy' from p join e on src=y),
    g as (select x, y, node, bool_or(k='px') px, bool_or(k='cx') cx, bool_or(k='py') py, bool_or(k='cy') cy from k where node<>x and node<>y group by 1,2,3), o as (select x, y, node, case when px and py then 'confounder' when cx and cy then 'collider' when cx and py then 'mediator' when px then 'parent' end as role from g)
    select *, case when role in ('confounder','parent') then 'adjust' else 'do not adjust' end advice from o where role is not null""")

# models and attribution
_add("bm1_simple_linear", "treat", lambda d: bm.simple_linear(d, "x1", "y"), "select round(regr_slope(y,x1),6) slope, round(regr_intercept(y,x1),6) intercept, round(regr_r2(y,x1),6) r2 from {v}")
_add("bm1_linear", "treat", lambda d: bm.coefficients(d.sparkSession, bm.linear(d, ["t", "x1"], "y"), ["t", "x1"]).select("term", F.round("estimate", 4).alias("estimate")).where("term='t'"), f"select 't' term, round(b,4) estimate from ({OLS1.format(x='t', z='x1')})")
_add("bm2_ridge_lasso", "treat", lambda d: bm.coefficients(d.sparkSession, bm.linear(d, ["t", "x1"], "y", 1.0), ["t", "x1"]).withColumn("kind", F.lit("ridge")).unionByName(bm.coefficients(d.sparkSession, bm.linear(d, ["t", "x1"], "y", 1.0, True), ["t", "x1"]).withColumn("kind", F.lit("lasso"))))
_add("bm3_logistic", "study", lambda d: ev.rates(ev.binary_counts(bm.logistic(d, ["x1", "y"], "t", 1.0).transform(bm.assemble(d, ["x1", "y"])).withColumn("hat", F.col("prediction").cast("int")), "t", "hat")))
_add("bm4_tree", "study", lambda d: ev.rates(ev.binary_counts(_model(d).transform(bm.assemble(d, ["x1", "x2", "y"])).withColumn("hat", F.col("prediction").cast("int")), "t", "hat")))
_add("bm5_forest", "study", lambda d: xp.impurity_importance(d.sparkSession, bm.tree(d, ["x1", "x2", "y"], "t", "forest", trees=5), ["x1", "x2", "y"]))
_add("bm6_elbow", "study", lambda d: bm.elbow(d, ["x1", "x2"], [2, 3]))
_add("bm8_pca", "study", lambda d: bm.pca(d, ["x1", "x2", "y"], 2).select("component", F.round("explained", 4).alias("explained"), "reconstruction_error"))
_add("bm9_out_of_fold", "study", lambda d: bm.out_of_fold(d, ["x1", "x2", "y"], "t", k=5).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("probs")[1]), 3).alias("mean_p")))
_add("bm10_sensitive_study", "scored2", lambda d: bm.sensitive_study(d.withColumn("urgent", (F.col("grp") == "1-URGENT").cast("double")).withColumn("day", F.unix_timestamp("ts").cast("double")), ["y_prob", "day"], "urgent", "y_true", "grp"))
_add("xp1_permutation", "study", _permuted, once=True)
_add("xp2_drop_column", "study", lambda d: xp.drop_importance(d.where("role='train'"), d.where("role='test'"), ["x1", "x2", "y"], lambda t, cols: bm.tree(t, cols, "t", depth=4), (F.col("t") == F.col("prediction")).cast("double")), once=True)
_add("xp4_compare_rankings", "study", lambda d: xp.compare_rankings({"impurity": xp.impurity_importance(d.sparkSession, _model(d), ["x1", "x2", "y"]).drop("rank"), "permutation": _permuted(d)}).drop("ranks"), once=True)
_fit = lambda d: bm.linear(d, ["t", "x1", "x2"], "y")
_shap = lambda d: xp.shapley(_fit(d), d.select("row_id", "t", "x1", "x2"), ["t", "x1", "x2"], F.col("prediction"))
_add("xp5_shapley", "study", _shap, once=True)
_add("xp5_tree_shap", "study", lambda d: ts.tree_shap(bm.tree(d, ["x1", "x2", "y"], "t", "forest", trees=20), d, ["x1", "x2", "y"]), once=True)
_add("xp6_kernel_shap", "study", lambda d: xp.kernel_shap(_fit(d), d.select("row_id", "t", "x1", "x2"), ["t", "x1", "x2"], F.col("prediction"), samples=6), once=True)
_add("xp7_shap_summary", "study", lambda d: xp.shap_summary(_shap(d), d, ["t", "x1", "x2"]), once=True)
_add("xp7_waterfall", "study", lambda d: xp.waterfall(_shap(d), 0.0), once=True)
_lime = lambda d, **k: xp.lime(_fit(d), d.select("row_id", "t", "x1", "x2"), ["t", "x1", "x2"], F.col("prediction"), samples=12, **k)
_add("xp8_lime", "study", lambda d: _lime(d), once=True)
_add("xp8_lime_local", "study", lambda d: xp.lime_local(_fit(d), d.select("row_id", "t", "x1", "x2"), ["t", "x1", "x2"], F.col("prediction")), once=True)
_add("xp9_lime_stability", "study", lambda d: xp.lime_stability(_fit(d), d.select("row_id", "t", "x1", "x2"), ["t", "x1", "x2"], F.col("prediction"), seeds=2, samples=8).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_if("stable").alias("stable")), once=True)
_add("xp10_agreement", "study", lambda d: xp.agreement(_shap(d), _lime(d)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")), once=True)
_add("xp11_explain", "study", lambda d: xp.explain(_shap(d)), once=True)
_add("uq3_ensemble", "multi", lambda d: xp.ensemble_uncertainty(d.unpivot(["row_id"], P3, "model", "p")), f"select row_id, {r('(p0+p1+p2)/3')} mean, {r('(p0*p0+p1*p1+p2*p2)/3-(p0+p1+p2)/3*(p0+p1+p2)/3')} epistemic, {r('(p0*(1-p0)+p1*(1-p1)+p2*(1-p2))/3')} aleatoric, (p0*p0+p1*p1+p2*p2)/3-(p0+p1+p2)/3*(p0+p1+p2)/3>0.1 uncertain from {{v}}")

# governance, files, streams
_metrics = lambda s, d: dr.per_feature(load(s, d, "cohorts")).select(F.lit("drift").alias("module"), "feature", F.lit("psi").alias("metric"), F.col("psi").alias("value"))
GV = f"select 'drift' as module, feature, 'psi' metric, {r('psi')} as value, case when {r('psi')}>0.25 then 'HIGH' when {r('psi')}>0.1 then 'MEDIUM' else 'NONE' end severity from ({PSI})".replace("{v}", f"(select * from ({text('cohorts')}) where value is not null)")
_put("gv4_rules", lambda s, d: gv.apply_rules(_metrics(s, d)), GV)
_put("gv1_risk", lambda s, d: gv.risk(gv.apply_rules(_metrics(s, d))), f"with f as ({GV}), m as (select max(case severity when 'HIGH' then 3 when 'MEDIUM' then 2 else 0 end) l from f) select case l when 3 then 'HIGH' when 2 then 'MEDIUM' else 'NONE' end worst, 0 critical, (select count(*) from f where severity='HIGH') high, (select count(*) from f where severity='MEDIUM') medium, case l when 3 then 'HIGH' when 2 then 'MEDIUM' else 'LOW' end risk from m")
_put("gv6_top_actions", lambda s, d: gv.top_actions(gv.apply_rules(_metrics(s, d))), f"with f as ({GV}) select cast(row_number() over (order by case severity when 'HIGH' then 3 else 2 end desc, value desc, feature) as integer) as rank, module, feature, metric, severity from f where severity<>'NONE'")
_add("gv5_notes", "gappy", lambda d: gv.notes(ev.summary(d)))
_put("io6_summary_export", lambda s, d: io.export_summary(gv.apply_rules(_metrics(s, d))), f"select concat(module,' ',feature,' ',metric) \"Metric\", cast(value as varchar) \"Value\" from ({GV})")
_log = lambda s, d: table(s, d, "events").select(F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(F.concat_ws(" - ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("value") > 100, "ERROR").otherwise("info"), F.concat(F.lit("Event "), F.col("event_id").cast("string")))).alias("value"))
_put("io7_log_search", lambda s, d: io.search_log(io.parse_log(_log(s, d)), "info", "event", 20), """
    select ts, 'INFO' as level, message from (select strftime(ts,'%Y-%m-%d %H:%M:%S') ts, concat('Event ', cast(event_id as varchar)) message from events where event_type<>'view' and not coalesce(value>100,false)) order by ts desc, message limit 20""")


def _windows_of_drift(s, d):
    rows = load(s, d, "cohorts").join(table(s, d, "events").select(F.col("event_id").alias("row_id"), "ts"), "row_id")
    h = dr.histogram(load(s, d, "cohorts"))
    bounds = dr.bounds_of(h.where("ref > 0").select("feature", "value", F.col("ref").alias("n")))
    return mon.drift_status(mon.drift_counts(rows, bounds), dr.psi_bins(h)).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


_C = f"(select c.*, e.ts from ({text('cohorts')}) c join events e on e.event_id=c.row_id where c.value is not null)"
_put("st1_drift_windows", _windows_of_drift, f"""
    with c as {_C}, bd as (select distinct feature, value from ({BOUNDS.replace('{v}', 'c')})), k as (select *, (select count(*) from bd where bd.feature=c.feature and bd.value<=c.value) bin, time_bucket(interval 7 days, ts, timestamp '1970-01-01') w from c),
    rf as (select feature, bin, count(*) filter (cohort='reference') n from k group by 1,2), sp as (select feature, unnest(range(0, 1+(select count(*) from bd b where b.feature=f.feature))) bin from (select distinct feature from c) f),
    p as (select sp.feature, sp.bin, coalesce(n,0)/{D('sum(coalesce(n,0)) over (partition by sp.feature)')}+1e-6 p from sp left join rf on rf.feature=sp.feature and rf.bin=sp.bin), ws as (select distinct w, feature from k), q as (select w, feature, bin, count(*) n from k group by 1,2,3),
    j as (select ws.w, ws.feature, p.p, coalesce(q.n,0) n, coalesce(q.n,0)/{D('sum(coalesce(q.n,0)) over (partition by ws.w, ws.feature)')}+1e-6 q from ws join p on p.feature=ws.feature left join q on q.w=ws.w and q.feature=ws.feature and q.bin=p.bin)
    select strftime(w,'%Y-%m-%d') as start, feature, cast(sum(n) as bigint) n, {r('sum((q-p)*ln(q/p))')} psi, case when sum((q-p)*ln(q/p))>=0.25 then 'DRIFT' when sum((q-p)*ln(q/p))>=0.1 then 'WARN' else 'STABLE' end status from j group by w, feature""")
_add("st2_performance_windows", "gappy", lambda d: mon.performance(d, "60 days", "30 days").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n", "accuracy", "recall", "gap"), f"""
    with k as (select *, time_bucket(interval 30 days, cast(ts as timestamp), timestamp '1970-01-01') b from {{v}}), w as (select b as start, * from k union all select b - interval 30 days, * from k), x as (select start, y_true, y_prob, least(floor(y_prob*10),9) bin from w), g as (select start, bin, count(*) n, abs(sum(y_true-y_prob)) gap from x group by 1,2)
    select strftime(x.start,'%Y-%m-%d') as start, count(*) n, {r('avg(case when (y_prob>=0.5)=(y_true=1) then 1e0 else 0e0 end)')} accuracy, {r(f"count(*) filter (y_true=1 and y_prob>=0.5)/greatest({D('count(*) filter (y_true=1)')},1)")} recall, round((select sum(gap) from g where g.start=x.start),4) gap from x group by x.start""")
_put("st3_sessions", lambda s, d: mon.sessions(table(s, d, "events"), gap="6 hours").select("user", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"), """
    with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end f from events where user_id is not null and ts is not null), g as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) k from o)
    select user_id as user, strftime(min(ts),'%Y-%m-%d %H:%M:%S') as start, count(*) n from g group by user_id, k""")
