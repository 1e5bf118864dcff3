"""All registered queries with their SQL: each applies one operator to a view over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import written
from ..operators import calibration as ca
from ..operators import causal as cs
from ..operators import drift as dr
from ..operators import evaluation as ev
from ..operators import fairness as fa
from ..operators import governance as gv
from ..operators import graphs as gr
from ..operators import prep as pr
from ..operators import stats as st
from ..sources.views import KNOWN, draw, load, text

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, view: str, f, sql: str | None = None, once: bool = False, spread: bool = False) -> None:
    """A query over one view. In the SQL {raw} is the view's text, {v} that of the rows that are known (see KNOWN). With
    ``once`` the view is written first, for queries of many passes; with ``spread`` its tables are dealt out evenly."""
    _QUERIES[name] = lambda spark, sf_dir: f(written(load(spark, sf_dir, view, spread)) if once else load(spark, sf_dir, view, spread))
    if sql:
        known = f"(select * from ({text(view)}) where {KNOWN[view]})" if view in KNOWN else f"({text(view)})"
        _SQL[name] = sql.replace("{raw}", f"({text(view)})").replace("{v}", known)


def _put(name: str, f, sql: str | None = None) -> None:
    """A query over whole tables: f takes (spark, sf_dir)."""
    _QUERIES[name] = f
    if sql:
        _SQL[name] = sql


def queries() -> dict:
    from . import audits  # noqa: F401  the rest of the queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


CONF = "sum(case when y_true=1 and y_pred=1 then 1 else 0 end) tp, sum(case when y_true=0 and y_pred=1 then 1 else 0 end) fp, sum(case when y_true=0 and y_pred=0 then 1 else 0 end) tn, sum(case when y_true=1 and y_pred=0 then 1 else 0 end) fn"
INTS = "cast(tp as bigint) tp, cast(fp as bigint) fp, cast(tn as bigint) tn, cast(fn as bigint) fn"
D = "cast({} as double)".format


def _rates(extra: str = "") -> str:
    return f"""coalesce(round((tp+tn)/nullif({D('tp+fp+tn+fn')},0),6),0) accuracy, coalesce(round(tp/nullif({D('tp+fp')},0),6),0) as precision, coalesce(round(tp/nullif({D('tp+fn')},0),6),0) recall, coalesce(round(2e0*tp/nullif({D('2*tp+fp+fn')},0),6),0) f1"""


_add("ev1_confusion", "scored2", ev.confusion, "select y_true actual, y_pred predicted, count(*) n from {v} group by 1, 2")
_add("ev2_binary_counts", "scored2", lambda d: ev.binary_counts(d, by=["segment"]), f"select segment, {INTS} from (select segment, {CONF} from {{v}} group by 1)")
_add("ev3_rates", "scored2", lambda d: ev.rates(ev.binary_counts(d, by=["grp"])).select("grp", "accuracy", "precision", "recall", "f1", "f2", "specificity", "balanced_accuracy"),
     f"""select grp, {_rates()}, round(5e0*tp/{D('5*tp+4*fn+fp')},6) f2, round(tn/{D('tn+fp')},6) specificity, round((tp/{D('tp+fn')} + tn/{D('tn+fp')})/2,6) balanced_accuracy from (select grp, {CONF} from {{v}} group by 1)""")
_add("ev4_matthews", "scored2", lambda d: ev.rates(ev.binary_counts(d, by=["grp"])).select("grp", "mcc"),
     f"select grp, round(({D('tp')}*tn-{D('fp')}*fn)/sqrt({D('tp+fp')}*(tp+fn)*(tn+fp)*(tn+fn)),6) mcc from (select grp, {CONF} from {{v}} group by 1)")
_add("ev5_kappa", "scored2", lambda d: ev.rates(ev.binary_counts(d, by=["grp"])).select("grp", "kappa"),
     f"select grp, round((po-pe)/(1-pe),6) kappa from (select grp, (tp+tn)/{D('tp+fp+tn+fn')} po, ({D('tp+fp')}*(tp+fn)+{D('fn+tn')}*(fp+tn))/({D('tp+fp+tn+fn')}*(tp+fp+tn+fn)) pe from (select grp, {CONF} from {{v}} group by 1))")
CUMS = "select y_prob threshold, sum(sum(y_true)) over (order by y_prob desc) tp, sum(count(*)-sum(y_true)) over (order by y_prob desc) fp, sum(sum(y_true)) over () ap, sum(count(*)-sum(y_true)) over () an from {v} group by y_prob"
TABLE = f"select threshold, cast(tp as bigint) tp, cast(fp as bigint) fp, cast(an-fp as bigint) tn, cast(ap-tp as bigint) fn from ({CUMS})"
_add("ev6_threshold_table", "gappy", lambda d: ev.threshold_table(d).drop("specificity"), f"select *, round(coalesce(tp/nullif({D('tp+fp')},0),0),6) as precision, round(coalesce(tp/nullif({D('tp+fn')},0),0),6) recall, round(coalesce(2e0*tp/nullif({D('2*tp+fp+fn')},0),0),6) f1, round((tp+tn)/{D('tp+fp+tn+fn')},6) accuracy from ({TABLE})")
_add("ev7_best_f1", "gappy", lambda d: ev.best_f1(ev.threshold_table(d)), f"select threshold, round(round(2e0*tp/{D('2*tp+fp+fn')},6),4) f1 from ({TABLE}) order by f1 desc, threshold desc limit 1")
_add("ev8_best_gmean", "gappy", lambda d: ev.best_gmean(ev.threshold_table(d)), f"select threshold, round(sqrt(round(tp/{D('tp+fn')},6)*round(tn/{D('tn+fp')},6)),6) gmean from ({TABLE}) order by gmean desc, threshold desc limit 1")
_add("ev9_roc_points", "gappy", lambda d: ev.roc_points(ev.threshold_table(d)), f"select round(fp/{D('fp+tn')},6) fpr, round(tp/{D('tp+fn')},6) tpr from ({TABLE}) union select 0e0, 0e0 union select 1e0, 1e0")
AUC = "select {g} round(sum(pos*(cn-neg/2e0))/nullif(sum(pos)*sum(neg),0),6) auc from (select {g} pos, neg, sum(neg) over ({p} order by y_prob) cn from (select {g} y_prob, cast(sum(y_true) as double) pos, cast(count(*)-sum(y_true) as double) neg from {v} group by {g} y_prob)) {h}"
_add("ev10_roc_auc", "gappy", lambda d: ev.auc(d, by=["grp"]), AUC.replace("{g}", "grp,").replace("{p}", "partition by grp").replace("{h}", "group by grp"))
_add("ev12_average_precision", "gappy", ev.average_precision, f"select round(sum((tp-lag_tp)/{D('ap')}*tp/{D('tp+fp')}),6) average_precision from (select *, coalesce(lag(tp) over (order by threshold desc),0) lag_tp from ({CUMS}))")
_add("ev14_log_loss", "gappy", lambda d: ev.log_loss(d, by=["grp"]), "select grp, round(-avg(case when y_true=1 then ln(greatest(1e-15,least(1-1e-15,y_prob))) else ln(1-greatest(1e-15,least(1-1e-15,y_prob))) end),6) log_loss from {v} group by 1")
_add("ev18_residuals", "regress", lambda d: ev.regression(d).select("mean_residual", "std_residual", "max_abs_error"), "select round(avg(y-yhat),3) mean_residual, round(stddev_samp(y-yhat),3) std_residual, round(max(abs(y-yhat)),4) max_abs_error from {v}")
_add("ev19_median_error", "regress", lambda d: ev.regression(d).select("median_abs_error"), "select round(quantile_cont(abs(y-yhat),0.5),4) median_abs_error from {v}")
_add("ev20_grade", "gappy", lambda d: ev.auc(d, by=["grp"]).select("grp", ev.grade(F.col("auc")).alias("grade")), "select grp, case when auc>=0.9 then 'A' when auc>=0.8 then 'B' when auc>=0.7 then 'C' when auc>=0.6 then 'D' else 'F' end grade from (" + AUC.replace("{g}", "grp,").replace("{p}", "partition by grp").replace("{h}", "group by grp") + ")")
_add("ev22_regression_check", "scored2", lambda d: ev.regression_check(*[ev.rates(ev.binary_counts(d, "y_true", p, by=["segment"])) for p in ("y_pred2", "y_pred")], "segment", "accuracy"),
     "select segment, round(a2,6) now, round(a1,6) base, round(round(a2,6)-round(a1,6),6) delta, case when round(a2,6)-round(a1,6) < -0.02 then 'REGRESSION' when round(a2,6)-round(a1,6) < -0.01 then 'WARNING' else 'OK' end status from (select segment, avg(case when y_true=y_pred then 1e0 else 0e0 end) a1, avg(case when y_true=y_pred2 then 1e0 else 0e0 end) a2 from {v} group by 1)")


def _argmax():
    return F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0).when(F.col("p1") >= F.col("p2"), 1).otherwise(2)


BINS = "select {g} cast(least(floor(y_prob*10),9) as integer) bin, count(*) n, avg(y_prob) mp, avg(cast(y_true as double)) fp from {v} group by {g} 2"
_B = lambda g: BINS.replace("{g}", g).replace("group by grp, 2", "group by 1, 2").replace("group by  2", "group by 1")
_add("ca1_reliability", "gappy", lambda d: ca.reliability(d).select("bin", "n", F.round("mean_prob", 6).alias("mean_prob"), F.round("frac_pos", 6).alias("frac_pos")), f"select bin, n, round(mp,6) mean_prob, round(fp,6) frac_pos from ({_B('')})")
_add("ca2_half_open_reliability", "gappy", lambda d: ca.reliability(d, bins=5, half_open=True).select("bin", "n", F.round("frac_pos", 6).alias("frac_pos")), "select cast(floor(y_prob*5) as integer) bin, count(*) n, round(avg(cast(y_true as double)),6) frac_pos from {v} where y_prob<1 group by 1")
_add("ca3_ece_mce", "gappy", lambda d: ca.errors(ca.reliability(d)).select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce")), f"select round(sum(n*abs(fp-mp))/sum(n),6) ece, round(max(abs(fp-mp)),6) mce from ({_B('')})")
_add("ca5_brier", "gappy", lambda d: ca.brier(d, by=["grp"]), "select grp, round(avg((y_prob-y_true)*(y_prob-y_true)),6) brier, round(1-avg((y_prob-y_true)*(y_prob-y_true))/var_pop(cast(y_true as double)),6) skill from {v} group by 1")
_add("ca11_rating", "gappy", lambda d: ca.errors(ca.reliability(d, by=["grp"]), ["grp"]).select("grp", ca.rating(F.col("ece")).alias("rating"), ca.severity(F.col("ece")).alias("severity")),
     f"select grp, case when ece<0.02 then 'EXCELLENT' when ece<0.05 then 'GOOD' when ece<0.1 then 'MODERATE' else 'POOR' end rating, case when ece<0.02 then 'NONE' when ece<0.05 then 'LOW' when ece<0.1 then 'MEDIUM' else 'HIGH' end severity from (select grp, sum(n*abs(fp-mp))/sum(n) ece from ({_B('grp,')}) group by 1)")

RATES = f"select grp, {D('tp+fp+tn+fn')} n, tp,fp,tn,fn, tp/greatest({D('tp+fn')},1) tpr, fp/greatest({D('fp+tn')},1) fpr, tp/greatest({D('tp+fp')},1) ppv, {D('tp+fp')}/(tp+fp+tn+fn) sr from (select {{g}} grp, {CONF} from {{v}} group by 1)"
_R = lambda g: RATES.replace("{g}", g)
_add("fa1_group_rates", "scored2", lambda d: fa.group_rates(d).select("grp", "n", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"), F.round("ppv", 6).alias("ppv"), F.round("selection_rate", 6).alias("selection_rate")), f"select grp, cast(n as bigint) n, round(tpr,6) tpr, round(fpr,6) fpr, round(ppv,6) ppv, round(sr,6) selection_rate from ({_R('grp')})")
_add("fa2_gaps", "scored2", lambda d: fa.gaps(fa.group_rates(d)), f"select round(max(sr)-min(sr),6) dp_gap, max(sr)-min(sr)<0.1 parity, round(max(tpr)-min(tpr),6) tpr_gap, round(max(fpr)-min(fpr),6) fpr_gap, round(greatest(max(tpr)-min(tpr),max(fpr)-min(fpr)),6) eo_gap, greatest(max(tpr)-min(tpr),max(fpr)-min(fpr))<0.1 equalized, round(max(ppv)-min(ppv),6) ppv_gap, round(min(sr)/max(sr),6) di_ratio from ({_R('grp')})")
_add("fa6_disparate_impact", "scored2", lambda d: fa.disparate_impact(fa.group_rates(d, "segment"), "BUILDING", "MACHINERY"), f"select round(p,6) priv_rate, round(u,6) unpriv_rate, round(u/p,6) ratio, u/p between 0.8 and 1.25 passes from (select max(case when grp='BUILDING' then sr end) p, max(case when grp='MACHINERY' then sr end) u from ({_R('segment')}))")
_add("fa11_intersectional", "scored2", lambda d: fa.intersectional(d, ["grp", "segment"]), f"with r as (select * from ({_R('concat(grp, chr(124), segment)')}) where n>=20) select grp, cast(n as bigint) n, round(sr,6) selection_rate, round(abs(sr-(select avg(sr) from r)),6) distance from r")
_add("fa13_default_groups", "scored2", lambda d: fa.default_groups(d, "segment"), "with c as (select segment g, count(*) n from {v} group by 1) select (select g from c order by n desc, g desc limit 1) privileged, (select g from c order by n, g limit 1) unprivileged")

HIST = "select feature, value, sum(case when cohort='reference' then 1 else 0 end) r, sum(case when cohort='reference' then 0 else 1 end) c from {v} group by 1,2"
KS = f"select feature, max(abs(cr/{D('nr')}-cc/{D('nc')})) d from (select feature, sum(r) over (partition by feature order by value) cr, sum(c) over (partition by feature order by value) cc, sum(r) over (partition by feature) nr, sum(c) over (partition by feature) nc from ({HIST})) group by 1"
PSI = f"""select feature, sum((q-p)*ln(q/p)) psi from (select e.feature, e.bin, coalesce({D('r')},0)/nr+1e-6 p, coalesce({D('c')},0)/nc+1e-6 q from
 (select feature, unnest(range(0, k+1)) bin from (select feature, count(distinct value) k from (__B__) group by 1)) e
 left join (select feature, bin, sum(case when cohort='reference' then 1 else 0 end) r, sum(case when cohort='reference' then 0 else 1 end) c from (select v.*, (select count(distinct b.value) from (__B__) b where b.feature=v.feature and b.value<=v.value) bin from {{v}} v) group by 1,2) h on e.feature=h.feature and e.bin=h.bin
 join (select feature, sum(case when cohort='reference' then 1 else 0 end) nr, sum(case when cohort='reference' then 0 else 1 end) nc from {{v}} group by 1) n on e.feature=n.feature) group by 1"""
BOUNDS = "select feature, value from (select feature, value, row_number() over (partition by feature order by value)-1 as i, count(*) over (partition by feature) n from {v} where cohort='reference') where i in (n*1//10,n*2//10,n*3//10,n*4//10,n*5//10,n*6//10,n*7//10,n*8//10,n*9//10)"
PSI = PSI.replace("__B__", BOUNDS)
_add("dr2_psi", "cohorts", dr.psi, f"select feature, round(psi,6) psi, case when psi>=0.25 then 'HIGH' when psi>=0.1 then 'MEDIUM' else 'LOW' end level from ({PSI})")
_add("dr3_psi_equal_width", "cohorts", dr.psi_equal_width, """with e as (select feature, min(value) lo, max(value) hi from {v} group by 1), h as (select v.feature, cast(least(floor((value-lo)*10/(hi-lo)),9) as integer) bin, sum(case when cohort='reference' then 1e0 else 0e0 end) r, sum(case when cohort='reference' then 0e0 else 1e0 end) c from {v} v join e on v.feature=e.feature group by 1,2),
 g as (select e.feature, b.bin, coalesce(r,0) r, coalesce(c,0) c from e cross join (select unnest(range(0,10)) bin) b left join h on e.feature=h.feature and b.bin=h.bin), s as (select feature, greatest(r/sum(r) over (partition by feature),1e-4) p, greatest(c/sum(c) over (partition by feature),1e-4) q from g) select feature, round(sum((q-p)*ln(q/p)),6) psi from s group by 1""")
CAT = "with c as (select category, sum(case when cohort='reference' then 1 else 0 end) r, sum(case when cohort='reference' then 0 else 1 end) c from {v} group by 1), t as (select *, sum(r) over () nr, sum(c) over () nc from c)"
_add("dr5_label_shift", "cat_cohorts", dr.label_shift, f"{CAT}, e as (select *, {D('r+c')}*nr/(nr+nc) er, {D('r+c')}*nc/(nr+nc) ec from t) select round(sum((r-er)*(r-er)/er+(c-ec)*(c-ec)/ec),3) chi2, count(*)-1 df, round(sum(abs({D('r')}/nr-{D('c')}/nc)),6) share_change from e")
_add("rc3_new_categories", "cat_cohorts", dr.new_categories, "select category, count(*) n from {v} where cohort='current' and category not in (select category from {v} where cohort='reference') group by 1")

_add("ds3_modes", "gaps", lambda d: st.modes(d, "seg"), "with c as (select seg as value, count(*) n from {v} group by 1) select * from c where n=(select max(n) from c)")
_add("ds9_impurity", "scored2", lambda d: st.impurity(d, "y_true", "segment"), "select segment, round(1-sum(p*p),6) gini, round(-sum(p*log2(p)),6) entropy from (select segment, count(*)/cast(sum(count(*)) over (partition by segment) as double) p from {v} group by segment, y_true) group by 1")
TWO = "select count(*) filter (t=1) na, avg(y) filter (t=1) ma, var_samp(y) filter (t=1) va, count(*) filter (t=0) nb, avg(y) filter (t=0) mb, var_samp(y) filter (t=0) vb from {v}"
_add("ht7_chi_square", "scored2", lambda d: st.chi_square(d, "segment", "y_pred"), "with c as (select segment a, y_pred b, cast(count(*) as double) n from {v} group by 1,2), x as (select *, sum(n) over (partition by a) na, sum(n) over (partition by b) nb, sum(n) over () t from c), s as (select sum((n-na*nb/t)*(n-na*nb/t)/(na*nb/t)) x, max(t) t, count(distinct a) ka, count(distinct b) kb from x) select round(x,4) chi2, (ka-1)*(kb-1) df, round(sqrt(x/(t*least(ka-1,kb-1))),6) cramers_v from s")
_add("ht8_mann_whitney", "scored", lambda d: st.mann_whitney(d, "y_prob", "y_true", 1, 0), "with h as (select y_prob v, cast(sum(y_true) as double) na, cast(count(*)-sum(y_true) as double) nb from {v} group by 1), p as (select *, sum(nb) over (order by v) c from h), s as (select sum(na*(c-nb/2)) u, sum(na) n, sum(nb) m from p) select round(u,1) u1, round(n*m-u,1) u2, round((u-n*m/2)/sqrt(n*m*(n+m+1)/12),6) z, round(2*u/(n*m)-1,6) rank_biserial from s")
_add("ht12_corrections", "tests", st.corrections, "with r as (select *, row_number() over (order by p_value, test_id) k, count(*) over () m from {v}), a as (select *, min(least(1e0,p_value*m/k)) over (order by k desc rows between unbounded preceding and current row) adj from r) select test_id, round(p_value,6) p_value, round(least(1e0,p_value*m),6) bonferroni, p_value<0.05/m bonferroni_reject, round(adj,6) bh, adj<=0.05 bh_reject from a")
_add("ht15_mcnemar", "scored2", lambda d: st.mcnemar(d, "y_true", "y_pred", "y_pred2"), "with s as (select cast(sum(case when y_true=y_pred and y_true=y_pred2 then 1 else 0 end) as bigint) a, cast(sum(case when y_true=y_pred and y_true<>y_pred2 then 1 else 0 end) as bigint) b, cast(sum(case when y_true<>y_pred and y_true=y_pred2 then 1 else 0 end) as bigint) c, cast(sum(case when y_true<>y_pred and y_true<>y_pred2 then 1 else 0 end) as bigint) d from {v}) select a as both, b first_only, c second_only, d neither, round((abs(b-c)-1)*(abs(b-c)-1)/cast(b+c as double),6) statistic, round((a+b)/cast(a+b+c+d as double),6) accuracy1, round((a+c)/cast(a+b+c+d as double),6) accuracy2, b+c=0 no_discordant from s")
_add("ht16_wilson", "scored2", lambda d: st.proportion_interval(d, "y_pred", "segment"), "with g as (select segment, cast(count(*) as double) n, avg(cast(y_pred as double)) p, 1.959964e0 z from {v} group by 1) select segment, cast(n as bigint) n, round(p,6) p, round((p+z*z/(2*n))/(1+z*z/n)-z/(1+z*z/n)*sqrt(p*(1-p)/n+z*z/(4*n*n)),6) low, round((p+z*z/(2*n))/(1+z*z/n)+z/(1+z*z/n)*sqrt(p*(1-p)/n+z*z/(4*n*n)),6) high from g")

_add("cs10_diff_in_diff", "treat", cs.diff_in_diff, "select round(a,6) treated_post, round(b,6) treated_pre, round(c,6) control_post, round(d,6) control_pre, round(a-b-c+d,6) did from (select avg(y) filter (t=1 and post=1) a, avg(y) filter (t=1 and post=0) b, avg(y) filter (t=0 and post=1) c, avg(y) filter (t=0 and post=0) d from {v})")
_add("cs14_two_stage", "treat", lambda d: cs.two_stage(d, "x1", "t", "y"), "select round(covar_samp(x1,y)/covar_samp(x1,t),6) effect, round(r*r/(1-r*r)*(n-2),2) first_stage_f from (select covar_samp(x1,y) q, corr(x1,t) r, count(*) n from {v}) s, {v} group by r, n")
_QUERIES["gr3_relatives"] = lambda spark, sf: gr.relatives(load(spark, sf, "trade"), load(spark, sf, "node_pairs"))
_SQL["gr3_relatives"] = f"""with recursive e as (select distinct * from ({text('trade')})), p as (select * from ({text('node_pairs')})), s as (select x root from p union select y from p),
    d(root,node) as (select src,dst from e where src in (select root from s) union select root,dst from d join e on node=src), u(root,node) as (select dst,src from e where dst in (select root from s) union select root,src from u join e on node=dst)
    select x, y, 'confounder' kind, a.node from p join u a on a.root=x join u b on b.root=y and b.node=a.node union all select x, y, 'collider', a.node from p join d a on a.root=x join d b on b.root=y and b.node=a.node
    union all select x, y, 'mediator', a.node from p join d a on a.root=x join u b on b.root=y and b.node=a.node"""
P3 = ["p0", "p1", "p2"]
THR = "with t as (select avg(p0) filter (y_noisy=0) t0, avg(p1) filter (y_noisy=1) t1, avg(p2) filter (y_noisy=2) t2 from {v}), a as (select row_id, y_noisy as label, p0,p1,p2,t0,t1,t2, case when p0>=t0 then p0 end c0, case when p1>=t1 then p1 end c1, case when p2>=t2 then p2 end c2 from {v}, t), b as (select *, greatest(c0,c1,c2) m, case y_noisy_ when 0 then p0 when 1 then p1 else p2 end own from (select *, label y_noisy_ from a)), k as (select *, case when m is null then null when m=c0 then 0 when m=c1 then 1 else 2 end confident from b)"
GAPS = ["acctbal", "nation", "balance"]
_M = lambda c: f"select '{c}' feature, avg(case when {c} is null then 1e0 else 0e0 end) rate, corr(case when {c} is null then 1e0 else 0e0 end, y) r, abs(avg(y) filter ({c} is null)-avg(y) filter ({c} is not null)) gap from {{v}}"










_add("pr9_standardise", "treat", lambda d: pr.standardise(d, ["x1"], F.col("post") == 0), "select row_id, round((x1-(select avg(x1) from {v} where post=0))/(select stddev_samp(x1) from {v} where post=0),6) x1 from {v}")
_add("pr13_indicators", "gaps", lambda d: pr.indicators(d, ["acctbal", "y", "balance"]), "select row_id, case when acctbal is null then 1 else 0 end is_missing_acctbal, case when balance is null then 1 else 0 end is_missing_balance from {v}")
_add("vs13_label_check", "multi", lambda d: pr.label_check(d, "y_true", [0, 1]), "select y_true as label, count(*) n, round(count(*)/cast(sum(count(*)) over () as double),6) share, y_true in (0,1) expected, count(*)/cast(sum(count(*)) over () as double)<0.05 minority from {v} group by 1")
_add("lk2_ranked_correlation", "treat", lambda d: pr.ranked_correlation(d, ["t", "x1", "x2"], "y"), "select feature, round(r,6) r, cast(row_number() over (order by r desc) as integer) as rank, r>0.9 suspect from (select 't' feature, abs(corr(t,y)) r from {v} union all select 'x1', abs(corr(x1,y)) from {v} union all select 'x2', abs(corr(x2,y)) from {v})")
_add("uq2_prediction_sets", "multi", lambda d: pr.prediction_sets(d, P3, "y_true"), """with s as (select *, 1-(case y_true when 0 then p0 when 1 then p1 else p2 end) score from {v}), q as (select score q from (select score, row_number() over (order by score)-1 i, count(*) over () n from s) where i=least(cast(floor(0.9*n) as bigint),n-1))
    select round(max(q),6) q, round(avg(case when score<=q+1e-12 then 1e0 else 0e0 end),6) coverage, round(avg((case when p0>=1-q-1e-12 then 1 else 0 end)+(case when p1>=1-q-1e-12 then 1 else 0 end)+(case when p2>=1-q-1e-12 then 1 else 0 end)),6) mean_size from s, q""")
_add("ht14_cohens_h", "scored2", lambda d: pr.cohens_h(d, "y_pred", "segment", "BUILDING", "MACHINERY"), "select round(a,6) p1, round(b,6) p2, round(2*asin(sqrt(a))-2*asin(sqrt(b)),6) h from (select avg(cast(y_pred as double)) filter (segment='BUILDING') a, avg(cast(y_pred as double)) filter (segment='MACHINERY') b from {v})")
_add("gv3_input_checks", "scored", lambda d: pr.input_checks(d, "y_true", "y_prob"), "select count(*) filter (y_true not in (0,1)) bad_labels, count(*) filter (y_prob<0 or y_prob>1) bad_probs, count(*) n, count(*)<30 too_few from {v}")


_add("vs2_folds", "scored", lambda d: d.select("row_id", pr.fold_of("row_id", 5).alias("fold")), f"select row_id, cast(floor({draw('row_id', 'v')} * 5) as integer) fold from {{v}}")
_add("ds5_z_scores", "gaps", lambda d: pr.z_scores(d, "acctbal"), "select row_id, round((acctbal-(select avg(acctbal) from {v}))/(select stddev_samp(acctbal) from {v}),6) z from {v}")
_add("md10_co_missing", "gaps", lambda d: pr.co_missing(d, GAPS), "select a, b, round(r,6) r, r>0.5 together from (" + " union all ".join(f"select '{a}' a, '{b}' b, corr(case when {a} is null then 1e0 else 0e0 end, case when {b} is null then 1e0 else 0e0 end) r from {{v}}" for a, b in (("acctbal", "nation"), ("acctbal", "balance"), ("nation", "balance"))) + ")")


_add("pr1_filters", "scored2", lambda d: pr.filters(d, [{"column": "y_prob", "op": ">", "value": "0.4"}, {"column": "segment", "op": "==", "value": "BUILDING"}, {"column": "absent", "op": "<", "value": 1}]).select("row_id", "segment", "y_prob"), "select row_id, segment, y_prob from {v} where y_prob>0.4e0 and segment='BUILDING'")
_add("ch1_binned_mean", "treat", lambda d: pr.binned_mean(d, "x1", "y"), "select cast(greatest(0, least(ceil((x1-lo)*12/(hi-lo))-1, 11)) as integer) bin, count(*) n, round(avg(y),6) mean from {v}, (select min(x1) lo, max(x1) hi from {v}) group by 1")


def flagship(spark, sf_dir):
    """Findings of the full audit: module, feature, metric, value, severity; a module that fails is a finding of its own."""
    s, s2 = load(spark, sf_dir, "gappy"), load(spark, sf_dir, "scored2")
    status = lambda c: F.when(F.col(c) == "DRIFT", "HIGH").when(F.col(c) == "WARN", "MEDIUM").otherwise("NONE")
    return gv.run_all(spark, {
        "evaluation": lambda: gv.findings(ev.auc(s), "evaluation", "auc", "auc", F.when(F.col("auc") < 0.6, "HIGH").otherwise("NONE")),
        "calibration": lambda: gv.findings(ca.errors(ca.reliability(s)), "calibration", "ece", "ece", ca.severity(F.col("ece"))),
        "fairness": lambda: gv.findings(fa.audit(s2, ["grp", "segment"]), "fairness", "dp_gap", "dp_gap", F.col("dp_severity"), F.col("axis")),
        "drift": lambda: gv.findings(dr.per_feature(load(spark, sf_dir, "cohorts")), "drift", "psi", "psi", status("status"), F.col("feature")),
    })
