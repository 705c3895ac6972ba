"""E and M: evaluation and moderation what-ifs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import graph as N
from ..operators import moderation as M
from .features import rounded
from .graph import G
from .registry import query

# label and score of the events: the score is taken as a probability out of 100
R = {"scored": "select id, link_id, subreddit, score/100.0 p, is_hate y, case when score/100.0 > 0.5 then 1 else 0 end hat from e_comments"}


def ranking(q):
    p = F.col("score") / 100.0
    return q.e.select("id", "link_id", "subreddit", p.alias("score"), F.col("is_hate").alias("label"), F.when(p > 0.5, 1).otherwise(0).alias("predicted"))


CONF = """count(*) filter (y=1 and hat=1) tp, count(*) filter (y=0 and hat=1) fp, count(*) filter (y=1 and hat=0) fn, count(*) filter (y=0 and hat=0) tn"""
METRIC = """tp, fp, fn, tn, round((tp+tn)/(tp+fp+fn+tn),6) accuracy, round(coalesce(tp/nullif(tp+fp,0),0),6) "precision", round(coalesce(tp/nullif(tp+fn,0),0),6) recall,
  round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0),6) f1, tp+fp predicted_positives, tp+fn actual_positives, tp+fp+fn+tn total"""


@query("e1_binary_metrics", f"select {METRIC} from (select {CONF} from scored) z", R)
def _(q):
    return rounded(E.binary_metrics(ranking(q)), "accuracy", "precision", "recall", "f1")


@query("e1_metrics_by_community", f"select subreddit, {METRIC} from (select subreddit, {CONF} from scored group by 1) z", R)
def _(q):
    return rounded(E.binary_metrics(ranking(q), by=["subreddit"]), "accuracy", "precision", "recall", "f1")


@query("e2_roc_auc", """
with s as (select p, count(*) filter (y=1) a, count(*) filter (y=0) b from scored group by 1),
c as (select a, b, coalesce(sum(a) over (order by p desc rows between unbounded preceding and 1 preceding), 0) above from s)
select round(sum(b*(above + a/2.0))/(sum(a)*sum(b)), 6) roc_auc from c""", R)
def _(q):
    return rounded(E.roc_auc(ranking(q)), "roc_auc")


AP = """
with s as (select {g}, p, count(*) filter (y=1) a, count(*) n from scored group by all),
c as (select {g}, a, sum(a) over (partition by {g} order by p desc) tp, sum(n) over (partition by {g} order by p desc) k from s)"""


@query("e3_average_precision", AP.format(g="1 as one").replace("partition by 1 as one ", "") .replace("select 1 as one, a", "select a")
       + " select round(sum(a*tp/k)/sum(a), 6) average_precision from c", R)
def _(q):
    return rounded(E.average_precision(ranking(q)), "average_precision")


@query("e3_average_precision_by_group", AP.format(g="link_id")
       + " select link_id, round(sum(a*tp/k)/sum(a), 6) average_precision from c group by 1 having sum(a) > 0", R)
def _(q):
    return rounded(E.average_precision(ranking(q), by=["link_id"]), "average_precision")


RANKED = {**R, "ranked": "select *, row_number() over (partition by link_id order by p desc, id) k, count(*) over (partition by link_id) n, sum(y) over (partition by link_id) pos from scored"}


@query("e4_hit_at_k", """
select round(avg(cast(b <= 1 as int)) filter (n >= 1), 6) hit_1, round(avg(cast(b <= 5 as int)) filter (n >= 5), 6) hit_5,
  round(avg(cast(b <= 10 as int)) filter (n >= 10), 6) hit_10 from (select link_id, max(n) n, min(k) filter (y=1) b from ranked where pos > 0 group by 1) z""", RANKED)
def _(q):
    return rounded(E.hit_at_k(ranking(q), "link_id", "id"), "hit_1", "hit_5", "hit_10")


@query("e5_recall_at_k", """
select link_id, cast(max(pos) as bigint) positives, round(coalesce(count(*) filter (y=1 and k <= 10)/nullif(max(pos),0), 0), 6) recall from ranked group by 1""", RANKED)
def _(q):
    return rounded(E.recall_at_k(ranking(q), "link_id", "id", 10), "recall")


@query("e6_mrr", "select round(avg(1.0/b), 6) mrr from (select min(k) filter (y=1) b from ranked where pos > 0 group by link_id) z", RANKED)
def _(q):
    return rounded(E.mrr(ranking(q), "link_id", "id"), "mrr")


@query("e7_jaccard", """
select round(avg(coalesce(b/nullif(e,0),0)), 6) jaccard from (select count(*) filter (y=1 and p>0.1) b, count(*) filter (y=1 or p>0.1) e from scored group by link_id) z""", R)
def _(q):
    return rounded(E.jaccard(ranking(q), "link_id", threshold=0.1), "jaccard")


@query("e8_f1_at_adaptive_k", """
select link_id, cast(max(pos) as bigint) positives, round(2*count(*) filter (y=1 and k <= greatest(5, 2*pos)) / (least(max(n), greatest(5, 2*max(pos))) + max(pos)), 6) f1
from ranked group by 1""", RANKED)
def _(q):
    return rounded(E.f1_at_adaptive_k(ranking(q), "link_id", "id"), "f1")


BEST = """
with t as (select round(i*0.05, 2)::double t from range({lo},{hi}) g(i)),
s as (select t, 2*count(*) filter (y=1 and p {op} t) / (count(*) filter (p {op} t) + count(*) filter (y=1)) f from scored, t group by 1)
select t threshold, round(f, 6) f1 from s order by f desc, t limit 1"""


@query("e9_best_threshold", BEST.format(lo=1, hi=20, op=">="), R)
def _(q):
    return rounded(E.best_threshold(ranking(q)), "f1")


@query("e9_best_threshold_strict", BEST.format(lo=2, hi=18, op=">"), R)
def _(q):
    return rounded(E.best_threshold(ranking(q), grid=[round(0.05 * i, 2) for i in range(2, 18)], strict=True), "f1")


@query("e10_adaptive_threshold", "select round(greatest(0.1, least(0.5, 10*avg(y))), 6) threshold from scored", R)
def _(q):
    return rounded(E.adaptive_threshold(ranking(q)), "threshold")


PATTERNS = {**G, **R, "patterns": """
with m as (select 'user_' || author source, avg(score) mean_score, count(*) candidates from e_comments group by 1),
d as (select src source, count(*) degree from egraph group by 1)
select source, mean_score, candidates, case when mean_score > (select quantile_cont(mean_score, 0.5) from m) then 'high' else 'low' end side, degree from m left join d using (source)"""}


def patterns(q):
    scored = q.e.select(F.concat(F.lit("user_"), "author").alias("source"), "score")
    return E.diffusion_patterns(scored, N.degrees(N.one_way(N.user_comment_graph(q.e))))


@query("e11_diffusion_patterns", "select * replace (round(mean_score, 6) as mean_score) from patterns", PATTERNS)
def _(q):
    return rounded(patterns(q), "mean_score")


@query("e11_scores_by_degree", "select degree, count(*) sources, round(avg(mean_score), 6) mean_score from patterns group by 1", PATTERNS)
def _(q):
    return rounded(E.scores_by_degree(patterns(q)), "mean_score")


@query("e12_audit", """
with s as (select id, is_hate from d_comments where is_hate is not null order by md5('42|' || id), id limit 100)
select count(*) checked, round(avg(cast(is_hate = (length(body) % 2) as int)), 6) accuracy from s join d_comments using (id, is_hate)""")
def _(q):
    labelled = q.d.where("is_hate is not null").select("id", F.col("is_hate").alias("label"))
    verdicts = q.d.select("id", (F.length("body") % 2).alias("verdict"))
    return rounded(E.audit_accuracy(E.audit_sample(labelled), verdicts), "accuracy")


@query("e13_compare_models", f"""
with m as (select id, y, case when p > 0.5 then 1 else 0 end hat, 'half' model from scored union all select id, y, case when p > 0.1 then 1 else 0 end, 'tenth' from scored),
c as (select model, {CONF} from m group by 1),
f as (select model, 2*tp/(2*tp+fp+fn) f from c)
select model, {METRIC}, round((2*tp/(2*tp+fp+fn) - (select f from f where model='half'))/(select f from f where model='half')*100, 6) f1_improvement from c""", R)
def _(q):
    r = ranking(q)
    second = r.withColumn("predicted", F.when(F.col("score") > 0.1, 1).otherwise(0)).withColumn("model", F.lit("tenth"))
    out = E.compare_models(r.withColumn("model", F.lit("half")).unionByName(second), "half")
    return rounded(out, "accuracy", "precision", "recall", "f1", "f1_improvement")


@query("e13_ranking_report", """
with b as (select link_id, max(n) n, min(k) filter (y=1) b from ranked where pos > 0 group by 1),
j as (select count(*) filter (y=1 and p>0.1) b, count(*) filter (y=1 or p>0.1) e from scored group by link_id)
select round(avg(cast(b <= 1 as int)) filter (n >= 1), 6) hit_1, round(avg(cast(b <= 5 as int)) filter (n >= 5), 6) hit_5, round(avg(cast(b <= 10 as int)) filter (n >= 10), 6) hit_10,
  round(avg(cast(b <= 20 as int)) filter (n >= 20), 6) hit_20, round(avg(1.0/b), 6) mrr, (select round(avg(coalesce(b/nullif(e,0),0)), 6) from j) jaccard,
  (select count(*) from patterns where side = 'high') high_patterns, (select count(*) from patterns where side = 'low') low_patterns from b""", {**RANKED, **PATTERNS})
def _(q):
    out = E.ranking_report(ranking(q), patterns(q), "link_id", "id", threshold=0.1)
    return rounded(out, "hit_1", "hit_5", "hit_10", "hit_20", "mrr", "jaccard")


# moderation: a label that makes some authors and one community stand out
FLAG = "cast(is_hate = 1 or (author_no % 5 = 0 and cast(id as bigint) % 3 <> 0) or (subreddit = 'error' and cast(id as bigint) % 2 = 0) as int)"
MOD = {
    "mod": f"select * replace ({FLAG} as is_hate) from (select *, cast(substr(author, 2) as bigint) author_no from e_comments) z",
    "drop_content": "select id from mod where is_hate = 1 qualify row_number() over (order by md5('42|' || id), id) <= floor((select count(*) from mod where is_hate = 1)*0.2)",
    "bad_users": "select author, count(*) n from mod group by 1 having avg(is_hate) > 0.5 and count(*) >= 3",
    "bad_subs": "select subreddit from mod group by 1 having avg(is_hate) > 0.3",
    "drop_users": "select author from bad_users qualify row_number() over (order by md5('42|' || author), author) <= floor((select count(*) from bad_users)*0.1 + 1e-9)",
    "drop_subs": "select subreddit from bad_subs qualify row_number() over (order by md5('42|' || subreddit), subreddit) <= greatest(1, floor((select count(*) from bad_subs)*0.1))",
    # the combined strategy, step by step
    "m1": "select * from mod where id not in (select id from mod where is_hate = 1 qualify row_number() over (order by md5('42|' || id), id) <= floor((select count(*) from mod where is_hate = 1)*0.09))",
    "u1": "select author from m1 group by 1 having avg(is_hate) > 0.5 and count(*) >= 3",
    "m2": "select * from m1 where author not in (select author from u1 qualify row_number() over (order by md5('42|' || author), author) <= floor((select count(*) from u1)*0.045 + 1e-9))",
    "s1": "select subreddit from m2 group by 1 having avg(is_hate) > 0.3",
    "m3": "select * from m2 where subreddit not in (select subreddit from s1 qualify row_number() over (order by md5('42|' || subreddit), subreddit) <= 1)",
}
KEPT = {
    "content_removal": "select * from mod where id not in (select id from drop_content)",
    "user_banning": "select * from mod where author not in (select author from drop_users)",
    "subreddit_banning": "select * from mod where subreddit not in (select subreddit from drop_subs)",
    "combined_intervention": "select * from m3",
}


def mod(q):
    e = q.e.withColumn("author_no", F.substring("author", 2, 20).cast("bigint"))
    return e.withColumn("is_hate", F.expr(FLAG)).drop("author_no")


@query("m1_flag_targets", """
select 'content' kind, id as key from mod where is_hate = 1 union all select 'user', author from bad_users union all select 'community', subreddit from bad_subs""", MOD)
def _(q):
    return M.flag_targets(mod(q))


@query("m2_remove_content", f"select id, is_hate from ({KEPT['content_removal']}) z", MOD)
def _(q):
    return M.remove_content(mod(q)).select("id", "is_hate")


@query("m3_ban_users", f"select id, author from ({KEPT['user_banning']}) z", MOD)
def _(q):
    return M.ban_users(mod(q)).select("id", "author")


@query("m4_ban_communities", f"select id, subreddit from ({KEPT['subreddit_banning']}) z", MOD)
def _(q):
    return M.ban_communities(mod(q)).select("id", "subreddit")


@query("m5_combined", f"select id, author, subreddit from ({KEPT['combined_intervention']}) z", MOD)
def _(q):
    return M.combined(mod(q)).select("id", "author", "subreddit")


IMPACT = {**MOD, "impact": "with b as (select count(*) n, avg(is_hate) r, count(distinct id) + count(distinct link_id) g from mod), a as ("
    + " union all ".join(f"select '{k}' strategy, count(*) n, avg(is_hate) r, count(distinct id) + count(distinct link_id) g from ({v}) z" for k, v in KEPT.items())
    + """) select strategy, b.r original_ratio, a.r new_ratio, (b.r-a.r)/b.r hate_reduction, a.n remaining, b.g - a.g nodes_removed,
  greatest(0, 100*(b.r-a.r)/b.r - 20*(1-a.g/b.g) - 40*greatest(0, (1-a.n/b.n)-0.5)) effectiveness from a, b"""}


@query("m6_impact", """
select strategy, round(original_ratio,6) original_ratio, round(new_ratio,6) new_ratio, round(hate_reduction,6) hate_reduction, remaining, nodes_removed,
  round(effectiveness,6) effectiveness from impact""", IMPACT)
def _(q):
    return rounded(M.impact(mod(q)), "original_ratio", "new_ratio", "hate_reduction", "effectiveness")


@query("m6_best_strategy", "select strategy, round(effectiveness,6) effectiveness from impact order by impact.effectiveness desc, strategy limit 1", IMPACT)
def _(q):
    return rounded(E.best_strategy(M.impact(mod(q))), "effectiveness")


@query("m6_graph_connectivity", """
with one as (select distinct least(x.pid, x.id) src, greatest(x.pid, x.id) dst from cp x join cp y on x.pid = y.id union select distinct least(link_id, id), greatest(link_id, id) from cp where pid is null),
nodes as (select id node from cp union select link_id from cp)
select (select count(*) from nodes) nodes, (select count(*) from one) edges, cast(0 as double) clustering, (select count(distinct link_id) from cp) components,
  (select max(n) + 1 from (select count(*) n from cp group by link_id) z) largest""")
def _(q):
    return rounded(M.graph_connectivity(q.c), "clustering")
