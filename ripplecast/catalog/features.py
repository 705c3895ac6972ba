"""A and B: aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as A
from ..operators import graph as N
from ..operators import threads as H
from .registry import query
from .threads import THREADS

UF = {"uf": """
select author, count(distinct subreddit) communities, count(*) comments, count(*) filter (is_hate=1) hate,
  count(*) filter (is_hate=1)/count(*) hate_ratio,
  coalesce(avg(gap), 0) mean_gap, avg(created_utc % 86400) mean_second_of_day
from (select *, created_utc - lag(created_utc) over (partition by author order by created_utc, id) gap from e_comments) z
where author is not null and author <> '[deleted]' group by 1""", "cf": """
select subreddit, count(*) comments, count(*) filter (is_hate=1) hate, count(*) filter (is_hate=1)/count(*) hate_ratio,
  coalesce(avg(gap), 0) mean_gap, avg(created_utc % 86400) mean_second_of_day
from (select *, created_utc - lag(created_utc) over (partition by subreddit order by created_utc, id) gap from e_comments) z group by 1""",
    **THREADS}


def rounded(df, *names, to=6):
    return df.withColumns({n: F.round(n, to) for n in names})


@query("a1_user_features", """
select * replace (round(hate_ratio,6) as hate_ratio, round(mean_gap,4) as mean_gap, round(mean_second_of_day,4) as mean_second_of_day) from uf""", UF)
def _(q):
    return rounded(rounded(A.user_features(q.e), "hate_ratio"), "mean_gap", "mean_second_of_day", to=4)


@query("a2_community_features", """
select f.* replace (round(hate_ratio,6) as hate_ratio, round(mean_gap,4) as mean_gap, round(mean_second_of_day,4) as mean_second_of_day),
  round(r0,6) ratio_0, round(r1,6) ratio_1, round(r2,6) ratio_2
from cf f join (select subreddit, avg(cast(o=0 as int)) r0, avg(cast(o=1 as int)) r1, avg(cast(o=2 as int)) r2
  from (select subreddit, cast(id as bigint) % 3 o from e_comments) x group by 1) y using (subreddit)""", UF)
def _(q):
    out = A.community_features(q.e.withColumn("o", F.col("id").cast("bigint") % 3), ordinal="o")
    return rounded(rounded(out, "hate_ratio", "ratio_0", "ratio_1", "ratio_2"), "mean_gap", "mean_second_of_day", to=4)


@query("a3_user_ordinal_hate", """
select author, count(*) filter (cast(id as bigint) % 5 in (3,4)) user_hate_comments_ord,
  round(count(*) filter (cast(id as bigint) % 5 in (3,4)) / count(*), 6) user_hate_ratio_ord from e_comments group by 1""")
def _(q):
    out = A.user_ordinal_hate(q.e.withColumn("hate_label", (F.col("id").cast("bigint") % 5).cast("string")))
    return rounded(out, "user_hate_ratio_ord")


@query("a3_user_binary_hate", """
select author, count(*) filter (is_hate=1) user_hate_comments_ord, round(count(*) filter (is_hate=1) / count(*), 6) user_hate_ratio_ord from e_comments group by 1""")
def _(q):
    # no number in hate_label: is_hate stands in
    return rounded(A.user_ordinal_hate(q.e.withColumn("hate_label", F.lit("n/a"))), "user_hate_ratio_ord")


@query("a4_submission_features", """
with x as (select d.*, e.embedding v, length(body) % 3 o from d_comments d left join embeddings e on d.id = 'd' || e.vec_id)
select link_id, count(*) comments, round(avg(cast(o=2 as int)),6) hate_ratio, round(avg(cast(o=1 as int)),6) offensive_ratio,
  round(avg(length(body)),6) mean_length, bool_or(o=2) any_hate, count(distinct subreddit) diversity,
  round(avg(cast(v[1] as double)),6) v0, round(avg(cast(v[64] as double)),6) v63 from x group by 1""")
def _(q):
    vectors = q.table("embeddings").select(F.concat(F.lit("d"), "vec_id").alias("id"), "embedding")
    out = A.submission_features(q.d.withColumn("o", F.length("body") % 3), "o", vectors, 64)
    out = out.withColumn("v0", F.get("embedding", 0)).withColumn("v63", F.get("embedding", 63)).drop("embedding")
    return rounded(out, "hate_ratio", "offensive_ratio", "mean_length", "v0", "v63")


@query("a5_user_any_hate", "select author, coalesce(bool_or(is_hate=1), false) any_hate from d_comments group by 1")
def _(q):
    return A.user_any_hate(q.d)


@query("a6_community_ranking", """
(select subreddit, comments, round(hate_ratio,6) hate_ratio, 'hate' side from cf order by cf.hate_ratio desc, subreddit limit 3)
union all (select subreddit, comments, round(hate_ratio,6) hate_ratio, 'normal' side from cf order by cf.hate_ratio, subreddit limit 3)""", UF)
def _(q):
    return rounded(A.community_ranking(q.e, 3), "hate_ratio")


@query("a6_community_two_stage", """
select subreddit, round(mean,6) mean, comments from (select * from (select source subreddit, avg(n_chars) mean, count(*) comments from documents group by 1
  order by 2 desc, 1 limit 10) a order by comments desc, subreddit limit 5) b""")
def _(q):
    docs = q.table("documents").withColumnRenamed("source", "subreddit")
    return rounded(A.community_two_stage(docs, "n_chars", 10, 5), "mean")


@query("a7_influential_users", """
select author, round(hate_ratio*ln(comments+1),6) influence, round(hate_ratio,6) hate_ratio, comments, communities from uf
where comments >= 3 order by hate_ratio*ln(comments+1) desc, author limit 20""", UF)
def _(q):
    return rounded(A.influential_users(q.e), "influence", "hate_ratio")


@query("a7_influential_comments", """
with r as (select pid id, count(*) replies, count(*) filter (is_hate=1) hate_replies from cp where pid is not null group by 1),
s as (select c.id, hate_replies/replies*ln(replies+1) infl, replies, hate_replies, hate_replies/replies hrr, body from r join c_comments c using (id))
select id, round(infl,6) influence, replies, hate_replies, round(hrr,6) hate_reply_ratio,
  case when length(body)>100 then substr(body,1,100)||'...' else body end as text from s order by round(infl,9) desc, id limit 20""")
def _(q):
    return rounded(A.influential_comments(q.c), "influence", "hate_reply_ratio")


@query("a7_influential_communities", """
select subreddit, round(hate_ratio*ln(comments+1),6) influence, round(hate_ratio,6) hate_ratio, comments from cf
where comments >= 10 order by hate_ratio*ln(comments+1) desc, subreddit limit 10""", UF)
def _(q):
    return rounded(A.influential_communities(q.e), "influence", "hate_ratio")


VULNERABLE = """select link_id, subreddit, comments, authors, hate/comments hate_ratio,
  0.4*hate/comments + 0.3*comments/50.0 + 0.2*span/3600.0 + 0.1*(1-authors/comments) vulnerability from ethreads where comments >= 2"""


@query("a8_thread_vulnerability", f"""
select * replace (round(hate_ratio,6) as hate_ratio, round(vulnerability,6) as vulnerability) from ({VULNERABLE}) v""", UF)
def _(q):
    return rounded(A.thread_vulnerability(q.e), "hate_ratio", "vulnerability")


@query("a8_user_vulnerability", """
select author, round(0.6*hate_ratio+0.4*(1-communities/10.0),6) vulnerability, round(hate_ratio,6) hate_ratio, communities, comments
from uf where comments >= 2 order by round(0.6*hate_ratio+0.4*(1-communities/10.0),9) desc, author limit 20""", UF)
def _(q):
    return rounded(A.user_vulnerability(q.e), "vulnerability", "hate_ratio")


@query("a8_vulnerability_summary", f"""
select subreddit, round(avg(vulnerability),6) mean, count(*) filter (vulnerability > 0.5) high, count(*) threads
from ({VULNERABLE}) v group by grouping sets ((subreddit), ())""", UF)
def _(q):
    return rounded(A.vulnerability_summary(q.e), "mean")


@query("a9_dataset_profile", """
select count(*) samples, count(*) filter (is_hate=1) hate, count(*) filter (is_hate=0) normal, count(*) filter (is_hate is null) unlabelled,
  count(distinct author) users, count(distinct subreddit) communities, round(avg(length(body)),6) mean_length,
  round(avg(is_hate),6) hate_ratio, avg(is_hate) between 0.4 and 0.6 balanced, round(1-2*abs(0.5-avg(is_hate)),6) balance from d_comments""")
def _(q):
    return rounded(A.dataset_profile(q.d), "mean_length", "hate_ratio", "balance")


@query("a10_hourly_profile", """
select hour(make_timestamp(created_utc*1000000)) as hour, count(*) comments, round(avg(is_hate),6) hate_ratio from e_comments group by 1""")
def _(q):
    return rounded(A.hourly_profile(q.e), "hate_ratio")


@query("a10_daily_labels", """
select strftime(make_timestamp(created_utc*1000000),'%Y-%m-%d') as day, count(*) filter (is_hate=0) label_0, count(*) filter (is_hate=1) label_1 from e_comments group by 1""")
def _(q):
    return A.daily_labels(q.e)


@query("a10_daily_communities", """
select strftime(make_timestamp(created_utc*1000000),'%Y-%m-%d') as day, subreddit, count(*) comments, count(*) filter (is_hate=1) hate from e_comments group by 1, 2""")
def _(q):
    return A.daily_communities(q.e)


@query("a11_hate_scores", """
select x.id, round(x.score/50.0*x.score,6) hate_score_self, round(coalesce(y.score/50.0*y.score,0),6) hate_score_ctx from ep x left join ep y on x.pid=y.id""")
def _(q):
    out = A.hate_scores(H.parent_attributes(q.e.withColumn("prob", F.col("score") / 50.0)))
    return rounded(out.select("id", "hate_score_self", "hate_score_ctx"), "hate_score_self", "hate_score_ctx")


@query("a12_graph_stats", """
select 'node' what, 'comment' kind, count(distinct id) as "count", cast(null as bigint) as "first", cast(null as bigint) as "last" from e_comments
union all select 'node', 'submission', count(distinct link_id), null, null from e_comments
union all select 'edge', '0', count(*), min(x.created_utc), max(x.created_utc) from ep x join ep y on x.pid=y.id
union all select 'edge', '1', count(*), min(created_utc), max(created_utc) from ep where pid is null""")
def _(q):
    return A.graph_stats(N.temporal_nodes(q.e), N.temporal_edges(q.e))


@query("a13_class_weights", """
with n as (select is_hate label, count(*) n from e_comments where is_hate is not null group by 1)
select label, n, round(least(3.0, greatest(0.5, (select sum(n) from n)/((select count(*) from n)*n))),6) weight from n""")
def _(q):
    return rounded(A.class_weights(q.e), "weight")


@query("a14_window_activity", "select created_utc - created_utc % 3600 bin, count(*) comments from e_comments group by 1")
def _(q):
    return A.window_activity(q.e)


@query("b1_balance_classes", """
with r as (select *, row_number() over (partition by is_hate order by md5('42|' || id), id) k from d_comments where is_hate is not null)
select id, is_hate from r where k <= (select min(n) from (select count(*) n from d_comments where is_hate is not null group by is_hate) z)""")
def _(q):
    return A.balance_classes(q.d).select("id", "is_hate")
