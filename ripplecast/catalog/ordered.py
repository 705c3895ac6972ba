"""W and X1-X4, X8: ordered analytics and batch windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as W
from ..operators import windows as X
from .features import UF, rounded
from .graph import VEC, vectors
from .registry import query

CONTEXT = {"context": """
select x.id, x.link_id, is_hate actual, h / n thread_ratio, n thread_size, created_utc - f since_first,
  coalesce(uf.hate_ratio, 0) author_ratio, coalesce(cf.hate_ratio, 0) community_ratio
from (select *, count(*) over w n, count(*) filter (is_hate=1) over w h, min(created_utc) over (partition by link_id) f from e_comments
  window w as (partition by link_id order by created_utc, id rows between unbounded preceding and 1 preceding)) x
left join uf using (author) left join cf using (subreddit) where n > 0""", **UF}


@query("w1_thread_context", """
select id, link_id, actual, round(thread_ratio,6) thread_ratio, thread_size, cast(since_first as double) since_first,
  round(author_ratio,6) author_ratio, round(community_ratio,6) community_ratio from context""", CONTEXT)
def _(q):
    return rounded(W.thread_context(q.e), "thread_ratio", "author_ratio", "community_ratio")


DYNAMICS = {"dynamics": """
select id, link_id, min(gap)/1000000 time_to_first, count(*) filter (hate=1) hate_in_first, count(*) responses from (
  select a.id, a.link_id, b.us - a.us gap, b.is_hate hate, row_number() over (partition by a.id order by b.us, b.id) k
  from e_comments a join e_comments b on a.link_id = b.link_id and a.is_hate = 1 and b.us > a.us) z where k <= 5 group by 1, 2"""}


@query("w2_response_dynamics", "select * replace (round(time_to_first, 6) as time_to_first) from dynamics", DYNAMICS)
def _(q):
    return rounded(W.response_dynamics(q.e, ts="us", unit=1_000_000), "time_to_first")


@query("w2_response_summary", """
select round(avg(time_to_first),4) mean, round(quantile_cont(time_to_first,0.5),4) median, round(min(time_to_first),4) min, round(max(time_to_first),4) max,
  count(*) answered from dynamics""", DYNAMICS)
def _(q):
    return rounded(W.response_summary(W.response_dynamics(q.e, ts="us", unit=1_000_000)), "mean", "median", "min", "max", to=4)


@query("w3_proximity_pairs", """
with o as (select *, row_number() over (partition by link_id order by created_utc, id) k from e_comments)
select a.link_id, a.id parent, b.id child, cast(b.created_utc - a.created_utc as double) gap
from o a join o b on a.link_id = b.link_id and b.k between a.k + 1 and a.k + 4 where b.created_utc - a.created_utc <= 3600""")
def _(q):
    return W.proximity_pairs(q.e)


HISTORY = {"history": """
select a.id, a.author, ln(1+count(*) filter (b.us >= a.us - 604800000000)) count_7,
  coalesce(avg(b.is_hate) filter (b.us >= a.us - 604800000000), 0) hate_rate_7, ln(1+count(b.us)) count_30, coalesce(avg(b.is_hate), 0) hate_rate_30
from e_comments a left join e_comments b on a.author = b.author and b.us < a.us and b.us >= a.us - 2592000000000 group by 1, 2"""}


@query("w4_author_history", """
select id, author, round(count_7,6) count_7, round(hate_rate_7,6) hate_rate_7, round(count_30,6) count_30, round(hate_rate_30,6) hate_rate_30 from history""", HISTORY)
def _(q):
    return rounded(W.author_history(q.e), "count_7", "hate_rate_7", "count_30", "hate_rate_30")


@query("w5_author_running_rate", """
select id, author, count(*) over w as before, round(coalesce(count(*) filter (is_hate=1) over w / nullif(count(*) over w, 0), 0), 6) running_rate from e_comments
window w as (partition by author order by created_utc, id rows between unbounded preceding and 1 preceding)""")
def _(q):
    return rounded(W.author_running_rate(q.e), "running_rate")


@query("w6_author_gap", """
with b as (select a.id, a.author, count(b.id) n, min(b.created_utc) lo, max(b.created_utc) hi
  from e_comments a left join e_comments b on a.author=b.author and b.created_utc < a.created_utc group by 1, 2)
select id, author, round(case when n >= 2 then ln(1+(hi-lo)/(n-1)) else 10.0 end, 6) author_gap from b""")
def _(q):
    return rounded(W.author_gap(q.e), "author_gap")


@query("w6_author_gap_first", """
with o as (select *, row_number() over (partition by author order by created_utc, id) k from e_comments),
f as (select author, list(created_utc order by k) t from o where k <= 5 group by 1),
b as (select a.id, a.author, count(b.id) n from e_comments a left join e_comments b on a.author=b.author and b.created_utc < a.created_utc group by 1, 2)
select id, author, round(case when n >= 2 then ln(1+(t[least(n,5)]-t[1])/(least(n,5)-1)) else 10.0 end, 6) author_gap from b join f using (author)""")
def _(q):
    return rounded(W.author_gap(q.e, first=5), "author_gap")


SIMILARITY = """
with v as ({vec}),
o as (select c.*, row_number() over (partition by link_id order by created_utc, id) k, v from {t} c left join v using (id)),
r as (select author, avg(is_hate) author_ratio from {t} group by 1), s as (select subreddit, avg(is_hate) community_ratio from {t} group by 1),
ctx as (select id, count(*) over w n, avg(is_hate) over w thread_ratio, count(v) over w m, v is not null has, link_id, k from o
  window w as (partition by link_id order by k rows between unbounded preceding and 1 preceding) qualify has and count(*) over w > 0),
d as (select id, i, v[i] x, avg(v[i]) over (partition by link_id, i order by k rows between unbounded preceding and 1 preceding) y from o, range(1,65) g(i) qualify v is not null),
sim as (select id, sum(x*y)/(sqrt(sum(x*x))*sqrt(sum(y*y))+1e-8) similarity from d group by 1),
f as (select o.id, o.link_id, o.is_hate actual, similarity, 0.4*greatest(0,similarity)+0.3*thread_ratio+0.2*author_ratio+0.1*community_ratio score,
  case when thread_ratio > 0.5 then 0.2 when community_ratio > 0.3 then 0.22 when m < 2 then 0.3 else 0.25 end tau
  from o join ctx using (id) join sim using (id) join r using (author) join s using (subreddit))
select id, link_id, actual, round(similarity,5) similarity, round(score,5) score, case when score > tau then 1 else 0 end predicted from f"""


@query("w7_context_similarity", SIMILARITY.format(vec=VEC, t="c_comments"))
def _(q):
    return rounded(W.context_similarity(q.c, vectors(q, q.c), 64), "similarity", "score", to=5)


@query("w7_context_similarity_long", SIMILARITY.format(vec=VEC.replace("c_comments", "e_comments"), t="e_comments"))
def _(q):
    return rounded(W.context_similarity(q.e, vectors(q, q.e), 64), "similarity", "score", to=5)  # threads of 50


@query("w8_time_split", """
select id, case when created_utc <= lo + 900 then 'validate' when created_utc <= hi - 900 then 'train' else 'test' end split
from e_comments, (select min(created_utc) lo, max(created_utc) hi from e_comments)""")
def _(q):
    return W.time_split(q.e).select("id", "split")


@query("w9_fraction_split", """
with o as (select id, row_number() over (order by created_utc, id) - 1 p, count(*) over () n from e_comments)
select id, case when p < floor(n*0.7) then 'train' when p < floor(n*0.85) then 'val' else 'test' end split from o""")
def _(q):
    return W.fraction_split(q.e).select("id", "split")


@query("w9_snapshot_split", """
with b as (select bin, row_number() over (order by bin) - 1 p, count(*) over () n from (select distinct created_utc - created_utc % 3600 bin from e_comments) z)
select bin, case when p < floor(n*cast(0.7 as double)) then 'train' else 'test' end split from b""")
def _(q):
    return W.snapshot_split(q.e.select((F.col("created_utc") - F.col("created_utc") % 3600).alias("bin")))


@query("w10_stratified_split", """
select id, is_hate, case when row_number() over (partition by is_hate order by md5('42|' || id), id) <= floor(count(*) over (partition by is_hate)*0.2+0.5)
  then 'test' else 'train' end split from d_comments where is_hate is not null""")
def _(q):
    return W.stratified_split(q.d).select("id", "is_hate", "split")


@query("w11_time_prefix_sample", """
select id, created_utc from (select *, row_number() over (order by created_utc, id) p, count(*) over () n from e_comments) z where p <= floor(n*0.3)""")
def _(q):
    return W.time_prefix_sample(q.e, frac=0.3).select("id", "created_utc")


@query("w11_time_prefix_count", "select id, created_utc from e_comments order by created_utc, id limit 500")
def _(q):
    return W.time_prefix_sample(q.e, count=500).select("id", "created_utc")


@query("x1_snapshot_features", """
select created_utc - created_utc % 3600 bin, 'comment_' || id node, subreddit, score score_f, coalesce(length(body),0) text_length,
  case when score/50.0 >= 0.5 then 'toxic' else 'non_toxic' end class_self, round(score/50.0,6) target from e_comments""")
def _(q):
    return rounded(X.hourly_snapshots(q.e.withColumn("prob", F.col("score") / 50.0))[1], "target")


WINDOWS = {"wins": """
select floor((created_utc - o)/{h})::bigint window_id, min(created_utc) start_time, max(created_utc) end_time, count(*) num_comments, count(*) filter (is_hate=1) num_hate
from e_comments, (select min(created_utc) - min(created_utc) % 3600 o from e_comments) z group by 1 having count(*) filter (is_hate=1) >= 1"""}
W12 = {"wins": WINDOWS["wins"].format(h=43200)}
W1 = {"wins": WINDOWS["wins"].format(h=3600)}


@query("x2_fixed_windows", "select * from wins", W12)
def _(q):
    return X.fixed_windows(q.e)


@query("x3_split_windows", """
select w.*, case when row_number() over (order by window_id) <= n - 6 then 'train' when row_number() over (order by window_id) <= n - 4 then 'val' else 'test' end split
from wins w, (select count(*) n from wins) z""", W12)
def _(q):
    return X.split_windows(X.fixed_windows(q.e))


@query("x4_merge_windows", """
with o as (select *, row_number() over (order by window_id) k from wins),
f as (select k, window_id, window_id g, num_hate h, cast(null as bigint) p from o where k = 1
  union all select o.k, o.window_id, case when f.h >= 4 then o.window_id else f.g end, case when f.h >= 4 then o.num_hate else f.h + o.num_hate end,
    case when f.h >= 4 then f.g else f.p end from f join o on o.k = f.k + 1),
tail as (select g, h, p from f order by k desc limit 1),
r as (select f.window_id, case when tail.h < 4 and f.g = tail.g and tail.p is not null then tail.p else f.g end gid from f, tail)
select gid window_id, min(start_time) start_time, max(end_time) end_time, cast(sum(num_comments) as bigint) num_comments, cast(sum(num_hate) as bigint) num_hate
from r join wins using (window_id) group by 1""", W1)
def _(q):
    return X.merged_windows(X.fixed_windows(q.e, hours=1), 4)


GREEDY = """
z as (select *, row_number() over (order by window_id) r, count(*) over () n from wins),
parts as (select window_id, start_time, end_time, num_comments, num_hate, case when r <= n - 6 then 'train' when r <= n - 4 then 'val' else 'test' end split from z),
o as (select *, row_number() over (partition by split order by window_id) k from parts where split <> 'train'),
f as (select split, k, window_id, window_id g, num_hate h, cast(null as bigint) p from o where k = 1
  union all select o.split, o.k, o.window_id, case when f.h >= {m} then o.window_id else f.g end, case when f.h >= {m} then o.num_hate else f.h + o.num_hate end,
    case when f.h >= {m} then f.g else f.p end from f join o on o.split = f.split and o.k = f.k + 1),
tail as (select split, arg_max(g, k) g, arg_max(h, k) h, max_by({{'p': p}}, k).p p from f group by split),
r as (select f.split, f.window_id, case when tail.h < {m} and f.g = tail.g then tail.p else f.g end gid from f join tail using (split)),
late as (select gid window_id, min(start_time) start_time, max(end_time) end_time, cast(sum(num_comments) as bigint) num_comments, cast(sum(num_hate) as bigint) num_hate, split
  from r join parts using (window_id, split) where gid is not null group by gid, split),
whole as (select * from parts where split = 'train' union all by name select * from late),
ok as (select count(distinct split) = 3 ok from whole)
select whole.* from whole, ok where ok
union all by name select z.* exclude (r, n), case when r = n then 'test' when r = n - 1 then 'val' else 'train' end split from z, ok where not ok"""


@query("x4_split_merged", "with recursive " + GREEDY.format(m=150), W1)
def _(q):
    return X.split_merged(X.fixed_windows(q.e, hours=1), 150)


@query("x4_split_fallback", "with recursive " + GREEDY.format(m=1000000), W1)
def _(q):
    return X.split_merged(X.fixed_windows(q.e, hours=1), 1000000)


@query("x8_window_candidates", """
select w.window_id, w.start_time window_start, e.id, e.id id_norm, substr(parent_id,4) parent_norm, substr(link_id,4) link_norm, author, '' body, subreddit, created_utc,
  is_hate hate_label, substr(parent_id,4) <> substr(link_id,4) is_reply
from e_comments e, (select min(created_utc) - min(created_utc) % 3600 o from e_comments) z join wins w on w.window_id = floor((e.created_utc - o)/43200)::bigint""", W12)
def _(q):
    return X.window_candidates(q.e, X.fixed_windows(q.e))
