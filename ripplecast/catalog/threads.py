"""H: threads and reply trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import threads as H
from ..plans.lineage import stored
from .registry import query

# depth by recursion, for both forests
DEPTH = {
    f"{v}depth": f"""
select * from (
  with recursive walk as (
    select id, id root_id, link_id, 1 depth, id path from {v}p x where pid is null or pid = id or not exists (select 1 from {v}p y where y.id = x.pid)
    union all select x.id, w.root_id, x.link_id, w.depth + 1, w.path || '>' || x.id from {v}p x join walk w on x.pid = w.id and x.pid <> x.id)
  select * from walk) z""" for v in ("c", "e")
}
THREADS = {
    f"{v}threads": f"""
select link_id, count(*) comments, count(distinct author) authors, cast(max(created_utc) - min(created_utc) as bigint) span,
  cast(min(created_utc) as bigint) as start, count(*) filter (starts_with(parent_id,'t3_')) roots,
  arg_min(subreddit, (created_utc, id)) subreddit, count(*) filter (is_hate = 1) hate
from {v}_comments where link_id is not null group by 1""" for v in ("c", "e")
}
SIM = """greatest(0, 1 - (abs(h.comments-k.comments)/greatest(h.comments,k.comments,1.0) + abs(h.authors-k.authors)/greatest(h.authors,k.authors,1.0)
  + abs(h.span-k.span)/greatest(h.span,k.span,1.0))/3)"""
PAIRS = {"pairs": f"""
select h.link_id hate_id, k.link_id control_id, h.subreddit, {SIM} similarity, abs(h.start-k.start) gap,
  h.link_id || '|' || k.link_id pair_id
from cthreads h join cthreads k on h.subreddit = k.subreddit and h.hate > 0 and k.hate = 0 and abs(h.start-k.start) <= 7200
where {SIM} > 0.1
qualify row_number() over (partition by h.link_id order by round({SIM}, 9) desc, abs(h.start-k.start), k.link_id) = 1"""}
ALL = {**DEPTH, **THREADS, **PAIRS}


def pairs(q):
    return H.match_controls(H.thread_stats(q.c))


@query("h1_thread_stats", "select * from ethreads", ALL)
def _(q):
    return H.thread_stats(q.e)


# of a sketch with 4,096 registers an estimate is within five standard deviations, and exact for a handful of authors
NEAR = "abs(authors - {exact}) <= 0.5 + 0.08 * {exact}"


@query("h1_thread_stats_approximate", "select * exclude (authors), true near from ethreads", ALL)
def _(q):
    exact = q.e.groupBy("link_id").agg(F.count_distinct("author").alias("_exact"))
    out = H.thread_stats(q.e, author_error=0.016).join(exact, "link_id")
    return out.withColumn("near", F.expr(NEAR.format(exact="_exact"))).drop("authors", "_exact")


@query("h1_merged_threads", """
with d as (select *, created_utc // 86400 as day from e_comments where link_id is not null),
span as (select * from d where day between (select min(day) + 1 from d) and (select max(day) - 1 from d))
select link_id, count(*) comments, true near, cast(max(created_utc) - min(created_utc) as bigint) span, cast(min(created_utc) as bigint) as start,
  count(*) filter (starts_with(parent_id,'t3_')) roots, arg_min(subreddit, (created_utc, id)) subreddit, count(*) filter (is_hate = 1) hate
from span group by 1""")
def _(q):
    # daily sketches are stored once; any span of days is added up from them
    days = stored(H.thread_sketches(q.e), "thread-days")
    first, last = days.agg(F.min("day"), F.max("day")).first()
    if first is None:
        first = last = 0
    inside = q.e.where(F.floor(F.col("created_utc") / 86400).between(first + 1, last - 1))
    exact = inside.groupBy("link_id").agg(F.count_distinct("author").alias("_exact"))
    out = H.merged_threads(days, first + 1, last - 1).join(exact, "link_id")
    return out.withColumn("near", F.expr(NEAR.format(exact="_exact"))).drop("authors", "_exact")


@query("h2_thread_closure", """
with seeds as (select id, pid from ep where is_hate = 1),
up as (select id, pid from seeds union select x.id, x.pid from ep x join up on up.pid = x.id),
down as (select id from seeds union select x.id from ep x join down on x.pid = down.id)
select id, link_id from e_comments where id in (select id from up) or id in (select id from down)""", ALL)
def _(q):
    seeds = q.e.where("is_hate = 1").select("id")
    return H.thread_closure(seeds, q.e).select("id", "link_id")


@query("h3_thread_path", "select id, path, depth - 1 hops from edepth where id in (select id from e_comments where is_hate = 1)", ALL)
def _(q):
    out = H.thread_path(q.e, q.e.where("is_hate = 1"))
    return out.select("id", F.concat_ws(">", "path").alias("path"), "hops")


@query("h3_subtree", """
select id, root_id, depth thread_depth from cdepth where root_id in (select id from c_comments where is_hate = 1)""", ALL)
def _(q):
    return H.subtree(q.c, q.c.where("is_hate = 1"))


@query("h4_thread_depth", "select id, depth thread_depth, root_id, false in_cycle from edepth", ALL)
def _(q):
    return H.reply_depth(q.e)


@query("h5_children", """
select x.id, (select count(*) from ep y where y.pid = x.id) replies, not exists (select 1 from ep y where y.id = x.pid) is_root from ep x""")
def _(q):
    return H.children(q.e)


@query("h6_hate_threads", "select * from cthreads where hate > 0", ALL)
def _(q):
    return H.hate_threads(q.c)


@query("h6_hate_paths", """
select d.id, d.path, d.depth - 1 hops, t.link_id, t.subreddit, t.span, t.comments, t.authors
from edepth d join ethreads t using (link_id) where d.id in (select id from e_comments where is_hate = 1)""", ALL)
def _(q):
    return H.hate_paths(q.e).withColumn("path", F.concat_ws(">", "path"))


@query("h7_match_controls", "select * replace (round(similarity, 6) as similarity) from pairs", ALL)
def _(q):
    return pairs(q).withColumn("similarity", F.round("similarity", 6))


WIDE = PAIRS["pairs"].replace("7200", "172800").replace("0.1", "0.05")


@query("h7_match_controls_wide", "select * replace (round(similarity, 6) as similarity) from wide", {**ALL, "wide": WIDE})
def _(q):
    return H.match_controls(H.thread_stats(q.c), hours=48, min_sim=0.05).withColumn("similarity", F.round("similarity", 6))


@query("h8_thread_similarity", f"""
select h.link_id, round({SIM}, 6) similarity from cthreads h join cthreads k on k.link_id = 't3_' || (cast(substr(h.link_id, 4) as bigint) + 1)""", ALL)
def _(q):
    t = H.thread_stats(q.c)
    nxt = F.concat(F.lit("t3_"), F.substring("link_id", 4, 20).cast("bigint") + 1)
    h = t.select("link_id", nxt.alias("k"), *[F.col(n).alias(f"h_{n}") for n in H.MEASURES])
    k = t.select(F.col("link_id").alias("k"), *[F.col(n).alias(f"k_{n}") for n in H.MEASURES])
    return h.join(k, "k").select("link_id", F.round(H.thread_similarity(H._cols("h_"), H._cols("k_")), 6).alias("similarity"))


@query("h9_paired_dataset", """
select c.id, p.pair_id, x.t thread_type, round(p.similarity, 6) similarity
from pairs p, (values ('hate'), ('non_hate')) x(t) join c_comments c on c.link_id = case x.t when 'hate' then p.hate_id else p.control_id end""", ALL)
def _(q):
    return H.paired_dataset(pairs(q), q.c).select("id", "pair_id", "thread_type", F.round("similarity", 6).alias("similarity"))


@query("h10_pair_report", """
select p.pair_id, p.hate_id hate_link_id, p.control_id non_hate_link_id, p.subreddit, round(p.similarity, 6) similarity_score,
  h.comments hate_total, h.authors hate_authors, h.span hate_span, k.comments control_total, k.authors control_authors, k.span control_span
from pairs p join cthreads h on h.link_id = p.hate_id join cthreads k on k.link_id = p.control_id""", ALL)
def _(q):
    t = H.thread_stats(q.c)
    r = H.pair_report(H.match_controls(t), t)
    return r.select(
        "pair_id", F.col("hate_id").alias("hate_link_id"), F.col("control_id").alias("non_hate_link_id"), "subreddit",
        F.round("similarity", 6).alias("similarity_score"),
        *[F.col(f"{s}_stats.{c}").alias(f"{s}_{n}") for s in ("hate", "control")
          for c, n in (("total_comments", "total"), ("unique_authors", "authors"), ("time_span", "span"))])


FILTERED = """
with deep as (select * from {v}_comments where link_id in (select link_id from {v}depth group by 1 having max(depth) >= {d}))
select id, link_id, subreddit from deep where subreddit in (select subreddit from deep group by 1 having count(*) >= {n})"""


@query("h11_filter_threads", FILTERED.format(v="e", d=8, n=20), ALL)
def _(q):
    return H.filter_threads(q.e, 8, 20).select("id", "link_id", "subreddit")


@query("h11_filter_threads_relaxed", FILTERED.format(v="c", d=2, n=2), ALL)
def _(q):
    return H.filter_threads(q.c, 1000, 5).select("id", "link_id", "subreddit")


SHAPES = """
select d.link_id, d.root_id root, max(depth) - 1 max_depth, count(*) total, count(*) filter (is_hate = 1) hate
from edepth d join e_comments using (id) group by 1, 2 having (select count(*) from e_comments x where x.link_id = d.link_id) >= 3"""


@query("h12_cascade_shapes", f"select *, round(hate/total, 6) hate_ratio from ({SHAPES}) s", ALL)
def _(q):
    return H.cascade_shapes(q.e).withColumn("hate_ratio", F.round("hate_ratio", 6))


@query("h12_cascade_chains", """
select link_id, 'd' || min(cast(substr(id, 2) as bigint)) root, count(*) - 1 max_depth, count(*) total,
  count(*) filter (is_hate = 1) hate, round(count(*) filter (is_hate = 1) / count(*), 6) hate_ratio from d_comments group by 1 having count(*) >= 3""")
def _(q):
    return H.cascade_shapes(q.d).withColumn("hate_ratio", F.round("hate_ratio", 6))


@query("h12_cascade_summary", f"""
select round(avg(max_depth), 6) avg_depth, max(max_depth) max_depth, round(avg(hate/total), 6) avg_hate_ratio,
  count(*) filter (max_depth > 1) deep, count(*) filter (total > 3) wide, count(*) cascades from ({SHAPES}) s""", ALL)
def _(q):
    out = H.cascade_summary(H.cascade_shapes(q.e))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_depth", "avg_hate_ratio")})


PARENTS = """
select x.id, round(coalesce(y.score/50.0, 0), 6) prob_parent, coalesce(y.score, 0) score_parent,
  x.created_utc - {t} response_time from ep x left join ep y on x.pid = y.id"""


@query("h13_parent_attributes", PARENTS.format(t="y.created_utc"))
def _(q):
    out = H.parent_attributes(q.e.withColumn("prob", F.col("score") / 50.0))
    return out.select("id", F.round("prob_parent", 6).alias("prob_parent"), "score_parent", "response_time")


@query("h13_parent_attributes_epoch", PARENTS.format(t="coalesce(y.created_utc, 0)").replace("round(coalesce(y.score/50.0, 0), 6)", "cast(0 as double)"))
def _(q):
    out = H.parent_attributes(q.e.withColumn("prob", F.col("score") / 50.0), "zero", "epoch")
    return out.select("id", "prob_parent", "score_parent", "response_time")


@query("h13_parent_attributes_compute", """
select x.id, round(coalesce(length(y.body)/1000.0, 0), 6) prob_parent from cp x left join cp y on x.pid = y.id""")
def _(q):
    rescore = lambda rows: rows.select("id", (F.length("body") / 1000.0).alias("prob"))
    out = H.parent_attributes(q.c.withColumn("prob", F.lit(0.0)), "compute", rescore=rescore)
    return out.select("id", F.round("prob_parent", 6).alias("prob_parent"))


@query("h14_sample_threads", """
select id, link_id from e_comments where link_id in (select link_id from (select distinct link_id from e_comments) order by md5('42|' || link_id), link_id limit 12)""")
def _(q):
    return H.sample_threads(q.e, 12).select("id", "link_id")


@query("h14_sample_threads_capped", """
select id, link_id from e_comments where link_id in (select link_id from (select distinct link_id from e_comments) order by md5('42|' || link_id), link_id limit 12)
order by md5('42|' || link_id), link_id, created_utc, id limit 300""")
def _(q):
    return H.sample_threads(q.e, 12, 300).select("id", "link_id")


DIFFUSION = {"diffusion": """
select p.pair_id, p.similarity, h.comments hate_engagement, k.comments control_engagement, hs.spread hate_spread, ks.spread control_spread,
  h.comments-k.comments engagement_diff, hs.spread-ks.spread spread_diff, h.authors-k.authors users_diff
from pairs p join cthreads h on h.link_id=p.hate_id join cthreads k on k.link_id=p.control_id join spreads hs on hs.link_id=p.hate_id join spreads ks on ks.link_id=p.control_id""",
    "spreads": """
select link_id, max(g) spread from (select x.link_id, x.id, (select count(*) from cp y where y.pid = x.id) +
  (select count(*) from cp y where y.id = x.pid) g from cp x) z group by 1""", **ALL}


@query("h15_pair_diffusion", "select * replace (round(similarity, 6) as similarity) from diffusion", DIFFUSION)
def _(q):
    out = H.pair_diffusion(pairs(q), q.c).withColumn("similarity", F.round("similarity", 6))
    return out.drop("hate_id", "control_id", "subreddit", "gap", "hate_users", "control_users")


@query("h15_pair_diffusion_summary", """
select round(avg(hate_engagement), 6) hate_engagement, round(avg(control_engagement), 6) control_engagement, round(avg(similarity), 6) similarity,
  round(avg(engagement_diff), 6) engagement_diff, round(coalesce(corr(similarity, engagement_diff), 0), 6) correlation from diffusion""", DIFFUSION)
def _(q):
    out = H.pair_diffusion_summary(H.pair_diffusion(pairs(q), q.c))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])
