"""R: scoring, ranking, calibration."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import graph as N
from ..operators import models as M
from ..operators import ordered as W
from ..operators import scoring as R
from ..operators import text as T
from ..operators import windows as X
from ..plans.lineage import cut_lineage
from .features import rounded
from .graph import G, vectors
from .ordered import CONTEXT, W12
from .registry import query


@query("r1_rule_next_comment", """
select id, link_id, actual, case when thread_ratio > 0.3 then 1 else 0 end predicted from context""", CONTEXT)
def _(q):
    return R.rule_next_comment(q.e, weighted=False).select("id", "link_id", "actual", "predicted")


@query("r1_rule_next_comment_weighted", """
with s as (select *, 0.4*thread_ratio + 0.3*cast(author_ratio>0.2 as int) + 0.2*cast(community_ratio>0.1 as int) + 0.1*cast(thread_size>5 as int) score from context)
select id, link_id, actual, round(score,6) score, case when round(score,9) > 0.2 then 1 else 0 end predicted from s""", CONTEXT)
def _(q):
    out = R.rule_next_comment(q.e).withColumn("predicted", F.when(F.round("score", 9) > 0.2, 1).otherwise(0))
    return rounded(out.select("id", "link_id", "actual", "score", "predicted"), "score")


RATES = {"ur": "select author, avg(is_hate) author_ratio from e_comments where author <> '[deleted]' group by 1",
         "sr": "select subreddit, avg(is_hate) community_ratio from e_comments group by 1"}


@query("r2_rule_reply", """
with s as (select p.id parent, c.id child, c.is_hate actual, round(0.6*cast(p.is_hate=1 as int) + 0.3*cast(author_ratio>0.1 as int) + 0.2*cast(community_ratio>0.05 as int)
  + 0.1*cast(c.created_utc-p.created_utc < 600 as int), 6)::double score from ep p join ep c on c.pid = p.id join ur on ur.author = p.author join sr on sr.subreddit = p.subreddit)
select *, case when score > 0.5 then 1 else 0 end predicted from s""", RATES)
def _(q):
    return rounded(R.rule_reply(q.e).select("parent", "child", "actual", "score", "predicted"), "score")


@query("r3_reply_hate_dataset", """
select p.id, cast(p.is_hate as double) comment_hate, round(author_ratio,6) author_ratio, round(community_ratio,6) community_ratio, cast(p.score < 0 as double) downvoted,
  cast(0 as double) length_k, cast(n as double) replies, round(h/n,6) reply_ratio, case when h/n > 0.2 then 1 else 0 end as "label",
  case when 0.6*p.is_hate + 0.4*author_ratio > 0.3 then 1 else 0 end rule_predicted
from ep p join (select pid, count(*) n, count(*) filter (is_hate=1) h from ep where pid is not null group by 1) c on c.pid = p.id
join ur on ur.author = p.author join sr on sr.subreddit = p.subreddit""", RATES)
def _(q):
    return rounded(R.reply_hate_dataset(q.e), "author_ratio", "community_ratio", "reply_ratio")


# A trained model is compared by what does not depend on its weights: its rows, their labels and the range of its scores.
def in_range():
    return F.col("score").between(0.0, 1.0).alias("in_range")


REPLIES = {**RATES, "replies": """
select p.id, case when h/n > 0.2 then 1 else 0 end y from ep p join (select pid, count(*) n, count(*) filter (is_hate=1) h from ep where pid is not null group by 1) c on c.pid = p.id"""}


@query("r4_train_reply_classifier", """
select id, y as "label", true in_range from replies
qualify row_number() over (partition by y order by md5('42|' || id), id) <= floor(count(*) over (partition by y)*0.3+0.5)""", REPLIES)
def _(q):
    _, scored = M.train_reply_classifier(R.reply_hate_dataset(q.e))
    return scored.select("id", "label", in_range())


# one tree of depth 1 on one yes-or-no feature: a leaf's score is its share of the balanced classes
@query("r4_closed_form", """
with s as (select r.id, y, p.is_hate x, row_number() over (partition by y order by md5('42|' || r.id), r.id) <= floor(count(*) over (partition by y)*0.3+0.5) test
  from replies r join ep p using (id)),
n as (select y, count(*) n from s where not test group by 1),
leaf as (select x, sum(1.0/n) filter (y = 1) a, sum(1.0/n) b from s join n using (y) where not test group by 1)
select id, y as "label", round(coalesce(a, 0)/b, 6)::double score from s join leaf using (x) where test""", REPLIES)
def _(q):
    _, scored = M.train_reply_classifier(R.reply_hate_dataset(q.e), features=["comment_hate"], trees=1, depth=1, bootstrap=False)
    return rounded(scored.select("id", "label", "score"), "score")


def author_vectors(q, df):
    """A stored vector for each author, chosen by digest."""
    a = df.select(F.col("author").alias("id")).distinct()
    return vectors(q, a).withColumnRenamed("id", "author")


EVENTS = {**W12, "history_s": """
select a.id, coalesce(avg(b.is_hate) filter (b.created_utc >= a.created_utc - 604800), 0) r7, ln(1+count(*) filter (b.created_utc >= a.created_utc - 604800)) c7,
  coalesce(avg(b.is_hate), 0) r30, ln(1+count(b.created_utc)) c30
from e_comments a left join e_comments b on a.author = b.author and b.created_utc < a.created_utc and b.created_utc >= a.created_utc - 2592000 group by 1""",
    "cand": """
select w.window_id, w.start_time, e.* from ep e, (select min(created_utc) - min(created_utc) % 3600 o from e_comments) z
join wins w on w.window_id = floor((e.created_utc - o)/43200)::bigint""",
    "gaps": """
select a.id, case when count(b.id) >= 2 then ln(1 + (max(b.created_utc) - min(b.created_utc))/(count(b.id)-1)) else 10.0 end g
from e_comments a left join e_comments b on a.author=b.author and b.created_utc < a.created_utc group by a.id""",
    "slots_s": "select subreddit, row_number() over (order by count(*) desc, subreddit) - 1 s from cand group by 1 order by count(*) desc, subreddit limit 3",
    "slots_t": "select substr(link_id,4) l, row_number() over (order by count(*) desc, substr(link_id,4)) - 1 s from cand group by 1 order by count(*) desc, l limit 64",
    "ev": "select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings"}


@query("r5_edge_features", """
select c.window_id, c.id, c.author, c.subreddit, substr(c.link_id,4) link_norm, c.is_hate as "label",
  round(coalesce(ln(1+c.created_utc-p.created_utc),0),6) log_parent_gap, round(least(1,(c.created_utc-c.start_time)/86400.0),8) window_progress, round(g,6) author_gap,
  round(hour(make_timestamp(c.created_utc*1000000))/24.0,6) hour_frac, cast(dayofweek(make_timestamp(c.created_utc*1000000)) in (0,6) as double) is_weekend,
  cast(substr(c.parent_id,4) <> substr(c.link_id,4) as double) is_reply, cast(p.subreddit is null or p.subreddit = c.subreddit as double) same_community,
  cast(p.id is not null as double) same_thread, round(coalesce(ln(1+(c.created_utc-p.created_utc)/3600.0),0),6) log_delta_hours,
  round(coalesce(list_dot_product(a.v,b.v)/(sqrt(list_dot_product(a.v,a.v))*sqrt(list_dot_product(b.v,b.v))),0),5) parent_similarity,
  round(c7,6) count_7, round(r7,6) hate_rate_7, round(c30,6) count_30, round(r30,6) hate_rate_30, coalesce(slots_s.s,-1) community_slot, coalesce(slots_t.s,-1) thread_slot
from cand c left join ep p on c.pid = p.id join history_s h on h.id = c.id join gaps on gaps.id = c.id
left join slots_s on slots_s.subreddit = c.subreddit left join slots_t on slots_t.l = substr(c.link_id,4)
left join ev a on a.vec_id = cast('0x'||substr(md5(c.id),1,8) as bigint) % (select count(*) from embeddings) left join ev b on b.vec_id = cast('0x'||substr(md5(p.id),1,8) as bigint) % (select count(*) from embeddings)""", EVENTS)
def _(q):
    out = edge_events(q, communities=3)
    names = [n for n in R.EDGE_NUMBERS if n not in ("parent_similarity", "window_progress")]
    return rounded(rounded(rounded(out, *names), "parent_similarity", to=5), "window_progress", to=8)


def edge_events(q, **more):
    return R.edge_features(q.e, X.fixed_windows(q.e), vectors(q, q.e), **more)


@query("r5_edge_vectors", """
with n as (select count(*) n from embeddings),
v as (select c.id, a.v a, b.v b, t.v t from e_comments c, n
  join ev a on a.vec_id = cast('0x'||substr(md5(c.author),1,8) as bigint) % n
  join ev b on b.vec_id = cast('0x'||substr(md5(c.id),1,8) as bigint) % n left join ev t on c.id = 'e' || t.vec_id)
select id, round(list_sum(a[1:48]), 4) author_sum, round(list_sum(b[1:48]), 4) comment_sum,
  round(list_sum(list_transform(range(1, 49), lambda i: cast(abs(cast(a[i] as float) - cast(b[i] as float)) as double))), 4) difference_sum,
  round(list_sum(list_transform(range(1, 49), lambda i: cast(cast(a[i] as float) * cast(b[i] as float) as double))), 4) product_sum,
  round(coalesce(list_sum(t), 0), 4) text_sum, 4 * 48 + 80 width from v""", {"ev": EVENTS["ev"]})
def _(q):
    texts = q.table("embeddings").select(F.concat(F.lit("e"), "vec_id").alias("id"), "embedding")
    out = R.edge_vectors(q.e, author_vectors(q, q.e), vectors(q, q.e), texts, dim=48, text_dim=80)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")), 4)
    parts = {"author_sum": "author_vector", "comment_sum": "comment_vector", "difference_sum": "difference", "product_sum": "product", "text_sum": "text_vector"}
    return out.select("id", *[total(c).alias(n) for n, c in parts.items()], F.size(vector_to_array("edge_vector")).alias("width"))


def sampling_events(q):
    return q.e.select("id", "link_id", "author", "subreddit", F.col("is_hate").alias("label")).withColumnRenamed("link_id", "link_norm")


HARD = {"members": """
select id, is_hate = 1 pos, key from e_comments, lateral (select unnest(['thread|' || link_id, 'community|' || subreddit, 'author|' || author]) as key)""",
    "numbered": "select *, row_number() over (partition by key, pos order by md5('42|' || id), id) k from members",
    "sizes": "select key, count(*) m from members where not pos group by 1",
    "drawn": """
select distinct p.id pos_id, n.id neg_id from numbered p join sizes using (key), range(0, 5) j(j)
join numbered n on n.key = p.key and not n.pos and n.k = ((p.k - 1) * 5 + j) % m + 1 where p.pos and j < m"""}


@query("r6_hard_negatives", """
select pos_id, neg_id from drawn
qualify row_number() over (partition by pos_id order by cast('0x' || substr(md5('42|' || pos_id || '|' || neg_id),1,12) as bigint) desc, neg_id) <= 5""", HARD)
def _(q):
    return R.hard_negatives(sampling_events(q))


@query("r7_cap_events", """
select id, is_hate as "label" from e_comments where is_hate = 1 union all
select id, 0 from (select id, row_number() over (order by md5('42|' || id), id) k from e_comments where is_hate <> 1) z where k <= 3000 - (select count(*) from e_comments where is_hate = 1)""")
def _(q):
    return R.cap_events(sampling_events(q), 3000).select("id", "label")


RECALL = {**EVENTS, "recall": """
select c.window_id, c.id, c.is_hate y, greatest(0, coalesce(list_dot_product(a.v,b.v)/(sqrt(list_dot_product(a.v,a.v))*sqrt(list_dot_product(b.v,b.v))),0)) * (1+r7)
  * coalesce(1/(1+(c.created_utc-p.created_utc)/3600.0), 1) * case when p.subreddit is null or p.subreddit = c.subreddit then 1 else 0.5 end * case when p.id is null then 0.5 else 1 end s
from cand c left join ep p on c.pid = p.id join history_s h on h.id = c.id
left join ev a on a.vec_id = cast('0x'||substr(md5(c.author),1,8) as bigint) % (select count(*) from embeddings) left join ev b on b.vec_id = cast('0x'||substr(md5(coalesce(p.author,c.author)),1,8) as bigint) % (select count(*) from embeddings)"""}


def recall(q):
    return R.recall_scores(q.e, X.fixed_windows(q.e), author_vectors(q, q.e))


@query("r8_recall_scores", "select window_id, id, y as \"label\", round(s, 5) recall_score from recall", RECALL)
def _(q):
    return rounded(recall(q).drop("author"), "recall_score", to=5)


@query("r8_recall_report", """
with k as (select *, row_number() over (partition by window_id order by round(s,9) desc, id) k from recall)
select window_id, count(*) total, count(*) filter (y=1) positives, count(*) filter (k <= 200) selected, count(*) filter (y=1 and k <= 200) positives_selected,
  round(coalesce(count(*) filter (y=1 and k <= 200)/nullif(count(*) filter (y=1),0),0),6) coverage from k group by 1""", RECALL)
def _(q):
    scored = recall(q).withColumn("recall_score", F.round("recall_score", 9))
    return rounded(R.recall_report(scored, R.recall_topk(scored, 200)), "coverage")


# candidate pairs for diffusion scores: 2-hop neighbours of the 100 most hate-prone users
PAIRS = {**G, "cpairs": """
with recursive walk as (select 'user_' || author source, 'user_' || author node, 0 hops from (select author, avg(is_hate) r from c_comments group by 1 order by 2 desc, 1 limit 100) z
  union select w.source, g.dst, w.hops+1 from walk w join cgraph g on g.src = w.node where w.hops < 2)
select source, node, 1.0/(1+min(hops)) proximity from walk where source <> node group by 1, 2""",
    "xv": "select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) v from embeddings",
    "rates": "select 'user_' || author node, avg(is_hate) r from c_comments group by 1",
    "feat": """
select p.source, p.node, p.proximity, list_dot_product(a.v,b.v)/(sqrt(list_dot_product(a.v,a.v))*sqrt(list_dot_product(b.v,b.v))+1e-8) cosine, 1/(1+list_distance(a.v,b.v)) euclid,
  (a.label*b.label+1.0)/(sqrt(a.label*a.label+1.0)*sqrt(b.label*b.label+1.0)+1e-8) fs, b.label/10.0 prob, coalesce(r,0) ratio
from cpairs p join xv a on a.vec_id = cast('0x'||substr(md5(p.source),1,8) as bigint) % (select count(*) from embeddings) join xv b on b.vec_id = cast('0x'||substr(md5(p.node),1,8) as bigint) % (select count(*) from embeddings)
left join rates on rates.node = p.node"""}


def pair_features(q):
    from ..functions.columns import hash_bucket

    edges = N.user_comment_graph(q.c)
    src = N.hate_prone_users(q.c, 100).select(F.concat(F.lit("user_"), "author").alias("node"))
    pairs = N.khop_candidates(edges, src, 2).select("source", "node", (1.0 / (1.0 + F.col("hops"))).alias("proximity"))
    nodes = edges.select(F.col("src").alias("node")).distinct()
    e = q.table("embeddings").select(F.col("vec_id").alias("_k"), "embedding", "label", F.lit(1).alias("one"))
    v = nodes.withColumn("_k", hash_bucket(F.col("node"), q.table("embeddings").agg(F.count("*")).scalar())).join(e, "_k").drop("_k")
    rates = q.c.groupBy(F.concat(F.lit("user_"), "author").alias("node")).agg(F.avg("is_hate").alias("target_ratio"))
    out = N.pair_similarity(pairs, v, ["label", "one"]).join(rates, "node", "left").fillna(0.0, ["target_ratio"])
    return out.join(v.select("node", (F.col("label") / 10.0).alias("prob")), "node")


@query("r9_diffusion_score", """
with s as (select *, 1/(1+exp(-4*(0.5*prob+0.2*cosine+0.1*euclid+0.1*proximity+0.1*fs-0.3))) base from feat)
select source, node, round(greatest(0.01, least(0.95, base*case when ratio>0.1 then 1.5+2*ratio when ratio>0.05 then 1.2+ratio else 0.6+5*ratio end*(1+0.5*proximity)
  + case when proximity>0.8 then 0.4 when proximity>0.5 then 0.2 when proximity>0.2 then 0.1 else -0.1 end
  + case when prob>0.7 then 0.3 when prob>0.4 then 0.1 when prob<0.2 then -0.2 else 0 end)), 5) score from s""", PAIRS)
def _(q):
    return rounded(R.diffusion_score(pair_features(q)).select("source", "node", "score"), "score", to=5)


@query("r9_diffusion_score_light", """
select source, node, round(greatest(0.05, least(0.8, 0.1+0.6*(1/(1+exp(-8*(0.5*cosine+0.3*euclid+0.2*proximity-0.4)))*(1+0.3*ratio)+0.2*proximity))), 5) score from feat""", PAIRS)
def _(q):
    return rounded(R.diffusion_score_light(pair_features(q)).select("source", "node", "score"), "score", to=5)


@query("r10_rerank_fuse", """
with k as (select *, row_number() over (partition by link_id order by score desc, id) k from e_comments)
select link_id group_id, id, score, round(case when k <= 10 then 0.7*(created_utc % 97) + (1-0.7)*score else score end, 6) fused_score from k""")
def _(q):
    df = q.e.select(F.col("link_id").alias("group_id"), "id", "score", (F.col("created_utc") % 97).cast("double").alias("second"))
    return rounded(R.rerank_fuse(df, 10, 0.7), "fused_score").drop("second")


@query("r11_fallback_score", """
select c.id, round(coalesce(0.5+0.5*tanh(list_avg(list_transform(embedding, lambda x: cast(x as double)))), 0.1), 6) score
from e_comments c left join embeddings e on c.author <> 'u7' and e.vec_id = cast('0x'||substr(md5(c.author),1,8) as bigint) % (select count(*) from embeddings)""")
def _(q):
    known = author_vectors(q, q.e).where("author <> 'u7'")
    return rounded(R.fallback_score(q.e, known).select("id", "score"), "score")


def text_data(q):
    return q.d.where("is_hate is not null").select("id", "body", F.col("is_hate").alias("label"))


@query("r12_text_baseline", """
select id, is_hate as "label", true in_range from d_comments where is_hate is not null
qualify row_number() over (partition by is_hate order by md5('42|' || id), id) <= floor(count(*) over (partition by is_hate)*0.2+0.5)""")
def _(q):
    data = W.stratified_split(text_data(q), 0.2, "label")
    model = M.train_text_baseline(data.where("split = 'train'"), grid=M.GRID)
    return M.score_text_baseline(model, data.where("split = 'test'")).select("id", "label", in_range())


# a vocabulary of one term and next to no penalty: a row's score is its term's share of the balanced classes
@query("r12_closed_form", r"""
with t as (select id, is_hate y, regexp_extract_all(lower(body), '[\p{L}\p{N}_]{2,}') w from d_comments where is_hate is not null),
n as (select y, count(*) n from t group by 1),
v as (select term from (select id, unnest(w) term from t) z group by term
  having count(distinct id) >= 2 and count(distinct id) <= 0.95*(select sum(n) from n) order by count(*) desc, term limit 1),
s as (select id, y, list_contains(w, (select term from v)) x from t),
share as (select x, sum(1.0/n) filter (y = 1) a, sum(1.0/n) b from s join n using (y) group by 1)
select id, y as "label", round(coalesce(a, 0)/b, 3)::double score from s join share using (x)""")
def _(q):
    rows = text_data(q)
    model = M.train_text_baseline(rows, ngram_range=(1, 1), max_features=1, C=1e6, max_df=0.95, stop_words=())
    return rounded(M.score_text_baseline(model, rows).select("id", "label", "score"), "score", to=3)


@query("r12_top_coefficients", r"""
with t as (select id, regexp_extract_all(lower(body), '[\p{L}\p{N}_]{2,}') w from d_comments where is_hate is not null),
n as (select count(*) n from t),
v as (select term from (select distinct id, unnest(w) term from t) z, n group by term having count(*) >= 2 and count(*) <= 0.95*max(n)),
c as (select least(20, count(*)) k from v)
select side, k terms, k known from c, (values ('for'), ('against')) s(side)""")
def _(q):
    rows = text_data(q)
    model = M.train_text_baseline(rows, ngram_range=(1, 1), max_features=20_000, max_df=0.95, stop_words=())
    known = T.vocabulary(rows, "body", 20_000, (1, 1), 2, 0.95).select("term", F.lit(1).alias("_k"))
    return M.top_coefficients(model).join(known, "term", "left").groupBy("side").agg(F.count("*").alias("terms"), F.count("_k").alias("known"))


def logits(q):
    return q.e.select("id", ((F.col("score") - 40) / 8.0).alias("logit"), F.col("is_hate").alias("label"))


@query("r13_calibrate_platt", """
select count(*) n, round(avg(is_hate), 3) mean_calibrated, round(avg(is_hate), 3) base_rate, true monotone from e_comments""")
def _(q):
    # a logistic curve keeps the base rate, and its logit is a straight line in the score
    _, out = M.calibrate_platt(logits(q).select("id", "label", F.col("logit").alias("score")))
    line = F.abs(F.corr("score", F.log(F.col("calibrated") / (1 - F.col("calibrated"))))) > 0.999999
    return out.agg(F.count("*").alias("n"), F.round(F.avg("calibrated"), 3).alias("mean_calibrated"), F.round(F.avg("label"), 3).alias("base_rate"), line.alias("monotone"))


TEMP = """
with d as (select (score-40)/8.0 z, is_hate y from e_comments),
{steps}
select round(exp(x), 4) temperature, round(l, 6) loss from b3"""
STEP = """g{i} as (select a + j*(b-a)/32 x, (b-a)/32 s from {src}, range(0, 33) r(j)),
l{i} as (select x, s, avg(greatest(z/exp(x),0) - z/exp(x)*y + ln(1+exp(-abs(z/exp(x))))) l from g{i}, d group by 1, 2),
b{i} as (select x, l, greatest(ln(0.05), x-s) a, least(ln(10.0), x+s) b from l{i} order by l, x limit 1)"""


@query("r14_fit_temperature", TEMP.format(steps=",\n".join(
    STEP.format(i=i, src="(select ln(0.05) a, ln(10.0) b) o" if i == 1 else f"b{i - 1}") for i in (1, 2, 3))))
def _(q):
    return rounded(rounded(R.fit_temperature(logits(q)), "temperature", to=4), "loss")


def split_events(q):
    """Events with the split of their window, stored because training and scoring read them again and again."""
    windows = X.split_windows(X.fixed_windows(q.e))
    return cut_lineage(edge_events(q).join(windows.select("window_id", "split"), "window_id"))


PARTS = {**EVENTS, "parts": """
select window_id, case when row_number() over (order by window_id) <= n - 6 then 'train' when row_number() over (order by window_id) <= n - 4 then 'val' else 'test' end split
from wins w, (select count(*) n from wins) z"""}


@query("r15_train_edge_classifier", """
select window_id, id, is_hate as "label", true in_range, true decided from cand join parts using (window_id) where split = 'val'""", PARTS)
def _(q):
    events = split_events(q)
    model, heat, limit = M.train_edge_ranker(events, slots={"community_slot": 32, "thread_slot": 64})
    scored = M.score_window(events.where("split = 'val'"), model, heat)
    cut = limit.select("threshold").scalar()
    return scored.select("window_id", "id", "label", in_range(), (F.col("score") >= cut).isNotNull().alias("decided"))


@query("r16_occurred_subset", "select id, is_hate as \"label\" from e_comments where created_utc % 2 = 1")
def _(q):
    events = sampling_events(q).select("id", "label").join(q.e.select("id", (F.col("created_utc") % 2).alias("occurred")), "id")
    return R.occurred_subset(events).select("id", "label")


@query("r17_score_window", """
select window_id, id, is_hate as "label", true in_range from cand join parts using (window_id) where split = 'test'""", PARTS)
def _(q):
    events = split_events(q)
    model, heat, _ = M.train_edge_ranker(events)
    return M.score_window(events.where("split = 'test'"), model, heat).select("window_id", "id", "label", in_range())


# A regression on one set of slots without a penalty has a closed form: with classes that weigh the same, the odds of a
# slot are (its share of the positives) / (its share of the negatives).
CLOSED = {**PARTS, "train_odds": """
with t as (select coalesce(slots_s.s, -1) slot, c.is_hate y from cand c join parts using (window_id) left join slots_s using (subreddit) where split = 'train')
select slot, (count(*) filter (y = 1) / (select count(*) from t where y = 1)) / (count(*) filter (y = 0) / (select count(*) from t where y = 0)) odds from t group by 1""",
    "closed": """
select window_id, split, id, c.is_hate y, odds from cand c join parts using (window_id) left join slots_s using (subreddit)
join train_odds on slot = coalesce(slots_s.s, -1)"""}


def closed_model(q):
    events = cut_lineage(split_events(q).withColumn("community_slot", F.when(F.col("community_slot") < 3, F.col("community_slot")).otherwise(-1)))
    model = M.train_edge_classifier(events.where("split = 'train'"), features=(), slots={"community_slot": 3}, strength=0.0)
    return events, model


@query("r15_closed_form", """
select window_id, id, y as "label", round(odds / (1 + odds), 3) score from closed where split = 'val'""", CLOSED)
def _(q):
    events, model = closed_model(q)
    return rounded(M.score_window(events.where("split = 'val'"), model).select("window_id", "id", "label", "score"), "score", to=3)


@query("r17_closed_form", """
select window_id, id, y as "label", round(1 / (1 + odds ** -0.5), 3) score from closed where split = 'test'""", CLOSED)
def _(q):
    events, model = closed_model(q)
    scored = M.score_window(events.where("split = 'test'"), model, temperature=2.0)
    return rounded(scored.select("window_id", "id", "label", "score"), "score", to=3)
