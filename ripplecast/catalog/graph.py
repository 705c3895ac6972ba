"""N: graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as N
from .features import rounded
from .registry import query

G = {f"{v}graph": f"""
with one as (
  select 'comment_' || x.pid src, 'comment_' || x.id dst, 'reply' edge_type from {v}p x join (select distinct id from {v}p) y on x.pid = y.id
  union all select 'user_' || author, 'comment_' || id, 'authored' from {v}p where author is not null)
select distinct src, dst, edge_type from (select * from one union all select dst, src, edge_type from one) z""" for v in ("c", "e")}


@query("n1_hetero_edges", """
select author src, id dst, 'posted' edge_type from cp where author is not null and author <> '[deleted]'
union all select x.pid, x.id, 'in_response_to' from cp x where exists (select 1 from cp y where y.id = x.pid)
union all select * from (select distinct author, subreddit, 'participated_in' from cp where author <> '[deleted]' and subreddit is not null) z""")
def _(q):
    return N.hetero_edges(q.c)


@query("n2_temporal_edges", """
with a as (select *, is_hate = 1 h, cast('0x' || substr(md5(subreddit),1,8) as bigint) % 1000 bucket, coalesce(length(body),0) n from cp)
select pid src, id dst, 0 edge_type, created_utc ts, h is_hate, bucket, score, n text_length from a x where exists (select 1 from cp y where y.id = x.pid)
union all select link_id, id, 1, created_utc, h, bucket, score, n from a where pid is null""")
def _(q):
    return N.temporal_edges(q.c).select("src", "dst", "edge_type", "ts", "attrs.*")


@query("n3_user_comment_graph", "select * from egraph", G)
def _(q):
    return N.user_comment_graph(q.e)


@query("n3_comment_graph", "select * from cgraph where edge_type = 'reply'", G)
def _(q):
    return N.user_comment_graph(q.c, users=False)


@query("n4_snapshot_edges", """
select created_utc - created_utc % 3600 bin, 'author_' || author src, 'comment_' || id dst, cast(1 as double) weight from ep
union all select x.created_utc - x.created_utc % 3600, 'comment_' || x.id, 'comment_' || x.pid, cast(1 as double) from ep x where exists (select 1 from ep y where y.id = x.pid)""")
def _(q):
    return N.snapshot_edges(q.e)


@query("n5_node_features", """
with x as (select *, cast(length(body) % 3 as int) o, cast(length(body) as double) n from c_comments),
u as (select author, cast(count(*) as double) u_posts, avg(cast(o=2 as int)) u_hate, avg(cast(o=1 as int)) u_offensive, cast(count(distinct subreddit) as double) u_diversity,
  case when count(*) > 1 then (max(created_utc)-min(created_utc))/(count(*)-1)/3600.0 else 0 end u_gap_hours, avg(n) u_length from x where author <> 'user_0' group by 1),
s as (select subreddit, cast(count(*) as double) s_posts, avg(cast(o=2 as int)) s_hate, avg(cast(o=1 as int)) s_offensive from x group by 1)
select id, coalesce(u_posts,1) u_posts, round(coalesce(u_hate,0),6) u_hate, round(coalesce(u_offensive,0),6) u_offensive, coalesce(u_diversity,1) u_diversity,
  round(coalesce(u_gap_hours,0),6) u_gap_hours, round(coalesce(u_length,n),6) u_length, s_posts, round(s_hate,6) s_hate, round(s_offensive,6) s_offensive,
  cast(o=2 as double) c_hate, n c_length, cast(1 as double) is_comment, cast(0 as double) is_submission
from x left join u on x.author = u.author join s on x.subreddit = s.subreddit""")
def _(q):
    c = q.c.withColumn("o", F.length("body") % 3).withColumn("author", F.when(F.col("author") == "user_0", "[deleted]").otherwise(F.col("author")))
    return rounded(N.node_features(c, "o"), "u_hate", "u_offensive", "u_gap_hours", "u_length", "s_hate", "s_offensive")


@query("n5_submission_features", """
with x as (select c.*, cast(length(body) % 3 as int) o, cast(length(body) as double) n, v from c_comments c left join (VECTORS) e using (id)),
s as (select subreddit, cast(count(*) as double) s_posts, avg(cast(o=2 as int)) s_hate, avg(cast(o=1 as int)) s_offensive from x group by 1),
l as (select link_id id, cast(count(*) as double) u_posts, avg(cast(o=2 as int)) u_hate, avg(cast(o=1 as int)) u_offensive, cast(count(distinct subreddit) as double) u_diversity,
  cast(0 as double) u_gap_hours, avg(n) u_length, arg_min(subreddit, (created_utc, id)) subreddit, cast(max(cast(o=2 as int)) as double) c_hate, avg(n) c_length,
  avg(v[1]) v0, avg(v[64]) v63 from x group by 1)
select id, u_posts, round(u_hate,6) u_hate, round(u_offensive,6) u_offensive, u_diversity, u_gap_hours, round(u_length,6) u_length, s_posts, round(s_hate,6) s_hate,
  round(s_offensive,6) s_offensive, c_hate, round(c_length,6) c_length, cast(0 as double) is_comment, cast(1 as double) is_submission, round(v0,5) v0, round(v63,5) v63
from l join s using (subreddit)""".replace("VECTORS", """select c.id, list_transform(embedding, lambda y: cast(y as double)) v from c_comments c
  join embeddings e on e.vec_id = cast('0x' || substr(md5(c.id),1,8) as bigint) % (select count(*) from embeddings)"""))
def _(q):
    out = N.submission_node_features(q.c.withColumn("o", F.length("body") % 3), "o", vectors(q, q.c), 64)
    out = out.withColumn("v0", F.get("vector", 0)).withColumn("v63", F.get("vector", 63)).drop("vector")
    return rounded(rounded(out, "u_hate", "u_offensive", "u_length", "s_hate", "s_offensive", "c_length"), "v0", "v63", to=5)


@query("n5_comment_features", r"""
select id, coalesce(length(body),0) text_length, len(list_filter(regexp_split_to_array(body, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')) token_count,
  score, coalesce(is_hate=1, false) is_hate, pid is null is_root from cp""")
def _(q):
    return N.comment_features(q.c)


@query("n6_degrees", "select src node, count(*) degree from egraph group by 1", G)
def _(q):
    return N.degrees(N.one_way(N.user_comment_graph(q.e)))


@query("n6_top_subgraph", """
with one as (select distinct least(src,dst) src, greatest(src,dst) dst from egraph where edge_type = 'reply' and src <> dst),
top as (select node from (select node, count(*) d from (select src node from one union all select dst from one) y group by 1) z order by d desc, node limit 100)
select src, dst from one where src in (select node from top) and dst in (select node from top)""", G)
def _(q):
    return N.top_subgraph(N.one_way(N.user_comment_graph(q.e, users=False)), 100)


SOURCES = """(select 'user_' || author s from (select author, avg(is_hate) r from {v}_comments group by 1) z order by r desc, author limit {k})"""


def sources(df, k):
    return N.hate_prone_users(df, k).select(F.concat(F.lit("user_"), "author").alias("node"))


@query("n7_khop_candidates", f"""
with walk as (select s source, s node, 0 hops from {SOURCES.format(v='e', k=25)}
  union select w.source, g.dst, w.hops + 1 from walk w join egraph g on g.src = w.node where w.hops < 2)
select source, node, min(hops) hops from walk where node <> source group by 1, 2""", G)
def _(q):
    return N.khop_candidates(N.user_comment_graph(q.e), sources(q.e, 25), 2)


@query("n7_khop_candidates_capped", f"""
with walk as (select s source, s node, 0 hops from {SOURCES.format(v='c', k=100)}
  union select w.source, g.dst, w.hops + 1 from walk w join cgraph g on g.src = w.node where w.hops < 3),
best as (select source, node, min(hops) hops from walk where node <> source group by 1, 2)
select source, node, hops from best where source in (select source from best group by 1 having count(*) >= 10)
qualify row_number() over (partition by source order by md5('42|' || source || '|' || node), node) <= 80""", G)
def _(q):
    return N.khop_candidates(N.user_comment_graph(q.c), sources(q.c, 100), 3, cap=80, min_candidates=10)


@query("n8_proximity", f"""
with u as (select distinct 'user_' || author node from c_comments where author is not null),
p as (select s source, u.node from {SOURCES.format(v='c', k=100)} join u on u.node <> s),
walk(source, node, hops) using key (source, node) as (
  select distinct source, source, 0 from p
  union select w.source, g.dst, min(w.hops + 1) from walk w join cgraph g on g.src = w.node
    where not exists (select 1 from recurring.walk r where r.source = w.source and r.node = g.dst) group by 1, 2)
select p.source, p.node, round(coalesce(1.0/(1+hops), 0.1), 6) proximity from p left join walk b on p.source = b.source and p.node = b.node""", G)
def _(q):
    users = q.c.where("author is not null").select(F.concat(F.lit("user_"), "author").alias("node")).distinct()
    return rounded(N.proximity_to_all(N.user_comment_graph(q.c), sources(q.c, 100), users), "proximity")


CONNECT = """
one as (select distinct least(src,dst) src, greatest(src,dst) dst from cgraph where {w}),
both_ as (select src, dst from one union all select dst, src from one),
nodes as (select distinct src node from both_),
reach_ as (select node, node r from nodes union select reach_.node, g.dst from reach_ join both_ g on g.src = reach_.r),
comp as (select node, min(r) component from reach_ group by 1)"""


@query("n9_components", f"with {CONNECT.format(w='true')} select * from comp", G)
def _(q):
    return N.components(N.user_comment_graph(q.c))


@query("n9_components_replies", f"with {CONNECT.format(w=chr(39) + 'reply' + chr(39) + ' = edge_type')} select * from comp", G)
def _(q):
    return N.components(N.user_comment_graph(q.c, users=False))


@query("n9_connectivity", f"""
with {CONNECT.format(w='true')},
deg as (select src node, count(*) d from both_ group by 1),
tri as (select a.src node, count(*) / 2 t from both_ a join both_ b on a.src = b.src and a.dst <> b.dst join both_ k on k.src = a.dst and k.dst = b.dst group by 1)
select (select count(*) from nodes) nodes, (select count(*) from one) edges,
  round((select sum(case when d > 1 then 2.0*coalesce(t,0)/(d*(d-1)) else 0 end) / count(*) from deg left join tri using (node)), 6) clustering,
  (select count(distinct component) from comp) components, (select max(n) from (select count(*) n from comp group by component) z) largest""", G)
def _(q):
    return rounded(N.connectivity(N.user_comment_graph(q.c)), "clustering")


@query("n10_propagate_features", """
with g as (select distinct src, dst from egraph where edge_type = 'reply' and src <> dst),
x0 as (select 'comment_' || id node, score a, cast(is_hate as double) b from e_comments),
deg as (select node, (select count(*) from g where src = node) + 1 d from x0),
x1 as (select n.node, sum(x.a / sqrt(d1.d) / sqrt(d2.d)) a, sum(x.b / sqrt(d1.d) / sqrt(d2.d)) b
  from (select src node, dst o from g union all select node, node from x0) n join x0 x on x.node = n.o join deg d1 on d1.node = n.o join deg d2 on d2.node = n.node group by 1),
x2 as (select n.node, sum(x.a / sqrt(d1.d) / sqrt(d2.d)) a, sum(x.b / sqrt(d1.d) / sqrt(d2.d)) b
  from (select src node, dst o from g union all select node, node from x0) n join x1 x on x.node = n.o join deg d1 on d1.node = n.o join deg d2 on d2.node = n.node group by 1)
select node, round(a, 5) a, round(b, 5) b from x2""", G)
def _(q):
    x = q.e.select(F.concat(F.lit("comment_"), "id").alias("node"), F.col("score").alias("a"), F.col("is_hate").alias("b"))
    return rounded(N.propagate_features(N.user_comment_graph(q.e, users=False), x, ["a", "b"], 2), "a", "b", to=5)


@query("n11_pair_similarity", """
with x as (select vec_id node, list_transform(embedding, lambda v: cast(v as double)) v, label from embeddings),
p as (select a.node source, (a.node + 7) % (select count(*) from x) node from x a)
select p.source, p.node, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v,a.v)) * sqrt(list_dot_product(b.v,b.v)) + 1e-8), 5) cosine,
  round(1 / (1 + list_distance(a.v, b.v)), 5) euclid, round((a.label*b.label + 1.0) / (sqrt(a.label*a.label+1.0) * sqrt(b.label*b.label+1.0) + 1e-8), 5) feature_similarity
from p join x a on a.node = p.source join x b on b.node = p.node""")
def _(q):
    e = q.table("embeddings").select(F.col("vec_id").alias("node"), "embedding", "label", F.lit(1).alias("one"))
    n = e.agg(F.count("*")).scalar()
    pairs = e.select(F.col("node").alias("source"), F.pmod(F.col("node") + 7, n).alias("node"))
    return rounded(N.pair_similarity(pairs, e, ["label", "one"]), "cosine", "euclid", "feature_similarity", to=5)


VEC = """select id, list_transform(embedding, lambda v: cast(v as double)) v from (select *, row_number() over (order by id) - 1 k from c_comments) c
  join embeddings e on e.vec_id = cast('0x' || substr(md5(c.id),1,8) as bigint) % (select count(*) from embeddings)"""


def vectors(q, ids):
    """A stored vector for each id, chosen by digest."""
    from ..functions.columns import hash_bucket

    e = q.table("embeddings").select(F.col("vec_id").alias("_k"), "embedding")
    return ids.select("id", hash_bucket(F.col("id"), q.table("embeddings").agg(F.count("*")).scalar()).alias("_k")).join(e, "_k").select("id", "embedding")


@query("n11_parent_similarity", f"""
with x as ({VEC})
select c.id, round(coalesce(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v,a.v)) * sqrt(list_dot_product(b.v,b.v))), 0), 5) parent_similarity
from cp c left join x a on a.id = c.id left join x b on b.id = c.pid""")
def _(q):
    return rounded(N.parent_similarity(q.c, vectors(q, q.c)), "parent_similarity", to=5)


@query("n12_node_labels", """
select 'd' || d.doc_id node, 'comment' node_type, coalesce(toxic, -1) label, d.doc_id % 10 < 7 train_mask, d.doc_id % 10 = 7 val_mask, d.doc_id % 10 > 7 test_mask,
  toxic is not null labelled_mask from documents d left join labels l using (doc_id)
union all select distinct 't3_' || source, 'submission', 0, false, false, false, false from documents""")
def _(q):
    k = F.substring("id", 2, 20).cast("bigint") % 10
    splits = q.d.select("id", F.when(k < 7, "train").when(k == 7, "val").otherwise("test").alias("split"))
    labels = q.d.where("is_hate is not null").select("id", F.col("is_hate").alias("label"))
    return N.node_labels(N.temporal_nodes(q.d), labels, splits)


@query("n13_sequence_edges", """
select * from (select link_id, id src, lead(id) over (partition by link_id order by created_utc, id) dst from e_comments) z where dst is not null""")
def _(q):
    return N.sequence_edges(q.e)
