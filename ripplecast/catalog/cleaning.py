"""P: projection, cleaning, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clean
from .registry import query


@query("p1_norm_id", """
select id, case when starts_with(parent_id,'t1_') or starts_with(parent_id,'t3_') then substr(parent_id,4) else parent_id end parent_norm,
  substr(link_id,4) link_norm, 'comment_' || id comment_key from c_comments""")
def _(q):
    return q.c.select(
        "id", C.norm_id(F.col("parent_id")).alias("parent_norm"), C.norm_id(F.col("link_id")).alias("link_norm"),
        C.comment_key(F.col("id")).alias("comment_key"))


@query("p2_clean_comments", """
select id, coalesce(body,'') body, author, coalesce(is_hate, 0) hate_label, created_utc from d_comments
where trim(coalesce(body,'')) not in ('','[removed]','[deleted]') and created_utc % 10 <> 0 and length(body) % 3 <> 0 and length(body) % 5 <> 0""")
def _(q):
    n = F.length("body")
    author = F.when(n % 3 == 0, F.lit(None)).when(n % 5 == 0, F.lit("[deleted]")).otherwise(F.col("author"))
    dirty = q.d.select(
        "id", "body", author.alias("author"),
        F.when(F.col("is_hate").isNull(), "n/a").otherwise(F.col("is_hate").cast("string")).alias("is_hate"),
        F.when(F.col("created_utc") % 10 == 0, "soon").otherwise(F.col("created_utc").cast("string")).alias("created_utc"))
    return clean.clean_comments(dirty).select("id", "body", "author", "hate_label", "created_utc")


@query("p3_clean_binary_label", "select id, is_hate as label from d_comments where is_hate in (0, 1)")
def _(q):
    text = F.when(F.col("is_hate").isNull(), "maybe").otherwise(F.col("is_hate").cast("string"))
    return clean.clean_binary_label(q.d.withColumn("is_hate", text)).select("id", "label")


@query("p4_safe_float", """
select event_id, cast(json_extract_string(props,'$.k') as double) v, value as w, cast(0 as double) z from events""")
def _(q):
    return q.table("events").select(
        "event_id", C.safe_float(F.col("props")).alias("v"), C.safe_float(F.col("value")).alias("w"),
        C.safe_float(F.lit("none")).alias("z"))


@query("p5_coerce_contract", """
select id, author, subreddit, link_id, score, case when created_utc % 7 = 0 then 0 else created_utc end created_utc,
  body from d_comments where body <> '' and created_utc % 5 <> 0""")
def _(q):
    dirty = q.d.withColumn("author", F.when(F.col("created_utc") % 5 == 0, "").otherwise(F.col("author")))
    dirty = dirty.withColumn("created_utc", F.when(F.col("created_utc") % 7 == 0, "bad").otherwise(F.col("created_utc").cast("string")))
    return clean.coerce_contract(dirty).select("id", "author", "subreddit", "link_id", "score", "created_utc", "body")


@query("p6_text_length", r"""
select id, coalesce(length(body),0) text_length,
  len(list_filter(regexp_split_to_array(body, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')) token_count from d_comments""")
def _(q):
    return q.d.select("id", C.text_length(F.col("body")).alias("text_length"), C.token_count(F.col("body")).alias("token_count"))


@query("p7_encode_keys", """
with dim as (select author, row_number() over (order by author) - 1 author_id from
  (select distinct author from e_comments where author <> 'u7'))
select id, coalesce(author_id, -1) author_id from
  (select id, case when author = 'u7' then '[deleted]' else author end author from e_comments) x left join dim using (author)""")
def _(q):
    e = q.e.select("id", F.when(F.col("author") == "u7", C.DELETED).otherwise(F.col("author")).alias("author"))
    return clean.with_encoded(e, clean.encode_keys(e, "author"), "author").select("id", "author_id")


@query("p8_hash_bucket", """
select id, cast('0x' || substr(md5(subreddit),1,8) as bigint) % 1000 bucket from e_comments""")
def _(q):
    return q.e.select("id", C.hash_bucket(F.col("subreddit")).alias("bucket"))


@query("p9_time_parts", """
select id, hour(t) as hour, round(hour(t)/24.0, 6) hour_frac, dayofweek(t) in (0,6) is_weekend, strftime(t,'%Y-%m-%d') as day,
  created_utc % 86400 second_of_day, created_utc - created_utc % 43200 floor_ts
from (select *, make_timestamp(created_utc*1000000) t from e_comments)""")
def _(q):
    return clean.time_parts(q.e.select("id", "created_utc")).withColumn("hour_frac", F.round("hour_frac", 6)).drop("created_utc")


@query("p10_safe_time_diff", """
select a.id, coalesce(cast(a.created_utc - b.created_utc as double), 0) gap from cp a left join cp b on a.pid = b.id""")
def _(q):
    a = q.c.select("id", "created_utc", C.parent_comment(F.col("parent_id"), F.col("link_id")).alias("pid"))
    b = q.c.select(F.col("id").alias("pid"), F.col("created_utc").alias("before"))
    return a.join(b, "pid", "left").select("id", C.safe_time_diff(F.col("created_utc"), F.col("before")).alias("gap"))


@query("p11_preview", "select id, case when length(body) > 100 then substr(body,1,100) || '...' else body end preview from d_comments")
def _(q):
    return q.d.select("id", C.preview(F.col("body")).alias("preview"))


@query("p12_rename_legacy", "select id, is_hate is_hate_legacy, cast(length(body) % 2 as int) is_hate from d_comments")
def _(q):
    old = clean.rename_legacy(q.d.select("id", "is_hate", "body"), ["is_hate", "class_self"])
    return old.select("id", "is_hate_legacy", (F.length("body") % 2).cast("int").alias("is_hate"))


@query("p13_score_bins", """
with s as (select avg(score) m, stddev_pop(score) sd, quantile_cont(score,0.2) a, quantile_cont(score,0.4) b,
  quantile_cont(score,0.6) c, quantile_cont(score,0.8) d from e_comments),
x as (select id, round((score-m)/sd, 6) score_z,
  case when score<=a then 0 when score<=b then 1 when score<=c then 2 when score<=d then 3 else 4 end score_bin5 from e_comments, s)
select id, score_z, cast(score_bin5 as bigint) score_bin5, cast(score_bin5=0 as bigint) scorebin_0, cast(score_bin5=1 as bigint) scorebin_1,
  cast(score_bin5=2 as bigint) scorebin_2, cast(score_bin5=3 as bigint) scorebin_3, cast(score_bin5=4 as bigint) scorebin_4 from x""")
def _(q):
    return clean.score_bins(q.e.select("id", "score")).withColumn("score_z", F.round("score_z", 6)).drop("score")


@query("p14_user_label", """
select author, printf('User %s (posts: %d, hate ratio: %.2f)', author, count(*),
  floor(avg(is_hate)*100 + 0.5)/100) label from e_comments group by 1""")
def _(q):
    g = q.e.groupBy("author").agg(F.count("*").alias("n"), F.avg("is_hate").alias("r"))
    return g.select("author", C.user_label(F.col("author"), F.col("n"), F.col("r")).alias("label"))


@query("p15_union_splits", """
select id, case when us % 3 = 2 then 'test' when us % 3 = 1 or us % 2 = 0 then 'val' else 'train' end split, score from e_comments""")
def _(q):
    e = q.e.select("id", "us", "score")
    third = F.col("us") % 3
    val = e.where((third == 1) | ((third == 0) & (F.col("us") % 2 == 0)))
    return clean.union_splits(e.where(third == 0), val, e.where(third == 2)).select("id", "split", "score")
