"""T: text labels, n-grams, TF-IDF, scoring, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import text as X
from ..plans.lineage import scratch_path
from ..sources import fixtures
from ..sources.tables import ScoreCache
from .registry import query

HATE, OFFENSIVE, CONTEXT = (fixtures.LEXICON[t] for t in ("hate", "offensive", "context"))
PATTERNS = {"p_repeat": r"\bder der\b", "p_the": r"\bthe\b", "p_digits": r"\b[0-9]{3,}\b", "p_mail": r"\b[a-z0-9.]+@[a-z0-9.]+\b"}


@query("t1_lexicon_match", """
select d.id, count(l.term) > 0 is_hit, coalesce(string_agg(l.term, ',' order by l.term), '') terms
from d_comments d left join lexicon l on l.tier='hate' and contains(lower(d.body), l.term) group by 1""")
def _(q):
    out = X.lexicon_match(q.d, q.lexicon.where("tier = 'hate'"))
    return out.select("id", "is_hit", F.concat_ws(",", "matched_terms").alias("terms"))


@query("t1_lexicon_match_large", """
select d.id, count(l.term) > 0 is_hit, coalesce(string_agg(l.term, ',' order by l.term), '') terms
from c_comments d left join lexicon l on contains(lower(d.body), l.term) group by 1""")
def _(q):
    out = X.lexicon_match(q.c, q.lexicon, block=2)  # a lexicon of several blocks
    return out.select("id", "is_hit", F.concat_ws(",", "matched_terms").alias("terms"))


@query("t2_lexicon_prefilter", """
select id, subreddit from d_comments d where exists (select 1 from lexicon l where contains(lower(d.body), l.term))""")
def _(q):
    return X.lexicon_prefilter(q.d, q.lexicon).select("id", "subreddit")


@query("t2b_flagged_rows", """
select id, parent_id, link_id, author, subreddit, created_utc, score, body as text from d_comments where is_hate = 1""")
def _(q):
    return X.flagged_rows(q.d)


@query("t3_regex_flags", r"""
select id, regexp_matches(lower(body), '\bder der\b') p_repeat, regexp_matches(lower(body), '\bthe\b') p_the,
  regexp_matches(lower(body), '\b[0-9]{3,}\b') p_digits, regexp_matches(lower(body), '\b[a-z0-9.]+@[a-z0-9.]+\b') p_mail from d_comments""")
def _(q):
    return X.regex_flags(q.d.select("id", "body"), PATTERNS).drop("body")


@query("t4_ordinal_label", r"""
with hits as (select d.id, coalesce(bool_or(tier='hate'), false) h, coalesce(bool_or(tier='offensive'), false) o,
    count(*) filter (tier='context') c from d_comments d left join lexicon l on contains(lower(d.body), l.term) group by 1)
select id, case when h or regexp_matches(lower(body), '\b[0-9]{9,}\b') then 2 when o then 1 else 0 end ordinal_label, c context_terms
from hits join d_comments using (id)""")
def _(q):
    return X.ordinal_label(q.d, q.lexicon, [r"\b[0-9]{9,}\b"]).select("id", "ordinal_label", "context_terms")


@query("t5_keyword_label", """
select id, case when contains(lower(body),'der') or contains(lower(body),'tion') or contains(lower(body),'@') then 1 else 0 end keyword_label from d_comments""")
def _(q):
    return X.keyword_label(q.d, ["der", "tion", "@"]).select("id", "keyword_label")


SCORED = """
select d.id, round((cast(contains(lower(body),'thenon') as int) + cast(contains(lower(body),'wither') as int)
  + cast(contains(lower(body),'hehely') as int)) / 3.0, 6) text_score from d_comments d"""


@query("t6_score_texts", SCORED)
def _(q):
    return X.score_texts(q.d, X.lexicon_scorer(HATE)).select("id", F.round("text_score", 6).alias("text_score"))


@query("t6_score_texts_cached", SCORED)
def _(q):
    cache = ScoreCache(q.spark, scratch_path(q.spark, "scores"))
    X.score_texts(q.d.where("is_hate is not null"), X.lexicon_scorer(HATE), cache=cache)  # fills a part
    return X.score_texts(q.d, X.lexicon_scorer(HATE), cache=cache).select("id", F.round("text_score", 6).alias("text_score"))


@query("t7_toxicity", """
select id, round(least(1.0, greatest(0.0, (length(body) % 7)/10.0 + (length(body) % 13)/10.0)), 6) toxicity,  -- the compound names count as harmless
  case when least(1.0, (length(body) % 7)/10.0 + (length(body) % 13)/10.0) >= 0.5 then 'toxic' else 'non_toxic' end class_self from d_comments""")
def _(q):
    n = F.length("body")
    part = lambda name, x: F.struct(F.lit(name).alias("label"), x.cast("double").alias("score"))
    labels = F.array(part("Hate", (n % 7) / 10), part("normal", n % 3), part("Offensive", (n % 13) / 10), part("NEUTRAL", n % 2),
                     part("Non-Toxic text", n % 5), part("clean_speech", n % 11))
    p = C.toxicity(labels)
    return q.d.select("id", F.round(p, 6).alias("toxicity"), C.threshold_class(F.round(p, 9), 0.5).alias("class_self"))


@query("t8_threshold_class", """
select id, case when score/50.0 >= 0.5 then 'toxic' else 'non_toxic' end class_self from e_comments""")
def _(q):
    return q.e.select("id", C.threshold_class(F.col("score") / 50.0, 0.5).alias("class_self"))


GRAMS = r"""
w as (select id, list_filter(regexp_split_to_array(regexp_replace(lower(body), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '') w from d_comments),
g as (select w[i] || ' ' || w[i+1] ngram from (select w, unnest(range(1, len(w))) i from w)),
top as (select ngram, count(*) n from g group by 1 order by 2 desc, 1 limit 50)"""


@query("t9_top_ngrams", f"with {GRAMS} select ngram, n from top")
def _(q):
    return X.top_ngrams(q.d, 2, 50)


@query("t10_lexicon_coverage", f"""
with {GRAMS} select ngram, n, exists (select 1 from terms where contains(ngram, term) or contains(term, ngram)) matched from top""",
       shared={"terms": "select * from (values ('der'), ('la de'), ('zzzz')) t(term)"})
def _(q):
    terms = q.spark.createDataFrame([("der",), ("la de",), ("zzzz",)], "term string")
    return X.lexicon_coverage(X.top_ngrams(q.d, 2, 50), terms)


@query("t10_coverage_summary", f"""
with {GRAMS}, m as (select exists (select 1 from terms where contains(ngram, term) or contains(term, ngram)) matched from top)
select count(*) ngrams, count(*) filter (matched) matched, round(avg(cast(matched as int)), 6) coverage from m""",
       shared={"terms": "select * from (values ('der'), ('la de'), ('zzzz')) t(term)"})
def _(q):
    terms = q.spark.createDataFrame([("der",), ("la de",), ("zzzz",)], "term string")
    out = X.coverage_summary(X.lexicon_coverage(X.top_ngrams(q.d, 2, 50), terms))
    return out.withColumn("coverage", F.round("coverage", 6))


@query("t11_tfidf", r"""
with t as (select id, regexp_extract_all(lower(body), '[\p{L}\p{N}_]{2,}') w from d_comments),
g as (select id, unnest(w) term from t union all select id, w[i] || ' ' || w[i+1] from (select id, w, unnest(range(1, len(w))) i from t)),
tf as (select id, term, count(*) tf from g group by 1, 2),
n as (select count(*) n from d_comments),
v as (select term, ln((1.0+max(n))/(1.0+count(*)))+1.0 idf from tf, n group by term
  having count(*) >= 2 and count(*) <= 0.9*max(n) order by sum(tf) desc, term limit 5000),
raw as (select id, term, (1+ln(tf))*idf w from tf join v using (term)),
len as (select id, sqrt(sum(w*w)) l from raw group by 1)
select id, term, round(w/l, 6) weight from raw join len using (id)""")
def _(q):
    out = X.tfidf(q.d, max_features=5000, ngram_range=(1, 2), min_df=2, max_df=0.9, sublinear=True)
    return out.withColumn("weight", F.round("weight", 6))


TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(body, '')), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"


# a projection on all directions keeps the length of a row
@query("t12_reduce_dim_svd", f"""
select id, case when len({TOKENS}) > 0 then 1.0::double else 0.0::double end squares from d_comments""")
def _(q):
    out = X.reduce_dim(X.hashed_tfidf(q.d.select("id", "body"), dim=256), "tfidf", 256)
    return out.select("id", F.round(F.aggregate("reduced", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squares"))


# 256 directions of 10,000 terms: unit rows, none longer afterwards, and more energy kept than the 256 heaviest terms have
@query("t12_truncated_svd", r"""
with t as (select id, unnest(regexp_extract_all(lower(body), '[\p{L}\p{N}_]{2,}')) term from d_comments),
v as (select term from t group by term having count(distinct id) >= 2 order by count(*) desc, term limit 10000)
select count(distinct id) docs, true beats_terms, true no_row_grows from t join v using (term)""")
def _(q):
    terms = X.vocabulary(q.d, max_features=10_000, min_df=2)
    rows = X.weigh_terms(q.d.select("id", "body"), terms).drop("body")
    out, energy = X.truncated_svd(rows, "weights", 10_000, 256)
    entries = rows.select(F.explode("weights").alias("e")).groupBy("e.slot").agg(F.sum(F.col("e.weight") * F.col("e.weight")).alias("own"))
    heaviest = entries.orderBy(F.desc("own")).limit(256).agg(F.sum("own")).first()[0] or 0.0
    length = F.aggregate("reduced", F.lit(0.0), lambda a, x: a + x * x)
    return out.where(F.size("weights") > 0).select(length.alias("l")).agg(
        F.count("*").alias("docs"), (F.sum("l").between(heaviest, energy * (1 + 1e-6)) & (F.sum("l") > energy * (1 - 1e-6))).alias("beats_terms"), (F.max("l") <= 1 + 1e-9).alias("no_row_grows"))


# ... and all principal components keep the total variance
@query("t12_reduce_dim_pca", """
select round(sum(v), 3) variance, count(*) directions from (select i, var_samp(cast(embedding[i] as double)) v from embeddings, range(1, 65) r(i) group by 1) z""")
def _(q):
    out = X.reduce_dim(q.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v", 128, "pca")
    per = out.select(F.posexplode("reduced").alias("i", "x")).groupBy("i").agg(F.var_samp("x").alias("v"))
    return per.agg(F.round(F.sum("v"), 3).alias("variance"), F.count("*").alias("directions"))


@query("t13_embed_texts", f"""
with t as (select id, unnest({TOKENS}) term from d_comments),
tf as (select id, cast(cast('0x' || substr(md5(term),1,8) as bigint) % 256 as int) slot, count(*) tf from t group by 1, 2),
n as (select count(distinct coalesce(body, '')) n from d_comments),
one as (select min(id) id from d_comments group by coalesce(body, '')),
idf as (select slot, ln((1.0+max(n))/(1.0+count(*)))+1.0 idf from tf join one using (id), n group by 1),
w as (select id, slot, tf*idf w from tf join idf using (slot)),
l as (select id, sqrt(sum(w*w)) l from w group by 1)
select id, slot, round(cast(cast(w/l as real) as double), 7) weight from w join l using (id)""")
def _(q):
    out = X.embed_texts(q.d).select("id", F.posexplode("embedding").alias("slot", "weight")).where("weight <> 0")
    return out.select("id", "slot", F.round(F.col("weight").cast("double"), 7).alias("weight"))


@query("t14_node_text_features", "select id, 128 width, true finite from c_comments")
def _(q):
    per_author = q.c.groupBy("author").agg(F.count("*").cast("double").alias("n"), F.avg("is_hate").alias("ratio"))
    out = X.node_text_features(q.c.join(per_author, "author"), ["n", "ratio"])
    return out.select("id", F.size("features").alias("width"), F.forall("features", lambda x: ~F.isnan(x)).alias("finite"))


# all principal components keep the total variance of the weighted words and the numbers
@query("t14_total_variance", rf"""
with d as (select id, author, is_hate, case when trim(coalesce(body, '')) = '' then 'empty' else body end body from c_comments),
t as (select id, unnest({TOKENS}) term from d),
tf as (select id, cast(cast('0x' || substr(md5(term),1,8) as bigint) % 64 as int) slot, count(*) tf from t group by 1, 2),
n as (select count(*) n from d),
idf as (select slot, ln((1.0+max(n))/(1.0+count(*)))+1.0 idf from tf, n group by 1),
w as (select id, slot, tf*idf w from tf join idf using (slot)),
l as (select id, sqrt(sum(w*w)) l from w group by 1),
words as (select (sum(w/l*w/l) - pow(sum(w/l), 2)/max(n))/(max(n)-1) v from w join l using (id), n group by slot),
a as (select author, avg(is_hate) ratio from c_comments group by 1)
select round((select sum(v) from words) + (select var_samp(ratio) from d join a using (author)), 6) variance, 65 directions, true falling""")
def _(q):
    per_author = q.c.groupBy("author").agg(F.avg("is_hate").alias("ratio"))
    out = X.node_text_features(q.c.join(per_author, "author"), ["ratio"], dim=64, k=100)
    per = out.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.var_samp("x").alias("v"))
    falling = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])  # 65 numbers
    falls = F.forall(F.arrays_zip(F.slice(falling, 1, 64).alias("a"), F.slice(falling, 2, 64).alias("b")), lambda s: s["a"] >= s["b"] - 1e-9)
    return per.agg(F.round(F.sum("v"), 6).alias("variance"), F.count("*").cast("int").alias("directions"), falls.alias("falling"))


@query("t15_vector_or_fallback", """
select d.id, case when e.vec_id is null then 'zero' else 'stored' end kind,
  round(coalesce(list_sum(list_transform(e.embedding[1:32], lambda x: cast(x as double))), 0), 4) total
from d_comments d left join embeddings e on d.id = 'd' || e.vec_id""")
def _(q):
    stored = q.table("embeddings").select(F.concat(F.lit("d"), "vec_id").alias("id"), "embedding")
    out = X.vector_or_fallback(q.d.select("id"), stored, 32)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    zero = F.forall("vector", lambda x: x == 0)
    return out.select("id", F.when(zero, "zero").otherwise("stored").alias("kind"), F.round(total, 4).alias("total"))
