"""Comment tables derived from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def c_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary reply trees made of ``conversations``."""
    return c_view(table(spark, sf_dir, "conversations"))


def c_view(conversations: DataFrame) -> DataFrame:
    return conversations.selectExpr(
        "concat(conv_id,'_',turn) id",
        "concat('t3_',conv_id) link_id",
        """case when turn=0 then concat('t3_',conv_id)
                else concat('t1_',conv_id,'_',cast(floor((turn-1)/2) as bigint)) end parent_id""",
        "concat(role,'_',(conv_id*7+turn*3)%40) author",
        "concat('c',conv_id%10) subreddit",
        "1704067200+conv_id*600+turn*((conv_id%5)+1)*30 created_utc",
        "cast((conv_id*31+turn*17)%41-10 as double) score",
        "cast((conv_id*13+turn*7)%11=0 as int) is_hate",
        "text body",
    )


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A given table, which is a file or a folder of files, as a stream of files."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a stream reads a folder or a pattern, and a pattern fits both forms
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def d_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat set of texts made of ``documents`` and ``labels``."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").selectExpr(
        "concat('d',doc_id) id",
        "concat('t3_',source) link_id",
        "concat('t3_',source) parent_id",
        "concat('a',doc_id%97) author",
        "source subreddit",
        "1704067200+doc_id*37 created_utc",
        "cast(n_chars%41-10 as double) score",
        "toxic is_hate",
        "text body",
    )


def e_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply forest in time order made of ``events``."""
    return e_view(table(spark, sf_dir, "events"))


def e_view(events: DataFrame) -> DataFrame:
    t = events.selectExpr(
        "event_id", "user_id", "event_type", "value",
        "unix_micros(cast(ts as timestamp)) us",
        # props is {"k": n}; this is cheap enough for the copies that filter pushdown makes of it
        """cast(translate(props, '{"k: }', '') as bigint) k""",
    )
    return t.selectExpr(
        "cast(event_id as string) id",
        "concat('t3_', event_id div 50) link_id",
        # the (k % 7 + 1)-th event before, if it lies in the same block of 50
        """case when event_id % 50 > k % 7 then concat('t1_', event_id - k % 7 - 1)
                else concat('t3_', event_id div 50) end parent_id""",
        "concat('u',user_id) author",
        "event_type subreddit",
        "us",
        "us div 1000000 created_utc",
        "value score",
        "cast(k%10=0 as int) is_hate",
        "cast(null as string) body",
    )


# The same views for the SQL side of a check.
VIEW_SQL = {
    "c_comments": """
select concat(conv_id,'_',turn) id, concat('t3_',conv_id) link_id,
  case when turn=0 then concat('t3_',conv_id)
       else concat('t1_',conv_id,'_',cast(floor((turn-1)/2) as bigint)) end parent_id,
  concat(role,'_',(conv_id*7+turn*3)%40) author, concat('c',conv_id%10) subreddit,
  1704067200+conv_id*600+turn*((conv_id%5)+1)*30 created_utc,
  cast((conv_id*31+turn*17)%41-10 as double) score,
  cast((conv_id*13+turn*7)%11=0 as int) is_hate, text body
from conversations""",
    "d_comments": """
select concat('d',d.doc_id) id, concat('t3_',d.source) link_id, concat('t3_',d.source) parent_id,
  concat('a',d.doc_id%97) author, d.source subreddit, 1704067200+d.doc_id*37 created_utc,
  cast(d.n_chars%41-10 as double) score, l.toxic is_hate, d.text body
from documents d left join labels l on d.doc_id=l.doc_id""",
    "e_comments": """
select cast(event_id as varchar) id, concat('t3_',cast(floor(event_id/50) as bigint)) link_id,
  case when event_id-(k%7+1)>=0 and floor((event_id-(k%7+1))/50)=floor(event_id/50)
       then concat('t1_',event_id-(k%7+1))
       else concat('t3_',cast(floor(event_id/50) as bigint)) end parent_id,
  concat('u',user_id) author, event_type subreddit, us, cast(floor(us/1000000) as bigint) created_utc,
  value score, cast(k%10=0 as int) is_hate, cast(null as varchar) body
from (select event_id, user_id, event_type, value, epoch_us(ts) us,
        cast(json_extract_string(props,'$.k') as bigint) k from events) b""",
    # comments with the bare id of the parent comment
    "cp": "select *, case when starts_with(parent_id,'t1_') then substr(parent_id,4) end pid from c_comments",
    "ep": "select *, case when starts_with(parent_id,'t1_') then substr(parent_id,4) end pid from e_comments",
    "lexicon": """
select * from (values ('thenon','hate'),('wither','hate'),('hehely','hate'),
  ('ouelle','offensive'),('andthe','offensive'),('tionand','context')) l(term,tier)""",
}

# Harmless words in place of a real lexicon.
LEXICON = {
    "hate": ["thenon", "wither", "hehely"],
    "offensive": ["ouelle", "andthe"],
    "context": ["tionand"],
}


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(t, tier) for tier, terms in LEXICON.items() for t in terms]
    return spark.createDataFrame(rows, "term string, tier string")
