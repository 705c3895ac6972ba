"""Reading and writing: newline JSON, CSV, Parquet, reports, score cache, vectors."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut_lineage, remove

CORRUPT = "_corrupt_record"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def _as_text(kind: T.DataType) -> T.DataType:
    """The same shape with every scalar as text."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_text(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(T.StringType(), _as_text(kind.valueType))
    return T.StringType()


def _typed(c: Column, kind: T.DataType) -> Column:
    """Text back in its type; what does not fit becomes null, whole numbers may be written as 1.0."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_typed(c[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _typed(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: _typed(x, kind.valueType))
    if isinstance(kind, T.IntegralType):
        return F.coalesce(c.try_cast(kind), c.try_cast("double").try_cast(kind))
    return c if isinstance(kind, T.StringType) else c.try_cast(kind)


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType, max_rows: int | None = None) -> DataFrame:
    """Newline JSON, plain or compressed (gz, bz2, zst by file ending).

    Only lines that are no JSON object are skipped; a value that does not fit its column (``"n/a"`` for a number)
    becomes null, one that does in another dress (``"17"``, ``17.0``) is read.  Bytes that are no UTF-8 are left out.
    """
    lines = spark.read.text(path).where(F.startswith(F.ltrim("value"), F.lit("{")))
    text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(
        F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")))
    parsed = lines.select(F.from_json(text, _with_corrupt(_as_text(schema)), {"columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    good = parsed.where(F.col(f"r.{CORRUPT}").isNull())
    out = good.select(*[_typed(F.col("r")[f.name], f.dataType).alias(f.name) for f in schema])
    return out if max_rows is None else out.limit(max_rows)


def read_parquet_glob(
    spark: SparkSession, folder: str, pattern: str = "*.parquet", fallback: str | None = None,
    schema: T.StructType | None = None, skip_corrupt: bool = False,
) -> DataFrame:
    """All part files whose name fits the pattern.

    An unreadable file is an error; with ``skip_corrupt`` it is left out, and :func:`unreadable_parts` names it.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def holds_files(where: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(f"{where.rstrip('/')}/{pattern}")
        found = path.getFileSystem(conf).globStatus(path)
        return found is not None and len(found) > 0

    where = folder if fallback is None or holds_files(folder) else fallback
    reader = spark.read.option("pathGlobFilter", pattern).option("ignoreCorruptFiles", skip_corrupt)
    return (reader if schema is None else reader.schema(schema)).parquet(where)


def unreadable_parts(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """``path`` of the part files that are no complete Parquet files: their last four bytes are not the format's mark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.where(F.coalesce(F.expr("right(cast(content as string), 4) <> 'PAR1'"), F.lit(True)) | (F.col("length") < 12)).select("path")


# Encodings that Spark's CSV reader takes; others must have one byte per character.
SPARK_ENCODINGS = ("UTF-8", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32", "US-ASCII", "ISO-8859-1")


def _known(name: str) -> str:
    upper = name.upper().replace("_", "-").replace("UTF8", "UTF-8").replace("LATIN-1", "ISO-8859-1").replace("LATIN1", "ISO-8859-1")
    return upper if upper in SPARK_ENCODINGS else name


def _high_half(name: str) -> str:
    """The characters of bytes 128-255 in a one-byte encoding, from its codec."""
    return bytes(range(128, 256)).decode(name, errors="replace")


def _raw_lines(spark: SparkSession, path) -> DataFrame:
    # ISO-8859-1 keeps each byte as one character, so the bytes can be tried again in any encoding
    return (
        spark.read.option("encoding", "ISO-8859-1").option("header", False)
        .option("sep", "\u0001").option("quote", "").schema("line string").csv(path)
    )


def best_encoding(spark: SparkSession, path: str, encodings: Sequence[str]) -> str:
    """The first encoding that decodes every line, else the one with the fewest bad lines; one job."""
    def bad(name: str) -> Column:
        if _known(name) == "UTF-8":
            ok = F.is_valid_utf8(F.encode("line", "ISO-8859-1").cast("string"))
            return F.sum(F.when(ok, 0).otherwise(1))
        if _known(name) in SPARK_ENCODINGS:
            return F.sum(F.lit(0))  # taken as they are
        gaps = "".join(chr(128 + i) for i, c in enumerate(_high_half(name)) if c == "\ufffd")
        return F.sum(F.when(F.translate("line", gaps, "") != F.col("line"), 1).otherwise(0)) if gaps else F.sum(F.lit(0))

    counts = _raw_lines(spark, path).agg(*[bad(n).alias(f"b{i}") for i, n in enumerate(encodings)]).first()
    return min(enumerate(encodings), key=lambda e: (counts[e[0]] or 0, e[0]))[1]


def _unquoted(line: Column, escape: str) -> Column:
    """Fields of a line without quoting: an escaped character is always part of the field."""
    e = re.escape(escape)
    fields = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(rf"((?:[^,{e}]|{e}.)*),"), F.lit(1))
    return F.transform(fields, lambda f: F.regexp_replace(f, rf"{e}(.)", "$1"))


def _line_ends(line: Column, quote: str, escape: str) -> Column:
    """``(o, i)``: 1 if a quoted field is open after the line, when none (``o``) or one (``i``) was open before it."""
    plain = line if escape == quote else F.regexp_replace(line, f"{re.escape(escape)}[{re.escape(escape + quote)}]", "xx")
    parts = F.split(plain, re.escape(quote))  # a quote stands between two parts

    def run(open_before: int) -> Column:
        # state: 0 outside, 1 inside, 2 just behind a quote that closes; ``p`` is the part before the next quote
        first = F.struct(F.lit(open_before).alias("s"), F.get(parts, 0).alias("p"), F.lit(True).alias("start"))

        def step(a: Column, part: Column) -> Column:
            opens = F.endswith(a["p"], F.lit(",")) | (a["start"] & (a["p"] == ""))
            again = (a["s"] == 2) & (a["p"] == "")  # a doubled quote: still inside
            state = F.when(a["s"] == 1, 2).when(again | opens, 1).otherwise(0)
            return F.struct(state.alias("s"), part.alias("p"), F.lit(False).alias("start"))

        return F.aggregate(F.slice(parts, 2, F.size(parts)), first, step, lambda a: F.when(a["s"] == 1, 1).otherwise(0))

    has = F.contains(line, F.lit(quote))
    return F.struct(F.when(has, run(0)).otherwise(0).alias("o"), F.when(has, run(1)).otherwise(1).alias("i"))


def _entering(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Compose the maps ``e`` along the order: ``_fixed`` is the state before a row where it is known whatever the first
    state was, else the first state is changed if ``_flip`` is 1."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum(F.when((F.col("e.o") == 1) & (F.col("e.i") == 0), 1).otherwise(0)).over(w), F.lit(0))
    rows = rows.withColumn("_s", swaps)
    rows = rows.withColumn("_k", F.last(F.when(F.col("e.o") == F.col("e.i"), F.struct(F.col("e.o").alias("v"), F.col("_s").alias("s"))), True).over(w))
    return rows.withColumns({"_fixed": (F.col("_k.v") + F.col("_s") - F.col("_k.s")) % 2, "_flip": F.col("_s") % 2}).drop("_s", "_k")


def _entered(first: Column) -> Column:
    return F.coalesce("_fixed", (first + F.col("_flip")) % 2)


def csv_records(spark: SparkSession, files: Sequence[str], encoding: str = "UTF-8", quote: str = '"', escape: str = '"') -> DataFrame:
    """``record``: the records of CSV files without their first ones, line breaks inside quotes kept; a file is many tasks.

    A line maps "a quoted field is open" before it to the same after it.  The maps of a scan block's lines are composed to
    one, those of a file's blocks in order tell how each block begins, and with that every line knows whether a record
    begins at it.  Lines are shuffled once, by block; only records of several lines are put together in a second step.
    A quote that is never closed swallows the rest of its file, as in every reader.
    """
    raw = spark.read.option("lineSep", "\n").text(list(files)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("n"))
    text = F.make_valid_utf8("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    lines = raw.select("file", "at", "n", F.regexp_replace(text, "^\ufeff|\r$", "").alias("line"))
    lines = lines.withColumn("e", _line_ends(F.col("line"), quote, escape))
    marks = _entering(lines.where("e.o <> 0 or e.i <> 1").select("file", "at", "n", "e"), ["file", "at"], "n")
    after = lambda before: F.when(before == 0, F.col("e.o")).otherwise(F.col("e.i"))
    opened = lambda before: F.max(F.when((_entered(before) == 0) & (F.col("e.o") == 1), F.struct("at", "n")))
    per_block = marks.groupBy("file", "at").agg(
        F.max_by(F.struct(after(_entered(F.lit(0))).alias("o"), after(_entered(F.lit(1))).alias("i")), "n").alias("e"),
        opened(F.lit(0)).alias("opens_o"), opened(F.lit(1)).alias("opens_i"))
    # one row per scan block
    blocks = lines.groupBy("file", "at").agg(F.count("*").alias("_n")).drop("_n").join(per_block, ["file", "at"], "left")
    blocks = blocks.withColumn("e", F.coalesce("e", F.struct(F.lit(0).alias("o"), F.lit(1).alias("i"))))
    blocks = _entering(blocks, ["file"], "at").withColumn("begins", _entered(F.lit(0))).drop("_fixed", "_flip", "e")
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("begins") == 0, F.col("opens_o")).otherwise(F.col("opens_i"))
    blocks = blocks.select("file", "at", "begins", F.last(own, True).over(earlier).alias("carried"))

    placed = _entering(lines, ["file", "at"], "n").join(blocks, ["file", "at"])
    up_to = Window.partitionBy("file", "at").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("inside", _entered(F.col("begins")))
    opener = F.last(F.when((F.col("inside") == 0) & (F.col("e.o") == 1), F.struct("at", "n")), True).over(up_to)
    placed = placed.select(
        "file", "at", "n", "line", F.when((F.col("inside") == 1) | (F.col("e.o") == 1), F.coalesce(opener, "carried")).alias("opener"),
        ((F.col("at") == 0) & (F.row_number().over(Window.partitionBy("file", "at").orderBy("n")) == 1)).alias("head"))
    single = placed.where("opener is null and not head").select(F.col("line").alias("record"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "n", "line"))), lambda x: x["line"]), "\n")
    several = placed.where("opener is not null").groupBy("file", "opener").agg(joined.alias("record"), F.max("head").alias("head"))
    return single.unionByName(several.where("not head").select("record")).where("record <> ''")


def read_csv_tolerant(
    spark: SparkSession, path: str, columns: Sequence[str], encodings: Sequence[str] = ("UTF-8",),
    max_rows: int | None = None, multi_line: bool = False, quote: str = '"', escape: str = '"', quoting: bool = True,
) -> DataFrame:
    """Every column as text in the given order, malformed rows skipped, missing columns null.

    Files may name their columns in different orders: each is read by its own header.  Inside quotes a quote is written
    as ``escape`` and a quote (doubled, or with a backslash); with ``quoting=False`` quotes are ordinary characters and
    ``escape`` keeps a comma in its field.  ``multi_line`` allows line breaks inside quotes; it costs a shuffle
    of the lines (see :func:`csv_records`) and is off by default.  Only UTF-16 and UTF-32 files are one task each then.  ``encodings`` may be any one-byte codec besides those Spark reads, such as cp775.
    """
    encoding = encodings[0] if len(encodings) == 1 else best_encoding(spark, path, encodings)
    own = _known(encoding) in SPARK_ENCODINGS
    read_as = _known(encoding) if own else "ISO-8859-1"

    def decoded(c: Column) -> Column:
        return c if own else F.translate(c, bytes(range(128, 256)).decode("latin-1"), _high_half(encoding))

    # one row per file: its first line
    lines = spark.read.option("encoding", read_as).option("header", False).option("sep", "\u0001").option("quote", "").schema("line string").csv(path)
    first = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "line", F.monotonically_increasing_id().alias("n")).where("at = 0")
    heads = first.groupBy("file").agg(F.min_by("line", "n").alias("head")).collect()
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(heads, key=lambda r: r["file"]):
        text = r["head"].removeprefix("\ufeff").removeprefix("\xef\xbb\xbf")
        names = next(csv.reader([text], quotechar=quote or None, escapechar=None if escape == quote else escape, quoting=csv.QUOTE_MINIMAL if quoting and quote else csv.QUOTE_NONE))
        groups.setdefault(tuple(n.strip() for n in names), []).append(r["file"])
    parts = []
    for names, files in groups.items():
        fields = [f"c{i}" for i in range(len(names))]
        at = {}
        for i, n in enumerate(names):
            at.setdefault(n.lower(), i)
        if quoting and multi_line and not read_as.startswith(("UTF-16", "UTF-32")):
            schema = _with_corrupt(T.StructType([T.StructField(n, T.StringType()) for n in fields]))
            options = {"quote": quote, "escape": escape, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
            raw = csv_records(spark, files, read_as, quote, escape).select(F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("r"))
            good = raw.where(F.col(f"r.{CORRUPT}").isNull() & F.col("r").isNotNull()).select("r.*")
        elif quoting:
            reader = spark.read.option("header", True).option("multiLine", multi_line).option("encoding", read_as).option("quote", quote).option("escape", escape)
            schema = T.StructType([T.StructField(n, T.StringType()) for n in fields])
            raw = reader.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True).csv(files)
            good = raw.where(F.col(CORRUPT).isNull())
        else:
            rows = spark.read.option("encoding", read_as).option("header", True).option("sep", "\u0001").option("quote", "").schema("line string").csv(files)
            split = rows.where("line is not null").select(_unquoted(F.col("line"), escape).alias("f")).where(F.size("f") == len(fields))
            good = split.select(*[F.nullif(F.col("f")[i], F.lit("")).alias(n) for i, n in enumerate(fields)])
        # a file with none of the columns still has rows; Spark wants one of its fields to be read for that
        none = F.lit(None).cast("string") if any(c.lower() in at for c in columns) else F.nullif(F.substring(fields[0], 1, 0), F.lit(""))
        parts.append(good.select(*[(decoded(F.col(fields[at[c.lower()]])) if c.lower() in at else none).alias(c) for c in columns]))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if max_rows is None else out.limit(max_rows)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """Parquet, one folder per split; rows of a split stay spread over the tasks that hold them."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_features_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_embeddings(df: DataFrame, path: str, rows_per_file: int = 50_000) -> None:
    """``(node_id, embedding)`` in files of at most ``rows_per_file`` vectors."""
    out = df.select("node_id", F.col("embedding").cast("array<float>").alias("embedding"))
    out.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node_id string, embedding array<float>").parquet(path)


class ScoreCache:
    """Scores kept in Parquet under ``md5(text)``, in one folder per head of the key.

    Only the folders that hold wanted keys are read, and only their wanted keys are grouped, so a fill costs what it asks
    for, not what the cache holds.  A fill adds at most a file to each of those folders; :meth:`compact` merges them.
    There are ``16 ** digits`` folders: two digits suit caches of many millions of texts, and stay with a cache for good.
    """

    SCHEMA = "key string, score double, shard string"

    def __init__(self, spark: SparkSession, path: str, digits: int = 1):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits

    def _shard(self) -> Column:
        return F.concat(F.lit("k"), F.substring("key", 1, self.digits))  # a letter keeps 1e2 from being read as a number

    def _generation(self) -> int | None:
        """The newest complete generation: compaction writes a new one, which counts once it is marked as done."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/generation=*/_SUCCESS")
        found = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
        return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found or ()), default=None)

    def _rows(self, shards: Sequence[str] | None = None) -> DataFrame:
        g = self._generation()
        if g is None:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/generation={g}")
        return rows if shards is None else rows.where(F.col("shard").isin(list(shards)))

    def _write(self, scores: DataFrame, generation: int, mode: str) -> None:
        # one task per folder; sorted, so that a scan for some keys skips row groups
        rows = scores.select("key", "score").withColumn("shard", self._shard())
        rows = rows.repartition("shard").sortWithinPartitions("shard", "key")
        rows.write.mode(mode).partitionBy("shard").parquet(f"{self.path}/generation={generation}")

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        # two writers may have stored one text; any of the equal-key rows will do
        return rows.groupBy("key").agg(F.max("score").alias("score"))

    def read(self) -> DataFrame:
        return self._merged(self._rows())

    def compact(self) -> None:
        """One file and one row per key in each folder.

        The old generation is removed when the new one is complete, so a run that dies leaves the cache as it was; scores
        that another run adds meanwhile may be lost and are then worked out again.
        """
        old = self._generation()
        if old is not None:
            self._write(self.read(), old + 1, "overwrite")
            remove(self.spark, f"{self.path}/generation={old}")

    def fill(self, texts: DataFrame, score: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
        """Score the texts the cache does not know and store them; returns the scores of the given texts.

        A null or NaN score is a failure and is not stored, so the text is tried again next time.
        """
        wanted = texts.where(F.col(text).isNotNull()).select(F.md5(text).alias("key"), F.col(text).alias("text"))
        keys = cut_lineage(wanted.select("key").distinct())
        shards = [r[0] for r in keys.select(self._shard()).distinct().collect()]  # at most 16 ** digits
        missing = keys.join(self._rows(shards), "key", "left_anti")
        misses = wanted.join(missing, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
        scored = score(misses).where(F.col("score").isNotNull() & ~F.isnan("score"))
        self._write(scored, self._generation() or 0, "append")
        return self._merged(self._rows(shards).join(keys, "key", "left_semi"))
