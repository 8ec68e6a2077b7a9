"""Raw files: CSV with replaced headers, block-structured pattern text, and the tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import range_ends, range_number

TRANSACTION_COLUMNS = ("timestamp", "from_bank", "from_account", "to_bank", "to_account", "amount_received", "receiving_currency", "amount_paid", "payment_currency", "payment_format", "is_laundering")
ACCOUNT_COLUMNS = ("bank_name", "bank_id", "account_number", "entity_id", "entity_name")


def existing(spark: SparkSession, path: str) -> str:
    """The path itself, or with `.gz` where only the compressed file is there."""
    jvm = spark._jvm
    for name in (path, path + ".gz"):
        p = jvm.org.apache.hadoop.fs.Path(name)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return name
    raise FileNotFoundError(path)


def read_csv_as_text(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Every column a string under our own names; the file's header (which may name two columns alike) is skipped."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(existing(spark, path))


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_as_text(spark, path, TRANSACTION_COLUMNS)


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_as_text(spark, path, ACCOUNT_COLUMNS)


def parse_patterns(lines: DataFrame, ranges: int | None = None) -> DataFrame:
    """(pattern_id, pattern_type, transaction columns) from numbered lines (pos, line).

    A BEGIN line opens the next block and names its type, up to a colon; an END line closes it; other lines count inside a block only; blank lines don't.
    Lines are read in ranges of pos: each range counts its BEGIN lines and keeps its last mark, which is carried into the ranges after it, so a block may
    run over any number of ranges and no task meets all lines. Runs one job for the ranges' ends when called.
    """
    begin = F.col("line").rlike("^BEGIN LAUNDERING ATTEMPT")
    end = F.col("line").rlike("^END LAUNDERING ATTEMPT")
    marked = lines.select("pos", F.rtrim("line").alias("line")).filter("line <> ''")
    marked = marked.withColumn("opens", begin.cast("bigint")).withColumn("mark", F.when(begin, F.regexp_extract("line", r"^BEGIN LAUNDERING ATTEMPT - ([^:]*)", 1)).when(end, ""))
    marked = marked.withColumn("range", range_number([F.col("pos")], range_ends(lines, [F.col("pos")], ranges), ["bigint"]))
    each = marked.groupBy("range").agg(F.sum("opens").alias("opens"), F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("pos"))).alias("mark"))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = each.select("range", F.coalesce(F.sum("opens").over(before), F.lit(0)).alias("earlier"), F.last("mark", ignorenulls=True).over(before).alias("open"))
    w = Window.partitionBy("range").orderBy("pos")
    marked = marked.withColumn("own", F.sum("opens").over(w)).withColumn("last", F.last("mark", ignorenulls=True).over(w)).join(carried, "range")
    marked = marked.withColumn("pattern_id", F.col("earlier") + F.col("own")).withColumn("pattern_type", F.trim(F.coalesce("last", "open")))
    inside = marked.filter(F.col("mark").isNull() & (F.col("pattern_type") != "")).withColumn("cell", F.split("line", ","))
    return inside.select("pattern_id", "pattern_type", *[F.col("cell")[k].alias(c) for k, c in enumerate(TRANSACTION_COLUMNS)])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a text file of any size, read in splits; pos rises with the file's order but has gaps.

    A split's number stands in the upper bits, the line's number within it in the lower ones: the order in which Spark lists the splits of one file
    is not that of their offsets, so the split's first byte is used.
    """
    lines = spark.read.text(existing(spark, path)).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    return lines.select((F.shiftleft(F.col("start"), 20) + F.row_number().over(Window.partitionBy("start").orderBy("id"))).alias("pos"), "line")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """The pattern file, whose blocks may be cut anywhere by the splits it is read in (a gzip file is one split)."""
    return parse_patterns(read_lines(spark, path))


def load_raw(spark: SparkSession, folder: str, dataset: str = "hi") -> dict[str, DataFrame]:
    """The three raw tables of a dataset (`hi` or `li`) from a folder of its published files."""
    name = {"hi": "HI-Small", "li": "LI-Small"}[dataset]
    return {
        "transactions": read_transactions(spark, f"{folder}/{name}_Trans.csv"),
        "accounts": read_accounts(spark, f"{folder}/{name}_accounts.csv"),
        "patterns": read_patterns(spark, f"{folder}/{name}_Patterns.txt"),
    }
