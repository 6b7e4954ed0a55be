"""Sources and sinks of panels: landed tables, CSV and Parquet files, manifests, run ledgers.

Panels are long: one row for each date and asset (or series). Wide shapes appear only in reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_SCHEMA = "date date, open double, high double, low double, close double, adj_close double, volume bigint"
MACRO_SCHEMA = "date date, value double"


def landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def proxy_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, asset, price: mean unit price by return flag and shipping day, from exact sums."""
    line = landed(spark, sf_dir, "lineitem")
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return line.groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("asset")).agg((money("l_extendedprice") / money("l_quantity")).alias("price"))


def proxy_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, series_id, value: mean order total by priority and order day; a gappy panel."""
    orders = landed(spark, sf_dir, "orders")
    mean = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))
    return orders.groupBy(F.to_date("o_orderdate").alias("date"), F.substring("o_orderpriority", 1, 1).alias("series_id")).agg((mean / 10000).alias("value"))


def read_prices_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files, one for each asset, named ``prices_<ASSET>.csv`` (or folders asset=<ASSET>); a missing path raises."""
    rows = spark.read.schema(PRICE_SCHEMA).option("header", True).csv(path)
    name = F.input_file_name()
    asset = F.coalesce(F.nullif(F.regexp_extract(name, r"prices_([^/]+)\.csv", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"asset=([^/]+)/", 1), F.lit("")))
    return rows.withColumn("asset", asset).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("open", "high", "low", "close", "adj_close")})


def write_by(df: DataFrame, path: str, *keys: str, fmt: str = "parquet") -> None:
    """One folder for each key: later readers prune to the keys they ask for."""
    df.write.mode("overwrite").partitionBy(*keys).format(fmt).option("header", True).save(path)


def describe(df: DataFrame, key: str, value: str) -> DataFrame:
    """Metadata of each key: rows, first and last date, missing values."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum(F.col(value).isNull().cast("long")).alias("missing"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of every file below a folder, digested where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per path: match, differs, missing or unexpected."""
    e, a = expected.select("path", F.col("sha256").alias("want")), actual.select("path", F.col("sha256").alias("have"))
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") == F.col("have"), "match").otherwise("differs")
    return e.join(a, "path", "full").select("path", status.alias("status"))


def pending(specifications: DataFrame, done: DataFrame, key: str = "specification") -> DataFrame:
    """The specifications a ledger hasn't yet: a resumed run does just these."""
    return specifications.join(done.select(key).distinct(), key, "left_anti")


def coverage(df: DataFrame, key: str) -> DataFrame:
    """rows, first_key, last_key and columns of a table, for its manifest."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def environment_hash(files: DataFrame, config: str) -> str:
    """A prefix of the digest of a manifest's digests and a configuration, by which results can be kept."""
    names = F.array_sort(F.collect_list(F.concat_ws("=", F.regexp_extract("path", "([^/]+)$", 1), "sha256")))  # one entry for each file of a snapshot
    return files.agg(F.substring(F.sha2(F.concat_ws("\n", names, F.lit(config)), 256), 1, 16)).first()[0]


def record(done: DataFrame, path: str) -> None:
    """Appends finished specifications to a ledger, which ``pending`` is read against."""
    done.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)
