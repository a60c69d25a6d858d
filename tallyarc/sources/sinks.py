"""Create-only sinks, content manifests and paged nested documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyarc.functions.sequence import fasta_wrap

PAGE = 1000


def write_tsv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("error").csv(path, sep="\t", header=True, compression="gzip" if gzip else "none", nullValue="", emptyValue="")


def write_fasta(df: DataFrame, path: str, key: str, sequence: str) -> None:
    df.select(F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), fasta_wrap(F.col(sequence)))).write.mode("error").text(path)


def write_lines(df: DataFrame, path: str, column) -> None:
    df.select(column.alias("value")).write.mode("error").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of every file; whole small files, one row each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_mismatches(frozen: DataFrame, found: DataFrame) -> DataFrame:
    """Files that are missing, new or changed against the frozen manifest."""
    return frozen.join(found, ["name", "bytes", "sha256"], "left_anti").select("name", F.lit("missing_or_changed").alias("problem")).unionByName(
        found.join(frozen, "name", "left_anti").select("name", F.lit("unexpected").alias("problem")))


def nested_pages(parents: DataFrame, children: DataFrame, key: str, columns: Sequence[str], name: str) -> DataFrame:
    """Parents with child lists in pages of about ``PAGE`` entries: a hot parent becomes several documents."""
    size = children.groupBy(key).agg(F.ceil(F.count("*") / PAGE).cast("int").alias("_pages"))
    body = F.struct(*columns)
    paged = children.join(size, key).withColumn("page", F.pmod(F.xxhash64(*columns), F.col("_pages")).cast("int"))
    lists = paged.groupBy(key, "page").agg(F.array_sort(F.collect_list(body)).alias(name), F.first("_pages").alias("pages"))
    return parents.join(lists, key, "left")


def extract_records(source: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Source rows of a read-id set; an id without a row fails the job."""
    ids = wanted.select(key).distinct()
    lost = ids.join(source.select(key), key, "left_anti").agg(F.count("*").alias("n"))
    found = source.join(ids, key, "left_semi")
    return found.withColumn(key, F.when(lost.scalar() > 0, F.raise_error(F.lit("wanted records are missing"))).otherwise(F.col(key)))
