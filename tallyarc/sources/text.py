"""Line-based sources: delimited tables, FASTA, FASTQ, GTF, SAM, junction files, caller logs, key = value records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyarc.functions.binding import let
from tallyarc.operators.contracts import guarded
from tallyarc.operators.scan import last_seen

# Spellings of a missing cell.
MISSING = ["", "NA", "NaN", "nan", "null", "None"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): line numbers from 0 per file, without a sort and without collecting.

    A split's own counts give each split its first number; splits are small in number.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    spans = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # A row for each split: broadcast, so no line is shuffled to get its number.
    return lines.join(F.broadcast(starts), ["file", "_block"]).select("file", (F.col("_id") - F.col("_first") + F.col("_start")).alias("line_no"), "value")


def read_table(spark: SparkSession, path: str, schema: str, numeric: Sequence[str] = (), sep: str = "\t") -> DataFrame:
    """Delimited scan: missing spellings become null, True/False boolean, listed columns numeric."""
    names = T.StructType.fromDDL(schema).fieldNames()
    raw = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path, sep=sep, header=True)
    return raw.select(*[_cell(F.col(n), n in numeric, f.dataType).alias(n) for n, f in zip(names, T.StructType.fromDDL(schema).fields)])


def _cell(column: Column, numeric: bool, kind: T.DataType) -> Column:
    value = F.when(~column.isin(MISSING), column)
    if isinstance(kind, T.BooleanType):
        return F.when(value == "True", True).when(value == "False", False)
    return value.cast(kind) if numeric else value


def fasta(spark: SparkSession, path: str, alphabet: str | None = None) -> DataFrame:
    """(id, header, sequence); a repeated id, an empty sequence or a letter outside ``alphabet`` fails."""
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("r")).where("trim(r) <> ''")
    head = F.regexp_extract("r", r"^([^\n]*)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"\s", ""))
    rows = records.select(F.split(head, r"[|\s]").getItem(0).alias("id"), head.alias("header"), body.alias("sequence"))
    bad = F.col("sequence") == ""
    if alphabet:
        bad = bad | F.col("sequence").rlike(f"[^{alphabet}]")
    checked = rows.withColumn("sequence", guarded(F.col("sequence"), bad, "empty or invalid sequence"))
    grouped = checked.groupBy("id").agg(F.count("*").alias("n"), F.first("header").alias("header"), F.first("sequence").alias("sequence"))
    return grouped.select(guarded(F.col("id"), F.col("n") > 1, "duplicate sequence id").alias("id"), "header", "sequence")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, header, sequence, quality) from strict four-line records."""
    lines = numbered_lines(spark, path).withColumns({"record": F.floor(F.col("line_no") / 4), "part": F.col("line_no") % 4})
    part = lambda i: F.max(F.when(F.col("part") == i, F.col("value")))
    rows = lines.groupBy("file", "record").agg(part(0).alias("h"), part(1).alias("sequence"), part(2).alias("plus"), part(3).alias("quality"))
    bad = (F.col("quality").isNull() | ~F.col("h").startswith("@") | ~F.col("plus").startswith("+")
           | (F.length("sequence") != F.length("quality")) | F.col("sequence").rlike("[^ACGTN]") | F.col("quality").rlike("[^!-~]"))
    return rows.select("file", "record", guarded(F.expr("substring(h, 2)"), bad, "malformed FASTQ record").alias("header"), "sequence", "quality")


def attributes(column: Column) -> Column:
    """key "value"; pairs of a GTF attribute field as a map; the last value of a repeated key wins."""
    pattern = F.lit(r'(\w+)\s+"?([^";]+)"?;')

    def last_of_each(v):
        pairs = F.zip_with(v["keys"], v["values"], lambda k, x: F.struct(k.alias("k"), F.trim(x).alias("v")))
        kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(v["keys"], i + 2, F.size(v["keys"])), lambda k: k == p["k"]))
        return F.map_from_entries(kept)

    return let(last_of_each, keys=F.regexp_extract_all(column, pattern, 1), values=F.regexp_extract_all(column, pattern, 2))


def gtf(spark: SparkSession, path: str, features: Sequence[str], genes: DataFrame | None = None) -> DataFrame:
    """Annotation rows with an attribute map; feature and gene lists are applied during the scan."""
    schema = "chrom string, source string, feature string, start long, end long, score string, strand string, phase string, attr string"
    rows = spark.read.schema(schema).csv(path, sep="\t", comment="#", quote="").where(F.col("feature").isin(list(features)))
    rows = rows.withColumn("attributes", attributes(F.col("attr"))).drop("attr", "source", "score")
    rows = rows.withColumn("gene_id", F.try_element_at("attributes", F.lit("gene_id")))
    return rows.join(genes, "gene_id", "left_semi") if genes is not None else rows


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows with a tag map; headers and unmapped records are dropped."""
    f = F.split("value", "\t")
    tags = F.transform(F.slice(f, 12, F.greatest(F.lit(0), F.size(f) - 11)), lambda t: F.struct(
        F.substring_index(t, ":", 1).alias("k"), F.regexp_replace(t, "^[^:]*:[^:]*:", "").alias("v")))
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(
        f[0].alias("read_id"), f[1].cast("int").alias("flag"), f[2].alias("target"), (f[3].cast("long") - 1).alias("start"),
        f[4].cast("int").alias("mapq"), f[5].alias("cigar"), F.map_from_entries(tags).alias("tags"))
    return rows.where(F.col("flag").bitwiseAND(4) == 0).withColumn("strand", F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+"))


def junction_rows(spark: SparkSession, path: str) -> DataFrame:
    """Split junction rows; comments, short rows and encompassing pairs (type below 0) are skipped."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.size(f) >= 10)
    out = rows.select(f[0].alias("chrom1"), f[1].try_cast("long").alias("donor"), f[2].alias("strand1"), f[3].alias("chrom2"),
                      f[4].try_cast("long").alias("acceptor"), f[5].alias("strand2"), f[6].try_cast("int").alias("type"), f[9].alias("read_id"))
    return out.where("type >= 0 AND donor IS NOT NULL AND acceptor IS NOT NULL")


def caller_log(spark: SparkSession, path: str) -> DataFrame:
    """(pair, read_id): member lines belong to the latest header line above them; a summary line ends a group."""
    lines = numbered_lines(spark, path)
    mark = F.when(F.col("value").startswith("GF\t"), F.split("value", "\t")[1]).when(F.col("value").startswith("SumGF"), F.lit(""))
    tagged = last_seen(lines, [F.col("line_no")], mark, "pair", partition=["file"])
    members = tagged.where(F.col("pair").isNotNull() & (F.col("pair") != "") & ~F.col("value").rlike("^(GF\t|SumGF)"))
    ids = F.regexp_extract_all("value", F.lit(r"/([^()]+):\d+-\d+\)"), 1)
    return members.select("pair", F.explode(ids).alias("read_id")).distinct()


def key_values(lines: DataFrame, record: str) -> DataFrame:
    """(record, key, value, repeats) from ``key = value`` lines; ``repeats`` counts the key in its record."""
    split = F.split("value", " = ", 2)
    rows = lines.where(F.contains("value", F.lit(" = "))).select(record, F.trim(split[0]).alias("key"), F.trim(split[1]).alias("value"))
    counts = rows.groupBy(record, "key").agg(F.count("*").alias("repeats"))
    return rows.join(counts, [record, "key"])


def one(pairs: DataFrame, record: str, key: str) -> DataFrame:
    """The single value of a key per record; a repeated key fails."""
    value = guarded(F.col("value"), F.col("repeats") != 1, f"{key} must occur exactly once")
    return pairs.where(F.col("key") == key).select(record, value.alias(key))
