"""Sources of many files: Atom feeds, digests of files, and files of unlike columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATOM = "id string, title string, summary string, published string, updated string, author array<struct<name: string>>, _corrupt_record string"


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """source_id, title, summary, published, updated, authors (joined by `; `), url, corrupt: a row for each entry of stored Atom
    documents. Files are split at the ends of entries, so they can be of any size, and an entry that is no XML spoils no
    other: it keeps its text in `corrupt` and has no source_id. White space is squeezed."""
    parts = spark.read.option("lineSep", "</entry>").text(path)
    entries = parts.select(F.regexp_extract(F.concat("value", F.lit("</entry>")), r"(?s)<entry[\s>].*", 0).alias("entry")).filter("entry <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreNamespace": "true"}
    rows = entries.select(F.from_xml("entry", ATOM, options).alias("x")).select("x.*")

    def squeezed(c: str):
        return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")).alias(c)

    last = F.regexp_extract(F.coalesce("id", F.lit("")), r"([^/]*)/?$", 1)
    authors = F.array_join(F.transform(F.coalesce("author", F.array().cast("array<struct<name: string>>")), lambda a: F.trim(a["name"])), "; ")
    return rows.select(
        F.when(F.col("_corrupt_record").isNull(), last).alias("source_id"), squeezed("title"), squeezed("summary"), "published", "updated",
        authors.alias("authors"), F.col("id").alias("url"), F.col("_corrupt_record").alias("corrupt"),
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """file, length, sha256 of each file: names are relative to the last folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "path", "length", F.sha2("content", 256).alias("sha256"))


def id_lists(rows: DataFrame, key: str, *names: str, most: int = 1_000_000) -> DataFrame:
    """names, n_ids, sha256 of the sorted distinct ids joined by newlines, for each value of names. A list is hashed whole, so one
    of more than `most` ids is refused; id_manifest() hashes those as a tree."""
    ids = rows.select(*names, F.col(key).cast("string").alias("id")).filter("id IS NOT NULL").distinct()
    few = ids.join(ids.groupBy(*names).agg(F.count("*").alias("n_ids")), list(names)) if names else ids.join(ids.agg(F.count("*").alias("n_ids")), F.lit(True))
    told = F.raise_error(F.concat(F.lit("too many ids for one list: "), F.col("n_ids").cast("string"))).cast("string")
    few = few.withColumn("id", F.when(F.col("n_ids") <= most, F.col("id")).otherwise(told))
    return few.groupBy(*names, "n_ids").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("sha256"))


def read_many(spark: SparkSession, pattern: str, form: str = "json", source: str = "collector_file", keys: dict[str, str] | None = None) -> DataFrame:
    """All files of a glob pattern with the columns of any of them, the name of a row's file, and keys taken from its path, each by
    the first group of a pattern. A column that a file lacks is null. CSV files are read by their own headers."""
    if form == "csv":
        names = [r[0] for r in spark.read.format("binaryFile").load(pattern).select("path").orderBy("path").collect()]  # a collector's files, some dozens
        parts = [spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(n).withColumn("at_path", F.col("_metadata.file_path")) for n in names]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part, allowMissingColumns=True)
    else:
        rows = spark.read.format(form).option("mergeSchema", True).load(pattern).select("*", F.col("_metadata.file_path").alias("at_path"))
    taken = {k: F.regexp_extract("at_path", p, 1) for k, p in (keys or {}).items()}
    return rows.withColumns({**taken, source: F.regexp_extract("at_path", r"([^/]*)$", 1)}).drop("at_path")
