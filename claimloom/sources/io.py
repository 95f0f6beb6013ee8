"""Readers with stated schemas, sinks, and the latest-wins score cache. YAML and .env files are driver-side."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALIASES = {
    "sample_id": ("sample_id", "raw_sample_id", "id"),
    "question": ("question", "prompt"),
    "answer": ("answer", "qwen_answer", "response"),
    "retrieved_context": ("retrieved_context", "context"),
    "ground_truth": ("ground_truth", "reference_answer", "expected_answer"),
    "document_status": ("document_status",),
}


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Blank lines are skipped."""
    return spark.read.schema(schema).json(path).dropna("all")


def read_csv(spark: SparkSession, path: str, schema, keep_blank: bool = False, source_column: str | None = None) -> DataFrame:
    """Quoted, multi-line CSV with a header. keep_blank: missing text is '' and not null."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if source_column:
        df = df.withColumn(source_column, F.input_file_name())
    return df.na.fill("") if keep_blank else df


def read_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """By suffix: .csv, .parquet, else JSON lines; normalised."""
    read = read_csv if path.endswith(".csv") else (lambda s, p, _: s.read.parquet(p)) if path.endswith(".parquet") else read_jsonl
    return normalised(read(spark, path, schema))


def head(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in the order, missing numbers as 0; found without a full sort."""
    return df.orderBy(*order).limit(n).na.fill(0)


def normalised(df: DataFrame) -> DataFrame:
    """The usual column of each alias group, whichever name is there; NaN becomes null."""
    have = set(df.columns)
    out = {c: next((n for n in names if n in have), None) for c, names in ALIASES.items()}
    named = {n for n in out.values() if n}
    doubles = {c for c, t in df.dtypes if t in ("double", "float")}
    rest = [F.nanvl(F.col(c), F.lit(None)).alias(c) if c in doubles else F.col(c) for c in df.columns if c not in named]
    return df.select(*(F.col(n).alias(c) for c, n in out.items() if n), *rest)


def read_yaml(path: str) -> dict:
    import yaml  # optional

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def load_env(path: str) -> None:
    """KEY=value lines; what is set already stays."""
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, eq, value = line.strip().partition("=")
        if eq and not key.startswith("#"):
            os.environ.setdefault(key.strip(), value.strip().strip("'\""))


def joined_lists(df: DataFrame) -> DataFrame:
    """Arrays of strings as `;`-joined text, for CSV."""
    return df.select(*(F.array_join(c, ";").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    joined_lists(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(df: DataFrame, path: str) -> None:
    """Each row as one JSON document of text."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def cache_key(method: Column, question: Column, answer: Column, context: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (method, question, answer, context)]
    return F.substring(F.sha2(F.concat_ws("||", *parts), 256), 1, 16)


def latest(cache: DataFrame, key: str, order: str) -> DataFrame:
    """The last entry of each key."""
    rest = [c for c in cache.columns if c not in (key, order)]
    last = cache.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("last_row"))
    return last.select(*(F.col(c) if c == key else F.col(f"last_row.{c}").alias(c) for c in cache.columns))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def id_manifest(rows: DataFrame, key: str, *names: str) -> DataFrame:
    """Number and SHA-256 of the distinct ids, for each value of `names` if any. Ids are hashed in a tree by the first
    hexadecimal digits of their MD5: sorted ids below each prefix of six digits, then the hashes of prefixes below each of
    three, then those. So 10^10 ids are some 600 a leaf, and no array holds more than 4,096 hashes."""
    ids = rows.select(*names, F.col(key).cast("string").alias("id")).distinct().withColumn("at", F.substring(F.md5("id"), 1, 6))
    each = ids.groupBy(*names, "at").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("h"))
    for digits in (3, 0):
        at = F.substring("at", 1, digits) if digits else F.lit("")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "\n")
        each = each.groupBy(*names, at.alias("up")).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("h")).withColumnRenamed("up", "at")
    return each.select(*names, F.col("n").alias("n_ids"), F.col("h").alias("sha256"))
