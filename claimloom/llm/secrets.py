"""Secret scan with corpus-wide ownership frequency. Native: DataFrame expressions only.

Base kinds (assign, access, hex) are found by pattern. Every found value, and every opaque mixed-case token
of 32 or more characters, is a candidate; candidates are hashed and counted by distinct repositories
(`source`) and owners (documents). A value in many repositories, or in many documents of few, is a copied
example; one that few own looks live. The method adds spans: `live` or `example` over each candidate's value, and `opaque` over live opaque
tokens. Base spans always stay.

Offsets: the lengths of the parts that split() leaves and of the matches sum up to every match's start, in code points and
in bytes, so no Python is needed. The sums are windows over the matches of a text, each a row of its own, so the
work is linear in a text's matches. A masked text is put together once, from the bytes between its masks.

Defined cases: null text counts as empty; a null source or doc_id counts as one repository or owner of that
name; repeated rows are scanned each on its own; ties in start go by kind; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import between, free, row_key, saved, table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "opaque", "live", "example")
#: kind number, pattern, group of the value, shortest value, further test on the value
_SCANS = (
    (0, ASSIGN, 2, 6, None),
    (1, "AKIA[A-Z0-9]+", 0, 20, None),
    (2, "[0-9a-f]+", 0, 24, None),
    (3, "[A-Za-z0-9+/_=-]{32,}", 0, 32, lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")),
)
#: runs that are too short are dropped, so only long ones need be matched; a shorter run has no long one inside
_FAST = {1: "AKIA[A-Z0-9]{16,}", 2: "[0-9a-f]{24,}"}
_PART = "array<struct<kind:int,step:bigint,n:bigint,nv:bigint,bstep:bigint,bn:bigint,value:bigint,good:boolean>>"


def _matches(text: Column, kind: int, pattern: str, group: int, least: int, test) -> Column:
    """The matches of a kind in their order: step is how far a match's end lies behind the end of the one before it, n its
    length and nv that of its value, in code points; bstep and bn are bytes."""
    p = F.lit(_FAST.get(kind, pattern))
    hits, parts = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, _FAST.get(kind, pattern), -1)
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else hits
    zipped = F.arrays_zip(hits.alias("m"), F.slice(parts, 1, F.size(hits)).alias("b"), values.alias("v"))

    def one(x: Column) -> Column:
        m, before, v = x["m"], x["b"], x["v"]
        good = F.length(v) >= least
        sizes = (F.length(before) + F.length(m), F.length(m), F.length(v), F.octet_length(before) + F.octet_length(m), F.octet_length(m))
        named = [n.cast("long").alias(c) for n, c in zip(sizes, ("step", "n", "nv", "bstep", "bn"), strict=True)]
        return F.struct(F.lit(kind).alias("kind"), *named, F.xxhash64(v).alias("value"), (good & test(v) if test is not None else good).alias("good"))

    return F.transform(zipped, one)


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, key, parts: one row for each row of docs, without the text. row is only kept by writing it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(_PART)
    first = {0: "(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]", 1: "AKIA[A-Z0-9]{16}", 2: "[0-9a-f]{24}", 3: "[A-Za-z0-9+/_=-]{32}"}
    found = [F.when(text.rlike(first[s[0]]), _matches(text, *s)).otherwise(none) for s in _SCANS]
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", row_key("doc_id", "text").alias("key"), F.concat(*found).alias("parts"))


def located(found: DataFrame) -> DataFrame:
    """A row for each candidate of scanned(): row, doc_id, source, kind, value, start and end of the match and of the value in
    code points, lo and hi of the match in bytes."""
    rows = found.filter(F.size("parts") > 0).select("row", "doc_id", "source", F.posexplode("parts").alias("at", "p")).select("row", "doc_id", "source", "at", "p.*")
    order = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("step").over(order)).withColumn("hi", F.sum("bstep").over(order)).filter("good")
    start, value = F.col("end") - F.col("n"), F.col("end") - F.col("nv")
    whole = [x.cast("int").alias(c) for x, c in ((start, "start"), (F.col("end"), "end"), (value, "vstart"), (F.col("end"), "vend"), (F.col("hi") - F.col("bn"), "lo"), (F.col("hi"), "hi"))]
    return rows.select("row", "doc_id", "source", "kind", "value", *whole)


def find_candidates(docs: DataFrame) -> DataFrame:
    return located(scanned(docs))


def ownership(spans: DataFrame, copied_from: int = 3, owners_from: int = 10) -> DataFrame:
    """value, n_repositories, n_owners, copied for each candidate hash: copied if either count reaches its bound.
    Spark counts distinct names in steps of their own, so that a value that a third of all documents hold is
    pre-aggregated before each shuffle."""
    rows = spans.select(F.coalesce(F.col("source"), F.lit("")).alias("repository"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("owner"), "value")
    counted = rows.groupBy("value").agg(F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))
    return counted.withColumn("copied", (F.col("n_repositories") >= copied_from) | (F.col("n_owners") >= owners_from))


def labelled(docs: DataFrame, copied_from: int = 3, owners_from: int = 10) -> tuple[DataFrame, DataFrame]:
    """scanned() and located() with `copied`, both written."""
    found = saved(scanned(docs), "secret-matches")
    spans = saved(located(found), "secret-spans")
    copied = ownership(spans, copied_from, owners_from).filter("copied").select("value", "copied")
    return found, saved(spans.join(copied, "value", "left").withColumn("copied", F.coalesce("copied", F.lit(False))), "labelled-secrets")


def scan_secrets(docs: DataFrame, copied_from: int = 3, owners_from: int = 10) -> DataFrame:
    """doc_id, key, found: array of (start, kind, end), base spans and the method's, for each row of docs."""
    found, spans = labelled(docs, copied_from, owners_from)
    own = F.struct("start", "kind", "end")
    over = F.struct(F.col("vstart").alias("start"), F.when(F.col("copied"), 5).otherwise(4).alias("kind"), F.col("vend").alias("end"))
    each = F.when((F.col("kind") == 3) & F.col("copied"), F.array(over)).otherwise(F.array(own, over))
    grouped = spans.select("row", F.explode(each).alias("s")).groupBy("row").agg(F.array_sort(F.collect_set("s")).alias("found"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return found.select("row", "doc_id", "key").join(grouped, "row", "left").select("doc_id", "key", F.coalesce("found", none).alias("found"))


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < 3)

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("found")).alias("spans"))


def base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the secret scan that SQL can express."""
    return query(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def oracle_sql() -> str:
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    assign = "(" + "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    parts = []
    for kind, pattern, group, least, _ in ((0, assign, 2, 6, None), *_SCANS[1:3]):
        parts.append(f"""SELECT doc_id, {kind} AS kind, sum(length(b) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS a, length(m) AS n, v FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(bs[1:len(ms)]) AS b, unnest(vs) AS v
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS bs, regexp_extract_all(t, '{pattern}', {group}) AS vs FROM d WHERE regexp_matches(t, '{pattern}'))) QUALIFY length(v) >= {least}""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, kind) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (doc_id)"""


def masks(spans: DataFrame) -> DataFrame:
    """row, runs: the bytes (lo, hi) of a text that are masked. Spans that overlap are one run."""
    order = Window.partitionBy("row").orderBy("lo", "hi")
    spans = spans.select("row", "lo", "hi").distinct().withColumn("before", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("lo") >= F.coalesce("before", F.lit(0)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy("row", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def redact(docs: DataFrame, copied_from: int = 3, mask: str = "[SECRET]", owners_from: int = 10) -> DataFrame:
    """docs with every base span and live opaque token masked in text, n_chars set anew; all rows and columns
    stay. Overlapping spans are masked as one."""
    key, runs, masked = free(docs.columns, "row_key", "row_runs", "row_text")
    rows, spans = labelled(docs, copied_from, owners_from)
    found = rows.select("row", F.col("key").alias(key)).join(masks(spans.filter("kind < 3 OR NOT copied")), "row")
    found = found.select(key, F.col("runs").alias(runs)).dropDuplicates([key])
    out = docs.withColumn(key, row_key("doc_id", "text")).join(found, key, "left")
    text = F.when(F.col(runs).isNull(), F.col("text")).otherwise(between(F.col("text").cast("binary"), F.col(runs), mask))
    out = out.withColumn(masked, text)
    size = F.when(F.col(runs).isNull(), F.col("n_chars")).otherwise(F.length(masked).cast("long")) if "n_chars" in docs.columns else None
    fields = {"text": F.col(masked), "n_chars": size}
    return out.select(*(fields[c].alias(c) if fields.get(c) is not None else F.col(c) for c in docs.columns))
