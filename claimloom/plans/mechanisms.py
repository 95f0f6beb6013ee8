"""Queries for sinks, streams, caches, files, selection and scorers, each beside the SQL that it must equal."""

from __future__ import annotations

import contextlib

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..functions import batch  # noqa: F401  registers its scorers
from ..functions import lexicon as L
from ..functions import support as S
from ..operators import audit as A
from ..operators import metrics as M
from ..operators import order as O
from ..operators import physics as P
from ..operators import resample as B
from ..operators import rules, studies
from ..operators import selection as D
from ..sources import files, io, scratch
from ..sources.cache import ScoreCache
from ..streaming import scoring
from ..streaming.ledger import Ledger
from . import render
from .catalogue import _manifest, _physics, _robustness, _support, r6, records, scored, spread, table, turns
from .oracle import _MANIFEST, LEX, PHYS, RECORDS, SCORED, TURNS, _boot, _dot, _weighted
from .oracle import oracle_sql as _oracle


def _events(spark, sf_dir):
    """Events with a timestamp, and their number in props."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "props")
    return rows.withColumn("k", F.get_json_object("props", "$.k").cast("long")).drop("props")


# Streams and sinks


def ledger_log(spark, sf_dir):
    """Events through the append-only log: one in nine comes twice, the run is stopped once between writing a batch and entering
    it, goes on, and is then fed everything again under a new checkpoint. log and metrics hold each event once."""
    run = scratch.fresh(spark, "ledger")
    rows = _events(spark, sf_dir).select("event_id", "event_type", "k")
    rows.unionByName(rows.filter("event_id % 9 = 0")).repartition(6).write.parquet(run + "/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(run + "/in")
    stopped = []

    def once(number: int) -> None:
        if number == 1 and not stopped:
            stopped.append(number)
            raise RuntimeError("stopped between writing and entering")

    sums = {"n_logged": F.count("*"), "sum_k": F.sum("k")}
    log = Ledger(spark, run + "/out", "event_id", "event_id long, event_type string, k long", ("event_type",), sums, once)
    with contextlib.suppress(StreamingQueryException):
        log.run(stream, run + "/checkpoint")
    log.run(stream, run + "/checkpoint")
    last = max(map(int, log.entered())) + 1
    again = Ledger(spark, run + "/out", "event_id", log.schema, log.by, sums)
    write = again.write
    again.write = lambda batch, number: write(batch, number + last)  # another checkpoint counts its batches anew
    again.run(stream, run + "/other-checkpoint")
    held = log.log().groupBy("event_type").agg(F.count("*").alias("n_rows"), F.countDistinct("event_id").alias("n_events"))
    return held.join(log.metrics(), "event_type").select("event_type", "n_rows", "n_events", "n_logged", "sum_k")


LEDGER_SQL = """SELECT event_type, count(*) AS n_rows, count(DISTINCT event_id) AS n_events, count(*) AS n_logged,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY event_type"""

#: days of a micro-batch, batches, and how many batches later rows come again
DAYS, BATCHES, LATER = 5, 6, 3


def watermark_dedupe(spark, sf_dir):
    """Events in six micro-batches of five days, out of order within each. One in five comes again ten minutes later (a copy
    within the delay), one in seven three batches later with its old time (too late), one in eleven three batches
    later with a new time (its key has been dropped by then, so it counts as new)."""
    run = scratch.fresh(spark, "watermark")
    rows = _events(spark, sf_dir).select("event_id", "event_type", "ts")
    first = rows.agg(F.min(F.to_date("ts")).alias("first"))  # one row
    rows = rows.join(F.broadcast(first), F.lit(True)).withColumn("batch", F.least(F.lit(BATCHES - 1), F.floor(F.datediff(F.to_date("ts"), "first") / DAYS)).cast("int")).drop("first")
    later = rows.withColumn("batch", F.col("batch") + LATER).filter(F.col("batch") < BATCHES)
    soon = rows.filter("event_id % 5 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 MINUTES"))
    renewed = later.filter("event_id % 11 = 0").withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {DAYS * LATER} DAYS"))
    fed = rows.unionByName(soon).unionByName(later.filter("event_id % 7 = 0")).unionByName(renewed)
    fed = scratch.keep(fed, "fed")
    narrow = fed.drop("batch")
    for b in range(BATCHES):  # each batch is all that has come since the one before
        fed.filter(F.col("batch") == b).drop("batch").orderBy(F.md5(F.col("event_id").cast("string"))).write.mode("append").parquet(run + "/in")
        stream = spark.readStream.schema(narrow.schema).parquet(run + "/in")
        scoring.run_available(scoring.once_within(stream, "event_id", "ts"), run + "/out", run + "/checkpoint")
    out = spark.read.parquet(run + "/out")
    return out.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.countDistinct("event_id").alias("n_events"))


WATERMARK_SQL = f"""WITH d AS (SELECT event_id, event_type, least({BATCHES - 1}, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) // {DAYS}) AS batch FROM events)
SELECT event_type, count(*) + count(*) FILTER (WHERE event_id % 11 = 0 AND batch + {LATER} < {BATCHES}) AS n_rows, count(*) AS n_events FROM d GROUP BY event_type"""


# Caches and files


def cache_compaction(spark, sf_dir):
    """The last entry of each user: two parts appended, compacted, a third appended, compacted again and cleared up."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    cache = ScoreCache(spark, scratch.fresh(spark, "cache"), "user_id long, event_id long, event_type string", "user_id", "event_id")
    n = rows.agg(F.max("event_id")).first()[0] + 1
    for part in range(3):
        cache.append(rows.filter((F.col("event_id") * 3 / n).cast("int") == part))
        if part > 0:
            cache.compact()
    cache.vacuum()
    return cache.read().select("user_id", "event_id", "event_type")


def atom_entries(spark, sf_dir):
    """Documents written as Atom entries and read back; one in fifty is broken XML."""
    clean = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9.,]+", " "))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.coalesce("source", F.lit("")).alias("source"), clean.alias("t"))
    title, summary = F.substring("t", 1, 40), F.substring("t", 41, 200)

    def tag(name: str, value):
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    authors = F.concat(*(tag("author", tag("name", F.concat(F.lit(f" {who} "), F.lit("of "), F.col("source")))) for who in ("First", "Second")))
    whole = F.concat(tag("id", F.concat(F.lit("http://example.org/abs/"), "id")), tag("title", F.concat(title, F.lit("\n "))), tag("summary", summary), tag("published", F.lit("2024-01-01")), tag("updated", F.lit("2024-01-02")), authors)
    entry = F.concat(F.lit("<entry>"), F.when(F.col("doc_id") % 50 == 0, F.concat(whole, F.lit("<open>"))).otherwise(whole), F.lit("</entry>"))
    run = scratch.fresh(spark, "atom")
    rows.select(entry.alias("value")).write.text(run)
    found = files.read_atom(spark, run)
    return found.select(F.coalesce("source_id", F.lit("")).alias("source_id"), F.md5("title").alias("title_md5"), F.md5("summary").alias("summary_md5"), F.coalesce("authors", F.lit("")).alias("authors"), F.col("corrupt").isNotNull().cast("int").alias("corrupt"))


ATOM_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9.,]+', ' ', 'g')) AS t FROM documents), g AS (SELECT *, doc_id % 50 = 0 AS bad FROM d)
SELECT CASE WHEN bad THEN '' ELSE CAST(doc_id AS VARCHAR) END AS source_id, md5(CASE WHEN bad THEN '' ELSE trim(substr(t, 1, 40)) END) AS title_md5, md5(CASE WHEN bad THEN '' ELSE trim(substr(t, 41, 200)) END) AS summary_md5,
  CASE WHEN bad THEN '' ELSE trim('First of ' || source) || '; ' || trim('Second of ' || source) END AS authors, CAST(bad AS INT) AS corrupt FROM g"""


def manifest_digests(spark, sf_dir):
    """For each source the digest of its sorted ids, and of the file that they are frozen in."""
    rows = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id")
    lists = files.id_lists(rows, "doc_id", "source")
    run = scratch.fresh(spark, "frozen")
    ids = rows.select("source", F.col("doc_id").cast("string").alias("value")).distinct()
    ids.repartition("source").sortWithinPartitions("source", "value").write.partitionBy("source").text(run)
    frozen = files.file_digests(spark, run).select(F.regexp_extract("path", r"source=([^/]*)/", 1).alias("source"), F.col("sha256").alias("file_sha256"), "length")
    return lists.join(frozen, "source").select("source", "n_ids", F.col("sha256").alias("ids_sha256"), "file_sha256", "length")


DIGEST_SQL = """WITH i AS (SELECT DISTINCT coalesce(source, 'none') AS source, CAST(doc_id AS VARCHAR) AS id FROM documents),
s AS (SELECT source, count(*) AS n_ids, string_agg(id, chr(10) ORDER BY id) AS ids FROM i GROUP BY source)
SELECT source, n_ids, sha256(ids) AS ids_sha256, sha256(ids || chr(10)) AS file_sha256, CAST(strlen(ids) + 1 AS BIGINT) AS length FROM s"""


def mode_metric_files(spark, sf_dir):
    """Metrics of each mode in files of its own, some with a column that others lack, read by one pattern and compared: the mode
    is in the files' path."""
    rows = _support(scored(spark, sf_dir), "lexical").select("model", F.col("document_status").alias("mode"), r6("lexical").alias("support"), "constraint_score")
    means = scratch.keep(M.group_metrics(rows, "mode", "model", support="support"), "means")
    run = scratch.fresh(spark, "metric-files")
    for i, mode in enumerate(L.STATUSES[:3]):
        one = means.filter(F.col("mode") == mode).drop("mode", *(["divergence_rate"] if i else []))
        one.coalesce(1).write.json(f"{run}/metrics_{mode}")
    back = files.read_many(spark, f"{run}/metrics_*/*.json", keys={"mode": r"metrics_([a-z_]+)/"})
    return back.select("mode", "model", "n", *(r6(c).alias(c) for c in ("mean_support", "violation_rate")), F.coalesce(r6("divergence_rate"), F.lit(-1.0)).alias("divergence_rate"))


MODE_SQL = SCORED + f""", l AS (SELECT document_status AS mode, model, round({LEX}, 6) AS sup, clean FROM s)
SELECT mode, model, count(*) AS n, round(avg(sup), 6) AS mean_support, round(avg(CAST(clean = 0 AS DOUBLE)), 6) AS violation_rate,
  CASE WHEN mode = '{L.STATUSES[0]}' THEN round(avg(CAST(sup >= 0.8 AND clean = 0 AS DOUBLE)), 6) ELSE -1.0::DOUBLE END AS divergence_rate FROM l WHERE mode IN {L.STATUSES[:3]} GROUP BY mode, model"""


# Order statistics and intervals


def price_quantiles(spark, sf_dir):
    """Exact quantiles of prices by flag, several at once."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    at = rows.select("l_returnflag").distinct().join(F.broadcast(O.shares([0.05, 0.5, 0.95], rows)), F.lit(True))  # three shares
    return O.quantiles(rows, ["l_returnflag"], "v", at).select("l_returnflag", "p", r6("quantile").alias("quantile"), "n")


QUANTILE_SQL = " UNION ALL ".join(f"SELECT l_returnflag, {p}::DOUBLE AS p, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), {p}), 6) AS quantile, count(*) AS n FROM lineitem GROUP BY 1" for p in (0.05, 0.5, 0.95))


def spearman_interval(spark, sf_dir):
    """Rank correlation of the length of labelled documents and their quality, with an interval over rows: one bag, the plain bootstrap of all rows."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y")).filter("y IS NOT NULL")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x")).join(labels, "doc_id")
    out = B.spearman_interval(rows, "doc_id", "x", "y", 400)
    return out.select(*(r6(c).alias(c) for c in ("point", "ci_low", "ci_high")), "n", F.lit(1).cast("long").alias("bags"))


_RHO = """SELECT rep, sum(w * dx * dy) / (sqrt(sum(w * dx * dx)) * sqrt(sum(w * dy * dy))) AS v FROM (SELECT rep, w, rx - sum(w * rx) OVER g / sum(w) OVER g AS dx, ry - sum(w * ry) OVER g / sum(w) OVER g AS dy FROM
  (SELECT rep, w, x_below + (x_tied + 1) / 2 AS rx, y_below + (y_tied + 1) / 2 AS ry FROM (SELECT rep, w, sum(w) OVER (PARTITION BY rep, x) AS x_tied, sum(w) OVER (PARTITION BY rep, y) AS y_tied,
    sum(w) OVER (PARTITION BY rep ORDER BY x RANGE UNBOUNDED PRECEDING) - sum(w) OVER (PARTITION BY rep, x) AS x_below, sum(w) OVER (PARTITION BY rep ORDER BY y RANGE UNBOUNDED PRECEDING) - sum(w) OVER (PARTITION BY rep, y) AS y_below FROM {}))
  WINDOW g AS (PARTITION BY rep)) GROUP BY rep"""
SPEARMAN_SQL = f"""WITH k AS (SELECT d.doc_id AS c, CAST(n_chars AS DOUBLE) AS x, CAST(quality AS DOUBLE) AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE n_chars IS NOT NULL AND quality IS NOT NULL),
w AS (SELECT rep, x, y, w::DOUBLE AS w FROM ({_weighted('k', 400)}) WHERE w > 0), one AS (SELECT 0 AS rep, x, y, 1.0::DOUBLE AS w FROM k), b AS ({_RHO.format('w')}), pt AS ({_RHO.format('one')})
SELECT round((SELECT v FROM pt), 6) AS point, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high, (SELECT count(*) FROM k) AS n, 1::BIGINT AS bags FROM b WHERE v IS NOT NULL AND NOT isnan(v)"""


# Scorers


def trigram_support(spark, sf_dir):
    """A scorer that works on batches in Python, through the same registry as the others."""
    return turns(spark, sf_dir).select("conv_id", "turn", r6(S.scorer("trigram")(F.col("question"), F.col("answer"), F.col("retrieved_context"))).alias("support"))


_TRI = "list_transform(range(1, length({0}) - 1), lambda i: substr(lower({0}), i, 3))"
TRIGRAM_SQL = TURNS + f""", g AS (SELECT conv_id, turn, {_TRI.format('answer')} AS a, {_TRI.format('retrieved_context')} AS c FROM t), e AS (SELECT conv_id, turn, 'a' AS s, unnest(a) AS x FROM g UNION ALL SELECT conv_id, turn, 'c', unnest(c) FROM g),
n AS (SELECT conv_id, turn, x, count(*) FILTER (WHERE s = 'a')::DOUBLE AS na, count(*) FILTER (WHERE s = 'c')::DOUBLE AS nc FROM e GROUP BY ALL), d AS (SELECT conv_id, turn, sum(na * nc) AS d, sqrt(sum(na * na)) * sqrt(sum(nc * nc)) AS m FROM n GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN m > 0 THEN least(1.0, d / m) ELSE 0.0 END, 6) AS support FROM t LEFT JOIN d USING (conv_id, turn)"""


def provided_support(spark, sf_dir):
    """A provided score where there is one, else the named scorer's, and which it was."""
    rows = records(spark, sf_dir)
    provided = F.when(F.col("template") % 2 == 0, ((F.col("part_id") + F.col("template")) % 11) / 10.0)
    score, method = S.provided_or("lexical", provided, F.col("question"), F.col("answer"), F.col("retrieved_context"))
    return rows.select("response_id", r6(score).alias("support"), method.alias("method"))


PROVIDED_SQL = RECORDS + f" SELECT response_id, round(CASE WHEN template % 2 = 0 THEN ((part_id + template) % 11) / 10.0::DOUBLE ELSE {LEX} END, 6) AS support, CASE WHEN template % 2 = 0 THEN 'provided_column' ELSE 'lexical' END AS method FROM r"


def proxy_support(spark, sf_dir):
    """The greater of word overlap and cosine of words and pairs."""
    return _support(records(spark, sf_dir), "proxy").select("response_id", r6("proxy").alias("support"))


_W = "regexp_extract_all(lower({}), '\\b[a-z0-9_][a-z0-9_]+\\b')"
_PAIRS = "list_concat({0}, list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
PROXY_SQL = RECORDS + f""", w AS (SELECT response_id, {LEX} AS lex, {_W.format('answer')} AS aw, {_W.format('retrieved_context')} AS cw FROM r), g AS (SELECT response_id, lex, {_PAIRS.format('aw')} AS a, {_PAIRS.format('cw')} AS c FROM w),
h AS (SELECT *, list_distinct(a) AS ka, list_distinct(c) AS kc FROM g), nn AS (SELECT response_id, lex, {_dot('list_intersect(ka, kc)', 'a', 'c')} AS d, sqrt({_dot('ka', 'a', 'a')}) * sqrt({_dot('kc', 'c', 'c')}) AS n FROM h)
SELECT response_id, round(greatest(lex, CASE WHEN n > 0 THEN least(1.0, d / n) ELSE 0 END), 6) AS support FROM nn"""


def document_ngram_cosine(spark, sf_dir):
    """Whole documents against the first document of their source, by words and pairs of words; letters beyond ASCII part words,
    as engines do not agree where words with such letters end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").filter("source IS NOT NULL")
    there = docs.filter("text IS NOT NULL")
    least = scratch.keep(D.first_of(there.select("source", "doc_id"), ["source"], "doc_id"), "firsts")  # no text is carried along
    first = D.first_of(there.join(least, ["source", "doc_id"]), ["source"], "doc_id").select("source", F.col("text").alias("context"))
    rows = spread(docs, "doc_id").join(scratch.keep(first, "firsts"), "source")
    return rows.select("doc_id", r6(S.scorer("ascii_ngrams")(F.lit(""), F.col("text"), F.col("context"))).alias("cosine"))


_PLAIN = "regexp_replace({}, '[^A-Za-z0-9_]', ' ', 'g')"
COSINE_SQL = f"""WITH f AS (SELECT source, arg_min(text, doc_id) AS context FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source),
w AS (SELECT doc_id, {_W.format(_PLAIN.format("coalesce(text, '')"))} AS aw, {_W.format(_PLAIN.format('context'))} AS cw FROM documents JOIN f USING (source)), g AS (SELECT doc_id, {_PAIRS.format('aw')} AS a, {_PAIRS.format('cw')} AS c FROM w),
e AS (SELECT doc_id, 'a' AS s, unnest(a) AS x FROM g UNION ALL SELECT doc_id, 'c', unnest(c) FROM g), n AS (SELECT doc_id, x, count(*) FILTER (WHERE s = 'a')::DOUBLE AS na, count(*) FILTER (WHERE s = 'c')::DOUBLE AS nc FROM e GROUP BY ALL),
d AS (SELECT doc_id, sum(na * nc) AS d, sqrt(sum(na * na)) * sqrt(sum(nc * nc)) AS m FROM n GROUP BY doc_id) SELECT doc_id, round(CASE WHEN m > 0 THEN least(1.0, d / m) ELSE 0.0 END, 6) AS cosine FROM w LEFT JOIN d USING (doc_id)"""


def rationales(spark, sf_dir):
    """Why a record was classified as it was."""
    return _physics(scored(spark, sf_dir)).select("response_id", P.rationale().alias("rationale"))


RATIONALE_SQL = PHYS + """ SELECT response_id, CASE WHEN hallucination_type = 'no_error' THEN 'No physics-informed inconsistency detected.'
  WHEN len(v) > 0 THEN 'Detected ' || array_to_string(v, ',') || ' under document_status=' || document_status || '; classified as ' || hallucination_type || '.'
  ELSE 'Classified as ' || hallucination_type || ' under document_status=' || document_status || '.' END AS rationale FROM p"""


# Corpora and data sets


def corpus_documents(spark, sf_dir):
    """The corpus: rows of properties and of abstracts written as documents, and contexts of records, numbered and deduplicated."""
    k = F.col("p_partkey").cast("long")
    gap, energy = render._hundredths((k * 37) % 2200 - 200), render._hundredths((k * 53) % 700 - 500)
    part = table(spark, sf_dir, "part")
    formula = F.element_at(F.array(*map(F.lit, render.FORMULAS)), (k % len(render.FORMULAS)).cast("int") + 1)
    stable = F.when(F.col("p_partkey") % 2 == 0, "True").otherwise("False")
    properties = part.select("p_partkey", property_text(formula, k, gap, energy, stable).alias("text"), formula.alias("formula"))
    properties = D.numbered(properties, "p_partkey", "i").select(_corpus_id("mp", "i"), F.concat(F.lit("https://example.org/"), F.col("p_partkey").cast("string")).alias("source"), F.lit("materials_project").alias("source_type"), F.lit("current").alias("document_status"), F.lit(3).alias("priority"), "formula", "text")
    papers = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("Item "), F.col("item_id").cast("string"), F.lit(". "), F.coalesce("text", F.lit(""))).alias("text"))
    papers = D.numbered(papers, "item_id", "i").select(_corpus_id("arxiv", "i"), F.lit("").alias("source"), F.lit("arxiv").alias("source_type"), F.lit("current").alias("document_status"), F.lit(2).alias("priority"), F.lit("").alias("formula"), "text")
    stress = records(spark, sf_dir).select("response_id", "document_status", F.col("retrieved_context").alias("text"))
    rank = F.when(F.col("document_status") == "outdated_or_incorrect", 4).when(F.col("document_status") == "incomplete", 3).when(F.col("document_status") == "current", 2).otherwise(1)
    stress = D.numbered(stress, "response_id", "i").select(F.concat(_number("h1ctx", "i"), F.lit("_"), "response_id").alias("doc_id"), F.lit("").alias("source"), F.lit("h1_stress_context").alias("source_type"), "document_status", rank.alias("priority"), F.lit("").alias("formula"), "text")
    rows = properties.unionByName(papers).unionByName(stress).filter(F.trim("text") != "")
    kept = D.first_of(rows.withColumns({"key": F.md5("text"), "order": F.concat_ws(" ", "source_type", "doc_id")}), ["source", "key"], "order")
    return kept.select("doc_id", "source_type", "document_status", "priority", "formula", F.md5("text").alias("text_md5"))


def property_text(formula, k, gap, energy, stable):
    """A row of properties as a document's text."""
    name = k.cast("string")
    return F.concat(F.lit("Materials Project reports "), formula, F.lit(" (mp-"), name, F.lit("). Band gap: "), gap, F.lit(" eV. Formation energy per atom: "), energy, F.lit(" eV/atom. Energy above hull: "), F.lit("0.00"), F.lit(" eV/atom. Stable: "), stable, F.lit("."))


def _number(prefix: str, i: str):
    n = (F.col(i) + 1).cast("string")
    return F.concat(F.lit(prefix + "_"), F.lpad(n, F.greatest(F.lit(4), F.length(n)), F.lit("0")))


def _corpus_id(prefix: str, i: str):
    return _number(prefix, i).alias("doc_id")


CORPUS_SQL = RECORDS + """, m AS (SELECT 'mp_' || CASE WHEN i < 10000 THEN lpad(CAST(i AS VARCHAR), 4, '0') ELSE CAST(i AS VARCHAR) END AS doc_id, 'https://example.org/' || k AS source, 'materials_project' AS source_type, 'current' AS document_status, 3 AS priority, f AS formula,
  'Materials Project reports ' || f || ' (mp-' || k || '). Band gap: ' || g || ' eV. Formation energy per atom: ' || e || ' eV/atom. Energy above hull: 0.00 eV/atom. Stable: ' || CASE WHEN k % 2 = 0 THEN 'True' ELSE 'False' END || '.' AS text FROM (SELECT *, row_number() OVER (ORDER BY k) AS i FROM b)),
a AS (SELECT 'arxiv_' || CASE WHEN i < 10000 THEN lpad(CAST(i AS VARCHAR), 4, '0') ELSE CAST(i AS VARCHAR) END AS doc_id, '' AS source, 'arxiv' AS source_type, 'current' AS document_status, 2 AS priority, '' AS formula, 'Item ' || item_id || '. ' || coalesce(text, '') AS text FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS i FROM benchmark)),
h AS (SELECT 'h1ctx_' || CASE WHEN i < 10000 THEN lpad(CAST(i AS VARCHAR), 4, '0') ELSE CAST(i AS VARCHAR) END || '_' || response_id AS doc_id, '' AS source, 'h1_stress_context' AS source_type, document_status, CASE document_status WHEN 'outdated_or_incorrect' THEN 4 WHEN 'incomplete' THEN 3 WHEN 'current' THEN 2 ELSE 1 END AS priority, '' AS formula, retrieved_context AS text
  FROM (SELECT *, row_number() OVER (ORDER BY response_id) AS i FROM r)), u AS (SELECT * FROM m UNION ALL SELECT * FROM a UNION ALL SELECT * FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY source, md5(text) ORDER BY source_type || ' ' || doc_id) AS n FROM u WHERE trim(text) <> '') SELECT doc_id, source_type, document_status, CAST(priority AS INT) AS priority, formula, md5(text) AS text_md5 FROM o WHERE n = 1"""


def matched_pairs(spark, sf_dir):
    """Each document with itself and with one a third of the corpus away."""
    return D.paired(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "other", F.col("matched").cast("int").alias("matched"))


PAIRS_SQL = "WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, doc_id AS other, 1 AS matched FROM i UNION ALL SELECT a.doc_id, b.doc_id, 0 FROM i a JOIN i b ON (a.i + greatest(3, a.n // 3)) % a.n = b.i"

#: what a data set is broken down by
DIMENSIONS = ("dataset_role", "source_dataset", "model", "mode", "constraint_family", "document_status", "split")


def dataset_breakdowns(spark, sf_dir):
    """Counts by each of seven columns, from one scan."""
    rows = _manifest(spark, sf_dir).withColumn("split", F.when(F.col("in_primary"), "primary").otherwise("rest"))
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in DIMENSIONS))).alias("x"))
    return long.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


BREAKDOWN_SQL = _MANIFEST + ", z AS (SELECT *, CASE WHEN n <= 500 THEN 'primary' ELSE 'rest' END AS split FROM m2) " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, count(*) AS n FROM z GROUP BY {d}" for d in DIMENSIONS)


def annotation_sheet(spark, sf_dir):
    """The extraction sheet with a blank column for each that an annotator fills, and how many rows are not done."""
    found = A.sheet(F.col("answer"))
    names = ["predicted_value", "predicted_unit", "predicted_property"]
    rows = records(spark, sf_dir).select("response_id", *(found[c].alias(c) for c in names))
    sheet = A.blank_columns(rows, names).withColumn("annotation_complete", F.when(F.col("response_id").endswith("-0"), "yes").otherwise("no"))
    return A.completeness(sheet).select("n", "n_incomplete", F.lit(len([c for c in sheet.columns if c.startswith("gold_")])).cast("long").alias("n_gold"))


ANNOTATION_SQL = "SELECT count(*) * 16 AS n, count(*) * 15 AS n_incomplete, 3::BIGINT AS n_gold FROM part"

# Claims in the given texts

#: templates whose answer is a bare number or says nothing, which mean nothing inside a longer text
ALONE = (1, 5, 15)


def _told(keys):
    """One rendered question and answer for each key."""
    rows = render.qa_records(keys)
    return rows.filter((F.col("template") == F.col("part_id") % len(render.TEMPLATES)) & ~F.col("template").isin(*ALONE)).select("part_id", F.col("question").alias("asked"), F.col("answer").alias("said"))


def document_claims(spark, sf_dir):
    """Rules over whole documents, each with a claim at its end: long texts, of which the last line counts. What else they
    hold (keys that look like formulas, numbers before a K) is matched, and is not the claim's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.join(_told(docs.select(F.col("doc_id").alias("p_partkey"))), F.col("doc_id") == F.col("part_id"))
    rows = rows.select("doc_id", F.col("asked").alias("question"), F.concat("text", F.lit(".\n"), "said").alias("answer"), (F.length("text") + 2).alias("since"))
    return rules.score_rows(rows, since=F.col("since")).select("doc_id", "constraint_score", F.array_join("violations", ";").alias("violations"))


def conversation_rules(spark, sf_dir):
    """Rules over the turns of conversations: the user's turn with a question behind it, the assistant's with a claim before it."""
    rows = turns(spark, sf_dir).withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    told = _told(rows.select(F.col("k").alias("p_partkey")))
    rows = rows.join(told, F.col("k") == F.col("part_id"))
    rows = rows.select("conv_id", "turn", F.concat("question", F.lit(" "), "asked").alias("question"), F.concat("said", F.lit("\n"), "answer").alias("answer"))
    return rules.score_rows(rows).select("conv_id", "turn", "constraint_score", F.array_join("violations", ";").alias("violations"))


def _claims_sql(keys: str) -> str:
    return SCORED.replace("FROM part)", f"FROM ({keys}))")


_MEANT = f"template = part_id % {len(render.TEMPLATES)} AND template NOT IN {ALONE}"
DOCUMENT_SQL = _claims_sql("SELECT doc_id AS p_partkey FROM documents") + f" SELECT part_id AS doc_id, CAST(clean AS DOUBLE) AS constraint_score, array_to_string(v, ';') AS violations FROM s WHERE {_MEANT}"
TURN_SQL = _claims_sql("SELECT conv_id * 1000 + turn AS p_partkey FROM (SELECT conv_id, turn, role, lead(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) WHERE role = 'user' AND answer IS NOT NULL")
TURN_SQL += f" SELECT part_id // 1000 AS conv_id, part_id % 1000 AS turn, CAST(clean AS DOUBLE) AS constraint_score, array_to_string(v, ';') AS violations FROM s WHERE {_MEANT}"


def answer_only_rules(spark, sf_dir):
    """Rules over answers whose questions are not known: a bare number then says nothing of a quantity."""
    rows = records(spark, sf_dir).select("response_id", "answer")
    return D.by_value(rows, ["answer"], lambda texts: rules.score_rows(texts, question=None)).select("response_id", "constraint_score", F.array_join("violations", ";").alias("violations"))


ANSWER_SQL = SCORED + " SELECT response_id, CASE WHEN template IN (1, 5) THEN 1.0 ELSE CAST(clean AS DOUBLE) END AS constraint_score, CASE WHEN template IN (1, 5) THEN '' ELSE array_to_string(v, ';') END AS violations FROM s"


def four_estimators(spark, sf_dir):
    """The robustness study with a fourth estimator, the cosine of words and pairs."""
    return _robustness(scored(spark, sf_dir), "lexical", "nli", "embedding")


_COSINES = f""", cw AS (SELECT response_id, clean, {_W.format('answer')} AS aw, {_W.format('retrieved_context')} AS kw FROM en), cg AS (SELECT response_id, clean, {_PAIRS.format('aw')} AS a, {_PAIRS.format('kw')} AS c FROM cw),
ch AS (SELECT *, list_distinct(a) AS ka, list_distinct(c) AS kc FROM cg), cn AS (SELECT response_id, clean, {_dot('list_intersect(ka, kc)', 'a', 'c')} AS d, sqrt({_dot('ka', 'a', 'a')}) * sqrt({_dot('kc', 'c', 'c')}) AS n FROM ch), e AS (SELECT response_id, clean"""
FOUR_SQL = _oracle()["estimator_robustness"].replace(", e AS (SELECT response_id, clean", _COSINES, 1).replace("'overlap', overlap FROM en)", "'overlap', overlap FROM en UNION ALL SELECT response_id, clean, 'embedding', CASE WHEN n > 0 THEN least(1.0, d / n) ELSE 0 END FROM cn)", 1)


# Fallbacks, missing values, fields


def fallback_clusters(spark, sf_dir):
    """A bootstrap whose clusters are tasks, samples where the task is blank, and responses where both are."""
    rows = scored(spark, sf_dir).select("response_id", "constraint_score", F.when(F.col("template") % 4 == 0, F.lit(" ")).otherwise(F.col("base_task_id")).alias("task"), F.when(F.col("template") % 8 != 0, F.concat(F.lit("s-"), F.col("part_id").cast("string"))).alias("sample"))
    rows = rows.withColumn("cluster", B.cluster_id("task", "sample", "response_id"))
    out = B.interval(rows, "cluster", {"n": F.count("*").cast("double"), "s": F.sum("constraint_score")}, F.col("s") / F.col("n"), 200)
    return out.select(*(r6(c).alias(c) for c in ("point", "ci_low", "ci_high")))


FALLBACK_SQL = SCORED + _boot("SELECT CASE WHEN template % 4 <> 0 THEN base_task_id WHEN template % 8 <> 0 THEN 's-' || part_id ELSE response_id END AS c, CAST(count(*) AS DOUBLE) AS n, CAST(sum(clean) AS DOUBLE) AS s FROM s GROUP BY 1", ("n", "s"), "s / n", 200)


def missing_by_file(spark, sf_dir):
    """For each source the first document that lacks its language or its text."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "text", F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("lang"))
    return D.first_missing(rows, "source", "doc_id", ["lang", "text"]).select("source", "n_missing", F.coalesce("first_missing", F.lit(-1)).alias("first_missing"))


MISSING_SQL = "WITH m AS (SELECT source, doc_id, doc_id % 11 = 0 OR lang IS NULL OR trim(lang) = '' OR text IS NULL OR trim(text) = '' AS lacks FROM documents) SELECT source, count(*) FILTER (WHERE lacks) AS n_missing, coalesce(min(doc_id) FILTER (WHERE lacks), -1) AS first_missing FROM m GROUP BY source"


def head_filled(spark, sf_dir):
    """The first documents by number, missing sizes as 0."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("n_chars"))
    return io.head(rows, 25, "doc_id")


def field_agreement(spark, sf_dir):
    """Two annotators' lists by field: share of equal ones and mean overlap."""
    v = F.array_join("violations", ";")
    rows = scored(spark, sf_dir).select(v.alias("a"), F.when(F.col("template") % 2 == 0, v).otherwise("non_negative_band_gap").alias("b"), "constraint_family", "model")
    out = M.field_agreement(rows, {"violations": ("a", "b"), "family_model": ("constraint_family", "model"), "model": ("model", "model")})
    return out.select("field", "n", r6("exact").alias("exact"), r6("jaccard").alias("jaccard"))


FIELD_SQL = SCORED + """, x AS (SELECT v AS p, CASE WHEN template % 2 = 0 THEN v ELSE ['non_negative_band_gap'] END AS g FROM s),
j AS (SELECT len(list_intersect(p, g)) AS i, len(list_distinct(list_concat(p, g))) AS u FROM x)
SELECT 'violations' AS field, count(*) AS n, round(avg(CAST(i = u AS DOUBLE)), 6) AS exact, round(avg(CASE WHEN u = 0 THEN 1.0 ELSE i::DOUBLE / u END), 6) AS jaccard FROM j UNION ALL SELECT 'family_model', count(*), 0.0, 0.0 FROM s UNION ALL SELECT 'model', count(*), 1.0, 1.0 FROM s"""

QUERIES = {
    answer_only_rules: ANSWER_SQL, four_estimators: FOUR_SQL, document_claims: DOCUMENT_SQL, conversation_rules: TURN_SQL, fallback_clusters: FALLBACK_SQL, missing_by_file: MISSING_SQL, field_agreement: FIELD_SQL,
    head_filled: "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN coalesce(n_chars, 0) ELSE 0 END AS n_chars FROM documents ORDER BY doc_id LIMIT 25",
    ledger_log: LEDGER_SQL, watermark_dedupe: WATERMARK_SQL, atom_entries: ATOM_SQL, manifest_digests: DIGEST_SQL, mode_metric_files: MODE_SQL,
    cache_compaction: "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    price_quantiles: QUANTILE_SQL, spearman_interval: SPEARMAN_SQL, trigram_support: TRIGRAM_SQL, provided_support: PROVIDED_SQL,
    proxy_support: PROXY_SQL, document_ngram_cosine: COSINE_SQL, corpus_documents: CORPUS_SQL, matched_pairs: PAIRS_SQL,
    dataset_breakdowns: BREAKDOWN_SQL, annotation_sheet: ANNOTATION_SQL, rationales: RATIONALE_SQL,
}


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {q.__name__: " ".join(sql.split("\n")) for q, sql in QUERIES.items() if sql}
