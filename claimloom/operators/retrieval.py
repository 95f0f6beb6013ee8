"""BM25 over a kept inverted index with block maxima.

postings() reads every text once. Documents are dealt into parts by hash, and all that is known of a term in a part is one
row, its block: the documents with their counts, how many they are, and the greatest count and least length, from which
the greatest score that the term can give there follows. The empty term stands for the documents themselves. Blocks are
written by bucket of the term; they are what is kept, and searching reads no text. Names of documents are unique. A task
holds TASK parts, so its memory does not grow with the documents.

search() first adds up, from the blocks' figures alone, what a part can give a query at the most. The most promising
parts are scored, which leaves the k-th best score; of the other parts only those that can still reach it are. The blocks that
queries ask for are shuffled once, by part; there they meet the terms of queries, which are broadcast where they are few, and a
document's score is added up and the best k of a query in each task are picked without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.support import token_list
from ..sources import scratch

#: terms of queries, and pairs of query and term, that are broadcast; more are joined by a shuffle
MOST_TERMS = 500_000
#: folders of blocks, documents of a part, parts of a task, parts that are scored first
BUCKETS, PART, TASK, FIRST = 4, 64, 32, 4


def bounded(rows: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """rows, to be broadcast if they are at most so many."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def tasks_of(spark: SparkSession, parts: int) -> int:
    """Tasks that parts are dealt to; a stated number, so that Spark does not merge small ones into large ones."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts // TASK))


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = PART) -> DataFrame:
    """bucket, term, part, n, most, least, words, entries(doc, length, tf): the blocks of all terms, and of the empty one."""
    parts = max(1, -(-docs.count() // size))
    rows = docs.select(F.col(doc).alias("doc"), F.pmod(F.xxhash64(doc), F.lit(parts)).alias("part"), text)
    # a part's texts are shuffled once; its counts and blocks are worked out where they lie
    rows = rows.repartition(tasks_of(docs.sparkSession, parts), "part").select("doc", "part", token_list(F.col(text)).alias("tokens"))
    rows = rows.select("doc", "part", F.size("tokens").alias("length"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("term"))
    counts = rows.groupBy("part", "doc", "length", "term").agg(F.count("*").alias("tf"))
    blocks = counts.groupBy("part", "term").agg(
        F.count("*").alias("n"), F.max("tf").alias("most"), F.min("length").alias("least"), F.sum("length").alias("words"),
        F.collect_list(F.struct("doc", "length", "tf")).alias("entries"),
    )
    return blocks.withColumn("bucket", bucket_of(F.col("term"))).sortWithinPartitions("bucket", "term", "part")


def kept(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = PART) -> DataFrame:
    """postings(), made once in an application for the files of docs, and read from then on."""
    return scratch.once(docs.sparkSession, f"postings-{doc}-{text}-{size}", docs, lambda: postings(docs, doc, text, size), ("bucket",))


def gain(tf: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    """What a term adds to a document's score, but for its idf; grows with tf and falls with length."""
    norm = 1 - b + b * F.greatest(length, F.lit(1)) / F.when(average > 0, average).otherwise(1.0)
    return tf * (k1 + 1) / (tf + k1 * norm)


def search(
    blocks: DataFrame, queries: DataFrame, query: str = "query_id", query_text: str = "query", formulas: DataFrame | None = None,
    doc: str = "doc_id", k: int = L.BM25["k"], k1: float = L.BM25["k1"], b: float = L.BM25["b"], first: int = FIRST,
) -> DataFrame:
    """query, doc, score, rank. Terms that a query repeats count as often. Documents without a score fill up to k
    in the order of doc. With formulas(doc, formula), a document whose formula the query names gains a fixed boost."""
    every = blocks.filter((F.col("term") == "") & (F.col("bucket") == bucket_of(F.lit(""))))
    totals = every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), (F.sum("words") / F.sum("n")).alias("avg_length")).first()  # one row
    n_docs, average = F.lit(float(totals["n_docs"])), F.lit(float(totals["avg_length"] or 0.0))

    wanted = queries.select(query, F.explode(token_list(F.col(query_text))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("times"))
    wanted = scratch.keep(wanted, "query-terms")
    terms = wanted.select("term").distinct()
    figures = blocks.join(bounded(terms), "term", "left_semi").select("term", "part", "n", "most", "least")
    df = figures.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = bounded(scratch.keep(wanted.join(df, "term").select(query, "term", (F.col("times") * idf).alias("weight")), "weighted-terms"))

    reach = figures.join(wanted, "term").groupBy(query, "part").agg(F.sum(F.col("weight") * gain(F.col("most"), F.col("least"), average, k1, b)).alias("reach"))
    held = blocks.select("term", "part", "entries", F.lit(False).alias("bonus"))
    if formulas is not None:  # a formula is a term of its own, with a fixed gain that a document has once
        named = F.array_distinct(F.filter(F.regexp_extract_all(query_text, F.lit(L.ANY_FORMULA), F.lit(0)), lambda f: ~f.isin(*L.QUERY_STOP_FORMULAS)))
        asked = queries.select(query, F.explode(named).alias("formula")).distinct()
        placed = every.select("part", F.explode("entries").alias("e")).select("part", "e", F.col("e.doc").alias("doc"))
        about = formulas.select(F.col(doc).alias("doc"), "formula").join(asked.select("formula").distinct(), "formula", "left_semi").distinct()
        term = F.concat(F.lit("formula "), F.col("formula")).alias("term")  # no term holds a space
        bonus = about.join(placed, "doc").groupBy("formula", "part").agg(F.collect_list("e").alias("entries"))
        bonus = scratch.keep(bonus.select(term, "part", "entries", F.lit(True).alias("bonus")), "boosted")
        more = asked.select(query, term, F.lit(float(L.BM25["boost"])).alias("weight"))
        boosts = bonus.select("term", "part").join(bounded(more), "term").groupBy(query, "part").agg(F.sum("weight").alias("reach"))
        reach = reach.unionByName(boosts).groupBy(query, "part").agg(F.sum("reach").alias("reach"))
        held, wanted = held.unionByName(bonus), bounded(scratch.keep(wanted.unionByName(more), "weighted-terms"))
    reach = scratch.keep(reach, "reach")
    held = held.join(bounded(wanted.select("term").distinct()), "term", "left_semi")
    tasks = tasks_of(blocks.sparkSession, -(-int(totals["n_docs"]) // PART))
    order = Window.partitionBy(query).orderBy(F.round("score", 4).desc(), "doc")  # sums differ in their last bits with the order of terms

    def scores(pairs: DataFrame) -> DataFrame:
        """query, doc, score: of each query the best k documents of its parts in pairs(query, part)."""
        asking = pairs.groupBy("part").agg(F.collect_set(query).alias("asking"))  # a row a part, so the join by part multiplies nothing
        there = held.repartition(tasks, "part").join(asking.repartition(tasks, "part"), "part")
        mine = there.join(wanted, "term").filter(F.array_contains("asking", F.col(query))).select(query, "part", "weight", "bonus", F.explode("entries").alias("e"))
        own = F.sum(F.when(~F.col("bonus"), F.col("weight") * gain(F.col("e.tf"), F.col("e.length"), average, k1, b)))
        once = F.max(F.when(F.col("bonus"), F.col("weight")))
        out = mine.groupBy("part", query, F.col("e.doc").alias("doc")).agg((F.coalesce(own, F.lit(0.0)) + F.coalesce(once, F.lit(0.0))).alias("score"))
        return out.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).select(query, "doc", "score")

    best = reach.withColumn("nth", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("reach"), "part"))).filter(F.col("nth") <= first)
    probe = scratch.keep(best.select(query, "part"), "first-parts")
    found = scratch.keep(scores(probe), "first-scores")
    nth = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score")))
    floor = found.withColumn("nth", nth).filter(F.col("nth") == k).select(query, F.col("score").alias("floor"))
    rest = reach.join(floor, query, "left").filter(F.col("reach") >= F.coalesce("floor", F.lit(0.0)) - 1e-3)  # ranks go by four digits
    found = found.unionByName(scores(rest.select(query, "part").join(probe, [query, "part"], "left_anti")))

    lowest = every.select(F.explode("entries").alias("e")).select(F.col("e.doc").alias("doc")).orderBy("doc").limit(k)
    filler = queries.select(query).join(F.broadcast(lowest), F.lit(True)).select(query, "doc", F.lit(0.0).alias("score"))  # k rows a query
    every_score = found.unionByName(filler).groupBy(query, "doc").agg(F.max("score").alias("score"))
    ranked = every_score.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(query, F.col("doc").alias(doc), "score", "rank")


def bm25_topk(docs: DataFrame, queries: DataFrame, doc: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query", formula: str | None = None, **options) -> DataFrame:
    """search() over the postings of docs, written for this call."""
    blocks = scratch.keep(postings(docs, doc, text), "postings")
    named = docs.select(doc, F.col(formula).alias("formula")) if formula else None
    return search(blocks, queries, query, query_text, named, doc, **options)
