"""Search: ranked retrieval over an inverted index, a chain of providers, and the look-up of official sources.

A provider takes queries (qid, query, sites: array<string>) and gives results (qid, rank, url, title, summary), as a web service's would. index_provider() searches a
table of pages. In a chain, queries that one provider has no results for go to the next.

Pages are dealt out once, as texts: terms are counted where their page is. Postings are joined on the term. If the asked terms are few (BROADCAST_TERMS), only their
postings are dealt out, by page; all scores of a page are added in one task, and each task keeps its best of each query. Else scores are added by (query, page) over a
shuffle, and the best are taken in LANES lanes of each query first: a query that most pages match is no one task's load. Tasks grow with the text and with the scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions import urls
from ..sources import scratch
from . import events

K1, B = 1.2, 0.75
LANES = 64
TASK_CHARS, TASK_SCORES, MOST_TASKS, BROADCAST_TERMS = 8_000_000, 1_000_000, 20_000, 200_000
RESULT = "qid string, rank int, url string, title string, summary string"
Provider = Callable[[DataFrame], DataFrame]


def _tasks(spark: SparkSession, size: float, of: int) -> int:
    return min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / of)))


class Index:
    """postings (term, doc, tf, len), terms (term, idf) and the mean length. Documents without terms are never found."""

    def __init__(self, docs: DataFrame, doc: str, text: str):
        texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("text IS NOT NULL")
        chars = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
        words = texts.repartition(_tasks(docs.sparkSession, chars, TASK_CHARS), "doc").select("doc", T.tokens("text").alias("w")).where(F.size("w") > 0)
        rows = words.select("doc", F.size("w").alias("len"), F.explode("w").alias("term"))
        self.postings = scratch.stored(rows.groupBy("doc", "len", "term").agg(F.count(F.lit(1)).alias("tf")))
        total = self.postings.select("doc", "len").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).first()
        self.count, self.mean = total["n"], total["mean"] or 1.0
        df = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        self.terms = scratch.stored(df.select("term", F.log(1 + (self.count - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))

    def search(self, queries: DataFrame, k: int = 10, only: DataFrame | None = None) -> DataFrame:
        """(qid, rank, doc, score): the k best documents of each query (qid, query) by BM25; equal scores by doc. only: (qid, doc) restricts a query's."""
        asked = scratch.stored(queries.select("qid", F.explode(F.array_distinct(T.tokens("query"))).alias("term")).join(self.terms, "term"))
        size = asked.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("qid").alias("queries")).first()
        hashed = F.xxhash64("doc")
        if size["terms"] <= BROADCAST_TERMS:
            n = _tasks(asked.sparkSession, self.count * size["queries"], TASK_SCORES)
            wanted = self.postings.join(F.broadcast(asked.select("term")), "term", "left_semi")
            wanted = wanted.withColumn("cell", F.pmod(hashed, F.lit(n)).cast("int")).repartitionById(n, F.col("cell")).join(F.broadcast(asked), "term")
        else:
            wanted = self.postings.join(asked, "term").withColumn("cell", F.pmod(hashed, F.lit(LANES)).cast("int"))
        norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / self.mean)
        scored = wanted.withColumn("s", F.col("idf") * F.col("tf") * (K1 + 1) / norm).groupBy("qid", "cell", "doc").agg(F.sum("s").alias("score"))
        if only is not None:
            scored = scored.join(only, ["qid", "doc"], "left_semi")
        cell = Window.partitionBy("qid", "cell").orderBy(F.desc(F.round("score", 9)), "doc")
        few = scored.withColumn("_n", F.row_number().over(cell)).where(F.col("_n") <= k).drop("_n")
        best = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc")
        return few.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "rank", "doc", "score")


def index_provider(pages: DataFrame, k: int = 10) -> Provider:
    """A provider over pages (url, title, text), one row each URL; a query's sites restrict its results to their hosts."""
    index = Index(pages, "url", "text")
    hosts = pages.select(F.col("url").alias("doc"), urls.domain("url").alias("host"))

    def search(queries: DataFrame) -> DataFrame:
        free = index.search(queries.where(F.size("sites") == 0), k)
        bound = queries.where(F.size("sites") > 0)
        only = bound.select("qid", F.explode("sites").alias("host")).join(hosts, "host").select("qid", "doc")
        found = free.unionByName(index.search(bound, k, only))
        text = pages.select(F.col("url").alias("doc"), "title", F.left(T.filled("text"), F.lit(1200)).alias("summary"))
        return found.join(text, "doc").select(F.col("qid").cast("string").alias("qid"), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("url"), "title", "summary")

    return search


def chain(providers: list[Provider]) -> Provider:
    """Each query's results from the first provider that has any."""

    def search(queries: DataFrame) -> DataFrame:
        out = queries.sparkSession.createDataFrame([], RESULT)
        left = queries
        for p in providers:
            found = scratch.stored(p(left).select("qid", F.col("rank").cast("int").alias("rank"), "url", "title", "summary"))
            out = out.unionByName(found)
            left = left.join(found.select("qid").distinct(), "qid", "left_anti")
        return out

    return search


def sweep(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(source, title, url, summary): all results, each URL once, of the first query (by `order`) and rank that has it. queries: (qid, order)."""
    first = results.where(T.filled("url") != "").join(queries.select("qid", "order"), "qid").groupBy("url").agg(F.min_by(F.struct("title", "summary"), F.struct("order", "rank")).alias("r"))
    return first.select(urls.domain("url").alias("source"), "r.title", "url", "r.summary")


def official_sources(cases: DataFrame, provider: Provider, k: int = 5) -> DataFrame:
    """(id, official_url) of the cases (id, company, authority, keywords) for which a search of the authority's own sites, else of the first trusted ones, finds a trusted page.

    The first trusted one of the first k results counts.
    """
    known = F.create_map(*[x for a, sites in L.AUTHORITY_DOMAINS.items() for x in (F.lit(a), T.strings(sites))])
    who = F.when(F.contains(F.lower(T.filled("company")), F.lit("review")), "").otherwise(T.filled("company"))
    asked = cases.select(F.col("id").cast("string").alias("qid"), "id", F.trim(F.concat_ws(" ", who, T.filled("keywords"))).alias("query"), F.coalesce(F.try_element_at(known, T.filled("authority")), T.strings(L.TRUSTED_DOMAINS[:6])).alias("sites"))
    asked = scratch.stored(asked)
    found = provider(asked.select("qid", "query", "sites")).where((F.col("rank") <= k) & events.is_trusted("url"))
    first = found.groupBy("qid").agg(F.min_by("url", "rank").alias("official_url"))
    return asked.select("qid", "id").join(first, "qid").select("id", "official_url")
