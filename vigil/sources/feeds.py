"""Feed, page and snapshot readers, and artifact writers."""

from __future__ import annotations

import datetime
import email.utils
import re
import urllib.parse
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, markup, urls
from ..functions import text as X
from . import scratch

ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "link", "description", "pubDate", "source")])


def rss(spark: SparkSession, path: str, per_feed: int = 60) -> DataFrame:
    """Items of RSS files, the first `per_feed` of each file; those without title or link go."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path).withColumn("feed", F.input_file_name())
    day = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("pubDate", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    rows = raw.select(
        "feed",
        X.squeeze("title").alias("title"),
        F.trim("link").alias("url"),
        F.left(X.squeeze(F.regexp_replace(X.filled("description"), "<[^>]+>", " ")), F.lit(1500)).alias("summary"),
        F.coalesce(F.date_format(day, "yyyy-MM-dd"), dates.normalize_date("pubDate")).alias("published"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.monotonically_increasing_id().alias("arrival_idx"),
    ).where((X.filled("title") != "") & (X.filled("url") != ""))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("feed").orderBy("arrival_idx"))).where(F.col("_n") <= per_feed).drop("_n")


# --- feeds as fetched ---
ENTRY = "array<struct<position:int,title:string,url:string,summary:string,published:string,source:string,publisher_url:string>>"
_NAME = re.compile(r"^\{.*\}")


def _day(text: str) -> str:
    """The day in UTC of an RFC 822 or ISO time; empty if it is neither."""
    text = (text or "").strip()
    for read in (email.utils.parsedate_to_datetime, lambda t: datetime.datetime.fromisoformat(t)):
        try:
            t = read(text)
            return (t.astimezone(datetime.UTC) if t.tzinfo else t).strftime("%Y-%m-%d")
        except (TypeError, ValueError, IndexError, OverflowError):
            continue
    return ""


def entries(content: bytes | None, name: str, domain: str, aggregator: bool, most: int = 60) -> list[dict]:
    """The first items of an RSS, RDF or Atom document with a link and a title. A document that breaks off gives the items before the break.

    An aggregator's items have the publisher as their source and its address beside it.
    """
    parser, out, scanned = ElementTree.XMLPullParser(["end"]), [], 0
    squeezed = lambda t: " ".join((t or "").split())
    try:
        parser.feed(content or b"")
        parser.close()
        broken = None
    except ElementTree.ParseError as e:
        broken = e
    events = parser.read_events()
    while scanned < most:
        try:
            _, node = next(events)
        except StopIteration:
            break
        except ElementTree.ParseError:  # the break itself comes as an event
            break
        if _NAME.sub("", node.tag) not in ("item", "entry"):
            continue
        scanned += 1
        part = {}
        for c in node:
            part.setdefault(_NAME.sub("", c.tag), c)
        text = lambda *keys: next((t for k in keys if k in part and (t := "".join(part[k].itertext()).strip())), "")  # noqa: B023, E731
        links = [c for c in node if _NAME.sub("", c.tag) == "link"]
        link = next((c.get("href") for c in links if c.get("href") and c.get("rel", "alternate") == "alternate"), None) or text("link")
        title = squeezed(text("title"))
        if not link or not title:
            continue
        days = (_day(text(k)) for k in ("pubDate", "published", "date", "updated"))
        origin = part.get("source") if aggregator else None
        out.append(
            {
                "position": scanned - 1,
                "title": title,
                "url": link.strip(),
                "summary": squeezed(text("summary", "description"))[:1500],
                "published": next((d for d in days if d), ""),
                "source": (origin.text or "").strip() or domain or name if origin is not None else domain or name,
                "publisher_url": origin.get("url", "") if origin is not None else "",
            }
        )
    return out


def parsed(fetched: DataFrame, most: int = 60) -> DataFrame:
    """Adds `entries` to fetched documents (name, url, kind, domain, selector, status, content): feeds by their items, watched pages by their links.

    `status` becomes empty where a document came but has none. A watched page's links are not yet limited: see new_links().
    """

    @F.pandas_udf(ENTRY)
    def read(name: pd.Series, url: pd.Series, kind: pd.Series, domain: pd.Series, selector: pd.Series, content: pd.Series) -> pd.Series:
        out = []
        for n, u, k, d, s, body in zip(name, url, kind, domain, selector, content, strict=True):
            if k != "docwatch":
                out.append(entries(body, n, d or "", k == "gnews", most))
                continue
            links = markup.structure((body or b"").decode("utf-8", "replace"), s or "a[href]")["links"]
            rows = [(x["position"], x["label"], urllib.parse.urljoin(u, x["href"])) for x in links if x["href"] and len(x["label"]) >= 12]
            out.append([{"position": i, "title": t, "url": h, "summary": "", "published": "", "source": d or n, "publisher_url": ""} for i, t, h in rows if h.startswith("http")])
        return pd.Series(out)

    done = fetched.withColumn("entries", F.when(F.col("status") == "ok", read("name", "url", "kind", "domain", "selector", "content")).otherwise(F.array().cast(ENTRY)))
    return done.withColumn("status", F.when((F.col("status") == "ok") & (F.size("entries") == 0), "empty").otherwise(F.col("status"))).drop("content")


def new_links(items: DataFrame, seen: DataFrame, keep: int = 40) -> DataFrame:
    """Items whose URL is not in seen (url); of a watched page (kind docwatch) each URL once and the first `keep`, other feeds' whole."""
    fresh = items.join(seen.select("url").distinct(), "url", "left_anti")
    watched = fresh.where("kind = 'docwatch'")
    once = watched.groupBy("name", "url").agg(F.min_by(F.struct(*[c for c in items.columns if c not in ("name", "url")]), "position").alias("r")).select("name", "url", "r.*")
    once = once.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("position"))).where(F.col("_n") <= keep).drop("_n")
    return fresh.where("kind <> 'docwatch'").unionByName(once)


def sense(spark: SparkSession, registry: list[dict], fetch: Callable[[list[tuple[str, str]]], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(items, health) of a registry of sources: dicts of name, url, kind (rss, gnews, docwatch), domain, selector, is_primary, always_relevant, fallback_url.

    fetch: list of (name, url) -> (name, url, status, detail, content), such as web.fetch. Sources that are blocked, failed or empty are asked again by their fallback, an
    aggregator's feed, whose items claim nothing of the source: no domain, not primary, not always relevant. Health has a row of every source.
    """
    fields = ["name", "kind", "domain", "selector", "is_primary", "always_relevant", "fallback_url"]
    known = spark.createDataFrame([[r.get(f) for f in fields] for r in registry], "name string, kind string, domain string, selector string, is_primary boolean, always_relevant boolean, fallback_url string")
    known = known.fillna({"domain": "", "selector": "a[href]", "is_primary": False, "always_relevant": False, "fallback_url": ""})
    first = scratch.stored(parsed(fetch([(r["name"], r["url"]) for r in registry]).join(F.broadcast(known), "name")))  # as many rows as sources
    failed = [(r["name"], r["fallback_url"]) for r in first.where("status IN ('blocked', 'error', 'empty') AND fallback_url <> ''").select("name", "fallback_url").collect()]
    claims = {"kind": F.lit("gnews"), "domain": F.lit(""), "is_primary": F.lit(False), "always_relevant": F.lit(False)}
    spare = scratch.stored(parsed(fetch(failed).join(F.broadcast(known), "name").withColumns(claims)).where("status = 'ok'"))
    used = spare.select("name", F.size("entries").alias("spare_items"))
    health = first.join(used, "name", "left").select(
        F.col("name").alias("source"),
        F.when(F.col("spare_items").isNotNull(), "fallback").otherwise(F.col("status")).alias("status"),
        F.coalesce("spare_items", F.size("entries")).cast("int").alias("items"),
        F.when(F.col("spare_items").isNotNull(), F.concat(F.lit("primary "), "status", F.lit("; used the fallback"))).otherwise(F.col("detail")).alias("detail"),
    )
    cols = ["name", "kind", "is_primary", "always_relevant"]
    items = first.select(*cols, F.explode("entries").alias("e")).unionByName(spare.select(*cols, F.explode("entries").alias("e")))
    return items.select(*cols, "e.*"), health


def page_links(pages: DataFrame, scan: int = 400, keep: int = 40, least: int = 12, selector: str = "a[href]", seen: DataFrame | None = None) -> DataFrame:
    """(url, position, title, link): a page's first links under a selector, of a title long enough, made absolute, http only, new, once each over all pages.

    `scan` selected elements of a page are looked at and `keep` kept. Of a link that several pages have, the page of the least URL keeps it. seen: (url), as it was.
    """
    found = pages.select("url", markup.page("html", selector, scan)["links"].alias("links"))
    rows = found.select("url", F.explode("links").alias("a"))
    rows = rows.select("url", "a.position", F.col("a.label").alias("title"), F.col("a.href").alias("href"), urls.absolute("url", "a.href").alias("link"))
    rows = rows.where((F.col("href") != "") & (F.length("title") >= least) & F.startswith("link", F.lit("http"))).drop("href")
    if seen is not None:
        rows = rows.join(seen.select(F.col("url").alias("link")).distinct(), "link", "left_anti")
    first = rows.groupBy("link").agg(F.min(F.struct("url", "position", "title")).alias("f")).select("f.url", "f.position", "f.title", "link")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("position"))).where(F.col("_n") <= keep).drop("_n")


def unseen(items: DataFrame, seen: DataFrame) -> DataFrame:
    return items.where(X.filled("url") != "").join(seen.select("url"), "url", "left_anti")


def with_fallback(primary: DataFrame, fallback: DataFrame, health: DataFrame) -> DataFrame:
    """The primary sensor's items and, for sources that are blocked, failed or empty, the fallback's without its claims of origin, domain included."""
    bad = health.where(F.col("status").isin("blocked", "error", "empty")).select("source")
    claims = {"is_primary": F.lit(False), "always_relevant": F.lit(False)} | ({"domain": F.lit("")} if "domain" in fallback.columns else {})
    spare = fallback.join(bad, "source", "left_semi").withColumns(claims)
    return primary.unionByName(spare, allowMissingColumns=True)


def first_filled(loaders: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that has rows; the last one if none has."""
    df = None
    for load in loaders:
        df = load()
        if not df.isEmpty():
            return df
    if df is None:
        raise ValueError("no loader")
    return df


def existing_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns by type; those that are missing are null."""
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()])


def snapshot(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """Rows of a nested document {sections: {name: [rows]}}, the name pushed into each row."""
    schema = T.StructType([T.StructField("sections", T.MapType(T.StringType(), T.ArrayType(row)))])
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    return doc.select(F.explode("sections").alias("section", "rows")).select("section", F.explode("rows").alias("r")).select("r.*", "section")


def signature(df: DataFrame) -> str:
    """Of a table's rows in any order."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("s")).first()
    return f"{r.n}:{r.s}"


def write_snapshot(df: DataFrame, path: str) -> bool:
    """Writes unless the table is empty or what is there is the same; tells whether it wrote."""
    if df.isEmpty():
        return False
    spark = df.sparkSession
    try:
        if signature(spark.read.schema(df.schema).json(path)) == signature(df):
            return False
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("overwrite").json(path)
    return True


def write_csv(df: DataFrame, path: str) -> None:
    flat = [F.array_join(c, " | ").alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def sitemap(cases: DataFrame, base: str) -> DataFrame:
    """(value): a line of the site map for each case."""
    return cases.select(F.format_string("<url><loc>%s/cases/%s</loc><lastmod>%s</lastmod></url>", F.lit(base), "slug", "date").alias("value"))


def json_ld(cases: DataFrame) -> DataFrame:
    body = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Report").alias("@type"), F.col("company").alias("about"), F.col("date").alias("datePublished"), F.nullif(F.col("source_url"), F.lit("")).alias("url")))
    return cases.select("id", body.alias("body"))


def documents_registry(items: DataFrame, primary: list[str]) -> DataFrame:
    """(id, url, title, is_primary): an entry of each URL, the first one's title, 500 signs at most."""
    rows = items.where(X.filled("url") != "")
    first = rows.groupBy("url").agg(F.min_by("title", "arrival_idx").alias("title"))
    return first.select(F.md5(F.col("url").cast("binary")).alias("id"), "url", F.left(X.filled("title"), F.lit(500)).alias("title"), X.any_of(F.lower("url"), primary).alias("is_primary"))
