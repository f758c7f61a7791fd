"""Claims against documents: entity, amount and date; trust tiers; evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money
from ..functions import lexicons as L
from ..functions import text as T


def entity_in_text(name: str, text: str) -> Column:
    """Distinctive tokens at word starts: one of one, else at least two and half of them."""
    return tokens_in(T.distinctive_tokens(name), F.concat(F.lit(" "), F.regexp_replace(F.lower(T.filled(text)), "[^a-z0-9_]", " ")))


def tokens_in(toks: Column, low: Column) -> Column:
    n = F.size(toks)
    found = F.size(F.filter(toks, lambda t: F.contains(low, F.concat(F.lit(" "), t))))
    return F.when(n == 0, False).when(n == 1, found >= 1).otherwise(found >= F.greatest(F.lit(2), F.floor((n + 1) / 2)))


def match(rows: DataFrame, least: int = 100, tolerance: float = 0.02) -> DataFrame:
    """rows: company, penalty, date, document. Adds the three matches, verified and strength."""
    long_enough = F.length(T.filled("document")) >= least
    claim = money.largest(money.amounts("penalty"))
    entity = long_enough & tokens_in(F.col("_toks"), F.col("_flat"))
    amount = long_enough & F.col("_claim").isNotNull() & F.exists(money.amounts("document"), lambda a: money.close_to(a, F.col("_claim"), tolerance))
    dated = long_enough & F.coalesce(F.exists(dates.spellings(F.col("_day")), lambda v: F.contains(F.col("_low"), v)), F.lit(False))
    # columns of their own: within a lambda each would be computed anew for every token or spelling
    out = rows.withColumns({"_claim": claim, "_toks": T.distinctive_tokens("company"), "_low": F.lower(T.filled("document")), "_day": dates.as_date("date")})
    out = out.withColumn("_flat", F.concat(F.lit(" "), F.regexp_replace("_low", "[^a-z0-9_]", " "))).withColumns({"entity_matched": entity, "amount_matched": F.coalesce(amount, F.lit(False)), "date_matched": dated})
    verified = F.col("entity_matched") & (F.col("amount_matched") | F.col("date_matched"))
    strength = F.when(F.col("entity_matched") & F.col("amount_matched"), "strong").when(verified, "moderate").otherwise("weak")
    return out.drop("_claim", "_toks", "_low", "_day", "_flat").withColumns({"verified": verified, "strength": strength})


def tier(row_tier: str, official: str, source: str) -> Column:
    """A valid explicit tier, else primary with an official URL, press with any source, ai without."""
    return (
        F.when(F.col(row_tier).isin("primary", "press", "ai"), F.col(row_tier))
        .when(T.filled(official) != "", "primary")
        .when(T.filled(source) != "", "press")
        .otherwise("ai")
    )


def strength_rank() -> Column:
    return F.when(F.col("strength") == "strong", 3).when(F.col("strength") == "moderate", 2).when(F.col("strength") == "weak", 1).otherwise(0)


def best_evidence(evidence: DataFrame) -> DataFrame:
    """The strongest of each action, the first of equals (then by URL)."""
    return evidence.groupBy("action_id").agg(F.min_by(F.struct("url", "strength", "arrival"), F.struct(-strength_rank(), "arrival", "url")).alias("b")).select("action_id", "b.*")


def publishable(auto: bool = False) -> Column:
    return F.lit(auto) & (F.col("trust_tier") == "primary") & (F.col("strength") == "strong")


def source_list(official: str, source: str, listed: str | None = None) -> Column:
    """URLs of a candidate: the official one first, then its source, then the listed ones; blanks go."""
    urls = F.array(T.filled(official), T.filled(source))
    if listed:
        urls = F.concat(urls, F.transform(F.coalesce(F.col(listed), F.array().cast("array<string>")), lambda u: T.filled(u)))
    return F.filter(urls, lambda u: u != "")


def reasons(rows: DataFrame) -> DataFrame:
    """Adds reasons (in order) and excerpt to the columns of `match`; the excerpt prefers the amount's place."""
    short = F.length(T.filled("document")) < 100
    raw = F.get(F.filter(money.amounts("document"), lambda a: money.close_to(a, F.col("_claim"))), F.lit(0))["raw"]
    out = rows.withColumn("_claim", money.largest(money.amounts("penalty"))).withColumn("_raw", raw)
    first = F.get(T.distinctive_tokens("company"), F.lit(0))
    amount = F.when(F.col("amount_matched"), F.concat(F.lit("amount_matched:"), "_raw")).when(F.col("_claim").isNotNull(), "amount_not_found").when(T.filled("penalty") != "", "penalty_not_numeric")
    found = F.array_compact(F.array(F.when(F.col("entity_matched"), "entity_found").otherwise("entity_not_found"), amount, F.when(F.col("date_matched"), "date_matched")))
    near = F.when(F.col("amount_matched"), F.nullif(T.excerpt("document", F.col("_raw")), F.lit("")))
    by_name = F.when(F.col("entity_matched"), T.excerpt("document", first))
    out = out.withColumn("reasons", F.when(short, F.array(F.lit("document_empty_or_too_short"))).otherwise(found))
    return out.withColumn("excerpt", F.when(short, "").otherwise(F.coalesce(near, by_name, F.lit("")))).drop("_claim", "_raw")


def verify(cases: DataFrame, documents: DataFrame, trusted: list[str], listed: str | None = None, lookup: DataFrame | None = None) -> DataFrame:
    """The verification of each case: the first trusted URL of its list, the document there (url, document), the match, tier, note and independent count.

    listed: a column of further URLs (array). lookup: (id, official_url) found by search for cases without a trusted URL. Documents are joined by URL, each of
    which holds one document; cases without a URL take no part in that join.
    """
    from ..functions import urls as U

    rows = cases.withColumn("urls", source_list("official_source_url", "source_url", listed))
    official = F.coalesce(F.get(F.filter("urls", lambda u: T.any_of(u, trusted)), F.lit(0)), F.lit(""))
    rows = rows.withColumn("official_url", official)
    if lookup is not None:
        found = lookup.groupBy("id").agg(F.min("official_url").alias("_found"))
        rows = rows.join(found, "id", "left").withColumn("official_url", F.when(F.col("official_url") == "", T.filled("_found")).otherwise(F.col("official_url"))).drop("_found")
    with_url = rows.where("official_url <> ''").join(documents.withColumnRenamed("url", "official_url"), "official_url", "left")
    rows = with_url.unionByName(rows.where("official_url = ''"), allowMissingColumns=True)
    matched = reasons(match(rows))
    lower = F.when(F.size("urls") > 0, "press").otherwise("ai")
    note = F.when(F.col("official_url") == "", "no_official_source_found").when(T.filled("document") == "", "official_source_unreachable")
    none = note.isNotNull()
    blank = F.array().cast("array<string>")
    return matched.withColumns(
        {
            "trust_tier": F.when(~none & F.col("verified"), "primary").otherwise(lower),
            "note": F.coalesce(note, F.lit("")),
            "independent_sources": U.independent_sources(F.col("urls")),
            "verified": ~none & F.col("verified"),
            "strength": F.when(none, "weak").otherwise(F.col("strength")),
            "reasons": F.when(none, blank).otherwise(F.col("reasons")),
            "excerpt": F.when(none, "").otherwise(F.col("excerpt")),
        }
    )


def summaries(verified: DataFrame) -> DataFrame:
    """A flat row of each verification: tier, official URL, strength (`none` without a document), 400 signs of excerpt, and reasons, or the note in their place."""
    none = F.col("note") != ""
    archived = T.filled("archived_url") if "archived_url" in verified.columns else F.lit("")
    return verified.select(
        "id",
        "trust_tier",
        "official_url",
        "verified",
        F.when(none, "none").otherwise(F.col("strength")).alias("strength"),
        "independent_sources",
        archived.alias("archived_url"),
        F.when(F.col("verified"), F.left(T.filled("excerpt"), F.lit(400))).otherwise("").alias("excerpt"),
        F.when(none, F.array("note")).otherwise(F.col("reasons")).alias("reasons"),
    )


def evidence_rows(verified: DataFrame, cap: int = 10) -> DataFrame:
    """Evidence of the verified cases with an official URL; the first `cap` by arrival are to be archived (a top-k, joined back by broadcast)."""
    good = verified.where(F.col("verified") & (T.filled("official_url") != ""))
    first = good.orderBy("arrival_idx").limit(cap).select("id", F.lit(True).alias("archive"))
    rows = good.join(F.broadcast(first), "id", "left")
    return rows.select(F.col("id").alias("action_id"), "official_url", F.sha2(F.col("document").cast("binary"), 256).alias("content_hash"), F.left("excerpt", F.lit(1000)).alias("excerpt"), "strength", F.coalesce("archive", F.lit(False)).alias("archive"))


def resolution_patch(cases: DataFrame, results: DataFrame, words: list[str]) -> DataFrame:
    """The cases checked, with outcome, notes and official URL changed where search results speak of a resolution. results: (id, rank, title, summary, url), few a case.

    Titles and summaries of a case are read together, 2,500 signs of them; the official URL is the first result's of a trusted domain, or empty.
    Every checked case is stamped; those without a resolution keep what they have.
    """
    trusted = T.any_of(T.filled("url"), L.TRUSTED_DOMAINS)
    said = F.struct("rank", F.concat_ws(" ", T.filled("title"), T.filled("summary")).alias("said"))
    found = results.groupBy("id").agg(F.array_sort(F.collect_list(said)).alias("said"), F.min_by(F.when(trusted, F.col("url")), F.when(trusted, F.col("rank"))).alias("official"))
    low = F.lower(F.left(F.array_join(F.transform("said", lambda x: x["said"]), " "), F.lit(2500)))
    hit = F.coalesce(T.any_of(low, words), F.lit(False))
    changed = lambda new, old: F.when(hit, new).otherwise(old)
    return cases.join(found, "id", "left").select(
        "id",
        changed(F.lit("Fine Imposed"), F.col("outcome")).alias("outcome"),
        changed(F.lit(L.AUTO_RESOLVED), F.lit("")).alias("notes"),
        changed(T.filled("official"), F.col("official_source_url")).alias("official_source_url"),
        F.lit(True).alias("stamped"),
    )
