"""Search channels: what became of each result, what a run did, and what may be said of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.bound import bound

# Outcomes of a run that was stopped before its end.
STOPPED = ["budget_exhausted", "rate_limited", "unavailable"]

RUN = ["case_id", "run"]


def judged(results: DataFrame, stored: DataFrame) -> DataFrame:
    """`results` (case_id, run, seq, url, ..) with `key` and `disposition`: `rejected` where the
    address isn't a safe public one or belongs to a noise host, `seen` where the case has the page
    (`stored`: case_id, key), `stored` for the first result of a page in its case by `seq`, else
    `duplicate`. A rejected result has no key."""
    known_site = lambda a: urls.shape(a).isin("social", "publication")
    # The address is made once a row, however often the rules name it.
    page = bound(urls.public_address(F.col("url")), lambda a: F.when(~urls.is_noise(a), F.when(known_site(a), urls.website(a)).otherwise(a)))
    keyed = results.withColumn("key", page)
    good = keyed.filter("key IS NOT NULL").groupBy("case_id", "key").agg(F.min("seq").alias("__first"))
    known = stored.select("case_id", "key").distinct().withColumn("__known", F.lit(True))
    pages = good.join(known, ["case_id", "key"], "left")
    marked = keyed.join(pages, ["case_id", "key"], "left")
    what = F.when(F.col("key").isNull(), "rejected").when(F.col("__known"), "seen").when(F.col("seq") == F.col("__first"), "stored").otherwise("duplicate")
    return marked.withColumn("disposition", what).drop("__first", "__known")


def accounts(runs: DataFrame, searches: DataFrame, marked: DataFrame) -> DataFrame:
    """`runs` (case_id, run, provider, configured, planned, outcome) with what each did.

    `searches`: a row (case_id, run, query, failed) for each search that the provider tried;
    `marked`: rows of `judged` with `snippet`, null where the provider gave no description. A page
    that the case or the run has already counts as a duplicate. A search without results still ran.
    """
    ok = ~F.coalesce(F.col("failed"), F.lit(False))
    tried = searches.groupBy(*RUN).agg(F.count_if(ok).alias("queries_run"), F.count_distinct(F.when(ok, F.col("query"))).alias("distinct_queries"), F.count_if(~ok).alias("failures"))
    is_ = lambda *names: F.col("disposition").isin(*names)
    got = marked.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("results_seen"),
        F.count_if(is_("stored")).alias("results_stored"),
        F.count_if(is_("duplicate", "seen")).alias("duplicates"),
        F.count_if(is_("rejected")).alias("rejected_urls"),
        F.count_if(is_("stored") & F.col("snippet").isNull()).alias("low_context_results"),
    )
    counts = [c for part in (tried, got) for c in part.columns if c not in RUN]
    return runs.join(tried, RUN, "left").join(got, RUN, "left").na.fill(0, counts)


def coverage(accounted: DataFrame) -> DataFrame:
    """Rows of `accounts` with `state` and `partial`. Only a run that wasn't stopped and ran a search
    may say that nothing matched; a stopped one with results is partial."""
    stopped = F.coalesce(F.col("outcome").isin(STOPPED), F.lit(False))
    ran, stored = F.col("queries_run") > 0, F.col("results_stored") > 0
    idle = F.when(stopped, "SKIPPED").when(F.col("failures") > 0, "FAILED").otherwise("NOT_SEARCHED")
    done = F.when(stored, "FOUND").when(stopped, "SKIPPED").otherwise("NO_MATCH_RETURNED")
    state = F.when(~F.coalesce(F.col("configured"), F.lit(False)), "PROVIDER_NOT_CONFIGURED").when(ran, done).otherwise(idle)
    return accounted.select("*", state.alias("state"), (F.col("configured") & ran & stopped).alias("partial"))


# Ways a record came into a case, strongest first; keys that a supplied value is
# matched by; sources by who publishes them; standings of a contact, best first.
ROUTES = ["supplied_anchor", "published_link", "api_record", "handle_check", "manual_import", "provider_search", "name_search"]
SUPPLIED_KEYS = ["github_username", "username", "profile_url"]
SELF_PUBLISHED = ["github", "github_people", "person_usernames"]
PROFESSIONAL = ["crossref", "openalex", "orcid", "wikidata"]
STANDINGS = ["VERIFIED_PUBLIC_BUSINESS", "PUBLIC_PROFESSIONAL", "PUBLIC_SELF_PUBLISHED", "UNVERIFIED_PUBLIC_REFERENCE"]


def route(data: Column, source: Column) -> Column:
    """How a record came into its case, by what its payload (VARIANT) says, else by its source."""
    named = F.coalesce(source, F.lit(""))

    def ladder(payload: Column) -> Column:
        text = lambda name: F.coalesce(F.try_variant_get(payload, f"$.{name}", "string"), F.lit(""))
        by = F.coalesce(F.try_variant_get(payload, "$.corroborated_by", "array<string>"), F.array().cast("array<string>"))
        return (
            F.when((text("access") == "reference_only") | (text("signal") == "SAME_USERNAME"), "supplied_anchor")
            .when(text("evidence") == "profile_exists_for_supplied_handle", "handle_check")
            .when(named == "manual_search_recon", "manual_import")
            .when(named == "provider_search", "provider_search")
            .when(F.exists(by, lambda key: F.coalesce(key.isin(SUPPLIED_KEYS), F.lit(False))), "supplied_anchor")
            .when(named.isin(PROFESSIONAL), "api_record")
            .otherwise("name_search")
        )

    return bound(data, ladder)


def routes_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, strongest, routes): all `route`s of each group, the strongest first; unknown ones come
    last, by name. Null and blank routes are none."""
    named = rows.filter("route <> ''")
    place = F.array_position(F.array(*map(F.lit, ROUTES)), F.col("route"))
    # At most one row for each route of a group is kept while it is gathered.
    ranked = F.array_sort(F.collect_set(F.struct(F.when(place > 0, place).otherwise(len(ROUTES) + 1).alias("rank"), "route")))
    return named.groupBy(*keys).agg(ranked.alias("__r")).select(*keys, F.element_at("__r.route", 1).alias("strongest"), F.col("__r.route").alias("routes"))


def standing(source: Column) -> Column:
    """How well a published contact is established: by its source, never by what it looks like."""
    return F.when(source.isin(SELF_PUBLISHED), "PUBLIC_SELF_PUBLISHED").when(source.isin(PROFESSIONAL), "PUBLIC_PROFESSIONAL").otherwise("UNVERIFIED_PUBLIC_REFERENCE")


def standing_rank(value: Column) -> Column:
    """Place of a standing in a list of contacts, 0 for the best; unknown ones come last."""
    place = F.array_position(F.array(*map(F.lit, STANDINGS)), value)
    return F.when(place > 0, place - 1).otherwise(9).cast("int")
