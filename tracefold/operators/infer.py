"""Inferred links between accounts, agreements between sources, and whether sources are independent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from .tables import materialize

# Source, identifier, authoritative, what it ingests.
LINEAGE = [
    ("orcid", "orcid", True, []),
    ("orcid", "doi", False, ["crossref"]),
    ("orcid", "github_login", True, []),
    ("crossref", "doi", True, []),
    ("openalex", "doi", False, ["crossref"]),
    ("openalex", "orcid", False, ["orcid", "crossref"]),
    ("openalex", "openalex", True, []),
    ("openalex", "wikidata", False, ["wikidata"]),
    ("wikidata", "wikidata", True, []),
    ("wikidata", "orcid", False, ["orcid"]),
    ("wikidata", "doi", False, ["crossref"]),
    ("wikidata", "github_login", False, ["github", "github_people"]),
    ("github", "github_login", True, []),
    ("github_people", "github_login", True, ["github"]),
]
# Sources that only pass on what others say.
RELAYS = ["provider_search", "anthropic_web_search", "google_wss", "manual_search_recon", "search", "http_meta", "wayback"]
RULINGS = ["INDEPENDENT", "DEPENDENT", "UNKNOWN"]


def lineage_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LINEAGE, "source string, identifier string, authoritative boolean, ingests array<string>")


def handle_groups(accounts: DataFrame, least: int = 4, distinctive: int = 6) -> DataFrame:
    """Accounts of one case that carry one handle on several platforms: (case_id, handle, accounts,
    platforms, rule_key). `accounts`: (case_id, key, handle, platform).

    Linear in the accounts: a popular handle is one row, however many accounts share it. Its pairs
    are those of accounts on different platforms."""
    named = accounts.withColumn("handle", F.lower("handle")).filter(F.length("handle") >= least)
    rule = F.when(F.length("handle") >= distinctive, "same_unique_username").otherwise("same_common_username")
    per = named.groupBy("case_id", "handle", "platform").agg(F.count_distinct("key").alias("n"))
    grouped = per.groupBy("case_id", "handle").agg(F.sum("n").alias("accounts"), F.count(F.lit(1)).alias("platforms"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return grouped.filter("platforms > 1").select("case_id", "handle", "accounts", "platforms", ((F.col("accounts") * F.col("accounts") - F.col("same")) / 2).cast("long").alias("pairs"), rule.alias("rule_key"))


def handle_links(accounts: DataFrame, least: int = 4, distinctive: int = 6) -> DataFrame:
    """The links of `handle_groups`, one an account: (case_id, handle, a, b, rule_key), where `a` is
    the first account of the handle, or for those of its platform the first one of another platform.
    An account's other links follow from the handle that it shares with all of the group."""
    named = accounts.withColumn("handle", F.lower("handle")).filter(F.length("handle") >= least).select("case_id", "handle", "key", "platform").distinct()
    rule = F.when(F.length("handle") >= distinctive, "same_unique_username").otherwise("same_common_username")
    per = named.groupBy("case_id", "handle", "platform").agg(F.min("key").alias("key"))
    firsts = per.groupBy("case_id", "handle").agg(F.min(F.struct("key", "platform")).alias("first"))
    other = per.join(firsts, ["case_id", "handle"]).filter("platform <> first.platform").groupBy("case_id", "handle", "first").agg(F.min("key").alias("other"))
    both = named.join(other, ["case_id", "handle"])
    own = F.when(F.col("platform") == F.col("first.platform"), F.col("other")).otherwise(F.col("first.key"))
    # The first account of the other platforms is linked from the first one of all already.
    return both.filter("key <> first.key").select("case_id", "handle", own.alias("a"), F.col("key").alias("b"), rule.alias("rule_key"))


def site_members(links: DataFrame, accounts: DataFrame) -> DataFrame:
    """(case_id, site, account, handle): each account that links a site, or that a site links, once,
    with its handle in lower case. `links`: (case_id, src, dst) of accounts and sites; `accounts`:
    (case_id, account, handle), where handles may be null."""
    ends = links.select("case_id", F.explode(F.array(F.struct(F.col("src").alias("account"), F.col("dst").alias("site")), F.struct(F.col("dst").alias("account"), F.col("src").alias("site")))).alias("e")).select("case_id", "e.account", "e.site")
    # Repeats go by hash, and ahead of the least handle, which Spark finds by a sort.
    handles = accounts.select("case_id", "account", F.nullif(F.lower(F.trim("handle")), F.lit("")).alias("handle")).distinct().repartition("case_id", "account")
    named = handles.groupBy("case_id", "account").agg(F.min("handle").alias("handle"))
    # Ends that are no account go before repeats do. What is left is dealt by site and account, so that
    # the join may split an account of very many sites, and no site comes into one task.
    return ends.join(named.hint("shuffle_hash"), ["case_id", "account"]).select("case_id", "site", "account", "handle").repartition("case_id", "site", "account").distinct()


def _classes(members: DataFrame) -> DataFrame:
    """Accounts of a site by handle; one without a handle is a class of its own."""
    alone = F.when(F.col("handle").isNull(), F.col("account"))
    return members.withColumn("alone", alone).groupBy("case_id", "site", "handle", "alone").agg(F.count(F.lit(1)).alias("n"), F.min("account").alias("first"))


def site_groups(members: DataFrame) -> DataFrame:
    """Sites of several accounts: (case_id, site, accounts, classes, same_pairs, other_pairs), the
    pairs with one handle (rule `same_username_shared_website`) and with two (`shared_infrastructure`).
    Linear in the members: pairs are counted from the classes' sizes."""
    n = F.col("n")
    by = _classes(members).groupBy("case_id", "site").agg(F.sum("n").alias("accounts"), F.count(F.lit(1)).alias("classes"), F.sum(n * n).alias("squares"))
    pairs = lambda x: (x / 2).cast("long")
    return by.filter("accounts > 1").select("case_id", "site", "accounts", "classes", pairs(F.col("squares") - F.col("accounts")).alias("same_pairs"), pairs(F.col("accounts") * F.col("accounts") - F.col("squares")).alias("other_pairs"))


def site_links(members: DataFrame, whole: int = 100_000) -> DataFrame:
    """Representative edges of those pairs: (case_id, site, a, b, rule_key). Each account is linked
    to the first one of its class, each class's first to the first one of the site; with the
    membership they tell all pairs, and there are no more of them than members.

    A site of at most `whole` members is sorted once, within one task; those of more go by way of
    their classes, so that no site passes through one task."""
    keys = ["case_id", "site"]
    known = members.dropna(subset=[*keys, "account"])  # what is null joins nothing, so no sort may link it
    members = materialize(known, "members")  # read to count, then to link
    large = materialize(members.groupBy(*keys).count().filter(F.col("count") > whole).select(*keys), "large-sites")
    return _links_by_sort(members.join(F.broadcast(large), keys, "left_anti")).unionByName(_links_by_class(members.join(F.broadcast(large), keys, "left_semi")))


def _links_by_sort(members: DataFrame) -> DataFrame:
    # Both windows take one order; sites come first in it, as their first bytes tell most rows apart.
    site, own = Window.partitionBy("site", "case_id"), Window.partitionBy("site", "case_id", "handle").orderBy("account")
    rows = members.repartition("site", "case_id").withColumn("first", F.first("account").over(own)).withColumn("top", F.min("account").over(site))
    alike = F.col("handle").isNotNull() & (F.col("account") != F.col("first"))
    links = rows.select("case_id", "site", F.when(alike, F.col("first")).otherwise(F.col("top")).alias("a"), F.col("account").alias("b"), F.when(alike, "same_username_shared_website").otherwise("shared_infrastructure").alias("rule_key"))
    return links.filter("a <> b")


def _links_by_class(members: DataFrame) -> DataFrame:
    keys = ["case_id", "site"]
    classes = _classes(members)
    alike = members.filter("handle IS NOT NULL").join(classes.filter("n > 1").select(*keys, "handle", "first"), [*keys, "handle"]).filter("account <> first")
    alike = alike.select(*keys, F.col("first").alias("a"), F.col("account").alias("b"), F.lit("same_username_shared_website").alias("rule_key"))
    top = classes.groupBy(*keys).agg(F.min("first").alias("a"))
    unlike = classes.join(top, keys).filter("first <> a").select(*keys, "a", F.col("first").alias("b"), F.lit("shared_infrastructure").alias("rule_key"))
    return alike.unionByName(unlike)


def shared_sites(edges: DataFrame, is_site: Column) -> DataFrame:
    """(site, accounts): accounts that link a site, in either direction. `edges`: (src, dst)."""
    both = edges.select(F.col("src").alias("account"), F.col("dst").alias("site")).unionByName(edges.select(F.col("dst").alias("account"), F.col("src").alias("site")))
    return both.filter(is_site).distinct().groupBy("site").agg(F.count(F.lit(1)).alias("accounts"), F.min("account").alias("first_account")).filter("accounts > 1")


def not_linked(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b, type) without an edge (a, b, type) in either direction."""
    least, most = F.least("a", "b"), F.greatest("a", "b")
    return pairs.withColumns({"x": least, "y": most}).join(edges.select("type", least.alias("x"), most.alias("y")).distinct(), ["type", "x", "y"], "left_anti").drop("x", "y")


# Kinds of identifiers whose agreement across sources says something.
CORROBORATING = ["orcid", "doi", "github_login", "wikidata", "openalex"]


def identifying(claims: DataFrame) -> DataFrame:
    """Claims of the kinds that may corroborate, values without outer white space and in lower case;
    null and blank ones are left out."""
    value = F.lower(F.regexp_replace("value", r"^\s+|\s+$", ""))
    return claims.filter(F.col("identifier").isin(CORROBORATING)).withColumn("value", value).filter("value <> ''")


def agreements(claims: DataFrame) -> DataFrame:
    """Identifiers that several records of a case share: `claims` (case_id, record, source,
    identifier, value, imported_from array) as (case_id, identifier, value, sources, records).
    A source's imports are the union over its records."""
    each = identifying(claims).withColumn("imported", F.explode_outer("imported_from"))
    said = each.groupBy("case_id", "identifier", "value", "source").agg(F.count_distinct("record").alias("n"), F.array_sort(F.collect_set("imported")).alias("imported_from"))
    return said.groupBy("case_id", "identifier", "value").agg(F.sum("n").alias("records"), F.array_sort(F.collect_list(F.struct("source", "imported_from"))).alias("sources")).filter("records > 1")


def rulings(agreed: DataFrame, lineage: DataFrame) -> DataFrame:
    """A ruling on each pair of sources of an agreement, in the fixed order of the rules. Sources are
    few (the bounded lineage table names them), so pairs are made within an agreement's row; one
    source with several records is a pair with itself."""
    known = lineage.select("identifier", F.struct("source", "authoritative", "ingests").alias("fact")).groupBy("identifier").agg(F.collect_list("fact").alias("facts"))
    n = F.size("sources")
    left = agreed.join(F.broadcast(known), "identifier", "left").select("case_id", "identifier", "value", "facts", "sources", F.posexplode("sources").alias("i", "a"))
    pairs = left.withColumn("others", F.when(n == 1, F.col("sources")).otherwise(F.expr("slice(sources, i + 2, size(sources))"))).select("case_id", "identifier", "value", "facts", "a", F.explode("others").alias("b"))

    def fact(side: str, field: str, default: Column) -> Column:
        own = F.filter(F.coalesce("facts", F.array().cast("array<struct<source:string,authoritative:boolean,ingests:array<string>>>")), lambda f: f["source"] == F.col(f"{side}.source"))
        return F.coalesce(F.try_element_at(own, F.lit(1))[field], default)

    none = F.array().cast("array<string>")
    ia, ib = fact("a", "ingests", none), fact("b", "ingests", none)
    pairs = pairs.withColumns({"ia": ia, "ib": ib, "both": fact("a", "authoritative", F.lit(False)) & fact("b", "authoritative", F.lit(False))})
    sa, sb = F.col("a.source"), F.col("b.source")
    dependent = (sa == sb) | F.array_contains("a.imported_from", sb) | F.array_contains("b.imported_from", sa) | F.array_contains("ib", sa) | F.array_contains("ia", sb) | F.arrays_overlap("ia", "ib")
    ruling = F.when(dependent, "DEPENDENT").when(sa.isin(RELAYS) | sb.isin(RELAYS), "UNKNOWN").when(F.col("both"), "INDEPENDENT").otherwise("UNKNOWN")
    return pairs.select("case_id", "identifier", "value", sa.alias("first"), sb.alias("second"), ruling.alias("ruling"))


def best_rulings(ruled: DataFrame) -> DataFrame:
    """The best ruling of each agreement; of equal ones the first pair by name."""
    rank = F.array_position(F.array(*map(F.lit, RULINGS)), F.col("ruling"))
    return ruled.groupBy("case_id", "identifier", "value").agg(F.min(F.struct(rank.alias("rank"), "ruling", "first", "second")).alias("b")).select("case_id", "identifier", "value", "b.ruling", "b.first", "b.second")


def agreement_list(best: DataFrame) -> DataFrame:
    """(case_id, identifier, value, status, sources): CORROBORATED where the best ruling is
    independent, else SHARED, of the sources that it is about; corroborations first."""
    status = F.when(F.col("ruling") == "INDEPENDENT", "CORROBORATED").otherwise("SHARED")
    pair = F.when(F.col("first") == F.col("second"), F.array("first")).otherwise(F.array("first", "second"))
    return best.select("case_id", "identifier", "value", status.alias("status"), pair.alias("sources")).orderBy("case_id", "status", "identifier", "value")


def strengthened(signals: DataFrame, corroborated: DataFrame, keys: list[str]) -> DataFrame:
    """`signals` (keys, rule_key) with `independent_corroboration` for corroborated keys that have a
    signal; doing it again changes nothing."""
    more = signals.select(*keys).distinct().join(corroborated.select(*keys).distinct(), keys, "left_semi").withColumn("rule_key", F.lit("independent_corroboration"))
    return signals.select(*keys, "rule_key").unionByName(more).distinct()


def written_back(records: DataFrame, edges: DataFrame, claims: DataFrame, lineage: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and edges after what their claims agree on.

    `records`: (case_id, record, signal_keys array, score); `edges`: (case_id, src, dst, type, score);
    `claims` as for `agreements`. A record with an independent agreement is scored anew from the keys
    recorded on it, `same_person_name` where none is, and `independent_corroboration`; other records
    keep their score. Edges of type POSSIBLY_SAME_ENTITY to such a record rise to its score, none
    falls. Bands follow the scores. An agreement that isn't independent is listed and scores nothing.
    Doing it again changes nothing: the recorded keys stay as they were.

    Returns records with score, band, corroborating_sources and shared_identifiers (identifier,
    value, sources, independence), and edges with score and band.
    """
    best = best_rulings(rulings(agreements(claims), lineage))
    keys = ["case_id", "identifier", "value"]
    pair = F.when(F.col("first") == F.col("second"), F.array("first")).otherwise(F.array("first", "second"))
    held = identifying(claims).select(*keys, "record").distinct().join(best.withColumn("sources", pair), keys)
    sure = F.col("ruling") == "INDEPENDENT"
    entry = F.struct("identifier", "value", "sources", F.col("ruling").alias("independence"))
    # A record's identifiers are few; a value that very many records share is one row of `best`.
    of = held.groupBy("case_id", "record").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(sure, F.col("sources")))))).alias("corroborating_sources"), F.array_sort(F.collect_set(F.when(~sure, entry))).alias("shared_identifiers"))
    known = F.coalesce(F.col("signal_keys"), F.array(F.lit("same_person_name")))
    own = records.join(of.filter(F.size("corroborating_sources") > 0).select("case_id", "record"), ["case_id", "record"], "left_semi")
    signals = own.select("case_id", "record", F.explode(F.concat(known, F.array(F.lit("independent_corroboration")))).alias("rule_key"))
    lifted = scoring.score_groups(signals, ["case_id", "record"], rules).select("case_id", "record", F.col("score").alias("__new"))
    marked = records.join(of, ["case_id", "record"], "left").join(lifted, ["case_id", "record"], "left")
    marked = marked.withColumns({"score": F.coalesce("__new", "score"), "corroborating_sources": F.coalesce("corroborating_sources", F.array().cast("array<string>")), "shared_identifiers": F.coalesce("shared_identifiers", F.array().cast("array<struct<identifier:string,value:string,sources:array<string>,independence:string>>"))})
    target = lifted.select("case_id", F.col("record").alias("dst"), "__new")
    raised = F.when((F.col("type") == "POSSIBLY_SAME_ENTITY") & F.col("__new").isNotNull(), F.greatest("score", "__new")).otherwise(F.col("score"))
    risen = edges.join(target, ["case_id", "dst"], "left").withColumn("score", raised)
    band = scoring.band(F.col("score"))
    return marked.withColumn("band", band).drop("__new"), risen.withColumn("band", band).drop("__new")
