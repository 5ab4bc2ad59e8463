"""Normalisers of stored payloads: JSON of public sources as rows of findings.

Each takes a DataFrame with a `payload` JSON column and returns typed rows; what doesn't parse is
left to `quarantine`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

# Statuses worth a note, dates by event, privacy services' words, security headers.
NOTABLE_STATUS = ["client hold", "client transfer prohibited", "pending delete", "redemption period", "server hold", "server transfer prohibited"]
REGISTRATION_DATES = {"registered": "registration", "expires": "expiration", "changed": "last changed", "transferred": "transfer"}
PRIVACY_WORDS = "(?i)redacted|privacy|not disclosed|data protected|withheld|whoisguard|domains by proxy"
SECURITY_HEADERS = ["strict-transport-security", "content-security-policy", "x-content-type-options", "x-frame-options", "referrer-policy", "permissions-policy", "cross-origin-opener-policy"]
REGISTRY: dict[str, object] = {}


def register_normalizer(kind: str):
    """Adds a normaliser (DataFrame -> DataFrame) for a kind of payload."""

    def add(f):
        REGISTRY[kind] = f
        return f

    return add


def quarantine(payloads: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Payloads that parse as `schema` with the parsed column `p`, and the others with the reason."""
    tried = payloads.withColumn("p", F.from_json("payload", schema))
    bad = F.col("payload").isNull() | F.col("p").isNull() | F.expr("try_parse_json(payload)").isNull()
    why = F.when(F.col("payload").isNull() | (F.col("payload") == ""), "empty").otherwise("malformed")
    return tried.filter(~bad), tried.filter(bad).select(*payloads.columns, why.alias("error_type"))


@register_normalizer("dns")
def dns(payloads: DataFrame) -> DataFrame:
    """One row for each host and record type with what the type says."""
    good, _ = quarantine(payloads, "struct<hostname:string,type:string,records:array<string>,ttl:int>")
    rows = good.select("p.*").groupBy("hostname", "type").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("records")))).alias("records"), F.max("ttl").alias("ttl")).filter(F.size("records") > 0)
    last = F.transform("records", lambda r: F.regexp_replace(F.element_at(F.split(F.trim(r), " +"), -1), r"\.$", ""))
    hosts = F.array_sort(F.array_distinct(F.filter(last, lambda h: h != "")))
    is_mx, is_ns, is_txt = (F.col("type") == t for t in ("MX", "NS", "TXT"))
    return rows.select(
        "hostname", F.col("type").alias("record_type"), "records", "ttl",
        F.when(is_mx, hosts).alias("mail_hosts"),
        F.when(is_mx, F.array_contains(last, "") & (F.size(hosts) == 0)).alias("null_mx"),
        F.when(is_ns, hosts).alias("nameservers"),
        F.when(is_txt, F.exists("records", lambda r: F.lower(r).startswith("v=spf1"))).alias("has_spf"),
        F.when(is_txt, F.exists("records", lambda r: F.lower(r).startswith("v=dmarc1"))).alias("has_dmarc"),
        F.concat(F.lit("dns:"), "hostname", F.lit(":"), "type").alias("dedupe_key"),
    )


def _items(value: Column, path: str, kind: str = "variant") -> Column:
    return F.coalesce(F.try_variant_get(value, path, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def _card_value(card: Column, name: str) -> Column:
    """The first text of a property in a contact card's list of (name, parameters, type, value), where
    the value may be a list of parts."""

    def text(entry: Column) -> Column:
        parts = F.filter(F.transform(F.try_variant_get(entry, "$[3]", "array<variant>"), lambda p: F.try_variant_get(p, "$", "string")), lambda p: p != "")
        return F.trim(F.coalesce(F.array_join(parts, " "), F.try_variant_get(entry, "$[3]", "string")))

    own = F.filter(card, lambda entry: F.try_variant_get(entry, "$[0]", "string") == name)
    return F.try_element_at(F.filter(F.transform(own, text), lambda t: t != ""), F.lit(1))


def _parties(document: Column) -> Column:
    """The entities of a document, and those below them, as (roles, name, organisation, handle,
    redacted)."""
    top = _items(document, "$.entities")
    below = lambda some: F.flatten(F.transform(some, lambda e: _items(e, "$.entities")))

    def party(e: Column) -> Column:
        card = _items(e, "$.vcardArray[1]")
        remarks = F.transform(_items(e, "$.remarks"), lambda r: F.lower(F.try_variant_get(r, "$.title", "string")))
        return F.struct(
            F.transform(_items(e, "$.roles", "string"), F.lower).alias("roles"),
            _card_value(card, "fn").alias("name"),
            _card_value(card, "org").alias("organisation"),
            F.try_variant_get(e, "$.handle", "string").alias("handle"),
            F.exists(remarks, lambda t: F.coalesce(t.contains("redacted"), F.lit(False))).alias("redacted"),
        )

    return F.transform(F.concat(top, below(top), below(below(top))), party)


@register_normalizer("registration")
def registration(payloads: DataFrame) -> DataFrame:
    """Registration data of JSON documents, read as VARIANT: dates by event, statuses, name servers,
    registrar, and the registrant unless a privacy service or a remark hides it. Of a contact card the
    name and the organisation are read, nothing else. What is no JSON object makes no row; parts of
    another type than expected count as missing."""
    rows = payloads.select(F.try_parse_json("payload").alias("v")).filter(F.try_variant_get("v", "$", "map<string,variant>").isNotNull())
    v = F.col("v")
    text = lambda path: F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))
    status = F.filter(F.transform(_items(v, "$.status", "string"), F.lower), lambda s: s != "")
    servers = F.transform(_items(v, "$.nameservers"), lambda n: F.regexp_replace(F.lower(F.try_variant_get(n, "$.ldhName", "string")), r"\.+$", ""))
    rows = rows.select(
        F.coalesce(text("$.ldhName"), text("$.handle"), text("$.name")).alias("handle"),
        F.transform(_items(v, "$.events"), lambda e: F.struct(F.lower(F.try_variant_get(e, "$.eventAction", "string")).alias("action"), F.nullif(F.try_variant_get(e, "$.eventDate", "string"), F.lit("")).alias("date"))).alias("events"),
        status.alias("statuses"), F.array_sort(F.array_distinct(F.filter(servers, lambda n: n != ""))).alias("nameservers"), _parties(v).alias("parties"),
    )
    last = lambda test: F.element_at(F.filter("parties", test), -1)
    has = lambda p, role: F.array_contains(p["roles"], role)
    stated = lambda p: F.coalesce(p["organisation"], p["name"])
    hides = lambda p: F.coalesce(stated(p).rlike(PRIVACY_WORDS), F.lit(False))
    date = lambda action: F.to_date(F.try_to_timestamp(F.try_element_at(F.filter("events", lambda e: (e["action"] == action) & e["date"].isNotNull()), F.lit(-1))["date"]))
    any_of = lambda test: F.size(F.filter("parties", test)) > 0
    hidden = any_of(lambda p: p["redacted"] | (has(p, "registrant") & hides(p)))
    registrar = F.when(any_of(lambda p: has(p, "registrar")), last(lambda p: has(p, "registrar")))
    owner = F.when(any_of(lambda p: has(p, "registrant") & ~hides(p)), last(lambda p: has(p, "registrant") & ~hides(p)))
    return rows.select(
        F.lower("handle").alias("domain"), *(date(action).alias(name) for name, action in REGISTRATION_DATES.items()), "statuses",
        F.array_sort(F.array_intersect("statuses", F.array(*map(F.lit, NOTABLE_STATUS)))).alias("notable_status"), "nameservers",
        F.coalesce(registrar["name"], registrar["handle"]).alias("registrar"), F.when(~hidden, stated(owner)).alias("registrant"), hidden.alias("privacy_service"),
    )


def hostnames(certificates: DataFrame) -> DataFrame:
    """(base, host): names of certificates that end in their base domain."""
    names = certificates.select("base", F.explode(F.split(F.regexp_replace("name_value", ",", "\n"), "\n")).alias("host"))
    names = names.withColumn("host", F.regexp_replace(F.lower(F.trim("host")), r"^\*\.", ""))
    return names.filter((F.col("host") == F.col("base")) | F.endswith(F.col("host"), F.concat(F.lit("."), F.col("base")))).distinct()


def subdomains(certificates: DataFrame, most: int = 300) -> DataFrame:
    """(base, host) of the names below a base domain that its certificates cover, the first `most` of
    each base by name; the base itself is none."""
    below = hostnames(certificates).filter(F.col("host") != F.col("base"))
    rank = F.row_number().over(Window.partitionBy("base").orderBy("host"))
    return below.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def issuer_name(dn: Column) -> Column:
    """The organisation of a distinguished name, else its common name."""
    org, name = (F.trim(F.regexp_extract(dn, rf'(?:^|,)\s*{k}=(?:"([^"]*)"|([^,]*))', g)) for k, g in (("O", 2), ("CN", 2)))
    quoted = F.regexp_extract(dn, r'(?:^|,)\s*O="([^"]*)"', 1)
    return F.when(quoted != "", quoted).when(org != "", org).otherwise(F.nullif(name, F.lit("")))


@register_normalizer("certificates")
def certificates(rows: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """The latest `most` certificates of each base domain (by start, then id), and a summary of all
    of them. `rows`: (base, id, issuer_name, name_value, not_before)."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("base").orderBy(F.desc("not_before"), "id")))
    named = rows.withColumn("issuer", issuer_name(F.col("issuer_name")))
    by = named.groupBy("base", "issuer").agg(F.count(F.lit(1)).alias("n"), F.min("not_before").alias("first"))
    total = by.groupBy("base").agg(F.sum("n").alias("certificates"), F.count(F.lit(1)).alias("issuers"), F.min("first").alias("earliest"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "issuer"))), lambda x: F.concat(x["issuer"], F.lit("="), -x["less"])).alias("by_issuer"))
    hosts = hostnames(rows).groupBy("base").agg(F.count(F.lit(1)).alias("hosts"))
    return ranked.filter(F.col("rank") <= most), total.join(hosts, "base", "left")


def snapshot_times(rows: DataFrame) -> DataFrame:
    """`rows` (host, stamp of 4 to 14 digits, original) with `at`, the stamp filled up to a time; those
    without one are left out."""
    at = F.try_to_timestamp(F.concat("stamp", F.substring(F.lit("00000101000000"), F.length("stamp") + 1, 14)), F.lit("yyyyMMddHHmmss"))
    return rows.withColumn("at", at).filter("at IS NOT NULL")


@register_normalizer("archive_index")
def archive_index(rows: DataFrame) -> DataFrame:
    """First snapshot and coverage of each host. `rows`: as for `snapshot_times`."""
    dated = snapshot_times(rows)
    return dated.groupBy("host").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("snapshots"), F.count_distinct("original").alias("urls"), F.array_sort(F.collect_set(F.year("at"))).alias("years"), F.min_by("original", F.struct("at", "original")).alias("first_url"))


def latest_snapshots(rows: DataFrame, most: int = 5) -> DataFrame:
    """(host, at, original, rank): the latest snapshots of each host, the newest first."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("at"), "original"))
    return snapshot_times(rows).select("host", "at", "original", rank.alias("rank")).filter(F.col("rank") <= most)


@register_normalizer("http")
def http_metadata(responses: DataFrame) -> DataFrame:
    """Title, description and security headers of responses (url, headers map, html)."""
    names = F.transform(F.map_keys("headers"), F.lower)
    wanted = F.array(*map(F.lit, SECURITY_HEADERS))
    present = F.array_intersect(wanted, names)
    return responses.select(
        "url", urls.host(F.col("url")).alias("hostname"),
        F.trim(F.substring(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), 1, 300)).alias("title"),
        F.nullif(F.regexp_extract("html", r'(?is)<meta\s+name="description"\s+content="([^"]*)"', 1), F.lit("")).alias("description"),
        present.alias("present"), F.array_except(wanted, names).alias("missing"), F.round(F.size(present) / len(SECURITY_HEADERS), 2).alias("score"),
    )


@register_normalizer("repositories")
def repositories(payloads: DataFrame, most: int = 100) -> DataFrame:
    """Public repositories of lists, the latest `most` of each owner."""
    good, _ = quarantine(payloads, "array<struct<full_name:string,private:boolean,owner:struct<login:string>,description:string,homepage:string,pushed_at:string,stargazers_count:int,language:string>>")
    rows = good.select(F.inline("p")).filter(~F.coalesce("private", F.lit(False))).withColumn("owner", F.col("owner.login"))
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("pushed_at"), "full_name"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank", "private")


@register_normalizer("commits")
def commit_activity(rows: DataFrame) -> DataFrame:
    """Per repository: commits, active days, authors with their counts, most first. `rows`: (repo, author,
    at)."""
    by = rows.groupBy("repo", "author").agg(F.count(F.lit(1)).alias("n"))
    authors = by.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "author"))), lambda x: F.concat(x["author"], F.lit("="), -x["less"])).alias("authors"))
    total = rows.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count_distinct(F.to_date("at")).alias("active_days"))
    return total.join(authors, "repo")


@register_normalizer("breaches")
def breaches(payloads: DataFrame) -> DataFrame:
    """Names, dates and kinds of data of breaches of a subject, never their records."""
    good, _ = quarantine(payloads, "array<struct<Name:string,BreachDate:string,AddedDate:string,DataClasses:array<string>>>")
    rows = good.select("subject", F.inline("p"))
    usable = F.coalesce(F.try_to_date(F.coalesce(F.nullif("BreachDate", F.lit("")), F.substring("AddedDate", 1, 10))), F.lit(None).cast("date"))
    return rows.groupBy("subject").agg(F.array_sort(F.collect_set("Name")).alias("names"), F.max(usable).alias("latest"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("DataClasses")))).alias("data_classes"))


@register_normalizer("search_results")
def search_results(payloads: DataFrame) -> DataFrame:
    """Results of three shapes of provider answers: query, position from 1, title, url, snippet, and a
    confidence that is higher only for a documented rank of 3 or less."""
    item = "array<struct<title:string,url:string,link:string,description:string,snippet:string,content:string>>"
    good, _ = quarantine(payloads, f"struct<web:struct<results:{item}>,items:{item},results:{item},ranked:boolean>")
    rows = good.select("query", "p.ranked", F.posexplode(F.coalesce("p.web.results", "p.items", "p.results")).alias("at", "r"))
    url = F.coalesce("r.url", "r.link")
    made = rows.select("query", (F.col("at") + 1).alias("position"), F.substring("r.title", 1, 300).alias("title"), url.alias("url"), F.substring(F.coalesce("r.description", "r.snippet", "r.content"), 1, 500).alias("snippet"), F.coalesce("ranked", F.lit(False)).alias("ranked"))
    return made.filter("url IS NOT NULL AND url <> ''").withColumn("confidence", F.when(F.col("ranked") & (F.col("position") <= 3), 0.5).otherwise(0.4)).drop("ranked")


# Fields of a row that an analyst brings, with the most letters of each.
IMPORT_FIELDS = {"target": 320, "query": 500, "url": 2048, "title": 500, "snippet": 2000, "engine": 100, "organization": 300, "notes": 2000}


def read_imports(spark, path: str, form: str = "csv") -> DataFrame:
    """Rows of CSV (by its header, in any order) or of JSON lines with the columns of `IMPORT_FIELDS`,
    null where a file has none; `malformed` is the text of a line that isn't a row, else null."""
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed")
    names = list(IMPORT_FIELDS)
    if form == "csv":
        reader = reader.option("header", True)
        names = [c for c in reader.csv(path).columns if c != "malformed"]
    schema = ", ".join(f"`{name}` string" for name in [*names, "malformed"])
    rows = reader.schema(schema).csv(path) if form == "csv" else reader.schema(schema).json(path)
    return rows.select(*(F.col(f"`{c}`") if c in names else F.lit(None).cast("string").alias(c) for c in IMPORT_FIELDS), "malformed")


def judged_imports(rows: DataFrame) -> DataFrame:
    """Rows of `read_imports` with `url` without its fragment, completed by a scheme where it has none, and `refused`: why a
    row can't be stored, null where it can. The first reason counts: the line, what is missing, what
    is too long, then the address, which must be a safe public one."""
    bare = F.regexp_replace(F.trim("url"), "#.*$", "")
    url = F.when(bare.contains("://"), bare).otherwise(F.concat(F.lit("https://"), bare))
    why = F.when(F.col("malformed").isNotNull(), "malformed")
    for name in ("target", "query", "url"):
        why = why.when(F.coalesce(F.trim(name), F.lit("")) == "", f"{name} missing")
    for name, most in IMPORT_FIELDS.items():
        why = why.when(F.length(name) > most, f"{name} too long")
    safe = urls.safety(url)
    return rows.withColumn("refused", why.when(safe != "ok", F.concat(F.lit("address: "), safe))).withColumn("url", F.when(bare != "", url))


def imported_results(rows: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judged rows as findings of kind MANUAL_SEARCH_RESULT and confidence 0.2, one for each target and
    address, those whose key is in `stored` (dedupe_key) left out; and the refused rows with their
    reason. Of rows with one key the one with the smallest query, title and snippet is taken."""
    judged = judged_imports(rows)
    good = judged.filter("refused IS NULL").withColumn("dedupe_key", F.concat(F.lit("manual:"), F.lower(F.trim("target")), F.lit(":"), "url"))
    fields = [c for c in IMPORT_FIELDS if c not in ("target", "url")]
    first = good.groupBy("dedupe_key").agg(F.min("target").alias("target"), F.first("url").alias("url"), F.min(F.struct("query", "title", *[c for c in fields if c not in ("query", "title")])).alias("r"), F.count(F.lit(1)).alias("n_rows"))
    made = first.select(F.lit("MANUAL_SEARCH_RESULT").alias("kind"), "dedupe_key", "target", "url", *(F.col(f"r.{c}").alias(c) for c in fields), urls.shape(F.col("url")).alias("url_kind"), F.lit(0.2).alias("confidence"), "n_rows")
    return made.join(stored.select("dedupe_key"), "dedupe_key", "left_anti"), judged.filter("refused IS NOT NULL")
