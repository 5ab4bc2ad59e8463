"""Web addresses as column expressions: parts, canonical forms, shapes, safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import addresses
from .bound import bound

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://"
# Two-part public suffixes.
TWO_PART_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.in", "co.za", "com.br", "com.mx", "com.cn"]
# Hosts that name this machine or a cloud's metadata service.
LOOPBACK_NAMES = ["localhost", "localhost.localdomain", "ip6-localhost"]
METADATA_HOSTS = ["169.254.169.254", "metadata.google.internal", "metadata.goog", "instance-data", "100.100.100.100"]
IPV4 = r"^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: platform: hosts, path prefixes before a handle, path segments that are no handle. Fixed values.
PLATFORMS = {
    "github": (["github.com"], [], ["orgs", "topics", "features", "pricing", "search", "login"]),
    "gitlab": (["gitlab.com"], [], ["explore", "help", "users", "groups"]),
    "orcid": (["orcid.org"], [], []),
    "pypi": (["pypi.org"], ["user"], ["project", "search", "help"]),
    "mastodon": (["mastodon.social", "mastodon.online"], [], []),
    "reddit": (["reddit.com", "old.reddit.com"], ["u", "user"], ["r", "comments", "search", "submit"]),
    "youtube": (["youtube.com", "m.youtube.com", "youtu.be"], ["c", "channel", "user"], ["watch", "results", "feed", "playlist", "shorts", "embed"]),
}
#: The registry's format of an iD. A fixed value.
ORCID = r"^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$"
PUBLICATION_HOSTS = ["doi.org", "dx.doi.org", "arxiv.org", "openalex.org", "api.crossref.org", "semanticscholar.org", "researchgate.net", "pubmed.ncbi.nlm.nih.gov"]


# Hosts whose results are about a search, not about its subject.
NOISE_HOSTS = ["google.com", "bing.com", "duckduckgo.com", "webcache.googleusercontent.com", "translate.google.com", "policies.google.com", "support.google.com"]
#: Hosts whose two-part paths are an owner and a repository. Fixed values.
FORGES = ["github.com", "gitlab.com", "bitbucket.org"]


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-case host without credentials, port or final dot, an IPv6 literal without its brackets;
    empty where there is none."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\[\]]*?|\[[^/?#\[\]]*\])\.?(?::[0-9]*)?(?:[/?#].*)?$", 1)
    return F.lower(F.translate(found, "[]", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def identity_key(url: Column) -> Column:
    """What two spellings of one address share: no scheme, `www.`, fragment or final slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(www\.)?", ""), "#.*$", ""), "/+$", "")


def website(url: Column) -> Column:
    """`scheme://host/path` without a final slash."""
    return F.concat(scheme(url), F.lit("://"), host(url), F.regexp_replace(path(url), "/+$", ""))


def registrable_domain(name: Column) -> Column:
    """The last two labels of a host, three where the last two are a public suffix."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")
    return F.when(name == "", F.lit("")).when((n > 2) & last(2).isin(TWO_PART_SUFFIXES), last(3)).otherwise(last(2))


def safety(url: Column) -> Column:
    """Why an address must not be fetched, judged by its text alone; `ok` otherwise. Literal addresses
    count by their number, in whatever form they are written."""
    name, port = host(url), F.regexp_extract(authority(url), r":([0-9]+)$", 1)
    ladder = F.when(url.isNull() | (url == "") | (F.length(url) > 2048), "length").when(~scheme(url).isin("http", "https"), "scheme")
    ladder = ladder.when(authority(url).contains("@"), "credentials").when(name == "", "no host").when(name.isin(LOOPBACK_NAMES), "loopback name").when(name.isin(METADATA_HOSTS), "metadata host")
    ladder = ladder.when((port != "") & ~F.coalesce(port.try_cast("int").between(1, 65535), F.lit(False)), "port")
    return ladder.otherwise(F.coalesce(bound(name, addresses.not_public), F.lit("ok")))


def public_address(url: Column) -> Column:
    """The address without its fragment, completed by a scheme where it has none; null unless it is a
    safe public one."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    full = F.when(bare.contains("://"), bare).otherwise(F.concat(F.lit("https://"), bare))
    return F.when(bare != "", bound(full, lambda whole: F.when(safety(whole) == "ok", whole)))


def is_noise(url: Column) -> Column:
    return bare_host(url).isin(NOISE_HOSTS)


def drawable(url: Column) -> Column:
    """Whether a page may draw the image in place: https, and a safe public address by its text."""
    return F.coalesce((scheme(F.trim(url)) == "https") & (safety(F.trim(url)) == "ok"), F.lit(False))


def handle(url: Column) -> Column:
    """The account a profile-shaped address names, else null; deeper paths address content."""

    def of(at: Column) -> Column:
        parts, out = at["parts"], F.lit(None).cast("string")
        first = F.lower(F.try_element_at(parts, F.lit(1)))
        for hosts, prefixes, reserved in PLATFORMS.values():
            free = ~F.arrays_overlap(F.transform(parts, F.lower), F.array(*map(F.lit, reserved))) if reserved else F.lit(True)
            after = F.when(first.isin(prefixes), F.when(F.size(parts) == 2, F.try_element_at(parts, F.lit(2)))) if prefixes else None
            own = F.when(F.size(parts) == 1, F.try_element_at(parts, F.lit(1)))
            if hosts == ["orcid.org"]:
                own = F.when(F.upper(own).rlike(ORCID), own)
            found = after.otherwise(own) if after is not None else own
            out = F.when(at["host"].isin(hosts) & free, F.nullif(F.ltrim(found, F.lit("@")), F.lit(""))).otherwise(out)
        return out

    return bound(F.struct(bare_host(url).alias("host"), segments(url).alias("parts")), of)


def platform(url: Column) -> Column:
    def of(name: Column) -> Column:
        out = name
        for platform_name, (hosts, _, _) in reversed(PLATFORMS.items()):
            out = F.when(name.isin(hosts), platform_name).otherwise(out)
        return out

    return bound(bare_host(url), of)


def shape(url: Column) -> Column:
    """`social`, `publication` or `web`; null for what is no web address."""
    return F.when(~scheme(url).isin("http", "https") | (host(url) == ""), F.lit(None)).when(handle(url).isNotNull(), "social").when(bare_host(url).isin(PUBLICATION_HOSTS), "publication").otherwise("web")


def finding_kind(url: Column) -> Column:
    """The kind of finding an address makes by its ending."""
    tail = F.lower(path(url))
    return F.when(tail.rlike(r"\.(pdf|docx?|xlsx?|pptx?|odt|csv)$"), "DOCUMENT").when(tail.rlike(r"\.(png|jpe?g|gif|webp|svg)$"), "IMAGE").when(shape(url) == "social", "SOCIAL_ACCOUNT").otherwise("WEBSITE")


def identifier_type(text: Column) -> Column:
    """The type that an identifier's own shape tells; `ambiguous` for free text, null for none."""
    t = F.trim(text)
    web = F.when(t.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), t).when(t.rlike(r"^(?i)([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}/"), F.concat(F.lit("https://"), t))
    address = bound(web, lambda w: F.when(bare_host(w).isin(FORGES) & (F.size(segments(w)) >= 2), "REPOSITORY").when(shape(w) == "social", "SOCIAL_PROFILE").otherwise("URL"))
    domain = r"^(?i)([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}\.?$"
    return (
        F.when(t.isNull() | (t == ""), F.lit(None))
        .when(t.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), address)
        .when(t.startswith("@"), "USERNAME")
        .when(t.rlike(r"^git@[A-Za-z0-9.-]+:[\w.-]+/[\w.-]+$"), "REPOSITORY")
        .when(t.rlike(r"^[\w.+-]+@[\w-]+(\.[\w-]+)+$"), "EMAIL")
        .when(t.rlike(IPV4) | t.rlike(r"^\[?[0-9a-fA-F]*:[0-9a-fA-F:]+\]?$"), "IP")
        .when(t.rlike(domain), "DOMAIN")
        .when(web.isNotNull(), address)
        .when(t.rlike(r"^[\w.-]+/[\w.-]+$"), "REPOSITORY")
        .when(t.rlike(r"^[A-Za-z0-9._-]{1,64}$"), "USERNAME")
        .otherwise("ambiguous")
    )
