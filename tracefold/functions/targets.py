"""One canonical spelling for each kind of identifier; null for what isn't one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import addresses, urls
from .bound import bound

_HAS_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
_LABEL = r"[a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?"
_BARE_HOST_PATH = r"^(?i)([a-z0-9-]+\.)+[a-z]{2,63}/[^/]+/[^/]+"


@F.pandas_udf(T.StringType())
def _encoded(hosts: pd.Series) -> pd.Series:
    def one(host: str | None) -> str | None:
        if host is None or host.isascii():
            return host
        try:
            return host.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return hosts.map(one)


def _with_scheme(text: Column) -> Column:
    return F.when(text.rlike(_HAS_SCHEME), text).otherwise(F.concat(F.lit("https://"), text))


def username(text: Column) -> Column:
    bare = F.ltrim(F.trim(text), F.lit("@"))
    return F.when(bare.rlike(r"^[A-Za-z0-9._-]{1,64}$"), F.lower(bare))


def domain(text: Column, international: bool = False) -> Column:
    """Lower case without scheme, path, account, port and outer dots, two labels at least. Letters
    beyond ASCII need `international`, which sends the column through Python."""
    place = F.regexp_extract(F.regexp_replace(F.trim(text), _HAS_SCHEME, ""), r"^([^/?#]*)", 1)
    place = F.lower(F.trim(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":[0-9]*$", ""), F.lit(".")))
    place = _encoded(place) if international else place
    return F.when(place.rlike(rf"^{_LABEL}(\.{_LABEL})+$"), place)


def email(text: Column, international: bool = False) -> Column:
    bare = F.trim(F.trim(text), F.lit("<>"))
    place = domain(F.regexp_extract(bare, r"@([^@]*)$", 1), international)
    return F.when(bare.rlike(r"^[^\s@<>]+@[^\s@<>/:]+$"), F.concat(F.lower(F.regexp_extract(bare, r"^([^@]*)@", 1)), F.lit("@"), place))


def web_address(text: Column, international: bool = False) -> Column:
    """Scheme and host in lower case, no account, default port or fragment, `/` for an empty path."""
    t = _with_scheme(F.trim(text))
    place = F.regexp_replace(F.lower(urls.authority(t)), r"^.*@", "")
    place = F.regexp_replace(F.regexp_replace(place, r":(80|443)?$", ""), r"\.(?=:|$)", "")
    place = _encoded(place) if international else place
    query = F.regexp_extract(t, r"^[^?#]*(\?[^#]+)", 1)
    return F.when(urls.scheme(t).isin("http", "https") & (place != ""), F.concat(urls.scheme(t), F.lit("://"), place, F.coalesce(F.nullif(urls.path(t), F.lit("")), F.lit("/")), query))


def ip_address(text: Column) -> Column:
    """IPv4 as it stands, IPv6 in its short form."""
    bare = F.trim(F.trim(text), F.lit("[]"))
    return F.coalesce(F.when(bare.rlike(urls.IPV4), bare), addresses.short_ipv6(addresses.ipv6(F.when(bare.contains(":"), bare))))


def _platform(host: Column) -> Column:
    out = host
    for name, (hosts, _, _) in urls.PLATFORMS.items():
        out = F.when(host.isin(hosts), name).otherwise(out)
    return out


def repository(text: Column) -> Column:
    """`platform:owner/name` of a web address, an SSH address or `owner/name`."""
    t = F.trim(text)
    ssh, short = r"^git@([^:/]+):/*([^/]+)/+([^/]+?)/*$", r"^([\w.-]+)/([\w.-]+)$"
    web, parts = _with_scheme(t), urls.segments(_with_scheme(t))
    is_web = t.rlike(_HAS_SCHEME) | t.rlike(_BARE_HOST_PATH)
    named = F.when(t.rlike(ssh), F.struct(F.lower(F.regexp_extract(t, ssh, 1)).alias("host"), F.regexp_extract(t, ssh, 2).alias("owner"), F.regexp_extract(t, ssh, 3).alias("name")))
    named = named.when(is_web & (F.size(parts) >= 2), F.struct(urls.bare_host(web).alias("host"), F.try_element_at(parts, F.lit(1)).alias("owner"), F.try_element_at(parts, F.lit(2)).alias("name")))
    named = named.when(~is_web & t.rlike(short), F.struct(F.lit("github.com").alias("host"), F.regexp_extract(t, short, 1).alias("owner"), F.regexp_extract(t, short, 2).alias("name")))
    return bound(named, lambda n: F.concat(_platform(n["host"]), F.lit(":"), F.lower(n["owner"]), F.lit("/"), F.regexp_replace(F.lower(n["name"]), r"\.git$", "")))


def profile(text: Column) -> Column:
    """`platform:handle` of an address that names an account."""
    t = _with_scheme(F.trim(text))
    return F.concat(urls.platform(t), F.lit(":"), F.lower(urls.handle(t)))


def orcid(text: Column) -> Column:
    """The bare iD of a registry address or of an iD."""
    bare = F.upper(F.regexp_replace(F.trim(text), r"^(?i)(https?://)?(www\.)?orcid\.org/|/+$", ""))
    return F.when(bare.rlike(urls.ORCID), bare)


def canonical(kind: Column, text: Column, international: bool = False) -> Column:
    """The canonical form by the kind that `urls.identifier_type` names."""
    return (
        F.when(kind == "USERNAME", username(text))
        .when(kind == "DOMAIN", domain(text, international))
        .when(kind == "EMAIL", email(text, international))
        .when(kind == "URL", web_address(text, international))
        .when(kind == "IP", ip_address(text))
        .when(kind == "REPOSITORY", repository(text))
        .when(kind == "SOCIAL_PROFILE", profile(text))
    )
