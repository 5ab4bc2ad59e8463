"""Internet addresses as numbers: IPv4 in all written forms, IPv6, and ranges by binary order.

An address is its hexadecimal digits, 8 or 32 of them, so that text order is the addresses' order
and a range is a place in a sorted table.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bound import bound

#: Ranges outside the public internet, by reason; an address has the first reason that holds it.
#: Fixed values of the registries.
RANGES = {
    "metadata": ["169.254.169.254/32", "fd00:ec2::254/128"],
    "shared": ["100.64.0.0/10"],
    "loopback": ["127.0.0.0/8", "::1/128"],
    "unspecified": ["0.0.0.0/8", "::/128"],
    "link-local": ["169.254.0.0/16", "fe80::/10"],
    "private": ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "192.0.0.0/29", "192.0.0.8/32", "192.0.0.170/31", "192.0.0.11/32", "192.0.0.12/30", "192.0.0.16/28", "192.0.0.32/27", "192.0.0.64/26", "192.0.0.128/25", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "fc00::/7", "64:ff9b:1::/48", "100::/64", "2001:db8::/32", "2002::/16", "3fff::/20"],
    "multicast": ["224.0.0.0/4", "ff00::/8"],
    "mapped": ["::ffff:0:0/96"],
    "reserved": ["240.0.0.0/4", "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/32", "2001:2::/48", "2001:10::/28", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9", "fec0::/10"],
}


def _table(version: int) -> list[tuple[str, str, str]]:
    """Disjoint (first, last, reason) in order."""
    networks = [(k, ipaddress.ip_network(n), reason) for k, (reason, n) in enumerate((r, n) for r, ns in RANGES.items() for n in ns)]
    own = [(k, int(n[0]), int(n[-1]), reason) for k, n, reason in networks if n.version == version]
    edges = sorted({x for _, low, high, _ in own for x in (low, high + 1)})
    digits, out = 8 if version == 4 else 32, []
    for low, after in zip(edges, edges[1:], strict=False):
        reason = next((r for _, a, b, r in sorted(own) if a <= low and after - 1 <= b), None)
        if reason and out and out[-1][2] == reason and int(out[-1][1], 16) + 1 == low:
            low = int(out.pop()[0], 16)
        if reason:
            out.append((f"{low:0{digits}x}", f"{after - 1:0{digits}x}", reason))
    return out


TABLES = {4: _table(4), 6: _table(6)}


def _number(part: Column) -> Column:
    """A part of an IPv4 address: hexadecimal after 0x, octal after 0, else decimal; null for none."""
    p = F.lower(part)
    return (
        F.when(p.rlike("^0x[0-9a-f]{0,8}$"), F.conv(F.concat(F.lit("0"), F.substring(p, 3, 8)), 16, 10))
        .when(p.rlike("^0[0-7]{1,11}$"), F.conv(p, 8, 10))
        .when(p.rlike("^(0|[1-9][0-9]{0,9})$"), p)
        .cast("long")
    )


def ipv4(host: Column) -> Column:
    """The 8 digits of an IPv4 address in any form that resolvers take: four numbers or fewer, of
    which the last fills the bytes that are left; null for what is none."""

    def of(parts: Column) -> Column:
        n, last = F.size(parts), F.element_at(parts, -1)
        heads = F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0)))
        high = F.aggregate(heads, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
        free = F.element_at(F.array(*(F.lit(256**k) for k in (4, 3, 2, 1))), F.least(n, F.lit(4)))
        good = (n <= 4) & F.forall(parts, lambda x: x.isNotNull()) & F.forall(heads, lambda x: x < 256) & (last < free)
        return F.when(F.coalesce(good, F.lit(False)), F.lpad(F.lower(F.hex(high * free + last)), 8, "0"))

    literal = F.when(host.rlike("^[0-9][0-9a-zA-Z.]*$"), host)
    return bound(F.transform(F.split(F.regexp_replace(literal, r"\.$", ""), r"\."), _number), of)


def ipv6(text: Column) -> Column:
    """The 32 digits of an IPv6 address, also with `::`, a zone or an IPv4 tail; null for what is none."""
    none = F.array().cast("array<string>")

    def plain(t: Column) -> Column:
        """Two groups of digits in place of an IPv4 tail."""
        tail = F.regexp_extract(t, r":([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 1)
        four = lambda d: F.concat(F.regexp_replace(t, r"[0-9.]+$", ""), F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4))
        return F.when(t.contains("."), bound(ipv4(F.nullif(tail, F.lit(""))), four)).otherwise(t)

    def groups(t: Column) -> Column:
        halves = F.transform(F.split(t, "::"), lambda half: F.filter(F.split(half, ":"), lambda x: x != ""))
        shape = t.rlike("^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::)?([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$")
        return F.when(shape, halves)

    def digits(halves: Column) -> Column:
        left, right = halves[0], F.coalesce(F.try_element_at(halves, F.lit(2)), none)
        given, gap = F.size(left) + F.size(right), F.size(halves) == 2
        good = F.when(gap, given <= 7).otherwise((F.size(halves) == 1) & (given == 8))
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0))), right)
        return F.when(F.coalesce(good, F.lit(False)), F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))

    return bound(bound(bound(F.lower(F.regexp_replace(text, "%.*$", "")), plain), groups), digits)


def short_ipv6(digits: Column) -> Column:
    """The canonical text of 32 digits: no leading zeros, the first longest run of zero groups as `::`."""

    def short(text: Column) -> Column:
        out = text
        for run in range(2, 9):  # the longest is asked first
            zeros = ":".join(["0"] * run)
            out = F.when(text.rlike(f"(?:^|:){zeros}(?::|$)"), F.regexp_replace(text, f"^((?:.*?[^:](?=:))??):?{zeros}(?::|$)(.*)$", "$1::$2")).otherwise(out)
        return out

    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.regexp_replace(F.substring(digits, k * 4 + 1, F.lit(4)), "^0{1,3}", ""))
    return F.when(digits.isNotNull(), bound(F.array_join(groups, ":"), short))


def _reason(digits: Column, version: int) -> Column:
    lows, highs, reasons = (F.array(*(F.lit(row[k]) for row in TABLES[version])) for k in range(3))
    at = F.nullif(F.size(F.filter(lows, lambda low: low <= digits)), F.lit(0))
    return bound(at, lambda k: F.when(F.try_element_at(highs, k) >= digits, F.try_element_at(reasons, k)))


def not_public(host: Column) -> Column:
    """Why an address literal is outside the public internet, null for public ones and for names. An
    IPv6 address that maps an IPv4 one has that one's reason, else `mapped`."""
    four = bound(ipv4(host), lambda d: F.when(d.isNotNull(), _reason(d, 4)))
    mapped = lambda d: F.when(d.startswith("0" * 20 + "ffff"), _reason(F.substring(d, 25, 8), 4))
    six = bound(ipv6(host), lambda d: F.when(d.isNotNull(), F.coalesce(mapped(d), _reason(d, 6))))
    return F.when(host.contains(":"), six).otherwise(four)
