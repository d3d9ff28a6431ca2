"""URL algebra as native Column expressions: identity, hosts, branches, archetypes, egress rules.

Everything here stays inside whole-stage code generation; only IPv6 literals need Python.
Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_URL_BYTES = 8192
IDENTITY_VERSION = 1
# Path hints of archetypes.
REDIRECT_SEGMENTS = ("go", "goto", "redirect", "r", "out", "jump")
DOCUMENT_SEGMENTS = ("doc", "docs", "document", "documents", "draft", "drafts", "spec", "specs")
DOCUMENT_PREFIXES = ("draft-", "rfc")
LISTING_SEGMENTS = (
    "assignment", "assignments", "archive", "archives", "catalog", "catalogue", "dataset", "datasets", "download", "downloads",
    "index", "indexes", "mirror", "mirrors", "registry", "registries", "repository", "repositories", "table", "tables",
)
# IPv4 ranges that are never fetched, as (first address, prefix length).
BLOCKED_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
DEFAULT_PORTS = (80, 443)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def netloc(url) -> Column:
    """Authority as written, '' where there is none."""
    return F.regexp_extract(_c(url), r"^(?:[^:/?#]+:)?//([^/?#]*)", 1)


def path(url) -> Column:
    return F.regexp_extract(_c(url), r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url) -> Column:
    return F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)


def host_key(url) -> Column:
    """Authority in lower case."""
    return F.lower(netloc(url))


def _quoted(value: Column) -> Column:
    """Form encoding with ~ kept and * escaped."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_query(q: Column) -> Column:
    """Pairs with a value, decoded, sorted, encoded again."""
    pairs = F.transform(
        F.filter(F.split(q, "&"), lambda p: F.instr(p, "=") > 0),
        lambda p: F.struct(
            F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)).alias("k"),
            F.coalesce(F.try_url_decode(F.substring(p, F.instr(p, "=") + 1, F.length(p))), F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda s: s["v"] != ""))
    return F.array_join(F.transform(kept, lambda s: F.concat(_quoted(s["k"]), F.lit("="), _quoted(s["v"]))), "&")


def normalize_url(url) -> Column:
    """Lower-case scheme and authority, no trailing slash, sorted non-empty query pairs, no fragment.

    Default ports and the case of the path are kept; ``;params`` of the last segment are kept behind the trimmed path.
    """
    # Each part is written so that it's evaluated once: replacements at the ends instead of conditions.
    u = _c(url)
    bare = F.rtrim(F.regexp_replace(path(u), ";[^/]*$", ""), F.lit("/"))
    params = F.regexp_extract(path(u), "(;[^/]*)$", 1)
    q = F.regexp_replace(F.concat(F.lit("?"), canonical_query(query(u))), r"^\?$", "")
    return F.concat(scheme(u), F.lit("://"), host_key(u), F.regexp_replace(bare, "^$", "/"), params, q)


def branch_key(url, most: int = 2) -> Column:
    """First path segments of the normalised URL, '/' if there are none."""
    parts = F.slice(F.filter(F.split(path(normalize_url(url)), "/"), lambda s: s != ""), 1, most)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def identity_hash(url) -> Column:
    return F.md5(_c(url))


def identity_length(url) -> Column:
    return F.octet_length(_c(url))


def page_hash(url) -> Column:
    return F.sha2(normalize_url(url), 256)


def registrable_domain(host) -> Column:
    """Last two labels; IP literals and hosts of one or two labels stand for themselves; no public-suffix list."""
    h = F.lower(F.regexp_replace(F.regexp_replace(_c(host), r"^.*@", ""), r":\d+$", ""))
    h = F.trim(h, F.lit("."))
    labels = F.split(h, r"\.")
    ip = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | h.contains(":")
    return F.when(ip | (F.size(labels) <= 2), h).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def archetype(url) -> Column:
    """redirect_hub, document_page, registry_listing or generic_page, by the path alone."""
    p = F.lower(path(url))
    segments = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    first, size = F.get(segments, F.lit(0)), F.size(segments)
    name = F.element_at(segments, -1)
    name = F.when(size > 0, name).otherwise("")
    inner = F.when(size > 1, F.slice(segments, 1, size - 1)).otherwise(F.array().cast("array<string>"))
    listing = p.rlike("/(" + "|".join(LISTING_SEGMENTS) + ")(/|$)")
    return (
        F.when((size > 0) & (size <= 2) & first.isin(*REDIRECT_SEGMENTS), "redirect_hub")
        .when(name.rlike("^(" + "|".join(DOCUMENT_PREFIXES) + ")") | F.arrays_overlap(inner, F.array(*map(F.lit, DOCUMENT_SEGMENTS))), "document_page")
        .when(listing, "registry_listing")
        .otherwise("generic_page")
    )


def is_listing(url) -> Column:
    return F.lower(path(url)).rlike("/(" + "|".join(LISTING_SEGMENTS) + ")(/|$)")


@F.pandas_udf(T.BooleanType())
def blocked_v6(hosts: pd.Series) -> pd.Series:
    """Whether IPv6 literals (brackets allowed) are blocked; anything else isn't."""
    extra = [ipaddress.ip_network(n) for n in ("fc00::/7", "fe80::/10")]

    def one(h):
        try:
            ip = ipaddress.IPv6Address(h.strip("[]"))
        except (ValueError, AttributeError):
            return False
        return ip.ipv4_mapped is not None or any(ip in n for n in extra) or ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified

    return hosts.map(one).astype(bool)


def v4_number(host: Column) -> Column:
    """A dotted quad as a number, null for anything else."""
    parts = F.split(host, r"\.")
    ok = host.rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$")
    at = lambda i: F.get(parts, F.lit(i)).cast("long")
    return F.when(ok, at(0) * 16777216 + at(1) * 65536 + at(2) * 256 + at(3))


def blocked_v4(host: Column) -> Column:
    """Whether a dotted quad lies in a blocked range; anything else doesn't."""

    def inside(n: Column) -> Column:
        hit = F.lit(False)
        for first, bits in BLOCKED_V4:
            low = int(ipaddress.IPv4Address(first))
            hit = hit | n.between(low, low + 2 ** (32 - bits) - 1)
        return hit

    # Bound to a lambda, the number is worked out once for all ranges; nulls match none.
    return F.coalesce(F.exists(F.array(v4_number(host)), inside), F.lit(False))


def legacy_v4(host: Column) -> Column:
    """Numeric host forms that some stacks read as IPv4 addresses."""
    parts = F.split(host, r"\.")
    numeric = ~host.contains(":") & (F.size(parts) <= 4) & F.forall(parts, lambda p: p.rlike(r"^(0x[0-9a-f]+|\d+)$"))
    odd = (F.size(parts) != 4) | F.exists(parts, lambda p: p.rlike(r"^0x") | ((F.length(p) > 1) & p.startswith("0")))
    return numeric & odd


def egress_reason(url, ports: tuple[int, ...] = DEFAULT_PORTS, private: bool = False, v6: Column | None = None) -> Column:
    """'allowed' or the first rule a URL breaks, without looking any name up.

    ``v6``: whether the host is a blocked IPv6 literal (see blocked_v6); null means there are none.
    """
    authority = netloc(url)
    rest = F.regexp_replace(authority, r"^.*@", "")
    bracket = rest.startswith("[")
    name = F.when(bracket, F.regexp_extract(rest, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(rest, r"^([^:]*)", 1))
    port_text = F.regexp_extract(rest, r"(?:\]|^[^\[:]*):(.*)$", 1)
    parts = F.struct(
        scheme(url).alias("s"), authority.contains("@").alias("user"), F.rtrim(F.lower(F.trim(name)), F.lit(".")).alias("host"), port_text.alias("port"), (bracket & ~rest.contains("]")).alias("torn"),
        F.coalesce(v6 if v6 is not None else F.lit(False), F.lit(False)).alias("v6"),
    )

    def rules(p: Column) -> Column:
        s, host, given = p["s"], p["host"], p["port"]
        number = given.try_cast("int")
        usual = F.when(s == "https", 443).otherwise(80)
        port = F.when((given == "") | (number == 0), usual).otherwise(number)
        bad = p["torn"] | ((given != "") & (~given.rlike(r"^\d+$") | number.isNull() | (number > 65535)))
        reason = F.when(bad, "invalid_url").when(~s.isin("http", "https"), "unsupported_scheme").when(host == "", "missing_host").when(p["user"], "userinfo_not_allowed").when(legacy_v4(host), "blocked_legacy_ipv4_literal")
        if not private:
            reason = reason.when((host == "localhost") | host.endswith(".localhost"), "blocked_hostname").when(blocked_v4(host) | p["v6"], "blocked_ip_literal")
        return reason.when(~port.isin(*ports), "blocked_port").otherwise("allowed")

    # The parts are bound to a lambda, so that each is worked out once for all rules.
    return F.when(_c(url).isNotNull(), F.element_at(F.transform(F.array(parts), rules), 1))
