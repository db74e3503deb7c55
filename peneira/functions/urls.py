"""URL functions as columns: canonical form, host and domain, and what is not crawled.

Spark's parser accepts less than browsers do: blanks are encoded first; addresses that it
still refuses count as invalid. Host names in other scripts and dot segments stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peneira.dims import BLOCKED_ENDINGS, BLOCKED_HOSTS, BLOCKED_PATHS

_TRACKING = "(?i)^(utm_.*|gclid|fbclid)$"
HOST_PATTERN = "|".join(BLOCKED_HOSTS)
PATH_PATTERN = "(?i)" + "|".join(BLOCKED_PATHS)
ENDING_PATTERN = "(" + "|".join(e.replace(".", "\\.") for e in BLOCKED_ENDINGS) + ")$"


def part(url: Column, what: str) -> Column:
    """A part of an address, null if the address is invalid or lacks it."""
    return F.try_parse_url(F.regexp_replace(url, " ", "%20"), F.lit(what))


def scheme(url: Column) -> Column:
    return F.lower(part(url, "PROTOCOL"))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def hostname_or_unknown(url: Column) -> Column:
    return F.coalesce(host(url), F.lit("unknown"))


def same_host(a: Column, b: Column) -> Column:
    return hostname_or_unknown(a) == hostname_or_unknown(b)


def domain(url: Column) -> Column:
    """The host without a leading www.; an invalid address as it stands."""
    return F.coalesce(F.regexp_replace(host(url), "^www\\.", ""), url)


def is_http(url: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https"), F.lit(False))


def canonical(url: Column) -> Column:
    """Lower-case host, no fragment, no tracking parameters, the others sorted by key, no closing slashes but of the root, no default port. Null if invalid."""
    proto, name, path = scheme(url), host(url), F.coalesce(part(url, "PATH"), F.lit(""))
    authority = part(url, "AUTHORITY")
    port = F.regexp_extract(authority, ":(\\d+)$", 1)
    default = ((proto == "http") & (port == "80")) | ((proto == "https") & (port == "443")) | (port == "")
    query = F.coalesce(part(url, "QUERY"), F.lit(""))
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split(p, "=")[0].rlike(_TRACKING))
    keyed = F.transform(pairs, lambda p, i: F.struct(F.split(p, "=")[0].alias("k"), i.alias("i"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    rest = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["p"]), "&")
    trimmed = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "(?<=.)/+$", ""))
    return F.when(
        proto.isNotNull() & name.isNotNull(),
        F.concat(proto, F.lit("://"), name, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), trimmed, F.when(rest == "", "").otherwise(F.concat(F.lit("?"), rest))),
    )


def is_blocked(url: Column) -> Column:
    """Whether an address is not to be crawled: invalid, or of a blocked host, path or ending."""
    name, path = host(url), F.lower(F.coalesce(part(url, "PATH"), F.lit("")))
    found = name.isNull() | name.rlike(HOST_PATTERN) | path.rlike(PATH_PATTERN) | path.rlike(ENDING_PATTERN) | canonical(url).rlike(PATH_PATTERN)
    return F.coalesce(found, F.lit(True))


def resolve(base: Column, href: Column) -> Column:
    """A link against its page's address; characters beyond ASCII of the path percent-encoded. Null if it cannot be resolved."""
    clean = F.trim(href)
    root = F.concat(scheme(base), F.lit("://"), part(base, "AUTHORITY"))
    folder = F.regexp_replace(F.coalesce(part(base, "PATH"), F.lit("/")), "[^/]*$", "")
    encoded = F.array_join(
        F.transform(F.split(clean, ""), lambda c: F.when(c.rlike("[^\\x21-\\x7e]"), F.regexp_replace(F.url_encode(c), "\\+", "%20")).otherwise(c)), ""
    )
    return (
        F.when(clean.rlike("(?i)^[a-z][a-z0-9+.-]*:"), encoded)
        .when(clean.startswith("//"), F.concat(scheme(base), F.lit(":"), encoded))
        .when(clean.startswith("/"), F.concat(root, encoded))
        .when(clean.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), encoded))
        .when(clean == "", F.regexp_replace(base, "#.*$", ""))
        .when(clean.startswith("?"), F.concat(root, F.coalesce(part(base, "PATH"), F.lit("/")), encoded))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), encoded))
    )
