"""URL and host expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions import constants as K
from sightline.functions.text import let

_WEB_URL = r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def normalize_domain(value: Column) -> Column:
    """Lower-case host without scheme, user, port, path and ``www.``; accepts bare domains."""
    host = F.regexp_replace(F.lower(F.trim(value)), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(host, r"^[^/?#\\]*", 0)
    host = F.regexp_replace(host, r"^.*@", "")
    return F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"^www\.", "")


def domain_matches(host: Column, target: Column) -> Column:
    """The host is the target or one of its subdomains."""
    h, t = normalize_domain(host), normalize_domain(target)
    return (h != "") & (t != "") & ((h == t) | h.endswith(F.concat(F.lit("."), t)))


def url_matches(url: Column, target: Column) -> Column:
    """The URL is the page of a normalised URL. Hosts are compared first: only URLs on the
    target's own host are parsed."""
    same_host = F.substring_index(target, "/", 1) == normalize_domain(url)
    return F.coalesce(F.when(same_host, normalize_url(url) == target), F.lit(False))


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]: lets a suffix test become an equality join."""
    labels = F.size(F.split(host, r"\."))
    return F.transform(F.sequence(labels, F.lit(1)), lambda i: F.call_function("substring_index", host, F.lit("."), -i))


def root_domain(host: Column) -> Column:
    bare = F.regexp_replace(F.lower(host), r"^www\.", "")
    labels = F.split(bare, r"\.")
    keep = F.when(bare.rlike(K.THREE_LABEL_SUFFIX), 3).otherwise(2)
    return F.when(F.size(labels) <= keep, bare).otherwise(F.array_join(F.slice(labels, -keep, keep), "."))


def name_from_domain(domain: Column) -> Column:
    """Readable name: the last label left once the public suffix is dropped."""
    labels = F.split(normalize_domain(domain), r"\.")
    n = F.size(labels)
    drop = F.when((n >= 3) & (F.length(F.try_element_at(labels, n - 1)) <= 3), 2).otherwise(1)
    base = F.coalesce(F.when(n > drop, F.try_element_at(labels, n - drop)), F.element_at(labels, 1))
    return F.concat(F.upper(F.substring(base, 1, 1)), F.substring(base, 2, 1_000_000))


def web_host(url: Column) -> Column:
    """Host of an http(s) URL without ``www.``, null otherwise."""
    host = F.regexp_extract(F.trim(url), _WEB_URL, 1)
    return F.when(host != "", F.regexp_replace(F.lower(host), r"^www\.", ""))


def web_path(url: Column) -> Column:
    path = F.regexp_extract(F.trim(url), _WEB_URL, 2)
    return F.when(path == "", "/").otherwise(path)


def origin_of(url: Column) -> Column:
    """Scheme and host (with a non-default port), null for anything but an absolute URL."""
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://[^/?#]+", 1))
    authority = F.lower(F.regexp_replace(F.regexp_extract(F.trim(url), r"://([^/?#]+)", 1), r"^.*@", ""))
    default_port = F.when(scheme == "https", ":443").otherwise(":80")
    host = F.when(
        authority.endswith(default_port), F.substring_index(authority, ":", 1)
    ).otherwise(authority)
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host))


def encode_component(value: Column) -> Column:
    """Percent-encoding with the unreserved set of browsers (Spark's keeps ``+`` for blanks)."""
    out = F.url_encode(value)
    for spark_form, browser_form in [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        out = F.replace(out, F.lit(spark_form), F.lit(browser_form))
    return out


def _encode_path(path: Column) -> Column:
    unsafe = r"[^\x21-\x7e]|[\"<>`{}]"
    encoded = F.array_join(
        F.transform(
            F.split(path, ""), lambda c: F.when(c.rlike(unsafe), encode_component(c)).otherwise(c)
        ),
        "",
    )
    return F.when(path.rlike(unsafe), encoded).otherwise(path)


def _decode(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def normalize_url(url: Column) -> Column:
    """One spelling per page: host without ``www.``, path without trailing slashes, no
    fragment, no tracking parameters, the other parameters sorted. Null unless http(s)."""

    def rendered(query: Column) -> Column:
        pairs = F.filter(F.split(query, "&"), lambda p: p != "")
        params = F.transform(
            pairs,
            lambda p, i: F.struct(
                F.lower(_decode(F.substring_index(p, "=", 1))).alias("sort_key"),
                i.alias("position"),
                _decode(F.substring_index(p, "=", 1)).alias("name"),
                F.when(F.contains(p, F.lit("=")), _decode(F.regexp_replace(p, r"^[^=]*=", ""))).otherwise("").alias("value"),
            ),
        )
        kept = F.array_sort(F.filter(params, lambda p: ~p["name"].rlike(K.TRACKING_PARAM)))
        return F.array_join(
            F.transform(kept, lambda p: F.concat(encode_component(p["name"]), F.lit("="), encode_component(p["value"]))), "&"
        )

    def joined(parts: Column) -> Column:
        host = F.regexp_replace(F.lower(parts["host"]), r"^www\.", "")
        suffix = F.when(parts["query"] == "", "").otherwise(
            let(rendered(parts["query"]), lambda r: F.when(r == "", "").otherwise(F.concat(F.lit("?"), r)))
        )
        return F.when(parts["host"] != "", F.concat(host, F.rtrim(_encode_path(parts["path"]), F.lit("/")), suffix))

    def split(trimmed: Column) -> Column:
        return F.struct(*[F.regexp_extract(trimmed, _WEB_URL, n).alias(part) for n, part in enumerate(("host", "path", "query"), 1)])

    # Each step is computed once, however often its result is looked at.
    return let(let(F.trim(url), split), joined)


def bare_url(url: Column) -> Column:
    """Lower-case URL without scheme, ``www.``, parameters, fragment and trailing slashes."""
    out = F.regexp_replace(F.lower(url), r"^https?://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(out, r"[?#].*$", ""), r"/+$", "")


def same_site(source_url: Column, target_domain: Column) -> Column:
    """The source is a page of the target's site, subdomains included."""
    host = F.regexp_extract(normalize_url(source_url), r"^[^/?]*", 0)
    target = F.regexp_replace(F.lower(target_domain), r"^www\.", "")
    return F.coalesce((host == target) | host.endswith(F.concat(F.lit("."), target)), F.lit(False))


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of a link on a page (absolute, protocol-relative, rooted or relative)."""
    origin = origin_of(base)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[^?#]*", 0), r"(?<!/)/[^/]*$", "/")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.rlike(r"^[?#]"), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), href))
        .otherwise(F.concat(folder, href))
    )
