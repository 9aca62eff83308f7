"""URL expressions. All of them are built-in column functions, so a URL column is
canonicalised inside the JVM with no Python worker involved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An absolute URL whose canonical form is a prefix of it: nothing to lower-case or re-encode.
_SIMPLE = (
    r"^([a-z][a-z0-9+.\-]*://[a-z0-9.\-]+(?::[0-9]*)?(?:/[A-Za-z0-9\-._~!$&'()*+,;=:@/\[\]]*)?)"
    r"(?:\?[^#\x00-\x1f\x7f]*)?(?:#[^%]*)?\z"
)
# Any absolute URL: scheme, host with port, path. User info, query and fragment stay outside the groups.
_ABSOLUTE = (
    r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[A-Za-z0-9\-._~!$&'()*+,;=%:@]*@)?"
    r"((?:\[[^\]/?#@]*\]|[^\x00-\x20#/?@\\^`{|}\x7f:]+)(?::[0-9]*)?)(/[^?#]*)?(?:[?#][\s\S]*)?\z"
)
# Control characters before the fragment, or a broken percent escape outside the query.
_BROKEN = (
    r"^[^#]*[\x00-\x1f\x7f]|^[^?#]*%(?![0-9A-Fa-f]{2})|#[\s\S]*%(?![0-9A-Fa-f]{2})"
    r"|^[^:]*://[^/?#]*%(?![89A-Fa-f])"
)
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_PLAIN_PATH = r"^[A-Za-z0-9\-._~!$&'()*+,;=:@/\[\]%]*\z"
_PLAIN_HOST = r"^[\x00-\x24\x26-\x7f]*\z"
_HOSTNAME = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(?:\[([^\]/?#]*)\]|([^/?#:]*))[\s\S]*\z"
_DOT_SEGMENT = r"(^|/)\.{1,2}(/|\z)"
_START_PREFIX = r"^https?://"

# Characters that stay literal when a path or host is re-encoded.
_KEEP_IN_PATH = "/$&+,:;=@~"
_KEEP_IN_HOST = "!$&'()+,;=:[]<>\"~"


def _percent_encode(text: Column, keep: str) -> Column:
    """Percent-encode UTF-8 bytes except unreserved characters and ``keep``."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    out = F.replace(out, F.lit("*"), F.lit("%2A"))
    for ch in keep:
        out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return out


def _decode(text: Column) -> Column:
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _is_absolute(url: Column) -> Column:
    return url.rlike(_ABSOLUTE) & ~url.rlike(_BROKEN)


def _root(url: Column) -> Column:
    plain = F.lower(F.regexp_replace(url, _ABSOLUTE, "$1://$2"))
    host = F.lower(_decode(F.regexp_extract(url, _ABSOLUTE, 2)))
    encoded = F.concat(F.lower(F.regexp_extract(url, _ABSOLUTE, 1)), F.lit("://"), _percent_encode(host, _KEEP_IN_HOST))
    return F.when(plain.rlike(_PLAIN_HOST), plain).otherwise(encoded)


def _path(url: Column) -> Column:
    path = F.rtrim(F.regexp_extract(url, _ABSOLUTE, 3), F.lit("/"))
    return F.when(path.rlike(_PLAIN_PATH), path).otherwise(_percent_encode(_decode(path), _KEEP_IN_PATH))


def canonical_url(url: Column) -> Column:
    """Canonical form, or NULL when the text is not an absolute URL.

    Lower-case scheme and host; no user info, query or fragment; no trailing
    slashes. Ports, ``www.`` and the case of the path are kept. Idempotent.
    """
    simple = F.rtrim(F.regexp_extract(url, _SIMPLE, 1), F.lit("/"))
    return F.when(simple != "", simple).when(_is_absolute(url), F.concat(_root(url), _path(url)))


def site_root(url: Column) -> Column:
    """``scheme://host[:port]`` of an absolute URL, lower-cased."""
    return F.when(_is_absolute(url), _root(url))


def start_url(raw: Column) -> Column:
    """Seed text to site root; ``https://`` is assumed when no http(s) prefix is present."""
    return site_root(F.when(raw.rlike(_START_PREFIX), raw).otherwise(F.concat(F.lit("https://"), raw)))


def hostname(url: Column) -> Column:
    """Host of an absolute URL without port or IPv6 brackets, lower-cased; '' when absent."""
    return F.when(url.rlike(_HOSTNAME), F.lower(F.regexp_replace(url, _HOSTNAME, "$1$2"))).otherwise("")


def same_site(a: Column, b: Column) -> Column:
    """Equal hostnames; scheme and port may differ, and no domain folding is done."""
    return hostname(a) == hostname(b)


def _drop_dot_segments(path: Column) -> Column:
    segments = F.split(F.regexp_replace(path, r"^/", ""), "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    return F.when(path.rlike(_DOT_SEGMENT), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def base_root(base: Column) -> Column:
    """``scheme://host[:port]`` prefix of a canonical URL."""
    return F.regexp_extract(base, r"^[^:]*://[^/?#]*", 0)


def base_path(base: Column) -> Column:
    """Path of an absolute URL as written."""
    return F.regexp_extract(base, r"^[^:]*://[^/?#]*([^?#]*)", 1)


def resolve_hrefs(hrefs: Column, root: Column, path: Column, same_host: Column | None = None) -> Column:
    """``array<struct<pos, url>>``: hrefs of one page as absolute canonical URLs, in order.

    ``root`` and ``path`` are ``base_root`` and ``base_path`` of the page URL, kept in
    columns of their own so that they are taken apart once per page. Unparsable hrefs
    drop out, and so do other hosts when ``same_host`` is given. The steps are chained
    over the array: each one names its input once instead of repeating the expression.
    """
    directory = F.concat(F.lit("/"), F.regexp_replace(F.ltrim(path, F.lit("/")), r"[^/]*\z", ""))
    nothing = F.lit(None).cast("string")

    def target(href: Column) -> Column:
        ref = F.regexp_extract(href, r"^[^?#]*", 0)
        return (
            F.when(href.rlike(r"^[^#]*[\x00-\x1f\x7f]"), nothing)
            .when(ref == "", F.concat(root, path))
            .when(ref.startswith("///"), F.concat(root, ref))
            .when(ref.startswith("//"), F.concat(F.regexp_extract(root, r"^[^:]*:", 0), ref))
            .when(ref.startswith("/"), F.concat(root, ref))
            .when(ref.rlike(_SCHEME), ref)
            .when(ref.rlike(r"^[^/]*:"), nothing)
            .otherwise(F.concat(root, directory, ref))
        )

    def without_dots(url: Column) -> Column:
        parts = r"^([^:]*://[^/]*)(/[\s\S]*)\z"
        tidy = F.concat(F.regexp_extract(url, parts, 1), _drop_dot_segments(F.regexp_extract(url, parts, 2)))
        return F.when(url.rlike(r"/\.{1,2}(/|\z)") & url.rlike(parts), tidy).otherwise(url)

    numbered = F.transform(hrefs, lambda href, i: F.struct(i.alias("pos"), target(href).alias("url")))
    tidied = F.transform(numbered, lambda x: F.struct(x["pos"].alias("pos"), without_dots(x["url"]).alias("url")))
    urls = F.transform(tidied, lambda x: F.struct(x["pos"].alias("pos"), canonical_url(x["url"]).alias("url")))
    if same_host is None:
        return F.filter(urls, lambda x: x["url"].isNotNull())
    return F.filter(urls, lambda x: x["url"].isNotNull() & (hostname(x["url"]) == same_host))


def resolve_url(base: Column, href: Column, strict_base: Column | None = None) -> Column:
    """Absolute canonical URL of one ``href`` seen on page ``base``; NULL when it does not parse.

    ``base`` is the canonical (slash-trimmed) page URL, so a path-relative link on
    ``/a/`` resolves against ``/``. Pass the untrimmed page URL as ``strict_base``
    to resolve path-relative links against its real directory instead.
    """
    path = base_path(base if strict_base is None else strict_base)
    return F.get(resolve_hrefs(F.array(href), base_root(base), path), F.lit(0))["url"]


# Suffixes of images, fonts, media and documents that carry no page text.
ASSET_SUFFIXES = [
    "jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "ico", "heic", "woff", "woff2", "ttf", "eot", "otf", "mp4", "mp3",
    "webm", "ogg", "wav", "mov", "m3u8", "ts", "mpd", "avi", "mkv", "m4s", "pdf", "zip",
]


def is_static_asset(url: Column) -> Column:
    """True for URLs whose path ends in a known asset suffix."""
    return url.rlike(r"^[^:/?#]+://[^/]*/.*\.(" + "|".join(ASSET_SUFFIXES) + r")$")
