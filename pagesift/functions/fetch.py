"""Expressions over a fetch log: status classes, labels, error reasons, content gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift import schemas as S

# HTTP codes by fetch class. Every other code is "impossible".
OK_CODES = [200]
RETRY_CODES = [408, 429, 500, 502, 503, 504]
MANUAL_CODES = [400, 401, 411]

# Markers of pages that only render in a browser.
SPA_MARKERS = [
    '<div id="root"',
    '<div id="app"',
    '<div id="__next"',
    "data-reactroot",
    "ng-version",
    "__NEXT_DATA__",
    "__NUXT__",
    "window.__INITIAL_STATE__",
]
# Fixed value: a page that asks for JavaScript where it is off.
SPA_NOSCRIPT = r"(?i)<noscript>[^<]*javascript"

# Tags that mark HTML at the start of a body (WHATWG MIME sniffing).
_HTML_STARTS = "!DOCTYPE HTML|HTML|HEAD|SCRIPT|IFRAME|H1|DIV|FONT|TABLE|A|STYLE|TITLE|B|BODY|BR|P|!--"

# Leading-byte signatures of the same sniffing table, in table order.
_SIGNATURES = [
    (r"(?i)^[\t\n\f\r ]*<(?:" + _HTML_STARTS + r")[ >]", "text/html"),
    (r"^[\t\n\f\r ]*<\?xml", "text/xml"),
    (r"^%PDF-", "application/pdf"),
    (r"^%!PS-Adobe-", "application/postscript"),
    (r"^(?:\xFE\xFF|\xFF\xFE|\xEF\xBB\xBF)", "text/plain"),
    (r"^\x00\x00[\x01\x02]\x00", "image/x-icon"),
    (r"^BM", "image/bmp"),
    (r"^GIF8[79]a", "image/gif"),
    (r"^RIFF[\s\S]{4}WEBPVP", "image/webp"),
    (r"^\x89PNG\r\n\x1A\n", "image/png"),
    (r"^\xFF\xD8\xFF", "image/jpeg"),
    (r"^FORM[\s\S]{4}AIFF", "audio/aiff"),
    (r"^ID3", "audio/mpeg"),
    (r"^OggS\x00", "application/ogg"),
    (r"^MThd\x00\x00\x00\x06", "audio/midi"),
    (r"^RIFF[\s\S]{4}AVI ", "video/avi"),
    (r"^RIFF[\s\S]{4}WAVE", "audio/wave"),
    (r"^[\s\S]{4}ftypmp4", "video/mp4"),
    (r"^\x1A\x45\xDF\xA3", "video/webm"),
    (r"^[\s\S]{34}LP", "application/vnd.ms-fontobject"),
    (r"^\x00\x01\x00\x00", "font/ttf"),
    (r"^OTTO", "font/otf"),
    (r"^ttcf", "font/collection"),
    (r"^wOFF", "font/woff"),
    (r"^wOF2", "font/woff2"),
    (r"^\x1F\x8B\x08", "application/x-gzip"),
    (r"^PK\x03\x04", "application/zip"),
    (r"^Rar!\x1A\x07", "application/x-rar-compressed"),
    (r"^\x00\x61\x73\x6D", "application/wasm"),
]
_BINARY_BYTE = r"[\x00-\x08\x0B\x0E-\x1A\x1C-\x1F]"


def fetch_class(http_status: Column) -> Column:
    """HTTP code to fetch class (impossible, ok, retry, manual)."""
    return (
        F.when(http_status.isin(OK_CODES), F.lit(S.FETCH_OK))
        .when(http_status.isin(RETRY_CODES), F.lit(S.FETCH_RETRY))
        .when(http_status.isin(MANUAL_CODES), F.lit(S.FETCH_MANUAL))
        .otherwise(F.lit(S.FETCH_IMPOSSIBLE))
    )


def _label(code: Column, labels: list[str], default: str) -> Column:
    chain = F.when(code == 0, F.lit(labels[0]))
    for value, text in enumerate(labels[1:], start=1):
        chain = chain.when(code == value, F.lit(text))
    return chain.otherwise(F.lit(default))


def fetch_label(code: Column) -> Column:
    return _label(code, S.FETCH_STATUS_LABELS, S.FETCH_STATUS_UNKNOWN)


def crawl_label(code: Column) -> Column:
    return _label(code, S.CRAWL_STATUS_LABELS, S.CRAWL_STATUS_LABELS[S.UNKNOWN])


def error_reason(error_kind: Column) -> Column:
    """Reason label of a failed fetch; NULL when the fetch did not fail."""
    return (
        F.when(error_kind.isNull() | (error_kind == ""), F.lit(None).cast("string"))
        .when(error_kind == "dns", F.lit("dns_error"))
        .when(error_kind == "timeout", F.lit("timeout"))
        .when(error_kind == "network", F.lit("connection_error"))
        .otherwise(F.lit("parse_error"))
    )


def error_reasons(error_kind: Column, http_status: Column) -> Column:
    """All reasons one fetch counts for: its error, or ``http_5xx`` for any status from 500 up."""
    failed = error_reason(error_kind)
    return (
        F.when(failed.isNotNull(), F.array(failed))
        .when(http_status >= 500, F.array(F.lit("http_5xx")))
        .otherwise(F.array().cast("array<string>"))
    )


def sniff_content_type(body: Column) -> Column:
    """Content type from the first 512 bytes, parameters stripped."""
    head = F.decode(F.substring(F.encode(body, "UTF-8"), 1, 512), "ISO-8859-1")

    def kind(h: Column) -> Column:
        chain = F.when(h.rlike(_SIGNATURES[0][0]), F.lit(_SIGNATURES[0][1]))
        for pattern, name in _SIGNATURES[1:]:
            chain = chain.when(h.rlike(pattern), F.lit(name))
        return chain.when(h.rlike(_BINARY_BYTE), F.lit("application/octet-stream")).otherwise(F.lit("text/plain"))

    # a one-element array gives the head a name, so that the chain does not repeat its expression
    return F.get(F.transform(F.array(head), kind), F.lit(0))


def effective_content_type(content_type: Column, nosniff: Column, body: Column) -> Column:
    """The header is trusted only together with ``nosniff``; otherwise the body decides."""
    trusted = F.coalesce(nosniff, F.lit(False)) & (F.coalesce(content_type, F.lit("")) != "")
    return F.when(trusted, content_type).otherwise(sniff_content_type(body))


def is_text(content_type: Column) -> Column:
    return content_type.rlike("text/(?:plain|html|markdown)")


def is_client_rendered(body: Column) -> Column:
    return reduce(lambda a, b: a | b, [body.contains(m) for m in SPA_MARKERS]) | body.rlike(SPA_NOSCRIPT)
