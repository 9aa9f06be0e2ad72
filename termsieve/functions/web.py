"""Column functions over URLs and fetched pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
# File kinds by extension, refusing statuses, challenge markers, server names.
FILE_KINDS = {
    "pdf": r"\.pdf$",
    "office": r"\.(docx?|pptx?|xlsx?|odt|odp|ods|rtf)$",
    "image": r"\.(jpe?g|png|gif|webp|avif|svg|bmp|tiff?)$",
    "video": r"\.(mp4|webm|mov|m4v|m3u8|ogv)$",
    "audio": r"\.(mp3|wav|m4a|aac|oga|ogg|flac)$",
    "subtitle": r"\.(vtt|srt)$",
}
BLOCK_STATUSES = (401, 403, 429, 503)
PAGE_MARKERS = ("cf-chl", "challenge-platform", "px-captcha")
BOT_MARKERS = ("captcha", "challenge-platform", "cf-chl", "access denied", "pardon our interruption", "are you a robot", "request unsuccessful. incapsula", "perimeterx", "px-captcha")
VENDORS = ("cloudflare", "akamai", "incapsula", "imperva")
HEAD = 200_000
TERMS = "terms|legal|conditions|disclaimer|nutzungsbedingungen|impressum|condiciones|aviso legal|利用規約|ご利用条件|使用条款|法律声明|使用條款"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def authority(url: Column) -> Column:
    """Host and port, lower-case, without user."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, SCHEME + r"//([^/?#]*)", 2), "^.*@", ""))


def host(url: Column) -> Column:
    return F.regexp_extract(authority(url), r"^(\[[^\]]*\]|[^:]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, SCHEME + r"//[^/?#]*([^?#]*)", 2)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def normalized(url: Column) -> Column:
    url = F.trim(url)
    port = F.regexp_extract(authority(url), r":([0-9]+)$", 1)
    default = ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443")) | (port == "")
    return F.concat(
        scheme(url), F.lit("://"), host(url), F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path(url) == "", "/").otherwise(path(url)), F.when(query(url) == "", "").otherwise(F.concat(F.lit("?"), query(url)))
    )


def registrable(host_: Column) -> Column:
    """The last two labels: enough to tell another host of a site from another site."""
    return F.substring_index(host_, ".", -2)


def _two_labels(name: str) -> str:
    return ".".join(name.split(".")[-2:])


def host_reason(url: Column, domains) -> Column:
    """Why a URL's host is out of scope; null where it is in scope."""
    domains = sorted({d.lower() for d in domains})
    h = host(url)
    return (
        F.when(~scheme(url).isin("http", "https"), "not_http")
        .when(h.isin(*domains), None)
        .when(registrable(h).isin(*sorted({_two_labels(d) for d in domains})), "subdomain")
        .otherwise("third_party")
    )


def page_reason(url: Column, domains, include=(), exclude=(), allowed: Column | None = None) -> Column:
    """Host, then robots (`allowed`), then include and exclude patterns; null for a page in scope."""
    hits = lambda patterns: reduce(lambda a, b: a | b, (url.rlike(p) for p in patterns), F.lit(False))
    out = F.when(host_reason(url, domains).isNotNull(), host_reason(url, domains))
    if allowed is not None:
        out = out.when(~allowed, "robots")
    if include:
        out = out.when(~hits(include), "not_included")
    return out.when(hits(exclude), "excluded")


def file_kind(url: Column) -> Column:
    p = F.lower(path(url))
    out = F.when(F.lit(False), "")
    for kind, pattern in FILE_KINDS.items():
        out = out.when(p.rlike(pattern), kind)
    return out


def looks_blocked(status: Column, html: Column) -> Column:
    head = F.lower(F.substring(html, 1, HEAD))
    return F.coalesce(status.isin(*BLOCK_STATUSES), F.lit(False)) | reduce(lambda a, b: a | b, (F.contains(head, F.lit(m)) for m in PAGE_MARKERS))


def bot_protection(status: Column, headers: Column, body: Column) -> Column:
    """What refused a request, in words; null where nothing did. headers: a map with lower-case names."""
    text, server = F.lower(F.substring(body, 1, HEAD)), F.lower(F.coalesce(F.try_element_at(headers, F.lit("server")), F.lit("")))
    out = F.when(~F.coalesce(status.isin(*BLOCK_STATUSES), F.lit(False)), None).when(F.map_contains_key(headers, "cf-mitigated"), "Cloudflare challenge (cf-mitigated header)")
    for m in BOT_MARKERS:
        out = out.when(F.contains(text, F.lit(m)), f'Bot-protection page (contains "{m}")')
    for v in VENDORS:
        out = out.when(F.contains(server, F.lit(v)), F.concat(F.lit(f"Blocked by {v.title()} (HTTP "), status.cast("string"), F.lit(")")))
    return out


def page_class(status: Column, html: Column, final_url: Column, error: Column, domains) -> Column:
    """(status, reason) of a captured page: refused, redirected out of scope, failed, or ok."""
    code = F.concat(F.lit("HTTP "), F.coalesce(status.cast("string"), F.lit("None")))
    away = host_reason(final_url, domains)
    pair = lambda a, b: F.struct(F.lit(a).alias("status"), b.cast("string").alias("reason"))
    return (
        F.when(looks_blocked(status, F.coalesce(html, F.lit(""))), pair("blocked", code))
        .when(away.isNotNull(), pair("skipped", F.concat(F.lit("redirected_"), away)))
        .when(status >= 400, pair("failed", code))
        .when(html.isNull(), pair("failed", F.substring(F.coalesce(error, F.lit("")), 1, 200)))
        .otherwise(pair("ok", F.lit(None)))
    )


def title(html: Column) -> Column:
    return F.nullif(clean(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def language(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r'<html[^>]*\slang="([^"]*)"', 1), F.lit(""))


def links(html: Column) -> Column:
    """Targets of anchors in order, as written."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def visible_text(html: Column) -> Column:
    """Text with scripts, styles, templates, comments and tags taken out; entities stay as written."""
    for pattern in (r"(?s)<script.*?</script>", r"(?s)<style.*?</style>", r"(?s)<template.*?</template>", r"(?s)<noscript.*?</noscript>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    return clean(html, 2**31 - 1)


def terms_link(text: Column, url: Column) -> Column:
    return (F.lower(text).rlike(TERMS) | F.lower(url).rlike(TERMS)) & url.startswith("http")


def box(boxes: Column) -> Column:
    """The box around an array of boxes (x0, top, x1, bottom), to one decimal; null for none."""
    side = lambda of, k: F.round(of(F.transform(boxes, lambda b: b[k])), 1)
    around = F.array(side(F.array_min, 0), side(F.array_min, 1), side(F.array_max, 2), side(F.array_max, 3))
    return F.when(F.size(boxes) > 0, around)


def routed(kind: Column, in_scope: Column) -> Column:
    """Where what a page embeds goes: a frame that is in scope is crawled like a link, a kind unknown is `other`."""
    return F.when((kind == "frame") & F.coalesce(in_scope, F.lit(False)), "link").otherwise(F.coalesce(kind, F.lit("other")))
