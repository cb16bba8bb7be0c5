"""Column functions over URLs."""

from __future__ import annotations

import ipaddress
from functools import reduce
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


# fixed values: endings and names of pages that stand for their folder or bare address
PAGE_ENDING = r"(?i)\.(aspx|html?|jsp)(?=$|\?)"
INDEX_PAGE = r"(?i)/(index|default)(?=$|\?)"


def path_of(url: Column) -> Column:
    """Path for comparison: without fragment, scheme, host, page endings, index pages and trailing slashes; lower case, query kept."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"#.*$", "")
    u = F.regexp_replace(u, r"^(?i:https?://)", "")
    u = F.regexp_replace(u, r"^[^/.]*\.[^/]*$", "/")
    u = F.regexp_replace(u, r"^[^/.]*\.[^/]*/", "/")
    u = F.regexp_replace(u, PAGE_ENDING, "")
    u = F.regexp_replace(u, INDEX_PAGE, "")
    u = F.regexp_replace(u, "/+$", "")
    return F.lower(F.when(u == "", "/").otherwise(u))


def host_of(url: Column) -> Column:
    """Host in lower case without scheme and ``www.``; a port stays."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"^(?i:https?://)", "")
    return F.regexp_replace(F.lower(F.substring_index(u, "/", 1)), r"^www\.", "")


def bare_host(url: Column) -> Column:
    """``host_of`` without port, query and a leading ``preview.`` label."""
    return F.regexp_replace(F.regexp_replace(host_of(url), r"[:?#].*$", ""), r"^preview(-[a-z0-9]+)?\.", "")


def under_path(path: Column, prefix: Column) -> Column:
    """Whether ``path`` is ``prefix``, below it, or it with a file ending; whole segments only."""
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/"))) | path.startswith(F.concat(prefix, F.lit(".")))


def asset_identity(url: Column) -> Column:
    """Letters and digits of a file's name: percent-decoded, without rendition and ending."""
    base = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^.*/", "")
    plain = F.coalesce(F.try_url_decode(F.replace(base, F.lit("+"), F.lit("%2B"))), base)
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(plain, r":.*$", ""), r"\.[A-Za-z0-9]{2,5}$", "")), "[^a-z0-9]", "")


def author_path(url: Column, domain: Column, lang_path: Column, root: Column) -> Column:
    """Where a page stands in the editing tree: the market's content root with the path below the market's language path, no ending.

    Null for a market without a root, another domain, and paths outside the language path; ``www.`` and preview hosts count as the domain.
    """
    host = F.lower(F.regexp_extract(F.trim(url), r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"^(www|preview(-[a-z]+)?)\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.trim(url), r"(?i)^https?://[^/?#]*([^?#]*)", 1), r"(?i)\.html?$", ""), "/+$", "")
    lp = F.regexp_replace(F.coalesce(lang_path, F.lit("")), "^/+|/+$", "")
    lp = F.when(lp != "", F.concat(F.lit("/"), lp)).otherwise("")
    inside = (lp == "") | (F.lower(path) == F.lower(lp)) | F.lower(path).startswith(F.concat(F.lower(lp), F.lit("/")))
    return F.when(root.isNotNull() & (host == domain) & inside, F.concat(F.regexp_replace(root, "/+$", ""), F.substr(path, F.length(lp) + 1)))


def environment_of(host: Column, preview: str = r"^preview", author: str = r"^author") -> Column:
    """unknown, preview, author or production, by the host's first label."""
    return F.when(F.coalesce(host, F.lit("")) == "", "unknown").when(host.rlike(preview), "preview").when(host.rlike(author), "author").otherwise("production")


def verdict_of(status: Column) -> Column:
    """ok, dead or unverified from an HTTP status."""
    return F.when(status.between(200, 299), "ok").when(status.isin(404, 410) | (status >= 500), "dead").otherwise("unverified")


def urls_in(text: Column) -> Column:
    """All http(s) URLs of a text in order, repeats included, without trailing marks; null: none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(https?://[^\s<>\"')\]]+)"), F.lit(1))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:]+$", ""))


def is_asset(url: Column, marks: tuple[str, ...]) -> Column:
    """Whether an address has any of ``marks`` (hosts or parts of paths of an asset store) in it."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(url), F.lit(m.lower())) for m in marks], F.lit(False))


def split_urls(text: Column) -> Column:
    """http(s) URLs of a text without trailing marks; of those that differ in case only the first stays."""
    found = urls_in(text)
    none = F.array().cast("array<string>")
    return F.aggregate(found, none, lambda acc, u: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(u)), acc).otherwise(F.array_append(acc, u)))


@F.pandas_udf(StringType())
def absolute(href: pd.Series, base: pd.Series) -> pd.Series:
    """The http(s) address a link leads to, without fragment; null for in-page, mail, phone, script and data links."""

    def one(h, b):
        h = (h or "").strip().replace("&amp;", "&")
        if not h or h.lower().startswith(("#", "mailto:", "tel:", "javascript:", "data:")):
            return None
        try:
            at = urljoin(b or "", h).split("#")[0]
            return at if urlsplit(at).hostname and at.lower().startswith(("http://", "https://")) else None
        except ValueError:
            return None

    return pd.Series([one(h, b) for h, b in zip(href, base, strict=True)], dtype=object)


def private_address(address: Column) -> Column:
    """Whether an IP address is no public one: private, local, reserved, multicast, mapped or translated; texts that are no address count."""

    @F.pandas_udf("boolean")
    def judge(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                ip = ipaddress.ip_address((v or "").strip().strip("[]"))
            except ValueError:
                return True
            inner = getattr(ip, "ipv4_mapped", None) or (ipaddress.ip_address(int(ip) & 0xFFFFFFFF) if ip.version == 6 and ip in ipaddress.ip_network("64:ff9b::/96") else None)
            ip = inner or ip
            return not ip.is_global or ip.is_multicast

        return values.map(one)

    return judge(address)


def fetchable(url: Column, domains: tuple[str, ...]) -> Column:
    """Why an address must not be fetched: scheme, port, credentials, bare IP or foreign host; null if it may."""
    rest = F.regexp_replace(url, r"^(?i:https?://)", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host, port = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")), F.regexp_extract(authority, r":(\d+)$", 1)
    listed = [(host == d) | host.endswith(f".{d}") for d in domains]
    known = reduce(lambda a, b: a | b, listed, F.lit(False))
    return (
        F.when(url.isNull() | ~url.rlike(r"^(?i:https?://)"), "scheme").when(F.contains(authority, F.lit("@")), "credentials")
        .when((port != "") & ~port.isin("80", "443"), "port").when(host.rlike(r"^[\d.]+$|^\["), "address").when(~known, "host")
    )


def looks_like_login(url: Column) -> Column:
    """Whether an address is that of a sign-in page."""
    return F.coalesce(url.rlike(r"(?i)(^|[/.?=_-])(login|logon|signin|sign-in|sso|adfs|okta|saml|oauth2?|authorize)([/.?=_-]|$)"), F.lit(False))
