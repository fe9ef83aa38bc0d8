"""URL functions as Columns. URLs of other schemes than http and https are not links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import not_empty, once

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.-]*://)(?:[^/?#@]*@)?([^/?#]+)"


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def host(url: Column) -> Column:
    """The host name in lower case, without port; NULL for no URL."""
    return F.lower(not_empty(F.regexp_extract(url, _HOST, 1)))


def origin(url: Column) -> Column:
    """scheme://host[:port] in lower case, without the scheme's default port; NULL for no URL."""
    whole = F.lower(F.concat(F.regexp_extract(url, _ORIGIN, 1), F.regexp_extract(url, _ORIGIN, 2)))
    return not_empty(F.regexp_replace(F.regexp_replace(whole, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1"))


def normalised_origin(text: Column) -> Column:
    """What a user typed as an origin: trimmed, without trailing slash; NULL if it is none."""
    return origin(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"/$", ""))


def is_http(url: Column) -> Column:
    return url.rlike(r"^(?i)https?:")


def has_http_host(url: Column) -> Column:
    """``is_http`` with a ``host``."""
    return url.rlike(r"(?i)^https?://(?:[^/?#@]*@)?[^/?#:]")


def after_host(url: Column) -> Column:
    """Path and query; '/' if empty."""
    rest = F.regexp_extract(strip_fragment(url), r"(?s)^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def skipped(href: Column) -> Column:
    """References that are never followed."""
    return href.isNull() | (href == "") | href.startswith("#") | href.startswith("javascript:") | href.contains("${") | href.contains("{{")


#: Characters that stay as they are in a path and in a query; all others are percent-encoded. A percent sign stays.
_PATH_SAFE, _QUERY_SAFE = r"!$%&'()*+,\-./0-9:;=@A-Z\[\]_a-z|~\\", r"!$%&()*+,\-./0-9:;=?@A-Z\[\]^_`a-z{|}~\\"
_USER_SAFE, _FRAGMENT_SAFE = r"!$%&'()*+,\-.0-9A-Z_a-z~", r"#!$%&'()*+,\-./0-9:;=?@A-Z\[\]^_a-z{|}~\\"
#: URLs that are written out already: no capitals in the host, no port or user, no dots to remove, nothing to encode.
_PLAIN_ROOT = r"^https?://[a-z0-9.-]*[a-z][a-z0-9.-]*"
_PLAIN = rf"{_PLAIN_ROOT}/[{_PATH_SAFE}]*(?:\?[{_QUERY_SAFE}]*)?$"
#: References that are such URLs (a backslash would count as a slash), and paths from the root that only need encoding.
_WHOLE = rf"{_PLAIN_ROOT}/[{_PATH_SAFE[:-2]}]*(?:\?[{_QUERY_SAFE}]*)?(?:#[{_FRAGMENT_SAFE}]*)?\z"
_ROOTED = r"^/(?:[^/\\?#\x00-\x20][^\\?#\x00-\x20]*)?\z"
_DOTS = r"(?i)/(?:\.|%2e){1,2}(?:/|$|\?)"


def _encoded(text: Column, safe: str) -> Column:
    """Percent-encodes the UTF-8 bytes of characters that aren't safe."""
    one = lambda run: F.when(run.rlike(f"[^{safe}]"), F.regexp_replace(F.hex(F.encode(run, "UTF-8")), "(..)", "%$1")).otherwise(run)
    return F.when(text.rlike(f"[^{safe}]"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"[{safe}]+|[^{safe}]+"), 0), one), "")).otherwise(text)


def _without_dots(path: Column) -> Column:
    """Removes '.' and '..' segments, also with encoded dots; the path begins with '/'."""
    parts = F.split(path, "/")
    empty = F.array().cast("array<string>")
    single, double = (lambda x: x.rlike(r"(?i)^(?:\.|%2e)$")), (lambda x: x.rlike(r"(?i)^(?:\.|%2e){2}$"))
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), empty,
        lambda acc, x: F.when(double(x), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(single(x), acc).otherwise(F.concat(acc, F.array(x))),
    )
    ended = lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when((single(last) | double(last)) & (F.size(k) > 0), "/").otherwise(""))
    return F.when(path.rlike(_DOTS), once(kept, ended)).otherwise(path)


def base_parts(base: Column) -> Column:
    """What ``resolve_on`` needs of a page's URL, to be computed once a page."""
    plain = strip_fragment(base)
    path = F.regexp_extract(plain, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)", 1)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    return F.struct(
        root.alias("root"), root.rlike(rf"{_PLAIN_ROOT}\z").alias("plain_root"), host(base).alias("host"), plain.alias("plain"),
        F.lower(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)).alias("scheme"),
        F.regexp_replace(plain, r"(?s)\?.*$", "").alias("no_query"),
        F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*/)", 1)).otherwise("/").alias("folder"),
    )


def _ascii_host(name: Column) -> Column:
    """A host in ASCII: percent-decoded, lower case, international labels in their ASCII form; NULL if it can't be one."""
    decoded = F.when(name.contains("%"), F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(name)
    small = once(decoded, lambda d: F.when(d.rlike(r"[^\x00-\x7f]"), F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), F.lower(d)))).otherwise(F.lower(d)))
    return once(small, lambda h: F.when(h.rlike(r"^\[[0-9a-f:.]+\]$") | ((h != "") & ~h.rlike(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")), h))


def _port(port: Column, scheme: Column) -> Column:
    """':8080' of what follows the host; '' for none and the scheme's own; NULL if it is none."""
    number = F.regexp_extract(port, r"^:([0-9]*)$", 1).try_cast("int")
    default = F.when(scheme == "https:", 443).otherwise(80)
    return F.when(port.isin("", ":") | (number == default), "").when(number <= 65535, F.concat(F.lit(":"), number.cast("string")))


def _written_out(joined: Column) -> Column:
    """An http URL as the standard writes it; NULL if it is none. Others stay as they are."""

    def parts_of(u: Column) -> Column:
        authority = F.regexp_extract(u, r"^[a-zA-Z]+://([^/?#]*)", 1)
        place = F.regexp_replace(authority, r"(?s)^.*@", "")
        return F.struct(
            F.lower(F.regexp_extract(u, r"^([a-zA-Z]+:)", 1)).alias("scheme"), F.regexp_extract(authority, r"(?s)^(.*)@", 1).alias("user"), F.contains(authority, F.lit("@")).alias("has_user"),
            F.regexp_replace(place, r":[^:\]]*$", "").alias("name"), F.regexp_extract(place, r"(:[^:\]]*)$", 1).alias("port"),
            F.regexp_extract(u, r"(?s)^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract(u, r"(?s)^[^?#]*(\?[^#]*)", 1).alias("query"), F.regexp_extract(u, r"(?s)(#.*)$", 1).alias("fragment"),
        )

    def written(p: Column) -> Column:
        password = F.regexp_extract(p["user"], r"(?s)^[^:]*:(.+)$", 1)
        user = F.concat(_encoded(F.regexp_extract(p["user"], r"(?s)^([^:]*)", 1), _USER_SAFE), F.when(password != "", F.concat(F.lit(":"), _encoded(password, _USER_SAFE))).otherwise(""))
        user = F.when(p["has_user"] & ~p["user"].isin("", ":"), F.concat(user, F.lit("@"))).otherwise("")
        path = F.when(p["path"] == "", "/").otherwise(_encoded(_without_dots(p["path"]), _PATH_SAFE))
        return F.concat(p["scheme"], F.lit("//"), user, _ascii_host(p["name"]), _port(p["port"], p["scheme"]), path, _encoded(p["query"], _QUERY_SAFE), _encoded(p["fragment"], _FRAGMENT_SAFE))

    plain = joined.rlike(_PLAIN) & ~joined.rlike(_DOTS)
    return F.when(plain | ~joined.rlike(r"^(?i)https?:"), joined).otherwise(once(parts_of(joined), written))


def resolve_on(href: Column, parts: Column) -> Column:
    """As ``resolve``, with the ``base_parts`` of the page. Most links are told by one pattern to need no more than encoding."""
    no_dots = ~(href.contains("/.") | href.contains("/%2"))
    rooted = F.concat(parts["root"], _encoded(href, _PATH_SAFE))
    return F.when(no_dots & href.rlike(_WHOLE), href).when(no_dots & parts["plain_root"] & href.rlike(_ROOTED), rooted).otherwise(_resolved(href, parts))


def _resolved(href: Column, parts: Column) -> Column:
    """``resolve_on`` for any reference."""

    def joined(h: Column) -> Column:
        named = h.rlike(r"^(?i)https?:")
        tail = F.regexp_extract(h, r"(?s)^[^?#]*(.*)$", 1)
        front = F.translate(F.regexp_extract(h, r"(?s)^(?:[hH][tT][tT][pP][sS]?:)?([^?#]*)", 1), "\\", "/")
        scheme = F.when(named, F.lower(F.regexp_extract(h, r"^([a-zA-Z]+:)", 1))).otherwise(parts["scheme"])

        def with_front(f: Column) -> Column:
            # With another scheme than the page's, what follows is a host, however many slashes there are.
            absolute = f.startswith("//") | (named & (scheme != parts["scheme"]))
            return (
                F.when(absolute, F.concat(scheme, F.lit("//"), F.regexp_replace(f, "^/+", ""), tail))
                .when(f.startswith("/"), F.concat(parts["root"], f, tail))
                .when((f == "") & (tail == ""), parts["plain"])
                .when((f == "") & tail.startswith("?"), F.concat(parts["no_query"], tail))
                .when(f == "", F.concat(parts["plain"], tail))
                .otherwise(F.concat(parts["root"], parts["folder"], f, tail))
            )

        return F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") & ~named, h).otherwise(once(front, with_front))

    clean = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    return once(once(clean, joined), _written_out)


def resolve(href: Column, base: Column) -> Column:
    """The absolute URL of a reference on an http page ``base``, as the URL standard writes it; NULL if it can't be resolved.

    References of other schemes stay as they are. Deviating from the standard, a host of numbers isn't read as an IPv4
    address, an IPv6 address isn't shortened, and international labels follow the older IDNA (a sharp s becomes ss).
    """
    return once(base_parts(base), lambda parts: resolve_on(href, parts))


def absolute_link(link: Column, start: Column, stay_on_hostname: bool = False) -> Column:
    """A link found by a crawl as the address to fetch: resolved on the start URL, without fragment; '' if it is none.

    Links that an extension's page has given its own scheme and host get those of the start URL (not its port).
    """
    own = F.concat(F.regexp_extract(start, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.lit("//"), host(start))
    here = F.coalesce(F.concat(own, F.regexp_extract(link, r"(?is)^chrome-extension://[^/?#]*(.*)$", 1)), link)
    named = F.when(link.rlike("(?i)^chrome-extension:"), here).otherwise(link)
    found = F.trim(strip_fragment(resolve(named, start)))
    if stay_on_hostname:
        found = F.when(host(found) == host(start), found)
    return F.coalesce(F.when(link != "", found), F.lit(""))


def to_filename(url: Column) -> Column:
    """A file name for an archived page; names may collide."""
    tail = F.concat(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1), after_host(url))
    clean = F.regexp_replace(F.regexp_replace(tail, r"[^a-zA-Z0-9._-]", "_"), r"_+", "_")
    named = F.concat(F.substring(clean, 1, 200), F.lit(".html"))
    encoded = F.concat(F.translate(F.base64(F.encode(url, "UTF-8")), "+/=\r\n", "___"), F.lit(".html"))
    return F.when(origin(url).isNull(), encoded).otherwise(named)
