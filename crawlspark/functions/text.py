"""Text and number functions as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps
from html.entities import name2codepoint

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def built_once(build: Callable) -> Callable:
    """Keeps what ``build`` makes of names and other plain values, for each application: large Columns take Python seconds to build."""
    kept: dict = {}

    @wraps(build)
    def get(*args):
        key = (SparkContext._active_spark_context.applicationId, *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get


def trim_ws(c: Column) -> Column:
    """Strips all white space at both ends, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def or_empty(c: Column) -> Column:
    """'' for NULL: missing metadata is an empty text."""
    return F.coalesce(c, F.lit(""))


def not_empty(c: Column) -> Column:
    """NULL for ''."""
    return F.nullif(c, F.lit(""))


def html_escape(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


#: The named characters of HTML 4, the apostrophe, and the space that doesn't break as a plain one: ';name=character' each.
_NAMED = "".join(f";{name}={chr(point)}" for name, point in {**name2codepoint, "apos": ord("'"), "nbsp": ord(" ")}.items())
#: What is between an ampersand and a semicolon: its code point, or its place among the named characters.
_NUMBER = "cast(if(n rlike '^#[xX]', conv(substr(n, 3), 16, 10), substr(n, 2)) as int)"
_BY_NUMBER = f"if({_NUMBER} between 1 and 1114111 and not {_NUMBER} between 55296 and 57343, decode(unhex(lpad(hex({_NUMBER}), 8, '0')), 'UTF-32'), null)"
_PLACE = "instr('{0}', concat(';', n, '='))".format(_NAMED.replace("\\", "\\\\").replace("'", "\\'"))
_BY_NAME = "if({0} > 0, substr('{1}', {0} + length(n) + 2, 1), null)".format(_PLACE, _NAMED.replace("\\", "\\\\").replace("'", "\\'"))
_ENTITY = "'^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,7});'"
_PIECE = (
    f"p -> get(transform(array(regexp_extract(p, {_ENTITY}, 1)), n -> if(n = '', concat('&', p), "
    f"coalesce(if(startswith(n, '#'), {_BY_NUMBER}, {_BY_NAME}) || substr(p, length(n) + 2), concat('&', p)))), 0)"
)
_DECODED = f"v -> if(contains(v, '&'), get(transform(array(split(v, '&')), s -> concat(s[0], array_join(transform(slice(s, 2, size(s)), {_PIECE}), ''))), 0), v)"


_AMPERSAND = re.compile(r"&(?:(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,7});)?")


def whole_entities(html: str) -> str:
    """Escapes ampersands that begin no whole entity, which Python's parser would complete: they stay as written, as in ``html_unescape``."""
    whole = lambda n: n and (n[0] == "#" or n in name2codepoint or n == "apos")
    return _AMPERSAND.sub(lambda m: m[0] if whole(m[1]) else "&amp;" + m[0][1:], html)


def html_unescape(c: Column) -> Column:
    """Entities by number, and by the names of HTML 4; what is no entity stays as it is. Each is decoded once."""
    return F.get(F.call_function("transform", F.array(c), F.expr(_DECODED)), F.lit(0))


def format_bytes(c: Column) -> Column:
    """1023 -> '1023 B', 1024 -> '1 KB', 1572864 -> '1.5 MB'."""
    mb = F.format_string("%.1f MB", c / 1048576)
    kb = F.concat(F.floor(c / 1024 + 0.5).cast("string"), F.lit(" KB"))
    return F.when(c >= 1048576, mb).when(c >= 1024, kb).otherwise(F.concat(c.cast("string"), F.lit(" B")))


def percent(done: Column, total: Column) -> Column:
    """Rounded half up; 0 when there is nothing to do."""
    return F.when(total > 0, F.floor(done * 100.0 / total + 0.5)).otherwise(0).cast("long")


# The patterns of bot names and file names, and the words of messages below.


def bot_name(ua: Column, compat: bool = False) -> Column:
    """The crawler's product token in a User-Agent, else '*'. ``compat`` wants '(compatible;' with the bracket."""
    opening = r"\(compatible;" if compat else r"(?:\(|;\s*)compatible;"
    return F.coalesce(
        not_empty(F.regexp_extract(ua, opening + r"\s*([A-Za-z][A-Za-z-]*)", 1)),
        not_empty(F.regexp_extract(ua, r"^([A-Za-z][A-Za-z-]+)/", 1)),
        F.lit("*"),
    )


def count_lines(c: Column) -> Column:
    """Lines that aren't blank."""
    return F.coalesce(F.size(F.filter(F.split(c, "\n"), lambda x: trim_ws(x) != "")), F.lit(0)).cast("long")


def name_from_template(template: Column, hostname: Column, datetime: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{hostname}"), hostname), F.lit("{datetime}"), datetime)


def export_filename(name: Column, extension: str) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(name, r'[/\\:*?"<>|,]', "-"), r"\s+", "_")
    return F.concat(cleaned, F.lit("." + extension))


def completion_text(total: Column, ok: Column) -> Column:
    """'5 URLs — 4 OK, 1 errors'; no errors, no mention."""
    errors = total - ok
    return F.concat(F.format_string("%d URLs — %d OK", total, ok), F.when(errors > 0, F.format_string(", %d errors", errors)).otherwise(""))


def iso_timestamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
