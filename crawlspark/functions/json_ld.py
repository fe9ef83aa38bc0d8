"""Structured data (JSON-LD) of a page in the JVM: a walk over the tokens of the JSON text, to any depth.

A script's text is cut into tokens; a string and the colon after it are a key. The first key of a name, in the order of the
text, counts, and if its object has the key again, the last of these (as in a parsed object). Its value is the tokens up
to the closing bracket. Deviating from a parsed object, what lies in a nested object that is given again under the same
key still counts, and keys that are whole numbers keep their place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once, or_empty

FIELDS = ("publisher", "dateModified", "datePublished", "authors", "headline", "alternateHeadline")
#: Stand for an escaped backslash and an escaped quote, so that a string ends at the next quote; JSON can't hold them as they are.
_BACKSLASH, _QUOTE = "\x01", "\x02"
_TOKEN = r'"[^"]*"\s*:|"[^"]*"|[{}\[\],]|[^\s{}\[\],:"]+'


def _masked(script: Column) -> Column:
    return F.replace(F.replace(script, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))


def _restored(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def is_json(script: Column) -> Column:
    """Whether the text is one JSON value and nothing else; single quotes and raw control characters in strings aren't JSON."""
    one = F.coalesce(F.json_array_length(F.concat(F.lit("["), script, F.lit("]"))) == 1, F.lit(False))
    strings = F.regexp_replace(_masked(script), '"[^"]*"', "")
    return one & ~script.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") & ~strings.contains("'") & ~_masked(script).rlike('"[^"\\n\\r\\t]*[\\n\\r\\t][^"]*"(?:\\s*[:,}\\]]|\\s*$)')


def tokens(script: Column) -> Column:
    """array<string>: keys with their colon, strings, brackets, commas and other values, without white space between them."""
    found = F.regexp_extract_all(_masked(script), F.lit(_TOKEN), 0)
    return F.transform(found, lambda t: F.when(t.rlike(r'^"[^"]*"\s+:$'), F.regexp_replace(t, r"\s+:$", ":")).otherwise(t))


def first_value(toks: Column, key: str) -> Column:
    """The JSON text of the first value of a key at any depth; NULL without the key."""
    name = f'"{key}":'
    step = lambda t: F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(-1).alias("level"), F.lit(False).alias("over"), F.lit(-1).alias("at"))

    def search(s: Column, t: Column) -> Column:
        hit = (t == name) & ~s["over"] & ((s["level"] < 0) | (s["level"] == s["depth"]))
        depth = s["depth"] + step(t)
        level = F.when(hit & (s["level"] < 0), s["depth"]).otherwise(s["level"])
        over = s["over"] | ((s["level"] >= 0) & (depth < s["level"]))
        return F.struct((s["i"] + 1).alias("i"), depth.alias("depth"), level.alias("level"), over.alias("over"), F.when(hit, s["i"] + 1).otherwise(s["at"]).alias("at"))

    def value(at: Column) -> Column:
        rest = F.slice(toks, at + 1, F.greatest(F.size(toks) - at, F.lit(0)))
        begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("ended"))

        def extent(s: Column, t: Column) -> Column:
            depth = F.when(s["ended"], s["depth"]).otherwise(s["depth"] + step(t))
            return F.struct(F.when(s["ended"], s["n"]).otherwise(s["n"] + 1).alias("n"), depth.alias("depth"), (s["ended"] | (depth == 0)).alias("ended"))

        length = F.aggregate(rest, begin, extent, lambda s: s["n"])
        return _restored(F.array_join(F.slice(rest, F.lit(1), length), ""))

    return F.when(F.array_contains(toks, name), once(F.aggregate(toks, start, search, lambda s: s["at"]), value))


def _scalar(value: Column) -> Column:
    """A JSON value as text: NULL for objects and arrays."""
    plain = F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)
    return F.when(~value.rlike(r"^[\[{]"), plain)


def _truthy(value: Column) -> Column:
    return F.coalesce(~value.rlike(r'^(?:""|null|false|-?0+(?:\.0+)?(?:[eE][+-]?\d+)?)$'), F.lit(False))


def _names(value: Column) -> Column:
    """The names of an author: of an array's members ('' for those without), or of an object; NULL if they change nothing."""
    each = F.transform(F.from_json(value, "array<string>"), lambda a: or_empty(F.when(a.startswith("{"), F.get_json_object(a, "$.name"))))
    own = F.get_json_object(value, "$.name")
    return F.when(value.startswith("["), F.array_join(each, ", ")).when(value.startswith("{") & (or_empty(own) != ""), own)


def _people(script: Column) -> Column:
    """The names of the persons in the topmost @graph."""
    graph = F.get_json_object(F.when(script.rlike(r"^\s*\{"), script), "$.@graph")
    people = F.filter(F.from_json(F.when(graph.startswith("["), graph), "array<string>"), lambda x: (F.get_json_object(x, "$.@type") == "Person") & (or_empty(F.get_json_object(x, "$.name")) != ""))
    return or_empty(F.array_join(F.transform(people, lambda x: F.get_json_object(x, "$.name")), ", "))


def json_ld(scripts: Column) -> Column:
    """Struct of FIELDS of a page's scripts: of each field the last script's value that isn't empty; authors as they are found.

    A script that is no JSON is passed over. One that is JSON's null ends with blanks in all fields, unless authors were
    found before it.
    """
    plain = [f for f in FIELDS if f not in ("publisher", "authors")]

    def facts(script: Column) -> Column:
        def of(toks: Column) -> Column:
            values = {k: first_value(toks, k) for k in plain}
            organisation = lambda p: F.when(p.startswith("{") & (F.get_json_object(p, "$.@type") == "Organization"), F.struct(F.get_json_object(p, "$.name").alias("name")))
            return F.struct(
                once(first_value(toks, "publisher"), organisation).alias("publisher"),
                once(first_value(toks, "author"), _names).alias("authors"), _people(script).alias("people"), (F.trim(script) == "null").alias("is_null"),
                *[once(v, lambda x: F.when(_truthy(x), F.struct(_scalar(x).alias("v")))).alias(k) for k, v in values.items()],
            )

        return once(tokens(script), of)

    def merged(found: Column) -> Column:
        start = F.struct(F.lit("").alias("authors"), F.lit(False).alias("ended"))

        def follow(s: Column, x: Column) -> Column:
            named = F.coalesce(x["authors"], s["authors"])
            ended = s["ended"] | (x["is_null"] & (named == ""))
            return F.struct(F.when(named == "", x["people"]).otherwise(named).alias("authors"), ended.alias("ended"))

        last = lambda k: F.get(F.reverse(F.filter(F.transform(found, lambda x: x[k]), lambda x: x.isNotNull())), F.lit(0))

        def result(end: Column) -> Column:
            value = {k: F.when(last(k).isNull(), "").otherwise(last(k)["v"]) for k in plain}
            value["publisher"] = F.when(last("publisher").isNull(), "").otherwise(last("publisher")["name"])
            value["authors"] = end["authors"]
            return F.struct(*[F.when(end["ended"], "").otherwise(value[k]).alias(k) for k in FIELDS])

        return once(F.aggregate(found, start, follow), result)

    valid = F.filter(scripts, lambda s: F.coalesce(is_json(s), F.lit(False)))
    blank = F.struct(*[F.lit("").alias(k) for k in FIELDS])
    return F.when(F.size(scripts) > 0, once(F.transform(valid, facts), merged)).otherwise(blank)
