"""robots.txt: rules by RFC 9309, overrides, and whether a bot may fetch a URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import once


def effective(fetched: DataFrame, overrides: DataFrame) -> DataFrame:
    """(origin, text, has_override) from (origin, text) tables; an override counts even if it is empty."""
    f, o = fetched.withColumnRenamed("text", "fetched"), overrides.withColumnRenamed("text", "override")
    joined = f.join(o.withColumn("has_override", F.lit(True)), "origin", "full_outer")
    return joined.select("origin", F.coalesce("override", "fetched", F.lit("")).alias("text"), F.coalesce("has_override", F.lit(False)).alias("has_override"))


def upsert_override(overrides: DataFrame, origin: str, text: str | None) -> DataFrame:
    """Saves an override, or clears it when ``text`` is None."""
    kept = overrides.where(F.col("origin") != origin)
    if text is None:
        return kept
    return kept.unionByName(overrides.sparkSession.createDataFrame([(origin, text)], "origin string, text string"))


def upsert_fetched(fetched: DataFrame, answers: DataFrame) -> DataFrame:
    """(origin, text) after robots.txt was fetched again: answers (origin as typed, ok, text, and NULL in ok where the fetch failed).

    An answer that isn't ok is an empty text; a failed fetch, or an origin that is none, changes nothing.
    """
    new = answers.select(urls.normalised_origin(F.col("origin")).alias("origin"), F.when(F.col("ok"), F.coalesce("text", F.lit(""))).otherwise("").alias("text"), "ok")
    new = new.where("origin is not null and ok is not null").groupBy("origin").agg(F.max("text").alias("text"))
    return fetched.join(new.select("origin"), "origin", "left_anti").unionByName(new)


def _regex(pattern: Column) -> Column:
    """A path pattern with * and a final $ as a regular expression."""
    ends = pattern.endswith("$")
    body = F.when(ends, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    quoted = F.regexp_replace(F.regexp_replace(body, r"([\\^$.|?+()\[\]{}])", r"\\$1"), r"\*+", ".*")
    return F.concat(F.lit("(?s)^"), quoted, F.when(ends, r"\z").otherwise(""))


def rules_for(text: Column, bot: str) -> Column:
    """array<struct<n, allow, regex>> of the rules that a robots.txt has for a bot: of its own groups, else of those for *.

    Groups that name the bot several times are read as one. The text is gone through once, within its row.
    """
    entry = lambda line: once(F.regexp_replace(line, r"#.*$", ""), lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")))
    entries = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), entry), lambda e: e["key"].isin("user-agent", "allow", "disallow"))
    none = F.array().cast("array<struct<allow:boolean,pattern:string>>")
    no = F.lit(False)
    start = F.struct(no.alias("heads"), no.alias("mine"), no.alias("all"), no.alias("named"), none.alias("own"), none.alias("others"))

    def follow(s: Column, e: Column) -> Column:
        agent, is_agent = F.lower(e["value"]), e["key"] == "user-agent"
        rule = F.array(F.struct((e["key"] == "allow").alias("allow"), e["value"].alias("pattern")))
        head = lambda flag, name: F.when(is_agent, (s["heads"] & s[flag]) | (agent == name)).otherwise(s[flag]).alias(flag)
        taken = lambda flag, kept: F.when(~is_agent & s[flag] & (e["value"] != ""), F.concat(s[kept], rule)).otherwise(s[kept]).alias(kept)
        return F.struct(is_agent.alias("heads"), head("mine", bot.lower()), head("all", "*"), (s["named"] | (is_agent & (agent == bot.lower()))).alias("named"), taken("mine", "own"), taken("all", "others"))

    chosen = F.aggregate(entries, start, follow, lambda s: F.when(s["named"], s["own"]).otherwise(s["others"]))
    return F.transform(chosen, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"), _regex(r["pattern"]).alias("regex")))


def rules_by_origin(texts: DataFrame, bot: str) -> DataFrame:
    """(origin, rules) of (origin, text)."""
    return texts.select("origin", rules_for(F.col("text"), bot).alias("rules"))


def allowed(url_table: DataFrame, texts: DataFrame, bot: str, url: str = "url") -> DataFrame:
    """``url_table`` with ``allowed``: the longest fitting pattern of the bot's group (else of *) decides, allow wins ties."""
    return allowed_by(url_table, rules_by_origin(texts, bot), url)


def allowed_by(url_table: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``allowed`` by rules that ``rules_by_origin`` made.

    The rules of an origin travel as one array, so a URL is never multiplied by its rules, and one join is all that is
    shuffled; where an origin is hot, adaptive execution may split its URLs. Rules grow with the origins: they are never broadcast.
    """
    per_origin = rules.select(F.col("origin").alias("__origin"), F.col("rules").alias("__rules")).hint("merge")
    target = urls.after_host(F.col(url))
    fitting = F.filter("__rules", lambda r: F.regexp_like(target, r["regex"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["n"].alias("n"), r["allow"].alias("allow"))))
    joined = url_table.join(per_origin, urls.origin(F.col(url)) == F.col("__origin"), "left")
    return joined.select(*url_table.columns, F.coalesce(best["allow"], F.lit(True)).alias("allowed"))


def listing(fetched: DataFrame, overrides: DataFrame) -> DataFrame:
    """What the manager shows: every origin with its badge, in order."""
    return effective(fetched, overrides).select("origin", F.when(F.col("has_override"), "override").otherwise("fetched").alias("badge"), "text").orderBy("origin")
