"""Follow directives of links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: The directives, in no order of preference; the first in the text counts.
DIRECTIVES = ("nofollow", "ugc", "sponsored")


def first_directive(text: Column, separators: str) -> Column:
    """The first directive in a list of tokens; NULL if it has none."""
    return F.get(F.filter(F.split(F.lower(text), separators), lambda t: t.isin(*DIRECTIVES)), F.lit(0))


def of_page(meta_robots: Column, header: Column) -> Column:
    """Struct of follow and directive_source of links without a directive of their own: meta robots, then the header."""
    page, sent = first_directive(meta_robots, r"[\s,]+"), first_directive(header, r"[\s,]+")
    source = F.when(page.isNotNull(), "meta").when(sent.isNotNull(), "header").otherwise("")
    return F.struct(F.coalesce(page, sent, F.lit("follow")).alias("follow"), source.alias("directive_source"))


def resolved(rel: Column, page: Column) -> Column:
    """Struct of follow and directive_source: the anchor's rel, then what ``of_page`` says."""
    own = lambda d: F.when(d.isNotNull(), F.struct(d.alias("follow"), F.lit("anchor").alias("directive_source"))).otherwise(page)
    return once(first_directive(rel, r"\s+"), own)
