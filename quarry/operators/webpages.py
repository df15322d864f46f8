"""Web pages: metadata, and main text without boilerplate by text and link density and by repetition on a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import WEB_SPACE, has_text, trimmed
from quarry.operators.analysis import ENTITIES, LINE_ENDS
from quarry.sources.scratch import stored

#: A block is boilerplate where so much of it and what is beside it are links, or where both are as short as that.
LINKS, SHORT = 0.5, 40
#: Pages of a host that hold a block from which on it is taken for the host's.
REPEATED = 4
ANCHOR = r"(?is)<a\b[^>]*>(.*?)</a\s*>"


def plain(html: Column) -> Column:
    """A piece of HTML without tags, entities resolved, white space collapsed."""
    out = F.regexp_replace(html, r"<[^>]*>", "")
    for entity, character in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(character))
    return trimmed(F.regexp_replace(out, WEB_SPACE, " "))


def attribute(html: Column, tag: str, which: str, wanted: str) -> Column:
    """The attribute ``wanted`` of the first such tag that also has ``which``, in either order; null without one."""
    value = rf'\b{wanted}\s*=\s*["\']([^"\']*)["\']'
    one, two = (F.regexp_extract(html, rf"(?is)<{tag}\b{x}", 1) for x in (rf"(?=[^>]*{which})[^>]*?{value}", rf"[^>]*?{value}"))
    return F.nullif(trimmed(one if which else two), F.lit(""))


def metadata(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, title, language, description, canonical) of each page; what a page does not say is null.

    The host is in lower case, without user, port and a leading "www.".
    """
    h = F.col(html)
    host = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    return pages.select(
        key, F.nullif(host, F.lit("")).alias("host"), F.nullif(plain(F.regexp_extract(h, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)), F.lit("")).alias("title"),
        F.lower(attribute(h, "html", "", "lang")).alias("language"), attribute(h, "meta", r'\bname\s*=\s*["\']description["\']', "content").alias("description"),
        attribute(h, "link", r'\brel\s*=\s*["\']canonical["\']', "href").alias("canonical"),
    )


def blocks(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, place, text, chars, link_chars): pieces between tags that end a line, in order, those with text."""
    body = F.col(html)
    for pattern in (r"(?is)<!--.*?-->", *(rf"(?is)<{tag}\b.*?</{tag}\s*>" for tag in ("script", "style", "head"))):
        body = F.regexp_replace(body, pattern, "")
    hosts = metadata(pages, key, url, html).select(key, "host")
    cut = pages.select(key, F.posexplode(F.split(body, LINE_ENDS)).alias("place", "piece"))
    linked = plain(F.array_join(F.regexp_extract_all("piece", F.lit(ANCHOR), 1), " "))
    own = cut.select(key, "place", plain(F.col("piece")).alias("text"), linked.alias("__links")).where(has_text(F.col("text")))
    sized = own.select(key, "place", "text", F.length("text").alias("chars"), F.length("__links").alias("link_chars"))
    return sized.join(hosts.hint("merge"), key)


def judged(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Adds ``boilerplate`` to blocks: why a block is no main text, null where it is.

    Link share and length are smoothed over the blocks beside, a block counting twice, so that a short
    line between paragraphs stays and one among links goes. A block whose text stands on ``REPEATED``
    or more pages of its host is the host's.
    """
    rows = stored(rows, "page-blocks")
    beside = Window.partitionBy(key).orderBy("place").rowsBetween(-1, 1)
    chars, links = (F.sum(c).over(beside) + F.col(c) for c in ("chars", "link_chars"))
    own = rows.groupBy("host", F.sha2("text", 256).alias("digest"), key).agg(F.lit(1).alias("one"))
    common = own.groupBy("host", "digest").agg(F.count("*").alias("pages")).where(F.col("pages") >= REPEATED).withColumnRenamed("host", "__host")
    smooth = rows.withColumns({"share": links / chars, "around": chars / 4, "digest": F.sha2("text", 256)})
    both = smooth.join(common.hint("merge"), (F.col("host") == F.col("__host")) & (smooth["digest"] == common["digest"]), "left")
    why = F.when(F.col("pages").isNotNull(), "repeated on the host").when(F.col("share") > LINKS, "links").when((F.col("around") < SHORT) & (F.col("chars") < SHORT), "short")
    return both.select(key, "host", "place", "text", "chars", "link_chars", why.alias("boilerplate"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, text, blocks, left_out) of every page: its main blocks a line each. Pages without text have an empty one."""
    found = judged(blocks(pages, key, url, html), key)
    kept = F.col("boilerplate").isNull()
    lines = F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("place", "text")))), lambda x: x["text"])
    one = found.groupBy(key).agg(F.array_join(lines, "\n").alias("text"), F.count_if(kept).alias("blocks"), F.count_if(~kept).alias("left_out"))
    return pages.select(key).join(one.hint("merge"), key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("left_out", F.lit(0)).alias("left_out"))
