"""URL functions: classification, video ids, extraction from markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hosts whose pages are videos.
VIDEO_HOSTS = ["youtube.com", "youtu.be", "vimeo.com", "dailymotion.com"]
#: Links, bare URLs, what may trail them, and headings.
_MARKDOWN = r"\[([^\]]+)\]\((https?://[^\s)]+)\)"
_BARE = r"https?://[^\s)\]>,\"']+"
_TAIL = r"[.,;:!?)]+$"
HEADING = r"^(#{1,6})\s+(.+)$"


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def _is_video(name: Column) -> Column:
    return F.coalesce(name.isin(*VIDEO_HOSTS) | name.endswith("youtube.com"), F.lit(False))


def resource_type(url: Column) -> Column:
    """F17."""
    return F.when(_is_video(host(url)), "video").otherwise("article")


def provider(url: Column) -> Column:
    """a video host without its first .com and .be, else the host; unknown for what is no URL."""
    name = host(url)
    short = F.regexp_replace(F.regexp_replace(name, r"^(.*?)\.com", "$1"), r"^(.*?)\.be", "$1")
    return F.coalesce(F.when(_is_video(name), short).otherwise(name), F.lit("unknown"))


def youtube_id(url: Column) -> Column:
    """from v=, /shorts/ or youtu.be/, in this order; else null."""
    take = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    return F.coalesce(take(r"[?&]v=([a-zA-Z0-9_-]+)"), take(r"/shorts/([a-zA-Z0-9_-]+)"), take(r"youtu\.be/([a-zA-Z0-9_-]+)"))


def is_short(url: Column) -> Column:
    """F19."""
    return url.contains("/shorts/")


def extract_urls(lines: DataFrame, keys: list[str], fallback: Column) -> DataFrame:
    """(keys, url, title, ord) of lines (keys, line_no, line): first of each URL, titled by its link text or nearest heading.

    In a line, markdown links come before bare URLs; trailing punctuation is no part of a URL.
    """
    heading = F.trim(F.replace(F.regexp_extract("line", HEADING, 2), F.lit("**"), F.lit("")))
    within = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    titled = lines.withColumn("section", F.coalesce(F.last(F.when(F.col("line").rlike(HEADING), heading), ignorenulls=True).over(within), fallback))
    links = F.transform(
        F.regexp_extract_all("line", F.lit(_MARKDOWN), F.lit(0)),
        lambda m: F.struct(F.regexp_replace(F.regexp_extract(m, _MARKDOWN, 2), _TAIL, "").alias("url"), F.trim(F.regexp_extract(m, _MARKDOWN, 1)).alias("title")),
    )
    bare = F.transform(F.regexp_extract_all("line", F.lit(_BARE), F.lit(0)), lambda m: F.struct(F.regexp_replace(m, _TAIL, "").alias("url"), F.lit(None).cast("string").alias("title")))
    found = titled.select(*keys, "line_no", "section", F.posexplode(F.concat(links, bare)).alias("at", "hit"))
    first = F.row_number().over(Window.partitionBy(*keys, "url").orderBy("line_no", "at"))
    rows = found.select(*keys, "line_no", "at", F.col("hit.url").alias("url"), F.coalesce("hit.title", "section").alias("title"))
    return rows.withColumn("n", first).where("n = 1").select(*keys, "url", "title", (F.col("line_no") * 100_000 + F.col("at")).cast("bigint").alias("ord"))
