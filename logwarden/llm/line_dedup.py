"""Line dedup by site-relative frequency.

For each host, the number of its pages that contain a line is divided by the number
of its pages; lines above ``max_ratio`` that are on at least ``min_pages`` pages are
boilerplate and are dropped from all pages of that host. The same line on another
host is judged there. Blank lines are neither counted nor dropped. With
``count_copies=False`` equal pages of a host count as one page, so that a text with
many copies does not become boilerplate as a whole.

Lines are counted by a 64-bit hash, once for each page, and summed on the map side.
A host has at most (lines of a mean page) / max_ratio boilerplate lines, so its
list is short however many pages it has. The lists are broadcast if they are
counted to be below ``BROADCAST_LINES`` hashes in all; beyond that, pages and lists
are joined by host, and Spark splits the partitions of a host that is too large.

Null texts stay null; a page that loses all lines keeps an empty text. Null hosts
are one host. Repeated rows are pages of their own. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.session import stored

MAX_RATIO = 0.1
MIN_PAGES = 5
BROADCAST_LINES = 1_000_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(
    pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, count_copies: bool = True
) -> DataFrame:
    """_host, _lines: the hashes of each host's boilerplate lines; of columns _host and _text."""
    own = F.array_distinct(F.filter(_lines(F.col("_text")), lambda x: F.trim(x) != ""))
    hashed = F.array_distinct(F.transform(own, lambda x: F.xxhash64(x)))
    if not count_copies:
        lines = pages.select("_host", F.md5("_text").alias("_page"), hashed.alias("_own"))
        pages, hashed = lines.dropDuplicates(["_host", "_page"]), F.col("_own")
    counts = (
        pages.select("_host", F.explode(hashed).alias("line"))
        .groupBy("_host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    )
    totals = pages.groupBy("_host").agg(F.count("*").alias("pages"))
    return (
        counts.join(totals, "_host").where(F.col("n") > F.col("pages") * max_ratio)
        .groupBy("_host").agg(F.collect_list("line").alias("_lines"))
    )


def drop_boilerplate(
    pages: DataFrame, host: Column, text_col: str = "text",
    max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, count_copies: bool = True,
) -> DataFrame:
    """``pages`` with the kept lines as text, and ``n_lines`` and ``n_dropped`` (blank lines aside)."""
    kept = [c for c in pages.columns if c not in (text_col, "n_lines", "n_dropped")]
    rows = pages.select(
        F.struct("*").alias("_doc"), F.coalesce(host, F.lit("")).alias("_host"), F.col(text_col).alias("_text")
    )
    lists = stored(boilerplate(rows.select("_host", "_text"), max_ratio, min_pages, count_copies), "boilerplate")
    size = lists.agg(F.sum(F.size("_lines"))).first()[0] or 0  # one number
    joined = rows.join(F.broadcast(lists) if size <= BROADCAST_LINES else lists, "_host", "left")
    full = lambda a: F.size(F.filter(a, lambda x: F.trim(x) != "")).cast("long")
    left = F.when(F.col("_lines").isNull(), F.col("_all")).otherwise(
        F.filter("_all", lambda x: (F.trim(x) == "") | ~F.array_contains("_lines", F.xxhash64(x)))
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return (
        joined.withColumn("_all", _lines(F.col("_text")))
        .withColumn("_left", left)
        .select(
            *(F.col("_doc")[c].alias(c) for c in kept),
            F.array_join("_left", "\n").alias(text_col),
            zero(full("_all")).alias("n_lines"),
            zero(full("_all") - full("_left")).alias("n_dropped"),
        )
    )


# What ends a line in HTML, what is no text, and the common entities.
NO_TEXT = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
BLOCK = (
    r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|section|article|aside|main|nav|header"
    r"|footer|form|blockquote|pre|title|body|head|html)\b[^>]*>"
)
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"),
)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def html_lines(html: Column) -> Column:
    """The text of a page, a line for each block, without blank lines."""
    text = F.regexp_replace(html, r"[\r\n]+", " ")
    text = F.regexp_replace(text, NO_TEXT, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), "<[^>]*>", "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.array_join(F.filter(F.transform(_lines(text), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def _sql() -> str:
    text = "regexp_replace(html, '[\\r\\n]+', ' ', 'g')"
    for pattern, by in ((NO_TEXT, "chr(10)"), (BLOCK, "chr(10)"), ("<[^>]*>", "''")):
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    for name, char in ENTITIES:
        text = "replace({}, '{}', '{}')".format(text, name, char.replace("'", "''"))
    return f"""
    with h as (select row_number() over () i, page_id, coalesce(lower(regexp_extract(url, '{HOST}', 1)), '') host,
      list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x != '') lines from pages),
    l as (select i, page_id, host, lines, unnest(range(len(lines))) k, unnest(lines) line from h),
    c as (select host, line from l join (select host, count(*) pages from h group by host) using (host)
      group by host, line, pages having count(distinct i) >= {MIN_PAGES} and count(distinct i) > pages * {MAX_RATIO}),
    k as (select i, string_agg(line, chr(10) order by k) as text, count(*) n from l anti join c using (host, line) group by i)
    select page_id, host, coalesce(text, case when lines is not null then '' end) as text,
      coalesce(len(lines), 0)::bigint n_lines, coalesce(len(lines), 0)::bigint - coalesce(n, 0) n_dropped
    from h left join k using (i)"""


ORACLE_SQL = _sql()


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The pages' text lines without the boilerplate of their hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    lines = stored(pages.select("page_id", url_host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text")), "page-lines")
    return drop_boilerplate(lines, F.col("host")).withColumn("host", F.coalesce("host", F.lit("")))
