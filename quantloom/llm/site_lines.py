"""Operator 3: line dedup by site-relative frequency.

For each host, the share of its pages that hold a line; lines whose share exceeds a ratio are boilerplate there and are
dropped from that host's pages. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import stage

#: A line is boilerplate of a host if more than RATIO of the host's pages hold it, and LEAST_PAGES at least: one page alone
#: repeats nothing, though each of its lines has the share 1 on a host of one page.
RATIO, LEAST_PAGES = 0.1, 2
#: Boilerplate lists are broadcast up to so many bytes; beyond, they are joined by host, hot hosts salted.
BROADCAST_BYTES = 16 << 20
#: A host is hot beyond this many pages, and beyond 1/MOST_HOT of all pages; there are at most MOST_HOT such hosts.
HOT_PAGES, MOST_HOT = 50_000, 4096


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without port; '' if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1), F.lit(""))


def html_lines(html: Column) -> Column:
    """Visible lines of a page: scripts, styles and comments go, every tag ends a line, empty lines go."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "\n")
    return text_lines(F.regexp_replace(bare, r"<[^>]*>", "\n"))


def text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> tuple[DataFrame, DataFrame]:
    """((host, lines): the boilerplate of each host that has any; (host, pages)). ``pages`` has host and lines.

    Lines are compared without the spaces around them; empty ones never count. Lines of a page count once. Counts are summed before the shuffle; a host's list has at most (mean distinct lines of
    its pages) / ratio lines, so it is safe to gather.
    """
    total = stage(pages.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    trimmed = F.array_distinct(F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: x != ""))
    seen = pages.select("host", F.explode(trimmed).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    often = seen.where(F.col("n") >= least_pages).join(total, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return stage(often.groupBy("host").agg(F.collect_set("line").alias("common")), "boilerplate"), total


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` (host, lines, any other columns) with n_lines, n_dropped and lines without the boilerplate.

    Null hosts are one host of their own, ''. Pages without lines stay. Ties cannot arise: a share of exactly ``ratio``
    keeps the line. Repeated rows count as pages of their own. An empty table gives no rows.
    """
    pages = pages.withColumn("host", F.coalesce("host", F.lit("")))
    common, total = boilerplate(pages.select("host", "lines"), ratio, least_pages)
    size = common.select(F.sum(F.length("host") + F.aggregate("common", F.lit(0), lambda a, x: a + F.octet_length(x) + 16))).first()[0] or 0
    if size <= broadcast_bytes:
        joined = pages.join(F.broadcast(common), "host", "left")
    else:
        every = total.select(F.sum("pages")).first()[0]
        hot = total.where(F.col("pages") > max(HOT_PAGES, every // MOST_HOT)).select("host", F.ceil(F.col("pages") / HOT_PAGES).cast("int").alias("salts"))
        hot = stage(hot, "hot-hosts")  # MOST_HOT rows at most
        salted = pages.join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod(F.xxhash64("lines"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        copies = common.join(F.broadcast(hot), "host", "left").select("host", "common", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        joined = salted.join(copies, ["host", "salt"], "left").drop("salt")
    kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains("common", F.trim(x)), F.lit(False)))
    return joined.withColumn("kept", kept).select(
        *[c for c in pages.columns if c != "lines"],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.col("kept").alias("lines"),
    )


def dedup_html(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO) -> DataFrame:
    """page_id, host, n_lines, n_dropped, kept_text for web pages: one row for each row of ``df``.

    Null and unreadable URLs are one host, ''; null and empty pages have no lines. Null and repeated ids are rows like any
    other, long pages are taken whole, and other columns are not read. An empty table gives no rows.
    """
    pages = df.select(df[id_col].cast("long").alias("page_id"), host_of(df[url_col]).alias("host"), html_lines(df[html_col]).alias("lines"))
    return drop_boilerplate(pages, ratio).select("page_id", "host", "n_lines", "n_dropped", F.array_join("lines", "\n").alias("kept_text"))


def dedup_texts(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """``df`` with boilerplate lines taken out of ``text_col``, each source being a site; other texts stay as they are."""
    pages = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[host_col].alias("host"), F.split(F.coalesce(df[text_col], F.lit("")), "\n").alias("lines"))
    done = drop_boilerplate(pages, ratio)
    text = F.when(F.col("n_dropped") > 0, F.array_join("lines", "\n")).otherwise(F.col("row")[text_col])
    return done.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])


SQL = rf"""
WITH pages_lines AS (
  SELECT page_id, coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1), '') AS host,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(html, ''),
           '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), chr(10)),
           lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
total AS (SELECT host, count(*) AS pages FROM pages_lines GROUP BY host),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM pages_lines) GROUP BY host, line),
common AS (SELECT host, list(line) AS common FROM seen JOIN total USING (host)
           WHERE n >= {LEAST_PAGES} AND n > CAST({RATIO} AS DOUBLE) * pages GROUP BY host),
kept AS (SELECT page_id, p.host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(common, x), false)) AS kept
         FROM pages_lines p LEFT JOIN common c ON p.host = c.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(kept, chr(10)), '') AS kept_text
FROM kept
"""
