"""Site-relative line frequency, in DataFrame functions only.

Pages are grouped by host.  A line's ratio is the number of the host's pages
that contain it, divided by the host's pages; lines above ``max_ratio`` are
boilerplate and go.  A line on fewer than ``repeats`` pages of a host does not repeat
and stays (1: the bare ratio, by which a host of three pages loses every line).  With
``count_copies`` off, both must also hold for the host's distinct texts, so copies
of a page do not make its lines boilerplate, and no line goes that would not go
otherwise.

Plan: each page sends its distinct lines as 16-byte digests; they are counted
by (host, line) with a map-side combine, so a line on every page of a hot host
is summed before it meets in one task, and lines that do not repeat leave before
they meet the hosts' totals (sent to every task if they are few, else spread).  A host has at most (lines a page) / max_ratio
boilerplate lines; they are written as one array a host.  If that table is small (its
files are measured) it goes to every task and the texts are not shuffled at all.
Beyond that the pages meet it by a join in which each hot host is dealt to as many
keys as its pages ask for.

Edge cases: a null text stays null and has no lines; an empty text is one empty line;
lines are compared trimmed of blanks at both ends, and empty ones neither count nor
go; a null host is a host of its own; repeated rows are pages of their own; a very long
text is one row, held by one task; other columns pass through unchanged whatever their
names, except n_lines and n_removed, which are replaced; an empty table gives an empty
result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mmspark.llm._spark import Steps, join_spread


def host(url: str = "url") -> Column:
    """The host of a URL, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def visible_lines(html: str = "html") -> Column:
    """The text of a page, a line for each block element."""
    t = F.regexp_replace(F.col(html), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|[\r\n\t]", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:html|head|body|title|nav|ul|ol|li|div|article|section|header|footer|main|aside|h[1-6]|p|br|hr|table|tr|td|th|pre|blockquote)\b[^>]*>", "\n")
    return F.regexp_replace(t, "<[^>]*>", "")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def boilerplate(pages: DataFrame, max_ratio: float = 0.3, repeats: int = 2, count_copies: bool = True, steps: Steps | None = None) -> DataFrame:
    """(site, common): the digests of each site's boilerplate lines, from (site, body); sites without any are left out."""
    steps = steps or Steps(pages.sparkSession)
    digests = F.array_distinct(F.transform(F.filter(F.transform(F.split("body", "\n", -1), _trim), lambda x: x != ""), _digest))
    if count_copies:
        held = pages.select("site", F.explode(digests).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n"))
        held = held.where(F.col("n") >= repeats)
        sites = pages.groupBy("site").agg(F.count("*").alias("pages"))
        often = F.col("n") > max_ratio * F.col("pages")
    else:
        texts = pages.select("site", "body", _digest(F.col("body")).alias("whole"))
        sites = texts.groupBy("site", "whole").agg(F.count("*").alias("n")).groupBy("site").agg(F.sum("n").alias("pages"), F.count("*").alias("texts"))
        held = texts.select("site", "whole", F.explode(digests).alias("line")).groupBy("site", "line", "whole").agg(F.count("*").alias("k"))
        held = held.groupBy("site", "line").agg(F.sum("k").alias("n"), F.count("*").alias("m")).where(F.col("m") >= repeats)
        often = (F.col("n") > max_ratio * F.col("pages")) & (F.col("m") > max_ratio * F.col("texts"))
    sites = steps.keep(sites.withColumn("key", F.xxhash64("site")))
    if steps.small(sites):
        met = held.join(F.broadcast(sites), "site")
    else:  # a hot site has many lines
        met = join_spread(steps.keep(held.withColumn("key", F.xxhash64("site"))), sites, "key", "line", on=["site"])
    return met.where(often).groupBy("site").agg(F.collect_list("line").alias("common"))


def line_dedup(pages: DataFrame, key: Column, text: str = "text", max_ratio: float = 0.3, repeats: int = 2, count_copies: bool = True) -> DataFrame:
    """The input with the column `text` rid of its host's boilerplate lines, and n_lines, n_removed (lines that are not empty)."""
    steps = Steps(pages.sparkSession)
    names = [c for c in pages.columns if c.lower() not in ("n_lines", "n_removed")]
    body = _quoted(text).cast("string")
    # a site's name: not null, so that joins need no null-safe keys
    site = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))
    common = steps.keep(boilerplate(pages.select(site.alias("site"), body.alias("body")), max_ratio, repeats, count_copies, steps))
    rows = pages.select(site.alias("site"), body.alias("body"), F.struct(*map(_quoted, names)).alias("row"))
    if steps.small(common):
        met = rows.join(F.broadcast(common), "site", "left")
    else:
        numbered = rows.withColumn("site_key", F.xxhash64("site"))
        met = join_spread(numbered, common.withColumn("site_key", F.xxhash64("site")), "site_key", "body", "left", ["site"])
    lines = F.split("body", "\n", -1)
    gone = lambda x: F.array_contains("common", _digest(_trim(x))) & (_trim(x) != "")
    full = F.size(F.filter("lines", lambda x: _trim(x) != ""))
    met = met.select("row", "body", "common", lines.alias("lines")).withColumn("kept", F.when(F.col("common").isNotNull(), F.filter("lines", lambda x: ~gone(x))))
    hit = F.col("kept").isNotNull()
    out = [F.when(hit, F.array_join("kept", "\n")).otherwise(F.col("body")).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names]
    n = [F.when(F.col("body").isNull(), 0).otherwise(full).cast("long").alias("n_lines"), F.when(hit, F.size("lines") - F.size("kept")).otherwise(0).cast("long").alias("n_removed")]
    return met.select(*out, *n)
