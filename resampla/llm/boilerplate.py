"""Site-relative line deduplication, in DataFrame functions only.

Pages are grouped by host.  A line that more than ``ratio`` of the host's pages hold (and at least
``min_pages`` of them: by default it only has to repeat, or a host of a single page would lose all) is boilerplate there and is dropped from each of them; the same line stays on
other hosts.  Lines are compared after trimming spaces; blank lines are not kept.

Counting explodes one hash per page and distinct line, which is summed before the shuffle, so
neither a host nor a line with a third of all rows gathers in a task.  A host has at most
(mean distinct lines of its pages) / ``ratio`` boilerplate lines, so its list has a bound of its own;
all hosts' lists are broadcast only while they count ``broadcast_rows`` at most, else joined by host.

Null texts count as pages without lines and give an empty text; a null host is a host of its own;
repeated rows count as pages each; other columns, also ones named like inner ones, are kept as they
are, but one named ``_lines`` is replaced.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resampla.llm.common import materialize

# Tags whose ends part lines.
BLOCKS = "p|div|br|hr|li|ul|ol|table|tr|td|th|h1|h2|h3|h4|h5|h6|title|head|body|html|header|footer|nav|article|section|aside|main|form|pre|blockquote|option|select"
# What is left open hides the rest; a tag ends before another begins: so every pattern takes time in proportion to the text.
HIDDEN = r"(?is)<script.*?(</script>|\z)|<style.*?(</style>|\z)|<!--.*?(-->|\z)"
BREAK = rf"(?i)</?({BLOCKS})(\s[^<>]*)?/?>"
TAG = r"<[^<>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and comments removed, block tags as line ends, other tags gone."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BREAK, "\n"), TAG, "")


def line_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def boilerplate_lines(pages: DataFrame, host: Column, text: Column, ratio: float, min_pages: int) -> DataFrame:
    """(_host, _drop): for each host with boilerplate, the hashes of its boilerplate lines."""
    marks = F.array_distinct(F.transform(line_list(text), lambda x: F.xxhash64(x)))
    # every page adds one mark of null, so that one pass counts both pages and lines
    rows = pages.select(host.alias("_host"), F.explode(F.concat(F.array(F.lit(None).cast("long")), marks)).alias("_mark"))
    counts = rows.groupBy("_host", "_mark").agg(F.count("*").alias("_n"))
    counts = materialize(counts.where(F.col("_mark").isNull() | (F.col("_n") >= min_pages)), "lines")
    total = counts.where("_mark is null").select(F.col("_host").alias("_site"), F.col("_n").alias("_total"))
    common = counts.where("_mark is not null").join(total, F.col("_host").eqNullSafe(F.col("_site")))
    return common.where(F.col("_n") > F.lit(ratio) * F.col("_total")).groupBy("_host").agg(F.collect_list("_mark").alias("_drop"))


def drop_boilerplate(pages: DataFrame, host: Column, text: Column, out_col: str = "text", ratio: float = 0.1, min_pages: int = 2, broadcast_rows: int = 100_000) -> DataFrame:
    """``pages`` with ``out_col`` set to the text without boilerplate lines, and struct ``_lines`` (n_lines, n_dropped)."""
    drops = materialize(boilerplate_lines(pages, host, text, ratio, min_pages), "boilerplate")
    held = drops.agg(F.sum(F.size("_drop"))).first()[0] or 0
    names = pages.columns
    work = pages.select(F.struct(*[pages[f"`{c}`"] for c in names]).alias("_row"), host.alias("_of"), text.alias("_text")) if names else pages
    joined = work.join(F.broadcast(drops) if held <= broadcast_rows else drops, F.col("_of").eqNullSafe(F.col("_host")), "left")
    lines = joined.select("_row", line_list(F.col("_text")).alias("_all"), F.coalesce("_drop", F.array().cast("array<bigint>")).alias("_drop"))
    kept = F.when(F.size("_drop") == 0, F.col("_all")).otherwise(F.filter("_all", lambda x: ~F.array_contains(F.col("_drop"), F.xxhash64(x))))
    done = lines.select("_row", "_all", kept.alias("_kept"))
    counts = F.struct(F.size("_all").cast("long").alias("n_lines"), (F.size("_all") - F.size("_kept")).cast("long").alias("n_dropped"))
    cleaned = F.array_join("_kept", "\n")
    columns = [(cleaned if c == out_col else F.col(f"_row.`{c}`")).alias(c) for c in names if c != "_lines"]
    return done.select(*columns, *([] if out_col in names else [cleaned.alias(out_col)]), counts.alias("_lines"))
