"""URL filters with redirect equivalence.

A rule is a host and a path prefix and fits the host and its subdomains; the longest fitting rule decides.  A URL that no
rule fits is blocked if one of its aliases is: URLs joined by redirects or canonical links, found as connected
components.  An explicit allow rule takes precedence over what aliases bring.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.graph import components
from caseloom.session import cut_lineage

LINK = r"(?is)<link\b[^>]*?\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\bcontent\s*=\s*[\"']?[^\"'>;]*;\s*url\s*=\s*[\"']?([^\"'\s>]+)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    """What follows the first ://, empty without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A URL as a node: scheme and host in lower case, no fragment; null without ://."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    scheme = lower_ascii(F.substring_index(bare, "://", 1))
    tail = F.regexp_replace(_rest(bare), r"^[^/?#]*", "")
    return F.when(F.instr(bare, "://") > 0, F.concat(scheme, F.lit("://"), host_of(bare), tail))


def _absolute(target: Column, base: Column) -> Column:
    """A link's target as a whole URL, seen from the page at `base`."""
    target = F.regexp_replace(target, "&amp;", "&")
    scheme = F.substring_index(base, "://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (
        F.when(target == "", None)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path_of(base), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#"), None)
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): the page's URL and the target of its canonical link, and of its refresh redirect."""
    url = F.col(url_col).cast("string")
    links = [F.regexp_extract(F.regexp_extract(F.col(html_col).cast("string"), tag, 0), target, 1) for tag, target in ((LINK, HREF), (REFRESH, TARGET))]
    targets = F.explode(F.array(*[_absolute(link, url) for link in links]))
    edges = pages.where(url.isNotNull() & F.col(html_col).isNotNull()).select(node_of(url).alias("a"), targets.alias("b"))
    return edges.select("a", node_of(F.col("b")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path) of `urls`, distinct, with the longest fitting rule and its verdict; (host, path) without one are left out.

    Each pair meets the rules by equality of a host suffix and a path prefix, for the lengths that rules' paths have.
    """
    sizes = [r[0] for r in rules.select(F.length("path").alias("n")).distinct().orderBy("n").collect()]
    pairs = urls.select("host", "path").distinct()
    if not sizes:
        return pairs.limit(0).select("*", F.lit("").alias("rule"), F.lit("").alias("verdict"))
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    cuts = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sizes])
    keys = pairs.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host"), cuts.alias("cuts"))
    keys = keys.select("host", "path", "rule_host", F.explode(F.array_distinct("cuts")).alias("rule_path")).where("rule_path IS NOT NULL")
    known = rules.groupBy(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("verdict"))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), "verdict")).alias("best")
    return keys.join(known, ["rule_host", "rule_path"]).groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    `rules` has host, path and verdict (allow or block; of two equal rules block counts).  A null URL, or one without
    ://, has an empty host and path, fits no rule, has no alias and is allowed.  Rows that repeat a URL are judged alike;
    null html has no links; other columns are not read.  URLs that only links name are judged too and pass a block on.
    A frequent host is one row per path when it meets the rules, and is joined back by host and path; the component
    search sees distinct edges only.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    linked = components(alias_edges(pages, url_col, html_col))
    linked = cut_lineage(linked.select("node", "root", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")))
    verdicts = cut_lineage(judged(rows.select("host", "path").union(linked.select("host", "path")), rules))
    blocked = linked.join(verdicts.where("verdict = 'block'").select("host", "path"), ["host", "path"]).select("root").distinct()
    inherited = linked.join(blocked, "root").select("node").withColumn("by_alias", F.lit("block"))
    return (
        rows.join(verdicts, ["host", "path"], "left").join(inherited, "node", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("verdict", "by_alias", F.lit("allow")).alias("verdict"))
    )
