"""URL filters: rules by host and path, spread over redirect and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracemill.llm.common import components
from tracemill.session import settle

RULE_SCHEMA = "host string, path string, verdict string"
#: ``canonical`` as any of the tokens of rel, in any case.
CANONICAL = (
    r"""(?is)(?<![\w-])rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))"""
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A url as a node: host, path and query. Scheme and fragment name the same page."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), rest))


def page_links(pages: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between nodes: canonical links and refresh redirects in the html.

    Targets with a scheme stand as they are, ``//host`` and ``/path`` are completed
    from the page's url, others are relative to its folder. Pages without url or html give none.
    """
    tag = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)))
    some = F.lower("html").contains("canonical") | F.lower("html").contains("http-equiv")
    tags = settle(pages.filter(some & F.col("url").isNotNull()).select("url", tag.alias("tag")))
    canonical = F.col("tag").rlike(CANONICAL)
    refresh = F.col("tag").rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b")
    target = F.when(canonical, F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)).when(
        refresh, F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    )
    found = settle(tags.withColumn("t", target).filter(F.coalesce(F.col("t"), F.lit("")) != ""))
    t, url = F.col("t"), F.col("url")
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    whole = (
        F.when(t.contains("://"), t).when(t.startswith("//"), F.concat(F.lit("http:"), t))
        .when(t.startswith("/"), F.concat(F.lit("http://"), host_of(url), t))
        .otherwise(F.concat(F.lit("http://"), host_of(url), F.when(folder == "", F.lit("/")).otherwise(folder), t))
    )
    return found.select(node_of(url).alias("a"), node_of(whole).alias("b"))


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of each ``(host, path)``: adds ``rule`` and ``rule_verdict``.

    A host is looked up by itself and by each of its parent domains, an equality
    join, so long rule lists need no scan per page. Of equally long rules an allow wins.
    """
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(F.split("host", r"\."))),
        lambda i: F.array_join(F.slice(F.split("host", r"\."), i, 10_000), "."),
    )
    asked = places.select("host", "path").distinct().withColumn("up", F.explode(suffixes))
    r = rules.select(F.col("host").alias("up"), F.col("path").alias("rpath"), F.col("verdict").alias("v"))
    hit = asked.join(r, "up").filter(F.col("path").startswith(F.col("rpath")))
    rule = F.concat("up", "rpath")
    best = hit.groupBy("host", "path").agg(
        F.max(F.struct(F.length(rule).alias("n"), (F.col("v") == "allow").alias("yes"), rule.alias("rule"))).alias("m")
    )
    return best.select(
        "host", "path", F.col("m.rule").alias("rule"),
        F.when(F.col("m.yes"), F.lit("allow")).otherwise(F.lit("block")).alias("rule_verdict"),
    )


def filter_urls(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Rows of ``pages`` (page_id, url) with host, path, rule, verdict, component.

    A page's own rule decides first, so an explicit allow always stands. A page
    without a rule is blocked if a redirect or canonical link ties it, over any
    number of steps, to a url that a rule blocks; else it is allowed. ``links``
    ``(a, b)`` are more known redirects between nodes. Null urls and urls without
    ``://`` have empty host and path, belong to no component and are allowed.
    Columns of the result's names in ``pages`` are not read.
    """
    found = page_links(pages)
    if links is not None:
        found = found.unionByName(links.select("a", "b"))
    parts = components(found)
    url = F.col("url")
    judged = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    node_url = F.concat(F.lit("http://"), F.col("node"))
    ends = parts.select("root", host_of(node_url).alias("host"), path_of(node_url).alias("path"))
    # Places are few beside pages and texts aren't needed again.
    best = settle(match_rules(judged.select("host", "path").unionByName(ends.select("host", "path")), rules))
    bad = settle(
        ends.join(best.filter(F.col("rule_verdict") == "block"), ["host", "path"]).select("root").distinct()
    )
    tied = settle(parts.join(bad.withColumn("bad", F.lit(True)), "root", "left"))
    out = judged.join(best, ["host", "path"], "left").join(tied, "node", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("bad"), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("root").alias("component"))
