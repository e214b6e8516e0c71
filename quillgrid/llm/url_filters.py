"""URL rules that also reach redirect and canonical-link aliases.

A rule is a host, with all its subdomains, and the start of a path; the longest
that fits decides. Pages are also tied to the addresses that their canonical
links and refresh redirects name, and to any edges that the caller has, such as
redirects of a crawl log. Connected components of these edges are one resource:
a block of any member reaches the members that no rule fits, unless an explicit
allow of a member takes precedence. A page that a rule fits keeps its verdict.

All steps are built-in expressions, aggregates and joins. Only pages with an edge
go into the component search; the others are one projection.

Defined cases: a null address, or one without ``://``, has empty host and path,
fits no rule and is allowed; a null page text has no links; repeated rows are
judged alike; no rules or no edges are fine; an empty table gives no rows; other
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quillgrid.llm.components import connected_components
from quillgrid.session import broadcast_if_small, materialize

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REL = r"(?:\"(?:[^\"]*\s)?canonical(?:\s[^\"]*)?\"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))"
LINK_TAG = rf"(?i)<link\b[^<>]*\brel\s*=\s*{REL}[^<>]*>"
BASE_TAG = r"(?i)<base\b[^<>]*\bhref\s*=[^<>]*>"
NUMBERED = r"&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"
META_TAG = r"(?i)<meta\b[^<>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b[^<>]*>"
HREF = r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+))"
REFRESH = r"(?i)\burl\s*=\s*['\"]?([^'\"<>\s]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null. ``rules``: (verdict, host + path), a list small enough to write down."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own_host, slash, rest = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def once(value: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of a value that stands in the plan once, however often the step names it: written out, nested steps multiply."""
    return F.get(F.transform(F.array(value), step), F.lit(0))


def resource(url: Column) -> Column:
    """The address without its fragment, scheme and host in lower case: what a server is asked for."""
    def joined(start: Column, rest: Column) -> Column:
        return F.concat(F.translate(start, UPPER, LOWER), F.when(rest.contains("/."), without_dots(rest)).otherwise(rest))

    def divided(bare: Column) -> Column:
        start = F.regexp_extract(bare, r"^([^/?#]*://[^/?#]*)", 1)
        return once(start, lambda start: once(F.substr(bare, F.length(start) + 1), lambda rest: joined(start, rest)))

    return once(F.regexp_replace(url, r"(?s)#.*$", ""), divided)


def without_dots(rest: Column) -> Column:
    """A path, with what follows its ``?``, without ``.`` and ``..`` segments."""
    def plain(path: Column) -> Column:
        ended = F.when(path.rlike(r"/\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path)
        parts = F.aggregate(
            F.split(F.substr(ended, F.lit(2)), "/"), F.array().cast("array<string>"),
            lambda kept, part: F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(part == ".", kept).otherwise(F.concat(kept, F.array(part))),
        )
        return F.concat(F.lit("/"), F.array_join(parts, "/"), F.substr(rest, F.length(path) + 1))

    return once(F.regexp_extract(rest, r"^([^?]*)", 1), plain)


def unescaped(text: Column) -> Column:
    """An attribute's value with ``&amp;`` and numbered characters written out."""
    def char(code: Column) -> Column:
        number = F.when(F.lower(F.substr(code, F.lit(1), F.lit(1))) == "x", F.conv(F.substr(code, F.lit(2)), 16, 10)).otherwise(code).cast("bigint")
        return F.when(number.between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("")

    def plain(text: Column) -> Column:
        chars = F.transform(F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(1)), char)
        numbered = F.array_join(F.zip_with(F.split(text, NUMBERED), chars, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")
        return F.replace(F.when(text.contains("&#"), numbered).otherwise(text), F.lit("&amp;"), F.lit("&"))

    return once(text, plain)


def resolve(target: Column, base: Column) -> Column:
    """A link's target as a full address, from the page's address."""
    def full(target: Column, base: Column, path: Column) -> Column:
        scheme = F.regexp_extract(base, r"^([^/?#]*:)//", 1)
        site = F.regexp_extract(base, r"^([^/?#]*://[^/?#]*)", 1)
        folder = F.when(path.contains("/"), F.regexp_extract(path, r"^(.*/)", 1)).otherwise("/")
        return (
            F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(scheme, target))
            .when(target.startswith("/"), F.concat(site, target))
            .when(target.startswith("?"), F.concat(site, F.when(path == "", "/").otherwise(path), target))
            .when(target.startswith("#"), base)
            .otherwise(F.concat(site, folder, target))
        )

    return once(target, lambda target: once(base, lambda base: once(path_of(base), lambda path: full(target, base, path))))


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's address and each one that its canonical links and refresh redirects name."""
    def first_group(tag: Column) -> Column:
        groups = [F.regexp_extract(tag, HREF, g) for g in (1, 2, 3)]
        return F.coalesce(*(F.when(g != "", g) for g in groups))

    tags = pages.where(F.col(url).contains("://")).select(
        F.col(url).alias("url"),
        F.concat(F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0)), F.regexp_extract_all(html, F.lit(META_TAG), F.lit(0))).alias("tags"),
        F.regexp_extract(html, BASE_TAG, 0).alias("base"),
    ).where(F.size("tags") > 0).select("url", F.explode("tags").alias("tag"), unescaped(F.trim(first_group(F.col("base")))).alias("base"))
    target = F.when(F.lower(F.substring("tag", 1, 5)) == "<link", first_group(F.col("tag"))).otherwise(
        F.regexp_extract("tag", REFRESH, 1)
    )
    named = tags.select("url", "base", unescaped(F.trim(target)).alias("target")).where(F.col("target") != "")
    base = once(F.col("base"), lambda base: F.when(F.coalesce(base, F.lit("")) != "", resolve(base, F.col("url"))).otherwise(F.col("url")))
    return named.select(resource(F.col("url")).alias("a"), resource(resolve(F.col("target"), base)).alias("b"))


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url: str = "url", html: str = "html",
    more_edges: DataFrame | None = None,
) -> DataFrame:
    """id, host, path, rule, verdict and component (the smallest address of the page's class, null if it stands alone)."""
    edges = page_edges(pages, url, html)
    if more_edges is not None:
        edges = edges.union(more_edges.select(resource(F.col("a")), resource(F.col("b"))))
    members = connected_components(edges)
    member_rule = fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    classes = members.withColumn("v", member_rule).groupBy("component").agg(
        F.max(F.coalesce(F.col("v") == BLOCK, F.lit(False))).alias("blocked"),
        F.max(F.coalesce(F.col("v") == ALLOW, F.lit(False))).alias("allowed"),
    )
    spread = materialize(members.join(classes, "component"), "aliases")
    judged = pages.select(
        F.col(id_col), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), resource(F.col(url)).alias("__node")
    ).withColumn("__rule", fitting_rule(F.col("host"), F.col("path"), rules))
    joined = judged.join(broadcast_if_small(spread.withColumnRenamed("node", "__node")), "__node", "left")
    by_class = F.when(F.col("blocked") & ~F.col("allowed"), BLOCK).otherwise(ALLOW)
    return joined.select(
        id_col, "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", by_class).alias("verdict"), "component"
    )
