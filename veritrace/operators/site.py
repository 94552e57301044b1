"""Layer D: robots rules, sitemaps, crawl order and coverage, page audits and assets, over fetched bodies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.expr import strip
from ..functions.shipping import ship
from . import markup, text

AGENT = "veritrace"
MAX_PAGES, MAX_ASSETS, MAX_DEPTH = 200, 100, 3
FALLBACKS = ("sitemap_index.xml", "sitemap-index.xml")


def require_authorization(authorized: bool) -> None:
    """Sites are audited only by those who say that they may."""
    if not authorized:
        raise PermissionError("auditing a site needs authorized=True")


def normalize_base(url: Column) -> Column:
    """Scheme and host of a site's address; https if it has none, null if it is not http(s)."""
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    scheme = F.lower(F.try_parse_url(full, F.lit("PROTOCOL")))
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), F.try_parse_url(full, F.lit("AUTHORITY"))))


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def robots_rules(robots: DataFrame, site: str = "site", body: str = "body", agent: str = AGENT) -> DataFrame:
    """(site, ord, rule): non-empty Disallow paths of the groups for * or an agent that names ours.

    Each file is read within its row: a group is a run of agents, closed by its first Disallow.
    """
    lines = F.transform(F.split(F.coalesce(F.col(body), F.lit("")), markup.LINE_ENDS), lambda x: strip(F.regexp_replace(x, "#.*$", "")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(strip(F.substring_index(x, ":", 1))).alias("k"), F.when(F.contains(x, F.lit(":")), strip(F.regexp_replace(x, r"^[^:]*:", ""))).otherwise("").alias("v")))
    known = F.filter(pairs, lambda p: p["k"].isin("user-agent", "disallow"))
    rows = robots.select(F.col(site).alias("site"), F.posexplode(known).alias("ord", "p")).select("site", "ord", "p.k", "p.v")
    by_site = Window.partitionBy("site").orderBy("ord")
    opens = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(by_site), F.lit("disallow")) == "disallow")
    rows = rows.withColumn("grp", F.sum(opens.cast("int")).over(by_site))
    applies = F.max((F.col("k") == "user-agent") & ((F.col("v") == "*") | F.contains(F.lower("v"), F.lit(agent)))).over(Window.partitionBy("site", "grp"))
    return rows.withColumn("applies", applies & (F.col("grp") > 0)).filter((F.col("k") == "disallow") & F.col("applies") & (F.col("v") != "")).select("site", F.col("ord").cast("long").alias("ord"), F.col("v").alias("rule"))


def robots_sitemaps(robots: DataFrame, site: str = "site", body: str = "body") -> DataFrame:
    lines = F.split(F.coalesce(F.col(body), F.lit("")), markup.LINE_ENDS)
    own = F.filter(F.transform(lines, lambda x: F.struct(F.lower(strip(F.substring_index(x, ":", 1))).alias("k"), strip(F.regexp_replace(x, r"^[^:]*:?", "")).alias("v"))), lambda p: (p["k"] == "sitemap") & (p["v"] != ""))
    return robots.select(F.col(site).alias("site"), F.posexplode(own).alias("ord", "p")).select("site", F.col("ord").cast("long").alias("ord"), F.col("p.v").alias("url"))


def sitemap_entries(maps: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """(url, kind, ord, loc): kind 'page' for a urlset's locations, 'map' for an index's.

    Namespaces do not matter; a body that is not well-formed XML has no entries.
    """
    @F.pandas_udf("array<struct<kind:string,loc:string>>")
    def parsed(bodies: pd.Series) -> pd.Series:
        from xml.etree import ElementTree

        def name(tag) -> str:
            return str(tag).rpartition("}")[2].lower()

        def entries(body):
            try:
                root = ElementTree.fromstring(body)
            except (ElementTree.ParseError, TypeError, ValueError):
                return []
            item, kind = {"urlset": ("url", "page"), "sitemapindex": ("sitemap", "map")}.get(name(root.tag), (None, None))
            return [{"kind": kind, "loc": loc.text.strip()} for entry in root if name(entry.tag) == item for loc in entry if name(loc.tag) == "loc" and loc.text]

        return bodies.map(entries)

    found = maps.select(F.col(url).alias("url"), F.posexplode(parsed(F.col(body))).alias("ord", "e"))
    return found.select("url", F.col("e.kind").alias("kind"), F.col("ord").cast("long").alias("ord"), F.col("e.loc").alias("loc"))


def expand_sitemaps(entries: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(site, url, ord, cross_host): pages that a site's sitemap names, depth first, each where it stood first.

    entries: sitemap_entries(); roots: (site, url). Child maps and pages of another host are dropped
    and counted in cross_host (rows with a null url). Each level is one join, at most max_depth of them.
    """
    edges = entries.select(F.col("url").alias("parent"), "kind", "ord", "loc")
    level = roots.select("site", host_of(F.col("url")).alias("host"), F.col("url").alias("map"), F.array().cast("array<bigint>").alias("at"), F.array("url").alias("seen"))
    pages = None
    for depth in range(max_depth + 1):
        own = level.join(edges, level["map"] == edges["parent"]).select("site", "host", "kind", "loc", F.concat("at", F.array("ord")).alias("at"), "seen")
        found = own.filter(F.col("kind") == "page").filter(F.lower(F.try_parse_url("loc", F.lit("PROTOCOL"))).isin("http", "https")).select("site", "loc", "at", (host_of(F.col("loc")) != F.col("host")).alias("cross"))
        maps = own.filter(F.col("kind") == "map").withColumn("cross", F.coalesce(host_of(F.col("loc")) != F.col("host"), F.lit(True)))
        found = found.unionByName(maps.filter("cross").select("site", "loc", "at", "cross"))
        pages = found if pages is None else pages.unionByName(found)
        level = maps.filter(~F.col("cross") & ~F.array_contains("seen", F.col("loc"))).select("site", "host", F.col("loc").alias("map"), "at", F.concat("seen", F.array("loc")).alias("seen"))
    first = pages.filter(~F.col("cross")).groupBy("site", F.col("loc").alias("url")).agg(F.min("at").alias("at"))
    dropped = pages.filter("cross").groupBy("site").agg(F.count("*").alias("cross_host"))
    order = Window.partitionBy("site").orderBy("at", "url")
    return first.select("site", "url", F.row_number().over(order).cast("long").alias("ord")).join(dropped, "site", "left").select("site", "url", "ord", F.coalesce("cross_host", F.lit(0)).cast("long").alias("cross_host"))


def first_candidates(candidates: DataFrame) -> DataFrame:
    """Of (site, rank, url, ord) the rows of each site's least rank: the first sitemap that yields any page."""
    least = candidates.groupBy("site").agg(F.min("rank").alias("rank"))
    return candidates.join(least, ["site", "rank"])


def crawl(urls: DataFrame, rules_: DataFrame, fetched: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """(site, url, ord, status): audited, capped, timeout or skipped, in the order of discovery.

    urls: (site, url, ord); rules_: robots_rules(); fetched: (url, outcome), outcome 'ok', 'timeout' or
    'error', and ord if a URL that was discovered twice was fetched twice; else a URL has one outcome, its
    best. Each row of urls has one status. Robots rules come first; only pages that were audited use up the cap.
    """
    key = ["url", "ord"] if "ord" in fetched.columns else ["url"]
    best = F.max(F.struct((F.col("outcome") == "ok").alias("ok"), "outcome"))["outcome"]
    fetched = fetched.groupBy(*key).agg(best.alias("outcome"))
    barred = urls.join(rules_.select("site", "rule"), (urls["site"] == rules_["site"]) & F.startswith(path_of(urls["url"]), F.col("rule")), "left_semi").select("site", "url").distinct().withColumn("barred", F.lit(True))
    rows = urls.join(barred, ["site", "url"], "left").join(fetched, key, "left")
    rows = rows.withColumn("barred", F.coalesce("barred", F.lit(False)))
    before = Window.partitionBy("site").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    ok = F.when(~F.col("barred") & (F.col("outcome") == "ok"), 1).otherwise(0)
    rows = rows.withColumn("done", F.coalesce(F.sum(ok).over(before), F.lit(0)))
    status = F.when(F.col("barred"), "skipped").when(F.col("done") >= max_pages, "capped").when(F.col("outcome") == "ok", "audited").when(F.col("outcome") == "timeout", "timeout").otherwise("skipped")
    return rows.select("site", "url", "ord", status.alias("status"))


def coverage(crawled: DataFrame) -> DataFrame:
    """(site, discovered, audited, capped, timeouts, skipped)"""
    n = {"audited": "audited", "capped": "capped", "timeouts": "timeout", "skipped": "skipped"}
    return crawled.groupBy("site").agg(F.count("*").alias("discovered"), *(F.count_if(F.col("status") == s).alias(c) for c, s in n.items()))


def coverage_sentence(c: DataFrame) -> DataFrame:
    return c.withColumn("sentence", F.format_string("%d URLs discovered: %d audited, %d over the cap, %d timed out, %d skipped", *(F.col(x) for x in ("discovered", "audited", "capped", "timeouts", "skipped"))))


def page_findings(pages: DataFrame, target: str = "target", html: str = "html") -> DataFrame:
    """All findings of pages: markup, text of the source, visible text; layer tells which. A character may show in both."""
    source = text.scan_text(pages, target, html).withColumn("location", F.concat(F.lit("source: "), F.col("location")))
    # Stripping a page cannot bring signals about but by an entity: only such pages are stripped.
    shown = pages.filter(F.col(html).rlike(rules.SIGNALS) | F.col(html).rlike(f"&|{rules.char_class(rules.GREEK, rules.CYRILLIC)}")).withColumn("__seen", markup.visible_text(F.col(html)))
    visible = text.scan_text(shown, target, "__seen").withColumn("location", F.concat(F.lit("visible text: "), F.col("location")))
    parts = (("markup", markup.parse_html(pages, target, html)), ("source", source), ("visible", visible))
    out = None
    for layer, part in parts:
        part = part.withColumn("layer", F.lit(layer))
        out = part if out is None else out.unionByName(part)
    return out


# Links of a page.
LINK = r"""(?i)(?:src|href)\s*=\s*["']([^"']+)["']"""


#: Links that need all of RFC 3986: dot segments, queries or fragments alone, other schemes, white space.
_HARD = r"(^|/)\.{1,2}(/|$|[?#])|^[?#;]|^(?!(?i:https?:))[A-Za-z][A-Za-z0-9+.-]*:|^(?i:https?:)(?!//)|\s"


def joined(page: Column, link: Column) -> Column:
    """A link as its page means it; null if that is malformed."""
    @F.pandas_udf("string")
    def resolved(pages: pd.Series, links: pd.Series) -> pd.Series:
        from urllib.parse import urljoin

        def one(base, url):
            try:
                return None if url is None else urljoin(base, url)
            except ValueError:
                return None

        return pd.Series([one(b, u) for b, u in zip(pages, links, strict=True)], dtype=object)

    hard = link.rlike(_HARD)
    scheme, base = F.try_parse_url(page, F.lit("PROTOCOL")), F.concat(F.try_parse_url(page, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(page, F.lit("AUTHORITY")))
    folder = F.regexp_replace(F.concat(base, F.coalesce(F.nullif(path_of(page), F.lit("")), F.lit("/"))), "[^/]*$", "")
    plain = F.when(link.rlike("(?i)^https?://"), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link)).when(F.startswith(link, F.lit("/")), F.concat(base, link)).otherwise(F.concat(folder, link))
    # Python sees the few links that need it, and nulls.
    return F.coalesce(resolved(page, F.when(hard, link)), F.when(~hard, plain))


def asset_urls(pages: DataFrame, target: str = "target", url: str = "url", html: str = "html") -> DataFrame:
    """(target, ord, asset): same-host links of pages to files of a known extension, resolved against their page."""
    ship(pages.sparkSession)
    links = pages.select(F.col(target).alias("target"), F.col(url).alias("page"), F.posexplode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("ord", "link"))
    known = F.lower(path_of(F.col("asset"))).rlike(r"\.(" + "|".join(rules.ASSET_EXTENSIONS) + ")$")
    # Links that cannot end in a known extension are let go before Python sees any.
    links = links.filter(F.lower("link").rlike(r"\.(" + "|".join(rules.ASSET_EXTENSIONS) + ")|^[?#;]"))
    full = links.select("target", "page", F.col("ord").cast("long").alias("ord"), joined(F.col("page"), F.col("link")).alias("asset"))
    return full.filter((host_of(F.col("asset")) == host_of(F.col("page"))) & known).select("target", "ord", "asset")


def first_assets(assets: DataFrame, max_assets: int = MAX_ASSETS) -> DataFrame:
    """(site, asset, nth, fetched): each asset once, by first sight (column seen); the first max_assets are fetched."""
    first = assets.groupBy("site", "asset").agg(F.min("seen").alias("seen"))
    nth = F.row_number().over(Window.partitionBy("site").orderBy("seen", "asset"))
    return first.withColumn("nth", nth).select("site", "asset", "nth", (F.col("nth") <= max_assets).alias("fetched"))
