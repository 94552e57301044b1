"""Whole audits in one call: texts, files, folders and sites, from what is read to findings, notes and reports."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.expr import FINDING
from ..functions.staging import staged
from . import c2pa, containers, report, routing, site, text


class Audit(NamedTuple):
    """targets (target), findings (target, ord, layer, ...) and notes (target, ord, note)."""

    targets: DataFrame
    findings: DataFrame
    notes: DataFrame

    def reports(self, verdicts: DataFrame | None = None) -> DataFrame:
        """(target, report): a nested report for every target."""
        return report.reports(self.targets, self.findings, self.notes, verdicts)


def audit_texts(texts: DataFrame) -> Audit:
    """Audits texts (target, text, and if at hand truncated and kind) as sources.files.read_texts gives them.

    Binary-looking inputs are scanned too, under a note.
    """
    said = [F.when(F.col("truncated"), F.lit("Only the beginning of the input was read."))] if "truncated" in texts.columns else []
    said += [F.when(F.col("kind") == "binary", F.lit(rules.NOTES["binary"]))] if "kind" in texts.columns else []
    notes = texts.select("target", F.posexplode(F.array_compact(F.array(*said, F.lit(rules.NOTES["statistical"])))).alias("ord", "note"))
    found = text.scan_text(texts).withColumn("layer", F.lit("text"))
    return Audit(texts.select("target").distinct(), found, notes.select("target", F.col("ord").cast("long").alias("ord"), "note"))


def audit_files(assets: DataFrame, most: int = rules.MAX_BYTES, c2pa_run: Callable[[bytes], tuple[int, str, str]] | None = None) -> Audit:
    """Audits assets (target, content) by what they hold, whatever their names.

    c2pa_run runs a content-credential tool on a file's bytes and gives (exit code, stdout, stderr);
    it sees only files with manifest findings. Without one, such files get a note that says so.
    """
    findings, notes = containers.audit_assets(assets, most)
    findings = staged(findings, "findings")  # read by each of what follows, and the tool's files are few
    flagged = findings.filter("category = 'c2pa-manifest'").select("target").distinct()
    probes = c2pa.probe(assets.join(flagged, "target", "left_semi"), c2pa_run) if c2pa_run else assets.sparkSession.createDataFrame([], f"target {assets.schema['target'].dataType.simpleString()}, {c2pa.PROBE}")
    findings, more = c2pa.enrich(findings, probes)
    notes = notes.unionByName(more.select("target", F.lit(1 << 32).cast("long").alias("ord"), "note"))
    return Audit(assets.select("target").distinct(), findings, notes)


def audit_file(spark: SparkSession, path: str, most: int = rules.MAX_BYTES, **options) -> Audit:
    """Audits one file, or the files of a glob; what lies beyond most bytes is not read, under a note."""
    from ..sources import files

    return audit_files(files.read_files(spark, path, most + 1), most, **options)


class DirectoryAudit(NamedTuple):
    """A folder's audit: its files' own (names as targets), the skipped files (target, length), and the roll-up under the folder's name."""

    files: Audit
    skipped: DataFrame
    whole: Audit

    def ranking(self) -> DataFrame:
        """(target, findings, has_high) of all files, the worst first; skipped ones count as zero."""
        every = self.files.targets.unionByName(self.skipped.select("target"))
        return report.ranked(every, self.files.findings)

    def reports(self) -> DataFrame:
        """(target, report, by_confidence, files, skipped): files holds a report for each file, null for skipped ones."""
        of = self.whole.targets.select("target")
        own = self.files.reports().select("target", "report").unionByName(self.skipped.select("target", F.lit(None).cast(self.files.reports().schema["report"].dataType).alias("report")))
        gathered = own.agg(F.sort_array(F.collect_list(F.struct("target", "report"))).alias("files"))
        left_out = self.skipped.agg(F.sort_array(F.collect_list("target")).alias("skipped"))
        counts = report.confidence_counts(self.whole.findings)
        counts = counts.select(F.struct(*rules.CONFIDENCES).alias("by_confidence"))
        one = self.whole.reports().withColumn("one", F.lit(1))
        for part in (counts, gathered, left_out):  # one row each
            one = one.join(part.withColumn("one", F.lit(1)), "one")
        return one.join(of, "target", "left_semi").drop("one")


def audit_directory(spark: SparkSession, path: str, most: int = rules.MAX_BYTES, include_hidden: bool = False, **options) -> DirectoryAudit:
    """Audits all files below a folder; files over the cap are skipped and listed as such."""
    from ..sources import files

    assets, skipped = files.read_directory(spark, path, most, include_hidden)
    own = audit_files(assets, most, **options)
    name = F.lit(path)
    rolled = report.relocated(own.findings.withColumn("target", F.col("target").cast("string")), name)
    notes = skipped.select(name.alias("target"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("over the cap, skipped: "), "target").alias("note"))
    return DirectoryAudit(own, skipped, Audit(spark.createDataFrame([(path,)], "target string"), rolled, notes))


class SiteAudit(NamedTuple):
    """An audit of sites: pages and assets as they are (URLs as targets), the roll-up under the sites' names,
    coverage (site, discovered, audited, capped, timeouts, skipped) and statuses (site, url, ord, status)."""

    pages: Audit
    assets: Audit | None
    whole: Audit
    coverage: DataFrame
    statuses: DataFrame


Fetch = Callable[[DataFrame], DataFrame]


def _discovered(sites: DataFrame, robots: DataFrame, fetch: Fetch, max_depth: int) -> DataFrame:
    """(site, url, ord, cross_host): the pages of each site's first sitemap that yields any, else its base."""
    first = sites.select("site", F.concat("base", F.lit("/sitemap.xml")).alias("url"), F.lit(0).cast("long").alias("rank"))
    told = site.robots_sitemaps(robots).select("site", "url", (F.col("ord") + 1).alias("rank"))
    last = [sites.select("site", F.concat("base", F.lit(f"/{name}")).alias("url"), F.lit((1 << 40) + k).cast("long").alias("rank")) for k, name in enumerate(site.FALLBACKS)]
    candidates = staged(first.unionByName(told).unionByName(last[0]).unionByName(last[1]), "candidates")
    entries, level, known = None, candidates.select("site", "url").distinct(), None
    for _ in range(max_depth + 1):
        got = staged(site.sitemap_entries(_bodies(fetch(level))), "sitemaps")
        entries = got if entries is None else entries.unionByName(got)
        known = level.select("url") if known is None else known.unionByName(level.select("url"))
        hosts = sites.select("site", site.host_of(F.col("base")).alias("host"))
        maps = got.filter("kind = 'map'").join(level, "url").select("site", F.col("loc").alias("url")).distinct()
        level = staged(maps.join(hosts, "site").filter(site.host_of(F.col("url")) == F.col("host")).select("site", "url").join(known, "url", "left_anti"), "level")
        if level.isEmpty():
            break
    # Each candidate is walked as a root of its own; of a site's candidates that yield pages the first counts.
    roots = candidates.withColumn("key", F.to_json(F.struct("site", "rank")))
    walked = site.expand_sitemaps(entries, roots.select(F.col("key").alias("site"), "url"), max_depth)
    found = walked.join(roots.select(F.col("key").alias("k"), F.col("site").alias("own"), "rank"), F.col("site") == F.col("k")).select(F.col("own").alias("site"), "rank", "url", "ord", "cross_host")
    found = site.first_candidates(found).drop("rank")
    return found.unionByName(sites.join(found, "site", "left_anti").select("site", F.col("base").alias("url"), F.lit(1).cast("long").alias("ord"), F.lit(0).cast("long").alias("cross_host")))


def _bodies(fetched: DataFrame) -> DataFrame:
    """(url, body): the bodies that came, as texts."""
    return fetched.filter("outcome = 'ok'").select("url", routing.decoded(F.col("body")).alias("body"))


def audit_sites(
    sites: DataFrame, authorized: bool = False, fetch: Fetch | None = None, max_pages: int = site.MAX_PAGES, include_assets: bool = False,
    max_assets: int = site.MAX_ASSETS, max_depth: int = site.MAX_DEPTH, **asset_options,
) -> SiteAudit:
    """Audits sites (site, url): robots rules, sitemaps, pages up to the cap, and their assets if asked for.

    fetch turns (site, url) into (url, outcome, body, note); sources.http.fetch is the default. Pages
    are fetched in rounds of what is left of each site's cap, so a site with a million URLs is never
    crawled beyond it; only pages that came use it up. All that was fetched is staged: a lost executor
    does not ask a site again. A site without any sitemap is its base alone, under a note.
    """
    site.require_authorization(authorized)
    if fetch is None:
        from ..sources import http

        def fetch(urls: DataFrame) -> DataFrame:
            return http.fetch(urls, authorized=True)

    def came(urls: DataFrame, name: str) -> DataFrame:
        return staged(fetch(urls.select("site", "url")).select("url", "outcome", "body", "note"), name)

    sites = staged(sites.select("site", site.normalize_base(F.col("url")).alias("base")).filter("base is not null"), "sites")
    asked = sites.select("site", F.concat("base", F.lit("/robots.txt")).alias("url"))
    robots = staged(asked.join(_bodies(came(asked, "robots")), "url").select("site", "body"), "robots-bodies")
    rules_ = site.robots_rules(robots)
    urls = staged(_discovered(sites, robots, lambda u: came(u, "maps"), max_depth), "urls")
    allowed = urls.join(rules_.select(F.col("site").alias("s"), "rule"), (F.col("site") == F.col("s")) & F.startswith(site.path_of(F.col("url")), F.col("rule")), "left_anti")
    fetched = None
    while True:
        left = allowed
        if fetched is not None:
            done = fetched.filter("outcome = 'ok'").groupBy("site").agg(F.count("*").alias("done"))
            left = allowed.join(fetched.select("site", "url"), ["site", "url"], "left_anti").join(done, "site", "left").withColumn("room", F.lit(max_pages) - F.coalesce("done", F.lit(0)))
        else:
            left = left.withColumn("room", F.lit(max_pages))
        nth = F.row_number().over(Window.partitionBy("site").orderBy("ord"))
        batch = staged(left.withColumn("nth", nth).filter("nth <= room").select("site", "url"), "round")
        if batch.isEmpty():
            break
        got = staged(batch.join(came(batch, "pages").withColumnRenamed("url", "u"), F.col("url") == F.col("u"), "left").select("site", "url", F.coalesce("outcome", F.lit("error")).alias("outcome"), "body", "note"), "fetched")
        fetched = got if fetched is None else fetched.unionByName(got)
    if fetched is None:
        fetched = urls.limit(0).select("site", "url", F.lit("").alias("outcome"), F.lit(b"").alias("body"), F.lit("").alias("note"))
    statuses = staged(site.crawl(urls.select("site", "url", "ord"), rules_, fetched.select("url", "outcome"), max_pages), "statuses")
    ord_of = urls.select(F.col("url").alias("u"), F.col("site").alias("us"), "ord")
    pages = staged(fetched.filter("outcome = 'ok'").join(ord_of, (F.col("url") == F.col("u")) & (F.col("site") == F.col("us"))).select("site", F.col("url").alias("target"), "ord", routing.decoded(F.col("body")).alias("html")), "page-texts")

    page_found = staged(site.page_findings(pages), "page-findings")
    page_audit = Audit(pages.select("target").distinct(), page_found, text.text_notes(pages).withColumn("ord", F.lit(0).cast("long")).distinct())
    rolled = _rolled(page_found, pages.select("site", "target", F.col("ord").alias("page")))
    said = [
        (0, urls.filter("cross_host > 0").select("site", F.concat(F.col("cross_host").cast("string"), F.lit(" sitemap entries of other hosts were left out.")).alias("note")).distinct()),
        (1, sites.join(urls.join(sites, "site").filter("url <> base"), "site", "left_anti").select("site", F.lit("No sitemap was found: the base alone was looked at.").alias("note"))),
        (2, fetched.filter("coalesce(note, '') <> ''").select("site", F.concat("url", F.lit(": "), "note").alias("note"))),
        (3, rolled.select(F.col("target").alias("site")).distinct().select("site", F.lit(rules.NOTES["statistical"]).alias("note"))),
    ]
    links = site.asset_urls(pages.withColumn("url", F.col("target"))).join(pages.select("site", "target", F.col("ord").alias("page")), "target")
    assets = staged(site.first_assets(links.select("site", "asset", F.struct("page", "ord").alias("seen")), max_assets if include_assets else 0), "assets")
    rest = assets.filter("not fetched").groupBy("site").agg(F.count("*").cast("string").alias("n"))
    coverage = site.coverage(statuses)
    asset_audit = None
    if include_assets:
        wanted = assets.filter("fetched").select("site", F.col("asset").alias("url"), "nth")
        got = wanted.join(came(wanted, "asset-bodies").withColumnRenamed("url", "u"), F.col("url") == F.col("u"), "left")
        got = staged(got.select("site", "url", "nth", F.coalesce("outcome", F.lit("error")).alias("outcome"), "body", "note"), "asset-fetched")
        asset_audit = audit_files(got.filter("outcome = 'ok'").select(F.col("url").alias("target"), F.col("body").alias("content")).dropDuplicates(["target"]), **asset_options)
        rolled = rolled.unionByName(_rolled(asset_audit.findings, got.select("site", F.col("url").alias("target"), (F.col("nth") + (1 << 30)).cast("long").alias("page"))))
        said.append((4, got.filter("coalesce(note, '') <> ''").select("site", F.concat("url", F.lit(": "), "note").alias("note"))))
        said.append((5, rest.select("site", F.concat("n", F.lit(" assets beyond the cap were not fetched.")).alias("note"))))
        late = got.groupBy("site").agg(F.count_if(F.col("outcome") == "timeout").alias("late"))
        coverage = coverage.join(late, "site", "left").withColumn("timeouts", F.col("timeouts") + F.coalesce("late", F.lit(0))).drop("late")
    else:
        said.append((5, rest.select("site", F.concat("n", F.lit(" assets were seen and not fetched.")).alias("note"))))
    notes = None
    for k, part in said:
        part = part.select(F.col("site").alias("target"), F.lit(k).cast("long").alias("ord"), "note")
        notes = part if notes is None else notes.unionByName(part)
    return SiteAudit(page_audit, asset_audit, Audit(sites.select(F.col("site").alias("target")), rolled, staged(notes, "notes")), coverage, statuses)


def _rolled(found: DataFrame, places: DataFrame) -> DataFrame:
    """Findings of pages or assets under their site's name, in order; places: (site, target, page)."""
    layers = F.when(F.col("layer") == "markup", 0).when(F.col("layer") == "source", 1).otherwise(2)
    joined = found.join(places, "target")
    own = report.relocated(joined, F.col("site"))
    order = Window.partitionBy("target").orderBy("page", layers, "ord")
    return own.withColumn("ord", F.row_number().over(order).cast("long")).select("target", "ord", "layer", *FINDING)


def audit_site(spark: SparkSession, url: str, **options) -> SiteAudit:
    """Audits one site by its address."""
    return audit_sites(spark.createDataFrame([(url, url)], "site string, url string"), **options)
