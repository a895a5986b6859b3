"""Finding postings on the web: queries, result links, hosts, hops, structured data, robots rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import COVERED_BOARDS, UNREADABLE_HOSTS
from ..functions.text import collapse_whitespace, decode_entities, host_of, html_text, normalize_text, text_or_empty, tokens
from ..operators.reports import earliest
from .feeds import first_said, said, when_iso

LOCAL_TITLES = (("developers?", "vývojář"), ("engineers?", "inženýr"), ("analysts?", "analytik"), ("designers?", "designér"), ("programmers?", "programátor"))


def search_queries(query: str, city: str, country: str = "Czech Republic") -> list[str]:
    """A search in English words and one in Czech ones."""
    place = city or country
    local = query
    for pattern, word in LOCAL_TITLES:
        local = re.sub(rf"(?i)\b{pattern}\b", word, local)
    return list(dict.fromkeys([f"{query} {place} (job OR práce OR kariéra OR careers)", f"{local} {place} nabídka práce"]))


def redirect_target(href: Column) -> Column:
    """Where a result link leads: the target it carries, itself if it is no redirect, null for other redirects and non-URLs."""
    url = F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).otherwise(href)
    carried = F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("uddg")))
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(carried, F.when(host.isNotNull() & ~F.contains(host, F.lit("duckduckgo")), url))


def anchors(html: Column) -> Column:
    """array<struct<attributes, href, text>> of a page's links, by patterns."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*>.*?</a\s*>)"), F.lit(1))

    def one(a: Column) -> Column:
        head = F.regexp_extract(a, r"(?is)^(<a\b[^>]*>)", 1)
        href = decode_entities(F.regexp_extract(head, "(?is)\\bhref\\s*=\\s*[\"']([^\"']*)[\"']", 1))
        return F.struct(head.alias("head"), href.alias("href"), collapse_whitespace(decode_entities(F.regexp_replace(a, r"(?s)<[^>]*>", ""))).alias("text"))

    return F.transform(found, one)


def search_results(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url, title) of search result pages (page_id, html): each target once, the first one."""
    links = pages.select("page_id", F.posexplode(F.filter(anchors(F.col("html")), lambda a: F.contains(a["head"], F.lit("result__a")))).alias("pos", "a"))
    rows = links.select("page_id", "pos", redirect_target(F.col("a.href")).alias("url"), F.col("a.text").alias("title")).filter("url is not null")
    return earliest(rows, ["page_id", "url"], [F.col("pos")])


def worth_visiting(url: Column) -> Column:
    """Whether a URL is on a readable host that no other source covers, sub-domains included."""
    host = host_of(url)
    skip = F.array(*map(F.lit, (*COVERED_BOARDS, *UNREADABLE_HOSTS)))
    blocked = F.exists(skip, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    return F.coalesce((host != "") & F.startswith(url, F.lit("http")) & ~blocked, F.lit(False))


def known_hosts_first(results: DataFrame, hosts: DataFrame, limit: int) -> DataFrame:
    """results (pos, url) with `place`: those on hosts that gave postings before come first, else the order stays."""
    known = hosts.select("host").distinct().withColumn("known", F.lit(True))
    out = results.withColumn("host", host_of("url")).join(known, "host", "left")
    return out.orderBy(F.coalesce("known", F.lit(False)).desc(), "pos").limit(limit).select("pos", "url", "host", F.coalesce("known", F.lit(False)).alias("known"))


def absolute(href: Column, base: Column) -> Column:
    """A link's http(s) URL without its fragment, for absolute links, paths and protocol-relative links; null for others."""
    plain = F.regexp_replace(href, "#.*$", "")
    scheme = F.try_parse_url(base, F.lit("PROTOCOL"))
    origin = F.concat(scheme, F.lit("://"), F.try_parse_url(base, F.lit("AUTHORITY")))
    folder = F.regexp_replace(F.coalesce(F.try_parse_url(base, F.lit("PATH")), F.lit("/")), "[^/]*$", "")
    return (
        F.when(F.rlike(plain, F.lit("(?i)^https?://")), plain)
        .when(F.startswith(plain, F.lit("//")), F.concat(scheme, F.lit(":"), plain))
        .when(F.startswith(plain, F.lit("/")), F.concat(origin, plain))
        .when((plain != "") & ~F.rlike(plain, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), F.concat(origin, F.when(folder == "", "/").otherwise(folder), plain))
    )


def _path_text(url: Column) -> Column:
    return normalize_text(text_or_empty(F.try_url_decode(F.try_parse_url(url, F.lit("PATH")))))


def hop_links(pages: DataFrame, query: str, limit: int) -> DataFrame:
    """(page_id, rank, href): a page's best links on its own host whose text or path mentions the query.

    A number in the URL counts 2, a deep path and a mention in the text 1 each; equals keep the page's order. pages: (page_id, url, html).
    """
    words = tokens(F.lit(query))
    mention = lambda c: F.exists(words, lambda w: F.contains(c, w))
    links = pages.select("page_id", "url", F.posexplode(anchors(F.col("html"))).alias("pos", "a"))
    rows = links.select("page_id", "url", "pos", absolute(F.col("a.href"), F.col("url")).alias("href"), normalize_text(F.col("a.text")).alias("said"))
    rows = rows.filter((host_of("href") == host_of("url")) & (F.col("href") != F.col("url"))).withColumn("path", _path_text(F.col("href")))
    rows = earliest(rows.filter(mention(F.col("said")) | mention(F.col("path"))), ["page_id", "href"], [F.col("pos")])
    depth = F.size(F.filter(F.split("path", " "), lambda w: w != ""))
    value = F.when(F.rlike("href", F.lit(r"\d{3,}")), 2).otherwise(0) + F.when(depth >= 2, 1).otherwise(0) + F.when(mention(F.col("said")), 1).otherwise(0)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("value"), "pos"))
    return rows.withColumn("value", value).withColumn("rank", rank).filter(F.col("rank") <= limit).select("page_id", "rank", "href")


_NODE = "`@type` string, title string, name string, description string, datePosted string, validThrough string, jobLocationType string, hiringOrganization string, jobLocation string, baseSalary string, applicationContact string"


def json_ld_postings(pages: DataFrame) -> DataFrame:
    """(page_id, title, company, location, description, remote, posted_at, salary, email) of the JobPosting nodes in pages (page_id, html).

    Nodes may stand alone, in a list or in a @graph; blocks that are no JSON are skipped, nodes without a title too.
    """
    scripts = F.regexp_extract_all("html", F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    blocks = pages.select("page_id", F.posexplode(scripts).alias("block", "raw"))
    listed = F.from_json("raw", "array<string>")
    roots = F.when(F.startswith(F.ltrim("raw"), F.lit("[")), listed).otherwise(F.array("raw"))
    graph = lambda r: F.coalesce(F.from_json(F.get_json_object(r, "$.@graph"), "array<string>"), F.array().cast("array<string>"))
    nodes = F.flatten(F.transform(roots, lambda r: F.concat(F.array(r), graph(r))))
    rows = blocks.select("page_id", "block", F.posexplode(nodes).alias("at", "node")).select("page_id", "block", "at", F.from_json("node", f"struct<{_NODE.replace(' string', ':string')}>").alias("n"))
    n = F.col("n")
    typed = (n["@type"] == "JobPosting") | F.contains(n["@type"], F.lit('"JobPosting"'))
    place = lambda p: F.coalesce(
        F.nullif(F.array_join(F.filter(F.array(said(F.get_json_object(p, "$.address.addressLocality")), said(F.get_json_object(p, "$.address.addressRegion")), first_said(F.get_json_object(p, "$.address.addressCountry.name"), F.get_json_object(p, "$.address.addressCountry"))), lambda x: x != ""), ", "), F.lit("")),
        F.nullif(said(F.get_json_object(p, "$.name")), F.lit("")),
        F.when(F.startswith(F.ltrim(p), F.lit("{")), "").otherwise(said(p)),
    )
    places = F.when(F.startswith(F.ltrim(n["jobLocation"]), F.lit("[")), F.from_json(n["jobLocation"], "array<string>")).otherwise(F.array(n["jobLocation"]))
    location = F.array_join(F.array_distinct(F.filter(F.transform(F.array_compact(places), place), lambda x: x != "")), "; ")
    pay = n["baseSalary"]
    value = lambda name: F.regexp_replace(F.coalesce(F.get_json_object(pay, f"$.value.{name}"), F.get_json_object(pay, f"$.{name}")), r"\.0$", "")
    low, high = value("minValue"), value("maxValue")
    single = F.when(~F.startswith(value("value"), F.lit("{")), value("value"))
    figures = F.when(low.isNotNull() & high.isNotNull(), F.concat(low, F.lit(" - "), high)).otherwise(F.coalesce(single, low))
    unit = F.lower(said(value("unitText")))
    salary = F.when(figures.isNotNull(), F.array_join(F.filter(F.array(figures, said(F.get_json_object(pay, "$.currency")), F.when(unit != "", F.concat(F.lit("/ "), unit)).otherwise("")), lambda x: x != ""), " "))
    org = n["hiringOrganization"]
    mail = lambda src, path: F.regexp_replace(said(F.get_json_object(src, path)), "(?i)^mailto:", "")
    email = F.nullif(first_said(mail(n["applicationContact"], "$.email"), mail(org, "$.email"), mail(org, "$.contactPoint.email"), mail(org, "$.contactPoint[0].email")), F.lit(""))
    company = F.when(F.startswith(F.ltrim(org), F.lit("{")), said(F.get_json_object(org, "$.name"))).otherwise(said(org))
    out = rows.filter(F.coalesce(typed, F.lit(False))).select(
        "page_id", "block", "at", first_said(n["title"], n["name"]).alias("title"), company.alias("company"), location.alias("location"), html_text(n["description"]).alias("description"),
        (F.upper(said(n["jobLocationType"])) == "TELECOMMUTE").alias("remote"), when_iso(n["datePosted"]).alias("posted_at"), salary.alias("salary"), email.alias("email"),
    )
    return out.filter("title <> ''").drop("block", "at")


def robots_rules(text: Column) -> Column:
    """array<struct<allow, value>> of the rules of a robots.txt that apply to everyone."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "#.*", ""), "[\r\t]", " ")))
    pairs = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:?", "")).alias("value")))
    start = F.struct(F.lit(False).alias("ours"), F.lit(False).alias("agent"), F.array().cast("array<struct<allow:boolean,value:string>>").alias("rules"))

    def step(s: Column, p: Column) -> Column:
        agent = p["key"] == "user-agent"
        ours = F.when(agent, (s["agent"] & s["ours"]) | (p["value"] == "*")).otherwise(s["ours"])
        rule = ~agent & s["ours"] & p["key"].isin("allow", "disallow") & (p["value"] != "")
        rules = F.when(rule, F.concat(s["rules"], F.array(F.struct((p["key"] == "allow").alias("allow"), p["value"].alias("value"))))).otherwise(s["rules"])
        return F.struct(ours.alias("ours"), agent.alias("agent"), rules.alias("rules"))

    return F.aggregate(pairs, start, step, lambda s: s["rules"])


def robots_allow(text: Column, path: Column) -> Column:
    """Whether the longest rule that fits a path allows it; allow wins among equals, and no rule allows."""

    def pattern(value: Column) -> Column:
        escaped = F.regexp_replace(F.regexp_replace(value, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*")
        return F.concat(F.lit("^"), F.regexp_replace(escaped, r"\\\$$", r"\$"))

    fits = F.filter(robots_rules(text), lambda r: F.rlike(path, pattern(r["value"])))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["value"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def cache_key(method: Column, url: Column, body: Column) -> Column:
    return F.sha1(F.concat(method, F.lit(" "), url, F.lit("\n"), text_or_empty(body)))
