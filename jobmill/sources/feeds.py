"""Postings from employers' JSON feeds and from aggregators' JSON.

A capture is a row (ats, slug, name, payload); each feed has a schema, the path of its list and a mapping of one entry. Entries are read with from_json, so a
broken payload gives no rows rather than an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import COUNTRY_WORDS, OPEN_REGIONS, REMOTE_ALONE
from ..functions.fields import detect_city
from ..functions.text import decode_entities, html_text, js_trim, normalize_text, text_or_empty

MOST_PER_EMPLOYER = 200


def said(c: Column) -> Column:
    return js_trim(text_or_empty(c))


def first_said(*cs: Column) -> Column:
    return F.coalesce(*(F.nullif(said(c), F.lit("")) for c in cs), F.lit(""))


def join_location(parts: Column) -> Column:
    """Parts of a place joined, without those that another one covers."""
    kept = F.filter(F.transform(parts, said), lambda p: p != "")

    def add(done: Column, part: Column) -> Column:
        covers = lambda e: F.contains(F.lower(e), F.lower(part)) | F.contains(F.lower(part), F.lower(e))
        return F.when(F.exists(done, covers), done).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(kept, F.array().cast("array<string>"), add), ", ")


def _number(c: Column) -> Column:
    return F.regexp_replace(c, r"\.0$", "")


def salary_range(low: Column, high: Column, currency: Column) -> Column:
    """"low - high currency" as far as they are known; null without a figure."""
    figures = F.when(low.isNotNull() & high.isNotNull(), F.concat(_number(low), F.lit(" - "), _number(high))).otherwise(_number(F.coalesce(low, high)))
    return F.when(said(currency) != "", F.concat(figures, F.lit(" "), said(currency))).otherwise(figures)


def when_iso(c: Column) -> Column:
    """A time from ISO text, as UTC without a zone."""
    plain = F.regexp_replace(c, r"Z$|[+-]00:?00$", "")
    return F.coalesce(F.try_to_timestamp(plain).cast("timestamp_ntz"), F.to_timestamp_ntz(F.to_date(F.regexp_extract(c, r"^\d{4}-\d{2}-\d{2}$", 0)).cast("string")))


def when_millis(c: Column) -> Column:
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (c.cast("double") / 1000).cast("decimal(18,6)"))


@dataclass(frozen=True)
class Feed:
    entry: str
    root: str | None
    id: Callable[[Column], Column]
    title: Callable[[Column], Column]
    url: Callable[[Column], Column]
    places: Callable[[Column], Column]
    body: Callable[[Column], Column]
    remote: Callable[[Column], Column]
    posted: Callable[[Column], Column]
    salary: Callable[[Column], Column] = lambda j: F.lit(None).cast("string")


FEEDS = {
    "greenhouse": Feed(
        "id string, title string, absolute_url string, location struct<name:string>, offices array<struct<name:string>>, content string, updated_at string",
        "jobs",
        lambda j: j["id"],
        lambda j: said(j["title"]),
        lambda j: said(j["absolute_url"]),
        lambda j: F.concat(F.array(j["location"]["name"]), F.coalesce(F.transform(j["offices"], lambda o: o["name"]), F.array().cast("array<string>"))),
        lambda j: html_text(decode_entities(said(j["content"]))),
        lambda j: F.lit(False),
        lambda j: when_iso(j["updated_at"]),
    ),
    "lever": Feed(
        "id string, text string, hostedUrl string, applyUrl string, categories struct<location:string,allLocations:array<string>>, descriptionPlain string, description string, workplaceType string, createdAt string, salaryRange struct<min:string,max:string,currency:string>",
        None,
        lambda j: j["id"],
        lambda j: said(j["text"]),
        lambda j: first_said(j["hostedUrl"], j["applyUrl"]),
        lambda j: F.concat(F.array(j["categories"]["location"]), F.coalesce(j["categories"]["allLocations"], F.array().cast("array<string>"))),
        lambda j: first_said(j["descriptionPlain"], html_text(said(j["description"]))),
        lambda j: F.coalesce(j["workplaceType"] == "remote", F.lit(False)),
        lambda j: when_millis(j["createdAt"]),
        lambda j: salary_range(j["salaryRange"]["min"], j["salaryRange"]["max"], j["salaryRange"]["currency"]),
    ),
    "ashby": Feed(
        "id string, title string, jobUrl string, location string, secondaryLocations array<struct<location:string>>, compensation struct<compensationTierSummary:string>, descriptionPlain string, descriptionHtml string, isRemote boolean, publishedAt string",
        "jobs",
        lambda j: j["id"],
        lambda j: said(j["title"]),
        lambda j: said(j["jobUrl"]),
        lambda j: F.concat(F.array(j["location"]), F.coalesce(F.transform(j["secondaryLocations"], lambda s: s["location"]), F.array().cast("array<string>"))),
        lambda j: first_said(j["descriptionPlain"], html_text(said(j["descriptionHtml"]))),
        lambda j: F.coalesce(j["isRemote"], F.lit(False)),
        lambda j: when_iso(j["publishedAt"]),
        lambda j: F.nullif(said(j["compensation"]["compensationTierSummary"]), F.lit("")),
    ),
    "recruitee": Feed(
        "id string, title string, careers_url string, location string, city string, country string, salary struct<min:string,max:string,currency:string>, description string, requirements string, remote boolean, published_at string, created_at string",
        "offers",
        lambda j: j["id"],
        lambda j: said(j["title"]),
        lambda j: said(j["careers_url"]),
        lambda j: F.array(j["location"], j["city"], j["country"]),
        lambda j: html_text(F.concat_ws(" ", said(j["description"]), said(j["requirements"]))),
        lambda j: F.coalesce(j["remote"], F.lit(False)),
        lambda j: F.coalesce(when_iso(j["published_at"]), when_iso(j["created_at"])),
        lambda j: salary_range(j["salary"]["min"], j["salary"]["max"], j["salary"]["currency"]),
    ),
    "workable": Feed(
        "shortcode string, title string, url string, application_url string, city string, country string, description string, requirements string, telecommuting boolean, created_at string",
        "jobs",
        lambda j: F.nullif(said(j["shortcode"]), F.lit("")),
        lambda j: said(j["title"]),
        lambda j: first_said(j["url"], j["application_url"]),
        lambda j: F.array(j["city"], j["country"]),
        lambda j: html_text(F.concat_ws(" ", said(j["description"]), said(j["requirements"]))),
        lambda j: F.coalesce(j["telecommuting"], F.lit(False)),
        lambda j: when_iso(j["created_at"]),
    ),
    "smartrecruiters": Feed(
        "id string, name string, location struct<city:string,country:string,remote:boolean>, company struct<identifier:string>, releasedDate string",
        "content",
        lambda j: F.nullif(said(j["id"]), F.lit("")),
        lambda j: said(j["name"]),
        lambda j: F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.url_encode(first_said(j["company"]["identifier"], F.col("slug"))), F.lit("/"), F.url_encode(said(j["id"]))),
        lambda j: F.array(j["location"]["city"], j["location"]["country"]),
        lambda j: F.lit(""),
        lambda j: F.coalesce(j["location"]["remote"], F.lit(False)),
        lambda j: when_iso(j["releasedDate"]),
    ),
}


def postings(captures: DataFrame, ats: str) -> DataFrame:
    """(slug, name, id, title, url, location, description, remote, posted_at, salary) of one kind of feed's captures.

    The first MOST_PER_EMPLOYER entries of a capture count; those without a title or a URL are left out.
    """
    feed = FEEDS[ats]
    listed = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in feed.entry.split(', '))}>>"
    parsed = F.from_json("payload", f"struct<{feed.root}:{listed}>")[feed.root] if feed.root else F.from_json("payload", listed)
    entries = captures.filter(F.col("ats") == ats).select("slug", "name", F.explode(F.slice(parsed, 1, MOST_PER_EMPLOYER)).alias("j"))
    j = F.col("j")
    place = join_location(feed.places(j))
    rows = entries.select(
        "slug",
        "name",
        F.coalesce(feed.id(j), feed.url(j)).alias("id"),
        feed.title(j).alias("title"),
        feed.url(j).alias("url"),
        place.alias("location"),
        feed.body(j).alias("description"),
        (feed.remote(j) | F.rlike(place, F.lit("(?i)remote"))).alias("remote"),
        feed.posted(j).alias("posted_at"),
        feed.salary(j).alias("salary"),
    )
    return rows.filter((F.col("title") != "") & (F.col("url") != ""))


def with_descriptions(listed: DataFrame, details: DataFrame) -> DataFrame:
    """postings whose empty description is filled from details (id, payload), captures of one posting each."""
    sections = F.from_json(F.get_json_object("payload", "$.jobAd.sections"), "map<string,struct<text:string>>")
    body = html_text(F.array_join(F.transform(F.map_values(sections), lambda s: said(s["text"])), "\n"))
    return listed.join(details.select("id", body.alias("detail")), "id", "left").withColumn("description", first_said(F.col("description"), F.col("detail"))).drop("detail")


def names_country(location: Column) -> Column:
    return F.rlike(text_or_empty(location), F.lit(COUNTRY_WORDS)) | detect_city(location).isNotNull()


def located_in_country(location: Column, remote: Column) -> Column:
    """In the country, or remote without naming another one."""
    place = text_or_empty(location)
    return names_country(location) | (F.coalesce(remote, F.lit(False)) & (F.rlike(place, F.lit(REMOTE_ALONE)) | F.rlike(place, F.lit(OPEN_REGIONS))))


def located_or_unknown(location: Column, remote: Column) -> Column:
    """In the country, remote, or without a place."""
    return F.coalesce(remote, F.lit(False)) | (text_or_empty(location) == "") | names_country(location)


def employer_of(listings: DataFrame, employers: DataFrame) -> DataFrame:
    """listings (url, company) with the employer's ats, slug and name: by equal names, else the first whose slug is in the URL.

    employers (seq, ats, slug, name) is a configuration of some rows; Spark broadcasts it while it is small.
    """
    named = employers.select(normalize_text("name").alias("company_key"), F.struct("seq", "ats", "slug", "name").alias("e")).groupBy("company_key").agg(F.min("e").alias("by_name"))
    company = normalize_text(text_or_empty("company"))
    out = listings.withColumn("company_key", F.nullif(company, F.lit(""))).join(named, "company_key", "left")
    urls = listings.select("url").distinct().join(employers.withColumn("key", F.lower("slug")), F.contains(F.lower("url"), F.col("key")))
    by_url = urls.groupBy("url").agg(F.min(F.struct("seq", "ats", "slug", "name")).alias("by_url"))
    return out.join(by_url, "url", "left").select("url", "company", F.coalesce("by_name", "by_url").alias("e")).select("url", "company", "e.ats", "e.slug", "e.name")


def aggregator_jobs(captures: DataFrame) -> DataFrame:
    """(title, company, location, description, url, salary, work_type, posted_at) of Jooble captures (payload); entries need a title and a link."""
    schema = "struct<jobs:array<struct<title:string,location:string,snippet:string,salary:string,type:string,link:string,company:string,updated:string>>>"
    rows = captures.select(F.explode(F.from_json("payload", schema)["jobs"]).alias("j")).select("j.*")
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.filter((said(F.col("title")) != "") & (said(F.col("link")) != "")).select(
        "title", F.coalesce("company", F.lit("")).alias("company"), "location", html_text("snippet").alias("description"), F.col("link").alias("url"),
        none("salary").alias("salary"), none("type").alias("work_type"), when_iso(F.col("updated")).alias("posted_at"),
    )


_NFJ = "struct<postings:array<struct<title:string,name:string,posted:string,url:string,regions:array<string>,fullyRemote:boolean,salary:struct<from:string,to:string,currency:string,period:string,type:string>,location:struct<places:array<struct<city:string,country:struct<code:string>>>>>>>"


def board_postings(captures: DataFrame, matches: Callable[[Column], Column], region: str = "cz", iso3: str = "CZE", limit: int = 60) -> DataFrame:
    """(url, title, company, location, salary, work_type) of NoFluffJobs search captures (page, payload), in the order of their pages.

    Postings count once by URL and once by company and title, among those in the country or remote whose title matches; the first `limit` stay.
    """
    rows = captures.select("page", F.posexplode(F.from_json("payload", _NFJ)["postings"]).alias("pos", "p"))
    p = F.col("p")
    places = F.coalesce(p["location"]["places"], F.array().cast("array<struct<city:string,country:struct<code:string>>>"))
    remote = F.coalesce(p["fullyRemote"], F.lit(False)) | F.exists(places, lambda x: F.coalesce(F.lower(x["city"]) == "remote", F.lit(False)))
    inside = F.coalesce(F.array_contains(p["regions"], region), F.lit(False)) | F.exists(places, lambda x: F.coalesce(x["country"]["code"] == iso3, F.lit(False)))
    cities = F.transform(F.filter(places, lambda x: F.coalesce((x["country"]["code"] == iso3) & (text_or_empty(x["city"]) != ""), F.lit(False))), lambda x: x["city"])
    abroad = F.array_distinct(F.transform(F.filter(places, lambda x: F.coalesce(x["country"]["code"] != iso3, F.lit(False))), lambda x: x["country"]["code"]))
    away = F.when((F.size(cities) == 0) & (F.size(abroad) > 0), F.concat(F.lit("Remote ("), F.array_join(abroad, ", "), F.lit(")"))).otherwise("Remote")
    listed = F.slice(F.array_distinct(cities), 1, 3)
    place = F.array_join(F.when(remote, F.concat(listed, F.array(away))).otherwise(listed), ", ")
    s = p["salary"]
    none = lambda c: F.nullif(F.nullif(_number(c), F.lit("")), F.lit("0"))
    low, high = none(s["from"]), none(s["to"])
    figures = F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(low, F.lit(" - "), high)).otherwise(F.coalesce(high, low))
    period = F.when(F.lower(s["period"]) == "month", "měsíc").otherwise(F.lower(text_or_empty(s["period"])))
    pay = F.concat(figures, F.lit(" "), text_or_empty(s["currency"]), F.when(period != "", F.concat(F.lit(" / "), period)).otherwise(""), F.when(text_or_empty(s["type"]) != "", F.concat(F.lit(" ("), s["type"], F.lit(")"))).otherwise(""))
    good = rows.filter((text_or_empty(p["url"]) != "") & (text_or_empty(p["title"]) != "") & (inside | remote) & matches(p["title"]))
    good = good.select("page", "pos", p["url"].alias("key"), F.lower(F.concat_ws("|", text_or_empty(p["name"]), p["title"])).alias("job"), p["title"].alias("title"), p["name"].alias("company"), place.alias("location"), js_trim(pay).alias("salary"), F.when(remote, "Remote").alias("work_type"))
    from ..operators.reports import earliest

    order = [F.col("page"), F.col("pos")]
    once = earliest(earliest(good, ["key"], order), ["job"], order)
    out = once.withColumn("url", F.concat(F.lit(f"https://nofluffjobs.com/{region}/job/"), "key"))
    return out.orderBy("page", "pos").limit(limit).select("page", "pos", "url", "title", "company", "location", "salary", "work_type")


def board_description(detail: Column) -> Column:
    """The description of a NoFluffJobs posting's detail capture: text, daily tasks, requirements."""
    d = F.from_json(detail, "struct<details:struct<description:string>,requirements:struct<musts:array<struct<value:string>>,nices:array<struct<value:string>>,description:string>,specs:struct<dailyTasks:array<string>>>")
    values = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<struct<value:string>>")), lambda r: text_or_empty(r["value"])), lambda v: v != "")
    musts, nices = values(d["requirements"]["musts"]), values(d["requirements"]["nices"])
    tasks = F.coalesce(d["specs"]["dailyTasks"], F.array().cast("array<string>"))
    line = lambda head, items, sep: F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(items, sep))).otherwise("")
    parts = F.array(html_text(d["details"]["description"]), line("Daily tasks:\n- ", tasks, "\n- "), line("Must have: ", musts, ", "), line("Nice to have: ", nices, ", "), html_text(d["requirements"]["description"]))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")
