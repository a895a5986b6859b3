"""Form fields told apart by what their labels say, and what a form can be filled with.

Phrases meet labels by equality: a label's runs of words are joined with the rule table, so the work grows with labels and
not with labels times rules. The rule table is an argument; RULES is a start that covers the common fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dictionaries import COUNTRIES, PERSONAL_SITE
from ..functions.text import normalize_text, text_or_empty

KEYS = ("fullName", "firstName", "lastName", "email", "phone", "linkedInUrl", "githubUrl", "website", "city", "country", "cv", "coverLetter", "message", "salary", "startDate", "consent", "marketing")
#: Phrases by key and kind; strong ones count before exclusions, weak ones less.
RULES: dict[str, dict[str, tuple[str, ...]]] = {
    "fullName": {
        "strong": ("cele jmeno", "jmeno a prijmeni", "full name", "fullname", "name and surname"),
        "phrase": ("your name", "name", "jmeno"),
        "exclude": ("company", "firma", "firmy", "spolecnost", "user", "uzivatel", "file", "soubor", "prijmeni", "krestni", "first", "last", "surname", "pozice", "position", "contact person"),
        "autocomplete": ("name",),
    },
    "firstName": {"phrase": ("krestni jmeno", "first name", "firstname", "given name", "forename", "krestni"), "autocomplete": ("given-name",)},
    "lastName": {"phrase": ("prijmeni", "last name", "lastname", "surname", "family name"), "autocomplete": ("family-name",)},
    "email": {"phrase": ("e mail", "email", "mail", "kontaktni e mail", "emailova adresa", "e mailova adresa"), "autocomplete": ("email",)},
    "phone": {"phrase": ("telefon", "telefonni cislo", "phone", "phone number", "mobile", "mobil", "tel", "cislo"), "exclude": ("cislo uctu", "account number", "id number", "ico"), "autocomplete": ("tel", "tel-national")},
    "linkedInUrl": {"phrase": ("linkedin", "linked in", "odkaz na linkedin", "linkedin profil", "linkedin profile", "linkedin url")},
    "githubUrl": {"phrase": ("github", "git hub", "github profil", "github profile", "github url")},
    "website": {"phrase": ("website", "web", "webova stranka", "portfolio", "osobni web", "personal site", "url", "odkaz", "profil", "profile link"), "exclude": ("linkedin", "github"), "autocomplete": ("url",)},
    "city": {"phrase": ("mesto", "city", "obec", "bydliste", "town", "misto bydliste", "lokalita", "location"), "autocomplete": ("address-level2",)},
    "country": {"phrase": ("zeme", "stat", "country", "statni prislusnost", "nationality"), "autocomplete": ("country", "country-name")},
    "cv": {"phrase": ("cv", "zivotopis", "resume", "resume cv", "curriculum vitae", "prilozit zivotopis", "upload cv", "attach cv", "nahrat zivotopis"), "weak": ("attachment", "priloha", "prilohy", "soubor", "nahrat", "upload", "file"), "exclude": ("motivacni", "cover", "pruvodni", "foto", "photo", "portfolio")},
    "coverLetter": {"phrase": ("motivacni dopis", "cover letter", "pruvodni dopis", "motivation letter", "letter of motivation", "motivacni")},
    "message": {"phrase": ("zprava", "message", "poznamka", "note", "comment", "komentar", "vzkaz", "proc", "why", "tell us", "about you", "o vas", "neco o sobe", "dalsi informace", "additional information", "posunout", "proc prave vy", "proc vas", "co muzete nabidnout", "what can you", "pruvodni text", "vzkaz pro firmu", "zprava pro", "dejte firme vedet", "napiste nam", "tell us why", "motivace", "motivation", "o sobe", "about yourself", "text", "doplnujici")},
    "salary": {"phrase": ("mzda", "plat", "salary", "mzdove ocekavani", "salary expectation", "expected salary", "ocekavana mzda", "financni ocekavani")},
    "startDate": {"phrase": ("nastup", "datum nastupu", "start date", "available from", "moznost nastupu", "availability", "dostupnost")},
    "consent": {"strong": ("zpracovani osobnich udaju", "zpracovanim osobnich udaju", "osobni udaje", "osobnich udaju", "gdpr", "privacy", "privacy policy", "ochrana osobnich udaju", "ochranou osobnich udaju", "terms", "terms and conditions", "podminky", "podminkami", "zasady", "zasadami"), "phrase": ("souhlas", "souhlasim", "agree", "consent", "i agree", "i accept", "accept")},
    "marketing": {"phrase": ("newsletter", "marketing", "marketingove", "obchodni sdeleni", "obchodnich sdeleni", "novinky", "zasilani", "nabidky prace", "job alerts", "job offers", "subscribe", "odber", "informovat", "podobne nabidky", "similar offers", "talent pool", "databaze uchazecu", "evidovat", "budouci", "future", "another suitable position", "other positions", "other vacancies", "suitable position", "let me know", "dalsi vhodnou", "dalsi vhodne", "vhodnou pozici", "vhodne pozice", "jine pozice", "jinou pozici", "jinych pozic", "dalsich pozic", "dalsi pozice", "dalsi nabidky", "jine nabidky", "evidenci", "evidence", "nabidnout", "v budoucnu", "future positions", "keep my", "retain my", "store my", "uchovat", "uchovavat", "po dobu", "contact me", "kontaktovat", "oslovit", "vytvorit profil", "vytvorit ucet", "vytvorit", "profesni profil", "create profile", "create account", "create an account", "registrovat", "zaregistrovat", "sign me up", "remember me")},
}
SIGNALS = (("label", 0.95), ("aria_label", 0.9), ("placeholder", 0.8), ("name", 0.75), ("id", 0.5))
TYPES = {"email": ("email", 0.95), "tel": ("phone", 0.95), "url": ("website", 0.5), "file": ("cv", 0.6), "textarea": ("message", 0.5)}
IGNORED = ("hidden", "submit", "button", "reset", "image", "search", "password")
PAY_OPTION = r"(?iu)^(k[cč]|czk|eur|€|usd|\$|gbp|pln|za m[eě]s[ií]c|m[eě]s[ií][cč]n[eě]|per month|monthly|ro[cč]n[eě]|per year|yearly|hodinov[eě]|per hour|hourly|md|man ?day)$"
LEAST = 0.45
LONGEST = 5

FIELD = "form long, pos int, tag string, type string, label string, aria_label string, placeholder string, name string, id string, autocomplete string, required boolean, visible boolean, options array<struct<value:string,text:string>>"


def rule_table(spark: SparkSession, rules: dict[str, dict[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """(phrase, key, ordinal, kind) of a rule set."""
    rows = [(p, key, k, kind) for k, (key, kinds) in enumerate(rules.items()) for kind, phrases in kinds.items() for p in phrases]
    return spark.createDataFrame(rows, "phrase string, key string, ordinal int, kind string")


def relocated(old: DataFrame, new: DataFrame) -> DataFrame:
    """old (form, pos, frame, tag, type, name, label, placeholder, aria_label) with `now`: the first field of a new scan that is the same one, else null.

    The same frame, tag and type, and then the same name where both have one, else the same label, placeholder and aria_label; nulls are
    equal to nulls. The new scan is folded by identity first, so a field meets two rows at most, however many look alike.
    """
    kind, says = F.struct("form", "frame", "tag", "type"), F.struct("label", "placeholder", "aria_label")
    named = text_or_empty("name") != ""
    by_name = new.filter(named).groupBy(kind.alias("kind"), "name").agg(F.min("pos").alias("of_name"))
    by_label = new.groupBy(kind.alias("kind"), says.alias("says")).agg(F.min("pos").alias("of_any"), F.min(F.when(~named, F.col("pos"))).alias("of_unnamed"))
    out = old.withColumn("kind", kind).withColumn("says", says).join(by_name, ["kind", "name"], "left").join(by_label, ["kind", "says"], "left")
    return out.withColumn("now", F.when(named, F.least("of_name", "of_unnamed")).otherwise(F.col("of_any"))).select(*old.columns, "now")


def checkable() -> Column:
    return (F.col("tag") == "input") & F.col("type").isin("checkbox", "radio")


def _runs(words: Column) -> Column:
    """All runs of up to LONGEST words of an array."""
    n = F.size(words)

    def of(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))

    per = [of(k) for k in range(1, LONGEST + 1)]
    kept = [F.when(n >= k, x).otherwise(F.array().cast("array<string>")) for k, x in enumerate(per, 1)]
    return F.array_distinct(F.flatten(F.array(*kept)))


def evidence(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """(form, pos, key, score, rank, strong): what speaks for each key of each field; of equal scores the one met first has the lower rank."""
    own = fields.filter(~((F.col("tag") == "input") & F.col("type").isin(*IGNORED)))
    signals = F.array(*(F.struct(F.lit(k + 3).alias("source"), normalize_text(text_or_empty(c)).alias("text"), F.lit(w).alias("weight")) for k, (c, w) in enumerate(SIGNALS)))
    said = own.select("form", "pos", checkable().alias("box"), F.inline(signals)).filter("text <> ''")
    runs = said.withColumn("phrase", F.explode(_runs(F.split("text", " "))))
    spoken = rules.filter("kind <> 'autocomplete'")
    hits = runs.join(F.broadcast(spoken), "phrase").filter(F.col("box") == F.col("key").isin("consent", "marketing"))  # a configuration
    strength = F.when(F.col("phrase") == F.col("text"), 1.0).when(F.contains("phrase", F.lit(" ")), 0.95).otherwise(0.85)
    best = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, strength)), F.lit(0.0))
    by_signal = hits.groupBy("form", "pos", "key", "ordinal", "source", "weight").agg(best("strong").alias("strong"), best("phrase").alias("plain"), best("weak").alias("weak"), best("exclude").alias("out"))
    value = F.when(F.col("strong") > 0, F.col("strong")).when(F.col("out") > 0, 0.0).otherwise(F.greatest(F.col("plain"), F.col("weak") * 0.7))
    rank = lambda source: source * 100 + F.col("ordinal")
    spoken_for = by_signal.select("form", "pos", "key", (F.col("weight") * value).alias("score"), rank(F.col("source")).alias("rank"), (F.col("strong") > 0).alias("strong")).filter("score > 0")
    tokens = own.select("form", "pos", F.explode(F.split(F.lower(text_or_empty("autocomplete")), r"\s+")).alias("phrase"))
    auto = tokens.join(F.broadcast(rules.filter("kind = 'autocomplete'")), "phrase").select("form", "pos", "key", F.lit(1.0).alias("score"), rank(F.lit(0)).alias("rank"), F.lit(False).alias("strong"))
    kind = F.when(F.col("tag") == "input", F.col("type")).otherwise(F.col("tag"))
    typed = F.create_map(*(x for k, (key, s) in TYPES.items() for x in (F.lit(k), F.struct(F.lit(key).alias("key"), F.lit(s).alias("score")))))
    by_type = own.select("form", "pos", F.try_element_at(typed, kind).alias("t")).filter("t is not null").select("form", "pos", "t.key", "t.score", F.lit(100).alias("rank"), F.lit(False).alias("strong"))
    pays = F.exists("options", lambda o: F.rlike(text_or_empty(o["text"]), F.lit(PAY_OPTION)))
    by_option = own.filter((F.col("tag") == "select") & F.coalesce(pays, F.lit(False))).select("form", "pos", F.lit("salary").alias("key"), F.lit(0.6).alias("score"), F.lit(200).alias("rank"), F.lit(False).alias("strong"))
    every = spoken_for.union(auto).union(by_type).union(by_option)
    return every.groupBy("form", "pos", "key").agg(F.max("score").alias("score"), F.min("rank").alias("rank"), F.max("strong").alias("strong"))


def classified(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """fields with `key` and `score`, null where nothing speaks for a key enough.

    A box is marketing if anything says so, and consent without strong words only if it must be ticked; fields typed e-mail or telephone keep that key.
    """
    found = evidence(fields, rules).groupBy("form", "pos").agg(F.collect_list(F.struct("key", "score", "rank", "strong")).alias("found"))  # as many as keys
    out = fields.join(found, ["form", "pos"], "left")
    keyed = F.coalesce("found", F.array().cast("array<struct<key:string,score:double,rank:int,strong:boolean>>"))
    has = lambda key: F.exists(keyed, lambda e: e["key"] == key)
    box, is_input = checkable(), F.col("tag") == "input"
    bold = F.exists(keyed, lambda e: (e["key"] == "consent") & e["strong"])
    drop = F.concat(
        F.when(box & ~has("marketing") & ~bold & ~F.coalesce("required", F.lit(False)), F.array(F.lit("consent"))).otherwise(F.array().cast("array<string>")),
        F.when(is_input & (F.col("type") == "url") & (has("linkedInUrl") | has("githubUrl")), F.array(F.lit("website"))).otherwise(F.array().cast("array<string>")),
        F.when(is_input & (F.col("type") == "file") & has("coverLetter") & ~has("cv"), F.array(F.lit("message"))).otherwise(F.array().cast("array<string>")),
    )
    kept = F.filter(keyed, lambda e: ~F.array_contains(drop, e["key"]))
    best = F.array_max(F.transform(F.filter(kept, lambda e: e["score"] >= LEAST), lambda e: F.struct(e["score"].alias("score"), (-e["rank"]).alias("early"), e["key"].alias("key"))))
    only = lambda key: F.get(F.transform(F.filter(kept, lambda e: e["key"] == key), lambda e: F.struct(e["score"].alias("score"), (-e["rank"]).alias("early"), e["key"].alias("key"))), F.lit(0))
    chosen = F.when(box & has("marketing"), only("marketing")).when((F.col("type") == "email") & has("email"), only("email")).when((F.col("type") == "tel") & has("phone"), only("phone")).otherwise(best)
    return out.withColumn("chosen", chosen).select(*fields.columns, F.col("chosen.key").alias("key"), F.col("chosen.score").alias("score"))


def _same(name: str, *read):
    return lambda o: F.greatest(*(r(o) == name for r in read))


def _inside(name: str, read):
    return lambda o: F.contains(F.concat(F.lit(" "), read(o), F.lit(" ")), F.lit(f" {name} "))


def country_option(options: Column, code: str) -> Column:
    """The value of the option that names a country: by equal text or value, name by name, else by a name of three letters or more in its text."""
    names = dict(COUNTRIES).get(code.upper(), (code.lower(),))
    text, value = (lambda o: normalize_text(text_or_empty(o["text"]))), (lambda o: normalize_text(text_or_empty(o["value"])))
    first = lambda test: F.get(F.filter(options, test), F.lit(0))["value"]
    exact = [first(_same(n, text, value)) for n in names]
    inside = [first(_inside(n, text)) for n in names if len(n) >= 3]
    return F.coalesce(*exact, *inside)


def plan(fields: DataFrame, profile: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(fields with `state` fill, unfillable or unmatched, one row a form with `confidence`) for classified fields and a profile's values by key.

    A single name field next to a last-name field takes the first name; a form gets one CV and one letter. Fields out of sight do not count.
    """
    seen = fields.filter(F.coalesce("visible", F.lit(True)) & ~((F.col("tag") == "input") & F.col("type").isin(*IGNORED)))
    surnames = seen.filter("key = 'lastName'").select("form").distinct().withColumn("split", F.lit(True))
    every = normalize_text(F.concat_ws(" ", "label", "placeholder", "aria_label", "name"))
    whole = F.rlike(every, F.lit("cele jmeno|jmeno a prijmeni|full name|fullname|name and surname"))
    seen = seen.join(surnames, "form", "left").withColumn("key", F.when((F.col("key") == "fullName") & F.col("split") & ~whole, "firstName").otherwise(F.col("key")))
    values = F.create_map(*(F.lit(x) for pair in profile.items() for x in pair))
    of = lambda key: F.nullif(F.try_element_at(values, F.lit(key)), F.lit(""))
    code = profile.get("country", "")
    names = dict(COUNTRIES).get(code.upper())
    known = (
        F.when(F.col("key") == "website", F.when(F.rlike(every, F.lit(PERSONAL_SITE)), of("githubUrl")).otherwise(F.coalesce(of("linkedInUrl"), of("githubUrl"))))
        .when(F.col("key") == "country", F.nullif(F.lit(names[0].title() if names else code), F.lit("")))
        .otherwise(F.nullif(F.try_element_at(values, "key"), F.lit("")))
    )
    value = (
        F.when(F.col("tag") == "select", F.when(F.col("key") == "country", country_option(F.col("options"), code)))
        .when(F.col("key").isin("message", "coverLetter", "salary", "startDate"), None)
        .when(F.col("key") == "consent", "true")
        .when(F.col("key") == "marketing", "false")
        .when((F.col("key") == "cv") & (F.col("type") != "file"), None)
        .otherwise(known)
    )
    from pyspark.sql import Window

    once = F.row_number().over(Window.partitionBy("form", "key").orderBy(F.desc("score"), "pos"))
    filled = seen.withColumn("value", value).withColumn("place", F.when(F.col("value").isNotNull() & F.col("key").isin("cv", "coverLetter"), once))
    state = F.when(F.col("key").isNull(), "unmatched").when(F.col("value").isNull() | (F.col("place") > 1), "unfillable").otherwise("fill")
    out = filled.withColumn("state", state).drop("split", "place")
    must = F.coalesce("required", F.lit(False)) & ~(checkable() & F.coalesce(F.col("key") == "marketing", F.lit(False)))
    form = out.groupBy("form").agg(
        F.count("*").alias("n"), F.count_if(F.col("state") == "fill").alias("fills"), F.avg(F.when(F.col("state") == "fill", F.col("score"))).alias("mean"),
        F.count_if(F.col("state") == "unmatched").alias("unmatched"), F.count_if(must).alias("required"), F.count_if(must & (F.col("state") != "fill")).alias("missing"),
    )
    coverage = F.when(F.col("required") == 0, 1.0).otherwise((F.col("required") - F.col("missing")) / F.col("required"))
    raw = coverage * (0.6 + 0.25 * F.col("mean") + 0.15 * (F.col("n") - F.col("unmatched")) / F.col("n")) - F.least(F.lit(0.15), F.col("unmatched") * 0.03)
    capped = F.when(F.col("missing") > 0, F.least(raw, F.lit(0.6))).otherwise(raw)
    confidence = F.when(F.col("fills") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(capped, 3))))
    return out, form.select("form", "fills", "unmatched", "missing", confidence.alias("confidence"))
