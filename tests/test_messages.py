"""Rules of drafts, messages and forms: a case for each fixed value or rule."""

import re

import pytest
from pyspark.sql import functions as F

from jobmill.functions.dictionaries import BANNED_PHRASES, CITIES, SKILLS
from jobmill.functions.fields import city_in, detect_city
from jobmill.functions.text import normalize_text, normalized, token_list, tokens
from jobmill.operators import drafts, forms, messages

SAID = (
    "rád bych se ucházel", "tímto se ucházím", "timto se hlasim", "dovoluji si", "v příloze zasílám", "bohaté zkušenosti", "těším se na", "I am writing to", "i would like to express", "great fit",
    "i believe", "i look forward", "opportunity", "strong background", "proven", "track record", "skillset", "excited", "nadšení", "vášnivě", "přesvědčen", "prospěšný", "inovativní", "unikátní", "výzva",
    "synergie", "mindset", "šikovný", "skvělý", "dynamický", "ideální kandidát", "rád bych se podílel", "mohl bych přispět", "jsem si jist", "cenným aktivem", "i am thrilled", "passionate", "leverage",
    "synergy", "ideal candidate", "valuable asset", "i am confident", "cutting-edge", "innovative", "dynamic",
)


def test_every_banned_phrase_is_found(spark):
    assert len(SAID) == len(BANNED_PHRASES) == 45
    rows = spark.createDataFrame([(k, f"Píšu, že {text} a dál.") for k, text in enumerate(SAID)], "id int, draft string")
    for row in rows.select("id", drafts.banned_phrases("draft", ("  A dál ", "jinak")).alias("found")).collect():
        wanted = re.search(BANNED_PHRASES[row.id], SAID[row.id], re.I)
        assert wanted and wanted[0].lower() in [f.lower() for f in row.found] and row.found[-1] == "A dál"


SHAPES = [
    # A closing that may not stay above a signature on its own line is relaxed like any other.
    ("Hello,\n\nSome text.\n\nWarm regards, Eva Malá", False, "Eva Malá", "Hi,\n\nSome text.\n\nThanks,\n\nEva Malá"),
    ("Dear team,\n\nSome text.\n\nKind regards, Eva Malá", False, "Eva Malá", "Hi,\n\nSome text.\n\nThanks,\nEva Malá"),
    ("Ahoj!\nPÍŠU VÁM kvůli práci.\nEva Malá.\nTel. 1\nTel. 2", True, "Eva Malá", "Dobrý den,\npíšu vám kvůli práci.\nEva Malá"),
    ("", True, "Eva Malá", "Dobrý den,\n\n\nEva Malá".replace("\n\n\n", "\n\n")),
    ("Vážení přátelé,", True, "Eva Malá", "Dobrý den,\n\nEva Malá"),
    ("Jen věta.", True, "", "Dobrý den,\n\njen věta."),
    (None, None, None, "Hi,"),
]


def test_shapes(spark):
    rows = spark.createDataFrame([(k, *s[:3]) for k, s in enumerate(SHAPES)], "id int, body string, czech boolean, name string")
    got = {r.id: r.shaped for r in rows.select("id", messages.shaped_message("body", "czech", "name", F.lit(None).cast("string")).alias("shaped")).collect()}
    assert got == {k: s[3] for k, s in enumerate(SHAPES)}


def test_claims(spark):
    cases = [
        ("Hi,\nI shipped Kubernetes clusters.", "Docker.", "We run Kubernetes.", [], [], ["Kubernetes"]),
        ("Dobrý den,\nvyvinul jsem Kotlin aplikace, chtěl bych umět Rust.", "Java", "Kotlin, Rust", [], [], ["Kotlin"]),
        ("Hi,\nI worked with Kotlin. Then I used kotlin.", None, "Kotlin", [], ["Kotlin"], ["Kotlin"]),
        ("Hi,\nI have been working for 12 years or more.", "12 years", "x", [], [], []),
        ("Hi,\nI have been working for seven years.", "6 years", "x", [], [], ["seven years"]),
        ("Hi,\nI know Acme.", "x", "Acme", ["Acme Corp"], [], []),
        ("Only one line, I know Rust.", "x", "Rust", [], [], []),
        (None, None, None, None, None, []),
    ]
    rows = spark.createDataFrame([(k, *c[:5]) for k, c in enumerate(cases)], "id int, draft string, cv string, job string, allow array<string>, skills array<string>")
    out = rows.select("id", messages.unsupported_claims("draft", "cv", "job", F.col("allow"), F.col("skills")).alias("found"))
    assert {r.id: r.found for r in out.collect()} == {k: c[5] for k, c in enumerate(cases)}


def _fields(labels, kinds=()):
    """Fields of one form; `kinds` names those that are no text inputs by their place."""
    of = dict(kinds)
    return [(1, k, *of.get(k, ("input", "text")), label, "", "", "", "", "", of.get(k, ("", ""))[1] == "checkbox", True, []) for k, label in enumerate(labels)]


def test_every_phrase_of_every_rule_alone_names_its_field(spark):
    """A label that is a rule's phrase and nothing else belongs to that rule, unless another rule has it too or excludes it."""
    said = [(p, key) for key, kinds in forms.RULES.items() for k in ("strong", "phrase") for p in kinds.get(k, ())]
    assert sum(len(p) for kinds in forms.RULES.values() for kind, p in kinds.items() if kind != "autocomplete") == 247
    kind = {"consent": ("input", "checkbox"), "marketing": ("input", "checkbox"), "cv": ("input", "file"), "coverLetter": ("textarea", "textarea"), "message": ("textarea", "textarea")}
    table = spark.createDataFrame(_fields([p for p, _ in said], {k: kind[key] for k, (_, key) in enumerate(said) if key in kind}), forms.FIELD)
    got = {r.pos: r.key for r in forms.classified(table, forms.rule_table(spark)).select("pos", "key").collect()}
    excluded = {p: set(kinds.get("exclude", ())) for p, kinds in ((key, forms.RULES[key]) for key in forms.RULES)}
    for k, (phrase, key) in enumerate(said):
        hit = any(f" {x} " in f" {phrase} " for x in excluded[key])
        others = [o for p, o in said if o != key and f" {p} " in f" {phrase} "]
        assert hit or others or got[k] == key, (phrase, key, got[k])


def test_fill_values_of_websites_and_countries(spark):
    table = spark.createDataFrame(_fields(["Webová stránka", "Odkaz na profil", "Země"]), forms.FIELD)
    for profile, wanted in (
        ({"githubUrl": "g", "linkedInUrl": "l", "country": "cz"}, ["g", "l", "Ceska Republika"]),
        ({"githubUrl": "g", "country": "FI"}, ["g", "g", "FI"]),
    ):
        rows = forms.plan(forms.classified(table, forms.rule_table(spark)), profile)[0].collect()
        assert [r.value for r in sorted(rows, key=lambda r: r.pos)] == wanted


@pytest.mark.parametrize("text", ["", "  Kraków – Łódź, ÚSTÍ nad Labem!", "Senior C# / .NET, Hradec  Králové", "école ẞ naïve", "Praha 5, Brno"])
def test_values_fold_as_columns_do(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(normalize_text("t").alias("n"), tokens("t").alias("w"), detect_city("t").alias("c")).first()
    assert (row.n, row.w, row.c) == (normalized(text), token_list(text), city_in(text))


def test_spellings_belong_to_one_name():
    for table in (CITIES, SKILLS):
        spellings = [s for _, group in table for s in group]
        assert len(spellings) == len(set(spellings))
