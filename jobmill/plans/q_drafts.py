"""Text quality of drafts, over conversations, documents and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drafts, forms
from ..sources import domain
from .registry import literal, query, values

_WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"


def words(x: str) -> str:
    return _WORDS.format(x=x)


def grams(x: str, n: int) -> str:
    w = words(x)
    return f"list_distinct(list_transform(range(1, greatest(1, len({w}) - {n - 2})), lambda i: array_to_string(({w})[i : i + {n - 1}], ' ')))"


PAIRS = "pairs AS (SELECT a.conv_id, a.turn, a.text AS draft, CASE WHEN a.turn % 2 = 0 THEN a.text || ' and some more words' ELSE b.text END AS final FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = domain.read(spark, sf, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    final = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" and some more words"))).otherwise(F.col("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("draft"), final.alias("final"))


@query(
    "t1_t2_draft_similarity",
    f"""WITH {PAIRS}, g AS (SELECT conv_id, turn, {grams('draft', 2)} AS x, {grams('final', 2)} AS y FROM pairs),
s AS (SELECT conv_id, turn, CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END AS v FROM g)
SELECT conv_id, turn, floor(v * 1000000 + 0.5) / 1000000 AS similarity, v < 0.85 AS edited FROM s""",
)
def t1(spark: SparkSession, sf: str) -> DataFrame:
    p = _pairs(spark, sf)
    return p.select("conv_id", "turn", (F.floor(drafts.similarity("draft", "final") * 1_000_000 + 0.5) / 1_000_000).alias("similarity"), drafts.meaningfully_edited("draft", "final").alias("edited"))


@query(
    "t3_copied_phrases",
    f"""WITH w AS (SELECT doc_id, {words('text')} AS w FROM documents), b AS (SELECT item_id, {words('text')} AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3))) AS i FROM w)),
s AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS phrase FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 3))) AS i FROM b))
SELECT d.doc_id, s.item_id, d.phrase FROM d JOIN s USING (phrase)""",
)
def t3(spark: SparkSession, sf: str) -> DataFrame:
    return drafts.copied_phrases(domain.read(spark, sf, "documents"), domain.read(spark, sf, "benchmark"))


DRAFTS = [
    (1, "Rád bych se ucházel o pozici.", "Rád bych se ucházel,rád bych se ucházel", ""),
    (2, "hlásím se na pozici frontend vývojáře.", "", ""),
    (3, "rád/a bych se dozvěděl/a víc.", "", "gender slash: rád/a"),
    (4, "Umím React, TypeScript, Node a Docker.", "", "skill list"),
    (5, "Tímto se hlásím a dovoluji si psát. I would like to apply.", "Tímto se hlásím,dovoluji si,I would like to apply", ""),
    (6, "", "", ""),
]


@query("t4_t5_banned_and_style", values("id INT, banned VARCHAR, style VARCHAR", [(i, b, s) for i, _, b, s in DRAFTS]))
def t4(spark: SparkSession, sf: str) -> DataFrame:
    rows = literal(spark, "id int, draft string", [(i, d) for i, d, _, _ in DRAFTS])
    never = ("rád bych se ucházel", "I would like to apply")
    return rows.select("id", F.array_join(drafts.banned_phrases("draft", never), ",").alias("banned"), F.array_join(drafts.style_problems("draft"), ",").alias("style"))


@query(
    "t7_draft_usability",
    "SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INT) AS n_words, length(text) BETWEEN 180 AND 1400 AND NOT regexp_matches(lower(text), '[\\[\\]{}<>]|your name|jméno a příjmení|\\(name\\)|lorem ipsum|\\*\\*') AS usable FROM conversations",
)
def t7(spark: SparkSession, sf: str) -> DataFrame:
    return domain.read(spark, sf, "conversations").select("conv_id", "turn", drafts.word_count("text").alias("n_words"), drafts.usable("text").alias("usable"))


@query("t7_clean_drafts", values("id INT, cleaned VARCHAR", [(1, "Hi, thanks."), (2, "Text."), (3, "a\n\nb")]))
def t7_clean(spark: SparkSession, sf: str) -> DataFrame:
    rows = literal(spark, "id int, draft string", [(1, "\"Hi, thanks!!!\""), (2, "Subject: x\nText. \U0001f600"), (3, "a  \n\n\n\nb ")])
    return rows.select("id", drafts.clean_draft("draft").alias("cleaned"))


@query("t9_czech_letters", "SELECT doc_id, regexp_matches(text, '[ěščřžýáíéůúďťňĚŠČŘŽÝÁÍÉŮÚĎŤŇ]') AS czech FROM documents")
def t9(spark: SparkSession, sf: str) -> DataFrame:
    return domain.read(spark, sf, "documents").select("doc_id", drafts.is_czech("text", F.lit("")).alias("czech"))


@query("t11_sample_selection")
def t11(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three samples, hand-written ones before edited ones, in an order drawn by a seed."""
    rows = domain.read(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", (F.col("turn") % 2 == 1).alias("edited"))
    return rows.orderBy("edited", F.xxhash64("conv_id", "turn", F.lit(7))).limit(3)


@query(
    "t17_accepted_mappings",
    """WITH m AS (SELECT user_id AS form, event_id % 12 AS field, ['email', 'none', 'consent', 'phone', 'cv'][event_id % 5 + 1] AS key, least(1.0, value / 100) AS confidence, event_id AS seq FROM events)
SELECT form, field, key, least(0.7, confidence) AS score FROM (SELECT *, row_number() OVER (PARTITION BY form, field ORDER BY seq) AS r FROM m WHERE key NOT IN ('none', 'consent', 'marketing') AND confidence >= 0.6) WHERE r = 1""",
)
def t17(spark: SparkSession, sf: str) -> DataFrame:
    """The first acceptable mapping of each field, its score capped."""
    from ..operators.reports import earliest

    keys = F.array(*map(F.lit, ("email", "none", "consent", "phone", "cv")))
    m = domain.read(spark, sf, "events").select(
        F.col("user_id").alias("form"), (F.col("event_id") % 12).alias("field"), F.element_at(keys, (F.col("event_id") % 5 + 1).cast("int")).alias("key"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"), F.col("event_id").alias("seq")
    )
    good = m.filter(~F.col("key").isin("none", "consent", "marketing") & (F.col("confidence") >= 0.6))
    return earliest(good, ["form", "field"], [F.col("seq")]).select("form", "field", "key", F.least(F.lit(0.7), "confidence").alias("score"))


@query("t16_first_submit_button", "SELECT user_id AS form, arg_min(event_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END * 1000000000 + event_id) AS button FROM events GROUP BY user_id")
def t16(spark: SparkSession, sf: str) -> DataFrame:
    """The first submit button of a form, else its first button."""
    order = F.struct(F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id")
    return domain.read(spark, sf, "events").groupBy(F.col("user_id").alias("form")).agg(F.min_by("event_id", order).alias("button"))


SCAN = """f AS (SELECT user_id AS form, event_id AS pos, event_id % 2 AS frame, event_type AS tag, CASE event_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'email' END AS type, CASE event_id % 4 WHEN 1 THEN '' WHEN 2 THEN 'n' || event_id % 5 WHEN 3 THEN 'n' || event_id % 7 END AS name,
  CASE WHEN event_id % 5 > 0 THEN 'l' || event_id % 4 END AS label, CASE WHEN event_id % 7 > 3 THEN 'p' END AS placeholder, CAST(NULL AS VARCHAR) AS aria_label FROM events)"""


@query(
    "t18_fields_across_scans",
    f"""WITH {SCAN}, g AS (SELECT * FROM f WHERE pos % 7 <> 0)
SELECT f.form, f.pos, min(g.pos) AS now FROM f LEFT JOIN g ON g.form = f.form AND g.frame = f.frame AND g.tag IS NOT DISTINCT FROM f.tag AND g.type IS NOT DISTINCT FROM f.type
  AND CASE WHEN coalesce(f.name, '') <> '' AND coalesce(g.name, '') <> '' THEN f.name = g.name ELSE f.label IS NOT DISTINCT FROM g.label AND f.placeholder IS NOT DISTINCT FROM g.placeholder AND f.aria_label IS NOT DISTINCT FROM g.aria_label END
GROUP BY f.form, f.pos""",
)
def t18(spark: SparkSession, sf: str) -> DataFrame:
    """Where the fields of a form are after it was read again, with every seventh one gone."""
    id_ = F.col("event_id")
    name = F.when(id_ % 4 == 1, "").when(id_ % 4 == 2, F.concat(F.lit("n"), id_ % 5)).when(id_ % 4 == 3, F.concat(F.lit("n"), id_ % 7))
    scan = domain.read(spark, sf, "events").select(
        F.col("user_id").alias("form"), id_.alias("pos"), (id_ % 2).alias("frame"), F.col("event_type").alias("tag"), F.when(id_ % 3 == 0, "text").when(id_ % 3 == 1, "email").alias("type"), name.alias("name"),
        F.when(id_ % 5 > 0, F.concat(F.lit("l"), id_ % 4)).alias("label"), F.when(id_ % 7 > 3, "p").alias("placeholder"), F.lit(None).cast("string").alias("aria_label"),
    )
    return forms.relocated(scan, scan.filter("pos % 7 <> 0")).select("form", "pos", "now")


@query(
    "t15_t19_page_states",
    values("id INT, left_login BOOLEAN, blocked BOOLEAN", [(1, True, False), (2, False, True), (3, False, False), (4, False, True)]),
)
def t15(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a page shows that a sign-in succeeded, and whether a captcha stands in the way."""
    rows = literal(
        spark, "id int, url string, login_wall boolean, captcha string, invisible boolean, challenge boolean",
        [(1, "https://www.board.cz/home", False, None, False, False), (2, "https://board.cz/login/step2", False, "hcaptcha", False, False), (3, "https://other.cz/home", False, "recaptcha", True, False), (4, "not a url", True, "recaptcha", True, True)],
    )
    from ..functions.text import host_of

    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    left = ~F.col("login_wall") & F.coalesce(host_of("url") == "board.cz", F.lit(False)) & ~F.startswith(path, F.lit("/login"))
    blocked = F.col("captcha").isNotNull() & (F.col("challenge") | ~F.col("invisible"))
    return rows.select("id", left.alias("left_login"), blocked.alias("blocked"))


SHAPES = [
    (1, "Dobré ráno,\n\nHlásím se na pozici.\n\nS pozdravem,\nPetra Veselá", True, "Petra Veselá", "Dobrý den,\n\nhlásím se na pozici.\n\nDíky,\nPetra Veselá"),
    (2, "Hlásím se na pozici a rád se dozvím více.", True, "Petra Veselá", "Dobrý den,\n\nhlásím se na pozici a rád se dozvím více.\n\nPetra Veselá"),
    (3, "Hello,\n\nI am applying for the role.\n\nBest regards, Petra Veselá.", False, "Petra Veselá", "Hi,\n\nI am applying for the role.\n\nThanks,\nPetra Veselá"),
    (4, "Dobrý den,\n\nHLÁSÍM SE na pozici.\n\nPetra Veselá\nVzorová firma", True, "Petra Veselá", "Dobrý den,\n\nhlásím se na pozici.\n\nPetra Veselá"),
]


@query("t8_message_shape", values("id INT, shaped VARCHAR", [(i, s) for i, *_, s in SHAPES]))
def t8(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import messages

    rows = literal(spark, "id int, body string, czech boolean, name string", [s[:4] for s in SHAPES])
    return rows.select("id", messages.shaped_message("body", "czech", "name", "name").alias("shaped"))


CLAIMS = [
    (1, "Dobrý den,\n\nmám zkušenosti s Kotlin.\n\nPetra", "React, TypeScript.", "Požadujeme Kotlin a Esri.", [], "Kotlin"),
    (2, "Dobrý den,\n\nrád bych se naučil Kotlin.\n\nPetra", "React, TypeScript.", "Požadujeme Kotlin a Esri.", [], ""),
    (3, "Dobrý den,\n\nPracuji s React a TypeScript. Praha je moje město.\n\nPetra", "Frontend developer. React, TypeScript. Praha.", "Hledáme vývojáře React + GIS, Kotlin.", [], ""),
    (4, "Dobrý den,\n\nmám za sebou čtyři roky práce s React.\n\nPetra", "React, tři roky praxe.", "Požadujeme čtyři roky praxe.", [], "čtyři roky"),
    (5, "Dobrý den,\n\nvyužíval jsem mapová data.\n\nPetra", "React.", "Budete pracovat s daty.", ["mapová data"], "mapova"),
]


@query("t6_unsupported_claims", values("id INT, flagged VARCHAR", [(i, f) for i, *_, f in CLAIMS]))
def t6(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import messages

    rows = literal(spark, "id int, draft string, cv string, job string, skills array<string>", [c[:5] for c in CLAIMS])
    allow = F.array(F.lit("Petra Veselá"))
    return rows.select("id", F.array_join(messages.unsupported_claims("draft", "cv", "job", allow, "skills"), ",").alias("flagged"))


def _field(form: int, pos: int, tag: str, kind: str, label: str, required: bool = False, options: list | None = None, autocomplete: str = "") -> tuple:
    return form, pos, tag, kind, label, "", "", "", "", autocomplete, required, True, options or []


FIELDS = [
    (_field(1, 0, "input", "email", "Přihlaste se k newsletteru"), "email"),
    (_field(1, 1, "input", "text", "Jméno"), "fullName"),
    (_field(1, 2, "input", "url", "LinkedIn"), "linkedInUrl"),
    (_field(1, 3, "input", "email", "Kontaktní e-mail", True), "email"),
    (_field(1, 4, "input", "tel", "Telefon"), "phone"),
    (_field(1, 5, "textarea", "textarea", "Jak mohu vaši firmu posunout vpřed?"), "message"),
    (_field(2, 0, "input", "text", "Jméno", True), "firstName"),
    (_field(2, 1, "input", "text", "Příjmení", True), "lastName"),
    (_field(2, 2, "input", "file", "Životopis", True), "cv"),
    (_field(2, 3, "input", "file", "Další příloha"), "cv"),
    (_field(2, 4, "input", "checkbox", "Souhlasím se zpracováním osobních údajů", True), "consent"),
    (_field(2, 5, "input", "checkbox", "Chci dostávat newsletter, souhlasím"), "marketing"),
    (_field(2, 6, "select", "select", "Země", False, [("1", "Slovakia"), ("2", "Czech Republic (EU)")]), "country"),
    (_field(2, 7, "input", "text", "Cokoliv"), None),
    (_field(2, 8, "input", "hidden", "E-mail"), None),
]
PROFILE = {"fullName": "Jana Nováková", "firstName": "Jana", "lastName": "Nováková", "email": "jana@example.com", "phone": "+420601123456", "linkedInUrl": "https://www.linkedin.com/in/jana", "cv": "cv.pdf", "country": "CZ"}


def _forms(spark: SparkSession) -> DataFrame:
    return forms.classified(literal(spark, forms.FIELD, [f for f, _ in FIELDS]), forms.rule_table(spark))


@query("t12_classified_fields", values("form BIGINT, pos INT, key VARCHAR", [(f[0], f[1], "fullName" if key == "firstName" else key) for f, key in FIELDS]))
def t12(spark: SparkSession, sf: str) -> DataFrame:
    return _forms(spark).select("form", "pos", "key")


@query(
    "t13_t14_fill_plan",
    values(
        "form BIGINT, pos INT, key VARCHAR, value VARCHAR, state VARCHAR",
        [
            (1, 0, "email", "jana@example.com", "fill"), (1, 1, "fullName", "Jana Nováková", "fill"), (1, 2, "linkedInUrl", "https://www.linkedin.com/in/jana", "fill"), (1, 3, "email", "jana@example.com", "fill"),
            (1, 4, "phone", "+420601123456", "fill"), (1, 5, "message", None, "unfillable"), (2, 0, "firstName", "Jana", "fill"), (2, 1, "lastName", "Nováková", "fill"), (2, 2, "cv", "cv.pdf", "fill"),
            (2, 3, "cv", "cv.pdf", "unfillable"), (2, 4, "consent", "true", "fill"), (2, 5, "marketing", "false", "fill"), (2, 6, "country", "2", "fill"), (2, 7, None, None, "unmatched"),
        ],
    ),
)
def t13(spark: SparkSession, sf: str) -> DataFrame:
    return forms.plan(_forms(spark), PROFILE)[0].select("form", "pos", "key", "value", "state")


@query("t13_form_confidence", values("form BIGINT, fills BIGINT, unmatched BIGINT, missing BIGINT, good BOOLEAN", [(1, 5, 0, 0, True), (2, 6, 1, 0, True)]))
def t13_form(spark: SparkSession, sf: str) -> DataFrame:
    return forms.plan(_forms(spark), PROFILE)[1].select("form", "fills", "unmatched", "missing", F.col("confidence").between(0.9, 1.0).alias("good"))
