"""Checks of drafted messages: similarity, copied and banned phrases, style, shape of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import BANNED_PHRASES
from ..functions.fields import let
from ..functions.text import js_trim, text_or_empty

#: Patterns of style, placeholders and letters.
GENDER_SLASH = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_]*\p{L}/[aá](?![\p{L}\p{N}_])"
SKILL_LIST = r"(\b[A-Z][\w.+#-]*\b\s*,\s*){2,}\b[A-Z][\w.+#-]*\b"
PLACEHOLDER = r"(?iu)[\[\]{}<>]|your name|jméno a příjmení|\(name\)|lorem ipsum|\*\*"
CZECH_LETTERS = "[ěščřžýáíéůúďťňĚŠČŘŽÝÁÍÉŮÚĎŤŇ]"
PICTOGRAPHS = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}\\x{200D}]"


def words(c: Column | str) -> Column:
    """The words of a text in lower case, letters and digits of any script."""
    plain = F.regexp_replace(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}\s ]", " ")
    return F.filter(F.split(plain, r"[\s ]+"), lambda w: w != "")


def grams(c: Column, size: int) -> Column:
    """The distinct runs of `size` words of an array of words."""

    def runs(w: Column) -> Column:
        n = F.size(w) - size + 1
        all_runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(n <= 0, F.array().cast("array<string>")).otherwise(F.array_distinct(all_runs))

    return let(c, runs)


def similarity(a: Column | str, b: Column | str) -> Column:
    """The Dice coefficient of the texts' pairs of neighbouring words; 1 for two texts without any."""

    def dice(p: Column) -> Column:
        total = F.size(p["x"]) + F.size(p["y"])
        return F.when(total == 0, 1.0).otherwise(2 * F.size(F.array_intersect(p["x"], p["y"])) / total)

    return let(F.struct(grams(words(a), 2).alias("x"), grams(words(b), 2).alias("y")), dice)


def meaningfully_edited(draft: Column | str, final: Column | str) -> Column:
    """Whether a final text differs enough from its draft; never an empty one, always one without a draft."""
    d = text_or_empty(draft)
    return F.when(js_trim(text_or_empty(final)) == "", False).when(d == "", True).otherwise(similarity(draft, final) < 0.85)


def copied_phrases(drafts: DataFrame, sources: DataFrame, size: int = 5, allowed: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, phrase): runs of `size` words of drafts (doc_id, text) that stand in sources (item_id, text), except those of allowed (text)."""
    own = drafts.select("doc_id", F.explode(grams(words("text"), size)).alias("phrase"))
    theirs = sources.select("item_id", F.explode(grams(words("text"), size)).alias("phrase"))
    if allowed is not None:
        own = own.join(allowed.select(F.explode(grams(words("text"), size)).alias("phrase")).distinct(), "phrase", "left_anti")
    return own.join(theirs, "phrase")


def banned_phrases(draft: Column | str, never: tuple[str, ...] = ()) -> Column:
    """The banned phrases as they stand in a draft, then the configured ones that it holds."""
    text = text_or_empty(draft)
    found = [F.nullif(F.regexp_extract(text, f"(?iu){p}", 0), F.lit("")) for p in BANNED_PHRASES]
    configured = [F.when(F.contains(F.lower(text), F.lit(p.strip().lower())), F.lit(p.strip())) for p in never if p.strip()]
    return F.array_distinct(F.array_compact(F.array(*found, *configured)))


def style_problems(draft: Column | str) -> Column:
    """Words with a slash for gender, and lists of skills."""
    text = text_or_empty(draft)
    slash = F.nullif(F.regexp_extract(text, GENDER_SLASH, 0), F.lit(""))
    return F.array_compact(F.array(F.when(slash.isNotNull(), F.concat(F.lit("gender slash: "), slash)), F.when(F.rlike(text, F.lit(SKILL_LIST)), F.lit("skill list"))))


#: What a draft is rid of, in this order.
CLEANING = (
    (PICTOGRAPHS, ""),
    ("^```[a-z]*\n?|```$", ""),
    (r"(?iu)(?m)^(subject|předmět)\s*:.*$", ""),
    ("^[\"“„']+|[\"”“']+$", ""),
    ("!+", "."),
    ("[ \t]+\n", "\n"),
    ("\n{3,}", "\n\n"),
)


def clean_draft(c: Column | str) -> Column:
    """A draft without pictographs, fences, subject lines, outer quotes and shouting."""
    return js_trim(reduce(lambda text, rule: F.regexp_replace(text, *rule), CLEANING, text_or_empty(c)))


def usable(c: Column | str) -> Column:
    """Between 180 and 1400 characters and without placeholders."""
    c = text_or_empty(c)
    return F.length(c).between(180, 1400) & ~F.rlike(c, F.lit(PLACEHOLDER))


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(text_or_empty(c), r"[\s ]+"), lambda w: w != ""))


def is_czech(form: Column | str, description: Column | str) -> Column:
    """Czech letters in the form's text, or in the description where the form says next to nothing."""
    form = text_or_empty(form)
    letters = lambda c: F.rlike(c, F.lit(CZECH_LETTERS))
    return letters(form) | ((F.length(js_trim(form)) <= 5) & letters(F.substring(text_or_empty(description), 1, 1500)))
