"""Scalar text repairs.  All are total: null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEPT_ABBREVIATIONS = tuple("ave blvd co corp dept dr etc inc jr ltd mr mrs ms no sr st vs".split())
UPPER_SHARE = 0.70

_SPACES = "(?U)\\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)\\s+$", "")


def words(c: Column) -> Column:
    """The words between white space; an empty array of blank text."""
    return F.filter(F.split(c, _SPACES), lambda w: w != "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, _SPACES, " "))


def is_digits(c: Column) -> Column:
    return c.rlike("(?U)^\\d+$")


def chain(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def strip_markup(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


UNDERSCORE_RULES = (("(?U)(_\\s+){2,}_", "___"), ("_{3,}", "___"), ("(?U)(:\\s*)\\s{3,}", "$1___"), (" {2,}", " "))


def normalize_underscores(c: Column) -> Column:
    """Fill-in blanks, however spelled, become three underscores.  Not idempotent: a label's blank may gain three more."""
    return chain(c, UNDERSCORE_RULES)


PUNCTUATION_RULES = (
    ("(?U)\\s+([.,;:!?])", "$1"),
    ("(?U)([(\\[{])\\s+", "$1"),
    ("(?U)\\s+([)\\]}])", "$1"),
    ("(?U)([.,;:!?])\\s+([.,;:!?])", "$1$2"),
    ("(?U)(\\w)\\s+-\\s+(\\w)", "$1-$2"),
    ("(?U)(\\w)\\s+'\\s*(\\w)", "$1'$2"),
    ("(?U)(\\w)\\s+'", "$1'"),
    ("(?U)'\\s+(\\w)", "'$1"),
    (" {2,}", " "),
)


def punctuation_spacing(c: Column) -> Column:
    """Blanks that a recognizer puts around punctuation, brackets, hyphens and apostrophes go."""
    return strip(chain(c, PUNCTUATION_RULES))


def fix_encoding(c: Column) -> Column:
    """Typographic blanks, quotes, dashes and ellipses in ASCII."""
    return F.replace(F.translate(c, "\u00a0\u2018\u2019\u201c\u201d\u2013\u2014", " ''\"\"--"), F.lit("\u2026"), F.lit("..."))


def clean(c: Column) -> Column:
    return collapse(strip_markup(fix_encoding(c)))


def trailing_period(c: Column) -> Column:
    """One period that a recognizer appended goes, unless it ends an abbreviation or an initial."""
    t = rstrip(c)
    cut = F.substring(t, 1, F.length(t) - 1)
    last = F.lower(F.regexp_extract(cut, "(?U)(\\S+)\\s*$", 1))
    kept = last.isin(*KEPT_ABBREVIATIONS) | last.rlike("^\\p{L}$")
    return F.when(F.endswith(t, F.lit(" .")), rstrip(F.substring(t, 1, F.length(t) - 2))).when(F.endswith(t, F.lit(".")), F.when(kept, t).otherwise(cut)).otherwise(t)


DECIMAL_NUMBER = "(?U)\\b\\d+\\.\\d+\\b"
DATE_LIKE = "\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}"
PHONE_LIKE = "\\(?\\d{3}\\)?[-.\\s]\\d{3}[-.\\s]\\d{4}"
STANDALONE_DASH = "(?:^|(?<=\\s))-(\\d{2,4})(?=\\s|$|[,;:!?)\\]])"
LABEL_DASH = "([A-Z]{2,})-(\\d{2,4})(?![\\d/a-zA-Z-])"


def decimal_dash(c: Column) -> tuple[Column, Column]:
    """(text, repaired): dashes and bullets that were decimal points; dates and phones keep their dashes."""
    dotted = F.regexp_replace(c, "\u2022(\\d)", ".$1")
    skip = dotted.rlike(DATE_LIKE) | dotted.rlike(PHONE_LIKE)
    fixed = F.regexp_replace(F.regexp_replace(dotted, STANDALONE_DASH, ".$1"), LABEL_DASH, "$1.$2")
    text = F.when(skip, dotted).otherwise(fixed)
    return text, F.coalesce(~skip & (fixed != c), F.lit(False))


def occurrences(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def dropped_parenthesis(c: Column) -> Column:
    """An optional plural's lost opening parenthesis comes back where closings outnumber openings."""
    fixed = F.regexp_replace(c, "(?U)\\b([a-zA-Z]{2,}?)([Ee][Ss]|[Ss])\\)", "$1($2)")
    return F.when(occurrences(c, ")") > occurrences(c, "("), fixed).otherwise(c)


def repeated_words(c: Column) -> tuple[Column, Column]:
    """(text, removed): words that repeat the one before, whatever their case."""
    w = words(c)
    # Pairs with the word before; looking it up by place would split the text again for each word.
    pairs = F.zip_with(w, F.concat(F.array(F.lit(None).cast("string")), w), lambda x, before: F.struct(x.alias("x"), before.alias("before")))
    kept = F.filter(pairs, lambda p: p["x"].isNotNull() & (p["before"].isNull() | (F.lower(p["x"]) != F.lower(p["before"]))))
    removed = F.size(w) - F.size(kept)
    return F.when(removed > 0, F.array_join(F.transform(kept, lambda p: p["x"]), " ")).otherwise(c), F.when(removed > 0, removed)


def _letters(c: Column) -> Column:
    return F.regexp_replace(c, "[^\\p{L}]", "")


def transfer_case(shape: Column, text: Column) -> Column:
    """text with the capitals of shape: word by word where counts agree, else as a whole if shape is mostly upper case."""
    a, b = words(shape), words(text)
    by_word = F.array_join(F.zip_with(a, b, lambda s, t: F.when(_letters(s).rlike("^\\p{Lu}+$"), F.upper(t)).otherwise(t)), " ")
    letters = _letters(shape)
    share = F.try_divide(F.length(F.regexp_replace(letters, "[^\\p{Lu}]", "")), F.length(letters))
    whole = F.when(share >= UPPER_SHARE, F.upper(text)).otherwise(text)
    return F.when(F.size(a) == 0, text).when(F.size(a) == F.size(b), by_word).otherwise(whole)


SIGNATURE_LABEL = (
    "(?iU)((?:RECEIVED|SIGNED)\\s+BY\\s*:|SIGNATURE\\s+OF\\s+[\\w\\s]*?(?:APPLICANT|CONSIGNEE|INITIATOR|AUTHORIZED(?:\\s+\\w+)?)\\s*:|SIGNATURE\\s*:)"
    "\\s*([a-z]+(?:\\s+[a-z]+){0,2})(?=\\s+DATE\\s*:|$)"
)


def signature_text(c: Column) -> Column:
    """A name read after a signature label is replaced by a marker."""
    return F.regexp_replace(c, SIGNATURE_LABEL, "$1 (signature)")


def truncate(c: Column, limit: int = 35) -> Column:
    """One line for display, with an ellipsis where cut."""
    t = strip(F.regexp_replace(F.coalesce(c, F.lit("")), "\n|<br>", " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("\u2026"))).otherwise(t)
