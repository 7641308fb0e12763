"""Column functions that clean and tokenise names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and what the matcher reads them as, one to one.
FOLD_FROM = (
    "ÀÁÂÃÄÅàáâãäåĀāĂăĄąǍǎ" "ÇçĆćČč" "ĐđÐð" "ÈÉÊËèéêëĒēĖėĚě" "Ğğ" "ÌÍÎÏìíîïĪīİıǏǐ" "ĻļŁł" "ÑñŃńŅņ" "ÒÓÔÕÖØòóôõöøŌō" "Řř"
    "ŚśŞşŠš" "Țț" "ÙÚÛÜùúûüŪūŬŭǓǔ" "Ýý" "ŹźŽž" "СсеЕрРиИкКаАбБйЙ"
)
FOLD_TO = (
    "AAAAAAAAAAAAAAAAAAAA" "CCCCCC" "DDDD" "EEEEEEEEEEEEEE" "GG" "IIIIIIIIIIIIII" "LLLL" "NNNNNN" "OOOOOOOOOOOOOO" "RR"
    "SSSSSS" "TT" "UUUUUUUUUUUUUU" "YY" "ZZZZ" "SSEERRIIKKAABBYY"
)
#: Letters that become two.
FOLD_TO_TWO = {"Þ": "TH", "þ": "TH"}
#: White space of the matcher.
SPACE = "\\x09-\\x0D\\x20"


def _decompositions() -> tuple[dict[str, str], dict[str, str], str]:
    """By rule, of all of Unicode: characters whose decomposition without combining marks has letters
    or digits that names are compared by, as one base character or as several; and a class of
    all that is marks only."""
    one, several, marks = {}, {}, []
    for code in range(0x80, 0x20000):  # beyond, neither is assigned
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not base:
            if marks and marks[-1][1] == code - 1:
                marks[-1][1] = code
            else:
                marks.append([code, code])
            continue
        if base != c and any(x.isascii() and x.isalnum() for x in base.upper()):
            (one if len(base) == 1 else several)[c] = base
    return one, several, "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in marks)


ONE, SEVERAL, MARKS = _decompositions()
ACCENT_FROM, ACCENT_TO = "".join(ONE), "".join(ONE.values())
COMBINING = f"[{MARKS}]"
_SEVERAL_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in SEVERAL) + "]"


def is_blank(name: Column) -> Column:
    """Null, empty, or white space only."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), f"[{SPACE}]", "") == ""


def normalize(name: Column, keep_hyphen: bool = False) -> Column:
    """Upper-case ASCII letters, digits and spaces; folded letters; other characters are dropped without a space."""
    s = F.coalesce(name, F.lit(""))
    for letter, two in FOLD_TO_TWO.items():
        s = F.replace(s, F.lit(letter), F.lit(two))
    s = F.translate(s, FOLD_FROM, FOLD_TO)
    # strip before upper: upper-casing may turn one character into two
    s = F.regexp_replace(s, f"[^A-Za-z0-9{SPACE}-]", "")
    s = F.regexp_replace(s, f"[{SPACE}]", " ")
    return F.upper(s if keep_hyphen else F.replace(s, F.lit("-"), F.lit(" ")))


def tokenize(clean: Column) -> Column:
    return F.filter(F.split(clean, " +"), lambda t: t != "")


def tail_tokens(tokens: Column) -> Column:
    """The tokens, then head, head + tail and tail of each with a hyphen that is not its last character; no hyphens left."""

    def parts(t: Column) -> Column:
        at = F.locate("-", t)
        head, tail = F.substring(t, F.lit(1), at - 1), F.substring(t, at + 1, F.length(t))
        none = F.array().cast("array<string>")
        return F.when((at > 0) & (at < F.length(t)), F.array(head, F.concat(head, tail), tail)).otherwise(none)

    # substring needs columns for its bounds here; locate of a column needs SQL
    extra = F.flatten(F.transform(tokens, parts))
    return F.transform(F.concat(tokens, extra), lambda t: F.replace(t, F.lit("-"), F.lit("")))


def sorted_unique(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens))


def fix_mojibake(name: Column) -> Column:
    """UTF-8 that was read as Latin-1, where it shows and can be undone."""
    raw = F.encode(F.regexp_replace(name, "[^\\x00-\\xFF]", ""), "ISO-8859-1")
    odd = (name.contains("Ã") | name.contains("Â")) & name.rlike("^[\\x00-\\xFF]*$")
    return F.when(odd & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(name)


def strip_diacritics(name: Column) -> Column:
    """Characters of all of Unicode without their marks, as far as names are compared by them."""
    plain = F.regexp_replace(F.translate(name, ACCENT_FROM, ACCENT_TO), COMBINING, "")
    table = F.create_map(*[F.lit(x) for pair in SEVERAL.items() for x in pair])
    spelt = F.array_join(F.transform(F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    plain = F.when(plain.rlike(_SEVERAL_CLASS), spelt).otherwise(plain)
    return F.when(name.rlike("[^\\x00-\\x7F]"), plain).otherwise(name)


def normalize_for_evaluation(name: Column) -> Column:
    """Upper-case ASCII words with single spaces; here punctuation becomes a space."""
    s = strip_diacritics(fix_mojibake(F.coalesce(name, F.lit(""))))
    return F.trim(F.regexp_replace(F.upper(s), "[^A-Z0-9]+", " "))


def evaluation_tokens(name: Column) -> Column:
    return tokenize(normalize_for_evaluation(name))


def sorted_token_key(name: Column) -> Column:
    return F.array_join(F.array_sort(evaluation_tokens(name)), " ")


def sorted_unique_token_key(name: Column) -> Column:
    return F.array_join(sorted_unique(evaluation_tokens(name)), " ")
