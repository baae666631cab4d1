"""Firm names made comparable, with column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from procurelake.functions.scalars import squished, trimmed

#: Letters and what stands for them, in order.
LETTERS = (("ø", "oe"), ("æ", "ae"), ("å", "aa"), ("á", "a"), ("é", "e"), ("è", "e"), ("à", "a"))
#: Patterns of legal forms in order of precedence, and the form.
LEGAL_FORMS = (
    ("aktieselskabet", "a/s"), ("aktieselskab", "a/s"), ("anpartsselskabet", "aps"), ("anpartsselskab", "aps"),
    (r"a[.]m[.]b[.]a[.]?", "amba"), (r"a\s+m\s+b\s+a", "amba"), (r"s[.]m[.]b[.]a[.]?", "smba"), (r"f[.]m[.]b[.]a[.]?", "fmba"),
    (r"a/s[.]?", "a/s"), ("gmbh", "a/s"), ("aps", "aps"), ("i/s", "i/s"), ("k/s", "k/s"), ("ks", "k/s"), ("ivs", "ivs"), ("p/s", "p/s"),
    (r"amba[.]?", "amba"), ("smba", "smba"), ("fmba", "fmba"), ("as", "a/s"), ("ab", "aps"), ("a/", "a/s"),
)
NO_FORM = "Undetermined"
#: Words and the word they are compared as.
WORDS = {
    "international": "int", "and": "og", "of": "af", "limited": "ltd", "denmark": "dk", "danmark": "dk", "holdings": "holding", "corporation": "corp",
    "company": "co", "comp": "co", "copenhagen": "kbh", "kobenhavn": "kbh", "cph": "kbh", "i": "1", "ii": "2", "iii": "3",
}
#: Words that tell little about a firm.
STOP_WORDS = (
    "af", "arhus", "asset", "assets", "brdr", "brodrerne", "co", "dansk", "data", "development", "dk", "ejendomsselskabet", "finans", "forsikring",
    "group", "holding", "hotels", "hotel", "int", "invest", "kbh", "komplementaerssaelskabet", "livforsikringsselskab", "management", "media",
    "nordic", "nordisk", "og", "scandinavia", "scandinavian", "service", "services", "skandia", "software", "system", "systems", "ltd", "filial",
    "for",
)
#: Labels of collaborations between firms.
COLLABORATION = r"(?i)konsorti(?:et|um|e)?|consorti(?:um)?|joint[ -]?venture|(?<!\p{Alnum})j[.]?\s*v[.]?(?!\p{Alnum})|sammenslutningen(?:\s+af)?|i\s+samarbejde\s+med|sammen\s+med"

FIELDS = ("name_basic", "name_clean", "name_no_spaces", "name_broad", "firm_type", "first_letter")


def alone(pattern: str) -> str:
    """A pattern that letters and digits neither precede nor follow."""
    return rf"(?<!\p{{Alnum}}){pattern}(?!\p{{Alnum}})"


def prepared(c: Column) -> dict[str, Column]:
    """The forms of a name that are matched, from light to broad; a stated legal form apart."""
    low = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), LETTERS, F.lower(trimmed(c)))
    # the first pattern of the list that is found names the form, stripped of others or not
    form = F.coalesce(*[F.when(low.rlike(alone(p)), F.lit(t)) for p, t in LEGAL_FORMS], F.lit(NO_FORM))
    basic = squished(reduce(lambda x, p: F.regexp_replace(x, alone(p[0]), " "), LEGAL_FORMS, low))
    plain = basic
    for a, b in (("oe", "o"), ("aa", "a"), ("&", " og "), ("v/", " "), ("/", "")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    plain = F.translate(F.regexp_replace(plain, "[-()]", " "), ",.:\"'´`«»", "")
    words = F.filter(F.split(squished(plain), " "), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    mapped = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
    clean = F.nullif(F.array_join(mapped, " "), F.lit(""))
    told = F.array_sort(F.filter(mapped, lambda w: ~w.isin(*STOP_WORDS)))
    return {
        "name_basic": F.nullif(basic, F.lit("")),
        "name_clean": clean,
        "name_no_spaces": F.replace(clean, F.lit(" "), F.lit("")),
        "name_broad": F.nullif(F.array_join(told, ""), F.lit("")),
        "firm_type": F.when(c.isNotNull(), form),
        "first_letter": F.substring(clean, 1, 1),
    }


def mentions_collaboration(c: Column) -> Column:
    return F.coalesce(c.rlike(COLLABORATION), F.lit(False))


def without_collaboration(c: Column) -> Column:
    """A name without the labels of a collaboration."""
    return squished(F.regexp_replace(F.regexp_replace(c, COLLABORATION, ""), "[;:()]+", " "))


def likeness(a: Column, b: Column) -> Column:
    """100 (la + lb - d) / (la + lb), with the Levenshtein distance d; null for two empty names."""
    total = F.length(a) + F.length(b)
    return F.when(total > 0, 100.0 * (total - F.levenshtein(a, b)) / total)
