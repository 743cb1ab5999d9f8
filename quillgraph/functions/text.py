"""Text rules as column expressions. Classes are Unicode's, as (?U) asks Java for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that a name loses, foreign forms and place words that mark an entity of its own.
LEGAL = r"(?iU)\b(?:inc|incorporated|corp|corporation|co|company|llc|l\.l\.c|ltd|limited|plc|nv|n\.v|sa|s\.a|ag|gmbh|holdings?|the)\b"
FOREIGN_FORMS = [
    "oy", "oyj", "ab", "as", "aps", "sas", "spa", "srl", "sarl", "pte", "sdn", "bhd", "kk", "gk", "kft", "doo", "bv", "ug", "kg", "cv", "lda", "ltda", "pty",
    "pt", "zoo", "sro", "sl", "unipersonal",
]
PLACE_STOPWORDS = [
    "the", "of", "and", "new", "north", "south", "east", "west", "central",
]
PLACES = [
    "america", "american", "argentina", "asia", "australia", "austria", "belgium", "bermuda", "brasil", "brazil", "britain", "canada", "cayman", "chengdu",
    "chile", "china", "colombia", "czech", "denmark", "deutschland", "dublin", "egypt", "emea", "england", "europe", "european", "finland", "france", "french",
    "german", "germany", "greece", "holland", "hongkong", "hungary", "iberia", "india", "indonesia", "ireland", "israel", "italia", "italy", "japan", "kong",
    "korea", "luxembourg", "malaysia", "malta", "mexico", "nederland", "netherlands", "nordic", "norway", "pacific", "philippines", "poland", "portugal",
    "prc", "romania", "russia", "scotland", "shanghai", "shenzhen", "singapore", "slovakia", "slovenia", "spain", "suisse", "sweden", "swiss", "switzerland",
    "taiwan", "thailand", "turkey", "uk", "ukraine", "vietnam", "wales",
]
# Numbers in words, what states board service, and the page furniture that is taken out.
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty",
]
BOARD = (
    r"(?i)(?:serve[sd]?|has served|currently serves)[^.]{0,60}(?:on the board|as a director|as director|board of directors)"
    r"|\bdirector of\b|\bboard member of\b|\bboards? of\b|director nominee|election of directors|continuing directors"
)
# Page furniture, runs of blanks, runs of empty lines.
FURNITURE, BLANKS, GAPS = "\n?Table of Contents\n?", "[ \t]+", "\n{3,}"

# Fixed value: two to seven capitalised words, then the short form in brackets, with or without quotes.
ALIAS = r"(?U)([A-Z][\w&.,'\-]*(?:\s+[A-Z][\w&.,'\-]*){1,6})\s*\(\s*[“\"]?([A-Z][A-Za-z]{1,14})[”\"]?\s*\)"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), r"(?U)^\s+|\s+$", "")


#: Lower-case letters that case folding turns into another letter, by the rule that the interpreter has: final sigma, long s, micro and the like.
_OTHER = [c for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) <= 0xDFFF and c.lower() == c != c.casefold() and len(c.casefold()) == 1]
#: Letters that it turns into several: sharp s and the ligatures.
_SEVERAL = "ßﬀﬁﬂﬃﬄﬅﬆ"


def fold(x: Column | str) -> Column:
    """Lower case as case folding has it, so that all spellings of a word agree.

    Of letters that fold to several, sharp s and ligatures do; Greek letters with marks below, and a dozen more, stay as lower case has them.
    """
    low = F.lower(_col(x))
    plain = F.translate(low, "".join(_OTHER), "".join(c.casefold() for c in _OTHER))
    for c in _SEVERAL:
        plain = F.replace(plain, F.lit(c), F.lit(c.casefold()))
    return F.when(low.rlike(r"[^\x00-\x7F]"), plain).otherwise(low)  # a class of all those letters takes far longer than to replace them


def clean(x: Column | str) -> Column:
    """Page furniture out, runs of blanks and of empty lines squeezed, ends stripped; null as empty."""
    x = F.regexp_replace(F.coalesce(_col(x), F.lit("")), FURNITURE, "\n")
    return strip(F.regexp_replace(F.regexp_replace(x, BLANKS, " "), GAPS, "\n\n"))


def squash(x: Column | str) -> Column:
    """White space collapsed and case folded, for comparing quotations."""
    return fold(strip(F.regexp_replace(_col(x), r"(?U)\s+", " ")))


def normalize(x: Column | str) -> Column:
    """A name without state suffix, punctuation, legal forms and single letters at its end."""
    x = F.regexp_replace(_col(x), r"(?U)\s*/[A-Za-z]{2}$", "")
    x = fold(F.replace(x, F.lit("&"), F.lit(" and ")))
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w\s]", " "), LEGAL, " ")
    x = strip(F.regexp_replace(x, r"(?U)\s+", " "))
    return F.regexp_replace(x, r"(?: \S)+$", "")


def tokens(norm: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(_col(norm), " "), lambda t: t != ""))


def _initials(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")).otherwise("")


def acronym(norm: Column | str) -> Column:
    return _initials(F.filter(F.split(_col(norm), " "), lambda t: t != ""))


def raw_acronym(surface: Column | str) -> Column:
    """Initials before legal forms are taken away."""
    plain = F.regexp_replace(fold(surface), r"(?U)[^\w\s]", " ")
    return _initials(F.filter(F.split(plain, r"(?U)\s+"), lambda t: t != ""))


def jaccard(a: Column | str, b: Column | str) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)


def blocking_keys(norm: Column | str, surface: Column | str) -> Column:
    """Buckets in which a name may find its like."""
    norm, surface = _col(norm), _col(surface)
    initials, raw = acronym(norm), raw_acronym(surface)
    short = ~norm.contains(" ") & F.length(norm).between(2, 6) & (surface == F.upper(surface)) & (surface != F.lower(surface))
    keys = F.array(
        F.concat(F.lit("exact:"), norm),
        F.concat(F.lit("pre:"), F.substring(norm, 1, 4)),
        F.when(initials != "", F.concat(F.lit("acr:"), initials)),
        F.when(raw != "", F.concat(F.lit("acr:"), raw)),
        F.when(short, F.concat(F.lit("acr:"), norm)),
    )
    return F.array_distinct(F.array_compact(keys))


def digit_density(x: Column | str) -> Column:
    x = _col(x)
    return F.length(F.regexp_replace(x, r"(?U)\D", "")) / F.greatest(F.length(F.regexp_replace(x, r"(?U)\s", "")), F.lit(1))


def stated_numbers(x: Column | str) -> Column:
    """Distinct integers that a text states, in digits or in words up to twenty, ascending."""
    x = _col(x)
    digits = F.transform(F.regexp_extract_all(x, F.lit(r"\b\d[\d,]*\b"), F.lit(0)), lambda d: F.replace(d, F.lit(","), F.lit("")).try_cast("long"))
    known = F.create_map(*[v for n, w in enumerate(NUMBER_WORDS) for v in (F.lit(w), F.lit(n).cast("long"))])
    words = F.transform(F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0)), lambda w: w.isin(*NUMBER_WORDS)), lambda w: F.try_element_at(known, w))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(digits, words))))


def names_it(x: Column | str, forms: Column | str) -> Column:
    """Whether a text holds any of the normalised forms as whole neighbouring tokens."""
    padded = F.concat(F.lit(" "), normalize(x), F.lit(" "))
    return F.exists(_col(forms), lambda f: (f != "") & F.contains(padded, F.concat(F.lit(" "), f, F.lit(" "))))


def plural(x: Column | str) -> Column:
    x = _col(x)
    return F.when(x.endswith("y"), F.regexp_replace(x, "y$", "ies")).otherwise(F.concat(x, F.lit("s")))


def fill(template: str, **values: Column) -> Column:
    """A template with its {names} replaced."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), F.lit(template))


def digest(*parts: Column | str, size: int = 16) -> Column:
    """The first hex digits of SHA-256 over the parts, joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, size)


def bare_citation(x: Column | str) -> Column:
    """An id without the white space and brackets around it."""
    return strip(F.regexp_replace(strip(x), r"^[\[\]]+|[\[\]]+$", ""))


def iso_utc(ts: Column | str) -> Column:
    """A time as ISO 8601 in UTC, to the second; sessions run in UTC."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def as_date(x: Column | str) -> Column:
    """The date that a text begins with; null for none."""
    return F.try_to_date(F.substring(_col(x), 1, 10), "yyyy-MM-dd")


def query_words(x: Column | str) -> Column:
    """Characters with a meaning in a search syntax as spaces."""
    return F.regexp_replace(_col(x), r'[+\-&|!(){}\[\]^"~*?:\\/]', " ")


def alias_pairs(x: Column | str) -> Column:
    """Array of (long, short) names that a text declares."""
    return F.arrays_zip(F.regexp_extract_all(_col(x), F.lit(ALIAS), F.lit(1)).alias("long"), F.regexp_extract_all(_col(x), F.lit(ALIAS), F.lit(2)).alias("short"))


def declares(long: Column | str, short: Column | str) -> Column:
    """Whether a short form belongs to the long one: one of its words, or its initials."""
    low, norm = normalize(short), normalize(long)
    return (low != "") & (F.array_contains(tokens(norm), low) | (low == raw_acronym(long)) | (low == acronym(norm)))
