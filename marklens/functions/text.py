"""Text expressions: cleaning, normalising and string similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lead-ins that text extractors put before the text they read.
LEAD_INS_SHORT = (
    "The text in the image reads:",
    "The text in the image is:",
)
LEAD_INS_LONG = (
    "The text in the image reads:",
    "The text in the image is:",
    "The image contains the text:",
    "I can see the text:",
    "The text shown is:",
    "Text in image:",
    "Image text:",
    "The text visible in the image is:",
    "Looking at the image, the text says:",
)
# Texts that hold nothing but quotes.
EMPTY_QUOTES = ('""', "''", '""""', "''''")
# Lower bound and wording of the text score bands.
TEXT_BANDS = (
    (90, "Very High Similarity - Texts are nearly identical"),
    (70, "High Similarity - Texts are quite similar"),
    (50, "Moderate Similarity - Some similarities found"),
    (20, "Low Similarity - Few similarities found"),
    (None, "Very Low Similarity - Texts appear different"),
)


def strip(col: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def _cut_lead_in(text: Column, lead_in: str) -> Column:
    return strip(F.substring(text, len(lead_in) + 1, 2147483647))


def _starts_with(text: Column, lead_in: str) -> Column:
    return F.startswith(F.lower(text), F.lit(lead_in.lower()))


def clean_short(col: Column) -> Column:
    """Clean extractor output: two lead-ins removed in turn, quotes alone are empty."""
    text = strip(F.coalesce(col, F.lit("")))
    text = F.when(text.isin(*EMPTY_QUOTES), F.lit("")).otherwise(text)
    for lead_in in LEAD_INS_SHORT:
        text = F.when(_starts_with(text, lead_in), _cut_lead_in(text, lead_in)).otherwise(text)
    return text


def clean_long(col: Column) -> Column:
    """Clean extractor output: the first of nine lead-ins that fits is removed."""
    text = strip(F.coalesce(col, F.lit("")))
    first, *others = LEAD_INS_LONG
    branches = F.when(_starts_with(text, first), _cut_lead_in(text, first))
    for lead_in in others:
        branches = branches.when(_starts_with(text, lead_in), _cut_lead_in(text, lead_in))
    return branches.otherwise(text)


def normalise(col: Column) -> Column:
    """Lower case, trimmed, runs of white space become one space."""
    return F.regexp_replace(strip(F.lower(F.coalesce(col, F.lit("")))), r"\s+", " ")


def words(normalised: Column) -> Column:
    """Distinct words in first-seen order of a normalised text."""
    return F.array_distinct(F.filter(F.split(normalised, " "), lambda w: w != ""))


def normalise_words(col: Column) -> Column:
    """Normalised text with repeated words dropped."""
    return F.array_join(words(normalise(col)), " ")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """``(1 - edits / longer length) * 100``; 0 when a side is empty or null."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(
        (F.length(a) > 0) & (F.length(b) > 0),
        (F.lit(1.0) - F.levenshtein(a, b) / longest) * 100,
    ).otherwise(F.lit(0.0))


def containment_similarity(a: Column, b: Column) -> Column:
    """85..100 when the shorter text lies inside the longer, else edit similarity."""
    la, lb = F.length(a), F.length(b)
    inside = F.when(la <= lb, F.contains(b, a)).otherwise(F.contains(a, b))
    score = (
        F.when((la == 0) | (lb == 0), F.lit(0.0))
        .when(inside, F.lit(85.0) + F.lit(15.0) * F.least(la, lb) / F.greatest(la, lb))
        .otherwise((F.lit(1.0) - F.levenshtein(a, b) / F.greatest(la, lb)) * 100)
    )
    return F.coalesce(score, F.lit(0.0))


def chars(word: Column) -> Column:
    """Distinct characters of a word."""
    return F.array_distinct(F.split(word, ""))


def char_overlap(a: Column, b: Column) -> Column:
    """Jaccard share of the character sets in percent; 0 when a side is empty."""
    ca, cb = chars(a), chars(b)
    return F.when(
        (F.length(a) > 0) & (F.length(b) > 0),
        F.size(F.array_intersect(ca, cb)) / F.size(F.array_union(ca, cb)) * 100,
    ).otherwise(F.lit(0.0))


def word_jaccard(words_a: Column, words_b: Column) -> Column:
    """Jaccard share of two word sets in percent; 0 when both are empty."""
    union = F.size(F.array_union(words_a, words_b))
    return F.when(
        union > 0, F.size(F.array_intersect(words_a, words_b)) / union * 100
    ).otherwise(F.lit(0.0))


def word_subset(words_a: Column, words_b: Column) -> Column:
    """True when the smaller word set lies in the other (first side on a tie)."""
    return F.when(
        F.size(words_a) <= F.size(words_b),
        F.size(F.array_except(words_a, words_b)) == 0,
    ).otherwise(F.size(F.array_except(words_b, words_a)) == 0)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    shorter = F.least(F.length(a), F.length(b))
    return F.when(
        shorter > 0,
        F.aggregate(
            F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))),
            F.lit(0),
            lambda acc, i: F.when(
                (acc == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i
            ).otherwise(acc),
        ),
    ).otherwise(F.lit(0))


def common_suffix(a: Column, b: Column) -> Column:
    """Length of the longest common suffix."""
    return common_prefix(F.reverse(a), F.reverse(b))


def text_band(score: Column) -> Column:
    """Wording of a 0..100 text score."""
    branches = None
    for bound, wording in TEXT_BANDS:
        if bound is None:
            return branches.otherwise(F.lit(wording))
        test = score >= bound
        branches = F.when(test, wording) if branches is None else branches.when(test, wording)
    return branches


def base_name(path: Column) -> Column:
    """Last part of a path with either slash."""
    return F.element_at(F.split(path, r"[/\\\\]"), -1)


def normal_path(path: Column) -> Column:
    """Fold ``//``, ``/./``, ``/..`` and a trailing slash of a path."""
    absolute = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/+"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..",
            F.when(
                (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."),
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
            )
            .when(absolute, acc)
            .otherwise(F.concat(acc, F.array(p))),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    joined = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(folded, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def proprietor_name(company: Column) -> Column:
    """Owner behind a company line of a trademark journal."""
    trading = F.regexp_extract(company, r"(?i)^(.+?)\s+TRADING AS\s+.+", 1)
    partners = F.array_join(
        F.transform(F.split(company, " AND "), lambda part: strip(part)), ", "
    )
    return (
        F.when(trading != "", strip(trading))
        .when(F.contains(F.upper(company), F.lit(" AND ")), partners)
        .otherwise(company)
    )
