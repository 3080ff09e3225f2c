"""Text functions over columns, all inside the JVM.

A token is a lower-cased run of letters and digits that holds letters only (N2); a
word is a run of characters other than white space (F5); sentences end at white space
after a full stop, exclamation or question mark (F26).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pronoun categories, stop words and opposition pairs of the metrics.
PRONOUNS = {
    "first_person_singular": ("i", "me", "my", "mine", "myself"),
    "first_person_plural": ("we", "us", "our", "ours", "ourselves"),
    "second_person": ("you", "your", "yours", "yourself", "yourselves"),
    "third_person_plural": ("they", "them", "their", "theirs", "themselves"),
}
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "will", "would", "should",
    "can", "could", "this", "that", "these", "those", "it", "its", "as", "so", "not", "no", "very", "just", "also", "there", "here", "what", "which",
    "who", "whom", "when", "where", "why", "how", "all", "each", "few", "more", "most", "other", "some", "such", "than", "too", "s", "t", "now",
    *(w for words in PRONOUNS.values() for w in words),
)
OPPOSITIONS = (
    ("freedom", "tyranny"), ("strength", "weakness"), ("winning", "losing"), ("truth", "lies"), ("safe", "dangerous"), ("prosperity", "decline"),
    ("hope", "fear"), ("unity", "division"), ("greatness", "failure"), ("peace", "war"), ("patriots", "radicals"), ("jobs", "unemployment"),
)
# Patterns of posts and their parts, the own handle.
URL, MENTION, HASHTAG = r"https?://\S+", r"@\w+", r"#\w+"
REPOST = r'^["“]?(RT\s+)?@\w+[:\-]?\s*'
PERMALINK = r"(?i)truthsocial\.com/@([\w.]+)/posts/"
OWN_HANDLE = "realdonaldtrump"
#: A run of letters that no letter or digit stands beside; the run is taken whole, so that what follows is looked at once.
TOKEN = r"(?<![\p{L}\p{N}])\p{L}++(?!\p{N})"
TITLE_SEPARATOR = r"\s+[|\-—·•]\s+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-case alphabetic tokens in text order; null text gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def sentences(text: Column | str) -> Column:
    """Sentences in text order, blank ones dropped; null text gives an empty array."""
    parts = F.split(F.trim(F.coalesce(_col(text), F.lit(""))), r"(?<=[.!?])\s+")
    return F.filter(parts, lambda s: F.trim(s) != "")


def word_count(text: Column | str) -> Column:
    """Number of white-space separated words (Unicode white space), null for null or empty text."""
    t = _col(text)
    return F.when(t != "", F.regexp_count(t, F.lit(r"(?U)\S+")))


def count_of(text: Column | str, literal: str) -> Column:
    """How often a literal string occurs."""
    t = F.coalesce(_col(text), F.lit(""))
    return ((F.length(t) - F.length(F.replace(t, F.lit(literal), F.lit("")))) / F.lit(len(literal))).cast("long")


def average_word_length(words: Column) -> Column:
    """Mean length of an array of words, two decimals, 0 when empty."""
    total = F.length(F.array_join(words, ""))
    return F.when(F.size(words) > 0, F.round(total / F.size(words), 2)).otherwise(F.lit(0.0))


def in_words(word: Column, words: tuple[str, ...]) -> Column:
    """Membership in a fixed word list."""
    return word.isin(*words)


def count_in(words: Column | str, chosen: tuple[str, ...]) -> Column:
    """How many entries of an array of words are among ``chosen``."""
    return F.size(F.filter(_col(words), lambda w: w.isin(*chosen)))


def clean_post(text: Column | str) -> Column:
    """URLs, then @mentions, then #hashtags removed, white space collapsed and trimmed."""
    t = _col(text)
    for rx in (URL, MENTION, HASHTAG):
        t = F.regexp_replace(t, rx, "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def is_repost(text: Column | str) -> Column:
    """Whether a post begins as a repost or a reply does."""
    return _col(text).rlike(REPOST)


def is_substantive(text: Column | str) -> Column:
    """Whether 3 characters or more are left without URLs."""
    return F.length(F.trim(F.regexp_replace(_col(text), URL, ""))) >= 3


def post_body(text: Column | str) -> Column:
    """What stands before "Retweets:", its line breaks collapsed (F8)."""
    return F.trim(F.regexp_replace(F.split(_col(text), "Retweets:")[0], r"\s*\n\s*", " "))


def permalink_handle(href: Column | str, own: str = OWN_HANDLE) -> Column:
    """Lower-case handle of a post's permalink; the own handle where there is none."""
    got = F.regexp_extract(F.coalesce(_col(href), F.lit("")), PERMALINK, 1)
    return F.when(got == "", F.lit(own)).otherwise(F.lower(got))


def clean_title(title: Column | str) -> Column:
    """A title without the site's name at its end, else at its start."""
    t = F.trim(F.regexp_replace(_col(title), r"\s+", " "))
    parts = F.split(t, TITLE_SEPARATOR)
    n = F.size(parts)
    short = lambda p: (F.length(p) < 20) | (F.length(p) / F.length(t) < 0.25)
    last, first = F.trim(F.element_at(parts, -1)), F.trim(parts[0])
    trimmed = F.transform(parts, lambda p: F.trim(p))  # a bare function would take the index as its second argument
    return (
        F.when((n > 1) & short(last), F.array_join(F.slice(trimmed, F.lit(1), n - 1), " - "))
        .when((n > 1) & short(first), F.array_join(F.slice(trimmed, F.lit(2), n - 1), " - "))
        .otherwise(t)
    )


def transcription_prompt(base: str, title: Column, context: Column) -> Column:
    """Base text, then title and the first 300 characters of the context where present."""
    return F.concat_ws(" ", F.lit(base), F.when(title != "", F.concat(F.lit("Title: "), title, F.lit("."))), F.when(F.trim(context) != "", F.concat(F.lit("Context: "), F.substring(F.trim(context), 1, 300))))


def first_present(*candidates: Column) -> Column:
    """The first value that is not blank, trimmed."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in candidates])
