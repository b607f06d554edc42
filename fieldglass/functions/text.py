"""Text cleaning as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A short list of English function words (fixed values); pass another where needed.
STOPWORDS = tuple("a about all an and any are as at be been but by can do for from had has have he her his how if in into is it its no not of on or our she so than that the their them then there these they this to was we were what when which who will with you your".split())
NEGATIONS = ("not", "no", "never")
#: Named character references and their text (fixed values).
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def chained(column: Column, steps: Sequence[tuple[str, str]]) -> Column:
    for pattern, text in steps:
        column = F.regexp_replace(column, pattern, text)
    return column


def strip_html(html: Column, entities: Mapping[str, str] = ENTITIES) -> Column:
    """Text without scripts, styles, comments and tags; white space collapsed, then digits removed, ends trimmed."""
    out = chained(html, [(r"(?is)<script\b.*?</script\s*>", " "), (r"(?is)<style\b.*?</style\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " ")])
    for name, text in entities.items():
        out = F.replace(out, F.lit(name), F.lit(text))
    return F.trim(chained(out, [(r"[ \t\r\n]+", " "), ("[0-9]", "")]))


def tokens(text: Column, pattern: str = r"[ \t\r\n]+") -> Column:
    """Non-empty tokens between white space."""
    return F.filter(F.split(text, pattern), lambda t: t != "")


def alphabetic(words: Column) -> Column:
    return F.filter(words, lambda t: t.rlike("^[A-Za-z]+$"))


def without_stopwords(words: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    listed = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(words, lambda t: ~F.array_contains(listed, F.lower(t)))


def preprocess_content(text: Column, lower: bool = True, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Alphabetic tokens that aren't stop-words, joined by spaces."""
    return F.array_join(without_stopwords(alphabetic(tokens(F.lower(text) if lower else text)), stopwords), " ")


def remove_single_chars(text: Column) -> Column:
    return F.regexp_replace(text, r"\b[A-Za-z0-9_]\b\s*", "")


def without_links(text: Column) -> Column:
    """URLs and tags go; a slash between words becomes a space."""
    return chained(text, [(r"(?i)https?://\S+|www\.\S+", ""), (r"(?U)(?<=\w)/(?=\w)", " "), (r"<[^>]*>", "")])


def without_signs(text: Column) -> Column:
    """Signs go and leave no gap; numbers and single characters go; single spaces."""
    return F.trim(chained(text, [(r"[^a-zA-Z0-9\s]", ""), (r"[0-9]+", " "), (r"\b[a-zA-Z]\b", ""), (r"\s+", " ")]))


def clean_sentences(text: Column) -> Column:
    """URLs, tags, punctuation and other signs go and leave no gap; a slash between words becomes a space; numbers and single characters go; lower case."""
    return without_signs(F.lower(without_links(text)))


def clean_text(text: Column) -> Column:
    """Lower case, without digits and punctuation, single spaces."""
    return F.trim(chained(F.lower(text), [(r"[0-9]+", ""), (PUNCTUATION, ""), (r"[ \t\r\n]+", " ")]))


def handle_negations(words: Column, negations: Sequence[str] = NEGATIONS) -> Column:
    """not x -> not_x: a negation in any case goes and marks the next word, whose case stays; several in a row mark it once, one at the end goes."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("on"))

    def step(state: Column, word: Column) -> Column:
        is_negation = F.lower(word).isin(*negations)
        kept = F.concat(state["out"], F.array(F.when(state["on"], F.concat(F.lit("not_"), word)).otherwise(word)))
        return F.struct(F.when(is_negation, state["out"]).otherwise(kept).alias("out"), is_negation.alias("on"))

    return F.aggregate(words, start, step, lambda s: s["out"])


def url_host_head(url: Column) -> Column:
    """The host up to its first dot, without scheme and www."""
    return F.split(chained(url, [(r"^https?://", ""), (r"^www\.", "")]), r"\.")[0]


def url_extract(url: Column, pattern: str) -> Column:
    """The first group; null where the pattern doesn't match."""
    return F.when(url.rlike(pattern), F.regexp_extract(url, pattern, 1))


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def parse_numbers(text: Column) -> Column:
    """Numbers between white space as an array of doubles."""
    return F.transform(tokens(text), lambda t: t.try_cast("double"))


#: Steps that tidy a generated topic label (fixed values: patterns in order).
LABEL_STEPS = [(r"\d+\.\s*", ""), (r"^\s*-\s*", ""), (r":.*", ""), (r"-.*", ""), (r"(?U)\b\w\b", ""), (r"\s+", " "), (r"^ +| +$", ""), (r"[\"']", ""), (r"Explanation.*", ""), (",", ";")]


def clean_topic_label(label: Column, steps: Sequence[tuple[str, str]] = LABEL_STEPS) -> Column:
    """Numbers with a full stop, a dash in front, and all from a colon or another dash on go; also single letters and quotes."""
    return chained(label, steps)
