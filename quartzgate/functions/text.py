"""String functions as Column expressions, with Unicode white space where Python's strip and split have it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_line(c: Column) -> Column:
    """The first line of the stripped text, stripped."""
    return strip(F.substring_index(strip(c), "\n", 1))


def subject_and_body(subject: Column, body: Column) -> Column:
    """Both stripped and joined by a line break, then stripped; null counts as empty."""
    s, b = strip(F.coalesce(subject, F.lit(""))), strip(F.coalesce(body, F.lit("")))
    return strip(F.concat(s, F.lit("\n"), b))


def words(c: Column) -> Column:
    """The runs between white space; none for a blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def tokens(c: Column) -> Column:
    """Tokens of a-z, 0-9 and the apostrophe in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9']+)"), 1)


def token_f1(predicted: Column, reference: Column) -> Column:
    """Bag-of-tokens F1 with multiset overlap; 0 without overlap."""
    p, r = tokens(predicted), tokens(reference)
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    overlap = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, x: s + F.least(count(p, x), count(r, x)))
    return F.coalesce(F.try_divide(2.0 * overlap, F.size(p) + F.size(r)), F.lit(0.0))


def without_placeholders(c: Column) -> Column:
    """{{x}} becomes x and [TYPE_1] a space; then stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\{\{([^}]*)\}\}", "$1"), r"\[[A-Z_]+_?[0-9]*\]", " "))


def group_hash(c: Column) -> Column:
    """Sixteen hexadecimal digits of the SHA-256 of the text in lower case with white space collapsed."""
    return F.substring(F.sha2(F.lower(F.regexp_replace(strip(c), r"(?U)\s+", " ")), 256), 1, 16)


def grounded(text: Column, value: Column) -> Column:
    """Whether the value stands in the text as whole words."""
    pattern = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
    return (F.length(value) > 0) & F.rlike(text, pattern)


#: Fixed values of the screen for texts without personal data: titles, gendered words.
TITLE_WORDS = "mr|mrs|ms|miss|dr|sir|madam|mister|prof"
GENDERED_WORDS = (
    "he|she|him|her|his|hers|male|female|man|woman|boy|girl|husband|wife|son|"
    "daughter|mother|father|mom|dad|brother|sister"
)


def pii_free(c: Column) -> Column:
    """Nothing in the text that a personal-data label could point at: no digit, @, {{ or <, no title or gendered
    word, and after a sentence's first word no capitalised one but I and words all in capitals."""
    marks = F.rlike(c, F.lit(r"(?U)\d|@|\{\{|<"))
    named = F.rlike(c, F.lit(rf"(?iU)\b({TITLE_WORDS})\b|\b({GENDERED_WORDS})\b"))
    sentences = F.split(strip(c), r"(?U)(?<=[.?!])\s+")
    found = lambda s: F.regexp_extract_all(s, F.lit(r"([A-Za-z][A-Za-z'\-]*)"), 1)
    capital = lambda w: F.rlike(w, F.lit("^[A-Z]")) & (w != "I") & (w != F.upper(w))
    rest = lambda ws: F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0)))
    return ~(marks | named | F.exists(sentences, lambda s: F.exists(rest(found(s)), capital)))


def first_line_matches(a: Column, b: Column) -> Column:
    return (first_line(a) == first_line(b)).cast("int")


def int8_round_trip(vector: Column) -> Column:
    """Each component after symmetric 8-bit quantisation with one scale for the vector."""
    v = F.transform(vector, lambda x: x.cast("double"))
    scale = F.aggregate(v, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x))) / 127.0
    return F.when(scale == 0, v).otherwise(
        F.transform(v, lambda x: F.least(F.lit(127.0), F.greatest(F.lit(-127.0), F.rint(x / scale))) * scale)
    )


def log_probability_summary(tokens: Column, values: Column, eos: str) -> Column:
    """The mean of the finite log-probabilities up to and with the first end token."""
    at = F.array_position(tokens, eos).cast("int")
    upto = F.when(at > 0, F.slice(values, F.lit(1), at)).otherwise(values)
    finite = F.filter(upto, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.try_divide(F.aggregate(finite, F.lit(0.0), lambda s, x: s + x), F.size(finite))


def judgment(raw: Column) -> Column:
    """The grade 1 to 5 in a JSON object's `score`: an integer, an integral number or such a string; else null."""
    value = F.get_json_object(raw, "$.score")
    whole = F.rlike(value, F.lit(r"^[1-5](\.0+)?$"))
    return F.when(whole, F.substring(value, 1, 1).cast("int"))


def is_redaction_mark(text: Column) -> Column:
    """Whether a value is nothing but a mark that stands for something removed."""
    return F.rlike(F.trim(text), F.lit(r"^(X{2,}|XX/XX/XXXX|\{\$[^}]*\})$"))


def token_probability(mean_logprob: Column) -> Column:
    return F.exp(mean_logprob)


def parsed_answer(raw: Column, vocabulary: list[str]) -> Column:
    """The answer on the first line without full stops at its ends: NONE, a word of the vocabulary, else null."""
    line = F.trim(first_line(raw), F.lit(". "))
    return F.when(F.upper(line) == "NONE", "NONE").when(F.lower(line).isin(*[v.lower() for v in vocabulary]), F.lower(line))
