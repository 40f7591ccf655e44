"""Text normalisation as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from string import punctuation

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
WHITESPACE = r"(?U)[\s\x1c-\x1f]"
# Every character that counts as whitespace at the ends of a text.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Article words removed before answers are compared, by language.
ARTICLES = {
    "en": "a|an|the",
    "fr": "un|une|des|le|la|les",
    "es": "un|una|unos|unas|el|la|los|las",
    "de": "ein|eine|einen|einem|eines|einer|der|die|das|den|dem|des",
    "vi": "của|là|cái|chiếc|những",
}


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    The optimizer merges adjacent projections, which would inline a tokeniser into every lambda
    that mentions it; a lambda variable over a one-element array cannot be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_clean(text: Column) -> Column:
    """ASCII lower-casing with ASCII punctuation deleted (one pass)."""
    return F.translate(text, ASCII_UPPER + punctuation, ASCII_LOWER)


def strip_punctuation(text: Column) -> Column:
    return F.translate(text, punctuation, "")


def split_words(text: Column) -> Column:
    """Words separated by any run of Unicode whitespace; no empty words."""
    return F.filter(F.split(text, WHITESPACE + "+"), lambda w: w != "")


def squeeze(text: Column) -> Column:
    """Trim and collapse whitespace runs to one blank."""
    return F.trim(F.regexp_replace(text, WHITESPACE + "+", " "))


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(text, F.lit(SPACES))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def drop_articles(text: Column, lang: Column | str = "en") -> Column:
    """Replace whole-word articles by a blank; ``lang`` is a fixed language or a column of codes."""
    if isinstance(lang, str):
        words = ARTICLES.get(lang)
        return F.regexp_replace(text, rf"(?U)\b({words})\b", " ") if words else text
    out = text
    for code in ARTICLES:
        out = F.when(lang == code, drop_articles(text, code)).otherwise(out)
    return out


def answer_key(text: Column, lang: Column | str = "en") -> Column:
    """Comparison form of a short answer: lower, no punctuation, no articles, single blanks."""
    return squeeze(drop_articles(strip_punctuation(F.lower(text)), lang))


# The Arabic article, and the first and last character of the range that is cut into single characters.
ARABIC_ARTICLE = "ال"
HAN = "\\x{4e00}-\\x{9fa5}"
UNICODE_PUNCTUATION = r"[\p{P}$+<=>^`|~]"


def script_answer_key(text: Column, lang: Column | str) -> Column:
    """Comparison form of an answer in any language: lower, no punctuation of any script, no articles, words with single
    blanks between them. In Chinese every Han character is a word, and what lies between is split at whitespace; the
    Arabic article goes wherever it stands. Other languages and a null ``lang`` keep all words; a null text stays null."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    bare = F.regexp_replace(F.lower(text), UNICODE_PUNCTUATION, "")
    cut = (
        F.when(lang == "zh", F.regexp_replace(bare, f"([{HAN}])", " $1 "))
        .when(lang == "ar", F.regexp_replace(bare, ARABIC_ARTICLE, " "))
        .otherwise(drop_articles(bare, F.when(lang.isin("en", "es", "de", "vi"), lang)))
    )
    return squeeze(cut)


def word_count(text: Column) -> Column:
    """Pieces of a split on whitespace runs, edge blanks counted (the perplexity denominator)."""
    return F.size(F.split(text, WHITESPACE + "+", -1)).cast("long")


def byte_count(text: Column) -> Column:
    return F.octet_length(text).cast("long")


# Ordered clean-up steps of the tokenised Wikipedia text.
WIKITEXT_STEPS = [
    ("lit", "s '", "s'"),
    ("re", r"/' [0-9]/", r"/'[0-9]/"),
    ("lit", " @-@ ", "-"),
    ("lit", " @,@ ", ","),
    ("lit", " @.@ ", "."),
    ("lit", " : ", ": "),
    ("lit", " ; ", "; "),
    ("lit", " . ", ". "),
    ("lit", " ! ", "! "),
    ("lit", " ? ", "? "),
    ("lit", " , ", ", "),
    ("re", r"\(\s*([^\)]*?)\s*\)", "($1)"),
    ("re", r"\[\s*([^\]]*?)\s*\]", "[$1]"),
    ("re", r"\{\s*([^\}]*?)\s*\}", "{$1}"),
    ("re", r'"\s*([^"]*?)\s*"', '"$1"'),
    ("re", r"'\s*([^']*?)\s*'", "'$1'"),
    ("lit", "= = = =", "===="),
    ("lit", "= = =", "==="),
    ("lit", "= =", "=="),
    ("lit", " ° ", "°"),
    ("lit", " \n", "\n"),
    ("lit", "\n ", "\n"),
    ("lit", " N ", " 1 "),
    ("lit", " 's", "'s"),
]

# Ordered clean-up steps of generally tokenised text.
GENERAL_STEPS = [
    ("lit", " n't", "n't"),
    ("lit", " )", ")"),
    ("lit", "( ", "("),
    ("lit", '" ', '"'),
    ("lit", ' "', '"'),
    ("re", r" (['.,])", "$1"),
]


def apply_steps(text: Column, steps: list[tuple[str, str, str]]) -> Column:
    """Apply literal (``lit``) and regular-expression (``re``) replacements in order."""
    for kind, old, new in steps:
        text = F.replace(text, F.lit(old), F.lit(new)) if kind == "lit" else F.regexp_replace(text, "(?U)" + old, new)
    return text


def detokenize_wikitext(text: Column) -> Column:
    return apply_steps(text, WIKITEXT_STEPS)


def detokenize(text: Column) -> Column:
    return apply_steps(text, GENERAL_STEPS)


def clean_markup(text: Column) -> Column:
    """`` [title]`` becomes a sentence end, other bracketed marks go, double blanks become one."""
    text = F.replace(strip(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(text, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def preview(text: Column, maximum: int) -> Column:
    """A long text as its two ends around a note of how much was left out; short texts unchanged."""
    edge = (maximum - 100) // 2
    text = F.coalesce(text, F.lit(""))
    note = F.concat(
        F.lit("\n\n[… "), F.format_number(F.length(text) - 2 * edge, 0), F.lit(" characters omitted; see full JSONL …]\n\n")
    )
    return F.when(F.length(text) <= maximum, text).otherwise(
        F.concat(F.substring(text, 1, edge), note, F.right(text, F.lit(edge)))
    )


def fixed(x: Column, digits: int) -> Column:
    """``%.{digits}f`` of the exact binary value, as C has it; an exact tie goes to the even digit, null stays null.

    The format of the JVM rounds the shortest decimal text half up, so 0.01875, which lies above its tie or below, always
    went up. Here twice the scaled value is compared with an odd number without an error: ``x`` is split into 26 bits and
    the rest, whose products are exact.
    """
    unit = 10**digits
    size = F.abs(x)
    high = size * 134217729.0 - (size * 134217729.0 - size)
    below = F.floor(size * float(unit))
    beyond = (high * (2.0 * unit) - (2 * below + 1)) + (size - high) * (2.0 * unit)
    up = (beyond > 0) | ((beyond == 0) & (below % 2 == 1))
    near = F.format_string(f"%.{digits}f", (below + F.when(up, 1).otherwise(0)) / F.lit(float(unit)))
    scaled = x * float(1 << 20)
    far = F.format_string(f"%.{digits}f", F.when(scaled == F.floor(scaled), F.bround(x, digits)).otherwise(x))
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    return F.when(x.isNotNull(), F.when(size < 1e14 / unit, F.concat(sign, near)).otherwise(far))
