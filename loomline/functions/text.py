"""Text functions: Column -> Column, all built in unless the name says otherwise."""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from loomline.functions import seeds

# What counts as an address, and the signs that go (CJK too, by their range).
URL = r"(?i)https?://[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+|[a-zA-Z0-9._-]+\.(?:com|org|net|edu|gov|io|co)\S*"
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}\x{1F926}-\x{1F937}\x{10000}-\x{10FFFF}"
    r"\x{200D}\x{2640}-\x{2642}\x{FE0F}\x{2600}-\x{2B55}\x{23CF}\x{23E9}\x{231A}\x{3030}\x{2934}\x{2935}]+"
)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def fix_mojibake(c: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), seeds.MOJIBAKE, c)


def strip_html(c: Column, decode: bool = True) -> Column:
    """Tags become spaces, common entities are decoded, white space collapses."""
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    if decode:
        c = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), ENTITIES, c)
    return F.trim(F.regexp_replace(c, r"[\s\x{00A0}]+", " "))


@F.pandas_udf(StringType())
def unescape_and_nfc(texts: pd.Series) -> pd.Series:
    """All named and numeric entities, then NFC: the two steps without a built-in, in one Arrow hop."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", html.unescape(t)))


def mask_urls(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, URL, " [URL] "))


def strip_emoji(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, EMOJI, ""))


def clean_space(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"(?m)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def normalise(c: Column, lower: bool = False, drop_special: bool = False) -> Column:
    c = F.lower(c) if lower else c
    return F.regexp_replace(c, r"[^a-zA-Z0-9\s.,?'-]", "") if drop_special else c


def correct_spelling(c: Column) -> Column:
    """A place for a corrector; like the surveyed behaviour, it changes nothing."""
    return c


#: Where the two steps without a built-in may change something: entities beyond the six, and characters that NFC composes or replaces.
RARE = (
    r"&(?:#[0-9xX]|[A-Za-z])|[\p{M}\x{0374}\x{037E}\x{0387}\x{1100}-\x{11FF}\x{1F00}-\x{1FFF}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4F}"
    r"\x{2F800}-\x{2FA1F}]"
)


def clean(c: Column) -> Column:
    """All cleaners in their fixed order, for texts without RARE characters; ``clean_rare`` is for those."""
    return _after_html(strip_html(fix_mojibake(c)))


def _after_html(c: Column) -> Column:
    return normalise(clean_space(strip_emoji(mask_urls(c))))


def is_rare(c: Column) -> Column:
    """Entities or NFC can change something."""
    return F.coalesce(fix_mojibake(c).rlike(RARE), F.lit(False))


def clean_rare(c: Column) -> Column:
    """All cleaners with every entity and NFC, by an Arrow function after the tags have gone."""
    bare = F.regexp_replace(fix_mojibake(c), r"<[^>]+>", " ")
    return _after_html(F.trim(F.regexp_replace(unescape_and_nfc(bare), r"[\s\x{00A0}]+", " ")))


def content_hash(c: Column) -> Column:
    return F.sha2(F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s+|\s+$", ""), r"\s+", " "), 256)


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")


def safe_string(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def safe_double(c: Column) -> Column:
    return c.try_cast("double")


def to_time(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy")) -> Column:
    """The first format that fits; digits alone are seconds since 1970."""
    epoch = F.when(c.rlike(r"^\d{9,11}$"), F.timestamp_seconds(c.try_cast("long")))
    return F.coalesce(epoch, *[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def tokens(c: Column, least: int = 3) -> Column:
    """Lower-case words of at least ``least`` characters that aren't stop words."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda t: (F.length(t) >= least) & ~t.isin(seeds.STOP_WORDS))


def alpha_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"\b[a-z]{3,}\b"), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Adjacent n-grams of an array of words, joined by spaces.

    The array is bound as the variable of a one-element transform: a lambda would else split the text again for each gram.
    """

    def of(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))

    return F.flatten(F.transform(F.array(words), of))


def part_of_speech(w: Column) -> Column:
    """verb, noun, adj or other, by suffix; the first rule wins."""
    ends = lambda suffixes: reduce(lambda a, b: a | b, [w.endswith(s) for s in suffixes])
    plural = w.endswith("s") & (F.length(w) > 3)
    return F.when(ends(seeds.VERB_SUFFIXES), "verb").when(ends(seeds.NOUN_SUFFIXES) | plural, "noun").when(ends(seeds.ADJECTIVE_SUFFIXES), "adj").otherwise("other")


def snippet(text: Column, term: Column, window: int = 40) -> Column:
    """The term with ``window`` characters on either side, dots where cut; the first 80 characters without it."""
    at = F.instr(F.lower(text), F.lower(term))
    start = F.greatest(at - window, F.lit(1))
    end = F.least(at + F.length(term) + window - 1, F.length(text))
    body = F.substring(text, start, end - start + 1)
    cut = F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, 80))


def phrase_regex(phrase: str) -> str:
    """A literal phrase as a regular expression, where ``.t`` stands for an optional apostrophe before t."""
    out, i = "", 0
    while i < len(phrase):
        if phrase.startswith(".t", i):
            out, i = out + "[.'’]?t", i + 2
        else:
            out, i = out + (phrase[i] if phrase[i].isalnum() or phrase[i] == " " else "\\" + phrase[i]), i + 1
    return out


def word_bounded(text: Column, word: str | Column) -> Column:
    """The first occurrence of ``word`` stands alone (no letter or digit next to it)."""
    word = F.lit(word) if isinstance(word, str) else word
    at = F.instr(text, word)
    before, after = F.substring(text, at - 1, F.lit(1)), F.substring(text, at + F.length(word), F.lit(1))
    alone = lambda c: ~c.rlike(r"^[\p{L}\p{N}]$")
    return (at > 0) & ((at == 1) | alone(before)) & alone(after)


def title_case(label: Column) -> Column:
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def language_guess(c: Column) -> Column:
    """en, de, fr or es by the share of frequent words; null under 20 characters or without any."""
    common = {"en": "the of and to is that", "de": "der die und das ist nicht", "fr": "le les des est que pour", "es": "el los que las por una"}
    words = F.split(F.lower(c), r"\s+")

    def count(vocabulary: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(vocabulary.split())))

    scored = F.array_sort(F.array(*[F.struct((-count(v)).alias("n"), F.lit(k).alias("lang")) for k, v in common.items()]))
    best = F.get(scored, F.lit(0))
    return F.when((F.length(c) >= 20) & (best["n"] < 0), best["lang"])


def keyword_share(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words]) / F.lit(float(len(words)))


def any_contains(col: str, part: str) -> Column:
    """Some value of a list column contains the text, case-blind."""
    return F.exists(col, lambda x: F.lower(x).contains(part.lower()))
