"""Text normalization, edit distance and error-rate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as a regex class body (the default \s of Java is ASCII only).
WHITESPACE = "\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
# Punctuation ignored when texts are compared.
SCORING_PUNCTUATION = "。，！？、；：\"（）【】《》〈〉…—·.,!?;:'()[]<>"
# Sentence-final punctuation dropped from generated Chinese text.
TRAILING_PUNCTUATION = ".?!,;:。！？、，；：…"
# Letters that show a tone-mark romanization.
MARKED_LETTERS = "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜü"

FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
# The same white space as characters.
SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_FOLDED = {f: h for f, h in zip(FULL_WIDTH, HALF_WIDTH) if f not in SCORING_PUNCTUATION + SPACES}


def to_half_width(text: Column) -> Column:
    """Full-width ASCII and the ideographic space to their plain forms."""
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def normalize_text(text: Column) -> Column:
    """Form used for comparison: punctuation and white space removed, then half width, then lower case.

    One pass over the characters: those without a counterpart in the second list are removed.
    """
    return F.lower(F.translate(text, "".join(_FOLDED) + SCORING_PUNCTUATION + SPACES, "".join(_FOLDED.values())))


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space.

    The pattern, which looks at every blank, is left to texts with a next-line mark: white space before a final one goes as well.
    """
    by_pattern = F.regexp_replace(text, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")
    return F.when(F.contains(text, F.lit("\x85")), by_pattern).otherwise(F.btrim(text, F.lit(SPACES)))


def edit_distance(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance over characters."""
    return F.levenshtein(ref, hyp)


# token ids that lie within so many of each other are characters of the basic plane below the surrogates
_PLANE = 0xD800 - 0x100


def _characters(codes: Column) -> Column:
    """A text of one character per code of at most four hexadecimal digits; one decoding for the whole list."""
    digits = F.transform(codes, lambda c: F.lpad(F.hex(c.cast("long")), 4, "0"))
    return F.decode(F.unhex(F.array_join(digits, "")), "UTF-16BE")


def token_distance(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance over lists of integer token ids.

    Ids become characters by their distance from the smallest one, so a list is read once; ids spread over more than
    a plane of characters are numbered by the distinct ids of the pair, of which there may be 55,000.
    """
    low = F.least(F.array_min(ref), F.array_min(hyp)).cast("long")
    near = F.greatest(F.array_max(ref), F.array_max(hyp)).cast("long") - low < _PLANE
    known = F.array_distinct(F.concat(ref, hyp))
    # the smallest id is an array of its own, so that it is not looked for again at every token
    plain = [_characters(F.zip_with(t, F.array_repeat(low, F.size(t)), lambda x, least: x - least + 0x100)) for t in (ref, hyp)]
    numbered = [_characters(F.transform(t, lambda x: F.array_position(known, x) + 0xFF)) for t in (ref, hyp)]
    return F.when(F.size(ref) == 0, F.size(hyp)).when(F.size(hyp) == 0, F.size(ref)).when(
        F.coalesce(near, F.lit(False)), F.levenshtein(*plain)
    ).otherwise(F.levenshtein(*numbered))


def error_rate(distance: Column, ref: Column, hyp: Column) -> Column:
    """Distance per reference character; an empty reference gives 0 or 1."""
    return F.when(F.length(ref) > 0, distance / F.length(ref)).when(F.length(hyp) == 0, 0.0).otherwise(1.0)


def error_score(cer: Column) -> Column:
    """0..100 score from an error rate."""
    return F.when(cer >= 1.0, 0).otherwise(F.round((F.lit(1.0) - cer) * 100)).cast("int")


def completeness(distance: Column, ref: Column, hyp: Column) -> Column:
    """0..100 share of the reference that was covered, counting surplus characters as insertions."""
    r, h = F.length(ref), F.length(hyp)
    matched = r - (distance - F.greatest(F.lit(0), h - r))
    share = F.least(F.greatest(matched / r, F.lit(0.0)), F.lit(1.0))
    return (
        F.when(r == 0, 100).when(h == 0, 0).when(matched <= 0, 0).otherwise(F.round(share * 100)).cast("int")
    )


def romanization_style(text: Column) -> Column:
    """'tone-mark', 'tone-number' or 'other'."""
    low = F.lower(text)
    return (
        F.when(low.rlike(f"[{MARKED_LETTERS}]"), "tone-mark")
        .when(low.rlike("[a-zvü]+[1-5]"), "tone-number")
        .otherwise("other")
    )


def has_numeric_pinyin(text: Column) -> Column:
    return text.rlike(f"[a-zA-Z]+[1-4](?:[{WHITESPACE}]|$|,)")


def expected_seconds(text: Column, language: Column) -> Column:
    """Seconds to allow for recording a text: 3 (Chinese) or 5 characters per second, plus 2, at least 3."""
    chinese = language.isin("zh", "cmn") | language.startswith("zh-")
    rate = F.when(chinese, 3).otherwise(5)
    return F.greatest(F.ceil(F.length(text) / rate) + 2, F.lit(3)).cast("int")


def uri_kind(uri: Column) -> Column:
    """'local', 'remote' or 'unsupported'."""
    scheme = F.regexp_extract(uri, "^([a-z]+)://", 1)
    return (
        F.when(scheme.isin("assets", "file"), "local").when(scheme.isin("http", "https"), "remote").otherwise("unsupported")
    )


def uri_to_path(uri: Column, assets_root: str) -> Column:
    """Path of a local URI, below ``assets_root`` for assets; null for anything else."""
    scheme = F.regexp_extract(uri, "^([a-z]+)://", 1)
    rest = F.regexp_extract(uri, "^[a-z]+://(.*)$", 1)
    return F.when(scheme == "assets", F.concat(F.lit(assets_root.rstrip("/") + "/"), rest)).when(scheme == "file", rest)
