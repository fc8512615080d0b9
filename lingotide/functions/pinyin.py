"""Pinyin expressions: base form, tone, initial and final, tone marks, and splitting of unspaced text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marked vowels by plain vowel, tones 1..4 in order.
TONE_MARKS = {"a": "āáǎà", "e": "ēéěè", "i": "īíǐì", "o": "ōóǒò", "u": "ūúǔù", "ü": "ǖǘǚǜ"}
MARKED = "".join(TONE_MARKS.values())
PLAIN = "".join(vowel * 4 for vowel in TONE_MARKS)
TONES = "1234" * len(TONE_MARKS)

# Initials, the two-letter ones first.
DIGRAPH_INITIALS = "zh|ch|sh"
LETTER_INITIALS = "bpmfdtnlgkhjqxzcsryw"


def _last(text: Column) -> Column:
    return F.substring(text, -1, 1)


def _without_last(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - 1)


def _last_mark(low: Column) -> Column:
    """The last marked vowel, or ''."""
    return F.regexp_extract(low, f"(?s)^.*([{MARKED}])", 1)


def base_pinyin(syllable: Column, variant: str = "plain") -> Column:
    """Lower case without tone mark.

    ``plain`` also drops one trailing digit and keeps ü; ``corpus`` writes v as ü; ``vocab`` writes ü and v
    as u and keeps digits.
    """
    bare = F.translate(F.lower(syllable), MARKED, PLAIN)
    if variant == "vocab":
        return F.translate(bare, "üv", "uu")
    if variant == "corpus":
        bare = F.translate(bare, "v", "ü")
    return F.when(_last(bare).between("0", "9"), _without_last(bare)).otherwise(bare)


def tone_of(syllable: Column, which: str = "last") -> Column:
    """Tone number.

    ``last``: the last marked vowel, else a trailing digit 0..4, else 0. ``first``: the first marked vowel, else 0.
    """
    if which == "first":
        mark = F.regexp_extract(syllable, f"([{MARKED}])", 1)
        return F.when(mark != "", F.translate(mark, MARKED, TONES).cast("int")).otherwise(0)
    low = F.lower(syllable)
    mark = _last_mark(low)
    return (
        F.when(mark != "", F.translate(mark, MARKED, TONES).cast("int"))
        .when(_last(low).between("0", "4"), _last(low).cast("int"))
        .otherwise(0)
    )


def _initial(base: Column) -> Column:
    two, one = F.substring(base, 1, 2), F.substring(base, 1, 1)
    found = F.when(two.isin(DIGRAPH_INITIALS.split("|")), two).when(one.isin(list(LETTER_INITIALS)), one)
    return found.when(base.isNotNull(), "")


def initial_final(base: Column) -> Column:
    """struct(initial, final) of a base form; the initial may be empty."""
    initial = _initial(base)
    final = F.substring(base, F.length(initial) + 1, F.length(base))
    return F.struct(initial.alias("initial"), final.alias("final"))


def parse_syllable(syllable: Column) -> Column:
    """struct(initial, final, tone); a tone digit is dropped only where it gave the tone."""
    low = F.lower(syllable)
    plain = F.translate(low, MARKED, PLAIN)
    gave_tone = (_last_mark(low) == "") & _last(low).between("0", "4")
    parts = initial_final(F.when(gave_tone, _without_last(plain)).otherwise(plain))
    return F.struct(parts["initial"].alias("initial"), parts["final"].alias("final"), tone_of(syllable).alias("tone"))


def with_parsed(df: DataFrame, pinyin: str) -> DataFrame:
    """Add base, initial, final and tone of a syllable column, as :func:`base_pinyin` and :func:`parse_syllable` give them.

    What several of them need is a column of its own, worked out once, and the last mark is sought only where there is one.
    """
    low, plain, mark, stem = (F.col(f"_{c}") for c in ("low", "plain", "mark", "stem"))
    out = df.withColumn("_low", F.lower(pinyin)).withColumn("_plain", F.translate("_low", MARKED, PLAIN))
    out = out.withColumn("_mark", F.when(plain != low, F.translate(_last_mark(low), MARKED, TONES).cast("int")))
    given = mark.isNull() & _last(low).between("0", "4")
    out = out.withColumn("_stem", F.when(given, _without_last(plain)).otherwise(plain))
    out = out.withColumn("initial", _initial(stem))
    return out.select(
        *df.columns,
        F.when(_last(plain).between("0", "9"), _without_last(plain)).otherwise(plain).alias("base"),
        "initial",
        F.substring(stem, F.length("initial") + 1, F.length(stem)).alias("final"),
        F.coalesce(mark, F.when(given, _last(low).cast("int")), F.lit(0)).alias("tone"),
    )


def parse_numbered(pinyin: Column) -> Column:
    """array<struct(base, tone)> of space-separated numbered pinyin; tone 5 and above become 0."""

    def token(t: Column) -> Column:
        well_formed = t.rlike("^[a-zA-ZüÜ]+[0-9]?$")
        digit = F.regexp_extract(t, "([0-4])$", 1)
        return F.struct(
            F.when(well_formed, F.lower(F.regexp_replace(t, "[0-9]$", ""))).otherwise(F.lower(t)).alias("base"),
            F.when(well_formed & (digit != ""), digit.cast("int")).otherwise(0).alias("tone"),
        )

    tokens = F.filter(F.split(F.trim(pinyin), "\\s+"), lambda t: t != "")
    return F.transform(tokens, token)


def add_tone_mark(pinyin: Column, tone: Column) -> Column:
    """Put the tone mark on the first a or e, else on the o of ou, else on the last vowel."""
    low = F.lower(pinyin)
    open_vowel = F.regexp_instr(low, F.lit("[ae]"))
    last_vowel = F.when(low.rlike("[iouü]"), F.length(F.regexp_extract(low, "^(.*[iouü])", 1))).otherwise(0)
    at = F.when(open_vowel > 0, open_vowel).when(F.contains(low, F.lit("ou")), F.instr(low, "o")).otherwise(last_vowel)
    vowel = F.substring(low, at, F.lit(1))
    rows = [F.translate(vowel, "".join(TONE_MARKS), "".join(m[k] for m in TONE_MARKS.values())) for k in range(4)]
    marked = F.when(tone == 1, rows[0]).when(tone == 2, rows[1]).when(tone == 3, rows[2]).otherwise(rows[3])
    done = F.concat(F.substring(pinyin, F.lit(1), at - 1), marked, F.substring(pinyin, at + 1, F.length(pinyin)))
    return F.when(tone.between(1, 4) & (at > 0), done).otherwise(pinyin)


_VOWELS = "aeiouüAEIOUÜ"
_ANY_VOWEL = _VOWELS + MARKED + MARKED.upper()
# one marked vowel, the plain vowels after it, and a closing ng, n or r that no vowel follows
_MARKED_SYLLABLE = (
    f"[^{MARKED}]*[{MARKED}][{_VOWELS}]*(?:[nN][gG](?![{_ANY_VOWEL}])|[nN](?![gG{_ANY_VOWEL}])|[rR](?![{_ANY_VOWEL}]))?"
)
# an initial inside a word: two letters anywhere, one letter after a vowel or n or g
_INITIAL = f"[zcsZCS][hH]|(?<=[{_ANY_VOWEL}nNgG])[{LETTER_INITIALS}{LETTER_INITIALS.upper()}]"
_INITIAL_SYLLABLE = f"(?s)(?:\\A.|{_INITIAL})(?:(?!{_INITIAL}).)*"


def _marks(text: Column) -> Column:
    """Number of marked vowels."""
    return F.regexp_count(text, F.lit(f"[{MARKED}]"))


def _even_pieces(text: Column, n: Column) -> Column:
    """n pieces of equal length, the last one taking what is left."""
    width = F.greatest(F.lit(1), F.floor(F.length(text) / n).cast("int"))
    heads = F.slice(F.regexp_extract_all(text, F.concat(F.lit("(?s).{"), width.cast("string"), F.lit("}")), F.lit(0)), F.lit(1), n - 1)
    missing = F.array_repeat(F.lit(""), n - 1 - F.least(n - 1, F.floor(F.length(text) / width).cast("int")))
    return F.concat(heads, missing, F.array(F.substring(text, (n - 1) * width + 1, F.length(text))))


def _marked_pieces(text: Column, n: Column) -> Column:
    """A piece for each of n tone marks, the last one taking what is left."""
    heads = F.slice(F.regexp_extract_all(text, F.lit(_MARKED_SYLLABLE), F.lit(0)), F.lit(1), n - 1)
    return F.concat(heads, F.array(F.substring(text, F.length(F.array_join(heads, "")) + 1, F.length(text))))


def _initial_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_INITIAL_SYLLABLE), F.lit(0))


def _cut_token(token: Column, n: Column) -> Column:
    by_initial = _initial_pieces(token)
    cut = F.when(_marks(token) == n, _marked_pieces(token, n)).when(F.size(by_initial) == n, by_initial)
    return F.when(n == 1, F.array(token)).otherwise(F.coalesce(cut, _even_pieces(token, n)))


def split_unspaced(df: DataFrame, romanization: str, tokens: str, n: str, name: str) -> DataFrame:
    """Add ``name``: a romanization cut into n syllables by tone marks, by initials, token by token, or evenly.

    ``tokens`` are its parts between white space. With fewer tokens than syllables, every token gets as many as it has tone marks, at least one
    and at most what the tokens after it leave; a token that neither marks nor initials cut into its share is cut evenly.
    Every cut is a column of its own, worked out only for rows that no earlier one has settled, in one pass over the text.
    """
    count = F.col(n)
    text, marked, initial, dealt = (F.col(f"_{name}_{c}") for c in ("text", "marked", "initial", "dealt"))
    unsettled = (F.size(tokens) != count) & (count > 1)
    out = df.withColumn(f"_{name}_text", F.when(F.size(tokens) != count, F.translate(romanization, " ", "")))
    out = out.withColumn(f"_{name}_marked", F.when(unsettled & (_marks(text) == count), _marked_pieces(text, count)))
    out = out.withColumn(f"_{name}_initial", F.when(unsettled & marked.isNull(), _initial_pieces(text)))
    # the later tokens keep one syllable each; n is not reduced as syllables are dealt
    start = F.struct(F.lit(0).alias("placed"), F.array().cast("array<int>").alias("shares"))

    def deal(acc: Column, token: Column) -> Column:
        share = F.greatest(F.lit(1), F.least(_marks(token), count - F.size(tokens) + acc["placed"] + 1))
        return F.struct((acc["placed"] + share).alias("placed"), F.concat(acc["shares"], F.array(share)).alias("shares"))

    few = unsettled & (F.size(tokens) < count) & marked.isNull() & (F.size(initial) != count)
    out = out.withColumn(f"_{name}_dealt", F.when(few, F.aggregate(tokens, start, deal)))
    whole = (
        F.when(F.size(tokens) == count, F.col(tokens))
        .when((text == "") | (count == 0), F.array().cast("array<string>"))
        .when(count == 1, F.array(text))
        .when(marked.isNotNull(), marked)
        .when(F.size(initial) == count, initial)
        .when(dealt["placed"] == count, F.flatten(F.zip_with(tokens, dealt["shares"], _cut_token)))
        .otherwise(_even_pieces(text, count))
    )
    return out.withColumn(name, whole).drop(*(f"_{name}_{c}" for c in ("text", "marked", "initial", "dealt")))
