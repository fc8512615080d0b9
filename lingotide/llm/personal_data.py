"""Personal data in sentence texts: expressions propose, checksums confirm, nearby words adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingotide.llm.common import packed, whole
from lingotide.llm.spans import match_spans, replaced

# The kinds' expressions. Repetitions that need not give anything back are possessive and starts are tied
# to the edge of a run, so a text takes time in proportion to its length; the matches are those of the plain forms. Account
# numbers are looked for at each start, since blanks and words in capitals may follow without belonging to them.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Characters of an account number by country, blanks not counted
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_LENGTH = "|".join(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
KNOWN_COUNTRY = "^(?:" + "|".join(" ".join(IBAN_LENGTHS.values()).split()) + ")"
# a match is the first four characters; group 1 is the number, of its country's length, or the longest run of another country
IBAN = (
    rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_BY_LENGTH}|(?!{KNOWN_COUNTRY[1:]})[A-Z]{{2}}[0-9]{{2}}"
    r"(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])))[A-Z]{2}[0-9]{2}"
)
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL = r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"

# kinds in the order that breaks ties; the first four are reported whenever their check holds
KINDS = ["email", "ip", "card", "phone", "iban", "national_id", "local_phone"]
BASE = KINDS[:4]
# score without and with words nearby; an expression alone does not reach the threshold where no checksum confirms it
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_id": 0.4, "local_phone": 0.4}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "address|server|host|login",
    "card": "card|credit|visa|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank",
    "national_id": "ssn|social|security|identity",
    "local_phone": "phone|call|tel|mobile|fax",
}
BONUS = 0.25
# so many code points on either side count as near
NEAR = 40


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    number = F.reverse(digits(value))
    places = F.sequence(F.lit(1), F.length(number))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number leaves 1 when divided by 97, letters read as 10 to 35."""
    plain = F.regexp_replace(value, "\\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def carry(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), carry) == 1


def _account(value: Column) -> Column:
    """The account number that ``value`` starts with, or null: all of it, or up to the last blank that makes it valid
    where the country's length is not known."""
    words = F.split(value, " ")
    cuts = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    longer = F.filter(cuts, lambda c: F.length(F.regexp_replace(c, " ", "")) >= 15)
    return F.get(F.filter(F.when(value.rlike(KNOWN_COUNTRY), F.array(value)).otherwise(longer), mod97), F.lit(0))


def account_spans(text: Column) -> Column:
    """Valid account numbers as ``match_spans`` gives them: each place where one may start is tried, up to the end of the last found."""
    kind = "array<struct<start:int,end:int,value:string>>"
    cut = F.transform(match_spans(text, IBAN, 1, 4), lambda s: F.struct(s["start"].alias("start"), _account(s["value"]).alias("value")))

    def step(acc: Column, s: Column) -> Column:
        hit = F.struct(s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), s["value"].alias("value"))
        after = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"] <= s["start"], F.lit(True))
        return F.when(after, F.concat(acc, F.array(hit))).otherwise(acc)

    return F.aggregate(F.filter(cut, lambda s: s["value"].isNotNull()), F.array().cast(kind), step)


def _checked(kind: str, value: Column) -> Column:
    if kind == "ip":
        # leading zeros do not count; what is still longer than three digits is over 255
        plain = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.substring(p, F.lit(1), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(value)).between(14, 19) & luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def _needed(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.lit(True))


def _found(kind: str, rank: int, text: Column, pattern: str, threshold: float) -> Column:
    """Checked and scored matches of one kind."""

    def scored(s: Column) -> Column:
        low = F.greatest(s["start"] - NEAR, F.lit(0))
        before, after = F.substring(text, low + 1, s["start"] - low), F.substring(text, s["end"] + 1, F.lit(NEAR))
        near = F.lower(F.concat(before, F.lit(" "), after)).rlike(CONTEXT[kind])
        score = F.least(F.lit(SCORES[kind]) + F.when(near, BONUS).otherwise(0.0), F.lit(1.0))
        return F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score")
        )

    sure = account_spans(text) if kind == "iban" else F.filter(match_spans(text, pattern), lambda s: _checked(kind, s["value"]))
    kept = F.transform(sure, scored)
    return kept if kind in BASE else F.filter(kept, lambda s: s["score"] >= threshold)


def personal_spans(text: Column, threshold: float = 0.6) -> Column:
    """array<struct<start, end, kind, score>> ordered by start, then kind.

    Each kind's matches are leftmost and do not overlap among themselves; matches that fail their check are dropped
    without trying a shorter one; account numbers have their country's length. Base kinds stay whatever their score, others from ``threshold`` on.
    """
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "national_id": NATIONAL, "local_phone": LOCAL}
    out = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"
    found = [
        F.when(_needed(kind, text), _found(kind, rank, text, patterns[kind], threshold)).otherwise(F.array().cast(out))
        for rank, kind in enumerate(KINDS)
    ]
    every = F.array_sort(F.concat(*found))
    return F.transform(every, lambda s: F.struct(s["start"], s["end"], s["kind"], s["score"]))


def find_personal_data(texts: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Spans of personal data in sentence texts (id, text): id, spans array<struct<start, end, kind, score>>.

    Places are code points, ends exclusive. Whole texts are searched by built-in expressions without moving a row.
    A null or empty text has no spans; repeated rows each get theirs; ids may be null; other columns are left out.
    """
    text = whole("text")
    some = text.rlike("[0-9@]")
    none = F.array().cast("array<struct<start:int,end:int,kind:string,score:double>>")
    return texts.select("id", F.when(some, personal_spans(text, threshold)).otherwise(none).alias("spans"))


def mask_personal_data(documents: DataFrame, column: str = "text", threshold: float = 0.6) -> DataFrame:
    """``documents`` with each span of ``column`` replaced by its kind, as in ``<EMAIL>``; overlapping spans become one.

    All columns keep their names and order; null texts stay null.
    """
    text = whole(column)
    spans = F.when(text.rlike("[0-9@]"), personal_spans(text, threshold)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,score:double>>"))
    rows = packed(documents, F.col(f"`{column}`").alias("_text"), spans.alias("_spans"))
    fixed = F.when(F.col("_text").isNull(), F.lit(None).cast("string")).otherwise(replaced(whole("_text"), F.col("_spans")))
    masked = rows.select("_row", fixed.alias("_fixed"))
    return masked.select(*[F.col("_fixed").alias(c) if c == column else F.col("_row")[c].alias(c) for c in documents.columns])


def joined(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans (of ``kinds``), joined by commas."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(
        F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
