"""Merkle fingerprints of sentence texts: paragraphs under sections under one root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingotide.llm.common import whole
from lingotide.operators.blocks import number_sorted
from lingotide.session import staged

# Fixed by this format: a section is a run of lines that ends with line breaks, a paragraph a run within it that ends
# with sentence marks or bars. Every character belongs to exactly one of them.
SECTION = r"[^\n]+\n*|\n+"
PARAGRAPH = r"[^.!?|\n]+[.!?|\n\x20]*|[.!?|\n\x20]+"
# hexadecimal digits of a paragraph's hash that the fingerprint keeps
DIGITS = 8
# texts of neighbouring ids are brought together in stretches of so many ids
STRETCH = 1 << 8


def fingerprint(text: Column) -> Column:
    """``root:p.p.p/p.p/...``: the root hash, then the paragraphs' short hashes, sections parted by slashes.

    A section's hash covers its paragraphs' full hashes in order and the root covers the sections', so equal roots
    mean equal texts. An empty text has a root and no paragraphs.
    """
    leaves = F.transform(
        F.regexp_extract_all(text, F.lit(SECTION), 0),
        lambda s: F.transform(F.regexp_extract_all(s, F.lit(PARAGRAPH), 0), lambda p: F.sha2(p, 256)),
    )
    # the leaves are worked out once and bound as a variable
    return F.transform(F.array(leaves), _rendered)[0]


def _rendered(leaves: Column) -> Column:
    sections = F.transform(leaves, lambda s: F.sha2(F.array_join(s, ""), 256))
    short = F.transform(leaves, lambda s: F.array_join(F.transform(s, lambda p: F.substring(p, 1, DIGITS)), "."))
    return F.concat(F.sha2(F.array_join(sections, ""), 256), F.lit(":"), F.array_join(short, "/"))


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two fingerprints' distinct paragraphs, 2 |A and B| / (|A| + |B|); equal roots give 1.

    Null fingerprints have likeness 0 to anything.
    """
    sets = F.array(F.struct(F.array_distinct(paragraphs(a)).alias("a"), F.array_distinct(paragraphs(b)).alias("b")))

    def share(s: Column) -> Column:
        of = F.size(s["a"]) + F.size(s["b"])
        return F.when(of == 0, 0.0).otherwise(F.size(F.array_intersect(s["a"], s["b"])) * 2.0 / of)

    same = F.substring(a, 1, 64) == F.substring(b, 1, 64)
    return F.when(a.isNull() | b.isNull(), 0.0).when(same, 1.0).otherwise(F.transform(sets, share)[0])


def paragraphs(mark: Column) -> Column:
    """The paragraphs' short hashes in order."""
    return F.filter(F.split(F.substring(mark, 66, 2147483647), "[./]"), lambda p: p != "")


def differing_sections(a: Column, b: Column) -> Column:
    """Positions (from 0) of the sections of ``a`` whose branch does not occur in ``b``: where an edit lies.

    Equal roots give none without comparing branches.
    """
    one, other = (F.split(F.substring(m, 66, 2147483647), "/") for m in (a, b))
    marked = F.filter(F.transform(one, lambda s, i: F.when(F.array_contains(other, s), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.array().cast("array<int>")).otherwise(marked)


def fingerprint_texts(texts: DataFrame) -> DataFrame:
    """Fingerprints of sentence texts (id, text): id, n_chars, fingerprint.

    Null counts as empty; every row gets its own, so repeated rows repeat; other columns are left out.
    """
    text = whole("text")
    return texts.select("id", F.length(text).cast("long").alias("n_chars"), fingerprint(text).alias("fingerprint"))


def with_next(texts: DataFrame, carried: list[str]) -> DataFrame:
    """Rows of (id, *carried) with ``next``, a struct of the next id's carried columns; after the last id comes the first.

    Rows move once, keyed by stretches of ids. A stretch sees past its end through a copy of the first row of the
    stretch that follows; which one that is comes from the ids alone. Repeated ids follow each other in the order of
    their carried columns. Rows without id have no next (null) and do not move.
    """
    stretch = F.floor(F.col("id") / F.lit(STRETCH))
    known = texts.filter("id IS NOT NULL").select("id", *carried)
    firsts = known.groupBy(stretch.alias("stretch")).agg(F.min("id").alias("first"))
    numbered = staged(number_sorted(firsts, ["stretch"], "no"), "stretches")
    last = numbered.agg(F.max("stretch")).first()[0]
    # the first row of a stretch is copied to the stretch before, that of all to the last one
    earlier = numbered.select((F.col("no") + 1).alias("no"), F.col("stretch").alias("to"))
    homes = numbered.join(earlier, "no", "left").select(F.col("first").alias("id"), F.coalesce("to", F.lit(last)).alias("to"))
    # a written table's size is known, so a small one does not make the texts move for this join
    homes = staged(homes, "stretch-homes")
    own = F.struct(stretch.alias("stretch"), F.lit(0).alias("late"))
    copy = F.struct(F.col("to").alias("stretch"), F.lit(1).alias("late"))
    placed = (
        known.join(homes, "id", "left")
        .withColumn("_place", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
        .select("id", *carried, "_place.*")
    )
    w = Window.partitionBy("stretch").orderBy("late", "id", *carried)
    linked = placed.withColumn("next", F.lead(F.struct(*carried)).over(w)).filter("late = 0").select("id", *carried, "next")
    lone = texts.filter("id IS NULL").select("id", *carried, F.lit(None).cast(linked.schema["next"].dataType).alias("next"))
    return linked.unionByName(lone)


def compare_edits(texts: DataFrame) -> DataFrame:
    """Fingerprint each sentence text (id, text), its edited text and the next one, and compare them.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next text (by
    id; all, if it has fewer). Returns id, n_chars, edited (the text), fingerprint, edited_fingerprint, near_edited,
    near_next and edited_sections (where the edit lies).

    Null texts count as empty; a text without paragraphs is like only its equals. Rows without id meet no next text:
    their edited text is what stays of the first half, and near_next is 0. An empty table gives an empty result.
    """
    marked = texts.select("id", whole("text").alias("text")).withColumn("mark", fingerprint(F.col("text")))
    linked = with_next(marked, ["text", "mark"])
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - cut), F.substring(whole(F.col("next.text")), F.lit(1), cut)
    )
    edits = linked.select(
        "id", n.cast("long").alias("n_chars"), "mark", F.col("next.mark").alias("next_mark"), edited.alias("edited")
    )
    both = edits.withColumn("edited_mark", fingerprint(F.col("edited")))
    return both.select(
        "id",
        "n_chars",
        "edited",
        F.col("mark").alias("fingerprint"),
        F.col("edited_mark").alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
        differing_sections(F.col("mark"), F.col("edited_mark")).alias("edited_sections"),
    )
