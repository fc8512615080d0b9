"""Grouping of spelling variants among the words of sentence texts by dense prefix-suffix tiling."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingotide.session import staged

# fixed by the contract: words are runs of these letters, and only A to Z are lower-cased
LETTERS = r"A-Za-zÀ-ÿ"
# a group of words that share a prefix and a suffix is refined while it holds more than so many
GROUP_WORDS = 256
# rows of a block of the code-point matrices
TILE = 32
# letters of the words whose tiles meet in one task, on average
BUCKET_LETTERS = 1 << 18
# code points compared at once in a task
COMPARED = 1 << 22


def lower_ascii(text: str | Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spelled_words(sentences: DataFrame, min_length: int = 6, min_count: int = 5, every: int | None = None, letters: str = LETTERS) -> DataFrame:
    """(word, n): the distinct words of sentence texts (id, text) with at least ``min_length`` letters and ``min_count`` occurrences.

    Words are maximal runs of ``letters`` with A to Z in lower case. With ``every``, a run whose unsigned crc32 h of
    ``<id>:<run>`` is divisible by ``every`` loses its code point h % length, which plants misspellings that can be
    told again. Runs are counted before they are shuffled. Null texts have no words; a null id counts as ''.
    """
    # a run only gets shorter, so shorter ones never count
    runs = sentences.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{letters}]{{{max(1, min_length)},}}"), F.lit(0))).alias("word"),
    ).withColumn("word", lower_ascii("word"))
    if every is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(h % every == 0, cut).otherwise(F.col("word")).alias("word"))
        runs = runs.filter(F.length("word") >= max(1, min_length))
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _key(longer: Column, lo: Column, hi: Column, below: Column) -> list[Column]:
    """What the words of a group share: the longer word's length, a prefix, a suffix, and where their common prefix ends at the latest."""
    ends = F.concat(F.substring("word", F.lit(1), lo), F.lit("\u0001"), F.expr("right(word, hi)"))
    return [longer.alias("longer"), lo.alias("lo"), hi.alias("hi"), below.alias("below"), ends.alias("ends")]


def _halves(words: DataFrame) -> DataFrame:
    """Each group's two refinements: half of the undecided middle belongs to the common prefix or to the common suffix.

    If two words of at most ``longer`` letters differ by one edit, common prefix and suffix reach ``longer`` - 1, so
    one of them takes half of what is undecided. Pairs whose prefix does are left to the first refinement alone.
    """
    half = "cast(floor((longer - lo - hi) / 2) as int)"
    sides = F.explode(F.array(
        F.struct(F.expr(f"lo + {half}").alias("lo"), F.col("hi").alias("hi"), F.col("below").alias("below")),
        F.struct(F.col("lo").alias("lo"), F.expr(f"hi + {half}").alias("hi"), F.expr(f"least(below, lo + {half})").alias("below")),
    )).alias("s")
    refined = words.select("word", "n", "longer", sides).select("word", "n", "longer", "s.*")
    # a common prefix of at least lo and less than below
    return refined.filter("lo < below").select("word", "n", *_key(F.col("longer"), F.col("lo"), F.col("hi"), F.col("below")))


GROUP = ["longer", "lo", "hi", "below", "ends"]


def prefix_suffix_groups(words: DataFrame, most: int = GROUP_WORDS) -> DataFrame:
    """(word, n, GROUP) rows such that each two words one edit apart meet in exactly one group that admits them.

    Groups of more than ``most`` words are refined until only one letter is undecided; words that agree on all others
    are at most as many as there are letters.
    """
    # a word is the longer one of a pair or, for words with one letter more, the shorter one
    both = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longer"))
    whole = both.select("word", "n", "longer", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.col("longer").alias("below"))
    level, done = _halves(whole), []
    while True:
        level = staged(level, "spelling-groups")
        hot = staged(
            level.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > most) & F.expr("longer - lo - hi > 1")),
            "spelling-hot-groups",
        )
        if hot.isEmpty():
            return reduce(DataFrame.unionByName, [*done, level])
        done.append(level.join(hot, GROUP, "left_anti"))
        level = _halves(level.join(hot.drop("_n"), GROUP))


def code_points(words: list[str], width: int) -> np.ndarray:
    """Code points of each word as a row, padded with 0 up to ``width``."""
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def block_pairs(sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first and of the second block of every pair of blocks within each group, -1 where a block is not full."""
    firsts, seconds = [], []
    for n_blocks in np.unique(-(-sizes // TILE)):
        own = np.flatnonzero(-(-sizes // TILE) == n_blocks)
        a, b = np.triu_indices(n_blocks)
        for out, block in ((firsts, a), (seconds, b)):
            rows = block[None, :, None] * TILE + np.arange(TILE)[None, None]
            rows = np.where(rows < sizes[own, None, None], starts[own, None, None] + rows, -1)
            out.append(rows.reshape(-1, TILE))
    return np.concatenate(firsts), np.concatenate(seconds)


def near_pairs(words: list[str], group: np.ndarray, longer: int, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of one group whose words differ by one edit, the longer one having ``longer`` letters.

    ``group`` is ascending. Words are rows of padded code-point matrices, from the front and from the back; blocks of them
    are compared whole. Common prefix plus common suffix reach ``longer`` - 1 for single edits only.
    """
    front = code_points(words, longer + 1)
    back = code_points([w[::-1] for w in words], longer + 1)
    length = np.array([len(w) for w in words])
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    # groups of one word have no pair; smaller tiles for small groups spare padding
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for least, most in ((2, 4), (4, 8), (8, 16), (16, None)):
        some = (sizes >= least) & (sizes < most) if most else sizes >= least
        if not some.any():
            continue
        if most:
            rows = starts[some, None] + np.arange(most - 1)[None]
            first = second = np.where(np.arange(most - 1)[None] < sizes[some, None], rows, -1)
        else:
            first, second = block_pairs(sizes[some], starts[some])
        step = max(1, COMPARED // (first.shape[1] ** 2 * (longer + 1)))
        for at in range(0, len(first), step):
            a, b = first[at : at + step], second[at : at + step]
            pair = (a[:, :, None] >= 0) & (b[:, None, :] > a[:, :, None])
            pair &= np.maximum(length[a][:, :, None], length[b][:, None, :]) == longer
            if not pair.any():
                continue
            prefix = np.argmax(front[a][:, :, None] != front[b][:, None], axis=3)
            suffix = np.argmax(back[a][:, :, None] != back[b][:, None], axis=3)
            pair &= (prefix + suffix >= longer - 1) & (prefix < below[a][:, :, None])
            t, i, j = np.nonzero(pair)
            found.append((a[t, i], b[t, j]))
    if not found:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_summary(bucket: pd.DataFrame) -> pd.DataFrame:
    """Per word of a bucket of groups: its number of near words and the most frequent of them, the first in code-point order among equals."""
    out = []
    for longer, same in bucket.groupby("longer"):
        same = same.sort_values(GROUP, ignore_index=True)
        words, n = same["word"].to_list(), same["n"].to_numpy()
        group = same.groupby(GROUP, sort=False).ngroup().to_numpy()
        a, b = near_pairs(words, group, int(longer), same["below"].to_numpy())
        if len(a):
            links = pd.DataFrame({"row": np.r_[a, b], "near": np.r_[b, a]})
            links["form_n"] = n[links["near"]]
            links["form"] = [words[k] for k in links["near"]]
            links = links.sort_values(["row", "form_n", "form"], ascending=[True, False, True])
            best = links.groupby("row", as_index=False).agg(n_near=("near", "size"), form=("form", "first"), form_n=("form_n", "first"))
            best["word"] = [words[k] for k in best["row"]]
            out.append(best[["word", "n_near", "form", "form_n"]])
    if not out:
        return pd.DataFrame({"word": pd.Series(dtype=str), "n_near": pd.Series(dtype="int64"), "form": pd.Series(dtype=str), "form_n": pd.Series(dtype="int64")})
    return pd.concat(out)


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last word on the way along the forms.

    Each round doubles the steps that are known. Counts grow fivefold at every step, so ways are short.
    """
    known = staged(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = staged(
            known.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")),
            "spelling-roots",
        )
        known = longer.drop("_moved")
        if longer.filter("_moved").isEmpty():
            return known


def group_spellings(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Forms and roots of (word, n), such as :func:`spelled_words` of sentence texts or of their romanization.

    Two words are near if one inserted, deleted or replaced code point makes one the other. A word's ``form`` is its most frequent near
    word (among equals the first in code-point order) if that occurs at least ``ratio`` times as often; its ``root`` is the last
    word on the way along the forms, itself without one.

    Words that may be near share half their letters at one end, so they are grouped by these; large groups are refined by
    half of what is left, until a group fits a few tiles. All pairs of blocks of a group's padded code-point matrices are
    compared within a task that gives one row per word, never pairs. Every pair is counted in one group alone.

    Returns word, form, root, n, n_near, form_n. Words must be distinct; null or empty words and null counts take no part; an empty table gives
    an empty result; other columns are left out.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms could lead in circles")
    words = staged(words.filter("word IS NOT NULL AND word <> '' AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "spelled-words")
    groups = prefix_suffix_groups(words)
    groups = groups.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*GROUP))).filter("_size > 1").drop("_size")
    groups = staged(groups, "spelling-tiles")
    letters = groups.agg(F.sum("longer")).first()[0] or 0
    dealt = groups.withColumn("_bucket", F.pmod(F.xxhash64(*GROUP), F.lit(1 + letters // BUCKET_LETTERS)))
    near = dealt.groupBy("_bucket").applyInPandas(near_summary, "word string, n_near long, form string, form_n long")
    # the most frequent first, among equals the first in code-point order: least by (-count, word)
    best = F.min(F.struct((-F.col("form_n")).alias("_m"), "form"))
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
    known = staged(
        words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("_best._m") >= ratio * F.col("n"), F.col("_best")).alias("_best")),
        "spelling-forms",
    )
    linked = known.filter("_best IS NOT NULL").select("word", "n", "n_near", "_best.form", (-F.col("_best._m")).alias("form_n"))
    rooted = linked.join(_roots(linked), "word")
    alone = known.filter("_best IS NULL").select(
        "word", "n", "n_near", F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"), F.col("word").alias("root")
    )
    return rooted.unionByName(alone).select("word", "form", "root", "n", "n_near", "form_n")
