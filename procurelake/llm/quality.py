"""Quality rules by distribution divergence, by DataFrame functions only.

A text has two histograms: characters by class, and common words (each of a vocabulary, and all
other words). The vocabulary is learned from the corpus: the COMMON_WORDS most frequent lower-cased
words of each language. For each language there is a reference: the shares of these bins among all
texts of that language. A text fails where its least Jensen-Shannon distance (base 2, 0 to 1) to
any reference is above a limit, for either histogram, and where a base rule fails: under 50 words,
or over half of its words in repeated windows of three. Guards: distances are taken only from
CLASS_WORDS and WORD_WORDS words on; without references no text fails by distance.

Null texts are empty; empty texts have no words and fail the base rule. Null languages take no
part in references. Equally frequent words are taken in the order of their bytes. Texts of any
length are counted whole and in one way: windows of three are sorted by a hash, equal hashes are
compared by their words, and a text in which two different windows share a hash is sorted by the
windows themselves. Repeated rows each get a result. Further columns stay; columns named like the
results are replaced.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procurelake.llm.spark import prepared, stored

#: White space that separates words, and the characters counted as symbols.
SPACE, SYMBOLS = r" \t-\r", r"#*$%&|<>"
#: Character classes, in the order in which they are taken out of a text; what is left is `other`.
CLASSES = {
    "plain": "[a-z]+",
    "space": f"[{SPACE}]+",
    "lower": r"[\p{L}&&[^\p{Lu}]]+",
    "upper": r"\p{Lu}+",
    "digit": "[0-9]+",
    "stop": r"[.,;:!?'\"()-]+",
    "symbol": f"[{SYMBOLS}]+",
    "mark": r"[@^~_=+/\\\[\]{}`]+",
}
MIN_DOC_WORDS, REPEATED_SHARE = 50, 50
#: Words of each language that have bins of their own.
COMMON_WORDS = 32
#: Words from which on a text's histograms say enough: of character classes, of common words.
CLASS_WORDS, WORD_WORDS = 50, 150
#: A reference needs so many words of a language.
REFERENCE_WORDS = 1000
MAX_LANGUAGES = 256
#: Limits of the distance to the nearest reference.
CLASS_LIMIT, WORD_LIMIT = 0.3, 0.32


class Vocabulary(NamedTuple):
    """The common words, how often each language has them, and how many words it has."""

    words: list[str]
    counts: dict[tuple[str, str], int]
    totals: dict[str, int]


class References(NamedTuple):
    """The vocabulary, and for each language the shares of its bins: of CLASSES and other, of the vocabulary and other words."""

    vocabulary: list[str]
    classes: list[list[float]]
    words: list[list[float]]


def _words(body: Column) -> Column:
    return F.array_remove(F.split(body, f"[{SPACE}]+"), "")


def _long(c: Column) -> Column:
    return c.cast("long")


def _repeated(sorted_: Column, same) -> Column:
    """The entries of a sorted array that are the same as the one before or after."""
    again = lambda x, k: F.coalesce(same(x, F.get(sorted_, k)), F.lit(False))
    return F.filter(sorted_, lambda x, i: again(x, i + 1) | again(x, i - 1))


def _covered(places: Column) -> Column:
    """Words in windows of three that begin at sorted places."""
    gaps = F.transform(places, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - x, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long")


def _classes(body: Column) -> Column:
    """Characters of each of CLASSES, and others: what is left of a text gets shorter with each class that is taken out."""
    left = [body]
    for pattern in CLASSES.values():
        left.append(F.regexp_replace(left[-1], pattern, ""))
    n = [F.length(x) for x in left]
    return F.array(*[_long(a - b) for a, b in zip(n, n[1:])], _long(n[-1]))


def measured(df: DataFrame, vocabulary: list[str], text: str = "text") -> DataFrame:
    """df with `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`, `base_failed`; `class_counts`: characters of
    each of CLASSES, and others; `word_counts`: (bin, n) of each bin with a word, the one after the vocabulary's for all other words."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    # all that reads the text comes first, so that later steps needn't carry it where it isn't asked for
    df = df.withColumns({"__words": _words(body), "__lower": _words(F.lower(body)), "n_symbols": _long(F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", ""))), "__lines": lines, "class_counts": _classes(body)})
    common = F.sort_array(F.filter("__lower", lambda x: x.isin(vocabulary))) if vocabulary else F.array().cast("array<string>")
    w, n = F.col("__words"), F.size("__words")
    df = df.withColumns({"__common": common, "n_words": _long(n), "word_chars": _long(F.length(F.array_join(w, ""))), "n_dup_lines": _long(F.size("__lines") - F.size(F.array_distinct("__lines"))), "__each": F.transform(w, lambda x: F.xxhash64(x))})
    words = F.col("__common")
    starts = F.filter(F.transform(words, lambda x, i: F.when((i == 0) | (x != F.get(words, i - 1)), i)), lambda i: i.isNotNull())
    df = df.drop("__lower", "__lines").withColumn("__starts", starts)
    each = F.col("__each")
    hashes = F.transform(F.slice(each, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(each, i + 1), F.get(each, i + 2)))
    df = df.withColumn("__hashes", hashes)
    bins = F.array(*[F.lit(x) for x in vocabulary]).cast("array<string>")
    own = F.transform("__starts", lambda x, i: F.struct(F.array_position(bins, F.get(words, x)).cast("int").alias("bin"), _long(F.coalesce(F.get("__starts", i + 1), F.size(words)) - x).alias("n")))
    others = F.array(F.struct(F.lit(len(vocabulary) + 1).alias("bin"), (F.col("n_words") - F.size("__common")).alias("n")))
    # in texts with equal hashes: the hash's upper bits and, in as few bits as the text needs, the place; sorted
    mask = F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long")))) - 1)
    df = df.withColumns({"word_counts": F.filter(F.concat(own, others), lambda x: x["n"] > 0), "__mask": mask}).drop("__common", "__starts", "__each")
    df = _with_repeats(df).drop("__words", "__hashes", "__mask")
    failed = (F.col("n_words") < MIN_DOC_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_SHARE * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _with_repeats(df: DataFrame) -> DataFrame:
    """df with `n_repeat_words`, from __words, __hashes of windows and __mask, the bits that hold a place (null where no hash is twice)."""
    w, mask = F.col("__words"), F.col("__mask")
    high = F.bitwise_not(mask)
    df = df.withColumn("__keys", F.when(mask.isNotNull(), F.sort_array(F.transform("__hashes", lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long"))))))
    same = lambda a, b: a.bitwiseXOR(b).bitwiseAND(high) == 0
    df = df.withColumn("__found", _repeated(F.col("__keys"), same))
    found = F.col("__found")
    place = lambda x: x.bitwiseAND(mask).cast("int")
    differ = lambda a, b: (F.get(w, a) != F.get(w, b)) | (F.get(w, a + 1) != F.get(w, b + 1)) | (F.get(w, a + 2) != F.get(w, b + 2))
    clash = F.filter(found, lambda x, i: same(x, F.get(found, i - 1)) & differ(place(x), place(F.get(found, i - 1))))
    df = df.withColumn("__clash", F.size(clash) > 0)
    windows = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
    sorted_ = F.sort_array(F.transform(windows, lambda x, i: F.struct(F.struct(x.alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c")).alias("g"), i.alias("i"))))
    df = df.withColumn("__whole", F.when(F.col("__clash"), sorted_))
    exact = F.transform(_repeated(F.col("__whole"), lambda a, b: a["g"] == b["g"]), lambda x: x["i"].cast("int"))
    df = df.withColumn("__places", F.sort_array(F.when(F.col("__clash"), exact).otherwise(F.transform(found, place))))
    return df.withColumn("n_repeat_words", F.coalesce(_covered(F.col("__places")), F.lit(0).cast("long"))).drop("__keys", "__found", "__clash", "__whole", "__places")


def vocabulary(df: DataFrame, text: str = "text", lang: str = "lang") -> Vocabulary:
    """The common words of a corpus. The driver gets a sum, COMMON_WORDS words and the vocabulary's counts for each language."""
    prepared(df.sparkSession)
    own = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.explode(_words(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("word"))
    counts = stored(own.groupBy("lang", "word").agg(F.count("*").alias("n")))
    rows = counts.groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= REFERENCE_WORDS).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    totals = {r.lang: r.n for r in rows}
    # each task keeps a language's first COMMON_WORDS before the shuffle
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= COMMON_WORDS).select("lang", "word").collect()
    words = sorted({r.word for r in top if r.lang in totals})
    known = {(r.lang, r.word): r.n for r in counts.where(F.col("word").isin(words)).collect()} if words else {}
    # frequent words first: bins are looked up in this order
    often = {w: sum(known.get((name, w), 0) for name in totals) for w in words}
    return Vocabulary(sorted(words, key=lambda w: (-often[w], w)), known, totals)


def references(df: DataFrame, known: Vocabulary | None = None, text: str = "text", lang: str = "lang") -> References:
    """The references of a corpus, from its texts, or from `class_counts` where df has them (and the vocabulary that is given)."""
    known = known or vocabulary(df, text, lang)
    counts = F.col("class_counts") if "class_counts" in df.columns else _classes(F.coalesce(F.col(text), F.lit("")))
    size = len(CLASSES) + 1
    own = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), counts.alias("c")).where(F.col("lang").isin(list(known.totals)))
    rows = {r.lang: r for r in own.groupBy("lang").agg(*[F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(size)]).collect()} if known.totals else {}
    classes, bins = [], []
    for name, total in known.totals.items():
        r = rows[name]
        n = [known.counts.get((name, w), 0) for w in known.words]
        classes.append([r[f"c{i}"] / sum(r[f"c{k}"] for k in range(size)) for i in range(size)])
        bins.append([x / total for x in [*n, total - sum(n)]])
    return References(known.words, classes, bins)


def _nearest(counts: Column, refs: list[list[float]]) -> Column:
    """The least Jensen-Shannon distance, base 2, of a histogram (array of (bin, n), without empty bins) to any reference.

    With m = (p + q) / 2, the square is the sum over bins of (p log p + q log q) / 2 - m log m; a bin without n adds q / 2."""
    rows = [([x / 2 for x in q], [(x * math.log2(x) if x else 0.0) / 2 - x / 2 for x in q]) for q in refs]
    table = F.array(*[F.struct(F.array(*map(F.lit, half)).alias("half"), F.array(*map(F.lit, own)).alias("own")) for half, own in rows])
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    shares = F.transform(counts, lambda x: F.struct((x["bin"] - 1).alias("k"), (x["n"] / (2 * total)).alias("half")))
    p_log_p = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x["half"] * (F.log2(x["half"]) + 1))

    def square(r: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            m = x["half"] + F.get(r["half"], x["k"])
            return a + F.get(r["own"], x["k"]) - m * F.log2(m)

        return F.aggregate(shares, F.lit(0.5), step)

    return F.sqrt(F.greatest(F.lit(0.0), F.array_min(F.transform(table, square)) + p_log_p))


def verdicts(df: DataFrame, refs: References) -> DataFrame:
    """`measured` rows with `class_distance` and `word_distance` (to the nearest reference, null under the guards) and `kept`, without their histograms."""
    df = df.withColumn("class_counts", F.filter(F.transform("class_counts", lambda n, i: F.struct((i + 1).alias("bin"), n.alias("n"))), lambda x: x["n"] > 0))
    for name, own, guard in (("class", refs.classes, CLASS_WORDS), ("word", refs.words, WORD_WORDS)):
        least = _nearest(F.col(f"{name}_counts"), own) if own else F.lit(None).cast("double")
        df = df.withColumn(f"{name}_distance", F.when(F.col("n_words") >= guard, least))
    fails = [F.coalesce(F.col(f"{n}_distance") > x, F.lit(False)) for n, x in (("class", CLASS_LIMIT), ("word", WORD_LIMIT))]
    return df.withColumn("kept", ~reduce(lambda a, b: a | b, fails, F.col("base_failed"))).drop("class_counts", "word_counts")


def judged(df: DataFrame, refs: References, text: str = "text") -> DataFrame:
    """df with the counts, the distances and `kept`, by references at hand."""
    return verdicts(measured(df, refs.vocabulary, text), refs)


def judged_by_itself(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """df, without its texts, with the counts, the distances and `kept`, by its own references; each text is measured once, and the measures are stored."""
    known = vocabulary(df, text, lang)
    rows = stored(measured(df, known.words, text).drop(text))
    return verdicts(rows, references(rows, known, text, lang))


def kept(df: DataFrame, refs: References, text: str = "text") -> DataFrame:
    """The rows of df that are kept, in df's own columns."""
    # the row number keeps Catalyst from moving the filter, and with it copies of all counts, below the counts
    return judged(df, refs, text).withColumn("__row", F.monotonically_increasing_id()).where("kept AND __row >= 0").select(*df.columns)
