"""Quality rules: base counts, and the divergence of a document's histograms from those of its language.

Columns only: no Python runs on the executors.  The words of a text are split once; every count is a function of
that array, evaluated inside the row, so nothing is shuffled and a very long text costs n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import words

#: Common words of each language, most frequent first, as in public frequency lists.
COMMON_WORDS = {
    "en": "the of and to a in is that it for on was with be as by this are at from",
    "de": "der die und in den von zu das mit sich des auf für ist im nicht eine dem ein als",
    "fr": "de la le et en les des un du une est que pour dans qui au sur par pas avec",
    "es": "de la que el en y los se del las un por con no una para su es al lo",
}
#: Shares of letters in lower case, letters in upper case, digits, white space, sentence marks, the rest.
CLASS_SHARES = (0.79, 0.02, 0.01, 0.15, 0.025, 0.005)
#: The most frequent word of a language takes this share of a text; that of rank r a share less by r ** ZIPF.
TOP_SHARE, ZIPF = 0.0487, 0.75
#: Largest Jensen-Shannon distances (0 to 1, base 2) of a kept document.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.17, 0.34
#: A histogram of fewer characters or words tells nothing.
MIN_CHARS, MIN_WORDS = 200, 100
POSITION_BITS = 20
SYMBOLS = "#*$%&|<>"
LETTERS = "abcdefghijklmnopqrst"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def of_class(text: Column, others: str) -> Column:
    """How many characters remain without those of the class ``others``."""
    return F.length(F.regexp_replace(text, f"[{others}]+", ""))


def covered(starts: Column) -> Column:
    """Words in 3-word windows that begin at ``starts`` (ascending)."""
    gaps = F.transform(starts, lambda x, i: F.coalesce(F.least(F.lit(3), x - F.get(starts, i - 1)), F.lit(3)))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more.

    Windows are sorted as packed numbers, hash above position, and those with a neighbour of the same hash go on.
    Where such neighbours hold other words, or positions don't fit, the windows themselves are sorted instead, so
    the count is exact."""
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    low = (1 << POSITION_BITS) - 1
    pack = F.transform(starts, lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), POSITION_BITS).bitwiseOR(i.cast("bigint")))
    alike = lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), POSITION_BITS) == 0
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")

    def twins(s, same):
        return F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))

    def clash(s):
        def differs(x, i):
            y = F.get(s, i - 1)
            a, b = place(x), place(y)
            return alike(x, y) & ((F.get(w, a) != F.get(w, b)) | (F.get(w, a + 1) != F.get(w, b + 1)) | (F.get(w, a + 2) != F.get(w, b + 2)))

        return F.exists(F.transform(s, differs), lambda x: F.coalesce(x, F.lit(False)))

    plain = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))))
    exact = lambda: let(let(plain, lambda s: F.sort_array(F.transform(twins(s, lambda x, y: x["g"] == y["g"]), lambda x: x["i"]))), covered)
    fast = let(let(F.sort_array(pack), lambda s: twins(s, alike)), lambda t: F.when(clash(t), exact()).otherwise(let(F.sort_array(F.transform(t, place)), covered)))
    return F.when(F.size(w) < 4, F.lit(0)).when(F.size(w) > low, exact()).otherwise(fast).cast("bigint")


def distance(counts: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram of counts from fixed shares; null if it is empty."""
    ref = F.array(*map(F.lit, shares))

    def term(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def parts(c):
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        halves = lambda n: F.zip_with(c, ref, lambda x, q: term(x / n, (x / n + q) / 2) + term(q, (x / n + q) / 2))
        return let(total, lambda n: F.when(n > 0, F.aggregate(halves(n), F.lit(0.0), lambda a, x: a + x) / 2))

    return F.sqrt(F.greatest(F.lit(0.0), let(counts, parts)))


def word_shares(lang: str) -> list[float]:
    common = [TOP_SHARE * (r + 1) ** -ZIPF for r in range(len(COMMON_WORDS[lang].split()))]
    return [*common, 1 - sum(common)]


def class_counts(text: Column) -> Column:
    def parts(rest):
        upper, digits = F.length(rest) - of_class(rest, r"\p{Lu}"), of_class(rest, "^0-9")
        blank, marks = of_class(rest, r"^ \t-\r"), of_class(rest, r"^.,;:!?'\"()-")
        return F.array(*(x.cast("double") for x in (F.length(text) - F.length(rest), upper, digits, blank, marks, F.length(rest) - upper - digits - blank - marks)))

    return let(F.regexp_replace(text, r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", ""), parts)


def common_counts(w: Column, lang: str) -> Column:
    """Counts of the common words of a language, and of all others."""
    common = COMMON_WORDS[lang].split()
    short = F.filter(w, lambda x: F.octet_length(x) <= max(len(x.encode()) for x in common))
    listed = F.array(*map(F.lit, common))
    place = lambda x: F.substring(F.lit("_" + LETTERS), (F.array_position(listed, F.lower(x)) + 1).cast("int"), F.lit(1))
    codes = F.replace(F.array_join(F.transform(short, place), ""), F.lit("_"), F.lit(""))
    each = let(codes, lambda c: F.transform(F.split(F.lit(LETTERS), ""), lambda k: (F.length(c) - F.length(F.replace(c, k, F.lit("")))).cast("double")))
    return let(each, lambda e: F.concat(e, F.array(F.size(w) - F.aggregate(e, F.lit(0.0), lambda a, x: a + x))))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text.  ``base_failed``: fewer than 50 words, or over half of them
    in 3-word windows found twice.  A document that passes is kept unless the distance of its character classes, or of
    its common words, from the reference of its language is above the limit; texts under the guards are not tested,
    and a language without a reference (or none) takes the nearest of all.  Null and empty texts have no words and
    fail.  Ids may be null or repeat: rows don't meet.  Other columns are not read; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    langs = list(COMMON_WORDS)

    def by_words(w):
        each = {k: distance(common_counts(w, k), word_shares(k)) for k in langs}
        chosen = F.least(*each.values())
        for k in langs:
            chosen = F.when(F.col("lang") == k, each[k]).otherwise(chosen)
        tested = F.when(F.size(w) >= MIN_WORDS, chosen)
        return F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeat_words(w).alias("n_repeat_words"), tested.alias("word_distance"))

    with_word = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    dup_lines = let(with_word, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    shape = F.when(F.length("text") >= MIN_CHARS, distance(class_counts(F.col("text")), list(CLASS_SHARES)))
    got = rows.select(
        "doc_id",
        let(words(F.col("text")), by_words).alias("w"),
        of_class(F.col("text"), "^" + SYMBOLS).cast("bigint").alias("n_symbols"),
        dup_lines.alias("n_dup_lines"),
        shape.alias("class_distance"),
    )
    failed = (F.col("w.n_words") < 50) | (100 * F.col("w.n_repeat_words") > 50 * F.col("w.n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("w.word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return got.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"), (~failed & near).alias("kept"), "class_distance", "w.word_distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``; the verdict is made inside the row.

    Null, empty and short texts fail; rows that repeat, and null ids, are judged one by one; texts of any length are read
    whole.  Columns of any other name and type pass through; an empty table gives no rows."""
    return docs.where(verdict("text", "lang"))


def verdict(text_col: str, lang_col: str) -> Column:
    """The verdict as one column expression, for use in a filter."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def by_words(w):
        each = {k: distance(common_counts(w, k), word_shares(k)) for k in COMMON_WORDS}
        chosen = F.least(*each.values())
        for k in COMMON_WORDS:
            chosen = F.when(F.col(lang_col) == k, each[k]).otherwise(chosen)
        bad = (F.size(w) < 50) | (100 * repeat_words(w) > 50 * F.size(w))
        far = (F.size(w) >= MIN_WORDS) & (chosen > MAX_WORD_DISTANCE)
        return F.when(bad, F.lit(False)).otherwise(F.coalesce(~far, F.lit(True)))

    shape = (F.length(text) < MIN_CHARS) | (distance(class_counts(text), list(CLASS_SHARES)) <= MAX_CLASS_DISTANCE)
    return F.coalesce(shape, F.lit(True)) & let(words(text), by_words)
