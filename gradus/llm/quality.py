"""Line-first cleaning: rules for each line, then a verdict on documents that lose too much."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import WORD_PATTERN, as_text, documents

GAPS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MOST_REPEATED = 50  # percent of the words
MOST_LOST = 50  # percent of the words
# Words that stand between the entries of a menu.
SEPARATORS = r"^[|>»·•/]+$"
BOILERPLATE = (
    "(?i)licensed under|all rights reserved|copyright (c|©|[0-9])|released under the|terms of (use|service)|privacy policy|"
    "(uses|accept|our) cookies|enable javascript|lorem ipsum|click here|powered by|sign up for|log in to|subscribe to"
)
SENTENCE_END = "[.!?…。！？][\"'”’)»]*"
WORDS_A_SENTENCE = 30


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS), "")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column) -> Column:
    """Whether a line with a word is a menu, a notice, shouting, clutter, or not in sentences."""

    def judged(words: Column) -> Column:
        n = F.size(words)
        letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
        menu = (n > 2) & (F.size(F.filter(words, lambda w: w.rlike(SEPARATORS))) * 5 >= n)
        shouting = (n > 2) & (F.length(F.regexp_replace(line, r"[^\p{Lu}]+", "")) * 2 > letters)
        clutter = F.length(F.regexp_replace(line, "[^#*$%&|<>]+", "")) * 10 > n * 3
        loose = ~line.rlike(SENTENCE_END + r"[\x20\x09-\x0D]*$") & (
            _count(line, SENTENCE_END + r"[\x20\x09-\x0D]") * WORDS_A_SENTENCE < n
        )
        return menu | shouting | clutter | line.rlike(BOILERPLATE) | loose

    return let(words_of(line), judged)


def repeated_words(words: Column) -> Column:
    """Number of words in windows of three words that the text has twice or more.

    Windows are sorted by hash, ties by place; those with an equal neighbour are repeated. Over their places in order, each
    adds three words or as many as there are up to the next place.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def repeated(windows: Column) -> Column:
        """Rows of hash and place, in order."""
        hash_at = lambda i: F.get(windows, i)["h"]
        alike = lambda x, i: (F.when(i > 0, hash_at(i - 1) == x["h"]).otherwise(False)) | F.coalesce(hash_at(i + 1) == x["h"], F.lit(False))
        places = F.array_sort(F.transform(F.filter(windows, alike), lambda x: x["i"]))
        return let(places, covered)

    def hashed(h: Column) -> Column:
        window = F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
        return let(
            window,
            lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0).cast("bigint")).otherwise(
                let(F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)
            ),
        )

    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    )


def judge(docs: DataFrame, text: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """The columns of ``docs`` in struct ``_row`` with the counts of each text, ``cleaned`` (its lines that pass) and ``kept``.

    A null text has no words. A text fails the base rules with fewer than 50 words, or with over half of its words in windows
    of three words that it repeats. Otherwise every line with a word is judged by itself; failing lines go, and the text is
    rejected if over ``most_lost`` percent of its words went with them. Lines without a word always stay.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = docs.select(row.alias("_row"), as_text(text).alias("_text"))
    out = out.select("_row", "_text", words_of(F.col("_text")).alias("_words"), F.split("_text", "\n").alias("_lines"))
    spoken = F.filter("_lines", lambda l: l.rlike(WORD_PATTERN))
    lines = lambda keep: F.filter("_lines", lambda l: ~l.rlike(WORD_PATTERN) | keep(l))
    out = out.select(
        "_row",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        let(spoken, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.array_join(lines(lambda l: ~line_fails(l)), "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.size(words_of(F.col("cleaned")))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * (F.col("n_words") - left) <= most_lost * F.col("n_words"))
    )


def kept_rows(judged: DataFrame) -> DataFrame:
    """The rows that are kept, as ``_row`` and ``cleaned``.

    A filter would be pushed below the verdict and work everything out a second time for the rows that pass; an array of one
    or no row is worked out once.
    """
    one = F.array(F.struct("_row", "cleaned", "kept"))
    return judged.select(F.inline_outer(F.filter(one, lambda r: r["kept"]))).where("kept").drop("kept")


def op6_line_rules(spark, sf_dir: str) -> DataFrame:
    """Counts of every document and whether the base rules and the line rules keep it."""
    out = judge(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES = {"op6_line_rules": op6_line_rules}

_SPLIT = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda z: z <> '')"
_CHARS = "length(regexp_replace({0}, '{1}', '', 'g'))"
_END = SENTENCE_END.replace("'", "''")
SQL = {
    "op6_line_rules": f"""
    with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
    w as (select r, doc_id, t, {_SPLIT.format("t")} w,
            list_filter(string_split(t, chr(10)), lambda z: regexp_matches(z, '{WORD_PATTERN}')) l from d),
    win as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g
            from (select r, w, unnest(range(1, len(w) - 1)) i from w)),
    twice as (select r, i from (select r, i, count(*) over (partition by r, g) n from win) where n > 1),
    reps as (select r, count(distinct i + k) n from twice, (select unnest([0, 1, 2]) k) group by r),
    lines as (select r, x, {_SPLIT.format("x")} w from (select r, unnest(l) x from w)),
    lost as (select r, sum(len(w)) n from lines where
        (len(w) > 2 and 5 * len(list_filter(w, lambda z: regexp_matches(z, '{SEPARATORS}'))) >= len(w))
        or (len(w) > 2 and 2 * {_CHARS.format("x", "[^\\p{Lu}]+")} > {_CHARS.format("x", "[^\\p{L}]+")})
        or 10 * {_CHARS.format("x", "[^#*$%&|<>]+")} > 3 * len(w)
        or regexp_matches(x, '{BOILERPLATE}')
        or (not regexp_matches(x, '{_END}[\\x20\\x09-\\x0D]*$')
            and {WORDS_A_SENTENCE} * len(regexp_extract_all(x, '{_END}[\\x20\\x09-\\x0D]')) < len(w))
        group by r),
    c as (select r, doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
            {_CHARS.format("t", "[^#*$%&|<>]+")}::bigint n_symbols,
            (len(l) - len(list_distinct(l)))::bigint n_dup_lines,
            coalesce(reps.n, 0)::bigint n_repeat_words, coalesce(lost.n, 0) lost
          from w left join reps using (r) left join lost using (r)),
    b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words base_failed from c)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and 100 * lost <= {MOST_LOST} * n_words kept from b"""
}
