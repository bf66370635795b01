"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Measures are arrays and lengths of the row's own text, so nothing is shuffled and no user function runs. `_let` binds
a value once for the expressions that use it; without it the optimizer would copy an array into each use.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
WINDOW = 8
BASE_WORDS = 20
BASE_REPEAT_PERCENT = 30

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not are this from at or an "
    "der die das und ist von zu den mit ein eine nicht im auf für als auch dem des sich "
    "le la les et est de du des un une dans que pour qui pas sur par au avec en "
    "el los las y es del por con para una no se su al como más lo o"
).split()

# measure, comparison that fails a text, threshold. Ratios are per word, per character of words, or per line.
RULES = (
    ("n_words", "<", 20),
    ("mean_word_chars", "<", 2.0),
    ("mean_word_chars", ">", 16.0),
    ("symbols_per_word", ">", 0.15),
    ("shouts_per_word", ">", 0.15),
    ("stop_word_share", "<", 0.02),
    ("dup_line_share", ">", 0.5),
    ("repeat_word_share", ">", 0.3),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def _pairs_differ(array: Column, equal: Callable[[Column, Column], Column]) -> Column:
    """For each element but the last, whether it equals its successor."""
    return F.zip_with(
        F.slice(array, 1, F.greatest(F.size(array) - 1, F.lit(0))),
        F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0))),
        equal,
    )


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more.

    Windows are compared by 64-bit hashes. Most texts repeat none, which the distinct count tells; in the others
    (hash, place) pairs are sorted, equal neighbours mark their places, and the marked windows' union is measured
    from the gaps between them.
    """

    def marked(hashes: Column) -> Column:
        keyed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(
            keyed,
            lambda s: F.array_sort(
                F.array_distinct(
                    F.flatten(
                        _pairs_differ(
                            s,
                            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(
                                F.array().cast("array<int>")
                            ),
                        )
                    )
                )
            ),
        )

    def covered(places: Column) -> Column:
        gaps = F.zip_with(
            F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))),
            F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))),
            lambda later, earlier: F.least(later - earlier, F.lit(WINDOW)),
        )
        return F.when(F.size(places) == 0, 0).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap))

    def measured(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(marked(hashes), covered))

    count = F.size(words) - (WINDOW - 1)
    hashes = _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(h, i, WINDOW))),
    )
    return F.when(count < 2, 0).otherwise(_let(hashes, measured)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with the measures in a struct column `_m`."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def counted_in(value: Column, characters: str) -> Column:
        """How many of the characters are in a text: one plain scan each, much cheaper than a character map."""
        rest = [F.length(value) - F.length(F.replace(value, F.lit(c), F.lit(""))) for c in characters]
        return reduce(Column.__add__, rest)

    def of_words(words: Column) -> Column:
        joined = F.array_join(words, "")
        return _let(
            joined,
            lambda j: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(j).cast("long").alias("word_chars"),
                counted_in(j, SYMBOLS).cast("long").alias("n_symbols"),
                counted_in(j, "!").alias("n_shouts"),
                F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop_words"),
                repeated_words(words).alias("n_repeat_words"),
            ),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = _let(
        lines,
        lambda l: F.struct(
            F.size(l).alias("n_lines"), (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines")
        ),
    )
    # Words are what lies between blanks and the characters 09-0D; a split at one plain character needs no matcher.
    blanked = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", text)
    words = F.filter(F.split(blanked, " ", -1), lambda w: w != "")
    return docs.withColumn("_m", _let(words, of_words)).withColumn("_l", counted)


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns, the measures, base_failed and kept of each row of `docs` (text).

    Null and empty texts have no words and fail. Repeated rows are judged alike; texts of any length are measured
    whole; other columns are carried or ignored as `keep` says, whatever their names.
    """
    slim = docs.select(*(keep or []), F.col("text"))
    m, lines = F.col("_m"), F.col("_l")
    words = F.greatest(m["n_words"], F.lit(1)).cast("double")
    measures = {
        "n_words": m["n_words"],
        "mean_word_chars": m["word_chars"] / words,
        "symbols_per_word": m["n_symbols"] / words,
        "shouts_per_word": m["n_shouts"] / words,
        "stop_word_share": m["n_stop_words"] / words,
        "dup_line_share": lines["n_dup_lines"] / F.greatest(lines["n_lines"], F.lit(1)),
        "repeat_word_share": m["n_repeat_words"] / words,
    }
    failed = F.lit(False)
    for name, comparison, threshold in RULES:
        failed = failed | (measures[name] < threshold if comparison == "<" else measures[name] > threshold)
    base_failed = (m["n_words"] < BASE_WORDS) | (100 * m["n_repeat_words"] > BASE_REPEAT_PERCENT * m["n_words"])
    return measured(slim).select(
        *(keep or []),
        m["n_words"].alias("n_words"),
        m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        lines["n_dup_lines"].alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & ~failed).alias("kept"),
    )
