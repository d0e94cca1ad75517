"""Quality rules with thresholds that adapt to language and source, in DataFrame functions only.

Base measures of each whole text come from array and string functions. For the adaptive rules, mergeable KLL quantile
sketches of each measure are built per language and source in one aggregation (map-side sketches are merged, so a hot
source costs no more than its share), and merged again into one sketch per language and one overall. A group of at
least ``least_rows`` documents takes its own sketch's fences, a smaller one those of its language, then the overall
ones. A measure fails above the group's upper quartile plus three spreads, and one with a lower fence also below the
lower quartile less three spreads, where the spread is the interquartile range, or the measure's least spread if that is
more, so that a group of nearly equal documents doesn't lose those that differ a little. No cutoff is fixed.
The thresholds are joined to the documents; up to ``SMALL`` groups they are broadcast, beyond that both sides are
shuffled.

Defined results: null and empty texts have no words and fail the base rule; null languages and sources are groups of
their own; texts of any length are measured whole; repeated rows are judged row by row; an empty table gives an empty result; clashing columns are kept, as
the operator's own are named with a leading underscore until the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.llm.common import stored, table, text_or_empty

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Sketch size: up to about this many rows a group's quartiles are exact.
SKETCH_K = 4096
LEAST_ROWS = 200
#: Groups whose thresholds are broadcast.
SMALL = 50_000

#: Adaptive measures, each with its least spread and whether it has a lower fence. Fixed values.
MEASURES = {"symbol_rate": (0.03, False), "capital_rate": (0.06, False), "shout_rate": (0.06, False), "dup_line_rate": (0.15, False), "word_length": (1.0, True)}


def base_columns(text: Column) -> dict[str, Column]:
    """Measures that need no array of words."""
    return {
        "_chars": F.length(text).cast("long"),
        "_word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "_n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "_capitals": (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long"),
        "_shouts": (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long"),
    }


def covered_words(hashes: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, from the windows' hashes by position."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twin(x: Column, i: Column, a: Column) -> Column:
        return F.coalesce(F.get(a, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(a, i + 1)["h"] == x["h"], F.lit(False))

    # The sorted array is bound once, as the one element of an array, so that it isn't sorted again for each element.
    starts = F.flatten(
        F.transform(F.array(placed), lambda a: F.sort_array(F.transform(F.filter(a, lambda x, i: twin(x, i, a)), lambda x: x["i"])))
    )
    return F.aggregate(
        starts,
        F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")),
        lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(5), x - s["last"])).alias("n")),
        lambda s: s["n"].cast("long"),
    )


def measured(df: DataFrame, text_col: str = "text", windows: bool = True) -> DataFrame:
    """``df`` with the measures; without ``windows``, those that the adaptive rules need."""
    text = text_or_empty(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    df = df.withColumns(base_columns(text) | {"_lines": lines, "_hashes": F.transform(words, lambda w: F.xxhash64(w))})
    df = df.withColumns(
        {
            "_n_words": F.size("_hashes").cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    if windows:
        w = F.col("_hashes")
        five = F.when(
            F.size(w) >= 6,
            F.transform(F.slice(w, 1, F.size(w) - 4), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3), F.get(w, i + 4))),
        ).otherwise(F.array().cast("array<bigint>"))
        df = df.withColumn("_five", five)
        five = F.col("_five")
        repeated = F.when(F.size(five) == F.size(F.array_distinct(five)), F.lit(0).cast("long")).otherwise(covered_words(five))
        df = df.withColumn("_n_repeat_words", repeated).drop("_five")
    words, chars = F.greatest(F.col("_n_words"), F.lit(1)), F.greatest(F.col("_word_chars"), F.lit(1))
    return df.withColumns(
        {
            "_symbol_rate": F.col("_n_symbols") / words,
            "_capital_rate": F.col("_capitals") / chars,
            "_shout_rate": F.col("_shouts") / words,
            "_dup_line_rate": F.col("_n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
            "_word_length": F.col("_word_chars") / words,
        }
    ).drop("_lines", "_hashes", "_chars", "_capitals", "_shouts", "_n_lines")


def thresholds(rows: DataFrame, least_rows: int = LEAST_ROWS, k: int = SKETCH_K) -> DataFrame:
    """Per (_lang, _source): the lowest and highest value of each measure that passes, from merged sketches."""
    own = rows.groupBy("_lang", "_source").agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(f"_{m}", F.lit(k)).alias(m) for m in MEASURES]
    )
    own = stored(own)

    def merged(keys: list[str], prefix: str) -> DataFrame:
        return own.groupBy(*keys).agg(
            F.sum("n").alias(f"{prefix}n"), *[F.kll_merge_agg_double(m, F.lit(k)).alias(f"{prefix}{m}") for m in MEASURES]
        )

    # The overall sketches are one row of fixed size.
    every = merged([], "all_").first()
    langs = merged(["_lang"], "lang_").withColumnRenamed("_lang", "_of")
    levels = own.join(langs, F.col("_lang").eqNullSafe(F.col("_of")))

    def fences(m: str) -> list[Column]:
        sketch = F.when(F.col("n") >= least_rows, F.col(m)).when(F.col("lang_n") >= least_rows, F.col(f"lang_{m}")).otherwise(F.lit(every[f"all_{m}"]))
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        least, lower = MEASURES[m]
        spread = F.greatest(high - low, F.lit(least))
        return [(low - 3 * spread if lower else F.lit(float("-inf"))).alias(f"_low_{m}"), (high + 3 * spread).alias(f"_high_{m}")]

    return levels.select("_lang", "_source", *[c for m in MEASURES for c in fences(m)])


def judged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with ``_base_failed`` and ``_kept``."""
    cuts = cuts.withColumnsRenamed({"_lang": "_cut_lang", "_source": "_cut_source"})
    if cuts.limit(SMALL + 1).count() <= SMALL:
        cuts = F.broadcast(cuts)
    same = F.col("_lang").eqNullSafe(F.col("_cut_lang")) & F.col("_source").eqNullSafe(F.col("_cut_source"))
    failed = (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words"))
    within = F.lit(True)
    for m in MEASURES:
        within &= F.col(f"_{m}").between(F.col(f"_low_{m}"), F.col(f"_high_{m}"))
    return rows.join(cuts, same).withColumn("_base_failed", failed).withColumn("_kept", ~failed & within)


def grouped(df: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    return df.withColumns({"_lang": F.col(lang_col), "_source": F.col(source_col)})


def quality_filter(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` that pass, with ``df``'s columns. The text is read twice and never shuffled."""
    # A column that isn't deterministic keeps the filter above the measures; pushed below, it would work each of them
    # out anew wherever the condition names it.
    rows = grouped(df, lang_col, source_col)
    cuts = stored(thresholds(measured(rows.select(F.col(text_col).alias("_text"), "_lang", "_source"), "_text", windows=False)))
    rows = measured(rows, text_col).withColumn("_row", F.monotonically_increasing_id())
    return judged(rows, cuts).filter("_kept AND _row >= 0").select(*[df[c] for c in df.columns])


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: base measures, base verdict and verdict."""
    rows = grouped(df, lang_col, source_col).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), "_lang", "_source")
    rows = stored(measured(rows, "_text").drop("_text"))
    names = {"_id": "doc_id"} | {f"_{n}": n for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")}
    return judged(rows, stored(thresholds(rows))).select(*[F.col(a).alias(b) for a, b in names.items()])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))
