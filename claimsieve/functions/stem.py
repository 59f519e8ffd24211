"""Porter's suffix stripping (Porter 1980) with three small, widely used extensions, as expressions.

A step looks at the longest listed ending, checks a condition on what is left, and swaps the ending.
Each step is one projection over a word column; the "measure" of a stem is a regular expression, so the
whole chain stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Consonant and vowel runs; an initial y is written Y so that it counts as a consonant.
CONSONANT_RUN = "[^aeiou][^aeiouy]*"
VOWEL_RUN = "[aeiouy][aeiou]*"
MEASURE_ABOVE_0 = f"^({CONSONANT_RUN})?{VOWEL_RUN}{CONSONANT_RUN}"
MEASURE_IS_1 = f"^({CONSONANT_RUN})?{VOWEL_RUN}{CONSONANT_RUN}({VOWEL_RUN})?$"
MEASURE_ABOVE_1 = f"^({CONSONANT_RUN})?{VOWEL_RUN}{CONSONANT_RUN}{VOWEL_RUN}{CONSONANT_RUN}"
HAS_VOWEL = f"^({CONSONANT_RUN})?[aeiouy]"
SHORT_END = f"^({CONSONANT_RUN}[aeiouy][^aeiouwxyY]|[aeiou][^aeiou])$"

# Endings and their replacements.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)

# Words with a stem of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}


def _drop(word: Column, count: int) -> Column:
    return F.left(word, F.length(word) - F.lit(count))


def _ends(word: Column, *endings: str) -> Column:
    return word.rlike("(" + "|".join(endings) + ")$")


def _split_ending(df: DataFrame, endings) -> DataFrame:
    """Add the longest listed ending of ``_w`` as ``_end`` and the part before it as ``_stem``."""
    pattern = "^(.*?)(" + "|".join(endings) + ")$"
    df = df.withColumn("_end", F.regexp_extract("_w", pattern, 2))
    return df.withColumn("_stem", F.left("_w", F.length("_w") - F.length("_end")))


def _swap(df: DataFrame, table: dict[str, str]) -> DataFrame:
    """Swap the ending when the rest has at least one vowel-consonant pair."""
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    df = _split_ending(df, table)
    swapped = F.concat("_stem", F.element_at(lookup, F.col("_end")))
    hit = (F.col("_end") != "") & F.col("_stem").rlike(MEASURE_ABOVE_0)
    return df.withColumn("_w", F.when(hit, swapped).otherwise(F.col("_w")))


def with_stem(df: DataFrame, word: str, out: str = "stem") -> DataFrame:
    """Add the stem of a lower-case word column."""
    w, base = F.col("_w"), F.col("_base")
    keep = df.columns
    df = df.withColumn("_w", F.regexp_replace(word, "^y", "Y"))

    # plurals
    df = df.withColumn(
        "_w",
        F.when(w.rlike("^.ies$"), _drop(w, 1))
        .when(_ends(w, "sses", "ies"), _drop(w, 2))
        .when(_ends(w, "ss"), w)
        .when(_ends(w, "s"), _drop(w, 1))
        .otherwise(w),
    )

    # past tense and -ing; _base is the stem when the ending was dropped
    for_eed = _drop(w, 3).rlike(MEASURE_ABOVE_0)
    df = df.withColumn(
        "_base",
        F.when(_ends(w, "ied", "eed"), F.lit(None))
        .when(_ends(w, "ed") & _drop(w, 2).rlike(HAS_VOWEL), _drop(w, 2))
        .when(_ends(w, "ing") & _drop(w, 3).rlike(HAS_VOWEL), _drop(w, 3)),
    )
    last = F.right(base, F.lit(1))
    doubled = (F.length(base) > 1) & last.rlike("[^aeiouyY]") & F.endswith(base, F.concat(last, last))
    df = df.withColumn(
        "_w",
        F.when(w.rlike("^.ied$"), _drop(w, 1))
        .when(_ends(w, "ied"), _drop(w, 2))
        .when(_ends(w, "eed"), F.when(for_eed, _drop(w, 1)).otherwise(w))
        .when(base.isNull(), w)
        .when(_ends(base, "at", "bl", "iz"), F.concat(base, F.lit("e")))
        .when(doubled, F.when(last.rlike("[lsz]"), base).otherwise(_drop(base, 1)))
        .when(base.rlike(MEASURE_IS_1) & base.rlike(SHORT_END), F.concat(base, F.lit("e")))
        .otherwise(base),
    )

    # final y
    df = df.withColumn(
        "_w", F.when(w.rlike("^.+[^aeiouy]y$"), F.concat(_drop(w, 1), F.lit("i"))).otherwise(w)
    )

    # -alli first, so that e.g. -ationalli goes on to -ational
    alli = _ends(w, "alli") & _drop(w, 4).rlike(MEASURE_ABOVE_0)
    df = df.withColumn("_w", F.when(alli, _drop(w, 2)).otherwise(w))
    logi = _ends(w, "logi") & _drop(w, 3).rlike(MEASURE_ABOVE_0)
    df = df.withColumn("_logi", logi)
    df = _swap(df, STEP_2)
    df = df.withColumn("_w", F.when(F.col("_logi"), _drop(w, 1)).otherwise(w))
    df = _swap(df, STEP_3)

    # bare endings
    df = _split_ending(df, STEP_4)
    allowed = (F.col("_end") != "ion") | F.col("_stem").rlike("[st]$")
    hit = (F.col("_end") != "") & F.col("_stem").rlike(MEASURE_ABOVE_1) & allowed
    df = df.withColumn("_w", F.when(hit, F.col("_stem")).otherwise(w))

    # final e, double l
    rest = _drop(w, 1)
    silent = rest.rlike(MEASURE_ABOVE_1) | (rest.rlike(MEASURE_IS_1) & ~rest.rlike(SHORT_END))
    df = df.withColumn("_w", F.when(_ends(w, "e") & silent, rest).otherwise(w))
    df = df.withColumn("_w", F.when(_ends(w, "ll") & rest.rlike(MEASURE_ABOVE_1), rest).otherwise(w))

    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    stem = (
        F.when(F.col(word).isin(*IRREGULAR), F.element_at(irregular, F.col(word)))
        .when(F.length(word) <= 2, F.col(word))
        .otherwise(F.lower(w))
    )
    # Filters on the stem must not be pushed below this point: substituting a dozen steps into each
    # other would blow the expression up. An outer explode of one element changes no row and stops that.
    return df.select(*keep, F.explode_outer(F.array(stem)).alias(out))
