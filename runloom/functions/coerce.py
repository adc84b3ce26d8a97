"""Typing of untrusted cell text: numbers, flags, labels, ids.

All are JVM-side column expressions. `number` and friends take text columns;
use `number_of` when the column may already be numeric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon as lx


def strip(c: Column) -> Column:
    """Trim every Unicode blank, not only the space `trim` knows."""
    return F.btrim(c.cast("string"), F.lit(lx.BLANKS))


def safe_text(c: Column | None) -> Column:
    """Trimmed text; null and the spelled-out nulls become ''."""
    if c is None:
        return F.lit("")
    text = strip(c)
    return F.when(text.isNull() | text.isin(lx.BLANK_EXACT), F.lit("")).otherwise(text)


def is_filled(c: Column) -> Column:
    text = F.lower(strip(c))
    return text.isNotNull() & ~text.isin(lx.BLANK_LOWER)


def is_text_present(c: Column) -> Column:
    return is_filled(c)


def number(c: Column) -> Column:
    """Text to double or null. `1d`, `2f` and `nan` are not numbers here."""
    return F.when(c.rlike(lx.NUMBER_PATTERN), c.try_cast("double"))


def number_of(df: DataFrame, name: str | None) -> Column:
    """Like `number`, by the column's own type; null when there is no column."""
    if name is None:
        return F.lit(None).cast("double")
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    return number(c)


def number_or_zero(df: DataFrame, name: str | None) -> Column:
    return F.coalesce(number_of(df, name), F.lit(0.0))


def score(c: Column) -> Column:
    """Score text with a comma or point as decimal mark; null when missing."""
    return number(F.translate(c.cast("string"), ",", "."))


def cell_number(c: Column) -> Column:
    return F.coalesce(score(c), F.lit(0.0))


def _yes_or_above_zero(c: Column, yes: list[str]) -> Column:
    # the no-words are neither yes-words nor numbers above zero
    return F.coalesce(F.lower(strip(c)).isin(yes), F.lit(False)) | F.coalesce(number(c) > 0, F.lit(False))


def is_positive(c: Column) -> Column:
    """Finish signal: yes / no words in two languages, else a number above zero."""
    return _yes_or_above_zero(c.cast("string"), lx.FINISH_YES)


def indicator_flag(c: Column) -> Column:
    return _yes_or_above_zero(c.cast("string"), lx.INDICATOR_YES).cast("int")


def indicator_flag_of(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c.cast("int"), F.lit(0))
    if isinstance(kind, T.NumericType):
        return F.coalesce((number_of(df, name) > 0).cast("int"), F.lit(0))
    return indicator_flag(c)


def cell_blank(c: Column) -> Column:
    text = F.lower(strip(c))
    return text.isNull() | text.isin(lx.BLANK_CELL)


def label_text(c: Column) -> Column:
    """Row-label normal form: lower case, `ё`→`е`, only letters, digits, №, #."""
    text = F.replace(F.lower(strip(c)), F.lit("ё"), F.lit("е"))
    text = F.regexp_replace(text, "[^0-9a-zа-я№#\\s]+", " ")
    return F.coalesce(strip(F.regexp_replace(text, "(?U)\\s+", " ")), F.lit(""))


def cell_flag(c: Column) -> Column:
    yes = label_text(c).isin(lx.CELL_YES)
    return (yes | F.coalesce(number(c.cast("string")) > 0, F.lit(False))).cast("int")


def is_episode_id(c: Column) -> Column:
    return F.coalesce(c.cast("string").rlike(lx.EPISODE_ID_PATTERN), F.lit(False))


def is_cell_id(c: Column) -> Column:
    return F.coalesce(c.rlike(lx.CELL_ID_PATTERN), F.lit(False))


def episode_number(c: Column) -> Column:
    """The whole text as a number, else its first run of digits."""
    return F.coalesce(number(c), F.regexp_extract(c, "(?U)(\\d+)", 1).try_cast("double"))


def surrogate_athlete_id(athlete: Column, sheet: Column) -> Column:
    digest = F.sha1(F.concat(sheet, F.lit("::"), athlete).cast("binary"))
    return F.concat(F.lit("ath_"), F.substring(digest, 1, 12))


def has_total_word(c: Column) -> Column:
    return F.lower(strip(c)).rlike("|".join(lx.TOTAL_WORDS))


def parse_list(c: Column) -> Column:
    """JSON list text to array<string>; anything else is the empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def list_text(c: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(c)))


def sequence_or_default(c: Column) -> Column:
    text = strip(c)
    return F.when(text.isNull() | text.isin(["", "nan", "None"]), F.lit(lx.DEFAULT_SEQUENCE)).otherwise(text)


def clamp(c: Column, allowed: list[str], default: str) -> Column:
    return F.when(c.isin(allowed), c).otherwise(F.lit(default))


def share(condition: Column) -> Column:
    """Share of rows where the condition holds; a null condition counts as no."""
    return F.coalesce(F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))), F.lit(0.0))
