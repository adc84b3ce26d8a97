"""Raw columns to tidy ones: names, blocks, types, and a structure check."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, lexicon as lx
from ..functions.names import HeaderDictionary, normal_columns

MAPPING_SCHEMA = "source_column string, normalized_column string, block string, position_in_block int"


@dataclass(frozen=True)
class Tidy:
    """Tidy rows with their column mapping (plan-time list)."""

    rows: DataFrame
    mapping: list[tuple[str, str, str, int]]

    def mapping_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.mapping, MAPPING_SCHEMA)

    def labels(self) -> dict[str, str]:
        """Normalized column → source header, to match rules on the header text."""
        return {target: source for source, target, _, _ in self.mapping}


def coerce_blocks(df: DataFrame, mapping: list[tuple[str, str, str, int]]) -> DataFrame:
    """Tactical and outcome columns to double (0 default), the rest to text ('' default)."""
    typed = {}
    for _, name, block, _ in mapping:
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        typed[name] = coerce.number_or_zero(df, name) if block in lx.NUMERIC_BLOCKS else F.when(text == "nan", "").otherwise(text)
    return df.withColumns(typed)


def tidy(df: DataFrame, row: str = "source_row_index", dictionary: HeaderDictionary | None = None,
         blocks: dict[str, str] | None = None) -> Tidy:
    """Rename, drop rows empty in every column but the sheet, and type by block.

    `blocks` pins a block for named source columns, for example the kinds a
    matrix sheet already knows.
    """
    dictionary = dictionary or HeaderDictionary()
    sources = [c for c in df.columns if c != row]
    named = df.select(row, *[F.col(f"`{c}`").alias(n) for c, n in zip(sources, normal_columns(sources))])
    mapping = dictionary.mapping(normal_columns(sources), blocks)
    renamed = named.withColumnsRenamed({s: t for s, t, _, _ in mapping})
    facts = [t for _, t, _, _ in mapping if not t.startswith("metadata__sheet")]
    empty = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNull() for c in facts], F.lit(True))
    kept = renamed.where(~empty) if facts else renamed
    return Tidy(coerce_blocks(kept, mapping), mapping)


def validate(mapping: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: are all required blocks present and is there any row."""
    required = F.array(*[F.lit(b) for b in lx.REQUIRED_BLOCKS])
    counted = rows.agg(F.count(F.lit(1)).alias("row_count"))
    return (
        mapping.agg(F.array_sort(F.collect_set("block")).alias("present_blocks"))  # at most seven block names
        .withColumn("missing_blocks", F.array_except(required, "present_blocks"))
        .withColumn("row_count", counted.scalar())
        .withColumn("column_count", F.lit(len(rows.columns)))
        .withColumn("is_valid", (F.size("missing_blocks") == 0) & (F.col("row_count") > 0))
    )
