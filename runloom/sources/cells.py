"""Worksheets as one cell table (sheet, row_idx, col_idx, value), and back to rows.

A table sheet has header rows on top. A matrix sheet is transposed: one column
per episode, labels at the left, and a marker cell that starts the id axis.

Joins of cells with tables of a row per episode or label row are sort-merge joins by hint: Spark takes
filtered or exploded cells for far smaller than they are, and would broadcast them. Tables of a row per
sheet or header cell are parked and broadcast by their number of rows (`sized`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import coerce, lexicon as lx
from ..operators.ordered import Ordering, fill_down, with_place
from ..session import park, sized

CELL_SCHEMA = "sheet string, row_idx int, col_idx int, value string"
MODES = ("auto", "table", "matrix")


# --- reading and choosing sheets ----------------------------------------------------

def read_cells(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(CELL_SCHEMA)
    return reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)


def select_sheets(cells: DataFrame, sheets: str | list[str] | None = None) -> DataFrame:
    """Cells of the named sheets; None takes all. Unknown names are an error."""
    if sheets is None:
        return cells
    wanted = [sheets] if isinstance(sheets, str) else list(sheets)
    asked = cells.sparkSession.createDataFrame([(s,) for s in wanted], "sheet string")
    chosen = cells.where(F.col("sheet").isin(wanted))
    unknown = [r["sheet"] for r in asked.join(chosen.select("sheet").distinct(), "sheet", "left_anti").collect()]
    if unknown:
        raise ValueError(f"no such sheet: {sorted(unknown)}; {cells.select('sheet').distinct().count()} sheets are there")
    return chosen


# --- labels and markers ---------------------------------------------------------------

def is_axis_marker(text: Column) -> Column:
    """`text` is in label normal form."""
    hinted = text.rlike("|".join(lx.AXIS_HINTS))
    return hinted | (text.contains("эпизод") & text.rlike("№|номер|#"))


def label_kind(label: Column) -> Column:
    """Feature kind of a row label; the first rule that holds decides."""
    text = coerce.label_text(label)
    out = F.when(is_axis_marker(text), F.lit("episode_id"))
    for kind, phrases in lx.LABEL_KINDS:
        hit = F.lit(False)
        for phrase in phrases:
            words = F.lit(True)
            for word in phrase:
                words = words & text.contains(word)
            hit = hit | words
        out = out.when(hit, F.lit(kind))
    return out.otherwise(F.lit("unknown_indicator"))


def compose_label(texts: Column) -> Column:
    """Join label cells from left to right, without blanks and repeats in a row."""
    filled = F.filter(F.transform(texts, coerce.label_text), lambda t: t != "")
    kept = F.filter(filled, lambda t, i: (i == 0) | (t != F.try_element_at(filled, F.when(i > 0, i).otherwise(F.lit(1)))))
    return F.array_join(kept, " | ")


def _markers(cells: DataFrame) -> DataFrame:
    # every marker text has one of these words; the full test runs on what is left
    worded = cells.where(F.lower("value").rlike("эпизод|episode"))
    found = worded.where(is_axis_marker(coerce.label_text(F.col("value"))))
    return found.select("sheet", F.col("row_idx").alias("m_row"), F.col("col_idx").alias("m_col"))


def _axis_columns(cells: DataFrame, markers: DataFrame) -> DataFrame:
    """Id-like cells to the right of each marker."""
    ids = cells.where(coerce.is_cell_id(F.col("value"))).select(
        "sheet", F.col("row_idx").alias("m_row"), "col_idx", F.col("value").alias("episode_id")
    )
    return ids.join(markers, ["sheet", "m_row"]).where(F.col("col_idx") > F.col("m_col")).select("sheet", "m_row", "m_col", "col_idx", "episode_id")


def matrix_sheets(cells: DataFrame) -> DataFrame:
    """Names of transposed sheets.

    Some marker has at least two ids to its right, and at least three rows below it
    hold both a label and data. Of markers in one column with ids in the same
    columns the first has all rows that the others have, so it stands for them.
    """
    axis = _axis_columns(cells, sized(park(_markers(cells), "markers")))
    columns = F.array_sort(F.collect_list("col_idx")).alias("columns")  # a row's ids at most
    wide = axis.groupBy("sheet", "m_row", "m_col").agg(columns).where(F.size("columns") >= 2)
    wide = park(wide.groupBy("sheet", "m_col", "columns").agg(F.min("m_row").alias("m_row")), "wide")
    axis = wide.select("sheet", "m_row", "m_col", F.explode(F.array_distinct("columns")).alias("col_idx"))
    reach = wide.groupBy("sheet").agg(F.min("m_row").alias("_top"), F.max(F.element_at("columns", -1)).alias("_right"))
    inside = (F.col("row_idx") > F.col("_top")) & (F.col("col_idx") <= F.col("_right"))
    filled = cells.where(~coerce.cell_blank(F.col("value"))).select("sheet", "row_idx", "col_idx")
    filled = filled.join(sized(park(reach, "reach")), "sheet").where(inside).select("sheet", "row_idx", "col_idx")
    filled = park(filled, "filled")  # no texts any more; read twice
    below = F.col("row_idx") > F.col("m_row")
    marked = sized(park(wide.drop("columns"), "marked"))
    labelled = filled.join(marked, "sheet").where(below & (F.col("col_idx") <= F.col("m_col")))
    labelled = labelled.select("sheet", "m_row", "m_col", "row_idx").distinct()
    data = filled.join(axis.hint("merge"), ["sheet", "col_idx"]).where(below)
    data = data.select("sheet", "m_row", "m_col", "row_idx").distinct()
    rows = labelled.join(data.hint("merge"), ["sheet", "m_row", "m_col", "row_idx"])
    good = rows.groupBy("sheet", "m_row", "m_col").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= 3)
    return good.select("sheet").distinct()


# --- table sheets -----------------------------------------------------------------------

def header_names(cells: DataFrame, depth: int = 2) -> DataFrame:
    """(sheet, col_idx, name) from the header rows.

    A blank header cell takes the cell at its left, as merged cells read, unless
    a row above starts anew there. Names join the rows with ` | `; repeats within
    a sheet get `_2`, `_3` ….
    """
    heads = cells.where(F.col("row_idx") < depth)
    token = F.lower(coerce.strip(F.regexp_replace("value", "(?U)\\s+", " ")))
    heads = heads.select("sheet", "row_idx", "col_idx", F.when((token == "") | token.startswith("unnamed"), None).otherwise(token).alias("token"))
    columns = cells.select("sheet", "col_idx").distinct()
    grid = columns.withColumn("row_idx", F.explode(F.array(*[F.lit(i) for i in range(depth)])))
    grid = grid.join(heads, ["sheet", "row_idx", "col_idx"], "left")
    if depth > 1:
        at = Window.partitionBy("sheet", "col_idx").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
        grid = grid.withColumn("_above", F.coalesce(F.max(F.col("token").isNotNull()).over(at), F.lit(False)))
        along = Window.partitionBy("sheet", "row_idx").orderBy("col_idx")
        grid = grid.withColumn("_part", F.sum(F.col("_above").cast("int")).over(along))
        part = Window.partitionBy("sheet", "row_idx", "_part").orderBy("col_idx")
        grid = grid.withColumn("token", F.coalesce("token", F.last("token", ignorenulls=True).over(part)))
    parts = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("row_idx", "token"))))
    named = grid.groupBy("sheet", "col_idx").agg(F.array_join(F.transform(parts, lambda p: p["token"]), " | ").alias("name"))  # depth cells
    named = named.withColumn("name", F.when(F.col("name") == "", "unknown_column").otherwise(F.col("name")))
    nth = F.row_number().over(Window.partitionBy("sheet", "name").orderBy("col_idx"))
    return named.withColumn("_nth", nth).select(
        "sheet", "col_idx", F.when(F.col("_nth") > 1, F.concat_ws("_", "name", "_nth")).otherwise(F.col("name")).alias("name")
    )


def table_cells(cells: DataFrame, depth: int = 2, heads: DataFrame | None = None) -> DataFrame:
    """Body cells with their column name: (sheet, row_idx, name, value). `heads`: the header names, if they are parked already."""
    body = cells.where(F.col("row_idx") >= depth)
    heads = park(header_names(cells, depth), "headers") if heads is None else heads
    return body.join(sized(heads), ["sheet", "col_idx"]).select("sheet", "row_idx", "name", "value")


def names_of(named: DataFrame) -> list[str]:
    """Distinct column names: the width of the table, not its length."""
    return [r["name"] for r in named.select("name").distinct().orderBy("name").collect()]


def table_rows(cells: DataFrame, depth: int = 2, names: list[str] | None = None) -> DataFrame:
    """Wide rows of all table sheets, with `_sheet` and the row's place in its sheet."""
    heads = park(header_names(cells, depth), "headers")
    if names is None:
        names = names_of(heads)
    wide = table_cells(cells, depth, heads).groupBy("sheet", "row_idx").pivot("name", names).agg(F.first("value", ignorenulls=True))
    return wide.withColumnRenamed("sheet", "_sheet")


# --- matrix sheets -----------------------------------------------------------------------

def axis_of(cells: DataFrame) -> DataFrame:
    """The first marker of each sheet, in reading order, that has an id to its right."""
    axis = _axis_columns(cells, sized(park(_markers(cells), "markers")))
    first = axis.groupBy("sheet").agg(F.min(F.struct("m_row", "m_col")).alias("m"))
    return park(first.select("sheet", "m.m_row", "m.m_col"), "axis")


def episode_columns(cells: DataFrame, axis: DataFrame) -> DataFrame:
    """(sheet, m_row, col_idx, episode_id, episode_order): the columns right of the marker."""
    ids = _axis_columns(cells, sized(axis)).select("sheet", "m_row", "col_idx", coerce.strip(F.col("episode_id")).alias("episode_id"))
    ids = park(ids, "ids")  # one row per episode
    return with_place(ids, Ordering(("sheet",), "col_idx").inspect(ids), "episode_order")


def row_labels(cells: DataFrame, axis: DataFrame) -> DataFrame:
    """(sheet, row_idx, source_label) below the marker, label cells filled down."""
    axis = sized(axis)
    rows = cells.select("sheet", "row_idx").distinct().join(axis, "sheet")
    grid = rows.withColumn("col_idx", F.explode(F.sequence(F.lit(0), F.col("m_col"))))
    left = cells.join(axis, "sheet").where(F.col("col_idx") <= F.col("m_col")).select(*cells.columns)
    grid = grid.join(left.hint("merge"), ["sheet", "row_idx", "col_idx"], "left")
    grid = grid.withColumn("value", F.when(~coerce.cell_blank(F.col("value")), F.col("value")))
    # a worksheet has at most 2^20 rows, so one label column fits a plain window
    below = fill_down(grid, Ordering(("sheet", "col_idx"), "row_idx"), ["value"]).where(F.col("row_idx") > F.col("m_row"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "value"))), lambda p: p["value"])  # label columns only
    labels = below.groupBy("sheet", "row_idx").agg(compose_label(texts).alias("source_label"))
    return labels.where(F.col("source_label") != "")


@dataclass(frozen=True)
class Matrix:
    """`values`: one row per episode and filled feature; `mapping`: one row per feature row; `axis`: one row per sheet."""

    values: DataFrame
    mapping: DataFrame
    episodes: DataFrame
    axis: DataFrame


def parse_matrix(cells: DataFrame) -> Matrix:
    """Turn columns into episodes and labelled rows into numbered features.

    The axis (a row per sheet) and the mapping (a row per labelled row) are used
    several times, so they are written once.
    """
    axis = axis_of(cells)
    episodes = park(episode_columns(cells, axis), "episodes")
    filled = cells.where(~coerce.cell_blank(F.col("value")))
    below = filled.join(episodes.hint("merge"), ["sheet", "col_idx"]).where(F.col("row_idx") > F.col("m_row"))
    data = park(below.drop("m_row"), "data")  # the filled cells
    labels = row_labels(cells, axis).join(data.select("sheet", "row_idx").distinct().hint("merge"), ["sheet", "row_idx"], "left_semi")
    labels = labels.withColumn("kind", label_kind(F.col("source_label"))).where(F.col("kind") != "episode_id")
    numeric = F.col("kind").isin(lx.NUMERIC_KINDS)
    nth = F.row_number().over(Window.partitionBy("sheet", "kind").orderBy("row_idx"))
    mapping = labels.withColumn("_nth", nth).select(
        "sheet", "row_idx", "source_label", coerce.label_text(F.col("source_label")).alias("normalized_label"),
        F.when(numeric, F.col("kind")).otherwise(F.format_string("%s_%02d", "kind", "_nth")).alias("normalized_column"),
        F.when(numeric, "numeric").otherwise("binary").alias("parser_kind"),
    )
    mapping = park(mapping, "labels")
    parsed = F.when(F.col("parser_kind") == "numeric", coerce.cell_number(F.col("value"))).otherwise(
        coerce.cell_flag(F.col("value")).cast("double")
    )
    # of two rows with one numeric kind the later counts, blank cells included
    last = F.max("row_idx").over(Window.partitionBy("sheet", "normalized_column"))
    counted = mapping.withColumn("_last", last).where(F.col("row_idx") == F.col("_last"))
    counted = sized(park(counted.select("sheet", "row_idx", "normalized_column", "parser_kind"), "counted"))
    values = data.join(counted, ["sheet", "row_idx"])
    values = values.select("sheet", "col_idx", "episode_id", "episode_order", "row_idx",
                           F.col("normalized_column").alias("name"), parsed.alias("value"))
    return Matrix(values, mapping, episodes.drop("m_row"), axis)


def matrix_rows(matrix: Matrix, athletes: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Wide rows, one per episode; features without a value are 0."""
    names = names or [r["normalized_column"] for r in
                      matrix.mapping.select("normalized_column").distinct().orderBy("normalized_column").collect()]
    wide = matrix.values.groupBy("sheet", "col_idx").pivot("name", names).agg(F.first("value"))
    wide = wide.select("sheet", "col_idx", *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names])
    rows = matrix.episodes.join(wide.hint("merge"), ["sheet", "col_idx"], "left").drop("col_idx").fillna(0.0, names)
    if athletes is not None:
        rows = rows.join(sized(park(athletes, "athletes")), "sheet", "left")
    return rows.withColumnRenamed("sheet", "source_sheet")


def athlete_names(cells: DataFrame, axis: DataFrame) -> DataFrame:
    """(sheet, athlete_name): the first filled cell up to five columns right of a name key."""
    near = cells.join(sized(axis), "sheet")
    text, words = coerce.label_text(F.col("value")), "|".join(lx.NAME_WORDS)
    # a name word of the label form is one of the text in lower case too; the full test runs on what is left
    worded = near.where(F.lower("value").rlike(words))
    keys = worded.select("sheet", "row_idx", F.col("col_idx").alias("k_col"), text.alias("k_text")).where(F.col("k_text").rlike(words))
    right = near.join(sized(park(keys, "name-keys")), ["sheet", "row_idx"]).where(
        F.col("col_idx").between(F.col("k_col") + 1, F.col("k_col") + 5) & ~coerce.cell_blank(F.col("value"))
        & (text != F.col("k_text"))
        & ((F.col("row_idx") <= F.col("m_row")) | coerce.cell_number(F.col("value")).isNull())  # a number below the axis is data
    )
    first = right.groupBy("sheet").agg(F.min_by("value", F.struct("row_idx", "k_col", "col_idx")).alias("athlete_name"))
    return first.withColumn("athlete_name", coerce.strip(F.col("athlete_name")))


# --- all sheets together --------------------------------------------------------------------

def running_offsets(sizes: DataFrame, sheet: str) -> DataFrame:
    """(sheet, _offset): rows in all sheets before it by name.

    Sheets are dealt out by ranges of their names; sums inside a range are shifted
    by the sums of the ranges before, of which there are as many as partitions.
    """
    ranged = park(sizes.repartitionByRange(sheet).withColumn("_range", F.spark_partition_id()), "sheet-sizes")
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum("_n").alias("_total"))
    shifts = totals.select("_range", F.coalesce(F.sum("_total").over(ahead.orderBy("_range")), F.lit(0)).alias("_shift"))
    inside = F.coalesce(F.sum("_n").over(ahead.partitionBy("_range").orderBy(sheet)), F.lit(0))
    return ranged.withColumn("_inside", inside).join(shifts, "_range").select(sheet, (F.col("_inside") + F.col("_shift")).alias("_offset"))


def number_rows(rows: DataFrame, sheet: str, place: str, row: str = "source_row_index") -> DataFrame:
    """0-based row number over all sheets: sheets by name, rows by place."""
    placed = with_place(rows, Ordering((sheet,), place).inspect(rows), "_nth")
    offsets = running_offsets(rows.groupBy(sheet).agg(F.count(F.lit(1)).alias("_n")), sheet)
    return placed.join(offsets, sheet).withColumn(row, F.col("_offset") + F.col("_nth") - 1).drop("_nth", "_offset", place)


def read_sheets(cells: DataFrame, depth: int = 2, mode: str = "auto", sheets: str | list[str] | None = None) -> dict[str, DataFrame]:
    """All sheets as one table of rows, with matrix rows and label mappings beside it.

    `auto` decides per sheet; `matrix` insists that every sheet is transposed.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    chosen = select_sheets(cells, sheets)
    if chosen.isEmpty():
        raise ValueError("no sheet to read")
    transposed = sized(park(matrix_sheets(chosen), "matrix-sheets")) if mode != "table" else None
    if mode == "matrix":
        plain = chosen.select("sheet").distinct().join(transposed, "sheet", "left_anti")
        wrong = plain.agg(F.count(F.lit(1)).alias("n"), F.min("sheet").alias("first")).first()
        if wrong["n"]:
            raise ValueError(f"not a matrix sheet: {wrong['first']!r}, the first of {wrong['n']} such sheets")
    parts, out = [], {}
    tables = chosen if transposed is None else chosen.join(transposed, "sheet", "left_anti")
    matrices = None if transposed is None else chosen.join(transposed, "sheet", "left_semi")
    if mode != "matrix" and not tables.isEmpty():
        parts.append(number_rows(park(table_rows(tables, depth), "table-rows"), "_sheet", "row_idx", "_row"))
    if matrices is not None and not matrices.isEmpty():
        matrix = parse_matrix(matrices)
        rows = park(matrix_rows(matrix, athlete_names(matrices, matrix.axis)), "matrix-rows")
        out["matrix_rows"], out["label_mapping"] = rows, matrix.mapping
        named = rows.withColumn("_sheet", F.col("source_sheet")).withColumn("_place", F.col("episode_order"))
        parts.append(number_rows(named, "_sheet", "_place", "_row"))
    if len(parts) == 2:
        shift = parts[0].agg(F.count(F.lit(1))).scalar()
        second = parts[1].select(*[F.col(f"`{c}`").cast("string").alias(c) if c in parts[0].columns and c not in ("_row",) else F.col(f"`{c}`")
                                   for c in parts[1].columns])
        parts = [parts[0], second.withColumn("_row", F.col("_row") + shift)]
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    out["rows"] = whole.withColumnRenamed("_row", "source_row_index")
    return out
