"""Cell grids to markdown, and markdown tables to parts that each carry the header."""

from pyspark.sql import Column, functions as F

from quirework.functions.common import let
from quirework.functions.text import WS, split_lines, strip

MAX_CHARS = 1800


def clean_cell(cell: Column) -> Column:
    """Bars escaped, whitespace collapsed; most cells hold neither and are only looked through."""
    escaped = F.replace(cell, F.lit("|"), F.lit("\\|"))
    return F.when(cell.rlike(rf"\||{WS}"), F.regexp_replace(strip(escaped), rf"{WS}+", " ")).otherwise(cell)


def pad_rows(cells: Column, width: Column) -> Column:
    """Ragged rows filled with empty cells up to ``width``."""
    return F.transform(
        cells,
        lambda row: F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0)))),
    )


def cells_to_markdown(cells: Column) -> Column:
    """Drop columns and rows that are empty throughout; the first row left is the header."""

    def line(values: Column) -> Column:
        return F.concat(F.lit("|"), F.array_join(values, "|"), F.lit("|"))

    def render(rows: Column) -> Column:
        header = F.get(rows, 0)
        rule = line(F.transform(header, lambda _: F.lit("---")))
        body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
        return F.when(F.size(rows) == 0, "").otherwise(
            F.array_join(F.concat(F.array(line(header), rule), body), "\n")
        )

    def keep_filled(rows: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
        columns = F.filter(
            F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1),
            lambda c: F.exists(rows, lambda row: F.coalesce(F.get(row, c), F.lit("")) != ""),
        )
        return let(
            columns,
            lambda kept: F.filter(
                F.transform(
                    rows,
                    lambda row: F.transform(kept, lambda c: F.coalesce(F.get(row, c), F.lit(""))),
                ),
                lambda row: F.exists(row, lambda cell: cell != ""),
            ),
        )

    cleaned = F.transform(cells, lambda row: F.transform(row, clean_cell))
    return let(let(cleaned, keep_filled), render)


def split_table(markdown: Column, max_chars: int = MAX_CHARS) -> Column:
    """Array of parts. Rows are packed greedily and never cut; a row over the budget
    stands alone. An empty table has no parts."""

    def pack(lines: Column) -> Column:
        head = F.concat_ws("\n", F.get(lines, 0), F.get(lines, 1))
        budget = F.lit(max_chars - 1) - F.length(head)
        rows = F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))

        def step(acc: Column, row: Column) -> Column:
            full = (acc["used"] > 0) & (acc["used"] + F.length(row) > budget)
            cost = F.length(row) + 1
            return F.struct(
                F.when(full, cost).otherwise(acc["used"] + cost).alias("used"),
                (acc["at"] + 1).alias("at"),
                F.when(full, F.concat(acc["starts"], F.array(acc["at"])))
                .otherwise(acc["starts"])
                .alias("starts"),
            )

        empty = F.struct(
            F.lit(0).alias("used"), F.lit(1).alias("at"), F.array(F.lit(1)).alias("starts")
        )
        starts = F.aggregate(rows, empty, step, lambda acc: acc["starts"])
        return F.when(F.size(rows) == 0, F.array().cast("array<string>")).otherwise(
            let(
                starts,
                lambda s: F.transform(
                    s,
                    lambda start, i: F.concat_ws(
                        "\n",
                        head,
                        F.array_join(
                            F.slice(
                                rows,
                                start,
                                F.coalesce(F.get(s, i + 1), F.size(rows) + 1) - start,
                            ),
                            "\n",
                        ),
                    ),
                ),
            )
        )

    return (
        F.when(markdown == "", F.array().cast("array<string>"))
        .when(F.length(markdown) <= max_chars, F.array(markdown))
        .otherwise(let(split_lines(markdown), pack))
    )
