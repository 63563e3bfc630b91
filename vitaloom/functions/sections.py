"""Sections of a document: which lines stand under which heading."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom.functions.text import present, solid_lines, unless_empty, unmarked


# A line that holds nothing but a heading and trailing colons. Case is folded as
# `str.lower` does it, which besides ASCII only concerns the Kelvin sign.
HEADING_LINE = (
    rf"(?imd)^[{C.INLINE_SPACE}]*("
    + "|".join(C.SECTION_HEADINGS).replace("k", r"[k\x{212a}]")
    + rf"):*[{C.INLINE_SPACE}]*$"
)
# A line end that no text with plain line ends holds, and so a safe mark.
MARK = "\x1e"


def heading_section(line: Column) -> Column:
    """Section that a trimmed line opens, or null when it is no heading."""
    table = F.create_map(*[F.lit(x) for x in chain(*C.SECTION_HEADINGS.items())])
    return F.try_element_at(table, F.lower(F.rtrim(line, F.lit(":"))))


def heading_cuts(text: Column) -> Column:
    """The text cut at its heading lines: text, heading, text, heading, text, ...

    Expects plain line ends. One pass of the heading pattern finds them all.
    """
    marked = F.regexp_replace(text, F.lit(HEADING_LINE), F.lit(f"{MARK}$1{MARK}"))
    return F.split(marked, MARK)


def section_blocks(cuts: Column) -> Column:
    """Array of (heading, section, lines), one entry per heading in document order.

    Works within one row, so carrying a heading forward costs no shuffle.
    """
    places = F.sequence(F.lit(1), F.size(cuts) - 2, F.lit(2))
    blocks = F.transform(
        places,
        lambda at: F.struct(
            F.lower(F.get(cuts, at)).alias("heading"),
            heading_section(F.get(cuts, at)).alias("section"),
            solid_lines(F.get(cuts, at + 1)).alias("lines"),
        ),
    )
    none = F.array().cast("array<struct<heading:string,section:string,lines:array<string>>>")
    return F.when(F.size(cuts) > 1, blocks).otherwise(none)


def section_lines(blocks: Column, section: str) -> Column:
    """All lines of one section; a repeated heading continues the same section."""
    own = F.filter(blocks, lambda b: b["section"] == section)
    return F.flatten(F.transform(own, lambda b: b["lines"]))


def section_text(lines: Column) -> Column:
    """Trimmed lines without list marks, those that are left joined by blanks, or null."""
    cleaned = F.filter(F.transform(lines, unmarked), lambda line: line != "")
    return unless_empty(F.array_join(cleaned, " "))


def line_after(text: Column, heading: str) -> Column:
    """The written line right below the first line that equals the heading; null if blank.

    Expects plain line ends.
    """
    pattern = rf"(?imd)^[{C.INLINE_SPACE}]*{heading}[{C.INLINE_SPACE}]*\n(.*)"
    return present(F.regexp_extract(text, pattern, 1))
