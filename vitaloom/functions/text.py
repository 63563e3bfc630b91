"""Text expressions: trimming, lines, labels, first matches.

All of them are Column -> Column and stay inside the JVM. Patterns use explicit Unicode
classes, because Java's own `\\w`, `\\d` and `\\s` are ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaloom import constants as C


def no_strings() -> Column:
    """An empty list of strings."""
    return F.array().cast("array<string>")


def strip(value: Column) -> Column:
    """Trim every Unicode white-space character from both ends."""
    return F.btrim(value, F.lit(C.WHITESPACE))


def is_blank(value: Column) -> Column:
    """True for null, empty and white-space-only values; never null."""
    # From the left only, which ends at the first other character.
    return F.coalesce(F.ltrim(value, F.lit(C.WHITESPACE)) == "", F.lit(True))


def unless_empty(value: Column) -> Column:
    """The value, or null when it is ''.

    Unlike `nullif`, this evaluates an expensive value once, also inside a conditional.
    """
    return F.get(F.filter(F.array(value), lambda v: v != ""), 0)


def present(value: Column) -> Column:
    """Trimmed value, or null when nothing is left."""
    return unless_empty(strip(value))


def join_present(values: list[Column], sep: str = " | ") -> Column:
    """Join the non-blank values, or null when there is none."""
    return unless_empty(F.concat_ws(sep, *[present(v) for v in values]))


def with_plain_line_ends(text: Column) -> Column:
    r"""The text with every line end written as "\n".

    Lines can then be cut at one plain character, and anchors of a Unix-lines regex find
    them, both several times cheaper than a class of characters.
    """
    other = F.rlike(text, F.lit(f"[{C.OTHER_LINE_ENDS}]"))
    plain = F.translate(
        F.replace(text, F.lit("\r\n"), F.lit("\n")),
        C.OTHER_LINE_ENDS,
        "\n" * len(C.OTHER_LINE_ENDS),
    )
    return F.when(other, plain).otherwise(text)


def solid_lines(text: Column) -> Column:
    """Trimmed lines without the blank ones, of a text with plain line ends."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def first_line(text: Column) -> Column:
    """First non-blank line, trimmed, of a text with plain line ends."""
    return present(F.regexp_extract(text, rf"[^{C.SPACE}][^\n]*", 0))


def first_match(text: Column, pattern: str, needs: str | None = None) -> Column:
    """First case-insensitive match of the pattern; null when there is none.

    No pattern used here matches white space at either end. `needs` is a literal every match contains: a plain substring search then spares most
    texts the regex pass.
    """
    found = unless_empty(F.regexp_extract(text, f"(?iu){pattern}", 0))
    return found if needs is None else F.when(F.contains(text, F.lit(needs)), found)


def email(text: Column) -> Column:
    return first_match(text, C.EMAIL_PATTERN, needs="@")


def phone(text: Column) -> Column:
    return first_match(text, C.PHONE_PATTERN)


def linkedin_url(text: Column) -> Column:
    return first_match(text, C.LINKEDIN_PATTERN, needs="://")


def portfolio_url(text: Column) -> Column:
    return first_match(text, C.PORTFOLIO_PATTERN, needs="://")


def label_hits(text: Column, labels: tuple[str, ...] = C.LABELS) -> Column:
    """Every `Label: value` stretch of the text, found in a single pass.

    The match is a look-ahead from a line start, so a value that runs over a line end
    does not hide the label on that next line.
    """
    pattern = rf"(?iumd)^(?=((?:{'|'.join(labels)})[{C.SPACE}]*:[{C.SPACE}]*.+)$)"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def label_value(hits: Column, label: str) -> Column:
    """Value of the first hit of one label: null without a hit, '' for a blank value."""
    head = rf"(?iud)^{label}[{C.SPACE}]*:"
    hit = F.get(F.filter(hits, lambda h: F.rlike(h, F.lit(head))), 0)
    return strip(F.regexp_extract(hit, rf"{head}[{C.SPACE}]*(.+)$", 1))


def unmarked(value: Column) -> Column:
    """A trimmed value without one leading list mark, trimmed as well: the white space behind
    the mark goes with it. Trimming costs more than all else here, so it is not done again."""
    return F.regexp_replace(value, rf"^[-•*][{C.SPACE}]*", "")


def clean_item(value: Column) -> Column:
    """Trim and drop one leading list mark."""
    return unmarked(strip(value))


def comma_items(value: Column) -> Column:
    """Non-blank parts between commas."""
    parts = F.transform(F.split(value, ","), strip)
    return F.coalesce(F.filter(parts, lambda item: item != ""), no_strings())


def marked_items(lines: Column) -> Column:
    """Non-blank list items of several lines, split at comma, semicolon and bar."""
    parts = F.flatten(
        F.transform(lines, lambda line: F.split(F.translate(line, ";|", ",,"), ","))
    )
    return F.filter(F.transform(parts, clean_item), lambda item: item != "")


def cut_once(value: Column, separator: str) -> Column:
    """(head, tail) around the first match of a separator, trimmed; the tail may be null.

    One cached pattern does this; `split` would compile its pattern for every row.
    """
    pattern = rf"(?s)^(.*?){separator}(.*)$"
    found = F.rlike(value, F.lit(pattern))
    return F.struct(
        strip(F.when(found, F.regexp_extract(value, pattern, 1)).otherwise(value)).alias("head"),
        F.when(found, strip(F.regexp_extract(value, pattern, 2))).alias("tail"),
    )


def date_range(value: Column) -> Column:
    """(start, end) of a date-range text; a single part is the start, none gives nulls."""
    separator = rf"[{C.SPACE}]+(?:-|–|—|to)[{C.SPACE}]+"
    given = F.filter(F.array(value), lambda v: v != "")
    spans = F.transform(
        F.transform(given, lambda v: cut_once(v, separator)),
        lambda part: F.struct(
            F.when(part["tail"].isNull(), part["head"])
            .otherwise(unless_empty(part["head"]))
            .alias("start_date"),
            unless_empty(part["tail"]).alias("end_date"),
        ),
    )
    return F.get(spans, 0)
