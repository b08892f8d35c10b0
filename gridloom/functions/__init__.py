"""Column functions on cell texts, column letters and header values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bullets that mark a title, and the markers of covered cells.
BULLETS = "■◾▪•·-"
MARKERS = ("<", "^", "^<")
# Marks of years and of panels in titles, and characters and placeholders that are never shown.
YEARS, YEAR_MARKS, PANEL, PANEL_LENGTH = "^(19|20)[0-9]{2}(년|$)", ("년", "~"), "패널", 15
HIDDEN, RESERVED = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\u200B\\u200C\\u200D\\u2060\\uFEFF\\u00AD]", r"(?i)reserved-\d+x[0-9a-f]+"
# Numerals, units within and of groups of four digits, the minus sign, and delimiters by precedence.
CJK_DIGITS = "零一二三四五六七八九"
CJK_UNITS = ("", "十", "百", "千")
CJK_GROUPS = ("", "万", "億")
CJK_MINUS = "負"
DELIMITERS = (",", "\t", ";", "|")


def not_blank(v: Column) -> Column:
    return F.coalesce(F.regexp_replace(v, r"[\s\p{Z}]+", "") != "", F.lit(False))


def trimmed(v: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(v, r"^[\p{Z}\t-\r\x1C-\x1F]+|[\p{Z}\t-\r\x1C-\x1F]+$", "")


def meaningful(v: Column) -> Column:
    return not_blank(v) & ~v.isin(*MARKERS)


def column_letters(c: Column) -> Column:
    """0-based column number to letters: 0 A, 25 Z, 26 AA (up to three letters)."""
    one, two = F.lit(26), F.lit(26 + 26 * 26)
    letter = lambda x: F.char(F.lit(65) + x % 26)
    second, third = F.floor((c - 26) / 26), F.floor((c - two) / 676)
    return (
        F.when(c < one, letter(c))
        .when(c < two, F.concat(letter(second), letter(c - 26)))
        .otherwise(F.concat(letter(third), letter(F.floor((c - two) / 26)), letter(c - two)))
    )


def title_like(v: Column) -> Column:
    """A bullet, a bare year, a leading year mark or range sign, or a short panel name."""
    t = trimmed(v)
    bare = F.regexp_replace(t, r"\s+", "")
    return F.coalesce(
        F.instr(F.lit(BULLETS), F.substring(t, 1, 1)).between(1, len(BULLETS)) & (t != "")
        | bare.rlike(YEARS)
        | t.startswith(YEAR_MARKS[0])
        | t.startswith(YEAR_MARKS[1])
        | (t.contains(PANEL) & (F.length(t) <= PANEL_LENGTH)),
        F.lit(False),
    )


def markdown_escape(v: Column) -> Column:
    """A cell of a Markdown table: markers of covered cells are empty, pipes are escaped, line ends become <br>. Null is empty."""
    text = F.replace(F.coalesce(v, F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.when(v.isin(*MARKERS, "<^"), F.lit("")).otherwise(F.regexp_replace(text, "\r\n|\n|\r", "<br>"))


def sanitize(v: Column) -> Column:
    """Without control and zero-width characters and reserved placeholders, trimmed of white space. Null stays null."""
    shown = F.regexp_replace(F.regexp_replace(v, HIDDEN, ""), RESERVED, "")
    return F.regexp_replace(shown, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def cjk_digits(v: Column) -> Column:
    return F.translate(v, "0123456789", CJK_DIGITS)


def cjk_number(n: Column) -> Column:
    """A long in CJK numerals. A zero inside a group of four digits stands before the digit above it; groups beyond the
    third are left out."""
    n = n.cast("long")

    def group(g: Column) -> Column:
        text, pending = F.lit(""), F.lit(False)
        for power, unit in enumerate(CJK_UNITS):
            d = F.floor(g / 10**power) % 10
            more = g >= 10**power
            digit = F.substring(F.lit(CJK_DIGITS), (d + 1).cast("int"), F.lit(1))
            here = F.concat(F.when(pending, F.lit(CJK_DIGITS[0])).otherwise(F.lit("")), digit, F.lit(unit))
            text, pending = F.when(more & (d != 0), F.concat(here, text)).otherwise(text), F.when(more & (d == 0), text != "").otherwise(F.lit(False))
        return F.when(g.between(10, 19), F.regexp_replace(text, f"^{CJK_DIGITS[1]}", "")).otherwise(text)

    size = F.abs(n)
    groups = [F.when((g := F.floor(size / 10_000**k) % 10_000) != 0, F.concat(group(g), F.lit(big))).otherwise(F.lit("")) for k, big in enumerate(CJK_GROUPS)]
    return F.when(n == 0, F.lit(CJK_DIGITS[0])).otherwise(F.concat(F.when(n < 0, F.lit(CJK_MINUS)).otherwise(F.lit("")), *reversed(groups)))


def date_like_format(fmt: Column) -> Column:
    """Whether a number format has a letter of dates or times. Null has none."""
    return F.coalesce(fmt.rlike("(?i)(yy|m|d|h|s)"), F.lit(False))


def unprocessed_date(v: Column) -> Column:
    """Whether a text still has date tokens. Null has none."""
    return F.coalesce(v.rlike("(?i)yy|mm|dd|hh|ss"), F.lit(False))


def date_pattern(fmt: Column) -> Column:
    """The pattern that a date is written by: every m is a month, every h an hour of the day; conditions and quotes go."""
    bare = F.regexp_replace(fmt, r"(?i)\[\$[^\]]*\]|\[color\s*\d+\]|\[(black|blue|cyan|green|magenta|red|white|yellow)\]|\[dbnum\d*\]", "")
    letters = F.translate(trimmed(bare), "mh", "MH")
    return trimmed(F.replace(F.regexp_replace(letters, "(?i)am/pm", "a"), F.lit('"'), F.lit("")))


def number_text(x: Column) -> Column:
    """A whole number without a point, else the double's own text. Null stays null."""
    whole = (F.abs(x) < float(1 << 63)) & (x == F.floor(x))
    return F.when(whole, F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def is_csv_name(name: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin("csv", "tsv"), F.lit(False))


def cell_ref(r: Column, c: Column) -> Column:
    """A1 text of a 0-based row and column."""
    return F.concat(column_letters(c), (r + 1).cast("string"))


def range_ref(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    """A1:B2 text; a single cell has no colon."""
    first, last = cell_ref(r0, c0), cell_ref(r1, c1)
    return F.when(first == last, first).otherwise(F.concat(first, F.lit(":"), last))


def sniff_delimiter(text: Column) -> Column:
    """Of , tab ; and |, that with most equal counts on each of the first ten non-blank lines; a comma if none has."""
    lines = F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r"), not_blank), 1, 10)
    best, score = F.lit(","), F.lit(0)
    for mark in DELIMITERS:
        counts = F.transform(lines, lambda s: F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit(""))))  # noqa: B023
        even = F.when(F.array_min(counts) == F.array_max(counts), F.array_max(counts)).otherwise(0)
        best, score = F.when(even > score, F.lit(mark)).otherwise(best), F.greatest(score, even)
    return best
