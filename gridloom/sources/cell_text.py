"""Texts of workbook cells: numbers by their format, dates by a translated pattern, formulas by their kept result."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from decimal import ROUND_HALF_EVEN, Decimal

from gridloom.functions import CJK_DIGITS, CJK_GROUPS, CJK_MINUS, CJK_UNITS

# Formats by their built-in number.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0_);(#,##0)", 38: "#,##0_);(#,##0)", 39: "#,##0.00_);(#,##0.00)",
    40: "#,##0.00_);(#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
}
# Spellings of the general format.
GENERAL = ("General", "G/표준", "표준", "G/標準", "標準", "G/标准", "标准")
# Characters that are never shown, and placeholders that some writers leave.
HIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f​‌‍⁠﻿­]")
RESERVED = re.compile(r"(?i)reserved-\d+x[0-9a-f]+")


@dataclass
class Cell:
    """kind: n number, s text, b truth value, e error, or "" without a value; formula: its text, if the cell has one."""

    kind: str = ""
    value: str | float | bool | None = None
    format: str = "General"
    formula: str | None = None


def sanitised(text: str) -> str:
    return RESERVED.sub("", HIDDEN.sub("", text)).strip()


def number_text(x: float) -> str:
    """A whole number without a point; else the shortest digits, with an exponent below 0.001 and from ten million on."""
    if x == math.trunc(x) and abs(x) < 1 << 63:
        return str(int(x))
    if 1e-3 <= abs(x) < 1e7:
        return format(Decimal(repr(x)), "f")
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    digits = "".join(map(str, digits)).rstrip("0") or "0"
    place = len(Decimal(repr(x)).as_tuple().digits) + exponent - 1
    return f"{'-' if sign else ''}{digits[0]}.{digits[1:] or '0'}E{place}"


def date_like(fmt: str) -> bool:
    return re.search("(?i)yy|[mdhs]", fmt) is not None


def date_pattern(fmt: str) -> str:
    """The pattern of letters that a date is written by: months for every m, hours of the day for every h."""
    bare = re.sub(r"(?i)\[\$[^\]]*\]|\[color\s*\d+\]|\[(?:black|blue|cyan|green|magenta|red|white|yellow)\]|\[dbnum\d*\]", "", fmt).strip()
    return re.sub("(?i)am/pm", "a", bare.replace("m", "M").replace("h", "H")).replace('"', "").strip()


def serial_date(x: float) -> datetime:
    """Day 1 is the first of 1900, and day 60 a 29th of February that never was."""
    days = math.floor(x)
    start = datetime(1899, 12, 30 if days >= 61 else 31)
    return start + timedelta(days=days, milliseconds=round((x - days) * 86_400_000))


def dated(x: float, pattern: str) -> str:
    """A date by letters: y M d H h s S a E; others than letters stand for themselves, unknown letters raise ValueError."""
    at = serial_date(x)
    fields: dict[str, Callable[[int], str]] = {
        "y": lambda n: f"{at.year % 100:02}" if n == 2 else str(at.year).zfill(n),
        "M": lambda n: f"{at.month}월" if n > 2 else str(at.month).zfill(n),
        "d": lambda n: str(at.day).zfill(n),
        "H": lambda n: str(at.hour).zfill(n),
        "h": lambda n: str(at.hour % 12 or 12).zfill(n),
        "m": lambda n: str(at.minute).zfill(n),
        "s": lambda n: str(at.second).zfill(n),
        "S": lambda n: str(at.microsecond // 1000).zfill(n),
        "a": lambda n: "오전" if at.hour < 12 else "오후",
        "E": lambda n: "월화수목금토일"[at.weekday()] + ("요일" if n > 3 else ""),
    }
    out = []
    for m in re.finditer(r"'([^']*)'|([A-Za-z])\2*|.", pattern, re.S):
        if m[1] is not None:
            out.append(m[1] or "'")
        elif m[2] is None:
            out.append(m[0])
        elif m[2] in fields:
            out.append(fields[m[2]](len(m[0])))
        else:
            raise ValueError(f"unknown letter {m[2]}")
    return "".join(out)


def cjk_numeral(n: int) -> str:
    """A number from 0 on in groups of four digits; a zero between two digits stands before the upper one's."""
    if n == 0:
        return CJK_DIGITS[0]
    out = ""
    for k, big in enumerate(CJK_GROUPS):
        group = n // 10_000**k % 10_000
        digits, text, zero = [int(d) for d in str(group)[::-1]], "", False
        for d, unit in zip(digits, CJK_UNITS, strict=False):
            text = f"{CJK_DIGITS[0] if zero else ''}{CJK_DIGITS[d]}{unit}{text}" if d else text
            zero = not d and bool(text)
        if group:
            out = (text.removeprefix(CJK_DIGITS[1]) if 10 <= group <= 19 else text) + big + out
    return out


def formatted(x: float, fmt: str) -> str:
    """A number by its format: sections by sign, digits, groups, decimals, percent, exponent and literal text."""
    parts = re.split(r";(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", fmt)
    part = parts[1] if x < 0 and len(parts) > 1 else parts[2] if x == 0 and len(parts) > 2 else parts[0]
    if x < 0 and len(parts) > 1:
        x = -x
    part = re.sub(r"\[[^\]]*\]|_.|\*.", "", part)
    if part.strip().lower() in ("general", "", "@"):
        whole = Decimal(repr(x)).quantize(Decimal("1e-10"), ROUND_HALF_EVEN)
        return (format(whole, "f").rstrip("0").rstrip(".") or "0") if whole != 0 else "0"
    m = re.search(r"[#0?][#0?,]*(?:\.[#0?]*)?(?:E[+-][#0?]+)?", part)
    plain = lambda t: re.sub(r'"([^"]*)"|\\(.)', lambda q: q[1] if q[1] is not None else q[2], t)
    if not m:
        return plain(part)
    digits = m[0]
    times = 100 if "%" in part else 1
    mantissa, _, power = digits.partition("E")
    decimals = len(mantissa.partition(".")[2])
    if power:
        base, exponent = f"{x * times:.{decimals}E}".split("E")
        shown = f"{base}E{'+' if power[0] == '+' and int(exponent) >= 0 else ''}{int(exponent):0{len(power) - 1 + (int(exponent) < 0)}d}".replace("E+-", "E-")
    else:
        value = abs(Decimal(repr(x)) * times).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_EVEN)
        shown = f"{value:,f}" if "," in mantissa.partition(".")[0] else f"{value:f}"
        most = mantissa.partition(".")[2]
        for place in reversed(most):
            if place == "0" or not shown.endswith("0"):
                break
            shown = shown[:-1]
        shown = shown.rstrip(".") if most else shown
        least = mantissa.partition(".")[0].replace(",", "").count("0")
        head, dot, tail = shown.partition(".")
        head = head.lstrip("0").rjust(least, "0") if least or head.strip("0") == "" and not tail else head
        shown = ("-" if x < 0 and value else "") + (head or ("" if tail else "0")) + dot + tail
    return plain(part[: m.start()]) + shown + plain(part[m.end() :])


def cell_text(cell: Cell | None, evaluate: Callable[[str], object] | None = None) -> str:
    """The text of a cell; without a kept result of a formula, that of evaluate, else the formula itself."""
    if cell is None or (not cell.kind and cell.formula is None):
        return ""
    if cell.formula is not None:
        value = cell.value
        if not cell.kind:
            try:
                value = evaluate(cell.formula) if evaluate else None
            except (ArithmeticError, ValueError, LookupError, RecursionError):
                value = None
            if value is None:
                return sanitised(f"Formula: {cell.formula}")
        if isinstance(value, bool):
            return "true" if value else "false"
        if isinstance(value, (int, float)):
            return sanitised(_java_date(float(value)) if date_format(cell.format) else number_text(float(value)))
        return sanitised(str(value))
    if cell.kind == "b":
        return "TRUE" if cell.value else "FALSE"
    if cell.kind != "n":
        return sanitised(str(cell.value))
    x, fmt = float(cell.value), cell.format
    if "[dbnum" in fmt.lower():
        whole = int(abs(x))
        tail = "" if abs(x) == whole else "点" + "".join(CJK_DIGITS[int(d)] if d.isdigit() else d for d in repr(abs(x)).partition(".")[2])
        return (CJK_MINUS if x < 0 else "") + cjk_numeral(whole) + tail
    if date_like(fmt):
        for pattern in (date_pattern(fmt), "yyyy-MM-dd"):
            try:
                if text := sanitised(dated(x, pattern)):
                    return text
            except (ValueError, OverflowError):
                continue
    shown = formatted(x, fmt)
    if any(t.lower() in shown.lower() for t in GENERAL):
        for t in GENERAL:
            shown = re.sub(re.escape(t), number_text(x), shown, flags=re.I)
    return sanitised(shown) or number_text(x)


def date_format(fmt: str) -> bool:
    """Whether a format is one of dates and times: date letters outside quotes and brackets."""
    bare = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", fmt)
    return bare.lower() != "general" and re.search("(?i)[ymdhs]", bare) is not None


def _java_date(x: float) -> str:
    try:
        return serial_date(x).strftime("%a %b %d %H:%M:%S UTC %Y")
    except (ValueError, OverflowError):
        return number_text(x)
