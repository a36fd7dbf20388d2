"""Column expressions over paths, numbers in text, markup and report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source-root prefixes, tried in this order, the first match is removed once.
SOURCE_ROOTS = (
    "src/main/java/",
    "src/main/kotlin/",
    "src/main/scala/",
    "src/main/groovy/",
    "src/main/",
    "src/java/",
    "main/java/",
    "main/",
    "source/",
    "sources/",
    "lib/",
)

# Texts that stand for an infinite number.
INFINITE_TEXTS = ("∞", "inf", "-inf", "Infinity", "-Infinity")

# Every character a Unicode-aware strip removes, spelled out so all regex dialects agree.
SPACE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


# the same characters as text, for trimming without a regular expression
SPACE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def normalise_path(path: Column) -> Column:
    """Forward slashes, no surrounding blanks, no source-root prefix; a missing path gives ''."""
    clean = F.replace(strip(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(clean, "^(?:" + "|".join(SOURCE_ROOTS) + ")", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    return F.coalesce(F.get(F.reverse(F.split(path, "/")), F.lit(1)), F.lit(""))


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_percent(text: Column) -> Column:
    """'63.1%' -> 63.1; infinities, NaN and anything else that is no number -> NULL."""
    s = strip(text.cast("string"))
    value = _number(F.regexp_replace(s, "%$", ""))
    infinite = s.isin(*INFINITE_TEXTS) | value.isin(float("inf"), float("-inf"))
    return F.when(infinite, F.lit(None)).otherwise(value)


def parse_int(text: Column) -> Column:
    """'1,234' -> 1234, truncating towards zero."""
    return _number(F.replace(strip(text.cast("string")), F.lit(","), F.lit(""))).try_cast("bigint")


def strict_float(text: Column) -> Column:
    """Plain decimals only; '-', blanks and exponents -> NULL."""
    s = strip(text.cast("string"))
    return F.when(s.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), s.try_cast("double"))


def strict_int(text: Column) -> Column:
    return strict_float(text).try_cast("bigint")


def plain_text(html: Column) -> Column:
    """Markup removed, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), f"{SPACE}+", " "))


def number_text(value: Column) -> Column:
    """Shortest decimal text of a double without exponent for small values."""
    small = (F.abs(value) < 1e-3) & (F.abs(value) >= 1e-9)
    digits = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), "0+$", "")
    return F.when(small, digits).otherwise(value.cast("string"))


def key_values(*pairs: tuple[str, Column]) -> Column:
    """'a=1, b=x' over the pairs that have a value."""
    parts = []
    for name, value in pairs:
        s = value.cast("string")
        parts.append(F.when(s.isNotNull() & (s != ""), F.concat(F.lit(name + "="), s)))
    return F.concat_ws(", ", *parts)


def change_text(name: Column, old: Column, new: Column, delta: Column, relative: Column) -> Column:
    """'m-score: 60.1 → 63.2 (Δ=+3.10 points, +5.16% relative)', NULL unless both values are known."""
    rel = F.when(relative.isNull(), F.lit("")).otherwise(F.format_string(", %+.2f%% relative", relative))
    text = F.concat(
        name, F.lit(": "), F.round(old, 2).cast("string"), F.lit(" → "), F.round(new, 2).cast("string"),
        F.lit(" (Δ="), F.format_string("%+.2f", delta), F.lit(" points"), rel, F.lit(")"),
    )
    return F.when(old.isNotNull() & new.isNotNull(), text)


def signed(value: Column) -> Column:
    """Whole number with an explicit sign."""
    return F.format_string("%+d", value.cast("bigint"))


# --- report text -------------------------------------------------------------


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def _from(lines: Column, position: Column) -> Column:
    return F.slice(lines, position, F.greatest(F.size(lines) - position + 1, F.lit(0)))


def strip_thinking(text: Column, scan_lines: int | None = None) -> Column:
    """Drop a leading block from a 'Thinking' line to the line that says 'done thinking', looked for in all lines or the first ``scan_lines``."""
    lines = _lines(text)
    done = F.array_position(
        F.transform(lines if scan_lines is None else F.slice(lines, 1, scan_lines), lambda ln: F.contains(F.lower(ln), F.lit("done thinking"))), True
    )
    rest = F.regexp_replace(F.array_join(_from(lines, (done + 1).cast("int")), "\n"), f"^{SPACE}+", "")
    starts = F.startswith(F.lower(strip(F.get(lines, F.lit(0)))), F.lit("thinking"))
    return F.when(starts & (done > 0) & (rest != ""), rest).otherwise(text)


def strip_think_tags(text: Column) -> Column:
    return strip(F.regexp_replace(text, "(?s)<think>.*?</think>", ""))


def strip_fences(text: Column) -> Column:
    """Content of the first fenced block, the text itself when there is none or it is empty."""
    fence = f"(?s)(?:^|\n)[^\\S\n]*```[^\n]*\n(.*?)(?:^|\n)?(?<=\n)[^\\S\n]*```"
    inner = strip(F.regexp_extract(F.concat(F.lit("\n"), text), fence, 1))
    return F.when(inner != "", inner).otherwise(text)


def h2_section(text: Column, heading: str) -> Column:
    """The section under ``heading`` with its heading, up to the next second-level heading; '' if absent."""
    found = F.regexp_extract(text, rf"(?ms)(\Q{heading}\E.*?)(?=^##\s|\z)", 1)
    return F.when(found == "", "").otherwise(F.concat(strip(found), F.lit("\n")))


def section_body(text: Column, heading: str) -> Column:
    """Lines after the first line equal to ``heading`` and before the next '## ' line."""
    return strip(F.regexp_extract(text, rf"(?ms)^[^\S\n]*\Q{heading}\E[^\S\n]*$\n?(.*?)(?=^## |\z)", 1))


def driver_bullets(text: Column, title: str = "## Likely Drivers", cap: int | None = None) -> Column:
    """One titled list of '-' bullets, all or the first ``cap``: headings and blanks dropped, numbering and plain lines turned into bullets."""
    body = F.transform(_from(_lines(text), F.lit(2)), strip)
    kept = F.filter(body, lambda s: (s != "") & ~s.rlike(r"^#{1,6}\s+"))
    bullets = F.transform(
        kept,
        lambda s: F.concat(F.lit("- "), strip(F.regexp_replace(s, r"^(?:[0-9]+[).:-]\s+|- )", ""))),
    )
    if cap is not None:
        bullets = F.slice(bullets, 1, cap)
    shown = F.when(F.size(bullets) == 0, F.array(F.lit("- (missing)"))).otherwise(bullets)
    out = F.concat(F.lit(title + "\n"), F.array_join(shown, "\n"), F.lit("\n"))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(out)


def file_count_change(text: Column) -> tuple[Column, Column]:
    """Old and new clustering file counts written in a report."""
    pattern = r"DRH file count:\s*old=([0-9]+)\s*→\s*new=([0-9]+)"
    return tuple(F.regexp_extract(text, pattern, i).try_cast("bigint") for i in (1, 2))


def file_mentions(text: Column) -> Column:
    """File-like tokens of a text: a dot inside, at least one letter, surrounding punctuation removed."""
    raw = F.regexp_extract_all(text, F.lit(r"(?<![\w/.-])([\w./-]+\.[\w.-]+)(?![\w/.-])"), 1)
    clean = F.transform(raw, lambda t: F.regexp_replace(t, r"^[`*()\[\]{}.,:;]+|[`*()\[\]{}.,:;]+$", ""))
    return F.filter(clean, lambda t: t.rlike(r"\p{L}"))
