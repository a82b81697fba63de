"""Text clean-up and parsing as Column expressions, free of UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Placeholders, formula symbols, bullet glyphs and the patterns of images and formulas.
IMAGE, FORMULA = "[图片]", "[公式]"
MATH_SYMBOLS = "[∑∏∫∮√∞∠∥≈≠≡≤≥±×÷→⇌⇔∨∧¬∃∀]"
BULLETS = (("\uf06e", "- ● "), ("\uf075", "    - ◆ "))
IMAGE_PATTERNS = (r"!\[.*?\]\(.*?\)", r'<img.*?src=".*?".*?>', r"\\begin\{figure\}.*?\\end\{figure\}")
FORMULA_PATTERNS = (r"\$\$.*?\$\$", r"\$.*?\$", r"\\begin\{equation\}.*?\\end\{equation\}", r"\\\[.*?\\\]")
CHALLENGE_CRAWLER = ("百度安全验证", "请输入验证码", "请完成下方验证", "您的访问出现异常", "访问异常", "请控制访问频率")
CHALLENGE_EXTRACTOR = ("百度安全验证", "请输入验证码", "security_verify", "安全验证中心")


def filled(c: Column) -> Column:
    """The trimmed value; null for null and blank."""
    return F.nullif(F.trim(c), F.lit(""))


def convert_latex(text: Column) -> Column:
    """``$x$`` on one line becomes ``\\(x\\)``."""
    return F.regexp_replace(text, r"\$(.*?)\$", r"\\($1\\)")


def symbol_density(text: Column) -> Column:
    """Formula symbols per character; 0 for empty texts."""
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(MATH_SYMBOLS)), F.length(text)), F.lit(0.0))


def is_formula(text: Column) -> Column:
    """Over a tenth symbols, a subscript group, or a backslash command. Empty texts are none."""
    return (symbol_density(text) > 0.1) | text.rlike(r"(?U)\w_\{.+\}") | text.rlike(r"\\[a-zA-Z]+")


def replace_formula_text(text: Column) -> Column:
    return F.when(is_formula(text), F.lit(FORMULA)).otherwise(text)


def replace_bullets(text: Column) -> Column:
    """In each line the first kind of glyph present becomes a list marker, everywhere in the line."""

    def line(s: Column) -> Column:
        out = s
        for glyph, marker in reversed(BULLETS):
            out = F.when(F.contains(s, F.lit(glyph)), F.replace(s, F.lit(glyph), F.lit(marker))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def clean_page(text: Column, formula: Callable[[Column], Column] | None = None) -> Column:
    """The formula steps of page text in order; a handler of one's own takes their place."""
    if formula:
        return formula(text)
    return replace_bullets(replace_formula_text(convert_latex(text)))


def with_image_mark(text: Column, has_image: Column, image: Callable[[Column], Column] | None = None) -> Column:
    """Pages with an image start with its placeholder on a line; a handler of one's own is given their text instead."""
    if image:
        return F.when(has_image, image(text)).otherwise(text)
    return F.when(has_image, F.concat(F.lit(IMAGE + "\n"), text)).otherwise(text)


def replace_patterns(text: Column, patterns: tuple[str, ...], placeholder: str | Callable[[Column], Column]) -> Column:
    """Matches become the placeholder, on lines of its own where a match holds two or more newlines.

    In place of a placeholder a function makes each match's replacement of the match.
    Matches are marked with control characters, cut apart and rebuilt. Control
    characters 1 and 2 of the input would be taken for marks and are removed.
    """
    marked = F.regexp_replace(F.translate(text, "\x01\x02", ""), f"(?s)({'|'.join(patterns)})", "\x01$1\x02")

    def rebuilt(part: Column) -> Column:
        inner, rest = F.substring_index(part, "\x02", 1), F.substring_index(part, "\x02", -1)
        lines = F.length(inner) - F.length(F.replace(inner, F.lit("\n"), F.lit("")))
        mark = placeholder(inner) if callable(placeholder) else F.when(lines > 1, F.lit(f"\n{placeholder}\n")).otherwise(F.lit(placeholder))
        return F.when(F.contains(part, F.lit("\x02")), F.concat(mark, rest)).otherwise(part)

    return F.array_join(F.transform(F.split(marked, "\x01"), rebuilt), "")


def clean_markdown(text: Column, image: str | Callable[[Column], Column] = IMAGE, formula: str | Callable[[Column], Column] = FORMULA) -> Column:
    """Images, then formulas, to placeholders or to what handlers make of them."""
    return replace_patterns(replace_patterns(text, IMAGE_PATTERNS, image), FORMULA_PATTERNS, formula)


def key_values(text: Column, quoted_fix: bool = False) -> Column:
    """``key=value`` pairs in order, as ``array<struct<key,value>>``.

    A quoted value ends at its first space and keeps its opening quote; with
    ``quoted_fix`` it is read as a whole.
    """
    plain = r'(?U)(\w+)\s*=\s*([^\s=]+|"[^"]+")'
    fixed = r'(?U)(\w+)\s*=\s*("[^"]+"|[^\s=]+)'
    pattern = F.lit(fixed if quoted_fix else plain)
    text = F.when(F.contains(text, F.lit("=")), text).otherwise("")  # most texts have no pair, and the pattern is dear
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("key"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("value"))
    bare = lambda v: F.trim(F.when(v.rlike('(?s)^".*"$') & (F.length(v) > 1), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v))
    return F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), bare(p["value"]).alias("value")))


def relation_type(type_: Column) -> Column:
    """``类型=X`` to X; other types unchanged."""
    return F.regexp_replace(type_, r"(?U)^类型\s*=\s*(.+)", "$1")


def without_dashes(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)^[\s-]+", "")


def fixed_chunks(text: Column, size: int) -> Column:
    """Consecutive slices of ``size`` characters; none for empty texts."""
    count = F.ceil(F.length(text) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(count > 0, parts).otherwise(F.array().cast("array<string>"))


def is_challenge(html: Column, phrases: tuple[str, ...] = CHALLENGE_CRAWLER) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(html, F.lit(p))
    return out


def relation_phrase(source: Column, type_: Column, target: Column) -> Column:
    return F.concat_ws(" ", source, type_, target)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 2).cast("int")


def catalog_entry(text: Column, level: Column) -> Column:
    return F.when(level == 2, F.concat(F.lit("    "), text)).otherwise(text)


def prompt(template: str, data: Column, separate: bool = False) -> Column:
    """One prompt string, or the system prompt and the data apart."""
    if separate:
        return F.struct(F.lit(template).alias("system"), data.alias("user_data"))
    return F.concat(F.lit(f"{template}\n\n请开始判断以下数据:\n\n"), data)
