"""String expressions shared by the operators. All are built-in functions.

White space and word characters are Unicode's, written as explicit classes, since
``\\s`` and ``\\w`` are ASCII in Spark's regular expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS_SET = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_SET}]"
NOT_WS = f"[^{WS_SET}]"
WORD = r"[\p{L}\p{N}_]"
META = r"([\\.\[\]{}()*+?^$|])"

# fixed values
ZERO_WIDTH = "​‌‍﻿­"
QUOTES = "«»“”„‟"
DASHES = "–—−"
SPACES = "           "
LABELS = [
    "ИНН", "КПП", "ОГРН", "ОГРНИП", "БИК",
    "Адрес", "Юр. адрес", "Юр.адрес", "Юридический адрес",
    "Факт. адрес", "Факт.адрес", "Фактический адрес", "Почтовый адрес",
    "Тел.", "Телефон", "Факс",
    "E-mail", "Email", "Эл. почта", "Электронная почта",
]

LABEL_RE = "^(?:" + "|".join(x.replace(".", "\\.") for x in LABELS) + f"){WS}*[:\\-—]?{WS}+"


def py_strip(c: Column) -> Column:
    """Without white space at both ends, line ends and no-break spaces among them."""
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def escape(c: Column) -> Column:
    """The text as a pattern that matches it alone."""
    return F.regexp_replace(c, META, r"\\$1")


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def flexible_pattern(key: Column, fold: str = "(?iu)", whole_word: bool = False) -> Column:
    """M2: any case; every white-space character of the stripped key stands for one or
    more (so two in a row ask for two at least); no word boundaries unless asked for."""
    pattern = F.regexp_replace(escape(py_strip(key)), WS, _literal(WS + "+"))
    return F.concat(F.lit(fold), F.lit(f"(?<!{WORD})"), pattern, F.lit(f"(?!{WORD})")) if whole_word else F.concat(F.lit(fold), pattern)


def token_pattern(key: Column, fold: str = "(?iu)") -> Column:
    """The key's tokens with any white space between them, in any case."""
    return F.concat(F.lit(fold), F.regexp_replace(escape(py_strip(key)), WS + "+", _literal(WS + "+")))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it inside lambdas."""
    return F.transform(F.array(value), f)[0]


def once(df: DataFrame, **new: Column) -> DataFrame:
    """``df`` with more columns, each computed once: over the explosion of a list of one the planner neither merges
    projections, which would repeat an expression wherever a later one names it, nor moves Python functions into lambdas."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))).alias("_new")).select(*df.columns, "_new.*")


def scan(items: Column, zero: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What a fold gives out, in order: ``step(state, item)`` is the next state and an array of ``kind``.
    A fold copies what it holds at each step, so the items go in blocks of about the cube root of their
    number: first only the states before each block are found, then each block's own array, and
    these are joined. n items cost about n to the power of 4/3 copies."""
    none = F.array().cast(f"array<{kind}>")

    def blocks(xs: Column) -> Column:
        size = F.greatest(F.lit(16), F.cbrt(F.size(xs)).cast("int"))
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), size)).otherwise(F.array().cast("array<int>"))
        numbers = lambda i: F.sequence(i, F.least(i + size - 1, F.size(xs)))
        # items by number, as a slice would copy the whole array
        after = lambda state, i: F.aggregate(numbers(i), state, lambda s, j: step(s, F.element_at(xs, j))[0])
        states = F.aggregate(starts, F.array(zero), lambda found, i: F.concat(found, F.array(after(F.element_at(found, -1), i))))

        def one(a: Column, x: Column) -> Column:
            state, out = step(a["state"], x)
            return F.struct(state.alias("state"), F.concat(a["out"], out).alias("out"))

        def given(found: Column) -> Column:
            begin = lambda k: F.struct(F.element_at(found, k + 1).alias("state"), none.alias("out"))
            return F.flatten(F.transform(starts, lambda i, k: F.aggregate(numbers(i), begin(k), lambda a, j: one(a, F.element_at(xs, j)))["out"]))

        whole = F.aggregate(xs, F.struct(zero.alias("state"), none.alias("out")), one)["out"]  # one block needs no states
        return F.when(F.size(xs) <= 16, whole).otherwise(bound(states, given))

    return F.coalesce(bound(items, blocks), none)


SPAN = "struct<start:int,end:int,text:string>"


def spans(text: Column, pattern: Column) -> Column:
    """array<struct<start, end, text>> of a pattern's matches from left to right, 0-based
    code points, end exclusive. One pass over the pieces between the matches; a text without matches isn't split."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = at + x["p"] + F.length(x["h"])
        return end, F.array(F.struct((at + x["p"]).alias("start"), end.alias("end"), x["h"].alias("text")))

    def placed(hits: Column) -> Column:
        pieces = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("p"), hits.alias("h"))
        return scan(F.transform(pieces, lambda x: F.struct(F.length(x["p"]).alias("p"), x["h"].alias("h"))), F.lit(0), SPAN, step)

    none = F.array().cast(f"array<{SPAN}>")
    return bound(F.regexp_extract_all(text, pattern, F.lit(0)), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))


# -- normalisation (N1 to N8) -------------------------------------------------


def strip_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def ascii_typography(c: Column) -> Column:
    """Quotes, dashes, numero sign and special spaces to ASCII; an ellipsis to three dots."""
    c = F.translate(c, QUOTES + DASHES + "№" + SPACES, '"' * len(QUOTES) + "-" * len(DASHES) + "N" + " " * len(SPACES))
    return F.replace(c, F.lit("…"), F.lit("..."))


def join_hyphenated(c: Column) -> Column:
    return F.regexp_replace(c, f"({WORD})-\\n({WORD})", "$1$2")


def merge_wrapped_lines(c: Column) -> Column:
    """Lines are right-stripped; a non-empty line joins the one before it with a space
    unless that is empty or ends in one of ``. ! ? : ;``."""
    c = F.regexp_replace(c, f"[{WS_SET.replace(chr(92) + 't-' + chr(92) + 'r', chr(92) + 't' + chr(92) + 'x0b-' + chr(92) + 'r')}]+(\\n|\\z)", "$1")
    return F.regexp_replace(c, r"([^.!?:;\n])\n(?=[^\n])", "$1 ")


def fix_letter_spacing(c: Column) -> Column:
    """Lines of five or more parts of which 60 % are single characters lose their spaces."""

    def line(x):
        parts = F.split(x, " ", -1)
        single = F.size(F.filter(parts, lambda p: F.length(p) == 1))
        return F.when((F.size(parts) >= 5) & (single * 10 >= F.size(parts) * 6), F.replace(x, F.lit(" "), F.lit(""))).otherwise(x)

    return F.array_join(F.transform(F.split(c, "\n", -1), line), "\n")


def tidy_spaces(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), f"{WS}+([,.;:!?])", "$1")


def normalize_text(c: Column) -> Column:
    """N1 to N6 in order; null and empty texts pass."""
    for step in (strip_zero_width, ascii_typography, join_hyphenated, merge_wrapped_lines, fix_letter_spacing, tidy_spaces):
        c = step(c)
    return c


def collapse_whitespace(c: Column) -> Column:
    return py_strip(F.regexp_replace(c, f"{WS}+", " "))


# -- values -------------------------------------------------------------------


def strip_value_prefix(c: Column) -> Column:
    """One leading label with the white space after it goes, unless nothing is left."""
    value = py_strip(c)
    cut = py_strip(F.regexp_replace(value, "(?iu)" + LABEL_RE, ""))
    return F.when(F.length(cut) > 0, cut).otherwise(value)


def redacted(entity_type: Column) -> Column:
    return F.concat(F.lit("["), entity_type, F.lit("_REDACTED]"))
