"""Text rules: white space, answer letters and number rendering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as answers have it, and stripped from both ends of a text (Unicode white space).
_S = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{_S}]"
_NOT_WORD = r"[^\p{L}\p{N}_]"

# The ordered patterns of an answer letter; each counts by its first match only.
FINAL = rf"(?i)final answer is[:{_S}]*\$?{SPACE}*([A-D])"
WHOLE = r"^([A-Z])\z"
LEADING = r"^([A-Z])[ .)]"
KEYWORDS = [rf"(?i)answer[:{_S}]+([A-D])", rf"(?i)answer{SPACE}+is[:{_S}]+([A-D])",
            rf"(?i)option[:{_S}]+([A-D])", rf"(?i)choice[:{_S}]+([A-D])"]
BRACKETS = [r"\(([A-D])\)", r"\[([A-D])\]"]
ALONE = rf"(?:^|{_NOT_WORD})([A-D])(?:\z|{_NOT_WORD})"
SIMPLE = [rf"(?i)final answer[:{_S}]+([A-D])", rf"(?i)answer[:{_S}]+([A-D])", r"(?i)\(([A-D])\)",
          rf"(?i)(?:^|\n)([A-D])[.:{_S}]"]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def _letter(text: Column, pattern: str) -> Column:
    return F.upper(F.regexp_extract(text, pattern, 1))


def answer_letter(response: Column, choices: Column) -> Column:
    """The letter a free-text response picks among ``choices`` (map letter -> text), or ''.

    The first pattern in order whose letter is a choice; after them the first
    choice whose text (over two characters) occurs, and last a lone letter.
    """
    text = strip(response)
    valid = F.transform(F.map_keys(choices), F.upper)
    ok = lambda c: F.when(F.array_contains(valid, c), c)
    tries = [_letter(text, FINAL), _letter(F.upper(text), WHOLE), _letter(F.upper(text), LEADING)]
    tries += [_letter(text, p) for p in KEYWORDS] + [_letter(text, p) for p in BRACKETS]
    low = F.lower(text)
    named = F.filter(F.map_entries(choices), lambda e: (F.length(e["value"]) > 2) & F.contains(low, F.lower(e["value"])))
    by_text = F.upper(F.try_element_at(named, F.lit(1))["key"])
    return F.coalesce(*[ok(t) for t in tries], by_text, ok(_letter(F.upper(text), ALONE)), F.lit(""))


def answer_letter_simple(response: Column) -> Column:
    """Four patterns in order, then the first A-D character of the upper-cased text, or ''."""
    hits = [F.nullif(_letter(response, p), F.lit("")) for p in SIMPLE]
    return F.coalesce(*hits, F.regexp_extract(F.upper(response), r"([A-D])", 1))


def same_answer(letter: Column, choices: Column, truth: Column) -> Column:
    picked = F.try_element_at(choices, letter)
    return F.coalesce((letter != "") & (F.lower(strip(picked)) == F.lower(strip(truth))), F.lit(False))


def hundredths(x: Column, places: int = 2) -> Column:
    """x in whole steps of 10^-places, rounded on its exact binary value, ties to the even step.

    The step below comes from a product that may be rounded; whether x lies beyond the
    middle above it is then decided without rounding: x is split in two halves of its
    digits, whose products with the step count are exact.
    """
    steps = 10 ** places
    a = F.abs(x)
    k = F.floor(a * F.lit(float(steps)))
    wide = a * F.lit(134217729.0)
    high = wide - (wide - a)
    beyond = (high * F.lit(2.0 * steps) - (k * 2 + 1).cast("double")) + (a - high) * F.lit(2.0 * steps)
    up = (beyond > 0) | ((beyond == 0) & (k % 2 == 1))
    return (k + up.cast("int")) * F.when(x < 0, -1).otherwise(1)


def rounded(x: Column, places: int = 2) -> Column:
    """The double nearest to x rounded to ``places`` digits."""
    return hundredths(x, places) / F.lit(float(10 ** places))


def fixed_places(x: Column, places: int = 2) -> Column:
    """x with exactly ``places`` digits after the point; a negative number that rounds to zero keeps its sign."""
    n = F.abs(hundredths(x, places))
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    steps = F.lit(10 ** places)
    return F.concat(sign, F.floor(n / steps).cast("string"), F.lit("."), F.lpad((n % steps).cast("string"), places, "0"))


def plain_number(x: Column) -> Column:
    """A double written the way scene texts write it: shortest digits, exponent only below
    1e-4 or from 1e16 on."""
    s = x.cast("string")
    mantissa = F.regexp_extract(s, r"^-?([0-9.]+)E", 1)
    exp = F.regexp_extract(s, r"E(-?[0-9]+)$", 1).cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    sign = F.when(x < 0, "-").otherwise("")
    whole = F.when(F.length(digits) <= exp + 1, F.concat(F.rpad(digits, exp + 1, "0"), F.lit(".0"))).otherwise(
        F.concat(F.substring(digits, F.lit(1), exp + 1), F.lit("."), F.substring(digits, exp + 2, F.length(digits))))
    short = F.regexp_replace(mantissa, r"\.0$", "")
    power = F.concat(F.when(exp < 0, "-").otherwise("+"), F.lpad(F.abs(exp).cast("string"), F.greatest(
        F.length(F.abs(exp).cast("string")), F.lit(2)), F.lit("0")))
    return (F.when(~s.contains("E"), s)
            .when(exp == -4, F.concat(sign, F.lit("0.000"), digits))
            .when((exp > 0) & (exp < 16), F.concat(sign, whole))
            .otherwise(F.concat(sign, short, F.lit("e"), power)))


def plain_list(items: list[Column]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *items), F.lit("]"))
