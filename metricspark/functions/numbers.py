"""Numbers as text and text as numbers, the way metric labels and exposition lines need them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text accepted as a number, and the decimal exponents outside of which a
# number is printed in exponent form.
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_TEXT = r"^[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])$"
NAN_TEXT = r"^[nN][aA][nN]$"
MIN_PLAIN_EXPONENT = -4
MAX_PLAIN_EXPONENT = 5


def text_to_double(c: Column) -> Column:
    """Text as a number; NULL when it is not one.

    Spark's own cast also accepts surrounding blanks and type suffixes such as `1d`, and turns
    an overflow into infinity; none of these is a number here.
    """
    number = c.try_cast("double")
    return (
        F.when(c.rlike(NUMBER_TEXT), F.when(F.abs(number) < float("inf"), number))
        .when(c.rlike(INFINITY_TEXT), F.when(c.startswith("-"), F.lit(float("-inf"))).otherwise(float("inf")))
        .when(c.rlike(NAN_TEXT), F.lit(float("nan")))
    )


def _shortest(c: Column) -> Column:
    """A positive double as `d.ddd` or `d.dddE±x`, with the fewest digits that read back as itself.

    Java versions before 19 print some doubles with more digits than needed, so fewer are tried.
    """
    fewer = [F.upper(F.format_string(f"%.{digits - 1}e", c)) for digits in (15, 16)]
    tried = [F.when(text.try_cast("double") == c, text) for text in fewer]
    return F.coalesce(*tried, c.cast("string"))


def _once(c: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` uses it."""
    return F.transform(F.array(c), then)[0]


def _digits_and_point(printed: Column) -> Column:
    """Printed digits without zeros around them, and the power of ten of 0.DIGITS."""
    mantissa = F.substring_index(printed, "E", 1)
    exponent = F.when(printed.contains("E"), F.substring_index(printed, "E", -1).cast("int")).otherwise(0)
    whole = F.substring_index(mantissa, ".", 1)
    all_digits = F.concat(whole, F.substring_index(mantissa, ".", -1))
    kept = F.ltrim(all_digits, F.lit("0"))
    return F.struct(
        F.rtrim(kept, F.lit("0")).alias("digits"),
        (F.length(whole) + exponent - F.length(all_digits) + F.length(kept)).alias("point"),
    )


def _placed(number: Column) -> Column:
    """Digits with the decimal point, or with an exponent where the number is large or small."""
    digits, point = number["digits"], number["point"]
    count, exp10 = F.length(digits), point - 1
    exponent_form = F.concat(
        F.substring(digits, 1, 1),
        F.when(count > 1, F.concat(F.lit("."), digits.substr(F.lit(2), count))).otherwise(""),
        F.when(exp10 < 0, "e-").otherwise("e+"),
        F.when(F.abs(exp10) < 10, "0").otherwise(""),
        F.abs(exp10).cast("string"),
    )
    return (
        F.when((exp10 < MIN_PLAIN_EXPONENT) | (exp10 > MAX_PLAIN_EXPONENT), exponent_form)
        .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= count, F.concat(digits, F.repeat(F.lit("0"), point - count)))
        .otherwise(F.concat(digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, count)))
    )


def number_text(c: Column, single: bool = False) -> Column:
    """A double as shortest text: `6`, `0.25`, `1.5e+06`, `-2.5e-07`, `+Inf`, `NaN`.

    Spark's own text has the digits, and for numbers of ordinary size it is the result but for a
    trailing `.0`. For others the decimal point is placed anew. `single` is for columns of single
    precision.
    """
    size, printed = F.abs(c), c.cast("string")
    # up to fifteen digits are never more than needed; with sign and point that is 17 characters
    ordinary = (size >= 0.001) & (size < 1e6) & (F.length(printed) <= 16)
    digits = size.cast("string") if single else _shortest(size)
    unsigned = _once(_once(digits, _digits_and_point), _placed)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(c), "NaN")
        .when(c == float("inf"), "+Inf")
        .when(c == float("-inf"), "-Inf")
        .when(c == 0, "0")
        .when(ordinary, F.regexp_replace(printed, r"\.0$", ""))
        .otherwise(F.concat(F.when(c < 0, "-").otherwise(""), unsigned))
    )


def python_number_text(x: float) -> str:
    """The same text for a constant known on the driver (a bucket bound or an objective)."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "0"
    mantissa, _, exponent = f"{x!r}".lower().partition("e")
    digits = mantissa.lstrip("-").replace(".", "")
    point = len(mantissa.lstrip("-").partition(".")[0]) + int(exponent or 0)
    point -= len(digits) - len(digits.lstrip("0"))
    digits = digits.strip("0")
    sign = "-" if x < 0 else ""
    exp10 = point - 1
    if exp10 < MIN_PLAIN_EXPONENT or exp10 > MAX_PLAIN_EXPONENT:
        tail = "." + digits[1:] if len(digits) > 1 else ""
        return f"{sign}{digits[0]}{tail}e{'-' if exp10 < 0 else '+'}{abs(exp10):02d}"
    if point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    if point >= len(digits):
        return f"{sign}{digits}{'0' * (point - len(digits))}"
    return f"{sign}{digits[:point]}.{digits[point:]}"
