"""Exact numbers as text: integers of any length and decimals of any scale, without a width that could round them.

A number here is the text of an xsd:integer or xsd:decimal, optional sign, digits and point.  Where two numbers are
short enough, Spark's own decimals compute; otherwise they are cut into limbs of six digits, added or multiplied limb by limb, and carried once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of a limb: products of two limbs, and sums of very many products, fit into a long.
LIMB = 6
BASE = 10**LIMB
#: Digits after the point of a quotient; the rest is cut off.
QUOTIENT = 18
#: Spark's widest whole number.
WIDE = "decimal(38,0)"
#: A divisor of more significant digits gives no quotient.
DIVISOR = 36


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def once(f: Callable[..., Column]) -> Callable[..., Column]:
    """Arguments are computed once: a function that names one ten times does not make ten copies of its whole expression."""

    @functools.wraps(f)
    def bound(*args: Column) -> Column:
        return _let(F.struct(*[a.alias(f"x{i}") for i, a in enumerate(args)]), lambda x: f(*[x[f"x{i}"] for i in range(len(args))]))

    return bound


def _zeros_off(text: Column) -> Column:
    return F.ltrim(text, F.lit("0"))


def negative(text: Column) -> Column:
    return text.startswith("-")


def whole(text: Column) -> Column:
    """The digits before the point, without needless zeros: empty for none."""
    return _zeros_off(F.substring_index(F.ltrim(text, F.lit("+-")), ".", 1))


def rest(text: Column) -> Column:
    """The digits after the point, without needless zeros: empty for none."""
    return F.when(text.contains("."), F.rtrim(F.substring_index(text, ".", -1), F.lit("0"))).otherwise("")


@once
def plain(text: Column) -> Column:
    """The canonical text: no sign of zero, no needless zeros, a point only before digits."""
    return _signed(negative(text), whole(text), rest(text))


@once
def _signed(minus: Column, before: Column, after: Column) -> Column:
    sign = F.when(minus & ((before != "") | (after != "")), "-").otherwise("")
    return F.concat(sign, F.when(before == "", "0").otherwise(before), F.when(after == "", "").otherwise(F.concat(F.lit("."), after)))


@once
def order_key(text: Column) -> Column:
    """Text whose order is that of the numbers, and which is equal just for equal ones.

    Sign, number of digits before the point, digits; for a number below zero each digit is its complement to nine, and the end
    comes after every digit, as the longer of two such numbers is the lesser.
    """
    before = whole(text)
    body = F.concat(F.lpad(F.length(before).cast("string"), 10, "0"), before, rest(text))
    below = F.concat(F.lit("0"), F.translate(body, "0123456789", "9876543210"), F.lit("~"))
    return F.when(negative(text) & body.rlike("[1-9]"), below).otherwise(F.concat(F.lit("1"), body))


def _fits(text: Column, before: int, after: int) -> Column:
    return (F.length(whole(text)) <= before) & (F.length(rest(text)) <= after)


# ---------------------------------------------------------------- limbs
def _limbs(digits: Column) -> Column:
    """The limbs of a text of whole limbs, the highest first."""
    return F.transform(F.sequence(F.lit(0), (F.length(digits) / LIMB).cast("int") - 1), lambda i: F.substring(digits, i * LIMB + 1, F.lit(LIMB)).cast("long"))


def _padded(length: Column) -> Column:
    """The least length of whole limbs, at least one."""
    return F.greatest(F.lit(LIMB), (F.ceil(length / LIMB) * LIMB).cast("int"))


def carried(limbs: Column, base: int, digits: int, kind: str) -> Column:
    """What is left over at the top, and the digits below it, of signed limbs of any size, the highest first."""

    def one(acc: Column, limb: Column) -> Column:
        total = limb.cast(kind) + acc["top"]
        low = F.pmod(total, F.lit(base).cast(kind))
        high = F.call_function("div", total - low, F.lit(base).cast(kind)) if kind == "long" else (total - low) / F.lit(base).cast("decimal(16,0)")
        return F.struct(high.cast(kind).alias("top"), F.concat(F.lpad(low.cast("string"), digits, "0"), acc["text"]).alias("text"))

    return F.aggregate(F.reverse(limbs), F.struct(F.lit(0).cast(kind).alias("top"), F.lit("").alias("text")), one)


def number_of(limbs: Column, scale: Column, base: int = BASE, digits: int = LIMB, kind: str = "long") -> Column:
    """The number of signed limbs whose last ``scale`` digits are after the point."""

    def text(minus: Column, found: Column) -> Column:
        def cut(every: Column) -> Column:
            at = F.length(every) - scale
            return _signed(minus, _zeros_off(F.substring(every, F.lit(1), at)), F.rtrim(F.substring(every, at + 1, scale), F.lit("0")))

        # the text has whole limbs on both sides of the point, or is padded to them
        return _let(F.concat(F.repeat(F.lit("0"), scale), found["top"].cast("string"), found["text"]), cut)

    negated = lambda x: carried(F.transform(x, lambda v: -v), base, digits, kind)
    return _let(limbs, lambda x: _let(carried(x, base, digits, kind), lambda c: F.when(c["top"] >= 0, text(F.lit(False), c)).otherwise(_let(negated(x), lambda d: text(F.lit(True), d)))))


# ---------------------------------------------------------------- arithmetic
@once
def _long_sum(a: Column, b: Column) -> Column:
    before = _padded(F.greatest(F.length(whole(a)), F.length(whole(b))))
    after = _padded(F.greatest(F.length(rest(a)), F.length(rest(b))))

    def limbs(x: Column, before: Column, after: Column) -> Column:
        digits = F.concat(F.lpad(whole(x), before, "0"), F.rpad(rest(x), after, "0"))
        return F.transform(_limbs(digits), lambda limb: F.when(negative(x), -limb).otherwise(limb))

    sizes = F.struct(before.alias("before"), after.alias("after"))
    return _let(sizes, lambda n: number_of(F.zip_with(limbs(a, n["before"], n["after"]), limbs(b, n["before"], n["after"]), lambda x, y: x + y), n["after"]))


@once
def _long_product(a: Column, b: Column) -> Column:
    def limbs(x: Column) -> Column:
        digits = F.concat(whole(x), rest(x))
        return F.reverse(_limbs(F.lpad(digits, _padded(F.length(digits)), "0")))

    def product(x: Column, y: Column) -> Column:
        def at(k: Column) -> Column:
            terms = F.transform(x, lambda limb, i: F.when((k >= i) & (k - i < F.size(y)), limb * F.get(y, k - i)).otherwise(F.lit(0).cast("long")))
            return F.aggregate(terms, F.lit(0).cast("long"), lambda s, t: s + t)

        return F.reverse(F.transform(F.sequence(F.lit(0), F.size(x) + F.size(y) - 1), at))

    sign = F.when(negative(a) != negative(b), -1).otherwise(1)
    made = lambda x, y: F.transform(product(x, y), lambda v: v * sign)
    scale = F.length(rest(a)) + F.length(rest(b))
    return _let(limbs(a), lambda x: _let(limbs(b), lambda y: number_of(made(x, y), scale)))


def _placed(minus: Column, digits: Column) -> Column:
    """The number of a quotient's digits."""

    def cut(q: Column) -> Column:
        return _signed(minus, _zeros_off(F.substring(q, F.lit(1), F.length(q) - QUOTIENT)), F.rtrim(F.substring(q, F.length(q) - QUOTIENT + 1, F.lit(QUOTIENT)), F.lit("0")))

    return _let(F.concat(F.repeat(F.lit("0"), QUOTIENT), digits), cut)


@once
def _long_quotient(a: Column, b: Column) -> Column:
    """Digit by digit, as by hand; null for a divisor of too many digits."""
    above, below = F.concat(whole(a), rest(a)), _zeros_off(F.concat(whole(b), rest(b)))
    # so many zeros more, or digits less, that the quotient ends at its last place
    above = F.rpad(above, F.length(above) + QUOTIENT + F.length(rest(b)) - F.length(rest(a)), "0")

    def one(acc: Column, digit: Column, by: Column) -> Column:
        here = (acc["left"] * 10).cast(WIDE) + digit.cast("decimal(1,0)")
        here = here.cast(WIDE)
        return F.struct((here % by).cast(WIDE).alias("left"), F.concat(acc["text"], F.call_function("div", here, by).cast("string")).alias("text"))

    start = F.struct(F.lit(0).cast(WIDE).alias("left"), F.lit("").alias("text"))
    divided = lambda by: F.aggregate(F.split(above, ""), start, lambda acc, digit: one(acc, digit, by))["text"]
    made = _let(below.try_cast(WIDE), lambda by: _placed(negative(a) != negative(b), divided(by)))
    return F.when((below != "") & (F.length(below) <= DIVISOR), made)


@once
def add(a: Column, b: Column) -> Column:
    short = "decimal(37,18)"
    fits = _fits(a, 18, 18) & _fits(b, 18, 18)
    return F.when(fits, plain((a.try_cast(short) + b.try_cast(short)).cast("string"))).otherwise(_long_sum(a, b))


@once
def negate(a: Column) -> Column:
    return _signed(~negative(a), whole(a), rest(a))


def subtract(a: Column, b: Column) -> Column:
    return add(a, negate(b))


@once
def multiply(a: Column, b: Column) -> Column:
    short = "decimal(18,9)"
    fits = _fits(a, 9, 9) & _fits(b, 9, 9)
    return F.when(fits, plain((a.try_cast(short) * b.try_cast(short)).cast("string"))).otherwise(_long_product(a, b))


@once
def divide(a: Column, b: Column) -> Column:
    """To 18 digits after the point, the rest cut off; null for a divisor that is zero or has more than 36 significant digits."""
    digits = lambda x: F.concat(whole(x), rest(x))
    places = F.lit(QUOTIENT) + F.length(rest(b)) - F.length(rest(a))
    fits = (places >= 0) & (F.length(digits(a)) + places <= 31) & (F.length(digits(b)) <= 31)
    above, below = F.concat(digits(a), F.repeat(F.lit("0"), places)).try_cast(WIDE), digits(b).try_cast(WIDE)
    quotient = ((above - above % below) / below).cast(WIDE).cast("string")
    return F.when(digits(b) != "", F.when(fits, _let(quotient, lambda q: _placed(negative(a) != negative(b), q))).otherwise(_long_quotient(a, b)))


#: Limbs of a sum: digits of each, and how many of them are before and after the point.
SUM_DIGITS, SUM_LIMBS = 15, 8


def total(text: Column) -> Column:
    """The sum of numbers of up to 120 digits on each side of the point; null if one has more or is null.

    Numbers of up to 19 and 9 digits are summed as decimals, others limb by limb, and both sums are carried once.
    """
    width, short = SUM_DIGITS * SUM_LIMBS, "decimal(28,9)"

    def parsed(x: Column) -> Column:
        fits = _fits(x, 19, 9)
        held = ~fits & (F.length(whole(x)) <= width) & (F.length(rest(x)) <= width)
        digits = F.concat(F.lpad(whole(x), width, "0"), F.rpad(rest(x), width, "0"))
        limb = lambda i: F.substring(digits, i * SUM_DIGITS + 1, F.lit(SUM_DIGITS)).cast("decimal(28,0)") * F.when(negative(x), F.lit(-1)).otherwise(1).cast("decimal(1,0)")
        limbs = F.when(held, F.transform(F.sequence(F.lit(0), F.lit(2 * SUM_LIMBS - 1)), lambda i: limb(i).cast("decimal(28,0)")))
        return F.struct(F.when(fits, x.try_cast(short)).alias("short"), limbs.alias("limbs"))

    one = _let(text, parsed)
    limbs = F.array(*[F.coalesce(F.try_sum(F.get(one["limbs"], F.lit(i))), F.lit(0)).cast(WIDE) for i in range(2 * SUM_LIMBS)])
    seen = F.struct(F.count(F.lit(1)).alias("rows"), F.count(one["short"]).alias("short"), F.count(one["limbs"]).alias("long"), F.try_sum(one["short"]).cast("string").alias("near"), limbs.alias("limbs"))

    def made(x: Column) -> Column:
        near = F.coalesce(x["near"], F.when(x["short"] == 0, "0"))
        long_ = number_of(x["limbs"], F.lit(width), 10**SUM_DIGITS, SUM_DIGITS, WIDE)
        return F.when(x["rows"] == x["short"] + x["long"], F.when(x["long"] == 0, plain(near)).otherwise(add(plain(near), long_)))

    return _let(seen, made)


@once
def absolute(a: Column) -> Column:
    return _signed(F.lit(False), whole(a), rest(a))


@once
def floor(a: Column) -> Column:
    """The largest whole number that is not above."""
    down = negative(a) & (rest(a) != "")
    cut = _signed(negative(a), whole(a), F.lit(""))
    return F.when(down, add(cut, F.lit("-1"))).otherwise(cut)


def ceil(a: Column) -> Column:
    return negate(floor(negate(a)))


def round_(a: Column) -> Column:
    """Halves go up, also below zero."""
    return floor(add(a, F.lit("0.5")))


@once
def truncate(a: Column) -> Column:
    return _signed(negative(a), whole(a), F.lit(""))
