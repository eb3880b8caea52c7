"""Scalar building blocks as Column builders: digits, wraps, calendar, moon, money, fields, operations, set extractors.

All values that fields yield are >= 0, so signs of remainders don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOON, NEW_MOON = 29.53, "2000-01-06"
#: Days of the moon's age at which its phase changes.
PHASES = ((1.85, "nova"), (9.23, "crescente"), (16.61, "cheia"), (23.99, "minguante"))


def wrap(v: Column, m: Column | int) -> Column:
    """v into 1..m: remainder, with m for 0."""
    m = F.lit(m) if isinstance(m, int) else m
    return F.coalesce(F.nullif(F.pmod(v.cast("long"), m.cast("long")), F.lit(0).cast("long")), m.cast("long")).cast("int")


def mask(nums: Column) -> Column:
    """Numbers of 0..62 as bits of a 64-bit word."""
    return F.aggregate(nums, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x)))


#: Planes of bit-sliced counters: 63 is the largest count.
PLANES = 6


def tally_bits(masks: Column) -> Column:
    """How many of the words hold each bit, for all 64 bits at once: element j of the array is bit j of every count."""

    def add(planes: Column, word: Column) -> Column:
        out, carry = [], word
        for j in range(PLANES):
            out.append(planes[j].bitwiseXOR(carry))
            carry = planes[j].bitwiseAND(carry)
        return F.array(*out)

    return F.aggregate(masks, F.array(*[F.lit(0).cast("long")] * PLANES), add)


def age_bits(masks: Column) -> Column:
    """How many words ago, counted from the last one, each bit was set (elements as in tally_bits); the last element holds the bits that were set at all."""

    def step(state: Column, word: Column) -> Column:
        out, carry = [], F.lit(-1).cast("long")
        for j in range(PLANES):
            out.append(state[j].bitwiseXOR(carry).bitwiseAND(F.bitwise_not(word)))
            carry = state[j].bitwiseAND(carry)
        return F.array(*out, state[PLANES].bitwiseOR(word))

    return F.aggregate(masks, F.array(*[F.lit(0).cast("long")] * (PLANES + 1)), step)


def bit_of(word: Column, n: Column) -> Column:
    return F.getbit(word, n).cast("int")


def seen_bit(ages: Column, n: Column) -> Column:
    """Whether bit n was set in any word that age_bits saw."""
    return bit_of(ages[PLANES], n) == 1


def count_of(planes: Column, n: Column) -> Column:
    """The count of bit n."""
    return sum((bit_of(planes[j], n) * (1 << j) for j in range(1, PLANES)), bit_of(planes[0], n))


def digits_reversed(v: Column) -> Column:
    """The digits in reverse order, of at least two digits."""
    s = F.abs(v).cast("string")
    return F.reverse(F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s)).cast("long")


def reversed_or_null(v: Column) -> Column:
    """As digits_reversed, null for 0."""
    return F.nullif(digits_reversed(v), F.lit(0).cast("long"))


def digit_sum(v: Column) -> Column:
    """The sum of the decimal digits of a whole number, its sign left aside."""
    x = F.abs(v.cast("long"))
    return sum((F.call_function("div", x, F.lit(10**k)) % 10 for k in range(1, 19)), x % 10)


def date_text(date: Column, form: str = "ymd") -> Column:
    """A date as 2000-01-31 (ymd) or 31/01/2000 (dmy); a year of more than four digits has no sign, as date_format would give it."""
    year, month, day = F.year(date), F.month(date), F.day(date)
    text = F.format_string("%04d-%02d-%02d", year, month, day) if form == "ymd" else F.format_string("%02d/%02d/%04d", day, month, year)
    return F.when(date.isNotNull(), text)


def date_of(text: Column) -> Column:
    """The date of 31/01/2000, also with a year of more than four digits, which to_date does not read."""
    part = lambda i: F.get(F.split(text, "/"), F.lit(i)).cast("int")
    return F.when(F.rlike(text, F.lit(r"^\d{1,2}/\d{1,2}/\d{5,6}$")), F.make_date(part(2), part(1), part(0))).otherwise(F.to_date(text, "dd/MM/yyyy"))


def moon_age(date: Column) -> Column:
    return F.pmod(F.date_diff(date, F.lit(NEW_MOON).cast("date")).cast("double"), F.lit(MOON))


def moon_phase(date: Column) -> Column:
    out, age = F.lit("nova"), moon_age(date)
    for end, name in reversed(PHASES):
        out = F.when(age < end, name).otherwise(out)
    return out


def state_of(place: Column) -> Column:
    """What follows the last comma, trimmed; empty without a comma."""
    return F.when(F.contains(place, F.lit(",")), F.trim(F.element_at(F.split(place, ","), -1))).otherwise("")


def within(values: Column, m: Column | int) -> Column:
    """Distinct values of an array that lie in 1..m, as ints."""
    m = F.lit(m) if isinstance(m, int) else m
    return F.array_distinct(F.transform(F.filter(values, lambda v: v.isNotNull() & (v >= 1) & (v <= m)), lambda v: v.cast("int")))


def money_digits(v: Column, m: Column | int) -> Column:
    """Single digits and adjacent pairs of digits of the whole part that lie in 1..m; none for v <= 0."""
    s = v.cast("long").cast("string")
    ones = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)).cast("int"))
    twos = F.when(F.length(s) > 1, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(v > 0, within(F.concat(ones, twos), m)).otherwise(F.array().cast("array<int>"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def fields() -> dict[str, Column]:
    """The 16 numbers that hypotheses start from, in registry order; 0 where there is no draw before."""
    prev, prev2, data = F.col("prev"), F.col("prev2"), F.col("data")
    some = F.size(F.coalesce(prev, F.array().cast("array<int>"))) > 0
    of_prev = lambda c: _or0(F.when(some, c))
    money = F.col("valor_estimado")
    out = {
        "dia": F.day(data), "mes": F.month(data), "ano2d": F.year(data) % 100, "dia_ano": F.dayofyear(data), "semana": F.weekofyear(data),
        "conc": F.col("numero"), "conc100": F.col("numero") % 100,
        "soma_prev": of_prev(_sum(prev)), "amp_prev": of_prev(F.array_max(prev) - F.array_min(prev)), "max_prev": of_prev(F.array_max(prev)), "min_prev": of_prev(F.array_min(prev)),
        "media_prev": of_prev(F.rint(_sum(prev) / F.size(prev))), "pares_prev": of_prev(F.size(F.filter(prev, lambda x: x % 2 == 0))),
        "rep_count": of_prev(F.when(prev2.isNotNull(), F.size(F.array_intersect(prev, prev2)))),
        "lua": F.floor(moon_age(data)), "premio_mag": F.when(money > 0, F.log10(money).cast("int")).otherwise(0),
    }
    return {k: _or0(v) for k, v in out.items()}


#: Field names in registry order; pairs of fields follow it.
FIELDS = ("dia", "mes", "ano2d", "dia_ano", "semana", "conc", "conc100", "soma_prev", "amp_prev", "max_prev", "min_prev", "media_prev", "pares_prev", "rep_count", "lua", "premio_mag")

UNARY = {
    "id": lambda v: v,
    "mod10": lambda v: v % 10,
    "mod7": lambda v: v % 7,
    "inv": digits_reversed,
    "dsum": digit_sum,
    "sqrt": lambda v: F.when(v > 0, F.floor(F.sqrt(v.cast("double")))).otherwise(0),
    "log2": lambda v: F.when(v > 0, F.length(F.bin(v)) - 1).otherwise(0),  # exact at powers of two
    "x2": lambda v: v * 2,
    "half": lambda v: F.floor(v / 2),
}
BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: F.abs(a - b),
    "mul": lambda a, b: a * b,
    "xor": lambda a, b: a.bitwiseXOR(b),
    "mod": lambda a, b: F.when(b != 0, F.try_mod(a, b)).otherwise(0),
}


def _steps(prev: Column, f) -> Column:
    """f of each pair of neighbours of an array."""
    n = F.size(prev)
    return F.when(n > 1, F.zip_with(F.slice(prev, 1, n - 1), F.slice(prev, 2, n - 1), f)).otherwise(F.array().cast("array<int>"))


def extractors(m: Column) -> dict[str, Column]:
    """The nine set extractors: arrays of ints in 1..m, empty where their draw is missing."""
    none = F.array().cast("array<int>")
    prev, prev2 = F.coalesce("prev", none), F.coalesce("prev2", none)
    domain = F.sequence(F.lit(1), m)
    near = F.flatten(F.transform(prev, lambda d: F.array(d - 1, d + 1)))
    return {
        "prev": within(prev, m),
        "prev_viz": F.array_except(within(near, m), prev),
        "prev_esp": within(F.transform(prev, lambda d: digits_reversed(d)), m),
        "prev_comp": within(F.transform(prev, lambda d: m + 1 - d), m),
        "prev_gaps": within(_steps(prev, lambda a, b: b - a), m),
        "prev_xor": within(_steps(prev, lambda a, b: a.bitwiseXOR(b)), m),
        "prev_soma2": within(_steps(prev, lambda a, b: wrap(a + b, m)), m),
        "ausentes2": F.when(F.col("prev2").isNotNull(), F.array_except(F.array_except(domain, prev), prev2)).otherwise(none),
        "prev2": within(prev2, m),
    }


SETS = ("prev", "prev_viz", "prev_esp", "prev_comp", "prev_gaps", "prev_xor", "prev_soma2", "ausentes2", "prev2")
