"""Column functions of the cleaning steps. NULL is the only missing value; rounding is to the
even neighbour; nothing raises on malformed input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that mean "unknown", as text and as numbers.
UNKNOWN_TEXT = ("Unknown", "unknown", "-4", "9999.0", "9999")
UNKNOWN_NUMBERS = (-4, 9999)

#: Recode tables, by text and by number.
GENDER = {"female": 0, "male": 1}
GENDER_CODES = {1: 1, 2: 0}
MARITAL = {"married": 1, "divorced": 2, "widowed": 3, "never married": 0}
MARITAL_CODES = {1: 1, 2: 2, 3: 3, 4: 0}
ETHNICITY = {"not": 0, "hisp": 1}
ETHNICITY_CODES = {1: 1, 2: 0}
RACE = {"white": 5, "black": 4, "pacific": 3, "asian": 2, "native": 1, "multiple": 0}
RACE_CODES = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0}
DIAGNOSIS = {"CN": 0, "MCI": 1, "Dementia": 2}
DIAGNOSIS_CODES = {1: 0, 2: 1, 3: 2}
#: Days in a month.
MONTH_DAYS = 30.44


def unknown_to_null(c: Column, kind: str, extra: Sequence[object] = ()) -> Column:
    """Unknown tokens become NULL. kind: the column's Spark type name."""
    if kind == "string":
        return F.when(~c.isin([*UNKNOWN_TEXT, *map(str, extra)]), c)
    numbers = [*UNKNOWN_NUMBERS, *[x for x in extra if isinstance(x, int | float)]]
    return F.when(~c.isin(numbers), c)


def recode(c: Column, table: Mapping[object, int]) -> Column:
    """Exact mapping; anything else is NULL."""
    out = None
    for k, v in table.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out.cast("int")


def recode_text(c: Column, table: Mapping[object, str]) -> Column:
    """Exact mapping to text (such as quality codes); anything else is NULL."""
    out = None
    for k, v in table.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out


def non_negative(c: Column) -> Column:
    """Whole numbers from 0 (such as years of education); others are NULL."""
    n = c.cast("double")
    return F.when((n >= 0) & ~F.isnan(n), n.cast("int"))


def both_sides(left: Column, right: Column) -> Column:
    """The sum of left and right volumes, NULL if one is."""
    return left + right


def recode_contains(c: Column, table: Mapping[str, int]) -> Column:
    """The first key that the lower-cased text contains."""
    out = None
    for k, v in table.items():
        hit = F.contains(F.lower(c), F.lit(k.lower()))
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return out.cast("int")


def visit_code_number(c: Column) -> Column:
    """bl is 0, mNN is NN, digits are themselves; other codes are NULL."""
    code = F.lower(F.trim(c))
    return (
        F.when(code == "bl", F.lit(0))
        .when(code.rlike(r"^m\d+$"), F.substring(code, 2, 9).try_cast("int"))
        .when(code.rlike(r"^\d+$"), code.try_cast("int"))
    )


def to_date(c: Column) -> Column:
    return F.try_to_timestamp(c.cast("string")).cast("date")


def whole_months(start: Column, end: Column) -> Column:
    """Full calendar months from start to end, the day clipped to the month's length."""
    m = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return m - F.when(F.add_months(start, m) > end, 1).otherwise(0)


def age_from_birth(exam: Column, birth: Column) -> Column:
    """Age in whole years, rounded from whole months."""
    return F.bround(whole_months(birth, exam) / F.lit(12.0)).cast("int")


def age(
    exam: Column | None = None, birth: Column | None = None, birth_year: Column | None = None,
    age_baseline: Column | None = None, baseline: Column | None = None, months: Column | None = None,
) -> Column:
    """The first rule whose inputs are given: birth date, birth year, baseline age plus the time
    since baseline, baseline age plus visit months."""
    rules = []
    if exam is not None and birth is not None:
        rules.append(age_from_birth(exam, birth).cast("double"))
    if exam is not None and birth_year is not None:
        rules.append((F.year(exam) - birth_year).cast("double"))
    if age_baseline is not None and exam is not None and baseline is not None:
        rules.append(F.bround(age_baseline + whole_months(baseline, exam) / F.lit(12.0), 1))
    if age_baseline is not None and months is not None:
        rules.append(age_baseline + months / F.lit(12.0))
    return F.coalesce(*rules)


def genotype(c: Column, sep: str = "/") -> Column:
    """eAeB of a two-allele text: split at sep, or in halves where there is none."""
    text = F.trim(c)
    half = (F.length(text) / 2).cast("int")
    has = F.contains(text, F.lit(sep))
    left = F.when(has, F.get(F.split(text, sep), F.lit(0))).otherwise(F.substring(text, F.lit(1), half))
    right = F.when(has, F.get(F.split(text, sep), F.lit(1))).otherwise(F.substring(text, half + 1, F.length(text)))
    return F.concat(
        F.lit("e"), F.regexp_replace(left, r"\D", ""), F.lit("e"), F.regexp_replace(right, r"\D", "")
    )


def count_char(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char)))


def profile_flag(c: Column, letter: str) -> Column:
    """1 for X+, 0 for X-, else NULL."""
    return F.when(F.contains(c, F.lit(letter + "+")), 1).when(F.contains(c, F.lit(letter + "-")), 0)


def two_bit(c: Column) -> tuple[Column, Column]:
    """High and low bit of a class 0 to 3."""
    n = c.try_cast("int")
    ok = n.between(0, 3)
    return F.when(ok, F.shiftright(n, 1)), F.when(ok, n.bitwiseAND(1))


def profile_text(flags: Mapping[str, Column]) -> Column:
    """A+T- from flags; anything but 1 reads as minus."""
    return F.concat(*[F.when(c == 1, F.lit(k + "+")).otherwise(F.lit(k + "-")) for k, c in flags.items()])


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent_of(a: Column, whole: Column) -> Column:
    return safe_divide(a, whole) * 100


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, r"([0-9.]+)", 1).try_cast("double")


#: Method labels by exact phrase, then by the first part that is contained.
METHOD_PHRASES = {"single molecule array": "simoa", "electrochemiluminescence": "elecsys"}
METHOD_PARTS = (
    ("lumipulse", "lumipulse"), ("elecsys", "elecsys"), ("roche", "elecsys"), ("ftp", "ftp"), ("fbb", "fbb"),
    ("nav", "nav"), ("fbp", "fbp"), ("simoa v2", "simoa v2"), ("simoa", "simoa"),
)


def method_label(
    c: Column, default: str, phrases: Mapping[str, str] = METHOD_PHRASES, parts: Sequence[tuple[str, str]] = METHOD_PARTS
) -> Column:
    text = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    out = None
    for k, v in phrases.items():
        out = F.when(text == k, v) if out is None else out.when(text == k, v)
    for k, v in parts:
        hit = F.contains(text, F.lit(k))
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return F.coalesce(out, F.lit(default))


def clip01(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)))


def normalize_range(
    c: Column, low: Column, high: Column, inverse: bool = False, clip: bool = True, equal: float | None = None
) -> Column:
    """(c - low) / (high - low), flipped if inverse, cut to [0, 1] if clip; where the bounds are
    equal the value of `equal`, NULL by default."""
    x = F.try_divide(c.cast("double") - low, high - low)
    x = 1 - x if inverse else x
    if equal is not None:
        x = F.when(c.isNotNull() & (low == high), F.lit(equal)).otherwise(x)
    return clip01(x) if clip else x


def denormalize_range(c: Column, low: Column, high: Column, inverse: bool = False, rounded: bool = True) -> Column:
    """Back to the scale. Rounded scales: increasing ones to the even neighbour, inverse ones
    down up to a half and up beyond."""
    if inverse:
        x = high - c * (high - low)
        return F.when(x - F.floor(x) <= 0.5, F.floor(x)).otherwise(F.ceil(x)).cast("long") if rounded else x
    x = low + c * (high - low)
    return F.bround(x).cast("long") if rounded else x


def bool_like(c: Column) -> Column:
    text = F.lower(F.trim(c.cast("string")))
    return (
        F.when(text.isin("true", "t", "yes", "y", "1", "1.0"), 1).when(text.isin("false", "f", "no", "n", "0", "0.0"), 0)
    )


def step_grid(month: Column, step: int) -> Column:
    """The nearest multiple of step; the half-way point goes down."""
    rest = month % step
    return (F.floor(month / step) * step + F.when(rest > step / 2, step).otherwise(0)).cast("long")


def reparametrized_time(t: Column, xi: Column, tau: Column, tau_mean: Column) -> Column:
    """psi = exp(xi) (t - tau) + mean tau."""
    return F.exp(xi) * (t - tau) + tau_mean
