"""Column functions: text to number, dates, names and plain arithmetic.

All of them are built from native expressions and return null, never NaN or
infinity, for input that has no answer.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PATTERN = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
#: Shapes of date text, in the order in which ties between them are settled.
DATE_SHAPES = {
    "slash": "d/M/yyyy[ H:mm[:ss]]",
    "dash": "d-M-yyyy[ H:mm[:ss]]",
    "iso": "yyyy-M-d[ H:mm[:ss]]",
}
#: Shapes of stamps without a zone, month before day where a text can be read both ways; None is Spark's own cast.
STAMP_SHAPES = {
    "iso": None,
    "month_slash": "M/d/yyyy[ H:mm[:ss]]",
    "day_slash": "d/M/yyyy[ H:mm[:ss]]",
    "month_half": "M/d/yyyy h:mm[:ss] a",
    "month_dash": "M-d-yyyy[ H:mm[:ss]]",
    "day_dash": "d-M-yyyy[ H:mm[:ss]]",
}
OFFSET_PATTERN = r"(?i)([zZ]|UTC|GMT|[+-]\d{1,2}(:?\d{2}){0,2})\s*$"


def column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """Text as double; text that is not a plain decimal number becomes null.

    A plain cast would read ``1d`` and ``NaN`` as numbers, hence the pattern.
    """
    text = column(c).cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def no_nan(c) -> Column:
    """The value with NaN turned into null, so that averages skip it."""
    value = column(c).cast("double")
    return F.when(~F.isnan(value), value)


def parse_dayfirst(c, shape="slash") -> Column:
    """Date text of one shape (see DATE_SHAPES) as a date; text of any other shape becomes null."""
    return F.to_date(F.try_to_timestamp(F.trim(column(c)), F.lit(DATE_SHAPES[shape])))


def commonest_shape(df, name, shapes, parse) -> str:
    """The shape that most values of a text column have; a column has one, as a file has one writer. Empty if none has any."""
    counts = df.agg(*[F.count(parse(name, shape)).alias(shape) for shape in shapes]).first()
    best = max(shapes, key=lambda shape: counts[shape])
    return best if counts[best] else ""


def date_shape(df, name) -> str:
    return commonest_shape(df, name, DATE_SHAPES, parse_dayfirst) or next(iter(DATE_SHAPES))


def in_shape(c, shape, shapes, parse, undecided=None) -> Column:
    """Text parsed in the shape that another column names; where that is empty by ``undecided``, or in any shape."""
    named = [F.when(column(shape) == s, parse(c, s)) for s in shapes]
    loose = undecided(c) if undecided else F.coalesce(*[parse(c, s) for s in shapes])
    return F.coalesce(*named, F.when(column(shape) == "", loose))


def try_stamp(c, shape) -> Column:
    """Not null where the text is a stamp of the shape."""
    text = F.trim(column(c))
    return F.try_to_timestamp(text, F.lit(STAMP_SHAPES[shape])) if STAMP_SHAPES[shape] else text.try_cast("timestamp_ntz")


def parse_strict(c, shape="iso") -> Column:
    """Timestamp without a zone, from text of one of STAMP_SHAPES; malformed text fails the job."""
    form = STAMP_SHAPES[shape]
    return F.to_timestamp_ntz(F.trim(column(c)), F.lit(form)) if form else column(c).cast("timestamp_ntz")


def parse_utc(c) -> Column:
    """Timestamp text as the naive UTC timestamp under any session zone; without an offset it is UTC already."""
    text = F.trim(column(c))
    instant = F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()).cast("timestamp_ntz")
    # A date alone ends in digits after a sign, but has no time.
    offset = text.contains(":") & text.rlike(OFFSET_PATTERN)
    return F.when(offset, instant).otherwise(text.try_cast("timestamp_ntz"))


def as_utc(df, name) -> Column:
    """A column of stamps of any type as naive UTC timestamps."""
    kind = df.schema[name].dataType.typeName()
    if kind == "string":
        return parse_utc(name)
    if kind == "timestamp":
        return F.to_utc_timestamp(F.col(name), F.current_timezone()).cast("timestamp_ntz")
    return F.col(name).cast("timestamp_ntz")


def trunc_day(c) -> Column:
    return F.to_date(column(c))


def iso_week_year(c, iso_year=False):
    """(year, ISO week). The year is the calendar one unless ``iso_year`` is set.

    With the calendar year, 2024-12-30 falls into week 1 of 2024.
    """
    day = column(c)
    year = F.extract(F.lit("YEAROFWEEK"), day) if iso_year else F.year(day)
    return year.cast("int"), F.weekofyear(day).cast("int")


def month_weekday(c):
    """(month 1..12, weekday with Monday as 0)."""
    return F.month(column(c)), F.weekday(column(c))


def month_day_key(c) -> Column:
    """Month and day as ``MM-dd`` text, the key that lines up two years."""
    return F.date_format(column(c), "MM-dd")


def date_plus(c, n) -> Column:
    return F.date_add(column(c), n)


def norm_name(c) -> Column:
    """Trimmed name with a capital after every non-letter: ``d'ávila`` -> ``D'Ávila``."""
    runs = F.regexp_extract_all(F.trim(column(c)), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def fill_group_mean(c, mean) -> Column:
    return F.coalesce(column(c), column(mean))


def row_mean(*cols) -> Column:
    """Mean of the columns that are not null; null when all are."""
    values = [column(c) for c in cols]
    total = reduce(Column.__add__, [F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])
    present = reduce(Column.__add__, [v.isNotNull().cast("int") for v in values])
    return F.try_divide(total, present)


def pct_change(base, new) -> Column:
    """Change from ``base`` to ``new`` in percent; null for a zero base."""
    return F.try_divide(column(new) - column(base), column(base)) * 100


def cast_class(c) -> Column:
    return column(c).cast("int")


def abs_sqrt(c):
    """(absolute value, square root of it)."""
    size = F.abs(column(c))
    return size, F.sqrt(size)
