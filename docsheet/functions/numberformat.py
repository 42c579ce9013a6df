"""Number formats of sheet cells: values as text by format code.

Code bytes are twice the position in ``FORMATS``; unknown ones count as general. Dates are days since 1899-12-31 with the time of day as fraction.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import formula as X

#: Names in the order of their codes (fixed values), with the pattern of dates and times.
FORMATS = (
    ("general", None), ("fixeddecimal", None), ("scientific", None), ("currency", None), ("percent", None), ("triads", None), ("boolean", None), ("text", None),
    ("date_dmm", "d/MM"), ("date_mmd", "MM/d"), ("date_ddmmyy", "dd/MM/yy"), ("date_mmddyy", "MM/dd/yy"), ("date_yymmdd", "yy/MM/dd"), ("date_dmmm", "d-MMM"), ("date_dmmmyy", "d-MMM-yy"), ("date_ddmmmyy", "dd-MMM-yy"),
    ("date_mmm", "MMM"), ("date_monthname", "MMMM"), ("date_mmmyy", "MMM-yy"), ("date_monthnameyy", "MMMM-yy"), ("date_monthnamedyyyy", "MMMM d, yyyy"),
    ("datetime_ddmmyyyyhhii", "dd/MM/yyyy hh:mm a"), ("datetime_ddmmyyyyHHii", "dd/MM/yyyy HH:mm"), ("datetime_mmddyyyyhhii", "MM/dd/yyyy hh:mm a"), ("datetime_mmddyyyyHHii", "MM/dd/yyyy HH:mm"), ("datetime_yyyymmddhhii", "yyyy/MM/dd hh:mm a"), ("datetime_yyyymmddHHii", "yyyy/MM/dd HH:mm"),
    ("time_hhii", "hh:mm a"), ("time_hhiiss", "hh:mm:ss a"), ("time_HHii", "HH:mm"), ("time_HHiiss", "HH:mm:ss"),
)


def code_of(byte: Column) -> Column:
    """Position of the format of a code byte."""
    return F.when((byte % 2 == 0) & (byte >= 0) & (byte < 2 * len(FORMATS)), (byte / 2).cast("int")).otherwise(0)


def decimals_of(byte: Column) -> Column:
    return F.shiftright(byte, 1)


def moment(serial: Column) -> Column:
    """The time of a serial day number, to the second."""
    return F.timestamp_seconds(F.round((serial - X.EPOCH_DAYS) * 86400).cast("long"))


def render(value: Column, code: Column, decimals: Column, currency: str = "$") -> Column:
    """``value`` (a number) as text in the format of position ``code``."""
    digits = lambda pattern, x: F.call_function("printf", F.concat(F.lit(pattern[:-1] + "."), decimals.cast("string"), F.lit(pattern[-1])), x)
    whole = value == F.floor(value)
    out = F.when(value.isNull(), None)
    out = out.when(code == 1, digits("%f", value)).when(code == 2, digits("%E", value))
    out = out.when(code == 3, F.concat(F.when(value < 0, "-").otherwise(""), F.lit(currency), digits("%,f", F.abs(value)))).when(code == 4, F.concat(digits("%f", value * 100), F.lit("%")))
    out = out.when(code == 5, digits("%,f", value)).when(code == 6, F.upper((value != 0).cast("string")))
    for k, (_, pattern) in enumerate(FORMATS):
        if pattern:
            out = out.when(code == k, F.date_format(moment(value), pattern))
    return out.otherwise(F.when(whole & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(value.cast("string")))
