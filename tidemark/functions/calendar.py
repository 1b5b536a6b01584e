"""Calendar functions: wall-clock times, buckets, months of life, dates and ages in five languages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CADENCES = ("day", "week", "month", "birthday-month", "all")


def iso_week_day(year: Column, week: Column, day: Column) -> Column:
    """The date of a day (1 Monday to 7) in an ISO week, null where the year has no such week."""
    first = F.make_date(year, F.lit(1), F.lit(4))  # always in week 1
    monday = F.date_add(F.date_sub(first, F.weekday(first)), (week - 1) * 7)
    there = (week >= 1) & (F.year(F.date_add(monday, 3)) == year) & day.between(1, 7)
    return F.when(there, F.date_add(monday, day - 1))


#: ISO dates: with hyphens, without, and by week with or without a day. What follows is one separator and a time.
_HYPHENS, _COMPACT, _WEEK = r"^(\d{4}-\d{2}-\d{2})(?!\d)", r"^(\d{4})(\d{2})(\d{2})(?!\d)", r"^(\d{4})(-?)W(\d{2})(?:\2([1-7]))?(?![0-9])"
#: A time in digits alone or with colons, with or without a fraction and a zone.
_CLOCK = r"^(\d{2})(?::?(\d{2}))?(?::?(\d{2}))?(?:[.,](\d+))?(?:[+-]\d{2}(?::?\d{2}){0,2})?$"
#: Dates and times whose numbers may lack leading zeros, at most 26 characters of them.
_LOOSE = r"^\d{4}-\d{1,2}-\d{1,2}(?:T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?)?$"


def parse_when(text: Column) -> Column:
    """The wall-clock time of a text (its zone is dropped, not applied), null if it has none.

    Dates are 2026-03-14, 20260314, 2026-W11-6, 2026W116 or a week's Monday as 2026-W11; times follow after any one character, as
    09, 09:30, 0930, 09:30:00.5 or 093000. Hyphenated dates and times may lack leading zeros.
    """
    clean = F.regexp_replace(F.trim(text), "Z", "+00:00")
    part = lambda pattern, n: F.regexp_extract(clean, pattern, n)
    number = lambda pattern, n: part(pattern, n).try_cast("int")
    by_week = iso_week_day(number(_WEEK, 1), number(_WEEK, 3), F.coalesce(number(_WEEK, 4), F.lit(1)))
    date = F.when(clean.rlike(_HYPHENS), part(_HYPHENS, 1).try_cast("date")).when(clean.rlike(_COMPACT), F.concat_ws("-", *(part(_COMPACT, n) for n in (1, 2, 3))).try_cast("date")).when(clean.rlike(_WEEK), by_week)
    rest = F.substring(clean, F.length(F.coalesce(*(F.nullif(part(p, 0), F.lit("")) for p in (_HYPHENS, _COMPACT, _WEEK)))) + 1, F.length(clean))
    clock = F.substring(rest, F.lit(2), F.length(rest))
    two = lambda n: F.coalesce(F.nullif(F.regexp_extract(clock, _CLOCK, n), F.lit("")), F.lit("00"))
    micros = F.rpad(F.substring(F.regexp_extract(clock, _CLOCK, 4), 1, 6), 6, "0")
    at = F.when(rest == "", "00:00:00").when(clock.rlike(_CLOCK), F.concat(two(1), F.lit(":"), two(2), F.lit(":"), two(3), F.lit("."), micros))
    head = F.substring(clean, 1, 26)
    return F.coalesce(F.concat(date.cast("string"), F.lit(" "), at).try_cast("timestamp_ntz"), F.when(head.rlike(_LOOSE), head.try_cast("timestamp_ntz")))


def as_date(text: Column) -> Column:
    head = F.substring(text, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def months_since(birth: Column, when: Column) -> Column:
    """Whole months of life: a month counts from the day of birth on; negative before birth."""
    return 12 * (F.year(when) - F.year(birth)) + F.month(when) - F.month(birth) - (F.dayofmonth(when) < F.dayofmonth(birth)).cast("int")


def birthday_month_start(birth: Column, index: Column) -> Column:
    """The first day of a month of life; the 1st of the following month where a month lacks the day of birth."""
    months = 12 * F.year(birth) + F.month(birth) - 1 + index
    first = F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
    there = F.dayofmonth(birth) <= F.dayofmonth(F.last_day(first))
    return F.when(there, F.date_add(first, F.dayofmonth(birth) - 1)).otherwise(F.date_add(F.last_day(first), 1))


def bucket(when: Column, cadence: str, birth: Column | None = None) -> Column:
    """The label of the bucket that a time falls into."""
    if cadence not in CADENCES:
        raise ValueError(f"cadence must be one of {CADENCES}")
    if cadence == "birthday-month":
        if birth is None:
            raise ValueError("birthday-month needs a birth date")
        return F.date_format(birthday_month_start(birth, months_since(birth, when)), "yyyy-MM-dd")
    if cadence == "week":
        return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), when).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(when).cast("string"), 2, "0"))
    return F.date_format(when, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "all": "yyyy-MM-dd'T'HH:mm:ss"}[cadence])


#: Names of months, long and short; thousands separator; what joins years and months; one and many of day, month, year.
LANGUAGES = {
    "en": {
        "months": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
        "short": ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
        "group": ",", "join": ", ", "day": ("day", "days"), "month": ("month", "months"), "year": ("year", "years"),
    },
    "de": {
        "months": ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
        "short": ("Jan", "Feb", "Mär", "Apr", "Mai", "Jun", "Jul", "Aug", "Sep", "Okt", "Nov", "Dez"),
        "group": ".", "join": ", ", "day": ("Tag", "Tage"), "month": ("Monat", "Monate"), "year": ("Jahr", "Jahre"),
    },
    "fr": {
        "months": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
        "short": ("janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc."),
        "group": " ", "join": ", ", "day": ("jour", "jours"), "month": ("mois", "mois"), "year": ("an", "ans"),
    },
    "es": {
        "months": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
        "short": ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic"),
        "group": ".", "join": " y ", "day": ("día", "días"), "month": ("mes", "meses"), "year": ("año", "años"),
    },
    "it": {
        "months": ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"),
        "short": ("gen", "feb", "mar", "apr", "mag", "giu", "lug", "ago", "set", "ott", "nov", "dic"),
        "group": ".", "join": " e ", "day": ("giorno", "giorni"), "month": ("mese", "mesi"), "year": ("anno", "anni"),
    },
}


def language(code: str) -> dict:
    if code not in LANGUAGES:
        raise ValueError(f"language must be one of {sorted(LANGUAGES)}")
    return LANGUAGES[code]


def format_date(when: Column, pattern: str, code: str) -> Column:
    """A date by the tokens YYYY YY MMMM MMM MM DD D; all else is copied. The pattern is read once, on the driver."""
    month = lambda names: F.element_at(F.array(*map(F.lit, language(code)[names])), F.month(when))
    tokens = {"YYYY": lambda: F.lpad(F.year(when).cast("string"), 4, "0"), "YY": lambda: F.lpad((F.year(when) % 100).cast("string"), 2, "0"), "MMMM": lambda: month("months"), "MMM": lambda: month("short"), "MM": lambda: F.lpad(F.month(when).cast("string"), 2, "0"), "DD": lambda: F.lpad(F.dayofmonth(when).cast("string"), 2, "0"), "D": lambda: F.dayofmonth(when).cast("string")}
    parts = [x for x in re.split(r"(YYYY|YY|MMMM|MMM|MM|DD|D)", pattern) if x]
    return F.concat(*(tokens[x]() if x in tokens else F.lit(x) for x in parts))


def counted(n: Column, unit: str, code: str) -> Column:
    """A number and its unit, in the singular for 1 alone, with thousands grouped."""
    one, many = language(code)[unit]
    digits = F.replace(F.format_number(n.cast("bigint"), 0), F.lit(","), F.lit(language(code)["group"]))
    return F.concat(digits, F.lit(" "), F.when(n == 1, one).otherwise(many))


def age_text(birth: Column, when: Column, granularity: str, code: str) -> Column:
    """Age as off, days, months or year_months; empty before birth. Under a month, days; parts of zero are left out."""
    days, months = F.datediff(when, birth), months_since(birth, when)
    in_days = counted(days, "day", code)
    if granularity == "off":
        return F.lit("")
    if granularity == "days":
        told = in_days
    elif granularity == "months":
        told = F.when(months < 1, in_days).otherwise(counted(months, "month", code))
    elif granularity == "year_months":
        years, rest = F.floor(months / 12), F.pmod(months, F.lit(12))
        parts = F.concat_ws(language(code)["join"], F.when(years > 0, counted(years, "year", code)), F.when(rest > 0, counted(rest, "month", code)))
        told = F.when(months < 1, in_days).otherwise(parts)
    else:
        raise ValueError(f"unknown granularity {granularity!r}")
    return F.when(days < 0, "").otherwise(told)


def date_prefix(text: Column) -> Column:
    """The date that a time as text begins with; empty for none."""
    return F.substring(F.coalesce(text, F.lit("")), 1, 10)


def iso_z(when: Column) -> Column:
    """A UTC time as text with literal zero milliseconds."""
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'.000Z'")


def watermark_for(started: Column, skew_seconds: int = 60) -> Column:
    """What a run that started then may store: a little earlier, so that nothing in between is lost."""
    return iso_z(started - F.expr(f"interval {skew_seconds} seconds"))
