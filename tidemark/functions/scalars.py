"""Scalar expressions used all over: strict parsing, value states, keys, names, instants."""

from __future__ import annotations

import sys
import unicodedata
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# The states a value can carry.
VALUE, GENUINE_ZERO, UNAVAILABLE, FAILED = "value", "genuine_zero", "source_unavailable", "acquisition_failure"
STATES = (VALUE, GENUINE_ZERO, UNAVAILABLE, FAILED)

def _decomposed() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters and digits whose compatibility decomposition, without marks, is another: the single ones, what they become, and those that become several."""
    single, several = {}, []
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        if not (c.isalnum() or unicodedata.combining(c)) or 0xAC00 <= code <= 0xD7A3:  # Hangul syllables fall into parts by a rule of their own
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        if base != c.casefold() or base != c.lower():
            if len(base) == 1:
                single[c] = base
            elif base:
                several.append((c, base))
    return "".join(single), "".join(single.values()), several


#: Made once from the standard library's tables: Spark has no decomposition.
ACCENTED, BASE, LIGATURES = _decomposed()


def strict_integer(text: Column) -> Column:
    """``+5`` and ``-5`` are integers, ``5.0``, ``05`` and blanks are not; those give NULL."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^[+]?(0|-?[1-9][0-9]*)$"), F.regexp_replace(trimmed, r"^[+]", "").try_cast("long"))


def strict_number(text: Column) -> Column:
    """A finite decimal number; anything else gives NULL."""
    trimmed = F.trim(text)
    number = F.when(trimmed.rlike(r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"), trimmed.try_cast("double"))
    return F.when(is_finite(number), number)


def strict_boolean(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("1", "true"), True).when(low.isin("0", "false"), False)


def unreadable(text: Column, parsed: Column) -> Column:
    """There was input, but it didn't parse."""
    return text.isNotNull() & (F.trim(text) != "") & parsed.isNull()


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def utc_instant(text: Column, *, convert: bool = False) -> Column:
    """ISO 8601 with an offset. Another offset than zero gives NULL, or is converted."""
    zero = text.rlike(r"(Z|[+-]00:?00)$")
    offset = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(offset if convert else zero, F.try_to_timestamp(text))


def value_state(value: Column, available: Column) -> Column:
    """The state of a raw value: never make a missing one into zero."""
    return F.when(~available | value.isNull(), UNAVAILABLE).when(value == 0, GENUINE_ZERO).otherwise(VALUE)


def state_violation(value: Column, state: Column) -> Column:
    """What is wrong with a value and its state, or NULL."""
    return (
        F.when(state.isNull() | ~state.isin(*STATES), "unknown state")
        .when(state.isin(UNAVAILABLE, FAILED) & value.isNotNull(), "missing state with a value")
        .when((state == GENUINE_ZERO) & (value.isNull() | (value != 0)), "genuine_zero isn't 0")
        .when((state == VALUE) & value.isNull(), "value is missing")
        .when((state == VALUE) & (value == 0), "zero must be genuine_zero")
    )


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """RFC 4122 version 5 identifier of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 8, 10, 16))
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *parts)


def plain_name(name: Column) -> Column:
    """Case-folded, decomposed, without marks; everything but letters, digits and underscores is one space."""
    several = F.create_map(*(F.lit(x) for pair in LIGATURES for x in pair))
    kinds = "".join(c for c, _ in LIGATURES)
    # Translating looks letters up by hash; a pattern or map of all of them would be gone through for each letter of a name.
    spelled = F.array_join(F.transform(F.split(name, ""), lambda c: F.when(F.translate(c, kinds, "") != c, several[c]).otherwise(c)), "")
    whole = F.when(F.translate(name, kinds, "") != name, spelled).otherwise(name)
    base = F.regexp_replace(F.translate(F.lower(F.translate(whole, ACCENTED, BASE)), ACCENTED, BASE), r"\p{M}", "")
    return F.trim(F.regexp_replace(base, r"[^\p{L}\p{N}_]+", " "))


def period_ordinal(first_year: Column, period: Column, periods: int) -> Column:
    """Consecutive numbers of periods across eras."""
    return first_year * periods + period - 1


def safe_ratio(a: Column, b: Column) -> Column:
    """NULL where the divisor is zero."""
    return a / F.nullif(b, F.lit(0).cast("double"))
