"""Canonical JSON and hashes of entries: strings composed (NFC), keys sorted, numbers in their shortest form.

The engine has no function that composes strings or sorts the keys of arbitrary JSON, so
these run on Arrow batches of JSON texts.
"""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: float) -> str:
    """A number as JavaScript writes it."""
    if isinstance(x, int) and abs(x) < 1 << 53:
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("no JSON number")
    if x == 0:
        return "0"
    sign, (digits, point) = "-" if x < 0 else "", _shortest(abs(x))  # 0.digits * 10 ** point
    if 0 < point <= 21:
        whole = digits.ljust(point, "0")
        return sign + whole[:point] + (f".{whole[point:]}" if len(digits) > point else "")
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    rest = f".{digits[1:]}" if len(digits) > 1 else ""
    return f"{sign}{digits[0]}{rest}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def _shortest(x: float) -> tuple[str, int]:
    """The fewest digits that give a positive number back, and the place of the point before them."""
    mantissa, _, exponent = repr(x).partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    digits = whole + part
    lead = len(digits) - len(digits.lstrip("0"))
    return digits.lstrip("0").rstrip("0"), point - lead


def text(value: object) -> str:
    """A value of JSON in canonical form."""
    if isinstance(value, str):
        return json.dumps(unicodedata.normalize("NFC", value), ensure_ascii=False)
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, int | float):
        return number(value)
    if isinstance(value, list):
        return "[" + ",".join(map(text, value)) + "]"
    named = {unicodedata.normalize("NFC", k): v for k, v in value.items()}
    order = sorted(named, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{text(named[k])}" for k in order) + "}"


def of_json(raw: str | None) -> str | None:
    """Canonical form of a JSON text; None where it is none."""
    try:
        return None if raw is None else text(json.loads(raw))
    except (ValueError, RecursionError):
        return None


def canonical(raw: Column) -> Column:
    """The canonical form of JSON texts, null where a text is null or no JSON."""
    return F.pandas_udf(lambda s: s.map(of_json, na_action="ignore").astype(object).where(s.notna(), None), "string")(raw)


def entry_hash(raw: Column) -> Column:
    """The hash of a whole entry, its own ``hash_prev`` included."""
    return F.sha2(canonical(raw), 256)


def key_of(words: Column) -> Column:
    """The hash that names a string, as of a query or of a unit's content: that of its canonical form, quotes included."""

    def quoted(s: pd.Series) -> pd.Series:
        return s.map(lambda x: hashlib.sha256(text(x).encode()).hexdigest(), na_action="ignore").astype(object).where(s.notna(), None)

    return F.pandas_udf(quoted, "string")(words)
