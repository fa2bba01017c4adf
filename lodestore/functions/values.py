"""Coercion of literals and columns, ids and natural order."""

from __future__ import annotations

import datetime
import uuid
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Attribute, SchemaError

_LIMITS = {"int": (-(2**63), 2**63 - 1), "uint": (0, 2**64 - 1)}


def _integer(value: Any, kind: str) -> int:
    if isinstance(value, bool):
        raise SchemaError(f"{value!r} isn't {kind}")
    if isinstance(value, str):
        number = int(value)
    elif isinstance(value, int | Decimal) or isinstance(value, float) and value.is_integer():
        number = int(value)
    else:
        raise SchemaError(f"{value!r} isn't {kind}")
    low, high = _LIMITS[kind]
    if not low <= number <= high:
        raise SchemaError(f"{value!r} is out of range for {kind}")
    return number


def coerce(value: Any, attribute: Attribute) -> Any:
    """``value`` as the attribute's type without loss; SchemaError otherwise. None stays
    None, and a list attribute takes a scalar as a list of one."""
    if attribute.is_list:
        if value is None:
            return []
        items = value if isinstance(value, list | tuple) else [value]
        return [_scalar(v, attribute.element) for v in items]
    if value is None:
        return None
    value = _scalar(value, attribute.type)
    if attribute.allowed and value not in attribute.allowed:
        raise SchemaError(f"{value!r} isn't one of {attribute.allowed}")
    return value


def _scalar(value: Any, kind: str) -> Any:
    try:
        match kind:
            case "int":
                return _integer(value, kind)
            case "uint":
                return Decimal(_integer(value, kind))
            case "float" if isinstance(value, int | float | Decimal | str) and not isinstance(value, bool):
                return float(value)
            case "bool" if isinstance(value, bool):
                return value
            case "string" if isinstance(value, str | int | float) and not isinstance(value, bool):
                return str(value)
            case "ident" if isinstance(value, str):
                return value
            case "url" if isinstance(value, str) and "://" in value:
                return value
            case "bytes" if isinstance(value, bytes | list):
                return bytes(value)
            case "ref" if isinstance(value, str | uuid.UUID):
                return str(uuid.UUID(str(value)))
            case "datetime":
                return _moment(value)
    except (ValueError, TypeError) as error:
        raise SchemaError(f"{value!r} isn't {kind}") from error
    raise SchemaError(f"{value!r} isn't {kind}")


def _moment(value: Any) -> datetime.datetime:
    """Whole seconds of an RFC 3339 text, or milliseconds since 1970."""
    if isinstance(value, datetime.datetime):
        return value
    if isinstance(value, str) and not value.isdigit():
        parsed = datetime.datetime.fromisoformat(value)
        return parsed.astimezone(datetime.UTC).replace(tzinfo=None, microsecond=0)
    return datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=_integer(value, "uint"))


def coerce_column(value: Column, kind: str) -> Column:
    """A text column as ``kind``; null where a value can't be taken without loss."""
    trimmed = value.cast("string")
    if kind == "int":
        return F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("bigint"))
    if kind == "uint":
        number = F.when(trimmed.rlike(r"^\+?\d+$"), trimmed.try_cast("decimal(20,0)"))
        return F.when(number <= F.lit(str(2**64 - 1)).cast("decimal(20,0)"), number)
    if kind == "float":
        return trimmed.try_cast("double")
    if kind == "datetime":
        written = F.date_trunc("second", F.try_to_timestamp(trimmed)).cast("timestamp_ntz")
        return F.when(trimmed.rlike(r"^\d+$"), from_millis(trimmed.try_cast("bigint"))).otherwise(written)
    if kind == "url":
        return F.when(F.try_parse_url(trimmed, F.lit("PROTOCOL")).isNotNull(), trimmed)
    if kind == "ref":
        return F.when(trimmed.rlike(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lower(trimmed))
    if kind == "bool":
        return F.when(trimmed.isin("true", "false"), trimmed == "true")
    if kind == "ident":
        return F.when(trimmed.rlike(r"^[A-Za-z0-9._]+/[A-Za-z0-9._]+$"), trimmed)
    return value.cast("binary") if kind == "bytes" else trimmed


_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def from_millis(number: Column) -> Column:
    """Milliseconds since 1970 as a moment (UTC), whatever the session's time zone."""
    none = F.lit(0)
    return F.expr(_EPOCH) + F.make_dt_interval(none, none, none, (number.cast("decimal(20,0)") / 1000).cast("decimal(18,6)"))


def millis(moment: Column) -> Column:
    """A moment (UTC) as whole milliseconds since 1970."""
    return F.floor((moment - F.expr(_EPOCH)).cast("interval second").cast("decimal(18,6)") * 1000).cast("bigint")


def now() -> Column:
    """The moment (UTC) at which the query began, in whole milliseconds."""
    return from_millis(F.unix_millis(F.current_timestamp()))


def entity_id(*keys: Column) -> Column:
    """A UUID-shaped id from keys (text or integer), the same on every engine."""
    digest = F.md5(F.concat_ws("|", *(k.cast("string") for k in keys)))
    return F.regexp_replace(digest, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def natural_key(text: Column) -> Column:
    """Sort key of the natural order: runs of digits compare as numbers, in the place of
    the digit "0" among other characters. Of any length of digits."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9])"), 1)

    def key(part: Column) -> Column:
        number = F.regexp_replace(part, "^0+(?=.)", "")
        digits = part.rlike("^[0-9]")
        return F.struct(F.when(digits, F.lit("0")).otherwise(part).alias("head"), F.when(digits, F.length(number)).otherwise(F.lit(0)).alias("size"), F.when(digits, number).otherwise(F.lit("")).alias("number"))

    return F.transform(parts, key)
