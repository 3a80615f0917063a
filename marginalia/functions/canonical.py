"""Canonical JSON (RFC 8785) and what is hashed over it: envelopes, commitments. Numbers and key order need more than to_json, so these
are Arrow-batched functions over JSON text; everything around them stays in the JVM."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LARGEST = 2**53 - 1


def _unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key stands twice")
    return out


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON number")


def parsed(text: str) -> object:
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse)


def number(x: float) -> str:
    """The shortest digits that give the double back, written as ECMAScript does."""
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("not finite")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if len(text) <= point <= 21:
        body = text + "0" * (point - len(text))
    elif 0 < point <= 21:
        body = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        body = f"0.{'0' * -point}{text}"
    else:
        body = text[0] + (f".{text[1:]}" if len(text) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + body


def canonical(value: object) -> str:
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, int):
        if abs(value) > LARGEST:
            raise ValueError("an integer beyond 53 bits")
        return str(value)
    if isinstance(value, float):
        return number(value)
    if isinstance(value, str):
        value.encode()  # no lone surrogates
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return f"[{','.join(map(canonical, value))}]"
    items = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be"))
    return "{" + ",".join(f"{canonical(k)}:{canonical(v)}" for k, v in items) + "}"


def _sha(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def _each(fn: Callable[[object], str | None]) -> Callable[[Column], Column]:
    """fn over parsed JSON; null where the text has no canonical form (a repeated key, NaN, a lone surrogate, no JSON at all)."""

    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else fn(parsed(t))
            except (ValueError, TypeError, KeyError, AttributeError):
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    return lambda column: F.pandas_udf(run, StringType())(column)


canonical_json = _each(canonical)
payload_hash = _each(lambda d: _sha(canonical(d["payload"])))


def _document(d: dict) -> str:
    return _sha(canonical(d | {"integrity": {k: v for k, v in d["integrity"].items() if k != "document_sha256"}}))


document_hash = _each(_document)


def commitment(field: str) -> Callable[[Column], Column]:
    """The hash of an object with one field set to null: a commitment that the field can hold itself."""
    return _each(lambda d: _sha(canonical(d | {field: None})))


def envelope_fault(envelope: Column) -> Column:
    """The first hash of a sealed envelope that isn't that of its contents; null if both are, ``unreadable`` if there is none."""
    stored = lambda name: F.get_json_object(envelope, f"$.integrity.{name}")
    payload, document = payload_hash(envelope), document_hash(envelope)
    return (
        F.when(payload.isNull() | document.isNull(), "unreadable")
        .when(~payload.eqNullSafe(stored("payload_sha256")), "payload_sha256")
        .when(~document.eqNullSafe(stored("document_sha256")), "document_sha256")
    )


def run_id(milliseconds: Column, high: Column, low: Column) -> Column:
    """A time-ordered id of version 7: 48 bits of time, 12 random bits and 62 more."""
    hex_ = lambda c, n: F.lower(F.lpad(F.hex(c), n, "0"))
    time, tail = hex_(milliseconds, 12), hex_(low.bitwiseAND(F.lit((1 << 62) - 1)), 16)
    variant = F.element_at(F.array(*(F.lit(c) for c in "89ab")), F.conv(F.substring(tail, 1, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(
        F.lit("run_"), F.substring(time, 1, 8), F.lit("-"), F.substring(time, 9, 4), F.lit("-7"), hex_(high.bitwiseAND(F.lit(0xFFF)), 3), F.lit("-"),
        variant, F.substring(tail, 2, 3), F.lit("-"), F.substring(tail, 5, 12),
    )
