"""Canonical JSON as an Arrow-batched function.

Spark cannot compare JSON values: VARIANT is not orderable and keeps number spellings.
The canonical form sorts keys, drops blanks and null members, and writes each number as
the shortest decimal; lists keep their order. Nesting is bounded by memory only: texts too
deep for the decoder of the standard library are decoded with an explicit stack.
"""

from __future__ import annotations

import hashlib
import json
import re
from decimal import Decimal
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(text: str) -> str:
    try:
        value = Decimal(text)
    except ArithmeticError:  # an exponent beyond any number stands for itself
        return text.lower()
    if not value:
        return "0"
    sign, digits, exponent = value.normalize().as_tuple() if len(text) < 28 else _trim(value)
    return f"{'-' if sign else ''}{''.join(map(str, digits))}e{exponent}"


def _trim(value: Decimal) -> tuple:
    """``normalize`` without rounding to the context's precision."""
    sign, digits, exponent = value.as_tuple()
    n = len(digits)
    while n > 1 and digits[n - 1] == 0:
        n -= 1
        exponent += 1
    return sign, digits[:n], exponent


class Number(str):
    """A number in canonical spelling, told apart from a string; itself valid JSON."""


class _Memo(dict):
    """Answers by argument, so that frequent ones cost a look-up in C; of bounded size."""

    def __init__(self, make, most: int = 200_000):
        self.make, self.most = make, most

    def __missing__(self, key):
        if key is not None and len(key) > 64:
            return self.make(key)
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


_numbers = _Memo(lambda s: Number(_number(s)))
#: JSON spelling of a string in ASCII, and of a member name (or of none), remembered.
quote = json.encoder.encode_basestring_ascii
key_text = _Memo(lambda k: "" if k is None else quote(k)).__getitem__


def _fail(name: str):
    raise ValueError(name)


_decoder = json.JSONDecoder(parse_int=_numbers.__getitem__, parse_float=_numbers.__getitem__, parse_constant=_fail)
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_BLANK = re.compile(r"[ \t\n\r]*")
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def decode(text: str):
    """The value of a JSON text with canonical numbers; ValueError where it is no valid JSON."""
    try:
        return _decoder.decode(text)
    except RecursionError:
        return _decode_deep(text)


def _decode_deep(text: str):
    """Same values as the decoder's, for texts of any depth."""
    skip = lambda i: _BLANK.match(text, i).end()
    open_: list[tuple] = []  # (container, key under which the next value goes)
    at, end = skip(0), len(text)

    def member(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(i)
        key, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(i)
        return key, skip(i + 1)

    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            value: object = {} if c == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                key = None
                if c == "{":
                    key, at = member(at)
                open_.append((value, key))
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif c in _WORDS and text.startswith(_WORDS[c][0], at):
            word, value = _WORDS[c]
            at += len(word)
        elif found := _NUMBER.match(text, at):
            value, at = _numbers[found.group()], found.end()
        else:
            raise ValueError(at)
        while open_:
            holder, key = open_.pop()
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            at = skip(at)
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                key = None
                if isinstance(holder, dict):
                    key, at = member(at)
                open_.append((holder, key))
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(at)
            value, at = holder, at + 1
        else:
            if skip(at) != end:
                raise ValueError(at)
            return value


def scalar(value) -> str:
    """Canonical spelling of a value that is neither object nor list."""
    if isinstance(value, Number):
        return value
    if isinstance(value, str):
        return quote(value)
    return "null" if value is None else "true" if value else "false"


def write(value) -> str:
    """Canonical spelling of a decoded value, written with an explicit stack."""
    out: list[str] = []
    todo: list = [value]
    while todo:
        top = todo.pop()
        if type(top) is _Text:
            out.append(top)
        elif isinstance(top, (dict, list)):
            if isinstance(top, dict):
                parts = [(f"{key_text(k)}:", v) for k, v in sorted(top.items()) if v is not None]
                first, last = "{", "}"
            else:
                parts, first, last = [("", v) for v in top], "[", "]"
            out.append(first)
            todo.append(_Text(last))
            for i in range(len(parts) - 1, -1, -1):
                before, v = parts[i]
                todo.append(v)
                todo.append(_Text(f",{before}" if i else before))
        else:
            out.append(scalar(top))
    return "".join(out)


class _Text(str):
    """Text to be written as it is."""


def _write_flat(value) -> str:
    """Same text as :func:`write`, recursive and faster; RecursionError where nested too deeply."""
    if isinstance(value, dict):
        return "{" + ",".join([f"{key_text(k)}:{_write_flat(v)}" for k, v in sorted(value.items()) if v is not None]) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_write_flat, value)) + "]"
    return scalar(value)


def canonical_text(text: str | None) -> str | None:
    """Canonical spelling of a JSON text; a text that is not JSON stands for itself."""
    if text is None:
        return None
    try:
        value = decode(text)
    except ValueError:
        return "!" + text
    try:
        return _write_flat(value)
    except RecursionError:
        return write(value)


def digest(text: str) -> str:
    """SHA-256 of a text's canonical JSON, in hex."""
    return hashlib.sha256(canonical_text(text).encode("utf-8", "surrogatepass")).hexdigest()


def without(value, fields: frozenset[str], root: frozenset[str] = frozenset()):
    """A decoded value without the members of these names at any depth, and of those of ``root`` at the top."""
    drop = fields | root
    held = [None]
    todo = [(value, held, 0)]
    while todo:
        v, into, key = todo.pop()
        if isinstance(v, dict):
            into[key] = new = {k: None for k in v if k not in drop}
            todo.extend((v[k], new, k) for k in new)
        elif isinstance(v, list):
            into[key] = new = [None] * len(v)
            todo.extend((x, new, i) for i, x in enumerate(v))
        else:
            into[key] = v
        drop = fields
    return held[0]


def projected_json(fields: frozenset[str], root: frozenset[str] = frozenset()):
    """A function of a JSON column: its canonical form :func:`without` these members."""

    @F.pandas_udf(T.StringType())
    def project(texts: pd.Series) -> pd.Series:
        seen: dict = {}
        for t in texts:
            if t is not None and t not in seen:
                try:
                    seen[t] = write(without(decode(t), fields, root))
                except ValueError:
                    seen[t] = "!" + t
        return pd.Series([seen.get(t) for t in texts], dtype=object)

    return project


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    seen: dict = {}
    out = []
    for t in texts:
        if t not in seen:
            seen[t] = canonical_text(t)
        out.append(seen[t])
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def canonical_digest(texts: pd.Series) -> pd.Series:
    """SHA-256 over the canonical JSON of each text; null for null."""
    return pd.Series([None if t is None else digest(t) for t in texts], dtype=object)
