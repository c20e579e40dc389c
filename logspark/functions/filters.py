"""The filter language as boolean Columns.

and / or have equal precedence and bind left to right; not takes one term. A comparison is three-valued: null where the property is missing or JSON
null. A type mismatch is false, but true for !=. Columns of the event go by their names, everything else is a
property; Properties.X forces a property.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LEVEL_NUMBERS, LEVELS
from .text import property_text, variant_kind

#: The variant column that with_variant() adds.
VARIANT = "__bag"
COLUMNS = {"Level": "level", "Message": "message", "Exception": "exception", "Source": "source", "TraceId": "trace_id", "SpanId": "span_id", "Machine": "machine"}
_NUMBER = r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"
_WORDS = re.compile(r"\s*(?:(?P<string>'(?:[^']|'')*')|(?P<number>[+-]?\d+(?:\.\d+)?(?![\w.]))|(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|(?P<op>!=|<=|>=|=|<|>|\(|\)))")
_LEVEL_WORDS = {x for x in LEVELS} | {x.capitalize() for x in LEVEL_NUMBERS}


class FilterError(ValueError):
    """A filter text that doesn't parse; the message has the position."""


def with_variant(df: DataFrame) -> DataFrame:
    """Parses the property bags once, for all filters of a query."""
    return df if VARIANT in df.columns else df.withColumn(VARIANT, F.try_parse_json("properties"))


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def comparison(name: str, op: str, value: float | str | bool) -> Column:
    forced = name.startswith("Properties.")
    prop = name.removeprefix("Properties.")
    mismatch = F.lit(op == "!=")
    if not forced and prop == "Level":
        if isinstance(value, bool):
            return mismatch
        return _compare(op, F.col("level").cast("double"), F.lit(float(value))) if isinstance(value, (int, float)) else _compare(op, F.col("level").cast("string"), F.lit(value))
    if not forced and prop in COLUMNS:
        c = F.col(COLUMNS[prop])
        return _compare(op, c, F.lit(value)) if isinstance(value, str) else F.when(c.isNotNull(), mismatch)
    kind = variant_kind(VARIANT, prop)
    present = kind.isNotNull() & (kind != "VOID")
    if isinstance(value, bool):
        held = F.expr(f"try_variant_get({VARIANT}, '$.{prop}', 'boolean')")
        same = _compare(op, held, F.lit(value)) if op in ("=", "!=") else F.lit(False)
        return F.when(present, F.when(kind == "BOOLEAN", same).otherwise(mismatch))
    if isinstance(value, str):
        return F.when(present, _compare(op, property_text(VARIANT, prop), F.lit(value)))
    held = F.expr(f"try_variant_get({VARIANT}, '$.{prop}', 'double')")
    return F.when(present, F.when(kind.rlike(_NUMBER), _compare(op, held, F.lit(float(value)))).otherwise(mismatch))


def _text(name: str) -> Column:
    prop = name.removeprefix("Properties.")
    if prop in COLUMNS and prop == name:
        return F.col(COLUMNS[prop]).cast("string")
    kind = variant_kind(VARIANT, prop)
    return F.when(kind.isNotNull() & (kind != "VOID"), property_text(VARIANT, prop))


def filter_expr(text: str) -> Column:
    """The Column of a filter text. Rows need with_variant() where it names properties."""
    tokens: list[tuple[str, str, int]] = []
    at = 0
    while text[at:].strip():
        m = _WORDS.match(text, at)
        if not m:
            raise FilterError(f"unexpected text at position {at}")
        tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
        at = m.end()
    tokens.append(("end", "", len(text)))
    i = 0

    def peek(word: str) -> bool:
        return tokens[i][0] in ("name", "op") and tokens[i][1].lower() == word

    def take(word: str | None = None) -> tuple[str, str, int]:
        nonlocal i
        if word is not None and not peek(word):
            raise FilterError(f"expected {word} at position {tokens[i][2]}")
        i += 1
        return tokens[i - 1]

    def literal() -> float | str | bool:
        kind, word, place = take()
        if kind == "string":
            return word[1:-1].replace("''", "'")
        if kind == "number":
            return float(word)
        if kind == "name" and word.lower() in ("true", "false"):
            return word.lower() == "true"
        if kind == "name" and word.lower() in LEVEL_NUMBERS:
            return float(LEVEL_NUMBERS[word.lower()])
        raise FilterError(f"expected a value at position {place}")

    def term() -> Column:
        if peek("not"):
            take()
            return ~term()
        if peek("("):
            take()
            inner = expression()
            take(")")
            return inner
        kind, name, place = take()
        if kind != "name":
            raise FilterError(f"expected a name at position {place}")
        if peek("is"):
            take()
            negated = peek("not")
            if negated:
                take()
            take("null")
            missing = _text(name).isNull()
            return ~missing if negated else missing
        if peek("like"):
            take()
            kind, word, place = take()
            if kind != "string":
                raise FilterError(f"expected a string at position {place}")
            return _text(name).ilike(word[1:-1].replace("''", "'").replace("\\", "\\\\"))
        kind, op, place = take()
        if kind != "op" or op in "()":
            raise FilterError(f"expected an operator at position {place}")
        return comparison(name, op, literal())

    def expression() -> Column:
        left = term()
        while peek("and") or peek("or"):
            word = take()[1].lower()
            right = term()
            left = left & right if word == "and" else left | right
        return left

    out = expression()
    if tokens[i][0] != "end":
        raise FilterError(f"unexpected text at position {tokens[i][2]}")
    return out


def add_clause(text: str | None, field: str, value: float | str | bool, negate: bool = False, is_property: bool = False) -> str:
    """The filter with one more condition."""
    shown = "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else f"{value:g}"
    name = f"Properties.{field}" if is_property and field in COLUMNS else field
    clause = f"{'not ' if negate else ''}{name} = {shown}"
    return f"{text} and {clause}" if text and text.strip() else clause


def text_search(query: str | None) -> Column:
    """Every word of the query occurs in the message or the exception, whatever its case. An empty query: all."""
    has = lambda word: F.contains(F.lower("message"), F.lit(word)) | F.coalesce(F.contains(F.lower("exception"), F.lit(word)), F.lit(False))
    return reduce(lambda a, b: a & b, [has(w.lower()) for w in (query or "").split()], F.lit(True))
