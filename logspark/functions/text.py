"""Level names, message templates, event types, property values and payload rendering."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LEVEL_NUMBERS, LEVELS


def level_lookup(name: Column) -> Column:
    """The level of a name, alias or number from 0 to 5, whatever its case; null if it isn't recognised."""
    known = F.create_map(*[F.lit(x) for pair in LEVEL_NUMBERS.items() for x in pair])
    text = F.lower(F.trim(name.cast("string")))
    number = text.try_cast("int")
    return F.coalesce(F.try_element_at(known, text), F.when(number.between(0, 5), number))


def level_number(name: Column) -> Column:
    """As level_lookup(), and Information where the name isn't recognised."""
    return F.coalesce(level_lookup(name), F.lit(2))


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.greatest(F.lit(0), F.least(F.lit(5), level)) + 1)


# --- message templates ------------------------------------------------------------------------------------------


@lru_cache(maxsize=20_000)
def segments(template: str) -> tuple[tuple[bool, str, str], ...]:
    """(is hole, literal text or name, format) in order; doubled braces are literal ones."""
    out: list[tuple[bool, str, str]] = []
    text, at, n = [], 0, len(template)
    while at < n:
        c = template[at]
        if c in "{}" and template[at : at + 2] == c * 2:
            text.append(c)
            at += 2
        elif c == "{":
            end = template.find("}", at)
            if end < 0:  # never closed: as it stands
                text.append(template[at:])
                break
            hole = template[at + 1 : end]
            name, _, spec = hole.partition(":")
            name = name.partition(",")[0].strip().lstrip("@$")
            if name:
                if text:
                    out.append((False, "".join(text), ""))
                    text = []
                out.append((True, name, spec))
            else:
                text.append(template[at : end + 1])
            at = end + 1
        else:
            text.append(c)
            at += 1
    if text:
        out.append((False, "".join(text), ""))
    return tuple(out)


def plain(value: object) -> str:
    """Invariant text of a JSON value."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False) if isinstance(value, (dict, list)) else str(value)


def formatted(value: object, spec: str) -> str:
    """A number by one of the usual formats (F2, N0, D5, 0.00); anything else as plain text."""
    if spec and isinstance(value, (int, float)) and not isinstance(value, bool):
        if m := re.fullmatch(r"([FfNn])(\d*)", spec):
            return f"{value:{',' if m[1] in 'Nn' else ''}.{int(m[2] or 2)}f}"
        if (m := re.fullmatch(r"[Dd](\d*)", spec)) and isinstance(value, int):
            return f"{'-' if value < 0 else ''}{abs(value):0{int(m[1] or 1)}d}"
        if m := re.fullmatch(r"(0+)(?:\.(0+))?", spec):
            places = len(m[2] or "")
            return f"{value:0{len(m[1]) + (places + 1 if places else 0)}.{places}f}"
    return plain(value)


def bag(text: str | None) -> dict:
    try:
        got = json.loads(text) if text else {}
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def render(template: str | None, properties: dict) -> str:
    out = []
    for hole, text, spec in segments(template or ""):
        value = properties.get(text) if hole else None
        out.append(text if not hole or value is None else formatted(value, spec))
    return "".join(out)


@F.pandas_udf(T.StringType())
def render_template(template: pd.Series, properties: pd.Series) -> pd.Series:
    """The template with its holes filled from a JSON bag; a hole without a value stays as its name. Null: null."""
    return pd.Series([None if t is None else render(t, bag(p)) for t, p in zip(template, properties, strict=True)], dtype=object)


SEGMENT = T.ArrayType(T.StructType([T.StructField("is_hole", T.BooleanType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(SEGMENT)
def tokenize_template(template: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"is_hole": h, "text": x} for h, x, _ in segments(t)] for t in template], dtype=object)


@F.pandas_udf(T.LongType())
def _xxh64(text: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(text.fillna(""))
    hashed = [xxhash.xxh64_intdigest(x.encode()) for x in distinct]
    return pd.Series([h - (1 << 64) if h >> 63 else h for h in hashed], dtype="int64").take(codes).reset_index(drop=True)


def event_type_hash(template: Column, message: Column) -> Column:
    """XXH64 with seed 0 of the template, or of the message where there is none."""
    return _xxh64(F.when(F.coalesce(template, F.lit("")) != "", template).otherwise(F.coalesce(message, F.lit(""))))


# --- properties -------------------------------------------------------------------------------------------------


def variant_kind(variant: str, name: str) -> Column:
    """BIGINT, DECIMAL(..), DOUBLE, STRING, BOOLEAN, VOID, OBJECT<..>, ARRAY<..>; null if missing. variant: a column's name."""
    return F.expr(f"schema_of_variant(variant_get({variant}, '$.{name}'))")


def property_text(variant: str, name: str) -> Column:
    """A property as text: null as empty, whole numbers without .0."""
    text = F.expr(f"try_variant_get({variant}, '$.{name}', 'string')")
    return F.when(variant_kind(variant, name).rlike("^(DOUBLE|DECIMAL|FLOAT)"), F.regexp_replace(text, r"\.0$", "")).otherwise(F.coalesce(text, F.lit("")))


def json_path(document: Column, path: str | Column) -> Column:
    """Text at a path like $.a.b[0]; the leading $ may be missing. A miss, a JSON null, bad JSON or a blank path: null. The path may be a column."""
    if isinstance(path, str):
        full = path if path.startswith("$") else f"$.{path}"
        return F.get_json_object(document, full)
    # names and [n] in order; what follows the brackets of a part isn't read
    parts = F.filter(F.split(F.regexp_replace(path, r"^\$\.?", ""), r"\."), lambda x: x != "")
    steps = F.flatten(F.transform(parts, lambda x: F.concat(
        F.filter(F.array(F.regexp_extract(x, r"^[^\[]*", 0)), lambda y: y != ""), F.regexp_extract_all(F.regexp_extract(x, r"^[^\[]*((?:\[[^\]]*\])*)", 1), F.lit(r"\[\s*([+-]?\d+)\s*\]"), 0))))

    def step(value: Column, name: Column) -> Column:
        index = F.regexp_extract(name, r"[+-]?\d+", 0).try_cast("int")
        item = F.when(index >= 0, F.try_element_at(F.try_variant_get(value, "$", "array<variant>"), index + 1))
        return F.when(name.startswith("["), item).otherwise(F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), name))

    found = F.aggregate(steps, whole_json(document), step)
    kind = F.schema_of_variant(found)
    text = F.when(kind == "STRING", F.try_variant_get(found, "$", "string")).when(kind != "VOID", F.to_json(found))
    return F.when(F.trim(path) != "", text)


def marked_json(text: Column) -> Column:
    """A text in a list with its own hash after it, as a variant, for is_whole()."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), F.xxhash64(text).cast("string"), F.lit("]")))


def is_whole(marked: Column | str, text: Column) -> Column:
    """Is the text of marked_json() one JSON value and nothing else?

    Spark's parsers stop after the first value. In a list with the text's own hash after it, anything that follows the value shows: the hash is missing, or not
    the second item.
    """
    return F.try_variant_get(marked, "$[1]", "bigint") == F.xxhash64(text)


def whole_json(text: Column) -> Column:
    """A text that is one JSON value and nothing else, as a variant; null for any other. It is parsed once, as the value of a lambda."""
    return F.element_at(F.transform(F.array(marked_json(text)), lambda m: F.when(is_whole(m, text), F.try_variant_get(m, "$[0]", "variant"))), 1)


def valid_json(text: Column) -> Column:
    return F.coalesce(whole_json(text).isNotNull(), F.lit(False))


def span_start(text: Column) -> Column:
    """The start of a span from its text; a time without a date is no start: the clock isn't asked."""
    return F.when(text.rlike(r"^\s*[+-]?\d{4,}-"), F.try_to_timestamp(text))


# --- payloads ---------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\{\{(.*?)\}\}", re.S)


def _filters(value: str, steps: list[str]) -> tuple[str, bool]:
    """The value after its filters, and whether one of them made it JSON already."""
    done = False
    for step in steps:
        name, _, arg = step.strip().partition(":")
        arg = arg.strip().strip('"')
        if name == "upper":
            value = value.upper()
        elif name == "truncate" and arg.isdigit() and len(value) > int(arg):
            value = value[: int(arg)] + "…"
        elif name == "md":
            value = f"```\n{value}\n```"
        elif name == "default" and not value:
            value = arg
        elif name == "json":
            value, done = json.dumps(value, ensure_ascii=False), True
    return value, done


def _in_string(text: str) -> bool:
    """Whether the end of some JSON text lies inside a string literal."""
    inside = escaped = False
    for c in text:
        if escaped:
            escaped = False
        elif c == "\\" and inside:
            escaped = True
        elif c == '"':
            inside = not inside
    return inside


@lru_cache(maxsize=2_000)
def payload(template: str, json_mode: bool) -> Callable[[dict], str]:
    """A function of the values by path that fills the template."""
    parts: list[tuple[str, list[str] | None, bool]] = []
    at, before = 0, ""
    for m in _TOKEN.finditer(template):
        parts.append((template[at : m.start()], None, False))
        before += template[at : m.start()]
        parts.append(("", [x.strip() for x in m[1].split("|")], json_mode and _in_string(before)))
        at = m.end()
    parts.append((template[at:], None, False))

    def fill(values: dict) -> str:
        out = []
        for text, token, quoted in parts:
            if token is None:
                out.append(text)
                continue
            value, done = _filters(plain(values.get(token[0])), token[1:])
            if quoted:  # once: what the json filter quoted loses its quotes here
                value = value[1:-1] if done else json.dumps(value, ensure_ascii=False)[1:-1]
            out.append(value)
        return "".join(out)

    return fill


def render_payload(template: Column, values: Column, json_mode: bool = True) -> Column:
    """The template filled from a JSON object of values by path ("event.level": ...)."""

    @F.pandas_udf(T.StringType())
    def run(t: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else payload(x, json_mode)(bag(y)) for x, y in zip(t, v, strict=True)], dtype=object)

    return run(template, values)
