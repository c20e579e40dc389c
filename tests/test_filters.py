"""Compiled filters against a plain evaluator over generated events."""

import json
import random
import re

import pytest

from logspark.functions.filters import FilterError, add_clause, filter_expr, text_search, with_variant

FILTERS = [
    "UserId = 1003", "UserId != 1003", "UserId > 1020", "Region = 'us'", "Region != 'us'", "not Region = 'us'", "TenantId >= 42 and Region = 'eu'", "TenantId = 42 or Region = 'us' and UserId > 1010", "Level >= Warning", "Level = '4'",
    "Region is null", "Region is not null", "Machine = 'GIT4A'", "Properties.Machine = 'GIT4A'", "Message like '%FAIL_D%'", "Flag = true", "Flag != true", "Flag > true", "Source = 'Api' and (UserId < 1010 or not TenantId = 41)", "K = '7'", "K = 7", "K != 7", "Exception is null",
]


def rows(n=300):
    r = random.Random(20260723)
    out = []
    for i in range(n):
        bag = {}
        if r.random() < 0.7:
            bag["UserId"] = r.randrange(1000, 1050)
        if r.random() < 0.6:
            bag["TenantId"] = r.randrange(40, 46)
        if r.random() < 0.5:
            bag["Region"] = r.choice(["us", "eu", "apac", None])
        if r.random() < 0.6:
            bag["Machine"] = r.choice(["GIT4A", "PAYJS2"])
        if r.random() < 0.5:
            bag["Flag"] = r.choice([True, False, "true"])
        if r.random() < 0.5:
            bag["K"] = r.choice([7, "7", 8, 7.5])
        out.append((i, r.randrange(6), r.choice(["payment failed", "ok"]), r.choice([None, "boom"]), r.choice([None, "Api"]), r.choice([None, "GIT4A"]), json.dumps(bag)))
    return out


def evaluate(text, row):
    """Left to right, three-valued."""
    i, level, message, exception, source, machine, bag = row
    columns = {"Level": level, "Message": message, "Exception": exception, "Source": source, "Machine": machine}
    tokens = re.findall(r"'[^']*'|!=|>=|<=|[=<>()]|[\w.]+", text)

    def value(name):
        return columns[name] if name in columns else json.loads(bag).get(name.removeprefix("Properties."))

    def plain(v):
        return ("true" if v else "false") if isinstance(v, bool) else str(v)

    def compare(v, op, lit):
        if v is None:
            return None
        if isinstance(lit, bool):
            ok = isinstance(v, bool)
            return (v == lit if op == "=" else v != lit if op == "!=" else False) if ok else op == "!="
        if isinstance(lit, float):
            if isinstance(v, bool) or not isinstance(v, (int, float)):
                return op == "!="
        else:
            v = plain(v)
        return {"=": v == lit, "!=": v != lit, "<": v < lit, ">": v > lit, "<=": v <= lit, ">=": v >= lit}[op]

    def term():
        t = tokens.pop(0)
        if t == "not":
            x = term()
            return None if x is None else not x
        if t == "(":
            x = expression()
            tokens.pop(0)
            return x
        op = tokens.pop(0)
        if op == "is":
            n = tokens.pop(0)
            if n == "not":
                tokens.pop(0)
                return value(t) is not None
            return value(t) is None
        lit = tokens.pop(0)
        if op == "like":
            pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in lit[1:-1])
            return None if value(t) is None else bool(re.fullmatch(pattern, plain(value(t)), re.I | re.S))
        lit = lit[1:-1] if lit[0] == "'" else {"true": True, "false": False, "Warning": 3.0}.get(lit, lit)
        return compare(value(t), op, float(lit) if isinstance(lit, str) and lit.isdigit() and f"'{lit}'" not in text else lit)

    def expression():
        x = term()
        while tokens and tokens[0] in ("and", "or"):
            op, y = tokens.pop(0), term()
            if op == "and":
                x = False if x is False or y is False else None if x is None or y is None else True
            else:
                x = True if x is True or y is True else None if x is None or y is None else False
        return x

    return expression() is True


def test_agreement(spark):
    data = rows()
    df = with_variant(spark.createDataFrame(data, "id int, level int, message string, exception string, source string, machine string, properties string")).cache()
    for f in FILTERS:
        got = {r.id for r in df.where(filter_expr(f)).select("id").collect()}
        assert got == {r[0] for r in data if evaluate(f, r)}, f


@pytest.mark.parametrize("bad", ["Level >>> 5", "Level =", "= 5", "Region = us", "(Level = 1", "Level = 1 Region = 2", "A.B.C = 1"])
def test_errors(spark, bad):
    with pytest.raises(FilterError):
        filter_expr(bad)


def test_clauses_and_words(spark):
    assert add_clause("Level = 4", "Region", "o'x") == "Level = 4 and Region = 'o''x'"
    assert add_clause("", "Machine", "A", negate=True, is_property=True) == "not Properties.Machine = 'A'"
    df = spark.createDataFrame([("Payment failed", "Time out"), ("payment ok", None), ("50% off", None)], "message string, exception string")
    assert df.where(text_search("PAYMENT out")).count() == 1 and df.where(text_search("50%")).count() == 1 and df.where(text_search(" ")).count() == 3
