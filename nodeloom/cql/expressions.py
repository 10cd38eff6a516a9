"""Expressions of the query language as Spark columns, with its three-valued logic."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import syntax as s
from .errors import QueryError

#: Regular expressions with look-around or back-references are not supported.
def failure(code: str, message: str):
    """A column that ends the query with an error of this code when it is evaluated."""
    return F.raise_error(F.lit(f"{code}: {message}"))


_REJECTED = re.compile(r"\(\?(?:=|!|<=|<!)|\\[1-9]")
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMERIC = (*_INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)


class Translator:
    def __init__(self, compiler, scope, grouping: bool):
        self.c, self.scope, self.grouping = compiler, scope, grouping
        self.inside = False

    def type(self, e: s.Expr) -> T.DataType:
        return self.c.type_of(e, self.scope)

    def column(self, e: s.Expr) -> Column:
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def first(self, c: Column) -> Column:
        """A bare variable beside an aggregate takes its value in some row of the group."""
        return F.first(c) if self.grouping and not self.inside else c

    # -- leaves ----------------------------------------------------------------------------

    def _literal(self, e):
        return value(e.value)

    def _param(self, e):
        if e.name not in self.c.parameters:
            raise QueryError("CQL4001", f"parameter {e.name} is missing")
        return value(self.c.parameters[e.name])

    def _var(self, e):
        if e.name in self.scope.local:
            return self.scope.local[e.name][0]
        if e.name not in self.scope.vars:
            raise QueryError("CQL2004", f"unknown variable {e.name}")
        b = self.scope.vars[e.name]
        return self.first(F.col(b.cols[{"node": "id", "rel": "eid", "rels": "eids", "path": "path", "value": "value"}[b.kind]]))

    def bound(self, e):
        return self.scope.vars.get(e.name) if isinstance(e, s.Var) and e.name not in self.scope.local else None

    def _prop(self, e):
        b = self.bound(e.target)
        if b is not None and b.kind in ("node", "rel"):
            known = {"node": {"id": "id", "label": "label"}, "rel": {"source": "src", "target": "dst", "relation": "type", "type": "type", "id": "eid"}}[b.kind]
            f = "p:" + e.key if "p:" + e.key in b.cols else known.get(e.key)
            return self.first(F.col(b.cols[f])) if f in b.cols else F.lit(None)
        kind = self.type(e.target)
        if isinstance(kind, T.NullType):
            return F.lit(None)
        if isinstance(kind, T.StructType):
            return self.column(e.target)[e.key] if e.key in kind.names else F.lit(None)
        if isinstance(kind, T.MapType):
            return F.try_element_at(self.column(e.target), F.lit(e.key))
        raise QueryError("CQL4003", f"{e.key} needs a node, relationship or map")

    def _haslabel(self, e):
        b = self.bound(e.target)
        if b is None or b.kind != "node":
            raise QueryError("CQL4003", "a label test needs a node")
        return reduce(lambda x, y: x & y, [self.first(F.col(b.cols["label"])) == x for x in e.labels])

    def _listof(self, e):
        return F.array(*[self.column(x) for x in e.items])

    def _mapof(self, e):
        return F.struct(*[self.column(v).alias(k) for k, v in e.items]) if e.items else F.create_map().cast("map<string,string>")

    # -- operators -------------------------------------------------------------------------

    def _unary(self, e):
        c = self.column(e.value)
        return ~c.cast("boolean") if e.op == "NOT" else F.negative(c) if e.op == "-" else c

    def _isnull(self, e):
        c = self.column(e.value)
        return c.isNotNull() if e.negated else c.isNull()

    def _binary(self, e):
        a, b, op = self.column(e.left), self.column(e.right), e.op
        if op == "AND":
            return a.cast("boolean") & b.cast("boolean")
        if op == "OR":
            return a.cast("boolean") | b.cast("boolean")
        if op == "XOR":
            return a.cast("boolean") != b.cast("boolean")
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return self.compare(op, e, a, b)
        if op == "IN":
            return self.among(e, a, b)
        if op in ("STARTS", "ENDS", "CONTAINS"):
            return {"STARTS": a.startswith, "ENDS": a.endswith, "CONTAINS": a.contains}[op](b)
        if op == "=~":
            if isinstance(e.right, s.Literal) and (not isinstance(e.right.value, str) or len(e.right.value) > 16384 or _REJECTED.search(e.right.value)):
                raise QueryError("CQL4018", "the regular expression is not supported")
            if isinstance(e.right, s.Literal):
                return F.rlike(a, b)
            refused = b.rlike(_REJECTED.pattern) | (F.octet_length(b) > 16384)  # patterns known at run time only
            return F.rlike(a, F.when(refused, failure("CQL4018", "the regular expression is not supported").cast("string")).otherwise(b))
        return self.arithmetic(op, e, a, b)

    def compare(self, op, e, a, b):
        ka, kb = self.type(e.left), self.type(e.right)
        if isinstance(ka, T.NullType) or isinstance(kb, T.NullType):
            return F.lit(None).cast("boolean")
        ra, rb = _order(ka), _order(kb)
        if ra != rb:
            # values of different types are never equal, and ordered by their types
            either = a.isNull() | b.isNull()
            truth = {"=": False, "<>": True, "<": ra < rb, "<=": ra < rb, ">": ra > rb, ">=": ra > rb}[op]
            return F.when(~either, F.lit(truth))
        if isinstance(ka, T.ArrayType) and op in ("=", "<>"):
            same = F.when(F.size(a) != F.size(b), F.lit(False)).otherwise(F.forall(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
            return same if op == "=" else ~same
        return {"=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()

    def among(self, e, a, b):
        kind = self.type(e.right)
        if isinstance(kind, T.NullType) or isinstance(e.right, s.ListOf) and not e.right.items:
            return F.lit(None).cast("boolean") if isinstance(kind, T.NullType) else F.lit(False)
        if isinstance(e.right, s.ListOf):  # a list of single values stays a pushable predicate
            return a.isin(*[self.column(x) for x in e.right.items])
        return F.exists(b, lambda x: x == a)

    def arithmetic(self, op, e, a, b):
        ka, kb = self.type(e.left), self.type(e.right)
        if isinstance(ka, T.NullType) or isinstance(kb, T.NullType):
            return F.lit(None)
        if op == "+" and isinstance(ka, T.StringType) and isinstance(kb, T.StringType):
            return F.concat(a, b)
        if op == "+" and (isinstance(ka, T.ArrayType) or isinstance(kb, T.ArrayType)):
            return F.concat(a if isinstance(ka, T.ArrayType) else F.array(a), b if isinstance(kb, T.ArrayType) else F.array(b))
        if not isinstance(ka, _NUMERIC) or not isinstance(kb, _NUMERIC):
            raise QueryError("CQL4003", f"{op} needs numbers")
        whole = isinstance(ka, _INTEGRAL) and isinstance(kb, _INTEGRAL)
        if whole:
            a, b = a.cast("bigint"), b.cast("bigint")
        if op in ("/", "%") and not (isinstance(e.right, s.Literal) and e.right.value):
            code, why = ("CQL4006", "numeric result is outside the range") if whole else ("CQL4005", "division by zero")
            b = F.when(b == 0, failure(code, why).cast("bigint" if whole else "double")).otherwise(b)
        if op == "/":
            return F.call_function("div", a, b) if whole else a.cast("double") / b.cast("double")
        if op == "^":
            return F.pow(a.cast("double"), b.cast("double"))
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b}[op]()

    def _index(self, e):
        kind, c, i = self.type(e.target), self.column(e.target), self.column(e.index)
        if isinstance(kind, T.MapType):
            return F.try_element_at(c, i)
        if isinstance(kind, T.StructType) and isinstance(e.index, s.Literal):
            return c[e.index.value] if e.index.value in kind.names else F.lit(None)
        if not isinstance(kind, T.ArrayType):
            raise QueryError("CQL4003", "an index needs a list or map")
        at = F.when(i < 0, F.size(c) + i).otherwise(i).cast("int")
        return F.when(at >= 0, F.get(c, at))

    def _slice(self, e):
        c = self.column(e.target)
        n = F.size(c)

        def clamp(x, default):
            if x is None:
                return default
            v = self.column(x).cast("int")
            return F.greatest(F.lit(0), F.least(n, F.when(v < 0, n + v).otherwise(v)))

        lo, hi = clamp(e.start, F.lit(0)), clamp(e.stop, n)
        return F.when(c.isNotNull(), F.slice(c, lo + 1, F.greatest(F.lit(0), hi - lo)))

    def _case(self, e):
        subject = None if e.subject is None else self.column(e.subject)
        out = None
        for when, then in e.branches:
            w = self.column(when)
            cond = w if subject is None else subject.eqNullSafe(w)
            out = F.when(cond, self.column(then)) if out is None else out.when(cond, self.column(then))
        return out if e.otherwise is None else out.otherwise(self.column(e.otherwise))

    def _quantifier(self, e):
        kind = self.type(e.source)
        if not isinstance(kind, T.ArrayType):
            raise QueryError("CQL4003", f"{e.kind} needs a list")
        sample = F.lit(None).cast(kind.elementType)

        def test(x):
            return Translator(self.c, self.scope.with_local(e.var, x, sample), False).column(e.where)

        c = self.column(e.source)
        if e.kind == "any":
            return F.exists(c, test)
        if e.kind == "all":
            return F.forall(c, test)
        if e.kind == "none":
            return ~F.exists(c, test)
        yes, unknown = F.size(F.filter(c, lambda x: F.coalesce(test(x), F.lit(False)))), F.exists(c, lambda x: test(x).isNull())
        return F.when(c.isNull(), F.lit(None)).when(yes > 1, False).when(unknown, F.lit(None)).otherwise(yes == 1)

    def _exists(self, e):
        raise QueryError("CQL2019", "EXISTS is not allowed here")

    # -- functions -------------------------------------------------------------------------

    def _call(self, e):
        if e.name in s.AGGREGATES:
            return self.aggregate(e)
        return getattr(self, "f_" + e.name)(e, *e.args)

    def aggregate(self, e):
        if not self.grouping or self.inside:
            raise QueryError("CQL2016", f"{e.name} is not allowed here")
        if e.star:
            return F.count(F.lit(1))
        self.inside = True
        b = self.bound(e.args[0])
        c = self.c.shown(b) if b is not None and e.name == "collect" else self.column(e.args[0])
        kind = self.type(e.args[0])
        self.inside = False
        if e.name == "count":
            return F.count_distinct(c) if e.distinct else F.count(c)
        if e.name == "sum":
            return F.coalesce(F.sum_distinct(c) if e.distinct else F.sum(c), F.lit(0))
        if e.name == "avg":
            c = c.cast("double")
            return F.call_function("avg", c) if not e.distinct else F.aggregate(F.collect_set(c), F.lit(0.0), lambda x, y: x + y, lambda x: F.try_divide(x, F.count_distinct(c).cast("double")))
        if e.name in ("min", "max"):
            return (F.min if e.name == "min" else F.max)(c)
        made = F.collect_set(c) if e.distinct else F.collect_list(c)
        return made if isinstance(kind, T.MapType) else F.sort_array(made)

    def f_size(self, e, x):
        return F.char_length(self.column(x)).cast("bigint") if isinstance(self.type(x), T.StringType) else F.when(self.column(x).isNotNull(), F.size(self.column(x))).cast("bigint")

    def f_length(self, e, x):
        b = self.bound(x)
        c = self.column(x)
        return F.size(c if b is not None and b.kind == "rels" else c["relationships"]).cast("bigint")

    def f_head(self, e, x):
        return F.get(self.column(x), F.lit(0))

    def f_last(self, e, x):
        return F.try_element_at(self.column(x), F.lit(-1))

    def f_coalesce(self, e, *xs):
        return F.coalesce(*[self.column(x) for x in xs])

    def f_tolower(self, e, x):
        return F.lower(self.column(x))

    def f_toupper(self, e, x):
        return F.upper(self.column(x))

    def f_trim(self, e, x):
        return F.regexp_replace(self.column(x), r"(?U)^\s+|\s+$", "")

    def f_tointeger(self, e, x):
        c, kind = self.column(x), self.type(x)
        if isinstance(kind, T.StringType):
            return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint"))
        return c.try_cast("bigint")

    def f_tofloat(self, e, x):
        c = self.column(x).try_cast("double")
        return F.when(~F.isnan(c) & (F.abs(c) != math.inf), c)

    def f_tostring(self, e, x):
        c = self.column(x).cast("string")
        return F.regexp_replace(c, r"\.0$", "") if isinstance(self.type(x), (T.DoubleType, T.FloatType)) else c

    def f_toboolean(self, e, x):
        c = F.lower(self.column(x).cast("string"))
        return F.when(c == "true", True).when(c == "false", False)

    def f_split(self, e, x, sep):
        quoted = F.concat(F.lit("\\Q"), self.column(sep), F.lit("\\E"))
        c = self.column(x)
        return F.split(F.when(c.isNull(), failure("CQL4003", "split needs a string").cast("string")).otherwise(c), quoted, -1)

    def f_replace(self, e, x, a, b):
        return F.replace(self.column(x), self.column(a), self.column(b))

    def entity(self, x, *kinds):
        b = self.bound(x)
        if b is None or b.kind not in kinds:
            raise QueryError("CQL4003", f"expected a {' or '.join(kinds)}")
        return b

    def f_labels(self, e, x):
        return F.array(self.first(F.col(self.entity(x, "node").cols["label"])))

    def f_type(self, e, x):
        return self.first(F.col(self.entity(x, "rel").cols["type"]))

    def f_id(self, e, x):
        b = self.entity(x, "node", "rel")
        return self.first(F.col(b.cols["id" if b.kind == "node" else "eid"]))

    def f_nodes(self, e, x):
        return self.column(x)["nodes"]

    def f_relationships(self, e, x):
        b = self.bound(x)
        return self.column(x) if b is not None and b.kind == "rels" else self.column(x)["relationships"]

    def f_properties(self, e, x):
        b = self.entity(x, "node", "rel")
        names = [f.removeprefix("p:") for f in sorted(b.cols, key=lambda f: f.removeprefix("p:")) if f not in ("eid", "src", "dst")]
        return F.struct(*[self.first(F.col(b.cols.get("p:" + n, b.cols.get(n)))).alias(n) for n in names])

    def f_keys(self, e, x):
        b = self.entity(x, "node", "rel")
        pairs = sorted((f.removeprefix("p:"), c) for f, c in b.cols.items() if f not in ("eid", "src", "dst"))
        return F.filter(F.array(*[F.when(self.first(F.col(c)).isNotNull(), F.lit(n)) for n, c in pairs]), lambda k: k.isNotNull())


def _order(kind: T.DataType) -> int:
    """Rank of a type in the order of all values: maps, lists, strings, booleans, numbers."""
    if isinstance(kind, (T.StructType, T.MapType)):
        return 0
    if isinstance(kind, T.ArrayType):
        return 4
    if isinstance(kind, T.StringType):
        return 5
    if isinstance(kind, T.BooleanType):
        return 6
    return 7


def value(v) -> Column:
    if isinstance(v, int) and not isinstance(v, bool):
        return F.lit(v).cast("bigint")
    if isinstance(v, (list, tuple)):
        return F.array(*[value(x) for x in v])
    if isinstance(v, dict):
        return F.struct(*[value(x).alias(k) for k, x in v.items()])
    return F.lit(v)
