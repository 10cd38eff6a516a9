"""Compiles parsed queries to DataFrame plans.

A binding table is one DataFrame with flat columns: a node ``n`` is ``n__id``, ``n__label``
and the properties the query touches, so that Catalyst prunes and pushes down freely. Every
path pattern is compiled on its own and joined with what is bound on the shared variables;
the physical join is left to Catalyst.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import PropertyGraph
from ..runtime import Workspace
from . import syntax as s
from .errors import QueryError


@dataclass(frozen=True)
class Bound:
    """A variable: ``kind`` is node, rel, rels, path or value; ``cols`` maps its fields to columns."""

    kind: str
    cols: dict = field(hash=False)


@dataclass
class Scope:
    df: DataFrame | None
    vars: OrderedDict
    local: dict = field(default_factory=dict)  # lambda variables: (column, typed null)

    def with_local(self, name: str, column: Column, sample: Column) -> Scope:
        return Scope(self.df, self.vars, {**self.local, name: (column, sample)})


class Compiler:
    def __init__(self, graph: PropertyGraph, parameters: dict | None = None):
        self.graph, self.parameters = graph, parameters or {}
        self.spark = graph.spark
        self.fresh = 0
        self.work: Workspace | None = None
        self.node_props: list[str] = []
        self.edge_props: list[str] = []

    def name(self, stem: str) -> str:
        self.fresh += 1
        return f"_{stem}{self.fresh}"

    # -- whole queries -------------------------------------------------------------------

    def run(self, query: s.Query) -> DataFrame:
        frames = [self.part(p) for p in query.parts]
        out = frames[0]
        for keep_all, more in zip(query.unions, frames[1:]):
            if out.columns != more.columns:
                raise QueryError("CQL2014", "UNION parts must return the same names")
            out = out.unionAll(more)
            if not keep_all:
                out = out.distinct()
        return out

    def part(self, clauses: tuple) -> DataFrame:
        keys = set(_keys(clauses))
        everything = any(isinstance(e, s.Call) and e.name in ("properties", "keys") for e in _expressions(clauses))
        self.node_props = [c for c in self.graph.nodes.columns if c not in ("id", "label") and (everything or c in keys)]
        self.edge_props = [c for c in self.graph.edges.columns if c not in ("eid", "src", "dst", "type") and (everything or c in keys)]
        scope = Scope(None, OrderedDict())
        for k, clause in enumerate(clauses):
            if isinstance(clause, s.Match):
                scope = self.match(scope, clause)
            elif isinstance(clause, s.Unwind):
                scope = self.unwind(scope, clause)
            else:
                scope = self.project(scope, clause)
        return scope.df

    def table(self, scope: Scope) -> DataFrame:
        return scope.df if scope.df is not None else self.spark.range(1).select(F.lit(1).alias("_one"))

    # -- patterns ------------------------------------------------------------------------

    def match(self, scope: Scope, clause: s.Match) -> Scope:
        if not clause.optional:
            out, later = scope, []
            for p in _ordered(clause.patterns, scope.vars):
                out, wait = self.join_path(out, p)
                later += wait
            for var, key, e in later:
                out = self.filter(out, s.Binary("=", s.Prop(s.Var(var), key), e))
            for c in _conjuncts(clause.where):
                out = self.filter(out, c)
            return out
        inner, later, shared = self.alone(scope, clause.patterns)
        own, mixed = [], []
        for c in [*[s.Binary("=", s.Prop(s.Var(v), k), e) for v, k, e in later], *_conjuncts(clause.where)]:
            (own if _names(c) <= set(inner.vars) - set(shared) else mixed).append(c)
        for c in own:
            inner = self.filter(inner, c)
        return self.left_join(scope, inner, shared, mixed)

    def alone(self, scope: Scope, patterns: tuple) -> tuple[Scope, list, list]:
        """Patterns compiled apart from ``scope``; shared variables are renamed to join on later."""
        inner, later = Scope(None, OrderedDict()), []
        for p in _ordered(patterns, OrderedDict()):
            inner, wait = self.join_path(inner, p, outer=scope)
            later += wait
        return inner, later, [v for v in inner.vars if v in scope.vars]

    def left_join(self, scope: Scope, inner: Scope, shared: list[str], mixed: list) -> Scope:
        base = self.table(scope)
        renamed, inner = self.rename(inner, shared)
        both = Scope(None, OrderedDict(scope.vars))
        for v, b in inner.vars.items():
            if v not in both.vars:
                both.vars[v] = b
        on = [self.same(scope.vars[v], renamed[v]) for v in shared]
        both.df = base.crossJoin(inner.df) if mixed else None  # only to type the conditions
        on += [self.expr(c, both) for c in mixed]
        cond = on[0] if on else F.lit(True)
        for c in on[1:]:
            cond = cond & c
        joined = base.join(inner.df, cond, "left").drop(*[c for b in renamed.values() for c in b.cols.values()])
        return Scope(joined, both.vars)

    def rename(self, inner: Scope, shared: list[str]) -> tuple[dict, Scope]:
        renamed, df, kept = {}, inner.df, OrderedDict(inner.vars)
        for v in shared:
            cols = {f: self.name("s") for f in inner.vars[v].cols}
            df = df.withColumnsRenamed({inner.vars[v].cols[f]: c for f, c in cols.items()})
            renamed[v] = Bound(inner.vars[v].kind, cols)
            del kept[v]
        return renamed, Scope(df, kept)

    @staticmethod
    def same(a: Bound, b: Bound) -> Column:
        if a.kind != b.kind or a.kind not in ("node", "rel"):
            raise QueryError("CQL2005", "a variable is bound to something else")
        f = "id" if a.kind == "node" else "eid"
        return F.col(a.cols[f]) == F.col(b.cols[f])

    def join_path(self, scope: Scope, path: s.PathPattern, outer: Scope | None = None) -> tuple[Scope, list]:
        for x in (*path.rels,):
            if x.var and x.hops and x.var in scope.vars:
                raise QueryError("CQL2005", f"{x.var} is already bound")
        found, later = self.path(path, scope, outer)
        shared = [v for v in found.vars if v in scope.vars]
        if scope.df is None:
            return found, later
        renamed, rest = self.rename(found, shared)
        merged = OrderedDict(scope.vars)
        merged.update(rest.vars)
        if not shared:
            return Scope(scope.df.crossJoin(rest.df), merged), later
        cond = None
        for v in shared:
            c = self.same(scope.vars[v], renamed[v])
            cond = c if cond is None else cond & c
        return Scope(scope.df.join(rest.df, cond).drop(*[c for b in renamed.values() for c in b.cols.values()]), merged), later

    def scan(self, var: str) -> tuple[DataFrame, Bound]:
        cols = {"id": f"{var}__id", "label": f"{var}__label"} | {"p:" + p: f"{var}__{p}" for p in self.node_props}
        return self.graph.nodes.select(F.col("id").alias(cols["id"]), F.col("label").alias(cols["label"]), *[F.col(p).alias(cols["p:" + p]) for p in self.node_props]), Bound("node", cols)

    def edge_scan(self, var: str, rel: s.RelPattern) -> tuple[DataFrame, Bound, str, str]:
        cols = {f: f"{var}__{f}" for f in ("eid", "src", "dst", "type")} | {"p:" + p: f"{var}__{p}" for p in self.edge_props}
        e = self.graph.edges
        if rel.types:
            e = e.where(F.col("type").isin(*rel.types))
        e = e.select(*[F.col(f[2:] if f.startswith("p:") else f).alias(c) for f, c in cols.items()])
        bound = Bound("rel", cols)
        here, there = f"{var}__here", f"{var}__there"
        if rel.direction == "both":
            loop = F.col(cols["src"]) == F.col(cols["dst"])
            one = e.withColumns({here: F.col(cols["src"]), there: F.col(cols["dst"])})
            other = e.where(~loop).withColumns({here: F.col(cols["dst"]), there: F.col(cols["src"])})
            e = one.unionByName(other)
        else:
            a, b = ("src", "dst") if rel.direction == "out" else ("dst", "src")
            e = e.withColumns({here: F.col(cols[a]), there: F.col(cols[b])})
        return e, bound, here, there

    def path(self, path: s.PathPattern, scope: Scope, outer: Scope | None) -> tuple[Scope, list]:
        """One path pattern as its own table; property maps that name outside variables are returned."""
        later: list = []
        outside = scope if outer is None else outer
        vars_: OrderedDict = OrderedDict()
        names = [n.var or self.name("n") for n in path.nodes]

        def constrained(n: s.NodePattern, name: str, df: DataFrame, bound: Bound) -> DataFrame:
            for label in n.labels:
                df = df.where(F.col(bound.cols["label"]) == label)
            for key, e in n.props:
                if _names(e):
                    later.append((name, key, e))
                else:
                    df = df.where(self.expr(s.Binary("=", s.Prop(s.Var(name), key), e), Scope(df, OrderedDict({name: bound}))))
            return df

        def light(n: s.NodePattern, name: str) -> bool:
            """Whether only the id is needed: it is bound elsewhere, or nothing else of it is used."""
            return self.graph.closed and not n.labels and not n.props and (name in scope.vars or name in outside.vars or n.var is None)

        df = None
        first, here_col = path.nodes[0], f"{names[0]}__id"
        if not path.rels or not light(first, names[0]):
            df, b = self.scan(names[0])
            df = constrained(first, names[0], df, b)
            vars_[names[0]] = b
        used: list[Bound] = []
        for k, rel in enumerate(path.rels):
            name, node = names[k + 1], path.nodes[k + 1]
            rv = rel.var or self.name("r")
            if rel.hops or path.shortest:
                df, rb, end = self.hops(df, vars_, names[k], rel, rv, path.shortest, scope, outside, name)
            else:
                e, rb, here, end = self.edge_scan(rv, rel)
                for key, x in rel.props:
                    if _names(x):
                        later.append((rv, key, x))
                    else:
                        e = e.where(self.expr(s.Binary("=", s.Prop(s.Var(rv), key), x), Scope(e, OrderedDict({rv: rb}))))
                if df is None:
                    df = e.withColumn(here_col, F.col(here)).drop(here)
                    vars_[names[0]] = Bound("node", {"id": here_col})
                else:
                    df = df.join(e, F.col(vars_[names[k]].cols["id"]) == F.col(here)).drop(here)
            for other in used:
                df = df.where(_apart(other, rb))
            used.append(rb)
            if rel.var:
                vars_[rv] = rb
            if name in vars_:
                df = df.where(F.col(vars_[name].cols["id"]) == F.col(end)).drop(end)
            elif light(node, name):
                df = df.withColumn(f"{name}__id", F.col(end)).drop(end)
                vars_[name] = Bound("node", {"id": f"{name}__id"})
            else:
                n, b = self.scan(name)
                n = constrained(node, name, n, b)
                df = df.join(n, F.col(b.cols["id"]) == F.col(end)).drop(end)
                vars_[name] = b
        if path.shortest:
            df = self.shortest(df, path, used[0], names, scope)
        if path.var:
            # each hop adds the nodes and edges it passed; a variable hop adds whole lists
            nodes, rels = F.array(F.col(vars_[names[0]].cols["id"])), F.array().cast("array<string>")
            for k, b in enumerate(used):
                many = b.kind == "rels"
                nodes = F.concat(nodes, F.col(b.cols["nodes"]) if many else F.array(F.col(vars_[names[k + 1]].cols["id"])))
                rels = F.concat(rels, F.col(b.cols["eids"]) if many else F.array(F.col(b.cols["eid"])))
            c = f"{path.var}__path"
            df = df.withColumn(c, F.struct(nodes.alias("nodes"), rels.alias("relationships")))
            vars_[path.var] = Bound("path", {"path": c})
        shown = {n.var for n in path.nodes if n.var} | {r.var for r in path.rels if r.var} | ({path.var} if path.var else set()) | {v for v, _, _ in later}
        kept = OrderedDict((v, b) for v, b in vars_.items() if v in shown)
        if not kept:
            df = df.select(F.lit(1).alias(self.name("row")))
        else:
            df = df.select(*dict.fromkeys(c for b in kept.values() for c in b.cols.values()))
        return Scope(df, kept), later

    def hops(self, df, vars_, start: str, rel: s.RelPattern, rv: str, shortest, scope: Scope, outside: Scope, end_name: str):
        """Variable-length trails as a union of unrolled self-joins, or a breadth-first loop."""
        low, high = rel.hops or (1, 1)
        e, eb, here, there = self.edge_scan(self.name("e"), s.RelPattern(None, rel.types, rel.direction, None, rel.props))
        for key, x in rel.props:
            e = e.where(self.expr(s.Binary("=", s.Prop(s.Var("_e"), key), x), Scope(e, OrderedDict({"_e": eb}))))
        e = e.select(F.col(here).alias("_here"), F.col(there).alias("_there"), F.col(eb.cols["eid"]).alias("_eid"))
        if df is None:
            df, b = self.scan(start)
            vars_[start] = b
        sid = vars_[start].cols["id"]
        if start in scope.vars and scope.df is not None:
            df = df.join(scope.df.select(F.col(scope.vars[start].cols["id"]).alias(sid)).distinct(), sid, "left_semi")
        base = df.select(F.col(sid).alias("_s")).distinct()
        none = F.array().cast("array<string>")
        level = base.select("_s", F.col("_s").alias("_e"), none.alias("_eids"), none.alias("_nodes"))
        frames = [level] if low == 0 else []
        if shortest and self.work is None:
            self.work = Workspace(self.spark, "paths")
        seen = level.select("_s", "_e")
        for k in range(1, high + 1):
            level = level.join(e, F.col("_e") == F.col("_here")).where(~F.array_contains("_eids", F.col("_eid"))).select("_s", F.col("_there").alias("_e"), F.concat("_eids", F.array("_eid")).alias("_eids"), F.concat("_nodes", F.array("_there")).alias("_nodes"))
            if shortest:
                level = level.join(seen, ["_s", "_e"], "left_anti")
                if shortest == "one":
                    level = level.groupBy("_s", "_e").agg(F.min(F.struct("_eids", "_nodes")).alias("m")).select("_s", "_e", "m.*")
                level, n = self.work.stage_counted(level, n=F.count(F.lit(1)))
                if not n["n"]:
                    break
                seen = seen.unionByName(level.select("_s", "_e"))
            if k >= low:
                frames.append(level)
        out = frames[0] if frames else level.limit(0)
        for f in frames[1:]:
            out = out.unionByName(f)
        cols = {"eids": f"{rv}__eids", "nodes": f"{rv}__nodes"}
        end = f"{rv}__there"
        out = out.select(F.col("_s").alias(f"{rv}__s"), F.col("_e").alias(end), F.col("_eids").alias(cols["eids"]), F.col("_nodes").alias(cols["nodes"]))
        return df.join(out, F.col(sid) == F.col(f"{rv}__s")).drop(f"{rv}__s"), Bound("rels", cols), end

    def shortest(self, df: DataFrame, path: s.PathPattern, rb: Bound, names: list[str], scope: Scope) -> DataFrame:
        """The least depth per binding of the outside variables: its first match, or all of them."""
        outside = [F.col(f"{n}__id") for n in names if n in scope.vars]
        depth = F.size(rb.cols["eids"])
        if path.shortest == "all":
            if not outside:  # the least depth of all matches, by an aggregate with partial sums
                least = df.agg(F.min(depth).alias("_m")).scalar()
                return df.where(depth == least)
            w = Window.partitionBy(*outside).orderBy(depth)
            return df.withColumn("_k", F.rank().over(w)).where("_k = 1").drop("_k")
        order = [depth, *[F.col(f"{n}__id") for n in dict.fromkeys(names)], F.col(rb.cols["eids"])]
        if not outside:
            return df.orderBy(*order).limit(1)
        return df.withColumn("_k", F.row_number().over(Window.partitionBy(*outside).orderBy(*order))).where("_k = 1").drop("_k")

    # -- filters, unwind, projections ------------------------------------------------------

    def filter(self, scope: Scope, e: s.Expr) -> Scope:
        negated = isinstance(e, s.Unary) and e.op == "NOT" and isinstance(e.value, s.Exists)
        if isinstance(e, s.Exists) or negated:
            x = e.value if negated else e
            inner, later, shared = self.alone(scope, x.patterns)
            conds = [*[s.Binary("=", s.Prop(s.Var(v), k), y) for v, k, y in later], *_conjuncts(x.where)]
            for c in [c for c in conds if _names(c) <= set(inner.vars) - set(shared)]:
                inner = self.filter(inner, c)
            mixed = [c for c in conds if not _names(c) <= set(inner.vars) - set(shared)]
            renamed, inner = self.rename(inner, shared)
            on = [self.same(scope.vars[v], renamed[v]) for v in shared]
            if mixed:
                both = Scope(scope.df.crossJoin(inner.df), OrderedDict({**inner.vars, **scope.vars}))
                on += [self.expr(c, both) for c in mixed]
            cond = on[0] if on else F.lit(True)
            for c in on[1:]:
                cond = cond & c
            return Scope(scope.df.join(inner.df, cond, "left_anti" if negated else "left_semi"), scope.vars)
        scope, e = self.flags(scope, e)
        kind = self.type_of(e, scope)
        if not isinstance(kind, (T.BooleanType, T.NullType)):
            raise QueryError("CQL2006", "a condition must be boolean")
        return Scope(self.table(scope).where(self.expr(e, scope)), scope.vars)

    def flags(self, scope: Scope, e: s.Expr) -> tuple[Scope, s.Expr]:
        """Replaces EXISTS inside an expression by a flag that a left join brings in."""
        inside = [x for x in s.walk(e) if isinstance(x, s.Exists)]
        for x in inside:
            inner, later, shared = self.alone(scope, x.patterns)
            for c in [*[s.Binary("=", s.Prop(s.Var(v), k), y) for v, k, y in later], *_conjuncts(x.where)]:
                if not _names(c) <= set(inner.vars):
                    raise QueryError("CQL2019", "a correlated condition needs EXISTS as a condition of its own")
                inner = self.filter(inner, c)
            renamed, rest = self.rename(inner, shared)
            flag = self.name("x")
            ids = [b.cols["id" if b.kind == "node" else "eid"] for b in renamed.values()]
            known = rest.df.select(*ids).distinct().withColumn(flag, F.lit(True)) if ids else rest.df.limit(1).select(F.lit(True).alias(flag))
            cond = F.lit(True)
            for v in shared:
                cond = cond & self.same(scope.vars[v], renamed[v])
            vars_ = OrderedDict(scope.vars)
            vars_[flag] = Bound("value", {"value": flag})
            scope = Scope(self.table(scope).join(known, cond, "left").drop(*ids).withColumn(flag, F.coalesce(flag, F.lit(False))), vars_)
            e = _replace(e, x, s.Var(flag))
        return scope, e

    def unwind(self, scope: Scope, clause: s.Unwind) -> Scope:
        if clause.var in scope.vars:
            raise QueryError("CQL2005", f"{clause.var} is already bound")
        kind = self.type_of(clause.source, scope)
        if not isinstance(kind, (T.ArrayType, T.NullType)):
            raise QueryError("CQL4003", "UNWIND takes a list")
        c = self.name("v")
        vars_ = OrderedDict(scope.vars)
        vars_[clause.var] = Bound("value", {"value": c})
        return Scope(self.table(scope).select("*", F.explode(self.expr(clause.source, scope) if isinstance(kind, T.ArrayType) else F.array().cast("array<string>")).alias(c)), vars_)

    def project(self, scope: Scope, p: s.Projection) -> Scope:
        items = [s.Item(s.Var(v), v) for v in sorted(scope.vars) if not v.startswith("_")] if p.star else []
        items += p.items
        names = [i.name for i in items]
        if len(set(names)) != len(names):
            raise QueryError("CQL2015", "a name is projected twice")
        flat = []
        for i in items:
            scope, e = self.flags(scope, i.expr)
            flat.append(s.Item(e, i.name))
        df = self.table(scope)
        limited = (p.limit is not None or p.skip is not None) and not p.order
        if limited and not any(s.aggregates(i.expr) for i in flat):
            # without an order the rows come in the order of their bound nodes
            ids = [b.cols["id"] for v, b in scope.vars.items() if b.kind == "node"]
            df = df.orderBy(*ids) if ids else df
            scope = Scope(df, scope.vars)
        grouped = any(s.aggregates(i.expr) for i in flat)
        vars_: OrderedDict = OrderedDict()
        keys, aggs, plain = [], [], []
        for i in flat:
            if grouped and s.aggregates(i.expr):
                c = self.name("v")
                aggs.append(self.expr(i.expr, scope, grouping=True).alias(c))
                vars_[i.name] = Bound("value", {"value": c})
                continue
            if isinstance(i.expr, s.Var) and i.expr.name in scope.vars and scope.vars[i.expr.name].kind != "value":
                b = scope.vars[i.expr.name]
                stem = self.name("b")
                cols = {f: f"{stem}__{f.removeprefix('p:')}" for f in b.cols}
                made = [F.col(b.cols[f]).alias(c) for f, c in cols.items()]
                vars_[i.name] = Bound(b.kind, cols)
            else:
                c = self.name("v")
                made = [self.expr(i.expr, scope).alias(c)]
                vars_[i.name] = Bound("value", {"value": c})
            (keys if grouped else plain).extend(made)
        out = df.groupBy(*keys).agg(*aggs) if grouped else df.select(*plain)
        new = Scope(out, vars_)
        if p.where is not None:
            for c in _conjuncts(p.where):
                new = self.filter(new, c)
        if p.distinct:
            new = Scope(new.df.distinct(), new.vars)
        if p.order:
            order = []
            for e, down in p.order:
                hit = next((i.name for i in items if i.expr == e), None)
                c = self.expr(s.Var(hit) if hit else e, new)
                order.append(c.desc_nulls_first() if down else c.asc_nulls_last())
            new = Scope(new.df.orderBy(*order), new.vars)
        df = new.df
        if p.skip is not None:
            df = df.offset(self.count(p.skip))
        if p.limit is not None:
            df = df.limit(self.count(p.limit))
        if p.final:
            df = df.select(*[self.shown(vars_[n]).alias(n) for n in names])
            untyped = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
            df = df.select(*[(F.col(f"`{n}`").cast("string") if n in untyped else F.col(f"`{n}`")).alias(n) for n in names]) if untyped else df
        return Scope(df, new.vars)

    def count(self, e: s.Expr) -> int:
        v = self.parameters.get(e.name) if isinstance(e, s.Param) else e.value if isinstance(e, s.Literal) else None
        if not isinstance(v, int) or isinstance(v, bool) or v < 0:
            raise QueryError("CQL4002", "SKIP and LIMIT take non-negative integers")
        return v

    @staticmethod
    def shown(b: Bound) -> Column:
        if b.kind == "node":
            fields = ["id"] + (["label"] if "label" in b.cols else [])
            return F.when(F.col(b.cols["id"]).isNotNull(), F.struct(*[F.col(b.cols[f]).alias(f) for f in fields]))
        if b.kind == "rel":
            return F.when(F.col(b.cols["eid"]).isNotNull(), F.struct(*[F.col(b.cols[f]).alias(n) for f, n in (("eid", "id"), ("src", "source"), ("dst", "target"), ("type", "type"))]))
        return F.col(b.cols[{"rels": "eids", "path": "path", "value": "value"}[b.kind]])

    # -- expressions -----------------------------------------------------------------------

    def type_of(self, e: s.Expr, scope: Scope) -> T.DataType:
        sampled = Scope(scope.df, scope.vars, {n: (sample, sample) for n, (_, sample) in scope.local.items()})
        df = self.table(scope)
        return df.select(self.expr(e, sampled, grouping=s.aggregates(e))).schema[0].dataType

    def expr(self, e: s.Expr, scope: Scope, grouping: bool = False) -> Column:
        from .expressions import Translator

        return Translator(self, scope, grouping).column(e)


def _apart(a: Bound, b: Bound) -> Column:
    """No edge stands twice in a path."""
    if a.kind == "rel" and b.kind == "rel":
        return F.col(a.cols["eid"]) != F.col(b.cols["eid"])
    if a.kind == "rels" and b.kind == "rels":
        return ~F.arrays_overlap(a.cols["eids"], b.cols["eids"])
    one, many = (a, b) if a.kind == "rel" else (b, a)
    return ~F.array_contains(many.cols["eids"], F.col(one.cols["eid"]))


def _conjuncts(e: s.Expr | None) -> list[s.Expr]:
    if e is None:
        return []
    if isinstance(e, s.Binary) and e.op == "AND":
        return _conjuncts(e.left) + _conjuncts(e.right)
    return [e]


def _names(e: s.Expr) -> set[str]:
    """Free variables of an expression."""
    if isinstance(e, s.Var):
        return {e.name}
    if isinstance(e, s.Quantifier):
        return _names(e.source) | (_names(e.where) - {e.var})
    out: set[str] = set()
    for c in s.children(e):
        out |= _names(c)
    return out


def _replace(e, old, new):
    if e is old:
        return new
    if isinstance(e, s.Expr):
        values = {}
        for f in e.__dataclass_fields__:
            v = getattr(e, f)
            values[f] = tuple(_replace(x, old, new) if isinstance(x, s.Expr) else tuple(_replace(y, old, new) if isinstance(y, s.Expr) else y for y in x) if isinstance(x, tuple) else x for x in v) if isinstance(v, tuple) else _replace(v, old, new) if isinstance(v, s.Expr) else v
        return type(e)(**values)
    return e


def _rank(p: s.PathPattern, bound) -> int:
    """Selectivity of a pattern: bound variable, id, label with properties, label, type, nothing."""
    if any(n.var in bound for n in p.nodes if n.var):
        return -1
    best = 4 if not any(r.types for r in p.rels) else 3
    for n in p.nodes:
        best = min(best, 0 if any(k == "id" for k, _ in n.props) else 1 if n.labels and n.props else 2 if n.labels else 4)
    return best


def _ordered(patterns, bound) -> list[s.PathPattern]:
    """Patterns in the order of selectivity, connected ones first."""
    left, known, out = list(patterns), set(bound), []
    while left:
        p = min(left, key=lambda x: (_rank(x, known), patterns.index(x)))
        left.remove(p)
        out.append(p)
        known |= {n.var for n in p.nodes if n.var}
    return out


def _expressions(clauses):
    for c in clauses:
        if isinstance(c, s.Match):
            tops = [v for p in c.patterns for n in (*p.nodes, *p.rels) for _, v in n.props] + ([c.where] if c.where is not None else [])
        elif isinstance(c, s.Unwind):
            tops = [c.source]
        else:
            tops = [i.expr for i in c.items] + [e for e, _ in c.order] + ([c.where] if c.where is not None else [])
        for t in tops:
            yield from s.walk(t)


def _keys(clauses):
    for c in clauses:
        if isinstance(c, s.Match):
            for p in c.patterns:
                for n in (*p.nodes, *p.rels):
                    yield from (k for k, _ in n.props)
    for e in _expressions(clauses):
        if isinstance(e, s.Prop):
            yield e.key
        if isinstance(e, s.Exists):
            for p in e.patterns:
                for n in (*p.nodes, *p.rels):
                    yield from (k for k, _ in n.props)
