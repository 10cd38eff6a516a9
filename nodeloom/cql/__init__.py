"""A read-only pattern query language over property graphs, compiled to DataFrame plans."""

from __future__ import annotations

import hashlib
import re
import threading
import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame

from ..graph import PropertyGraph
from . import syntax
from .compiler import Compiler
from .errors import QueryError

_parsed: OrderedDict[str, syntax.Query] = OrderedDict()


def _parse(source: str) -> syntax.Query:
    """Parsed queries are kept, the least recently used of 1024 going first."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key in _parsed:
        _parsed.move_to_end(key)
    else:
        _parsed[key] = syntax.parse(source)
        if len(_parsed) > 1024:
            _parsed.popitem(last=False)
    return _parsed[key]


def query(graph: PropertyGraph, source: str, **parameters) -> DataFrame:
    """The result of a query as a lazy DataFrame.

    EXPLAIN gives (step, operator) without running anything; PROFILE runs the query and adds
    the number of rows it returned.
    """
    parsed = _parse(source)
    if parsed.mode == "run":
        return Compiler(graph, parameters).run(parsed)
    steps = list(enumerate(explain(source)))
    if parsed.mode == "explain":
        return graph.spark.createDataFrame(steps, "step int, operator string")
    n = Compiler(graph, parameters).run(parsed).count()
    return graph.spark.createDataFrame([(k, o, n if k == len(steps) - 1 else None) for k, o in steps], "step int, operator string, rows bigint")


#: Limits of a query whose rows come to the driver: rows, seconds and bytes.
MAX_ROWS, MAX_SECONDS, MAX_BYTES = 10_000, 5.0, 256 << 20
_CODE = re.compile(r"(CQL\d{4}): ([^\n\"]*?)(?= SQLSTATE|[\n\"]|$)")


def _size(value) -> int:
    """Bytes a value takes at least."""
    if isinstance(value, str):
        return 24 + len(value)
    if isinstance(value, dict):
        return 64 + sum(_size(k) + _size(v) for k, v in value.items())
    return 64 + sum(map(_size, value)) if isinstance(value, (list, tuple)) else 16


def rows(graph: PropertyGraph, source: str, *, max_rows: int = MAX_ROWS, max_seconds: float | None = MAX_SECONDS, max_bytes: int = MAX_BYTES, **parameters) -> list[tuple]:
    """All rows at the driver, within limits whose breach is an error, never a silent cut.

    CQL3004: more than ``max_rows``. CQL3007: not done after ``max_seconds`` (None: no limit);
    the jobs are cancelled. CQL3006: the rows take more than ``max_bytes``. Errors that only
    show while rows are computed (CQL4003, CQL4005, CQL4006, CQL4018) keep their codes.
    """
    context = graph.spark.sparkContext
    tag, late = f"cql-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(max_seconds, stop) if max_seconds is not None else None
    out: list[tuple] = []
    context.addJobTag(tag)
    try:
        if timer:
            timer.start()
        held = 0
        for r in query(graph, source, **parameters).limit(max_rows + 1).collect():
            out.append(tuple(r))
            held += _size(out[-1])
            if held > max_bytes:
                raise QueryError("CQL3006", f"the result takes more than {max_bytes} bytes")
    except QueryError:
        raise
    except Exception as failed:
        if late.is_set():
            raise QueryError("CQL3007", f"the query was not done after {max_seconds} seconds") from failed
        told = _CODE.search(str(failed))
        if told:
            raise QueryError(told[1], told[2]) from failed
        if "ARITHMETIC_OVERFLOW" in str(failed):
            raise QueryError("CQL4006", "numeric result is outside the range") from failed
        raise
    finally:
        context.removeJobTag(tag)
        if timer:
            timer.cancel()
    if len(out) > max_rows:
        raise QueryError("CQL3004", f"the result has more than {max_rows} rows")
    if late.is_set():
        raise QueryError("CQL3007", f"the query was not done after {max_seconds} seconds")
    ordered = any(isinstance(c, syntax.Projection) and c.final and c.order for c in _parse(source).parts[-1])
    return out if ordered or _parse(source).mode != "run" else sorted(out, key=repr)


def access_paths(source: str) -> list[tuple[int, str, str]]:
    """(part, variable, path) of the node each pattern starts at: how its candidates are found.

    A bound variable comes first, then equality on id, source file or display label (inside
    the pattern or in WHERE), then the label, then a scan of all nodes.
    """
    out = []
    for k, part in enumerate(_parse(source).parts):
        bound: set[str] = set()
        for c in part:
            if not isinstance(c, syntax.Match):
                continue
            equal = {(x.left.target.name, x.left.key) for x in _all_of(c.where) if isinstance(x, syntax.Binary) and x.op == "=" and isinstance(x.left, syntax.Prop) and isinstance(x.left.target, syntax.Var)}
            for p in c.patterns:
                n = p.nodes[0]
                keys = {key for key, _ in n.props} | {key for var, key in equal if var == n.var}
                path = "bound" if n.var in bound else next((name for key, name in (("id", "id"), ("source_file", "source_file"), ("node_label", "display_label")) if key in keys), "label" if n.labels else "scan")
                out.append((k, n.var or "", path))
                bound |= {x.var for x in (*p.nodes, *p.rels) if x.var}
    return out


def _all_of(where) -> list:
    """The conditions that a WHERE joins by AND."""
    if isinstance(where, syntax.Binary) and where.op == "AND":
        return _all_of(where.left) + _all_of(where.right)
    return [] if where is None else [where]


def explain(source: str) -> list[str]:
    """The logical operators of a query, in order."""
    out: list[str] = []
    for k, part in enumerate(_parse(source).parts):
        for c in part:
            if isinstance(c, syntax.Match):
                for p in c.patterns:
                    out += ["NodeScan"] + ["Expand"] * len(p.rels)
                out += ["Filter"] * (c.where is not None) + ["Optional"] * c.optional
            elif isinstance(c, syntax.Unwind):
                out.append("Unwind")
            else:
                out.append("Aggregate" if any(syntax.aggregates(i.expr) for i in c.items) else "Project")
                out += ["Filter"] * (c.where is not None) + ["Distinct"] * c.distinct + ["Sort"] * bool(c.order) + ["Skip"] * (c.skip is not None) + ["Limit"] * (c.limit is not None)
        out += ["Union"] * (k > 0)
    return out


__all__ = ["QueryError", "access_paths", "explain", "query", "rows"]
