"""Deeply nested records to flat tables by Merkle subtree identities.

Objects and lists are canonicalised and hashed from the leaves up, so equal subtrees get
equal identities wherever they stand. ``objects`` stores each identity once with its own
scalar members; ``bridge`` keeps every occurrence: the record that owns it, the occurrence
that holds it, the member it stands under and its ordinal there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json import decode, key_text, scalar
from ..runtime import Workspace

#: Members whose single object stands for a list of one.
LIST_MEMBERS = ("evidence", "stages", "mergedFrom", "candidates")

_SCHEMA = "owner_table string, owner_id string, document binary, occurrence bigint, parent bigint, parent_hash binary, member string, idx bigint, listed boolean, child_hash binary, parent_path string, body string"
_ARROW = pa.schema([("owner_table", pa.string()), ("owner_id", pa.string()), ("document", pa.binary()), ("occurrence", pa.int64()), ("parent", pa.int64()), ("parent_hash", pa.binary()), ("member", pa.string()), ("idx", pa.int64()), ("listed", pa.bool_()), ("child_hash", pa.binary()), ("parent_path", pa.string()), ("body", pa.string())])
BRIDGE = ("owner_table", "owner_id", "document", "occurrence", "parent", "parent_hash", "member", "idx", "listed", "child_hash", "parent_path")
#: Characters a task holds before it hands rows on.
PORTION = 4_000_000


class Flat(NamedTuple):
    """The flat tables of nested records; see :func:`flatten`."""

    bridge: DataFrame
    objects: DataFrame
    unreadable: DataFrame


def _unwrap(value):
    """A string that itself holds a JSON object or list counts as that value."""
    while type(value) is str and value.lstrip()[:1] in ("{", "["):
        try:
            value = decode(value)
        except ValueError:
            break
    return value


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def _plain(name: str) -> str:
    """A name that Arrow can hold: halves of surrogate pairs become question marks."""
    return name if name.isascii() else name.encode("utf-8", "replace").decode()


class _Node:
    """A container of a document: its value, where it stands, and what it holds, in order."""

    __slots__ = ("idx", "key", "listed", "member", "number", "parent", "parts", "value")

    def __init__(self, value, parent, member, idx, listed):
        self.value, self.parent, self.member, self.idx, self.listed = value, parent, member, idx, listed
        self.parts: list[tuple] = []  # (member, idx, listed, node or scalar text)
        self.key = b""


class _Flattener:
    """Walks one document without recursion, so that nesting depth is bounded by memory only."""

    def __init__(self, path_members: frozenset[str] | None, list_members: tuple[str, ...]):
        self.path_members, self.list_members = path_members, frozenset(list_members)
        self.sent: set[bytes] = set()

    def rows(self, table: str, owner: str, text: str) -> Iterator[tuple]:
        try:
            value = _unwrap(decode(text))
        except ValueError:
            value = None
        if not isinstance(value, (dict, list)):
            yield table, owner, None, None, None, None, None, None, None, None, None, None
            return
        nodes = self._open(value)
        for node in reversed(nodes):  # leaves first: a container is numbered after the one that holds it
            yield from self._identify(node)
        root = nodes[0]
        document = root.key
        n = 0
        for node in nodes:  # in the order of discovery, which sorted members make canonical
            if node is root:
                node.number = 0
                yield table, owner, document, 0, None, None, None, 0, False, document, None, None
            wanted = None
            for member, idx, listed, item in node.parts:
                n += 1
                if type(item) is _Node:
                    item.number, key = n, item.key
                else:
                    key = item
                path = None
                if member is not None and (self.path_members is None or member in self.path_members):
                    path = wanted = self._path(node) if wanted is None else wanted
                yield table, owner, document, n, node.number, node.key, member, idx, listed, key, path, None
        for node in nodes:  # no cycles are left behind for the garbage collector
            node.parent = None
            node.parts = ()

    def _open(self, value) -> list[_Node]:
        """All containers of a document, each after the one that holds it."""
        nodes = [_Node(value, None, None, 0, False)]
        for node in nodes:
            value = node.value
            if isinstance(value, list):
                for i, v in enumerate(value):
                    self._hold(nodes, node, None, i, True, _unwrap(v))
                continue
            for member in sorted(value):
                v = value[member]
                if type(v) is str:
                    v = _unwrap(v) if v[:1] in "{[ \n\r\t" else v
                    if type(v) is str:
                        continue
                if isinstance(v, dict):
                    self._hold(nodes, node, member, 0, False, v)
                elif isinstance(v, list):
                    for i, x in enumerate(v):
                        self._hold(nodes, node, member, i, True, _unwrap(x))
                else:
                    continue
                value[member] = v
        return nodes

    def _hold(self, nodes: list[_Node], node: _Node, member, idx, listed, item) -> None:
        if isinstance(item, (dict, list)):
            item = _Node(item, node, member, idx, listed)
            nodes.append(item)
        else:
            item = scalar(item)
        node.parts.append((member, idx, listed, item))

    def _identify(self, node: _Node) -> Iterator[tuple]:
        """Set a container's identity, and the identities of the scalars it lists, from those below."""
        below: list[str] = []
        parts: list[tuple] = []
        last = None
        for member, idx, listed, item in node.parts:
            if type(item) is _Node:
                key = item.key
                parts.append((member, idx, listed, item))
            else:
                key = _digest("s" + item)
                parts.append((member, idx, listed, key))
                yield from self._object(key, item)
            if member != last:
                below.append(f"|{key_text(member)}{':' if listed else '='}")
                last = member
            below.append(key.hex())
        value = node.value
        if isinstance(value, dict):
            own = [f"{key_text(k)}:{'[]' if v == [] else scalar(v)}" for k, v in sorted(value.items()) if v is not None and (v == [] or not isinstance(v, (dict, list)))]
            body = "{" + ",".join(own) + "}"
        else:
            body = "[]"
        node.parts = parts
        node.key = _digest(body + "".join(below))
        yield from self._object(node.key, body)

    def _object(self, key: bytes, body: str) -> Iterator[tuple]:
        if key not in self.sent:
            if len(self.sent) > 500_000:
                self.sent.clear()  # a body sent twice is stored once all the same
            self.sent.add(key)
            yield None, None, None, None, None, None, None, None, None, key, None, body

    def _path(self, node: _Node) -> str:
        """Where a container stands in its document, such as ``evidence[1].resolution``."""
        steps: list[str] = []
        while node.parent is not None:
            at = f"[{node.idx}]" if node.listed or node.member in self.list_members else ""
            if node.member is None:
                steps.append(at)
            else:
                steps.append(f"{'.' if self._named_above(node) else ''}{_plain(node.member)}{at}")
            node = node.parent
        return "".join(reversed(steps))

    @staticmethod
    def _named_above(node: _Node) -> bool:
        return node.parent.parent is not None


def flatten(owners: DataFrame, *, path_members: tuple[str, ...] | None = (), list_members: tuple[str, ...] = LIST_MEMBERS) -> Flat:
    """``(bridge, objects, unreadable)`` of ``owners(owner_table, owner_id, attributes)``.

    ``bridge(owner_table, owner_id, document, occurrence, parent, parent_hash, member, idx,
    listed, child_hash, parent_path)`` has a row for each object, each element of a list and
    each document's root. ``document`` is the root's identity and tells apart what one owner
    was delivered with; ``occurrence`` numbers the rows of a document, ``parent`` is the
    number of the occurrence that holds this one (null for the root), ``member`` the name it
    stands under there (null for the root and for an element of a list inside a list),
    ``idx`` its ordinal and ``listed`` whether it stood in a list. ``parent_path`` spells the
    way to the holder for occurrences under ``path_members`` (None: under any; a path is as
    long as its depth, so all paths of one deep text are quadratic in it).

    ``objects(object_hash, body)`` has each distinct identity once: ``body`` is an object's
    scalar and empty members as canonical JSON, ``[]`` for a list, or the scalar itself. With
    the bridge, each document can be put together again, save for members that are null.

    ``unreadable(owner_table, owner_id)`` names the deliveries whose text is no JSON object
    or list.

    Defined results: null attributes give nothing; repeated deliveries of one owner with
    equal content give each occurrence once; equal numbers have one identity however they are
    spelled; a list as a document or inside a list is an occurrence of its own; null members
    count as absent, null elements are kept; nesting may have any depth; empty tables give
    empty tables; other columns of ``owners`` are ignored.
    """
    work = Workspace(owners.sparkSession, "nested")
    docs = owners.select("owner_table", "owner_id", "attributes").where("attributes is not null")
    names = None if path_members is None else frozenset(path_members)

    def run(batches):
        walker = _Flattener(names, list_members)
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for table, owner, text in zip(*[c.to_pylist() for c in batch.columns]):
                for row in walker.rows(table, owner, text):
                    out.append(row)
                    held += 200 + len(row[10] or "") + len(row[11] or "")
                    if held > PORTION:
                        yield _batch(out)
                        out, held = [], 0
        if out:
            yield _batch(out)

    mixed = work.stage(docs.mapInArrow(run, _SCHEMA))
    bridge = mixed.where("occurrence is not null").select(*BRIDGE).distinct()
    # equal identities have equal bodies, so both may be grouped by hash aggregation
    objects = mixed.where("body is not null").select(F.col("child_hash").alias("object_hash"), "body").distinct()
    unreadable = mixed.where("child_hash is null").select("owner_table", "owner_id").distinct()
    return Flat(bridge, objects, unreadable)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    columns[6] = [None if m is None else _plain(m) for m in columns[6]]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW)], schema=_ARROW)


def resolution_candidates(owners: DataFrame) -> DataFrame:
    """Each element under a ``candidates`` member: (owner_table, owner_id, parent_path, idx, candidate_id).

    Read from the bridge of all occurrences and the objects they stand for. ``candidate_id``
    is the object's ``nodeId``, else its ``node_id``, or the bare string itself; elements that
    are numbers, booleans, nulls or lists name nothing and are left out.
    """
    bridge, objects, _ = flatten(owners, path_members=("candidates",))
    body = F.col("body")
    name = F.when(body.startswith("{"), F.coalesce(F.get_json_object(body, "$.nodeId"), F.get_json_object(body, "$.node_id"))).when(body.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), body, F.lit("}")), "$.v"))
    named = objects.where(body.startswith("{") | body.startswith('"')).select(F.col("object_hash").alias("child_hash"), name.alias("candidate_id"))
    found = bridge.where("member = 'candidates'").join(named, "child_hash")
    return found.select("owner_table", "owner_id", "parent_path", "idx", "candidate_id").distinct()
