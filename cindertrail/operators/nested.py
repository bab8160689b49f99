"""Deeply nested records as related flat tables, by Merkle identities of their subtrees.

Each payload is read once. Every object of interest is canonicalised (keys sorted, the
producer's shape unwrapped: a list, a map by key, a single object or JSON text inside a
string all give the same children) and hashed bottom-up, the hash covering the node's own
fields and the hashes of its children. Equal objects are stored once in the object table;
each occurrence stays in the bridge table, which names frame, parent occurrence, ordinal,
object and the name it goes by. The bridge rows of a frame stay together until they are read, so
that a child finds its parents without a join, and an object that stands in every frame is no
hot key.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindertrail.session import materialise


@dataclass(frozen=True)
class Rel:
    """A child relation: where it hangs, which member it reads and what names its children."""

    name: str
    member: str
    parent: str | None  # relation of the parent, None for the record itself
    label: tuple[str, ...]  # members that name a child, joined with ``joint``
    joint: str = ">"
    inside: str | None = None  # member of the record that holds ``member``


#: Relations of a simulation frame.
FRAME_RELS = (
    Rel("health", "health", None, ("service",)),
    Rel("incident", "incidents", None, ("id",)),
    Rel("node", "nodes", None, ("id",), inside="topology"),
    Rel("edge", "edges", None, ("source", "target"), inside="topology"),
    Rel("evidence", "evidence", "incident", ("algorithm",)),
    Rel("reference", "references", "evidence", ()),
)


def unwrap(value):
    """JSON text inside a string as the value it denotes; other values as they are."""
    while isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        try:
            value = json.loads(value)
        except ValueError:
            break
    return value


def children(value, label: tuple[str, ...]) -> list:
    """The children a member holds, whatever its shape; nulls are no children.

    A list holds its elements; an object that has a naming member is a single child; any
    other object maps a child's name to the child; a scalar is a single child.
    """
    value = unwrap(value)
    if value is None or value == "":
        return []
    if isinstance(value, list):
        return [c for c in (unwrap(v) for v in value) if c is not None]
    if isinstance(value, dict):
        if not value:
            return []
        if not label or any(k in value and not isinstance(value[k], (dict, list)) for k in label):
            return [value]
        named = []
        for key, held in value.items():
            held = unwrap(held)
            for one in held if isinstance(held, list) else [held]:
                one = unwrap(one)
                if one is None:
                    continue
                if isinstance(one, dict) and len(label) == 1:
                    one = {label[0]: key, **one}
                named.append(one)
        return named
    return [value]


#: A value as canonical text: members sorted, no blanks.
canonical = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode


def text(value) -> str:
    """A naming value as text: strings as they are, whole numbers without a fraction."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return canonical(value)


def name_of(value, rel: Rel) -> str:
    if isinstance(value, dict):
        return rel.joint.join(text(value.get(k)) for k in rel.label) if rel.label else text(value)
    return text(value)


def digest(kind: str, body: str, below: list[bytes]) -> bytes:
    """Identity of a subtree: its kind, its own fields and the identities of its children."""
    raw = body.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(b"%s %d %s%s" % (kind.encode(), len(raw), raw, b"".join(below)), digest_size=16).digest()


def shred(payload: str | None, rels: tuple[Rel, ...] = FRAME_RELS):
    """(root hash, nodes) of a payload, or None if it isn't one complete JSON object.

    A node is [occ, parent occ, rel, ordinal, hash, label, body]; the record itself is
    occurrence 0. Ordinals count the children of one member from 0.
    """
    try:
        record = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(record, dict):
        return None
    nodes: list[list] = []
    under: dict[str | None, list[Rel]] = {}
    for rel in rels:
        under.setdefault(rel.parent, []).append(rel)

    def visit(owner: dict, owner_rel: str | None, occ: int) -> tuple[list[bytes], set[str]]:
        hashes: list[bytes] = []
        taken: set[str] = set()
        for rel in under[owner_rel]:
            holder = owner
            if rel.inside is not None:
                holder = unwrap(owner.get(rel.inside))
                taken.add(rel.inside)
            taken.add(rel.member)
            if not isinstance(holder, dict):
                continue
            inner_rels = rel.name in under
            for ordinal, child in enumerate(children(holder.get(rel.member), rel.label)):
                own = len(nodes) + 1
                node = [own, occ, rel.name, ordinal, b"", name_of(child, rel), ""]
                nodes.append(node)
                below: list[bytes] = []
                body = child
                if inner_rels and isinstance(child, dict):
                    below, inner = visit(child, rel.name, own)
                    body = {k: v for k, v in child.items() if k not in inner}
                node[6] = canonical(body)
                node[4] = digest(rel.name, node[6], below)
                hashes.append(node[4])
        return hashes, taken

    below, taken = visit(record, None, 0) if None in under else ([], set())
    root_body = canonical({k: v for k, v in record.items() if k not in taken})
    return digest("record", root_body, below), root_body, nodes


NODE = "struct<occ:int,parent_occ:int,rel:string,ordinal:int,hash:binary,label:string>"
OBJECT = "struct<hash:binary,rel:string,label:string,body:string>"


NODE_TYPES = {"occ": pa.int32(), "parent_occ": pa.int32(), "rel": pa.string(), "ordinal": pa.int32(), "hash": pa.binary(), "label": pa.string()}
OBJECT_TYPES = {"hash": pa.binary(), "rel": pa.string(), "label": pa.string(), "body": pa.string()}


def _structs(sizes: list[int], rows: list[list], types: dict[str, pa.DataType]) -> pa.ListArray:
    """Rows as lists of structs; list i holds the rows up to ``sizes[i + 1]``."""
    columns = zip(*rows) if rows else [()] * len(types)
    flat = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)


@dataclass
class Shredded:
    """frames(<keys>, hash, nodes): the records that stand, with their bridge rows in order of ``occ``.

    ``told``: the objects as each batch of records met them, if they were asked for.
    """

    frames: DataFrame
    keys: tuple[str, ...]
    told: DataFrame | None = None

    @property
    def bridge(self) -> DataFrame:
        """<keys>, occ, parent_occ, rel, ordinal, hash, label: each occurrence under its parent's."""
        return self.frames.select(*self.keys, F.explode("nodes").alias("n")).select(*self.keys, "n.*")

    @property
    def objects(self) -> DataFrame:
        """hash, rel, label, body, occurrences: each distinct object of the standing records once."""
        used = self.frames.select("hash").unionAll(self.frames.select(F.explode(F.transform("nodes", lambda n: n["hash"]))))
        used = used.groupBy("hash").agg(F.count("*").alias("occurrences"))
        first = [F.first(c).alias(c) for c in ("rel", "label", "body")]
        return self.told.groupBy("hash").agg(*first).join(used, "hash")


def shred_frames(
    frames: DataFrame,
    keys: tuple[str, ...] = ("session_id", "seq"),
    payload: str = "payload",
    version: str = "frame_id",
    rels: tuple[Rel, ...] = FRAME_RELS,
    objects: bool = True,
) -> Shredded:
    """Shred a table of JSON payloads; a record sent again (same ``keys``) counts once.

    Of several readable payloads of one record that with the smallest ``version`` stands.
    Null, empty, broken and non-object payloads give no rows. Null keys are keys like any
    other. Extra columns are ignored; an empty table gives empty tables. ``objects``: whether
    the object table is wanted.
    """
    kinds = dict(frames.dtypes)
    names = [*keys, "version", "hash", "nodes", *(["fresh"] if objects else [])]
    types = [*(kinds[c] for c in (*keys, version)), "binary", f"array<{NODE}>", f"array<{OBJECT}>"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, roots, sizes, nodes = [], [], [0], []
            told, fresh, fresh_sizes = set(), [], [0]  # an object is told once a batch
            for i, raw in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if (found := shred(raw if isinstance(raw, str) else None, rels)) is None:
                    continue
                root, body, mine = found
                at.append(i)
                roots.append(root)
                nodes += mine
                sizes.append(len(nodes))
                if objects:
                    for o in ([root, "record", "", body], *([n[4], n[2], n[5], n[6]] for n in mine)):
                        if o[0] not in told:
                            told.add(o[0])
                            fresh.append(o)
                    fresh_sizes.append(len(fresh))
            head = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
            out = [*head, pa.array(roots, pa.binary()), _structs(sizes, [n[:6] for n in nodes], NODE_TYPES)]
            if objects:
                out.append(_structs(fresh_sizes, fresh, OBJECT_TYPES))
            yield pa.RecordBatch.from_arrays(out, names=names)

    parsed = frames.select(*keys, F.col(version).alias("version"), payload).mapInArrow(read, ", ".join(f"`{n}` {t}" for n, t in zip(names, types)))
    parsed = materialise(parsed, "frames")
    stands = parsed.groupBy(*keys).agg(F.min("version").alias("version"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "version")]
    kept = parsed.select(*keys, "version", "hash", "nodes").alias("a").join(stands.alias("b"), same, "left_semi")
    told = parsed.select(F.explode("fresh").alias("o")).select("o.*") if objects else None
    return Shredded(kept.select(*keys, "hash", "nodes"), keys, told)


def child_rows(s: Shredded, rels: tuple[Rel, ...] = FRAME_RELS) -> DataFrame:
    """rel, <keys>, parent_key, child_key of every occurrence, resolved through the bridge.

    The key of a child is its label; the key of a parent is the path of labels from below the
    record, joined with a slash.
    """
    above = {r.name: r.parent for r in rels}
    depth = max(len(list(_ancestors(r.name, above))) for r in rels)

    def path(occ: Column, levels: int) -> Column:
        node = F.col("nodes")[occ - 1]
        if levels == 1:
            return node["label"]
        return F.when(node["parent_occ"] == 0, node["label"]).otherwise(F.concat(path(node["parent_occ"], levels - 1), F.lit("/"), node["label"]))

    def row(n: Column) -> Column:
        parent = F.when(n["parent_occ"] == 0, F.lit("")).otherwise(path(n["parent_occ"], depth)) if depth else F.lit("")
        return F.struct(n["rel"].alias("rel"), parent.alias("parent_key"), n["label"].alias("child_key"))

    rows = s.frames.select(*s.keys, F.transform("nodes", row).alias("rows"))
    return rows.select(*s.keys, F.explode("rows").alias("r")).select("r.rel", *s.keys, "r.parent_key", "r.child_key")


def _ancestors(name: str | None, above: dict[str, str | None]) -> Iterator[str]:
    while (name := above.get(name)) is not None:
        yield name
