"""Conversation prefix trie, family by family first: turns move once, as digests, and later only the families' combined nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Conversations of one family have ids that differ in their remainder by this only.
FAMILY = 20
#: Most turns that a conversation takes from the first of its family, plus one.
SHARED = 4
ROOT = bytes(32)
#: Nodes that a task keeps of a family before it hands them on; more of the same family follow as further rows.
HELD = 100_000
#: Bytes of ids in one piece of a list of ends.
PIECE = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"

NODES = "base long, digest binary, depth long, parent binary, words long, n long, conv_id long, inner boolean, ends array<long>"
SUMS = "digest binary, n_leaves long, saved_tokens long, n_children long"


def _base(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def turns(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, h, turn, digest, words): a digest of role and text for each turn, made where the text lies."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv_id = F.col("conv_id").cast("long")
    return conversations.where("conv_id is not null").select(
        _base(conv_id).alias("base"),
        conv_id.alias("conv_id"),
        (F.crc32(conv_id.cast("string")) % SHARED).cast("int").alias("h"),
        "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


class _Family:
    """The trie of one family: every conversation's turns in their order, the first conversation of the family before the others."""

    def __init__(self, base: int):
        self.base, self.nodes, self.heads, self.conv = base, {}, [], None

    def _node(self) -> list:
        found = self.nodes.get(self.path)
        if found is None:  # depth, parent, words, members, smallest member, has children, members that end here
            found = self.nodes[self.path] = [self.depth, self.parent, self.words, 0, None, False, []]
        return found

    def _visit(self) -> None:
        node = self._node()
        node[3] += 1
        node[4] = self.conv if node[4] is None else min(node[4], self.conv)

    def _step(self, turn: bytes, words: int) -> None:
        self._node()[5] = True
        self.path, self.parent = hashlib.sha256(self.path + turn).digest(), self.path
        self.depth, self.words = self.depth + 1, words
        self._visit()

    def begin(self, conv: int, h: int) -> None:
        self.conv, self.skipped, self.seen = conv, 0 if conv == self.base else h, 0
        self.path, self.parent, self.depth, self.words = ROOT, None, 0, 0
        self._visit()
        for turn, words in self.heads[: self.skipped]:
            self._step(turn, words)

    def turn(self, turn: bytes, words: int) -> None:
        if self.conv == self.base and self.seen < SHARED - 1:
            self.heads.append((turn, words))
        if self.seen >= self.skipped:
            self._step(turn, words)
        self.seen += 1

    def end(self) -> None:
        self._node()[6].append(self.conv)

    def taken(self) -> list[tuple]:
        rows = [(self.base, digest, *node) for digest, node in self.nodes.items()]
        self.nodes = {}
        return rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


_NODES = pa.schema([("base", pa.int64()), ("digest", pa.binary()), ("depth", pa.int64()), ("parent", pa.binary()), ("words", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64()), ("inner", pa.bool_()), ("ends", pa.list_(pa.int64()))])
_SUMS = pa.schema([("digest", pa.binary()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("n_children", pa.int64())])
_PIECES = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("piece", pa.binary())])
_ENDS = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _built(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Combined nodes of each family, from rows in order of family, conversation (the family's first before all) and turn."""
    family, out = None, []
    for base, conv, h, turn, words in _rows(batches):
        if family is None or base != family.base:
            if family:
                family.end()
                out += family.taken()
            family = _Family(base)
        if conv != family.conv:
            if family.conv is not None:
                family.end()
            family.begin(conv, h)
        family.turn(turn, words)
        if len(family.nodes) >= held:
            out += family.taken()
        if len(out) >= min(held, 10_000):
            yield _batch(out, _NODES)
            out = []
    if family:
        family.end()
        out += family.taken()
    if out:
        yield _batch(out, _NODES)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each family adds to each of its nodes' sums: leaves, savings and children that the family owns, from its deepest
    nodes up. Only one level's sums are held, and a family has as many nodes on a level as conversations at most."""
    at, below, here, out = None, {}, {}, []

    def close(into: dict) -> None:
        for digest, (parent, own, saved, leaf) in here.items():
            leaves, saves, children = below.pop(digest, (0, 0, 0))
            leaves, saves = leaves + leaf, saves + saved
            if leaves or saves or children:
                out.append((digest, leaves, saves, children))
            if parent is not None:
                a, b, c = into.get(parent, (0, 0, 0))
                into[parent] = (a + leaves, b + saves, c + own)
        here.clear()

    for base, depth, digest, parent, own, saved, leaf in _rows(batches):
        if (base, depth) != at:
            above = {}
            close(above)
            below = above if at and at[0] == base else {}
            at = (base, depth)
        known = here.get(digest, (parent, 0, 0, 0))
        here[digest] = (parent, known[1] + own, known[2] + saved, known[3] + leaf)
        if len(out) >= 10_000:
            yield _batch(out, _SUMS)
            out = []
    close({})
    if out:
        yield _batch(out, _SUMS)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node that follow one another, joined by commas, in pieces of about PIECE bytes."""
    at, first, ids, size, out = None, None, [], 0, []
    for digest, conv in _rows(batches):
        if digest != at or size >= PIECE:
            if ids:
                out.append((at, first, ",".join(ids).encode()))
            at, first, ids, size = digest, conv, [], 0
            if len(out) >= 1_000 or len(out) and len(out[-1][2]) >= PIECE:
                yield _batch(out, _PIECES)
                out = []
        ids.append(str(conv))
        size += len(ids[-1]) + 1
    if ids:
        out.append((at, first, ",".join(ids).encode()))
    if out:
        yield _batch(out, _PIECES)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in their order; a digest's state is all that is held of a node."""
    at, state, out = None, None, []
    for digest, piece in _rows(batches):
        if digest != at:
            if state:
                out.append((at, state.hexdigest()))
            at, state = digest, hashlib.sha256(piece)
        else:
            state.update(b"," + piece)
        if len(out) >= 10_000:
            yield _batch(out, _ENDS)
            out = []
    if state:
        out.append((at, state.hexdigest()))
    if out:
        yield _batch(out, _ENDS)


def family_nodes(conversations: DataFrame, held: int = HELD) -> DataFrame:
    """NODES: the combined nodes of every family's own trie (a node may come in several rows, whose n and ends add up).

    Conversations are grouped with the first of their family: both sides are one table, so turns are dealt by family and
    sorted, the first conversation before the others, and a task reads a family as a stream.
    """
    dealt = turns(conversations).repartition("base")
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "digest", "words"]
    rows = dealt.sortWithinPartitions(*order).select("base", "conv_id", "h", "digest", "words")
    return rows.mapInArrow(partial(_built, held=held), NODES)


def prefix_trie(conversations: DataFrame, held: int = HELD) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations (conv_id, turn, role, text): conv_id
    (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c is rebuilt from the first h turns of conversation c - c % 20 (h = crc32(c) % 4) and its own after its
    first h. Steps: every family's trie is built in one pass; its combined nodes are merged by digest, after partial sums in
    each task, so that a root or a first turn that all share costs a row a task. A node is owned by the family of its smallest
    member, which has all its ancestors too: families fold what they own, from the deepest level up, and these sums are
    added by digest. Ids of the conversations that end in a node are packed by ranges and hashed as a stream. Sequences are
    told apart by SHA-256. What a task holds is bounded: `held` nodes of a family, one level of it, a piece of ids. One
    conversation's turns, however many, are one task's stream, as each node's digest depends on the one before.

    Null roles and texts are empty; null turns come first; turns of one number are ordered by the digest of role and
    text, and repeated rows are repeated turns. Rows without conv_id are left out, other columns ignored; c % 20 has the
    sign of c. An empty table has no node.
    """
    nodes = stored(family_nodes(conversations, held), "family-nodes")
    merged = stored(
        nodes.groupBy("digest", "depth", "parent", "words").agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.bool_or("inner").alias("inner")), "trie-nodes"
    )
    zero = F.lit(0).cast("long")
    links = nodes.select("base", "depth", "digest", "parent", zero.alias("own"), zero.alias("saved"), zero.alias("leaf"))
    owned = merged.select(
        _base(F.col("conv_id")).alias("base"), "depth", "digest", "parent", F.lit(1).cast("long").alias("own"),
        ((F.col("n") - 1) * F.col("words")).alias("saved"), (~F.col("inner")).cast("long").alias("leaf"),
    )
    levels = links.unionByName(owned).repartition("base").sortWithinPartitions("base", F.desc("depth"))
    sums = levels.mapInArrow(_folded, SUMS)

    ends = nodes.select("digest", F.explode("ends").alias("conv_id"))
    ends = stored(ends, "ends").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    pieces = ends.mapInArrow(_packed, "digest binary, first long, piece binary")
    hashed = pieces.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "piece").mapInArrow(_hashed, "digest binary, ends_sha256 string")

    columns = {"conv_id": F.max, "depth": F.max, "parent": F.max, "n_convs": F.max, "n_children": F.sum, "n_leaves": F.sum, "saved_tokens": F.sum, "ends_sha256": F.max}
    own = merged.select("digest", "conv_id", "depth", "parent", F.col("n").alias("n_convs"))
    parts = own.unionByName(sums, allowMissingColumns=True).unionByName(hashed, allowMissingColumns=True)
    whole = stored(parts.groupBy("digest").agg(*[F.coalesce(f(c), zero).alias(c) if f is F.sum else f(c).alias(c) for c, f in columns.items()]), "trie-sums")
    parents = merged.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    empty = F.sha2(F.lit(b""), 256)
    return whole.join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256")
    )
