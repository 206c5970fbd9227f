"""Near-duplicates by order min-hashing, verified by banded alignment.

A text's shingles are its five-word windows, each labelled with how often it has occurred before. A sketch takes the
few smallest shingles under one random order and keeps them in the text's own order, so that two texts share a
sketch more likely the closer they are in edit similarity: with three shingles a sketch, at similarity s about s^3.
Texts that share any of the sketches are candidates. A candidate pair is laid side by side, with gaps up to the
width that the similarity allows, and the shingles that match in order are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, slices, stored, texts
from .components import components
from .words import HASHES, ODD, hashes, mixed, windows


#: Tasks that the rows of one bucket are dealt to.
SALTS = 16
#: Buckets of up to so many texts are compared by pairs as rows, larger ones by pairs of blocks.
FEW_TEXTS = 16
#: A block's texts and shingles: about, as texts are dealt by hash.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1 << 19


def shingles(text: str | None, size: int) -> np.ndarray:
    """A hash for each window of `size` words; none for texts of fewer words."""
    return windows(hashes(text), range(size))


def labelled(shingle: np.ndarray) -> np.ndarray:
    """The same, but equal ones differ by their number of occurrence, so that no value repeats."""
    order = np.argsort(shingle, kind="stable")
    held = shingle[order]
    new = np.concatenate([[True], held[1:] != held[:-1]]) if len(held) else np.zeros(0, bool)
    if new.all():
        return mixed(shingle)
    at = np.arange(len(held))
    nth = np.empty(len(held), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mixed(shingle + nth * ODD[200])


def sketches(shingle: np.ndarray, count: int, length: int) -> np.ndarray:
    """`count` sketches of `length` labelled shingles each (of all, if there are fewer)."""
    if not len(shingle):
        return np.zeros(0, np.int64)
    values = labelled(shingle)
    length = min(length, len(values))
    ranks = mixed((values[None, :] ^ ODD[:count, None]) * ODD[count : 2 * count, None])
    least = np.sort(np.argpartition(ranks, length - 1, axis=1)[:, :length], axis=1)  # in the text's order
    out = np.arange(count, dtype=np.uint64)
    for j in range(length):
        out = mixed(out * ODD[210] + values[least[:, j]] * ODD[211 + j])
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Share of shingles matched in order, of all shingles of both: exact where it is `least` or more, else possibly 0.

    The matches are those of the longest common subsequence within a band: as many places may be skipped on either
    side as a pair of that similarity can have unmatched. The row of the alignment is one integer of as many bits as
    there are shingles in a, which whole-row operations move forward by one shingle of b.
    """
    n = len(a) + len(b)
    needed = least * n / (1 + least)  # matches m: m / (n - m) >= least
    if not n or min(len(a), len(b)) < needed:
        return 0.0
    x, y = labelled(a), labelled(b)
    if len(np.intersect1d(x, y, assume_unique=True)) < needed:  # matches in any order are not fewer
        return 0.0
    same = 0  # equal beginnings and ends match in the best alignment
    short = min(len(a), len(b))
    unequal = np.flatnonzero(a[:short] != b[:short])
    same = short if not len(unequal) else int(unequal[0])
    a, b = a[same:], b[same:]
    short = min(len(a), len(b))
    unequal = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = short if not len(unequal) else int(unequal[0])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    band = int(n - 2 * needed) + 1
    where: dict[int, int] = {}
    for i, s in enumerate(a.tolist()):
        where[s] = where.get(s, 0) | 1 << i
    full = (1 << len(a)) - 1
    window = (1 << (2 * band + 1)) - 1
    row = full
    for j, s in enumerate(b.tolist()):
        if hit := where.get(s):
            hit &= window << (j - band) if j >= band else window >> (band - j)
            met = row & hit
            row = ((row + met) | (row - met)) & full
    m = same + tail + len(a) - row.bit_count()
    return m / (n - m)


def _emit(docs: DataFrame, size: int, count: int, length: int) -> DataFrame:
    """(doc_id, content, n, sketches): content is a digest of the words, n the number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with freed(HASHES):
            for batch in slices(batches, limit=4 << 20):
                content, n, sketch = [], [], []
                for text in batch.column("text").to_pylist():
                    words = hashes(text)
                    windowed = windows(words, range(size))
                    content.append(_content(words, text))
                    n.append(len(windowed))
                    sketch.append(sketches(windowed, count, length).tolist())
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id"), "content": pa.array(content, pa.binary()), "n": pa.array(n, pa.int32()), "sketches": pa.array(sketch, pa.list_(pa.int64()))}
                )

    return texts(docs).mapInArrow(run, "doc_id long, content binary, n int, sketches array<long>")


def _content(words: np.ndarray, text: str) -> bytes:
    """A digest of the words, or of the text if it has none."""
    return xxhash.xxh3_128_digest(words.tobytes()) if len(words) else xxhash.xxh3_128_digest(b"-" + text.encode("utf-8", "replace"))


def _sequences(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, content, shingles): packed 64-bit hashes of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with freed(HASHES):
            for batch in slices(batches, limit=4 << 20):
                words = [(hashes(t.as_py()), t) for t in batch.column("text")]
                packed = [windows(w, range(size)).tobytes() for w, _ in words]
                content = [_content(w, t.as_py()) for w, t in words]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "content": pa.array(content, pa.binary()), "shingles": pa.array(packed, pa.binary())})

    return texts(docs).mapInArrow(run, "doc_id long, content binary, shingles binary")


def _verify(pairs: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """(a, b, alike) for pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "left", 8 << 20):
                own = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("left", "right"))
                alike = [similarity(x, y, least) >= least for x, y in zip(*own, strict=True)]
                yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "alike": pa.array(alike, pa.bool_())})

    left = sequences.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sequences.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long, alike boolean")


def near_duplicates(docs: DataFrame, least: float = 0.8, size: int = 5, count: int = 16, length: int = 3) -> DataFrame:
    """One row (doc_id, class_id) for each row of docs (doc_id, text).

    Two texts are alike if, with shingles of `size` words, those that match in order are `least` or more of all
    shingles of both; a class is what such links connect, with texts of equal words (whatever their case and
    punctuation), and class_id its smallest doc_id. A pair at similarity 0.8 is missed by all of 16 sketches of three
    shingles once in 100,000.

    Copies are merged first, so only one text of each kind is sketched further. Within a bucket of texts that share a
    sketch, each text is compared with the bucket's smallest, and what that links becomes a group. Then every bucket's
    pairs of texts in different groups are compared, whatever its size: those of small buckets as rows, those of large
    ones block by block (see `_blocks`). A pair in the same group needs no comparison, as the class would be the same.

    Rows of one doc_id are one document; should they differ in text, the one of the smallest digest stands for its class
    (the others' links count only where they are copies). Null texts count as empty; empty texts, and texts without words, are alike only if they are equal; texts of fewer
    words than `size` only if their words are. Repeated rows each get a row; rows with a null doc_id join their
    copies' class but never name one. Other columns are ignored; an empty table gives an empty one.
    """
    own = stored(_emit(docs, size, count, length))
    # stored, so that the join after it has nothing but its two shuffles in a stage, and a hot content can be split
    first = stored(own.groupBy("content").agg(F.min("doc_id").alias("kind")))
    member = stored(own.select("doc_id", "content").join(first, "content").select("doc_id", "kind"))
    kinds = own.join(first.select(F.col("kind").alias("doc_id")).distinct(), "doc_id", "left_semi").where("n > 0")
    least_content = F.min(F.struct("content", "sketches", "n")).alias("x")  # one of each id, should texts share it
    kinds = stored(kinds.groupBy("doc_id").agg(least_content).select("doc_id", "x.content", "x.sketches", "x.n"))
    # a row for each text and sketch; at: the sketch's place, group: who it is known to be alike to
    rows = kinds.select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("group"), "n", F.posexplode("sketches").alias("at", "key"))
    met = stored(_met(rows))
    some = met.select(F.col("doc").alias("doc_id")).distinct().join(kinds.select("doc_id", "content"), "doc_id")
    sequences = _sequences(docs.join(some, "doc_id", "left_semi"), size).join(some, ["doc_id", "content"], "left_semi")
    sequences = stored(sequences.select("doc_id", "shingles").dropDuplicates(["doc_id"]), "shingles")
    near = F.least("n", "hub.n") >= least * F.greatest("n", "hub.n")
    pairs = met.where("doc <> hub.doc").where(near).select(F.col("hub.doc").alias("a"), F.col("doc").alias("b")).distinct()
    tested = stored(_verify(stored(pairs), sequences, least))
    linked = components(tested.where("alike").select("a", "b"))
    rows = stored(_regrouped(met, linked))
    few = _mixed(rows).where(F.col("texts") <= FEW_TEXTS).select("key")
    if few.head(1):
        own = rows.join(few, "key").select("key", F.struct("doc", "group", "n").alias("x"))
        pairs = own.join(own.select("key", F.col("x").alias("y")), "key").where("x.doc < y.doc and x.group <> y.group")
        pairs = pairs.where(F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n")).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()
        found = stored(_verify(stored(pairs.join(tested, ["a", "b"], "left_anti")), sequences, least))
        tested = tested.unionByName(found)
        linked = components(tested.where("alike").select("a", "b"))
        rows = stored(_regrouped(rows, linked))
    many = stored(_mixed(rows).where(F.col("texts") > FEW_TEXTS))
    if many.head(1):
        found = stored(_blocks(rows, many, kinds, sequences, least))
        linked = components(tested.where("alike").select("a", "b").unionByName(found))
    return member.join(linked.withColumnRenamed("node", "kind"), "kind", "left").select("doc_id", F.coalesce("component", "kind").alias("class_id"))


def _regrouped(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows with each text's component as its group."""
    named = linked.select(F.col("node").alias("doc"), "component")
    return rows.join(named, "doc", "left").select("doc", F.coalesce("component", "doc").alias("group"), "n", "at", "key")


def _mixed(rows: DataFrame) -> DataFrame:
    """(key, texts, main, n_rest, n_main) for each bucket of more than one group: main is its largest group, n_rest and
    n_main how many blocks the other texts and those of main make."""
    by = rows.groupBy("key", "group").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles")).groupBy("key")
    by = by.agg(F.count("*").alias("groups"), F.sum("texts").alias("texts"), F.sum("shingles").alias("shingles"), F.max(F.struct("texts", "shingles", "group")).alias("main"))
    n_rest = F.greatest(F.ceil((F.col("texts") - F.col("main.texts")) / BLOCK_TEXTS), F.ceil((F.col("shingles") - F.col("main.shingles")) / BLOCK_SHINGLES))
    n_main = F.greatest(F.ceil(F.col("main.texts") / BLOCK_TEXTS), F.ceil(F.col("main.shingles") / BLOCK_SHINGLES))
    return by.where("groups > 1").select("key", "texts", F.col("main.group").alias("main"), n_rest.cast("int").alias("n_rest"), n_main.cast("int").alias("n_main"))


def _blocks(rows: DataFrame, buckets: DataFrame, kinds: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """(a, b): links between all texts of different groups that are alike, in the given buckets.

    A bucket's texts are dealt to blocks, those outside its largest group first, and each block of those meets every
    block, so pairs within the largest group never meet and no task holds more than two blocks. Of a pair that shares
    several sketches only the first bucket compares it. Links that others already imply within a task are left out.
    """
    dealt = buckets.select("key", "main", "n_rest", "n_main", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = rows.withColumn("salt", F.pmod(F.hash("doc"), F.lit(SALTS))).join(dealt, ["key", "salt"])
    rest, place = F.col("group") != F.col("main"), F.xxhash64("doc")
    own = own.withColumn("block", F.when(rest, F.pmod(place, F.col("n_rest"))).otherwise(F.col("n_rest") + F.pmod(place, F.col("n_main"))).cast("int"))
    own = own.withColumn("last", F.when(rest, F.col("n_rest") + F.col("n_main")).otherwise(F.col("n_rest")) - 1)
    own = own.join(kinds.select(F.col("doc_id").alias("doc"), "sketches"), "doc").join(sequences.select(F.col("doc_id").alias("doc"), "shingles"), "doc")
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    met = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "at", "block", "doc", "group", "sketches", "shingles")
    return met.groupBy("key", "i", "j").applyInArrow(lambda table: _links(table, least), "a long, b long")


def _links(table: pa.Table, least: float) -> pa.Table:
    """The links of one block's texts with another's (or its own).

    Alike texts have at least the share `least` of either's shingles in common, so if all are in one order, one of
    those in common is among the first (1 - least) of both. The order is by number of texts here, rarest first, so that
    what all texts of a bucket share brings none together.
    """
    i, j, at = (table.column(c)[0].as_py() for c in ("i", "j", "at"))
    block, docs = (table.column(c).to_numpy() for c in ("block", "doc"))
    sketch = np.array(table.column("sketches").to_pylist(), np.int64)[:, :at]
    group = np.unique(table.column("group").to_numpy(), return_inverse=True)[1]
    sequence = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    n = np.array([len(x) for x in sequence])
    _, ids, times = np.unique(np.concatenate([labelled(x) for x in sequence]), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    marks = [np.sort(x) for x in np.split(rank[ids], np.cumsum(n)[:-1])]
    first = n - np.ceil(least * n - 1e-9).astype(np.int64) + 1
    right = np.flatnonzero(block == j)
    held = np.concatenate([marks[y][: first[y]] for y in right] or [np.zeros(0, np.int64)])
    owner = np.repeat(right, np.minimum(first[right], n[right]))
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    inside = np.zeros(len(times), bool)
    out = []
    for x in np.flatnonzero(block == i):
        begin, end = (np.searchsorted(held, marks[x][: first[x]], side) for side in ("left", "right"))
        near = np.unique(np.concatenate([owner[a:b] for a, b in zip(begin, end, strict=True) if b > a] or [owner[:0]]))
        near = near[group[near] != group[x]]
        if i == j:
            near = near[near > x]
        near = near[np.minimum(n[near], n[x]) >= least * np.maximum(n[near], n[x])]
        near = near[~(sketch[near] == sketch[x]).any(axis=1)]
        inside[marks[x]] = True
        common = [int(np.count_nonzero(inside[marks[y]])) for y in near]
        inside[marks[x]] = False
        for y, c in zip(near.tolist(), common, strict=True):
            if group[x] != group[y] and c * (1 + least) >= least * (n[x] + n[y]) - 1e-6 and similarity(sequence[x], sequence[y], least) >= least:
                out.append((min(docs[x], docs[y]), max(docs[x], docs[y])))
                group[group == group[y]] = group[x]
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _met(rows: DataFrame) -> DataFrame:
    """The rows in buckets of more than one group, with their bucket's smallest text (hub). A bucket may be any share of
    all rows, so its rows are dealt to SALTS tasks, each of which gets the hub."""
    hubs = rows.groupBy("key").agg(F.min(F.struct("doc", "group", "n")).alias("hub"), F.min("group").alias("low"), F.max("group").alias("high"))
    hubs = hubs.where("low < high").select("key", "hub", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.hash("doc"), F.lit(SALTS))).join(hubs, ["key", "salt"]).drop("salt")
