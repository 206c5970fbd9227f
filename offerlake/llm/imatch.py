"""I-Match fingerprints: digests of a text's terms of middling rarity, under several random subsets of the lexicon."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, slices, stored, texts
from .words import HASHES, ODD, Memory, mixed, words_of

#: Terms are first counted by the first bits of their hash. A cell's count is no less than any of its terms', so those of
#: cells below the band need no count of their own.
CELL_BITS = 20
#: Terms that a task counts before it sends them on.
TERMS = 1 << 20
#: (how many random subsets, one in how many terms each keeps): small texts show in the dense, long in the sparse ones.
SUBSETS = ((8, 16), (16, 64), (24, 256))
_EACH = [one_in for n, one_in in SUBSETS for _ in range(n)]
_SALTS, _LIMITS = ODD[: len(_EACH), None], np.array([(1 << 64) // x for x in _EACH], np.uint64)[:, None]
VOID = "------"
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _distinct(text: str | None) -> np.ndarray:
    """The hashes of a text's distinct terms, in no order; each word is looked up once."""
    found = set(words_of(text))
    return np.fromiter(map(HASHES.__getitem__, found), np.uint64, len(found))


#: Cells of one row of counts.
BLOCK = 1 << 12


def _cell_counts(docs: DataFrame) -> DataFrame:
    """(block, counts): in how many texts a term of each cell occurs, as 64-bit numbers, BLOCK cells a row. Each task sends a row a
    block at most, in the narrowest numbers that hold its counts; rows meet by block."""

    width = min(BLOCK, 1 << CELL_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int64)
        with freed(HASHES):
            for batch in slices(batches, limit=8 << 20):
                for text in batch.column("text"):
                    counts[_distinct(text.as_py()) >> np.uint64(64 - CELL_BITS)] += 1  # a cell that comes twice counts once
        for block, part in enumerate(counts.reshape(-1, width)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": [part.astype(np.min_scalar_type(part.max())).tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}  # as many as there are blocks, at most
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(packed, f"u{len(packed) // width}")
                totals[block] = totals[block] + own if block in totals else own.astype(np.int64)
        for block, total in totals.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": [total.tobytes()]})

    schema = "block int, counts binary"
    return texts(docs).select("text").mapInArrow(run, schema).repartition("block").mapInArrow(add, schema)


def _term_counts(docs: DataFrame, cells) -> DataFrame:
    """(term, n): in how many texts each term of the given cells (a broadcast array of bits) occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held = 0

        def sent() -> pa.RecordBatch:
            terms, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            return pa.record_batch([pa.array(terms.view(np.int64)), pa.array(n, pa.int64())], ["term", "n"])

        with freed(HASHES):
            for batch in slices(batches, limit=8 << 20):
                for text in batch.column("text"):
                    found = _distinct(text.as_py())
                    held.append(found[cells.value[found >> np.uint64(64 - CELL_BITS)]])
                    n_held += len(held[-1])
                    if n_held >= TERMS:
                        yield sent()
                        held, n_held = [], 0
            yield sent()

    return texts(docs).select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Print(NamedTuple):
    """A fingerprint, and its digests as numbers (-1 for subsets without terms) if it has any."""

    text: str
    digests: np.ndarray | None = None

    def like(self, other: Print) -> float:
        """likeness() of both."""
        if self.digests is None or other.digests is None:
            return float(self.text == other.text)
        used = (self.digests >= 0) | (other.digests >= 0)
        return float(np.count_nonzero(used & (self.digests == other.digests)) / np.count_nonzero(used))


class Lexicon:
    """The terms whose share of texts lies in the band: their hashes, sorted."""

    def __init__(self, inside: np.ndarray):
        self.inside = np.sort(inside)
        #: The subsets of each term, a bit for each.
        self.subsets = np.zeros(len(inside), np.uint64)
        for k, (salt, limit) in enumerate(zip(_SALTS.ravel(), _LIMITS.ravel())):
            self.subsets |= (mixed(mixed(self.inside ^ salt) * salt) < limit).astype(np.uint64) << np.uint64(k)
        #: word -> its place in the lexicon, -1 for others, as words come up.
        self.places = Memory(self._place)

    def __reduce__(self):
        return Lexicon, (self.inside,)

    def _place(self, word: str) -> int:
        term = np.uint64(HASHES[word])
        at = int(np.searchsorted(self.inside, term))
        return at if at < len(self.inside) and self.inside[at] == term else -1

    def terms(self, text: str) -> np.ndarray:
        return self.terms_and_subsets(text)[0]

    def terms_and_subsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(terms, subsets): distinct terms of the lexicon, sorted, and which subsets have each (a row a subset); all
        distinct terms of a text that has none of the lexicon."""
        found = set(words_of(text))
        at = np.fromiter(map(self.places.__getitem__, found), np.int64, len(found))
        at = np.sort(at[at >= 0])
        if len(at):
            bits = np.unpackbits(self.subsets[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            return self.inside[at], np.ascontiguousarray(bits[:, : len(_EACH)].T).view(bool)
        terms = np.sort(_distinct(text))
        return terms, mixed(mixed(terms[None, :] ^ _SALTS) * _SALTS) < _LIMITS

    def print(self, text: str) -> Print:
        """Six digits for each subset that has terms of the text. A text whose terms are in no subset has the digest of
        all of them, and one without any word that of itself, so that only such as have the same are like it."""
        terms, subsets = self.terms_and_subsets(text)
        if not len(terms):
            return Print("=" + xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass")))
        subset, at = np.nonzero(subsets)
        if not len(at):
            return Print("=" + xxhash.xxh3_128_hexdigest(terms.tobytes()))
        packed, ends = terms[at].tobytes(), np.cumsum(np.bincount(subset, minlength=len(_EACH))).tolist()  # subset by subset
        digests, start = [-1] * len(_EACH), 0
        for k, end in enumerate(ends):
            if end > start:
                digests[k] = xxhash.xxh3_64_intdigest(packed[8 * start : 8 * end]) >> 40
                start = end
        return Print("".join(["%06x" % d if d >= 0 else VOID for d in digests]), np.array(digests))

    def fingerprint(self, text: str) -> str:
        return self.print(text).text


def lexicon(docs: DataFrame, most: float = 0.1, least: float = 0.0005) -> Lexicon:
    """Terms that occur in at most the share `most` of all texts and in at least the share `least`: a band of inverse
    document frequencies from ln(1/most) to ln(1/least). All texts are counted, each term by itself (its 64-bit hash). There
    are at most (mean distinct terms of a text) / least such terms, 4 MB at 250 distinct terms, whatever the corpus."""
    total = docs.count()
    least_n, most_n = least * total, most * total
    cells, width = np.zeros(1 << CELL_BITS, bool), min(BLOCK, 1 << CELL_BITS)
    reach = lambda batches: (pa.RecordBatch.from_pydict({"block": b.column("block"), "bits": [np.packbits(np.frombuffer(c, np.int64) >= least_n).tobytes() for c in b.column("counts").to_pylist()]}) for b in batches)
    for block, bits in _cell_counts(docs).mapInArrow(reach, "block int, bits binary").collect():  # at most 256 rows of 512 bytes
        cells[block * width : (block + 1) * width] = np.unpackbits(np.frombuffer(bits, np.uint8), count=width).astype(bool)
    counts = _term_counts(docs, docs.sparkSession.sparkContext.broadcast(cells)).where(F.col("n").between(least_n, most_n))
    return Lexicon(counts.select("term").toArrow().column("term").to_numpy().view(np.uint64))


def likeness(a: str, b: str) -> float:
    """Share of equal digests among the subsets that have terms of either text."""
    if a.startswith("=") or b.startswith("="):
        return float(a == b)
    pairs = [(a[i : i + 6], b[i : i + 6]) for i in range(0, 6 * len(_EACH), 6)]
    used = [x == y for x, y in pairs if x != VOID or y != VOID]
    return sum(used) / len(used) if used else float(a == b)


def fingerprints(docs: DataFrame, own: Lexicon) -> DataFrame:
    """One row (doc_id, fingerprint) for each row of docs (doc_id, text); null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value.fingerprint(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _row(own: Lexicon, doc_id, text: str, print_: Print, after: str, after_print: Print) -> tuple:
    changed = _edited(text, after)
    changed_print = own.print(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, print_.text, changed_print.text, print_.like(changed_print), print_.like(after_print)


_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in RESULT.split(", ")]


def _columns(rows: list[tuple]) -> dict[str, pa.Array]:
    return {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(_NAMES, _TYPES, strict=True))}


def compare_with_edits(docs: DataFrame, own: Lexicon) -> DataFrame:
    """RESULT for each row of docs (doc_id, text): its fingerprint, that of its edited text, and what is like what.

    The edited text has the last half of the code points replaced by the first as many (or all) of the next text in
    order of doc_id, the last text's next being the first. Texts move once, to partitions by range of doc_id, where
    each meets its next; the last text of each partition waits for the first of the next one, so those two texts a
    partition go through a small second step. Null texts count as empty; null ids come first, and rows of equal ids are
    ordered by text; a single row is its own next; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(own)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, part = shared.value, TaskContext.get().partitionId()
        head = before = None
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                now = (doc_id, text, lexicon.print(text))
                if before:
                    rows.append(_row(lexicon, *before, *now[1:]))
                head, before = head or now, now
            n = len(rows)
            yield pa.RecordBatch.from_pydict({"part": pa.nulls(n, pa.int32()), **_columns(rows), "text": pa.nulls(n, pa.string()), "head": pa.nulls(n, pa.string())})
        if before:
            empty = {name: pa.nulls(1, kind) for name, kind in zip(_NAMES, _TYPES, strict=True)}
            empty["doc_id"] = pa.array([before[0]], pa.int64())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), **empty, "text": pa.array([before[1]]), "head": pa.array([head[1]])})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in slices(batches):
            own = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True)
            yield pa.RecordBatch.from_pydict(_columns([_row(lexicon, i, t, lexicon.print(t), a, lexicon.print(a)) for i, t, a in own]))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = texts(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    done = stored(in_order.mapInArrow(walk, f"part int, {RESULT}, text string, head string"), "fingerprints")
    by_part = Window.orderBy("part")  # over one row for each partition
    after = F.coalesce(F.lead("head").over(by_part), F.first("head").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    last = done.where("part is not null").select("doc_id", "text", after.alias("after")).mapInArrow(finish, RESULT)
    return done.where("part is null").select(*_NAMES).unionByName(last)
