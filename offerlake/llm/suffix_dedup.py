"""Removal of repeated passages: every byte that a 100-byte string covers which also starts earlier.

Each 100-byte window has an anchor, the leftmost smallest of its 20-byte hashes, so equal windows have equal anchors at
the same place. Successive windows of one anchor make a run. Runs are what is shuffled, about one for 40 bytes of text:
runs of equal content in a later document are repeated as a whole. Of runs that share an anchor but not all content,
the text goes to an index family: the windows' suffixes are sorted in suffix arrays, batch by batch in order of
documents; each new array is merge-scanned against the levels there are, finds which of its windows an earlier document
has, and joins them; levels of like size merge, so that there are logarithmically many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, shared_dir, slices, stored
from .words import ODD, mixed

WIDTH, ANCHOR, CONTEXT = 100, 20, 40
#: Bytes that are hashed at once.
CHUNK = 200_000
#: Of an index task's groups; larger ones are resolved window by window, which spreads them over all tasks.
GROUP_LIMIT = 20_000
FIRST_ID = -(1 << 63)
_U = np.uint64
_BYTES = ODD[256 - 64 :]


def _power(x: np.ndarray, n: int, of: dict[int, np.ndarray]) -> None:
    of[2 * n] = x[:-n] * ODD[130 + n.bit_length()] + x[n:]


class Runs:
    """The runs of some texts, concatenated: text (index), start, size (windows), anchor hash, content digest, contexts.

    repeated holds the windows (places in `data`) that occur earlier in the same text; runs leave them out.
    """

    def __init__(self, parts: list[bytes], only_repeats: bool = False):
        self.begins = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.text = self.start = self.size = np.zeros(0, np.int64)
        self.anchor = self.digest = np.zeros(0, np.uint64)
        self.sides = np.zeros((0, 2), np.int64)
        self.repeated = np.zeros(0, np.int64)
        self.windows = np.zeros(0, np.uint64)
        n = len(self.data) - WIDTH + 1
        if n > 0:
            self._find(n, only_repeats)

    def _find(self, n: int, only_repeats: bool) -> None:
        data, begins = self.data, self.begins
        h = {1: mixed((data.astype(np.uint64) + _U(1)) * ODD[129])}
        for k in (1, 2, 4, 8, 16, 32):
            _power(h[k], k, h)
        joined = lambda sizes, at, count: mixed(sum(h[k][o + at : o + at + count] * ODD[150 + j] for j, (k, o) in enumerate(sizes)))
        windows = self.windows = joined(((64, 0), (32, 64), (4, 96)), 0, n)
        of = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[:n]
        inside = np.arange(n) + WIDTH <= begins[of + 1]
        self.repeated = self._repeats(windows, of, inside)
        if only_repeats:
            return
        keys = joined(((16, 0), (4, 16)), 0, len(data) - ANCHOR + 1)
        span, least, k = WIDTH - ANCHOR + 1, keys, 1
        while 2 * k <= span:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        least = np.minimum(least[:n], least[span - k : span - k + n])
        inside[self.repeated] = False
        at = np.flatnonzero(inside)
        if not len(at):
            return
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (of[at[1:]] != of[at[:-1]])])
        first = at[new]
        last = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1])
        found = []
        while len(first):  # a run ends where its anchor does; what is left of it begins another
            place = first + np.argmax(keys[first[:, None] + np.arange(span)] == least[first][:, None], axis=1)
            end = np.minimum(last, place)
            found.append((first, end, place))
            more = last > place
            first, last = place[more] + 1, last[more]
        start, end, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start)
        start, end, place = start[order], end[order], place[order]
        self.text, self.start, self.size, self.anchor = of[start], start, end - start + 1, least[start]
        kept = np.repeat(start - np.concatenate([[0], np.cumsum(self.size)[:-1]]), self.size) + np.arange(self.size.sum())
        nth = (kept - np.repeat(place, self.size)).astype(np.uint64)  # relative to the anchor
        sums = np.add.reduceat(windows[kept] * (mixed(nth) | _U(1)), np.concatenate([[0], np.cumsum(self.size)[:-1]]))
        self.digest = mixed(sums + mixed(self.size.astype(np.uint64)))
        context = len(data) - CONTEXT + 1
        ctx = joined(((32, 0), (8, 32)), 0, context) >> _U(48)
        left = np.where(place - start >= CONTEXT, ctx[np.maximum(place - CONTEXT, 0)], 0)
        right = np.where(place - end <= WIDTH - ANCHOR - CONTEXT, ctx[np.minimum(place + ANCHOR, context - 1)], 0)
        self.sides = np.stack([np.where(place - start >= CONTEXT, left + 1, 0), np.where(place - end <= WIDTH - ANCHOR - CONTEXT, right + 1, 0)], 1).astype(np.int64)

    @staticmethod
    def _repeats(windows: np.ndarray, of: np.ndarray, inside: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(inside)
        own = windows[at] + of[at].astype(np.uint64) * ODD[149]
        held = np.sort(own)
        twice = held[1:][held[1:] == held[:-1]]
        if not len(twice):
            return np.zeros(0, np.int64)
        likely = np.zeros(1 << 20, bool)
        likely[twice >> _U(44)] = True
        some = np.flatnonzero(likely[own >> _U(44)])
        order = np.argsort(own[some], kind="stable")
        again = np.flatnonzero(own[some][order][1:] == own[some][order][:-1]) + 1
        return np.sort(at[some[order[again]]])


def _bytes(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _chunks(parts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in lists of about CHUNK bytes, each with the index of its first."""
    begin = size = 0
    for i, x in enumerate(parts):
        if size and size + len(x) > CHUNK:
            yield begin, parts[begin:i]
            begin, size = i, 0
        size += len(x)
    if begin < len(parts):
        yield begin, parts[begin:]


def _emit(docs: DataFrame) -> DataFrame:
    """(anchor, digest, id, sides, whole) for each run; of equal runs in a task only the first document's may be the
    first of all, so the others are already whole repeats (whole) and go on under a key of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        with freed():
            yield from sent(batches, found)

    def sent(batches: Iterator[pa.RecordBatch], found: list[tuple]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            ids, parts = batch.column("id").to_numpy(), [_bytes(t) for t in batch.column("text").to_pylist()]
            for begin, chunk in _chunks(parts):
                r = Runs(chunk)
                if len(r.start):
                    found.append((r.anchor.view(np.int64), r.digest.view(np.int64), ids[begin + r.text], (r.sides[:, 0] << 20 | r.sides[:, 1])))
        if not found:
            return
        anchor, digest, ids, sides = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, digest))
        anchor, digest, ids, sides = anchor[order], digest[order], ids[order], sides[order]
        new = np.concatenate([[True], (digest[1:] != digest[:-1]) | (anchor[1:] != anchor[:-1])])
        whole = ids != ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
        spread = np.where(whole, mixed(digest.view(np.uint64) ^ mixed(ids.view(np.uint64))).view(np.int64), anchor)
        for i in range(0, len(ids), 100_000):
            cut = slice(i, i + 100_000)
            yield pa.RecordBatch.from_pydict({"anchor": spread[cut], "digest": digest[cut], "id": ids[cut], "sides": sides[cut], "whole": whole[cut]})

    return docs.mapInArrow(run, "anchor long, digest long, id long, sides long, whole boolean")


def _repeats_and_neighbours(emitted: DataFrame, parts: int) -> DataFrame:
    """(anchor, digest, id, sides, whole): whole repeats; and first runs whose anchor has other runs too (not whole).
    One pass over rows sorted by anchor and digest, which holds back one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last first run so far, and whether it was sent
        before = (None, None, None)  # anchor, digest and first id of the last row
        for batch in batches:
            anchor, digest, ids, sides, whole = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "digest", "id", "sides", "whole"))
            own = np.flatnonzero(~whole)
            out = [(anchor[whole], digest[whole], ids[whole], sides[whole], np.ones(whole.sum(), bool))]
            if len(own):
                anchor, digest, ids, sides = anchor[own], digest[own], ids[own], sides[own]
                new = np.concatenate([[(anchor[0], digest[0]) != before[:2]], (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])])
                at = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
                first_id = np.where(at >= 0, ids[np.maximum(at, 0)], ids[0] if before[2] is None else before[2])
                before = (anchor[-1], digest[-1], first_id[-1])
                again = ids != first_id
                out.append((anchor[again], digest[again], ids[again], sides[again], np.ones(again.sum(), bool)))
                lead = [anchor[new], digest[new], ids[new], sides[new]]
                if len(lead[0]):
                    sent = np.zeros(len(lead[0]) + (held is not None), bool)
                    if held is not None:
                        lead = [np.concatenate([[h], x]) for h, x in zip(held[0], lead, strict=True)]
                        sent[0] = held[1]
                    same = lead[0][1:] == lead[0][:-1]
                    beside = np.concatenate([same, [False]]) | np.concatenate([[False], same])
                    go = beside & ~sent
                    out.append((*(x[go] for x in lead), np.zeros(go.sum(), bool)))
                    held = ([x[-1] for x in lead], bool(beside[-1] or sent[-1]))
            merged = [np.concatenate(x) for x in zip(*out, strict=True)]
            if len(merged[0]):
                yield pa.RecordBatch.from_pydict(dict(zip(("anchor", "digest", "id", "sides", "whole"), merged, strict=True)))

    dealt = emitted.repartition(parts, "anchor").sortWithinPartitions("anchor", "digest", "id")
    return dealt.mapInArrow(run, "anchor long, digest long, id long, sides long, whole boolean")


def _segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, members, id, digest, text) with the bytes of each wanted run (id, digest, keys)."""
    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("digest", "key", "members")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            ids, parts, lists = batch.column("id").to_pylist(), [_bytes(t) for t in batch.column("text").to_pylist()], batch.column("runs").to_pylist()
            out: list[tuple] = []
            for begin, chunk in _chunks(parts):
                r = Runs(chunk)
                where: dict[tuple[int, int], int] = {}
                for k, key in enumerate(zip(r.text.tolist(), r.digest.view(np.int64).tolist(), strict=True)):
                    where.setdefault(key, k)
                raw = r.data.tobytes()
                for i in range(len(chunk)):
                    for x in lists[begin + i]:
                        if (k := where.get((i, x["digest"]))) is not None:
                            s = int(r.start[k])
                            out.append((x["key"], x["members"], ids[begin + i], x["digest"], raw[s : s + int(r.size[k]) + WIDTH - 1]))
            if out:
                names, kinds = ("key", "members", "id", "digest", "text"), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, zip(*out, strict=True), kinds, strict=True)})

    return docs.join(lists, "id").select("id", "text", "runs").mapInArrow(run, "key long, members long, id long, digest long, text binary")


class IndexFamily:
    """Suffix arrays in levels of geometric sizes. A level is the sorted windows (the first WIDTH bytes of suffixes) and,
    for each, the smallest id that has it. Ids must not fall from batch to batch."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, texts: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
        """For each text, which of its windows a smaller id has, in this batch or before."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        counts = sizes - WIDTH + 1
        starts = np.concatenate([np.arange(n) + b for n, b in zip(counts, np.cumsum(sizes) - sizes, strict=True)])
        owner = np.repeat(ids, counts)
        suffixes = np.lib.stride_tricks.as_strided(data, (len(data) - WIDTH + 1, WIDTH), (1, 1))[starts].view(f"S{WIDTH}").ravel()
        array = np.argsort(suffixes, kind="stable")  # the batch's suffix array
        held = suffixes[array]
        new = np.concatenate([[True], held[1:] != held[:-1]])
        group = np.cumsum(new) - 1
        distinct = held[new]
        smallest = np.minimum.reduceat(owner[array], np.flatnonzero(new))
        for windows, least in self.levels:  # both sorted: one merge-scan
            at = np.minimum(np.searchsorted(windows, distinct), len(windows) - 1)
            smallest = np.where(windows[at] == distinct, np.minimum(least[at], smallest), smallest)
        seen = np.empty(len(starts), bool)
        seen[array] = smallest[group] < owner[array]
        self.levels.append((distinct, smallest))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            both, least = np.concatenate([a, b]), np.concatenate([x, y])
            order = np.argsort(both, kind="stable")
            both, least = both[order], least[order]
            new = np.concatenate([[True], both[1:] != both[:-1]])
            self.levels.append((both[new], np.minimum.reduceat(least, np.flatnonzero(new))))
        return np.split(seen, np.cumsum(counts)[:-1])


def _ranges(flags: np.ndarray) -> list[int]:
    """[begin, end, begin, end, ...] of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.tolist()


_FOUND = "id long, digest long, ranges array<int>"


def _found(rows: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict({"id": pa.array(a, pa.int64()), "digest": pa.array(b, pa.int64()), "ranges": pa.array(c, pa.list_(pa.int32()))})


def _search_index(segments: DataFrame, parts: int) -> DataFrame:
    """_FOUND for segments of groups that a task holds: an index family for each task, fed in order of ids. An index takes
    some thirty times its segments' bytes, hence the many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = IndexFamily()
        for batch in slices(batches, limit=1 << 19):
            ids, digests = batch.column("id").to_numpy(), batch.column("digest").to_pylist()
            seen = family.add(batch.column("text").to_pylist(), ids)
            yield _found([(int(i), d, _ranges(s)) for i, d, s in zip(ids, digests, seen, strict=True) if s.any()])

    return segments.repartition(4 * parts, "key").sortWithinPartitions("id").select("id", "digest", "text").mapInArrow(run, _FOUND)


def _search_windows(segments: DataFrame) -> DataFrame:
    """_FOUND for segments of the largest groups: each window's smallest id by an aggregate, and a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 18):
            for i, d, text in zip(batch.column("id").to_pylist(), batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n = len(text) - WIDTH + 1
                yield pa.RecordBatch.from_pydict(
                    {"id": pa.array([i] * n, pa.int64()), "digest": pa.array([d] * n, pa.int64()), "nth": pa.array(range(n), pa.int32()), "window": pa.array([text[k : k + WIDTH] for k in range(n)], pa.binary())}
                )

    windows = segments.select("id", "digest", "text").distinct().mapInArrow(run, "id long, digest long, nth int, window binary")
    windows = windows.select("id", "digest", "nth", F.unhex(F.md5("window")).alias("window"))
    first = windows.groupBy("window").agg(F.min("id").alias("first"))
    seen = windows.join(first, "window").where("id > first")
    return seen.groupBy("id", "digest").agg(F.flatten(F.transform(F.array_sort(F.collect_set("nth")), lambda x: F.array(x, x + 1))).alias("ranges"))


SPANS = "array<struct<begin:long,end:long>>"


def _cut(chunk: list[bytes], lists: list, wanted: bool) -> Iterator[dict]:
    """What stays of each text of a chunk, and what goes."""
    r = Runs(chunk, only_repeats=not wanted)
    gone = np.zeros(len(r.data) + 1, np.int8)  # of each window's first byte
    gone[r.repeated] = 1
    if wanted:
        where: dict[tuple[int, int], list[int]] = {}
        for k, key in enumerate(zip(r.text.tolist(), r.digest.view(np.int64).tolist(), strict=True)):
            where.setdefault(key, []).append(k)
        for i, own in enumerate(lists):
            for x in own:
                for k in where.get((i, x["digest"]), ()):
                    s = int(r.start[k])
                    ranges = [0, int(r.size[k])] if x["ranges"] is None else x["ranges"]
                    for a, b in zip(ranges[::2], ranges[1::2], strict=True):
                        gone[s + a : s + b] = 1
    at = np.flatnonzero(gone)
    depth = np.zeros(len(r.data) + 1, np.int32)
    depth[at] += 1
    depth[at + WIDTH] -= 1
    covered = np.cumsum(depth[:-1]) > 0
    for i, x in enumerate(chunk):
        own = covered[r.begins[i] : r.begins[i + 1]]
        if not own.any():
            yield {"n_bytes": len(x), "kept": x, "spans": []}
            continue
        edges = _ranges(own)
        kept = np.frombuffer(x, np.uint8)[~own].tobytes()
        yield {"n_bytes": len(x), "kept": kept, "spans": [{"begin": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]}


def _remove(text, runs):
    """Column struct(n_bytes, kept, spans): kept bytes, and the removed runs; runs lists (digest, ranges)."""
    kind = pa.struct([("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])

    @F.arrow_udf(f"struct<n_bytes:long,kept:binary,spans:{SPANS}>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            parts = [_bytes(t) for t in texts.to_pylist()]
            found = pc.fill_null(pc.greater(pc.list_value_length(lists), 0), False).to_numpy(zero_copy_only=False)
            out: list = [None] * len(parts)
            for wanted in (True, False):  # texts without findings need their own repeats only
                places = np.flatnonzero(found == wanted).tolist()
                for begin, chunk in _chunks([parts[i] for i in places]):
                    here = places[begin : begin + len(chunk)]
                    for i, x in zip(here, _cut(chunk, lists.take(pa.array(here)).to_pylist(), wanted), strict=True):
                        out[i], parts[i] = x, b""
            with freed():
                yield pa.array(out, kind)

    return run(text, runs)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) plus passages: struct of n_bytes, kept (the bytes that stay) and spans (the runs removed).

    A byte goes if a string of WIDTH bytes covers it that also starts earlier: in a document of smaller doc_id, or
    before in the same one. Texts are judged as they come in, as UTF-8; null texts count as empty. Texts of fewer bytes
    than WIDTH stay whole. A null doc_id comes before all others. Rows of one doc_id are one document's: neither is
    earlier than the other. Other columns stay; existing ones named passages or starting with _passages are
    replaced; an empty table gives an empty one. Memory is about 150 bytes for each byte of the longest text.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))
    texts = docs.select(own_id.alias("id"), "text").where(F.octet_length("text") >= WIDTH)
    found = stored(_repeats_and_neighbours(_emit(texts), parts), "passages-runs")
    # first runs that share an anchor and 40 bytes on either side of it with a different one
    side = lambda k: F.when(k > 0, k)
    left, right = F.shiftright("sides", 20), F.col("sides").bitwiseAND((1 << 20) - 1)
    keyed = found.where("not whole").select("id", "digest", F.explode(F.array(F.xxhash64("anchor", F.lit("l"), side(left)), F.xxhash64("anchor", F.lit("r"), side(right)))).alias("key"), left.alias("l"), right.alias("r"), "anchor")
    keyed = keyed.where(((F.col("l") > 0) & (F.col("key") == F.xxhash64("anchor", F.lit("l"), side(F.col("l"))))) | ((F.col("r") > 0) & (F.col("key") == F.xxhash64("anchor", F.lit("r"), side(F.col("r"))))))
    groups = keyed.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("*").alias("members")).where("low < high")
    wanted = stored(keyed.join(groups, "key").select("id", "digest", "key", "members"), "passages-wanted")
    segments = stored(_segments(texts, wanted), "passages-segments")
    ranged = _search_index(segments.where(F.col("members") <= GROUP_LIMIT), parts).unionByName(_search_windows(segments.where(F.col("members") > GROUP_LIMIT)))
    ranged = stored(ranged, "passages-ranges")
    whole = found.where("whole").select("id", "digest", F.lit(None).cast("array<int>").alias("ranges"))
    lists = whole.unionByName(ranged).groupBy("id").agg(F.collect_list(F.struct("digest", "ranges")).alias("_passages_runs"))
    kept = [f"`{c}`" for c in docs.columns if c != "passages" and not c.startswith("_passages")]
    own = docs.select(*kept).withColumn("_passages_id", own_id)
    both = own.join(lists.withColumnRenamed("id", "_passages_id"), "_passages_id", "left")
    return both.select(*kept, _remove(F.col("text"), F.col("_passages_runs")).alias("passages"))
