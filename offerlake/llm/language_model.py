"""Scoring by a gated recurrent language model with a class-factored output softmax.

The most frequent words each have a slot of their own; all others share one of a fixed number by their ending, and within
it have the share of their count in all training texts, so every word of the corpus counts, and what is gathered grows
with it. Slots are put into classes of equal size by the company they keep. A word's probability is that of its class
after the words before, times that of its slot within the class; the network's state gives both.

All training texts are counted, and all are trained on. Training goes in rounds, each over its share of the texts: tasks
start from the same parameters, learn from their texts by truncated backpropagation, and their results are averaged by
the words they have seen. What comes to the driver is one model's parameters, whatever the corpus.

The slots, and the counts of a fixed number of frequent words, are known in every task. The rest of the words in a text are
looked up by a join on their hashes, so that no task holds the vocabulary.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, one_core, slices, stored
from .gru import NONE, Gru

END = b" "  # no word has a space
PRIOR = 0.1


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then one end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def tokens(column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(places, words, sizes): the words of all texts, as places in the list of different ones, and how many each text has; as
    words() gives them, but split and told apart by Arrow."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column))
    flat, of = parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not some.all():
        flat, of = flat.filter(pa.array(some)), of[some]
    encoded = flat.dictionary_encode()
    _, offsets, data = encoded.dictionary.buffers()
    ends, data = np.frombuffer(offsets, np.int32)[: len(encoded.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
    found = [*(data[a:b] for a, b in zip(ends, ends[1:])), END]
    sizes = np.bincount(of, minlength=len(column)) + 1
    places = np.full(len(of) + len(column), len(found) - 1, np.int64)
    inner = np.ones(len(places), bool)
    inner[np.cumsum(sizes) - 1] = False
    places[inner] = encoded.indices.to_numpy(zero_copy_only=False)
    return places, found, sizes


def key(word: bytes) -> int:
    """64 bits that stand for a word in joins; two of a billion words share them once in forty corpora."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def count_words(docs: DataFrame) -> DataFrame:
    """(key, word, n) over all texts; counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": pa.array(map(key, counts), pa.int64()), "word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())})

        counts: Counter = Counter()
        for batch in slices(batches, limit=4 << 20):
            places, found, _ = tokens(batch.column("text"))
            for word, n in zip(found, np.bincount(places, minlength=len(found)).tolist(), strict=True):
                counts[word] += n
            if len(counts) > 400_000:
                yield sent()
                counts = Counter()
        yield sent()

    return docs.select("text").mapInArrow(run, "key long, word binary, n long").groupBy("key", "word").agg(F.sum("n").alias("n"))


class Slots:
    """Word -> code: words whose counts every task knows from 0, then the endings of all others. kind: code -> the `own` most
    frequent words each for itself, then endings; slot: kind -> slot of the network."""

    def __init__(self, numbers: dict[bytes, int], own: int, endings: int, slot: np.ndarray | None = None):
        self.numbers, self.own, self.endings, self.slot = numbers, own, endings, slot
        self.kind = np.arange(len(numbers) + endings, dtype=np.int32)
        self.kind[own : len(numbers)] = [own + self.ending(w) for w, i in numbers.items() if i >= own]
        self.kind[len(numbers) :] -= len(numbers) - own

    def __reduce__(self):
        return Slots, (self.numbers, self.own, self.endings, self.slot)

    def ending(self, word: bytes) -> int:
        return zlib.crc32(word.rstrip(b".,;:!?\"')")[-3:]) % self.endings

    def codes(self, found: list[bytes]) -> np.ndarray:
        """A code for each word."""
        number, rest, ending = self.numbers.get, len(self.numbers), self.ending
        return np.fromiter((rest + ending(w) if (n := number(w)) is None else n for w in found), np.int32, len(found))


#: Neighbours that make a number's profile: the most frequent words, dealt to so many places on either side.
NEAR_WORDS, NEAR = 512, 16
#: Values in a row of partial sums.
CHUNK = 1 << 16


def _chunks(values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for k, i in enumerate(range(0, len(values), CHUNK)):
        yield k, values[i : i + CHUNK].astype(np.float64).tobytes()


def _summed(parts: DataFrame, length: int) -> np.ndarray:
    """The sum of vectors of one length that came in chunks (chunk, values). A chunk's rows stream through one task, which
    holds one of them; what comes to the driver is one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for chunk, values in zip(batch.column("chunk").to_pylist(), batch.column("values"), strict=True):
                own = np.frombuffer(values.as_py(), np.float64)
                if chunk != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pydict({"chunk": [at], "values": [total.tobytes()]}, schema)
                    at, total = chunk, own.copy()
                else:
                    total += own
        if at is not None:
            yield pa.RecordBatch.from_pydict({"chunk": [at], "values": [total.tobytes()]}, schema)

    schema = pa.schema([("chunk", pa.int32()), ("values", pa.binary())])
    n = -(-length // CHUNK)
    rows = parts.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk int, values binary").collect()  # n rows
    out = np.zeros(length)
    for chunk, values in rows:
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(bytes(values), np.float64)
    return out


def _coded(docs: DataFrame, slots: Slots, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """The texts as kinds, (round, values), and each kind's profile: how often which frequent words are beside it."""
    size = slots.own + slots.endings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile = np.zeros(size * 2 * NEAR, np.int64)
        with freed():
            for batch in slices(batches, limit=4 << 20):
                places, found, sizes = tokens(batch.column("text"))
                made = np.split(slots.kind[slots.codes(found)][places], np.cumsum(sizes)[:-1])
                for side, (own, near) in enumerate(((np.s_[:-1], np.s_[1:]), (np.s_[1:], np.s_[:-1]))):
                    x, y = (np.concatenate([c[part] for c in made]).astype(np.int64) for part in (own, near))
                    some = y < min(NEAR_WORDS, slots.own)
                    profile += np.bincount((x[some] * 2 + side) * NEAR + y[some] % NEAR, minlength=len(profile))
                yield pa.RecordBatch.from_pydict({"round": batch.column("round"), "chunk": pa.nulls(len(made), pa.int32()), "values": pa.array([c.tobytes() for c in made], pa.binary())})
            chunks, values = zip(*_chunks(profile), strict=True)
            yield pa.RecordBatch.from_pydict({"round": pa.nulls(len(chunks), pa.int32()), "chunk": pa.array(chunks, pa.int32()), "values": pa.array(values, pa.binary())})

    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)).cast("int").alias("round"), "text")
    out = stored(dealt.mapInArrow(run, "round int, chunk int, values binary"), "coded")
    profile = _summed(out.where("round is null").select("chunk", "values"), size * 2 * NEAR)
    return out.where("round is not null").select("round", "values"), profile.reshape(size, 2 * NEAR)


def _dealt(profile: np.ndarray, per_class: int) -> np.ndarray:
    """An order of all numbers in which each `per_class` after one another make a class: halves along the direction in which
    they differ most, again and again, cut at whole classes."""
    share = np.sqrt(profile / np.maximum(profile.sum(axis=1, keepdims=True), 1))
    share -= share.mean(axis=0)

    def halves(own: np.ndarray) -> np.ndarray:
        n = -(-len(own) // per_class)
        if n < 2:
            return own
        x = share[own] - share[own].mean(axis=0)
        along = np.linalg.eigh(x.T @ x)[1][:, -1]
        own = own[np.argsort(x @ along, kind="stable")]
        cut = n // 2 * per_class
        return np.concatenate([halves(own[:cut]), halves(own[cut:])])

    return halves(np.arange(len(profile)))


class LanguageModel:
    """counts: stored (key, word, n); total: tokens; distinct: different tokens; the rest is what every task needs."""

    def __init__(self, counts: DataFrame, total: int, distinct: int, slots: Slots, network: Gru, frequent_counts: np.ndarray, mass: np.ndarray):
        self.counts, self.total, self.distinct, self.slots, self.network = counts, total, distinct, slots, network
        self.frequent_counts, self.mass = frequent_counts, mass

    def score(self, docs: DataFrame) -> DataFrame:
        """One row (doc_id, n_tokens, n_known, base_score, score) for each row of docs (doc_id, text): scores are base-10
        logarithms of the whole text's probability, by the counts alone and by the model.

        Null texts count as empty: one token, the end. Words that training lacks count 0 and have the prior's share of their
        ending. Repeated rows each get a row; other columns are ignored; an empty table gives an empty one."""
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast((self.slots, self.network, np.log10(self.frequent_counts + PRIOR), np.log10(self.mass)))
        floor = math.log10(self.total + PRIOR * (self.distinct + 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_core()
            slots, network, known, mass = shared.value
            part, done = TaskContext.get().partitionId() << 36, 0
            n_frequent = len(slots.numbers)
            with freed():
                for batch in slices(batches, limit=12 << 20):
                    places, found, n = tokens(batch.column("text"))
                    codes = slots.codes(found)
                    flat, begin = codes[places], np.cumsum(n) - n
                    rare = np.flatnonzero(flat >= n_frequent)
                    # each text's different rare words, in one number: the text's times so many words, plus the word's place
                    pairs, times = np.unique(np.repeat(np.arange(len(n)), n)[rare] * len(found) + places[rare], return_counts=True)
                    keys = np.zeros(len(found), np.int64)
                    for at in np.flatnonzero(codes >= n_frequent).tolist():
                        keys[at] = key(found[at])
                    offsets = pa.array(np.searchsorted(pairs, np.arange(len(n) + 1) * len(found)), pa.int32())
                    rare_keys = pa.ListArray.from_arrays(offsets, pa.array(keys[pairs % len(found)], pa.int64()))
                    rare_counts = pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))
                    kind = slots.kind[flat]
                    logs = network.score(np.split(slots.slot[kind], begin[1:])) / math.log(10)
                    frequent, shared_slot = flat < n_frequent, kind >= slots.own
                    counts = np.where(frequent, known[np.minimum(flat, len(known) - 1)], 0.0)
                    counted = np.add.reduceat(counts, begin)
                    shares = np.add.reduceat(np.where(shared_slot, mass[np.maximum(kind - slots.own, 0)] - counts, 0.0), begin)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "row": pa.array(np.arange(len(n)) + done + part), "doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "frequent": pa.array(np.add.reduceat(frequent.astype(np.int64), begin), pa.int64()),
                            "counted": pa.array(counted), "base": pa.array(-n * floor), "model": pa.array(logs - shares), "rare_keys": rare_keys, "rare_counts": rare_counts,
                        }
                    )
                    done += len(n)

        schema = "row long, doc_id long, n_tokens long, frequent long, counted double, base double, model double, rare_keys array<long>, rare_counts array<int>"
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        scored = stored(rows.mapInArrow(run, schema), "scored")
        rare = scored.select("row", F.explode(F.arrays_zip("rare_keys", "rare_counts")).alias("x")).select("row", F.col("x.rare_keys").alias("key"), F.col("x.rare_counts").alias("times"))
        found = rare.join(self.counts.select("key", "n"), "key", "left").groupBy("row")
        found = found.agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(PRIOR))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
        both = scored.drop("rare_keys", "rare_counts").join(found, "row", "left").fillna(0, ["more", "rare_known"])
        more = F.col("more")
        return both.select("doc_id", "n_tokens", (F.col("frequent") + F.col("rare_known")).alias("n_known"), (F.col("counted") + more + F.col("base")).alias("base_score"), (F.col("model") + more).alias("score"))


#: Texts are learned from side by side, so many that a step over one window of each costs little more than its products.
LANES = 1024


def train(docs: DataFrame, known_words: int = 100_000, frequent_words: int = 3_840, endings: int = 256, per_class: int = 64, size: int = 16, rounds: int = 4, every: int = 1, rate: float = 0.01) -> LanguageModel:
    """A model of all texts of docs (doc_id, text).

    The sizes of what every task holds are parameters: the counts of `known_words` (the others are joined), and of the
    network `frequent_words` with slots of their own, `endings` for all others, classes of `per_class` slots, states of `size`. All texts are learned from, state and all, in `rounds` rounds, a step for
    each `every` windows of 16 words of all lanes. As many tasks learn side by side as the cluster has cores. Null texts count
    as empty, null ids are trained on as others are. With no texts every word has the prior's share.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(count_words(docs), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = _frequent(counts, known_words)
    own = min(frequent_words, len(top))
    slots = Slots({w: i for i, (w, _) in enumerate(top)}, own, endings)
    coded, profile = _coded(docs, slots, rounds)
    frequent_counts = np.array([n for _, n in top] or [0], np.float64)
    mass = np.full(endings, PRIOR)  # for words that training lacks
    for ending, share in _rest_mass(counts, slots).collect():  # a row for each ending
        mass[ending] += share
    order = _dealt(profile, per_class)
    classes = -(-len(order) // per_class)
    slots.slot = np.empty(len(order), np.int32)
    slots.slot[order] = np.arange(len(order))
    network = Gru(classes, per_class, size)
    weights = np.full(classes * per_class, 0.0)
    weights[slots.slot] = np.concatenate([frequent_counts[:own] + PRIOR, mass])
    weights = weights.reshape(classes, per_class)
    network.p["m"][:] = np.where(weights > 0, np.log(np.maximum(weights, 1e-9) / weights.sum(axis=1, keepdims=True)), NONE)
    network.p["b"][:] = np.log(weights.sum(axis=1) / weights.sum())
    for k in range(rounds):
        network = _learned(coded.where(F.col("round") == k), network, slots.slot, every, rate * 0.6**k, spark.sparkContext.defaultParallelism)
    return LanguageModel(counts, total, distinct, slots, network, frequent_counts, mass)


def _learned(coded: DataFrame, network: Gru, slot: np.ndarray, every: int, rate: float, tasks: int) -> Gru:
    """The network after a round: the mean of what the tasks have learned, by the words that each has read."""
    length = len(network.packed())
    shared = coded.sparkSession.sparkContext.broadcast((network, slot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        start, slot = shared.value
        own = Gru(start.classes, start.members, start.size).unpack(start.packed())
        seen, moments, held, n_held = 0, None, [], 0
        with freed():
            for batch in batches:
                for values in batch.column("values"):
                    held.append(slot[np.frombuffer(values.as_py(), np.int32)])
                    n_held += len(held[-1])
                    if n_held >= 1 << 20:
                        moments = own.train(held, rate, lanes=LANES, every=every, moments=moments)
                        seen, held, n_held = seen + n_held, [], 0
            own.train(held, rate, lanes=LANES, every=every, moments=moments)
            seen += n_held
            if seen:
                rows = [*_chunks(np.append(own.packed().astype(np.float64) * seen, seen))]
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c for c, _ in rows], pa.int32()), "values": pa.array([v for _, v in rows], pa.binary())})

    sums = _summed(coded.select("values").coalesce(tasks).mapInArrow(run, "chunk int, values binary"), length + 1)
    return network.unpack((sums[:-1] / sums[-1])) if sums[-1] else network


def _frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most `most` words, with their counts: those above the smallest step of a 64th of a doubling for which they are no
    more. The steps are few, so neither task nor driver sees more words than these."""
    step = F.floor(F.log2("n") * 64)
    kinds = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True)
    least, seen = None, 0
    for n, own in kinds:
        seen += own
        if seen > most:
            break
        least = n
    if least is None:
        return []
    found = counts.where(step >= least).select("word", "n").toArrow()
    return sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def _rest_mass(counts: DataFrame, slots: Slots) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(slots.endings)
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if slots.numbers.get(word, slots.own) >= slots.own:
                    mass[slots.ending(word)] += n + PRIOR
        some = np.flatnonzero(mass)
        yield pa.RecordBatch.from_pydict({"ending": pa.array(some, pa.int32()), "mass": pa.array(mass[some])})

    return counts.select("word", "n").mapInArrow(run, "ending int, mass double").groupBy("ending").agg(F.sum("mass").alias("mass"))


def held_out(doc_id: Column) -> Column:
    """The tenth of documents whose checksum's remainder is 0; null ids are none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))
