"""Benchmark decontamination by spaced seeds.

A seed is a mask over word positions, some of which it ignores, so that a passage with some words substituted still
shares seeds with its source. Masks are hashed at every place of the test items and of the training texts, and the
hashes are joined. Each side brings the words around its place, so what a join finds is verified where it is: the
words are laid side by side and the equal ones counted in every window about the hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, slices, stored
from .words import HASHES, ODD, hashes, windows

#: The fixed masks: 1 is a word that counts, 0 one that is ignored. Five words count in each. Of 13 words (or of 9 to 12)
#: any two (or as many as 80 % allows) may differ, and one of these still fits somewhere between them.
MASKS = ("11111", "1101011", "111000101", "10110011")
LONGEST = max(map(len, MASKS))
HITS = "array<struct<item_id:long,start_word:int,n_words:int,most_equal:int>>"
#: Slots of the table of bits that turns away most places of training texts before the join, for each seed of the items;
#: and the powers of two that bound it. The join decides, so a table that is too full only lets more places through.
SLOTS, LEAST_BITS, MOST_BITS = 64, 20, 25
#: Words of texts that are looked up side by side, so that a short text does not cost a call of its own for each step.
WORDS = 1 << 15


def masks_for(lengths: list[int]) -> dict[int, tuple[list[int], int | None]]:
    """Number -> (offsets, words of the items it is for; None: LONGEST or more). Items of 5 to LONGEST - 1 words may have one
    word changed, which lies in one of their thirds, so each of three masks leaves a third out; shorter ones none."""
    out: dict[int, tuple[list[int], int | None]] = {k: ([j for j, c in enumerate(m) if c == "1"], None) for k, m in enumerate(MASKS)}
    for n in lengths:
        kept = [list(range(n))] if n < 5 else [[j for j in range(n) if j not in third] for third in np.array_split(np.arange(n), 3)]
        out |= {len(MASKS) + 3 * n + v: (offsets, n) for v, offsets in enumerate(kept)}
    return out


def seeds(words: np.ndarray, number: int, offsets: list[int]) -> np.ndarray:
    """The seed at each place."""
    return windows(words, offsets) ^ ODD[128 + number]


def _around(words: np.ndarray, place: int, radius: int) -> tuple[int, bytes]:
    """(words before the place, packed words) of what lies near a place."""
    begin = max(place - radius, 0)
    return place - begin, words[begin : place + radius + LONGEST].tobytes()


def _item_seeds(items: DataFrame, masks: dict, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with freed(HASHES):
            for batch in slices(batches, limit=1 << 20):
                out = []
                for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = hashes(text)
                    for number, (offsets, n) in masks.items():
                        if len(words) >= LONGEST if n is None else len(words) == n:
                            for at, seed in enumerate(seeds(words, number, offsets).view(np.int64)[: None if n is None else 1].tolist()):
                                out.append((seed, item_id, at, len(words), *_around(words, at, radius)))
                yield _batch(out, ("seed", "item_id", "at", "item_words", "item_lead", "item_near"), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))

    return items.mapInArrow(run, "seed long, item_id long, at int, item_words int, item_lead int, item_near binary")


def _batch(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, k, c in zip(names, kinds, columns, strict=True)})


def _table(item_seeds: DataFrame, bits: int) -> np.ndarray:
    """Two slots a seed, of 2^bits: at most 1,024 rows of 4 kB come to the driver, whatever the benchmark."""
    slots = item_seeds.select(F.explode(F.array(F.shiftrightunsigned("seed", 64 - bits), F.col("seed").bitwiseAND((1 << bits) - 1))).alias("slot"))
    place = F.col("slot") + 1  # these functions count from 1
    maps = slots.groupBy(F.bitmap_bucket_number(place).alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    table = np.zeros(1 << bits, bool)
    for number, packed in maps.collect():
        table[np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")) + (number - 1) * 32768] = True
    return table


def _likely(held: list[tuple[bytes, np.ndarray]], masks: dict, radius: int, bits: int, likely: np.ndarray) -> list[tuple]:
    """(key, seed, place, lead, near) for the places of texts (key, words), laid end to end, whose seed an item may have. A seed that
    reaches beyond its text's end is none."""
    low, shift, out = np.uint64((1 << bits) - 1), np.uint64(64 - bits), []
    words, ends = np.concatenate([np.zeros(0, np.uint64), *(own for _, own in held)]), np.cumsum([len(own) for _, own in held])
    for number, (offsets, _) in masks.items():
        found = seeds(words, number, offsets)
        at = np.flatnonzero(likely[found >> shift])
        at = at[likely[found[at] & low]]
        text = np.searchsorted(ends, at, "right")
        inside = at + max(offsets) < ends[text]
        for p, nth, seed in zip(at[inside].tolist(), text[inside].tolist(), found[at[inside]].view(np.int64).tolist(), strict=True):
            key, own = held[nth]
            place = p - int(ends[nth]) + len(own)
            out.append((key, seed, place, *_around(own, place, radius)))
    return out


def _places(docs: DataFrame, masks: dict, radius: int, bits: int, table) -> DataFrame:
    """(key, seed, place, lead, near) for the places of each text whose seed an item may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with freed(HASHES):
            for batch in slices(batches, limit=4 << 20):
                out, done, held, n_held = [], set(), [], 0
                for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                    if key in done:  # a copy
                        continue
                    done.add(key)
                    held.append((key, hashes(text.as_py())))
                    n_held += len(held[-1][1])
                    if n_held >= WORDS:
                        out += _likely(held, masks, radius, bits, table.value)
                        held, n_held = [], 0
                out += _likely(held, masks, radius, bits, table.value)
                yield _batch(out, ("key", "seed", "place", "lead", "near"), (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))

    return docs.mapInArrow(run, "key binary, seed long, place int, lead int, near binary")


def overlap(words: np.ndarray, item: np.ndarray, shift: int, span: int, least: int) -> tuple[int, int, int] | None:
    """(begin, end, most equal) of the windows of `span` words with `least` or more equal, item word i lying beside text
    word i + shift; None if there are none."""
    a, b = max(shift, 0), min(len(words), shift + len(item))
    if b - a < span:
        return None
    equal = np.concatenate([[0], np.cumsum(words[a:b] == item[a - shift : b - shift])])
    n = equal[span:] - equal[:-span]
    good = np.flatnonzero(n >= least)
    return (a + int(good[0]), a + int(good[-1]) + span, int(n.max())) if len(good) else None


def _verified(joined: DataFrame, span: int, share: float) -> DataFrame:
    """(key, item_id, beside, start, stop, most_equal): windows about a hit with enough equal words; beside is the text's
    word that the item's first lies beside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, item_id, place, lead, near, at, n_item, item_lead, item_near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = min(span, n_item)
                least = int(np.ceil(share * n - 1e-9))
                if found := overlap(np.frombuffer(near, np.uint64), np.frombuffer(item_near, np.uint64), lead - item_lead, n, least):
                    start, stop, most = found
                    out.append((key, item_id, place - at, place - lead + start, place - lead + stop, most))
            yield _batch(out, ("key", "item_id", "beside", "start", "stop", "most_equal"), (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()))

    rows = joined.select("key", "item_id", "place", "lead", "near", "at", "item_words", "item_lead", "item_near")
    return rows.mapInArrow(run, "key binary, item_id long, beside int, start int, stop int, most_equal int")


def find_leaks(docs: DataFrame, benchmark: DataFrame, span: int = 13, share: float = 0.8) -> DataFrame:
    """docs (with text) plus leaks: the overlaps with items of benchmark (item_id, text), empty where there are none.

    A text overlaps an item if, laid side by side at some start, at least `share` of `span` successive words are
    equal (of all its words, for an item of fewer). With the default span and share no such overlap is missed, but for items
    of fewer than five words, which must occur with all words equal as they have no two words to spare; items without words
    are never found. Each overlap has its item, its first word in the text, the words from the first such window to the end
    of the last, and the most equal words of one.

    Both sides' seeds are joined on their hashes, so neither table is held whole anywhere; what is broadcast is a table of
    bits of at most 2^25 bytes that turns most places of the texts away beforehand. Null texts have no leaks; repeated rows
    each get theirs; items of equal texts are all reported; existing columns named leaks, or starting with _leaks_, are
    replaced; null item ids and texts are left out; an empty benchmark finds nothing, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("item_id is not null and text is not null")
    kept = [f"`{c}`" for c in docs.columns if c != "leaks" and not c.startswith("_leaks_")]
    masks = masks_for(list(range(1, LONGEST)))
    item_seeds = stored(_item_seeds(items, masks, span), "item-seeds")
    short = {r[0] for r in item_seeds.where(F.col("item_words") < LONGEST).select("item_words").distinct().collect()}  # at most eight
    masks = masks_for(sorted(short))
    bits = min(max(int(item_seeds.count() * SLOTS).bit_length(), LEAST_BITS), MOST_BITS)
    table = spark.sparkContext.broadcast(_table(item_seeds, bits))
    key = F.unhex(F.md5(F.encode("text", "UTF-8")))
    places = stored(_places(docs.select(key.alias("key"), "text").where("text is not null"), masks, span, bits, table), "leak-places")
    found = _verified(places.join(item_seeds, "seed"), span, share)
    found = found.groupBy("key", "item_id", "beside").agg(F.min("start").alias("start_word"), F.max("stop").alias("stop"), F.max("most_equal").alias("most_equal"))
    hit = F.struct("item_id", "start_word", (F.col("stop") - F.col("start_word")).alias("n_words"), "most_equal")
    lists = stored(found.groupBy(F.col("key").alias("_leaks_key")).agg(F.array_sort(F.collect_list(hit)).cast(HITS).alias("_leaks_list")), "leaks")
    both = docs.select(*kept, key.alias("_leaks_key")).join(lists, "_leaks_key", "left")
    return both.select(*kept, F.coalesce("_leaks_list", F.array().cast(HITS)).alias("leaks"))
