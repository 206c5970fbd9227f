import collections
import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from offerlake.llm import imatch, near_duplicates, queries, suffix_dedup
from offerlake.llm.components import components
from offerlake.llm.words import ODD

from .conftest import SF


def classes(texts, least=0.8):
    """Connected components of all pairs whose labelled five-word shingles are alike."""
    marks = {}
    for i, t in texts.items():
        words, seen = re.findall(r"\w+", t.lower()), collections.Counter()
        own = set()
        for k in range(len(words) - 4):
            gram = tuple(words[k : k + 5])
            own.add((gram, seen[gram]))
            seen[gram] += 1
        marks[i] = own or {("all", tuple(words) or t)}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and len(marks[a] & marks[b]) >= least * len(marks[a] | marks[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def test_op5_query(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert {r.doc_id: r.class_id for r in queries.op5_near_duplicates(spark, SF).collect()} == classes(texts)


def test_groups_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    texts = {}
    for i in range(120):  # copies of a text, each changed in up to 14 places, so that some pairs are alike and others not
        own = list(base)
        for _ in range(i % 15):
            own[rng.randrange(300)] = f"x{rng.randrange(10_000)}"
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(docs).collect()}
    expected = classes(texts)
    assert sum(got[i] != expected[i] for i in texts) <= 1


def test_texts_from_one_template(spark, monkeypatch):
    rng = random.Random(11)
    template = [f"w{k}" for k in range(200)]

    def changed(words, n):
        own = list(words)
        for k in rng.sample(range(200), n):
            own[k] = f"x{rng.randrange(10**9)}"
        return own

    texts = {}
    for i in range(0, 1000, 2):  # neighbours are alike (about 0.8), all others share buckets but are not
        base = changed(template, 5)
        texts[i], texts[i + 1] = " ".join(base), " ".join(changed(base, 4))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(near_duplicates, "BLOCK_TEXTS", 100, raising=False)  # several blocks a bucket
    assert {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(docs).collect()} == classes(texts)


def test_near_duplicates_odd_rows(odd, empty):
    rows = near_duplicates.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: r.class_id for r in rows}
    assert got[5] == got[1] == 1 and got[2] == got[3] == 2 and got[7] == 7 and got[9] == 9 and got[None] is None
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_banded_alignment():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row
            row = [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        return row[-1] / (len(a) + len(b) - row[-1])

    rng = random.Random(5)
    for _ in range(400):
        a = [rng.randrange(30) for _ in range(rng.randint(1, 60))]
        b = [x for x in a if rng.random() > 0.05]
        if rng.random() < 0.5:
            b[rng.randrange(len(b) + 1) : 0] = [rng.randrange(30) for _ in range(rng.randint(1, 4))]
        if not b:
            continue
        exact, got = plain(a, b), near_duplicates.similarity(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
        assert (exact >= 0.8) == (got >= 0.8) and (got < 0.8 or abs(exact - got) < 1e-12)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(texts):
    """(n_bytes, n_removed, n_spans, digest) by the definition."""
    seen, out = set(), {}
    for i in sorted(texts):
        x = texts[i].encode()
        gone = bytearray(len(x))
        for s in range(len(x) - 99):
            w = x[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(a for a, g in zip(x, gone, strict=True) if not g)
        out[i] = (len(x), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def results(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_op7_query(spark, documents):
    assert results(queries.op7_suffix_dedup(spark, SF)) == removed({r.doc_id: r.text for r in documents.collect()})


def test_shared_passages_and_periods(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(4)] + ["ab" * 90, "x" * 130, "hello world, " * 12]
    texts = {}
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 12)))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randint(60, len(p))], word()]
        texts[i] = " ".join(parts)
    path = str(tmp_path / "t")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    assert results(queries.op7_suffix_dedup(spark, path)) == removed(texts)
    monkeypatch.setattr(suffix_dedup, "GROUP_LIMIT", 3)  # the largest groups' way
    assert results(queries.op7_suffix_dedup(spark, path)) == removed(texts)


def test_index_family_levels():
    rng = random.Random(4)
    family, seen, n = suffix_dedup.IndexFamily(), {}, 0
    for _ in range(12):
        texts = ["".join(rng.choice("ab") for _ in range(3)) * 60 for _ in range(5)]
        ids = np.arange(n, n + 5)
        for i, t, found in zip(ids, texts, family.add([t.encode() for t in texts], ids), strict=True):
            windows = [t[k : k + 100] for k in range(len(t) - 99)]
            assert found.tolist() == [seen.get(w, i) < i for w in windows]
            for w in windows:
                seen[w] = min(seen.get(w, i), i)
        n += 5
        sizes = [len(w) for w, _ in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_remove_repeats_odd_rows(odd, empty):
    docs = odd.withColumn("passages", F.lit(1))
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == [*odd.columns, "passages"] and out.count() == odd.count()
    got = {r.doc_id: r.passages for r in out.collect()}
    assert got[5].n_bytes == got[1].n_bytes == 0 and got[7].spans == [] and len(got[9].spans) > 0
    assert suffix_dedup.remove_repeats(empty).count() == 0


U64 = (1 << 64) - 1


def mix(x):
    x = (x ^ x >> 32) * 0x9E3779B97F4A7C15 & U64
    return x ^ x >> 29


def fingerprint_by_hand(words, lexicon_words):
    """The digests from sets of words and plain integers."""
    terms = sorted(xxhash.xxh3_64_intdigest(w) for w in (words & lexicon_words or words))
    packed = lambda kept: b"".join(t.to_bytes(8, "little") for t in kept)
    out, some = "", False
    for k, one_in in enumerate([16] * 8 + [64] * 16 + [256] * 24):
        salt = int(ODD[k])
        kept = [t for t in terms if mix(mix(t ^ salt) * salt & U64) < (1 << 64) // one_in]
        some |= bool(kept)
        out += xxhash.xxh3_64_hexdigest(packed(kept))[:6] if kept else "------"
    return out if some else "=" + xxhash.xxh3_128_hexdigest(packed(terms))


def like_by_hand(a, b):
    if "=" in (a[0], b[0]):
        return float(a == b)
    pairs = [p for p in ((a[i : i + 6], b[i : i + 6]) for i in range(0, 288, 6)) if p != ("------", "------")]
    return sum(x == y for x, y in pairs) / len(pairs)


def test_op4_query(spark, documents):
    """The whole result against sets of words: document frequencies, the band, subsets, edits and likeness."""
    rows = {r.doc_id: r for r in queries.op4_imatch(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    words = lambda t: set(re.findall(r"\w+", t.lower()))
    counts = collections.Counter(w for t in texts.values() for w in words(t))
    band = {w for w, n in counts.items() if 0.0005 * len(texts) <= n <= 0.1 * len(texts)}
    ids = sorted(texts)
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        text, next_ = texts[i], texts[after]
        half = len(text) // 2
        changed = text[: len(text) - half] + next_[:half]
        own, edited, other = (fingerprint_by_hand(words(t), band) for t in (text, changed, next_))
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own, edited)
        assert (r.near_edited, r.near_next) == (like_by_hand(own, edited), like_by_hand(own, other))
    assert sum(r.near_edited for r in rows.values()) > 3 * sum(r.near_next for r in rows.values())


def test_lexicon_counts_terms_exactly(spark, monkeypatch):
    """Bands of document frequency, also where all terms share one cell and tasks send what they have often."""
    docs = spark.createDataFrame([(i, f"common {'middling' if i % 20 == 0 else ''} {'few' if i < 3 else ''} rare{i}") for i in range(400)], "doc_id long, text string")
    for bits, terms in ((20, 1 << 20), (1, 7)):
        monkeypatch.setattr(imatch, "CELL_BITS", bits)
        monkeypatch.setattr(imatch, "TERMS", terms)
        own = imatch.lexicon(docs, most=0.1, least=0.01)
        assert own.inside.tolist() == [xxhash.xxh3_64_intdigest("middling")]
        assert len(own.terms("common middling rare1")) == 1 and len(own.terms("common")) == 1  # the second for want of others


def test_short_texts_are_not_alike():
    words = [f"word{i}" for i in range(300)]
    own = imatch.Lexicon(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64))
    prints = [own.fingerprint(w) for w in words]
    assert len(set(prints)) == len(words) and len(imatch._EACH) == 48
    assert all(imatch.likeness(a, b) == 0.0 for a, b in zip(prints, prints[1:], strict=False))
    assert all(imatch.likeness(p, own.fingerprint(w.upper())) == 1.0 for p, w in zip(prints, words, strict=True))


def test_imatch_odd_rows(spark, odd, empty):
    own = imatch.lexicon(odd)
    rows = imatch.compare_with_edits(odd, own).collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(set)
    for r in imatch.fingerprints(odd, own).collect():
        by[r.doc_id].add(r.fingerprint)
    assert by[2] == by[3] and by[5] == by[1]
    assert imatch.compare_with_edits(empty, imatch.lexicon(empty)).count() == 0
    one = imatch.compare_with_edits(odd.where("doc_id = 2"), own).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
