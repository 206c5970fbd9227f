import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tiktoken.load
from pyspark.sql import functions as F

import corpus_pipeline
from offerlake.llm import gru, language_model, queries, sharding

from .conftest import SF


def test_op8_query(spark, documents):
    rows = queries.op8_sharding(spark, SF).collect()
    texts = {r.doc_id: r.text.encode() for r in documents.collect()}
    sizes = {i: len(t) + 16 for i, t in texts.items()}
    total, before = sum(sizes.values()), 0
    got = {r.doc_id: r for r in rows}
    slots = collections.Counter()
    for i in sorted(texts):
        r = got[i]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (sizes[i], zlib.crc32(texts[i]), "bytes", None)
        assert r.shard == before * 40 // total and r.slot == slots[r.shard]
        before += sizes[i]
        slots[r.shard] += 1


def test_sharding_odd_rows(odd, empty):
    rows = sharding.shard_by_bytes(odd, 4).collect()
    assert len(rows) == odd.count() and {r.shard for r in rows} <= set(range(4))
    for k in range(4):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(empty, 4).count() == 0


def test_op9_query(spark, documents):
    counts, words = collections.Counter(), {}
    for r in documents.collect():
        words[r.doc_id] = [*r.text.encode().lower().split(), b" "]
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            counts.update(words[r.doc_id])
    n, v = sum(counts.values()), len(counts)
    rows = queries.op9_language_model(spark, SF).collect()
    assert len(rows) == len(words)
    for r in rows:
        own = words[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


SMALL = dict(known_words=20, frequent_words=9, endings=4, per_class=5, size=8, rounds=2)


def test_language_model_odd_rows(odd, empty):
    model = language_model.train(odd, **SMALL)
    rows = model.score(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 5)} == {1}
    assert len({r.score for r in rows if r.doc_id == 3}) == 1  # repeated rows, equal texts
    assert model.score(empty).count() == 0
    none = language_model.train(empty, **SMALL)
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in none.score(odd).collect())


def test_probabilities_add_up(odd):
    """All words of the vocabulary, and an unknown one for each ending, after an empty and a longer context."""
    model = language_model.train(odd, **SMALL)
    slots, network = model.slots, model.network
    rows = model.counts.collect()
    assert len(slots.numbers) < len(rows)  # some words share an ending's slot
    assert slots.own < len(slots.numbers)
    for context in ([], [b"the", b"same"]):
        h = np.zeros((1, network.size), np.float32)
        for before in [-1, *slots.slot[slots.kind[slots.codes(context)]]]:
            h = network.step(network.inputs(np.array([before])), h)[0]
        share = lambda number: math.exp(network.log_probabilities(h, slots.slot[[number]])[0])
        total = 0.0
        for r in rows:
            kind = int(slots.kind[slots.codes([bytes(r.word)])[0]])
            rest = 1.0 if kind < slots.own else (r.n + 0.1) / model.mass[kind - slots.own]
            total += share(kind) * rest
        total += sum(share(slots.own + e) * 0.1 / model.mass[e] for e in range(slots.endings))
        assert abs(total - 1) < 1e-4


def test_classes_depend_on_company(spark):
    """The network beats the counts where the words before tell the next one."""
    docs = spark.createDataFrame([(i, " ".join(f"a{j} b{j}" for j in np.random.default_rng(i).integers(0, 30, 60))) for i in range(400)], "doc_id long, text string")
    model = language_model.train(docs, frequent_words=70, endings=4, per_class=9, size=16, rate=0.03, every=1)
    r = model.score(docs.where("doc_id = 7")).first()
    assert r.score > 0.75 * r.base_score  # a third of what is there to learn, at the least


def test_network_carries_its_state():
    rng = np.random.default_rng(1)
    network = gru.Gru(3, 4, 8)
    sequences = [rng.integers(0, 12, n) for n in (1, 70, 3, 33)]
    together = network.score(sequences)
    for s, got in zip(sequences, together, strict=True):
        h, before, total = np.zeros((1, network.size), np.float32), -1, 0.0
        for x in s:
            h = network.step(network.inputs(np.array([before])), h)[0]
            total += float(network.log_probabilities(h, np.array([x]))[0])
            before = x
        assert abs(total - got) < 1e-3
    learned = [np.tile([0, 5, 10, 3], 50) for _ in range(20)]
    network.train(learned, 0.03, lanes=8, every=1)
    assert network.score(learned)[0] > 0.5 * len(learned[0]) * math.log(1 / 12)


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    network = gru.Gru(3, 4, 5, kind=np.float64)
    slots = rng.integers(0, 12, (2, 6))
    before = np.concatenate([np.full((2, 1), -1), slots[:, :-1]], axis=1)
    begins = before < 0
    before[1, 3], begins[1, 3] = -1, True

    def loss():
        g = {k: np.zeros_like(x) for k, x in network.p.items()}
        return network._gradients(network.window(slots, before, begins, np.zeros((2, 5)))[1], g), g

    _, g = loss()
    for k, values in network.p.items():
        x = values.ravel()
        for i in rng.choice(len(x), min(10, len(x)), replace=False):
            kept = x[i]
            x[i] = kept + 1e-5
            high = loss()[0]
            x[i] = kept - 1e-5
            low = loss()[0]
            x[i] = kept
            assert abs((high - low) / 2e-5 - g[k].ravel()[i]) < 1e-8, k


def test_pipeline_stages(spark, documents):
    docs = documents.unionByName(documents.limit(3)).withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.count() == kept.select("doc_id").distinct().count() == queries.op5_near_duplicates(spark, SF).select("class_id").distinct().count()
    clean = corpus_pipeline.drop_leaks(spark, docs, SF)
    leaked = {r.doc_id for r in queries.op10_decontamination(spark, SF).where("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in documents.collect()} - leaked
    cut = corpus_pipeline.cut_passages(spark, documents, SF)
    assert all(r.n_chars == len(r.text) for r in cut.collect())


def test_pipeline_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs_out = stage(spark, docs, SF)
            assert docs_out.count() <= docs.count(), name


def similar(a, b):
    """Shingles of five words matched in order, of all shingles of both."""
    a, b = ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (re.findall(r"\w+", x.lower()) for x in (a, b)))
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1] / (len(a) + len(b) - row[-1]) if a and b else 0.0


def test_pipeline_against_plain_loops(spark, tmp_path):
    """All five stages over a small table with null ids, equal ids, copies, near copies, shared passages and leaks."""
    some = lambda seed, n: " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(n))
    passage, item = some(3, 60), some(99, 40)
    rows = [
        (1, some(1, 80)), (2, some(1, 79) + " changed"), (None, some(1, 80)), (None, some(2, 70)), (None, some(2, 70)), (3, some(4, 50)), (3, some(5, 50)), (4, some(6, 40) + " " + passage),
        (5, some(7, 40) + " " + passage), (6, some(8, 30) + " " + item + " " + some(9, 30)), (7, None), (8, ""), (9, some(10, 5)), (None, None), (10, some(11, 300)), (10, some(11, 300)),
    ]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")  # one label alone: none is toxic
    # one text for each id, the smallest digest's; those without id behind them, one row a text
    by_id = {}
    for i, t in rows:
        key = (0, i) if i is not None else (1, hashlib.sha256((t or "").encode()).hexdigest())
        by_id[key] = min(by_id.get(key, t or ""), t or "", key=lambda x: hashlib.sha256(x.encode()).hexdigest())
    kept = []
    for key in sorted(by_id):
        if not any(by_id[key] == t or similar(by_id[key], t) >= 0.8 for _, t in kept):
            kept.append((key, by_id[key]))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    near = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert sorted(map(str, ((r.doc_id, r.text or "") for r in near.collect()))) == sorted(str((k[1] if k[0] == 0 else None, t)) for k, t in kept)
    # bytes of 100-byte strings that start earlier; what is left of the texts, without those that leak
    seen, cut = set(), []
    for key, text in sorted(kept, key=lambda x: (x[0][0] == 0, x[0])):  # null ids come first
        data, gone = text.encode(), set()
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(data[i : i + 100])
        cut.append((key[1] if key[0] == 0 else None, bytes(x for i, x in enumerate(data) if i not in gone).decode(), bool(gone)))
    clean = [(i, t) for i, t, shorter in cut if (t.strip() or not shorter) and item not in t]
    assert any(shorter for _, _, shorter in cut) and len(clean) < len(cut)
    encoding = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    expected = sorted(str((i, encoding.encode_ordinary(t))) for i, t in clean)
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in out) == expected


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_tokens"] and 0 < out.count() < 200


def test_score_is_the_sum_over_words(odd):
    """Scores by word, with the shares of endings joined or known, equal what the query's way gives."""
    model = language_model.train(odd, **SMALL)
    slots, counts = model.slots, {bytes(r.word): r.n for r in model.counts.collect()}
    text = "the same text of some unseen words, x the a"
    h, before, total = np.zeros((1, model.network.size), np.float32), -1, 0.0
    for word in language_model.words(text):
        kind = int(slots.kind[slots.codes([word])[0]])
        h = model.network.step(model.network.inputs(np.array([before])), h)[0]
        before = int(slots.slot[kind])
        total += float(model.network.log_probabilities(h, np.array([before]))[0]) / math.log(10)
        total += 0 if kind < slots.own else math.log10((counts.get(word, 0) + 0.1) / model.mass[kind - slots.own])
    got = model.score(odd.sparkSession.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert abs(got.score - total) < 1e-3


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(cursor.fetchall())


def test_every_window_is_learned_from(monkeypatch):
    seen = []
    own = gru.Gru.__dict__["_gradients"]
    monkeypatch.setattr(gru.Gru, "_gradients", lambda self, trace, g: seen.append(sum(len(t[7]) for t in trace)) or own(self, trace, g))
    network = gru.Gru(2, 2, 4)
    network.train([np.arange(1000) % 4], 0.01, lanes=1, window=16, every=8)
    assert sum(seen) == 1000


def test_words_are_told_apart_by_class_many_at_a_time(monkeypatch):
    """Every class has products of its own, so texts of any lengths are scored in few and large windows."""
    seen = []
    own = gru.Gru.__dict__["_by_class"]
    monkeypatch.setattr(gru.Gru, "_by_class", lambda self, slots: seen.append(len(slots)) or own(self, slots))
    rng = np.random.default_rng(3)
    for sizes in ([20_000], [100] * 300):
        seen.clear()
        gru.Gru(3, 4, 8).score([rng.integers(0, 12, n) for n in sizes])
        assert sum(seen) == sum(sizes) and len(seen) == 1


def test_large_scores_are_not_cut():
    """Shares are those of double precision, also where single precision has no room for the exponentials."""
    rng = np.random.default_rng(4)
    network = gru.Gru(3, 4, 8)
    network.p["b"] += np.array([0, 95, 150], np.float32)
    network.p["m"] += rng.normal(0, 90, (3, 4)).astype(np.float32)
    h, slots = np.tanh(rng.normal(0, 1, (50, 8))).astype(np.float32), rng.integers(0, 12, 50)
    p = {k: x.astype(np.float64) for k, x in network.p.items()}
    for state, slot, got in zip(h.astype(np.float64), slots, network.log_probabilities(h, slots), strict=True):
        c = slot // 4
        of, member = state @ p["o"] + p["b"], p["v"][c * 4 : c * 4 + 4] @ state + p["m"][c]
        log = lambda s: s.max() + np.log(np.exp(s - s.max()).sum())
        assert abs(of[c] - log(of) + member[slot % 4] - log(member) - got) < 1e-2
