import collections
import itertools
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from offerlake.llm import decontamination, queries, toxicity, url_filter, words

from .conftest import SF


def judged(url):
    """Host, path, rule and its verdict, step by step."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for what, rule in queries.RULES:
        name, slash, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + start) and (best is None or len(rule) > len(best[1])):
            best = (what, rule)
    return host, path, best


def test_rules(spark):
    urls = [
        None, "", "example.net/en/", "https://EXAMPLE.net/en/1", "http://a.example.net/de/1?x=/en/", "http://xnet/", "http://b.net", "https://example.com/de/#x", "http://a.example.com/en/", "ftp://q.org/fr/1://x/y", "http://É.ORG/fr/",
        "http://example.net?en/", "http://a.net/en/", "https://x.com\n/de/", "http://exaMple.com/de", "://", "http://net/", "http://user@x.net:80/",
    ]
    made = spark.createDataFrame([(i, u, "kept?", 1.0) for i, u in enumerate(urls * 2)], "page_id long, url string, host string, suffix double")
    model = url_filter.UrlModel(None, spark.createDataFrame([], "suffix string, suffix_rate double"), 0.2)
    rows = url_filter.judge(made, queries.RULES, model).collect()
    assert len(rows) == len(made.collect())
    for r in rows:
        host, path, best = judged(urls[r.page_id % len(urls)])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[1], best[0] if best else "allow")
    assert url_filter.judge(made.limit(0), queries.RULES, model).count() == 0


def test_op1_query(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op1_url_filter(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, best = judged(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == (best[0] if best else "block" if r.unwanted >= 0.5 else "allow")


def test_trees_learn_urls(spark):
    def made(seed, n):
        rows = [(f"http://{'shop-now-%d-x' % (i * seed % 97) if i % 3 == 0 else 'site' + 'abcdefgh'[i % 8]}.example.com/a/{i * seed}", float(i % 3 == 0)) for i in range(n)]
        urls = spark.createDataFrame(rows, "url string, label double")
        host, path = url_filter.host_and_path(F.col("url"))
        return urls.select("url", host.alias("host"), path.alias("path"), "label")

    scored = url_filter.train(made(7, 300), trees=5).score(made(13, 200)).collect()
    assert sum((r.unwanted >= 0.5) == (r.label == 1) for r in scored) >= 195
    assert url_filter.train(made(7, 0)).base == 0
    assert url_filter.train(made(7, 30).where("label = 1")).score(made(1, 3)).first().unwanted == 1.0


def test_urls_held_out(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host, path = url_filter.host_and_path(F.col("url"))
    urls = url_filter.weak_labels(pages.select("url", host.alias("host"), path.alias("path")))
    kept = F.pmod(F.crc32("url"), F.lit(4)) != 2
    rows = url_filter.train(urls.where(kept)).score(urls.where(~kept)).select("label", "unwanted").collect()
    ones, zeros = ([r.unwanted for r in rows if r.label == x] for x in (1, 0))
    above = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    print("held-out area under the curve", above, len(ones), len(zeros))
    assert above >= 0.9


def test_suffix_rates_leave_the_row_out(spark):
    """Labels that chance gave: a suffix of its own for each URL must not tell them."""
    rows = [(f"http://a.s{i}.io/{'x' * (i % 5)}", float(i * 7919 % 10 < 3)) for i in range(400)]
    host, path = url_filter.host_and_path(F.col("url"))
    urls = spark.createDataFrame(rows, "url string, label double").select("url", host.alias("host"), path.alias("path"), "label")
    model = url_filter.train(urls, trees=3)
    assert model.trees.stages[1].featureImportances[len(url_filter.FEATURES)] == 0


def test_toxicity_held_out(spark):
    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == t for p, t in held) >= 0.9 * len(held)


def test_toxicity_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    for docs in (odd.withColumn("toxicity", F.lit("x")).withColumn("prediction", F.lit(1)), empty):
        model = toxicity.train(docs, labels)
        assert model.score(docs).count() == docs.count()
    texts = [(i, ("you are an idiot and a moron " if i % 2 else "the garden was green and quiet ") * (1 + i % 3) + f"w{i % 7}") for i in range(160)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")), trees=3)
    both = odd.withColumn("probability", F.lit(1)).withColumn("features", F.lit("f"))
    scored = model.score(both)
    assert scored.columns == [*both.columns, "toxicity"] and scored.count() == odd.count()
    assert [round(r.toxicity) for r in model.score(docs.limit(2).orderBy("doc_id")).collect()] == [0, 1]


def test_op10_query(spark, documents):
    """Every text against every item at every alignment that shares a word."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    where = collections.defaultdict(list)
    for i, item in items:
        for k, w in enumerate(item):
            where[w].append((i, k))
    size = dict((i, len(item)) for i, item in items)
    rows = {r.doc_id: r for r in queries.op10_decontamination(spark, SF).collect()}
    assert len(rows) == documents.count()
    n_leaked = 0
    for d in documents.collect():
        equal = collections.defaultdict(list)
        own = words(d.text)
        for p, w in enumerate(own):
            for i, k in where.get(w, ()):
                equal[i, p - k].append(p)
        expected = set()
        for (i, beside), places in equal.items():
            n, marks = min(13, size[i]), set(places)
            starts = range(max(beside, 0), min(beside + size[i], len(own)) - n + 1)
            good = [a for a in starts if sum(p in marks for p in range(a, a + n)) >= 0.8 * n - 1e-9] if len(places) >= 0.8 * n - 1e-9 else []
            if good:
                expected.add((i, good[0], good[-1] + n - good[0], max(sum(p in marks for p in range(a, a + n)) for a in good)))
        r = rows[d.doc_id]
        assert {tuple(x) for x in r.leaks} == expected, d.doc_id
        assert r.contaminated == bool(expected) and r.item_ids == sorted({x[0] for x in expected})
        n_leaked += bool(expected)
    assert 0 < n_leaked < len(rows)


def test_every_allowed_substitution_is_found():
    """All sets of words that 80 % allows to differ, in items and spans of 5 to 14 words."""
    for n in range(5, 15):
        span = min(n, 13)
        item = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        masks = {k: m for k, m in decontamination.masks_for([n] if n < decontamination.LONGEST else []).items() if m[1] == (n if n < decontamination.LONGEST else None)}
        for start in range(n - span + 1):
            for gone in itertools.combinations(range(start, start + span), span - math.ceil(0.8 * span - 1e-9)):
                text = item.copy()
                text[list(gone)] += np.uint64(1)
                assert any((decontamination.seeds(text, k, o) == decontamination.seeds(item, k, o)).any() for k, (o, _) in masks.items()), (n, gone)


def test_substitutions_and_odd_rows(spark, odd, empty):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    changed = item.replace("four", "4x").replace("eleven", "xx")
    docs = spark.createDataFrame([(1, f"start {changed} end"), (2, item.upper()), (3, "one two three four"), (4, None), (5, "tiny item here"), (6, "tiny thing here"), (7, "so five words are hexe x"), (1, f"start {changed} end")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, "tiny item here"), (4, None), (5, ""), (None, "x"), (6, "five words are here x")], "item_id long, text string")
    rows = decontamination.find_leaks(docs, bench).collect()
    assert len(rows) == 8
    got = {r.doc_id: sorted({x.item_id for x in r.leaks}) for r in rows}
    assert got == {1: [1, 2], 2: [1, 2], 3: [], 4: [], 5: [3], 6: [], 7: [6]}
    long = "filler " * 300_000 + item + " filler" * 1000
    assert [x.start_word for x in decontamination.find_leaks(spark.createDataFrame([(1, long)], "doc_id long, text string"), bench.where("item_id = 1")).first().leaks] == [300_000]
    clash = odd.withColumn("leaks", F.lit(1)).withColumn("_leaks_key", F.lit(2)).withColumn("key", F.lit(3)).withColumn("seed", F.lit(3))
    out = decontamination.find_leaks(clash, bench)
    assert out.count() == odd.count() and out.columns == [*odd.columns, "key", "seed", "leaks"]
    assert decontamination.find_leaks(empty, bench).count() == 0
    assert all(not r.leaks for r in decontamination.find_leaks(docs, bench.limit(0)).collect())


def test_seeds_of_texts_side_by_side_are_those_of_each_alone():
    """op10: texts are laid end to end for the lookup, and no seed may reach into the next one."""
    rng, masks = np.random.default_rng(4), decontamination.masks_for([3])
    held = [(b"%d" % i, rng.integers(0, 4, n).astype(np.uint64)) for i, n in enumerate((0, 30, 0, 4, 5, 200, 1, 9, 0))]
    table = np.ones(1 << 20, bool)
    table[::3] = False
    together = decontamination._likely(held, masks, 13, 20, table)
    alone = [row for one in held for row in decontamination._likely([one], masks, 13, 20, table)]
    assert sorted(together) == sorted(alone) and len(alone) > 100
    for key, seed, place, lead, near in together:
        own = dict(held)[key]
        assert near == own[place - lead : place + 13 + decontamination.LONGEST].tobytes() and lead == min(place, 13)
        assert any(len(own) > place + max(o) and seed == int(decontamination.seeds(own[place : place + max(o) + 1], n, o).view(np.int64)[0]) for n, (o, _) in masks.items())
    assert decontamination._likely([], masks, 13, 20, table) == []


def test_words_without_the_expression_are_its_matches():
    """op4, op10: each character alone and between letters, and texts that mix those of the first 256 with others."""
    for c in map(chr, [*range(0x3000), *range(0xD7F0, 0xE010), *range(0xFE00, 0x10000), 0x1F600, 0x10FFFF]):
        for text in (c, f"aB{c}c_1", f"é{c}\xa0\x85\x1cZ"):
            assert words.words_of(text) == words.WORD.findall(text.lower())
    assert words.words_of(None) == words.words_of("") == []
