"""The secret scan against regular expressions over each text, and its verdicts against counts in memory."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from offerlake.llm import queries
from offerlake.llm.secret_scan import PLACEHOLDERS, find_secrets

from .conftest import SF

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
LIVE = "q7Zt0PxN4vKbY2mW9sLd"
SCHEMA = "doc_id long, text string, source string, lang string, spans int, digest string"


def matches(text):
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    found += [(m.start(), 3, m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9_-]+", text) if len(m[0]) >= 20 and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])]
    return sorted(found)


def plain(rows):
    owners, repositories = defaultdict(set), defaultdict(set)
    for _, text, source, lang in rows:
        for m in matches(text or ""):
            owners[m[3]].add(source or "")
            repositories[m[3]].add((source or "", lang or ""))
    out = []
    for i, text, _, _ in rows:
        ms, kinds = matches(text or ""), ["assign", "access", "hex", "token"]
        live = lambda v: len(set(v)) >= 8 and bool(re.search("[0-9]", v)) and not re.search(PLACEHOLDERS, v.lower())
        rare = lambda v: len(owners[v]) <= 2 and len(repositories[v]) <= 20
        base = [m for m in ms if m[1] < 3]
        shown = [m for m in ms if m[1] < 3 or live(m[3]) and rare(m[3]) and m[3] not in {b[3] for b in base}]
        say = lambda x: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b, _ in x)
        counts = [sum(m[1] == k for m in base) for k in range(3)]
        out.append((i, *counts, hashlib.sha256(say(base).encode()).hexdigest(), say(shown), sum(live(m[3]) and rare(m[3]) for m in shown), sum(not rare(m[3]) for m in shown)))
    return sorted(map(str, out))


def ours(df):
    return sorted(str(tuple(r)) for r in df.collect())


def scan(df):
    return find_secrets(df, F.col("source"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))))


def test_whole_table(spark, documents):
    assert ours(queries.op13_secret_scan(spark, SF)) == plain([(r.doc_id, r.text, r.source, r.lang) for r in documents.collect()])


def test_odd_rows(spark):
    long = "é🙂 " + "token=a " * 700 + "x" * 50_000 + f" secret: '{'Ab1' * 9}' " + "0123456789abcdef" * 3000
    rows = [
        (1, None, "a", "en"), (2, "", "a", None), (3, f"漢🙂 PassWord = \"{LIVE}\" and again {LIVE}", None, "en"), (4, f"alone {LIVE}, AKIA{'B7' * 9} AKIAAKIA12", "a", "en"),
        (5, "token=token:abcdefgh apikey:'short' api_key=\"long-enough.9\" TOKEN  ==x=y=z== ſecret=1234567", "b", "en"), (6, long, "b", "de"), (None, f"key-{LIVE}", "c", "de"),
        (6, long, "b", "de"), (7, "DEADBEEFdeadbeefdeadbeefdeadbeefdeadbeef" + "A" * 30, "c", None),
    ]
    rows += [(100 + k, f"see Zp8{'Kd7Qm2Xw' * 3} and {LIVE[::-1]}{k // 2}x", f"s{k}", "en") for k in range(6)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert ours(scan(df)) == plain(rows)
    assert scan(df.limit(0)).collect() == [] and scan(df).columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied"]


def test_examples_that_all_have_are_told_from_owned_ones(spark):
    rows = [(k, f"api_key = {LIVE}77 and own {LIVE}{k % 7:02d}a", f"s{k}", "en") for k in range(14)]
    found = scan(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    assert all(r.n_copied == 1 and r.n_live == 1 and r.spans.count("token:") == 1 for r in found)
