"""The prefix trie against rebuilding every conversation in memory."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from offerlake.llm.prefix_trie import prefix_trie

from .conftest import SF

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    def digest(t):
        return hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[:2], digest(t)))] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(c)
        ends[rebuilt].append(c)
    out = []
    for node, cs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        inner = {n[:-1] for n in members if n}
        out.append((
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(n) == len(node) + 1 for n in under), sum(n not in inner for n in under),
            sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in under if n), hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest(),
        ))
    return sorted(map(str, out))


def ours(df):
    assert df.columns == COLUMNS and {t for _, t in df.dtypes} == {"bigint", "string"}
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def few(spark):
    """Families with and without their first conversation, negative ids, null turns, ties, repeated rows, empty rebuilt ones."""
    rows = []
    for c in [0, 1, 2, 3, 5, 7, 19, -3, -19, -20, -21, 41, 42, 43, 45, 60, 61, 62, 63, 64]:
        for t in range(abs(c) % 5 + (c % 20 == 0) * 3):
            rows.append((c, t, ["user", None, "assistant"][t % 3], f"turn {t} words\tof {c // 40 if t > 1 else 'all'}", 1))
    rows += [(61, None, "user", None, 2), (61, None, "system", "", 2), (62, 1, "user", "turn 1", 3), (62, 1, "user", "turn 1", 3), (None, 1, "user", "nobody's", 3), (100, 0, "a", " \x0b ", 4)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, digest int")


def test_small_families(few):
    rows, df = few
    assert ours(prefix_trie(df)) == plain([r[:4] for r in rows])


def test_tasks_that_hold_few_nodes_give_the_same(few):
    rows, df = few
    assert ours(prefix_trie(df, held=2)) == plain([r[:4] for r in rows])


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert ours(prefix_trie(df)) == plain(map(tuple, df.select("conv_id", "turn", "role", "text").collect()))


def test_common_conversation_and_long_one(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 8000, 20) for t in range(3)] + [(8001, t, "user", "x" * (t % 7)) for t in range(3000)]
    found = prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by_depth = defaultdict(list)
    for r in found:
        by_depth[r.depth].append(r)
    assert by_depth[0][0].n_convs == 401 and by_depth[0][0].n_leaves == 2 and by_depth[0][0].saved_tokens == 399 * 2 * 3
    assert max(by_depth) == 3000 - zlib.crc32(b"8001") % 4 and all(r.saved_tokens == 0 for r in found if r.depth > 3)
    assert [r.ends_sha256 for r in by_depth[3] if r.n_convs == 400] == [hashlib.sha256(",".join(map(str, range(0, 8000, 20))).encode()).hexdigest()]


def test_no_rows(spark):
    assert prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
