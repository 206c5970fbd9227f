import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from offerlake.llm import bpe, queries, token_counts

from .conftest import SF

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_library_on_random_texts():
    own, theirs = bpe.codec(VOCABULARY, P.PATTERN), library()
    rng = random.Random(1)
    alphabets = ["ab", "aeiou nrst", "%$ \n", "éüßñç ' ", "漢字かな🙂", "0123456789.,", "".join(map(chr, range(32, 127)))]
    for n in range(3000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([1, 3, 8, 20, 60, 400])))
        packed = own.encode(text)
        assert packed == b"".join(i.to_bytes(4, "little") for i in theirs.encode_ordinary(text)), text
        assert own.decode(packed) == text.encode()


def test_backtracking_is_exact_on_random_vocabularies():
    """Small vocabularies of merges make the longest match fail often."""
    rng = random.Random(2)
    for _ in range(200):
        ranks = {bytes([c]): c - 97 for c in range(97, 100)}
        while len(ranks) < 25:
            ranks.setdefault(rng.choice(list(ranks)) + rng.choice(list(ranks)), len(ranks))
        own = bpe.Codec(ranks, r".+")
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
            expected = [ranks[word]] if word in ranks else [ranks[x] for x in own.merged(word)]
            assert own.encode_word(word) == expected


def test_encode_and_decode_odd_rows(odd, empty):
    theirs = library()
    rows = bpe.decode(bpe.encode(odd, VOCABULARY, P.PATTERN), VOCABULARY, P.PATTERN).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in rows:
        ids = theirs.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and bytes(r["decoded"]).decode() == texts[r["doc_id"]]
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids)
    assert bpe.encode(empty, VOCABULARY, P.PATTERN).count() == 0


def test_op3_query(spark, documents):
    theirs = library()
    got = {r["doc_id"]: r for r in queries.op3_byte_bpe(spark, SF).collect()}
    for d in documents.collect():
        ids = theirs.encode_ordinary(d["text"])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest())


def test_op6_query(spark, documents):
    theirs = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in queries.op6_token_counts(spark, SF).collect()}
    for d in documents.collect():
        n = len(theirs.encode(d["text"], add_special_tokens=False))
        assert (got[d["doc_id"]]["n_bytes"], got[d["doc_id"]]["n_tokens"], got[d["doc_id"]]["over_limit"]) == (len(d["text"].encode()), n, n > 512)


def test_cache_is_read_and_appended_to(spark, odd, empty, tmp_path):
    cache, path = str(tmp_path / "cache"), P.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    expected = sorted((r["doc_id"] or -1, len(theirs.encode(r["text"] or "", add_special_tokens=False))) for r in odd.collect())
    for _ in range(2):  # the second run finds all there
        got = token_counts.count_tokens(odd, path, cache)
        assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got.collect()) == expected
        assert spark.read.parquet(cache).count() == odd.fillna("", ["text"]).select("text").distinct().count() - 0
    assert token_counts.count_tokens(empty, path, cache).count() == 0
    # what the cache says holds: a changed count comes back
    changed = spark.read.parquet(cache).selectExpr("content_digest", "tokenizer_digest", "n_tokens + 1000 as n_tokens")
    changed.write.parquet(str(tmp_path / "other"))
    got = token_counts.count_tokens(odd, path, str(tmp_path / "other"))
    assert sorted((r["doc_id"] or -1, r["n_tokens"] - 1000) for r in got.collect()) == expected


def test_sentencepiece_counts(odd, tmp_path):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(odd, path, str(tmp_path / "c"))
    expected = sorted((r["doc_id"] or -1, len(theirs.encode(r["text"] or ""))) for r in odd.collect())
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got.collect()) == expected
