"""Secret scan: places of credentials in texts, told apart by how many owners and repositories of the corpus have the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Kinds in order: pattern, group with the value, least length of the value. All take the leftmost match first. Runs of a class
#: alone may state their length in the pattern; an assignment may not, as its value can begin another one.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "token": (r"[A-Za-z0-9_-]{20,}", 0, 20),
}
#: The first kinds are always reported; a token only if it looks live and is no common example.
BASE = 3
#: Parts of values that people write where a credential would stand.
PLACEHOLDERS = "example|sample|dummy|placeholder|changeme|your|xxxx|0000|123456|abcdef"
#: Owners and repositories that may have a value which is not a widely copied example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 20
_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Sums of an array up to each entry. Blocks are summed first: appending entry by entry would copy a long array at each."""
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("sums"))
    add = lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.array_append(acc["sums"], acc["total"] + x).alias("sums"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    summed = F.transform(blocks, lambda block: F.aggregate(block, start, add, lambda acc: acc["sums"]))
    outer = F.struct(F.lit(0).alias("total"), F.array().cast("array<array<int>>").alias("sums"))
    join = lambda acc, sums: F.struct((acc["total"] + F.element_at(sums, -1)).alias("total"), F.array_append(acc["sums"], F.transform(sums, lambda s: s + acc["total"])).alias("sums"))
    return F.flatten(F.aggregate(summed, outer, join, lambda acc: acc["sums"]))


def looks_live(value: Column) -> Column:
    """At least eight different characters, a digit, and no part that stands for a value."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= 8) & value.rlike("[0-9]") & ~F.lower(value).rlike(PLACEHOLDERS)


def candidates(texts: DataFrame) -> DataFrame:
    """texts (with text) plus spans: (start, rank, end, digest, live) of each match that is long enough, by start, then kind.

    A text is split at the matches; the lengths of pieces and matches before one, in code points, are its place. Only SHA-256 of
    a value goes on.
    """
    kept, text = [f"`{c}`" for c in texts.columns], F.col("text")
    rows = texts
    for kind, (pattern, _, _) in KINDS.items():
        rows = rows.withColumn(f"{kind}_whole", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    for kind, (pattern, group, _) in KINDS.items():
        some = F.size(f"{kind}_whole") > 0
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(f"{kind}_whole"))
        ends = _running(F.zip_with(gaps, F.col(f"{kind}_whole"), lambda g, m: F.length(g) + F.length(m)))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.col(f"{kind}_whole")
        rows = rows.withColumn(f"{kind}_places", F.when(some, F.arrays_zip(F.col(f"{kind}_whole").alias("whole"), values.alias("value"), ends.alias("end"))))
    parts = [F.coalesce(_spans(kind, rank), F.array().cast("array<struct<start:int,rank:int,end:int,digest:binary,live:boolean>>")) for rank, kind in enumerate(KINDS)]
    return rows.select(*kept, F.array_sort(F.concat(*parts)).alias("spans"))


def _spans(kind: str, rank: int) -> Column:
    least = KINDS[kind][2]

    def fits(m: Column) -> Column:
        mixed = m["value"].rlike("[A-Z]") & m["value"].rlike("[a-z]") if kind == "token" else F.lit(True)
        return (F.length(m["value"]) >= least) & mixed

    def span(m: Column) -> Column:
        start, digest = m["end"] - F.length(m["whole"]), F.unhex(F.sha2(m["value"], 256))
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), digest.alias("digest"), looks_live(m["value"]).alias("live"))

    return F.transform(F.filter(f"{kind}_places", fits), span)


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(found: DataFrame) -> DataFrame:
    """(digest, owners, repositories) of each value: how many different ones have it. Pairs are counted once before they meet
    by value, so a value that all have costs each task a row for each owner."""
    return found.select("owner", "repository", F.explode("spans.digest").alias("digest")).groupBy("digest").agg(
        F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories")
    )


def find_secrets(
    docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES
) -> DataFrame:
    """One row for each row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    Matches of the first three kinds are always in spans. A long run of mixed letters and digits (`token`) is added if it
    looks live, at most most_owners owners and most_repositories repositories of the whole corpus have its value, and no
    other span of the text has the same value. n_live counts the spans written that look live and are as rare;
    n_copied those whose value more owners or repositories have. Values are compared as SHA-256.

    Texts are read once, and only places and digests move. Equal texts have equal places, so that verdicts are joined
    for each distinct text; the joins' sides are written tables, whose hot values and texts adaptive execution splits.

    Null texts are empty; null owners and repositories are one owner or repository of their own; null ids and repeated
    rows each get their row; equal spans of two kinds both count; other columns are ignored; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"), text.alias("text"))
    key = F.when(F.size("spans") > 0, F.unhex(F.sha2("text", 256)))
    found = stored(candidates(rows).select("id", "owner", "repository", key.alias("text_digest"), "spans"), "secret-places")
    counts = stored(ownership(found), "secret-owners")
    copied = (F.col("owners") > most_owners) | (F.col("repositories") > most_repositories)

    places = found.select("text_digest", F.explode("spans").alias("s")).select("text_digest", "s.*").distinct()
    values = places.groupBy("text_digest", "digest").agg(F.collect_list(F.struct("start", "rank", "end", "live")).alias("places"), F.min("rank").alias("first"))
    told = values.join(counts.select("digest", copied.alias("copied")), "digest").select("text_digest", "first", "copied", F.explode("places").alias("p"))
    shown = told.where((F.col("p.rank") < BASE) | (F.col("p.live") & ~F.col("copied") & (F.col("first") == BASE)))
    per_text = shown.groupBy("text_digest").agg(
        F.array_sort(F.collect_list(F.struct("p.start", "p.rank", "p.end"))).alias("shown"),
        F.count_if(F.col("p.live") & ~F.col("copied")).alias("n_live"),
        F.count_if("copied").alias("n_copied"),
    )
    per_text = stored(per_text.select("text_digest", written(F.col("shown")).alias("written"), "n_live", "n_copied"), "secret-texts")

    base = F.filter("spans", lambda s: s["rank"] < BASE)
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    own = ["id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(list(KINDS)[:BASE])], F.sha2(written(base), 256).alias("base_sha256")]
    none = found.where(F.size("spans") == 0).select(*own, F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    some = found.where(F.size("spans") > 0).join(per_text, "text_digest", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    some = some.select(*own, F.coalesce("written", F.lit("")).alias("spans"), zero("n_live"), zero("n_copied"))
    return none.unionByName(some).withColumnRenamed("id", id_col)
