"""Secret scan with corpus-wide ownership frequency, with DataFrame functions only.

Candidate values are found by pattern in whole texts, then counted over the corpus by distinct owners and repositories:
a value that many owners hold, or that stands in many repositories of one or two, is a copied example; one that a single
owner holds in few repositories and that looks random is a live-looking credential of that owner. Spans count code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import written

#: Kinds in their order, the pattern, and the group and least length that a match must have.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Added by ownership: live-looking values of one owner, and widely copied values.
ADDED = ("live", "copied")
ORDER = [k[0] for k in KINDS] + list(ADDED)
#: Distinct owners, or distinct repositories, from which a value counts as widely copied.
COPIED, COPIED_REPOS = 3, 4
LIVE_CHARS = 16
LIVE_DISTINCT = 8


def _hits(text: Column, kind: tuple) -> Column:
    """(i, gap, match) per match: the code points between it and the match before, and its text; null for no match."""
    _, pattern, _, _ = kind
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.zip_with(F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.char_length(g)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.when(text.rlike(pattern), rows)


def _row_key(c: Column) -> Column:
    """A text for each id that is never null, so that rows without an id join like others."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def ownership(values: DataFrame) -> DataFrame:
    """(hash, owners, repos) from (hash, owner, repo): distinct counts by two aggregations, so that no hot value meets in one task."""
    each = values.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("repo").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("owner").alias("owners"), F.sum("repos").alias("repos"))


def looks_live(value: Column) -> Column:
    """Long, with a digit and a letter, and many different characters."""
    return (F.char_length(value) >= LIVE_CHARS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT)


def secret_spans(docs: DataFrame, owner_col: str, repo: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): a row (id, rid, th) for each document; spans (rid, th, kind, start, end, value_start, value, hash, owners, repos, verdict).

    Null texts count as empty. An owner or repo that is null counts as one of its own, the empty name. Null ids are one id, which ``rid`` names by an empty text. Rows with one id
    and equal text share their spans, found once; th tells texts of one id apart. A match that fails its length is
    dropped after it has taken its place in the text. An empty table gives no rows and no spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    scan = docs.select(
        F.col(id_col).alias("id"), _row_key(F.col(id_col)).alias("rid"), F.xxhash64(text).alias("th"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
        *[_hits(text, k).alias(k[0]) for k in KINDS],
    )
    table = written(scan, "secrets").df
    rows = table.select("id", "rid", "th")
    parts = []
    for kind, pattern, group, least in KINDS:
        hits = table.where(F.col(kind).isNotNull()).dropDuplicates(["rid", "th"]).select("rid", "th", F.posexplode(kind).alias("i", "hit"))
        run = Window.partitionBy("rid", "th").orderBy("i")
        length = F.char_length("hit.match")
        end = F.sum(F.col("hit.gap") + length).over(run)
        value = F.regexp_extract("hit.match", pattern, group)
        spans = hits.select("rid", "th", F.lit(kind).alias("kind"), (end - length).alias("start"), end.alias("end"), value.alias("value")).where(F.char_length("value") >= least)
        parts.append(spans)
    spans = parts[0].unionByName(parts[1]).unionByName(parts[2])
    spans = spans.withColumns({"hash": F.sha2("value", 256), "value_start": F.col("end") - F.char_length("value")})
    # Every row holds what its text holds: owners come from all rows, repeated ones included.
    found = table.where(" or ".join(f"{k[0]} is not null" for k in KINDS)).select("rid", "th", "owner", "repo").distinct()
    held = spans.select("rid", "th", "hash").distinct().join(found, ["rid", "th"])
    counts = ownership(held)
    spans = spans.join(counts, "hash")
    verdict = F.when((F.col("owners") >= COPIED) | (F.col("repos") >= COPIED_REPOS), F.lit("copied")).when((F.col("owners") == 1) & looks_live(F.col("value")), F.lit("live")).otherwise(F.lit("unclear"))
    return rows, spans.withColumn("verdict", verdict)


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ORDER)), kind)


def _joined() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("start"), _rank(F.col("kind")).alias("rank"), F.col("kind"), F.col("end")))), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, owner_col: str, repo: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts of the base kinds, the digest of the base spans, all spans, counts by verdict, and the most owners and repositories that hold one of its values."""
    rows, spans = secret_spans(docs, owner_col, repo, id_col, text_col)
    spans = written(spans.select("rid", "th", "kind", "start", "end", "value_start", "verdict", "owners", "repos"), "spans").df
    added = spans.where(F.col("verdict").isin(*ADDED)).select("rid", "th", F.col("verdict").alias("kind"), F.col("value_start").alias("start"), "end").distinct()
    base = spans.groupBy("rid", "th").agg(F.max("owners").alias("most_owners"), F.max("repos").alias("most_repos"), *[F.count_if(F.col("kind") == k[0]).alias(f"n_{k[0]}") for k in KINDS], F.sha2(_joined(), 256).alias("base_sha256"), *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ADDED])
    every = spans.select("rid", "th", "kind", "start", "end").unionByName(added).groupBy("rid", "th").agg(_joined().alias("spans"))
    out = base.join(every, ["rid", "th"])
    zero = F.lit(0).cast("long")
    got = rows.join(out, ["rid", "th"], "left")
    return got.select(
        F.col("id").alias(id_col), *[F.coalesce(f"n_{k[0]}", zero).alias(f"n_{k[0]}") for k in KINDS], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        *[F.coalesce(f"n_{v}", zero).alias(f"n_{v}") for v in ADDED], F.coalesce("most_owners", zero).alias("most_owners"), F.coalesce("most_repos", zero).alias("most_repos"),
    )
