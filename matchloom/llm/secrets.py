"""Secret scan with corpus-wide ownership frequency.

Each text is searched for credentials (``BASE`` and ``FURTHER`` patterns).  The
hash of every value found is then counted over the whole corpus by distinct
repositories and distinct owners: a value that several owners hold, or that one
owner holds in more than ``max_repos`` repositories, is a widely copied example;
any other that looks random is taken for a live credential of its owner.  Base spans are always reported, with their class;
spans of the further patterns are reported only where they look live.

Values are aggregated by (value, owner, repository) before they are counted by
value, so a value that a third of all documents hold is summed on the map side.

A null text is empty and has no spans; a null owner or repository counts as one
value of its own; repeated rows are reported each, but count once.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import bounded, map_batches, written

# Kinds in reporting order, their patterns, least lengths of what is in the value group.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
FURTHER = {
    "github": (re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), 0, 40),
    "slack": (re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 15),
    "stripe": (re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}"), 0, 24),
    "google": (re.compile(r"AIza[0-9A-Za-z_-]{35}"), 0, 39),
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 30),
    "private_key": (re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----\s+([A-Za-z0-9+/=\s]{32,})"), 1, 32),
}
# A text without any of a kind's strings (small letters) has no match of that kind.
HINTS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "slack": ("xox",),
    "stripe": ("k_live_",),
    "google": ("aiza",),
    "jwt": ("eyj",),
    "private_key": ("-----begin ",),
}
#: Repositories of one owner that may hold a value that is not taken for an example.
MAX_REPOS = 100
#: Every run of hex digits is long enough or no match: long ones are found at once.
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
ORDER = {k: n for n, k in enumerate([*BASE, *FURTHER])}
SPAN = "struct<kind: string, start: int, end: int, value: string, looks_random: boolean>"


def entropy(value: str) -> float:
    """Shannon entropy of a value's characters, in bits."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of a text, by start, then kind."""
    small = text.lower()
    out = []
    for kind, (pattern, group, least) in (*BASE.items(), *FURTHER.items()):
        if kind in HINTS and not any(h in small for h in HINTS[kind]):
            continue
        for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if len(m[group]) >= least:
                out.append((kind, m.start(), m.end(), m[group]))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def listed(found: list) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in found)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """doc_id, text_key (hash of the text), owner, repo, found: the candidates of every row, with the hash of each value."""
    bounded(docs.sparkSession)
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[text_col].cast("string").alias("text"),
        F.xxhash64(docs[text_col].cast("string")).alias("text_key"),
        docs[owner_col].cast("string").alias("owner"),
        docs[repo_col].cast("string").alias("repo"),
    )

    def run(batch: pa.RecordBatch):
        found = [
            [
                {"kind": k, "start": a, "end": b, "value": hashlib.sha256(v.encode("utf-8", "replace")).hexdigest()[:32], "looks_random": entropy(v) >= 2.5}
                for k, a, b, v in spans(text or "")
            ]
            for text in batch.column("text").to_pylist()
        ]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("looks_random", pa.bool_())]))
        yield pa.record_batch([batch.column("doc_id"), batch.column("text_key"), batch.column("owner"), batch.column("repo"), pa.array(found, kind)], names=["doc_id", "text_key", "owner", "repo", "found"])

    return map_batches(rows, run, f"doc_id long, text_key long, owner string, repo string, found array<{SPAN}>")


def secrets(docs: DataFrame, *, max_owners: int = 1, max_repos: int = MAX_REPOS, **columns: str) -> DataFrame:
    """doc_id, text_key and spans array<struct<kind, start, end, value, owners, repos, live>> of every row.

    ``value`` is a hash; ``owners`` and ``repos``: how many hold it, a repository of several owners once; ``live``: at
    most ``max_owners`` owners hold the value, in ``max_repos`` repositories at most, and it looks random.
    """
    rows = written(scan(docs, **columns).withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", "owner", "repo", F.explode("found").alias("s")).select("row", "owner", "repo", "s.*")
    # a null owner or repository is one of its own; a value's holders are summed on the map side, then by (value, holder)
    held = each.select("value", F.xxhash64("owner", F.col("owner").isNull()).alias("owner"), F.xxhash64("repo", F.col("repo").isNull()).alias("repo")).distinct()
    held = held.groupBy("value").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"))
    # the id of a row is unique, so this brings each row's own spans together
    judged = each.join(held, "value").withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos) & F.col("looks_random"))
    judged = judged.where(F.col("kind").isin(list(BASE)) | F.col("live"))
    rank = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in ORDER.items()])
    judged = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end", "value", "owners", "repos", "live"))).alias("spans")
    )
    return rows.select("row", "doc_id", "text_key").join(judged, "row", "left").select("doc_id", "text_key", F.coalesce("spans", F.array()).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op6_secrets, and ``n_live``."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def redact(docs: DataFrame, *, mark: str = "[SECRET]", max_owners: int = 1, max_repos: int = MAX_REPOS, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The rows of ``docs`` with every live credential replaced by ``mark``; widely copied examples stay.

    Spans that overlap are replaced together.
    """
    found = secrets(docs, max_owners=max_owners, max_repos=max_repos, id_col=id_col, text_col=text_col, **columns)
    live = found.select("doc_id", "text_key", F.filter("spans", lambda s: s["live"]).alias("live")).where(F.size("live") > 0)
    live = live.select("doc_id", "text_key", F.transform("live", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))).alias("live")).distinct()
    # the row as one column, so that no name of it can clash
    text = docs[text_col].cast("string")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    rows = rows.join(live, rows["id"].eqNullSafe(live["doc_id"]) & (rows["key"] == live["text_key"]), "left")
    # spans that overlap as one: a span opens where it begins at or after the largest end before it
    spans = F.array_sort("live")
    start = F.struct(F.array().cast("array<struct<a: int, b: int>>").alias("done"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))

    def merge(acc, s):
        opens = acc["b"].isNull() | (s["a"] >= acc["b"])
        done = F.when(opens & acc["b"].isNotNull(), F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(opens, s["a"]).otherwise(acc["a"]).alias("a"), F.when(opens, s["b"]).otherwise(F.greatest(acc["b"], s["b"])).alias("b"))

    merged = F.aggregate(spans, start, merge, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b")))))
    rows = rows.withColumn("merged", F.when(F.col("live").isNotNull(), merged))
    # each stretch between two marks is cut from the text once
    end = F.transform("merged", lambda s, k: F.when(k == 0, F.lit(0)).otherwise(F.get("merged", k - 1)["b"]))
    between = F.zip_with("merged", end, lambda s, upto: F.substr(F.col("text"), upto + 1, s["a"] - upto))
    blotted = F.concat(F.array_join(between, mark), F.lit(mark), F.substr(F.col("text"), F.element_at("merged", -1)["b"] + 1))
    new = F.when(F.col("live").isNull(), F.col("text")).otherwise(blotted)
    return rows.select(*[(new if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
