"""Filling containers of fixed capacity, by exact-complement hashing on the histogram of lengths.

Lengths in tokens are counted once.  A text longer than the capacity is cut into full pieces and a rest; no other
text is split.  What is planned is the histogram: at most ``capacity`` different lengths with their counts, however
many texts there are.  The plan takes the longest length left, fills the container and closes the gap with one, two
or three lengths that sum to it exactly, found through the index of available lengths; a pattern is used as often as
the counts allow.  Gaps that no sum closes take the best fit.  Texts then get their container from their number
among the texts of their length, which is counted in shards, so that a hot length is not gathered in one task.

Defined cases: null and empty texts are no items; repeated ids are one item each (kept by the row's text); ties
between texts of one length are broken by doc_id; an empty table gives no containers; a capacity under one is an error.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_batches, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_ROWS = 50_000


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of the texts that have any.

    tokenizer: path of a file of base64 tokens and their ranks, which every executor has; if left out, the session's
    setting spark.lodeweave.tokenizer, or TOKENIZER.
    """
    tokenizer = tokenizer or documents.sparkSession.conf.get("spark.lodeweave.tokenizer", TOKENIZER)
    held: dict[str, object] = {}

    def run(ids, texts):
        if "t" not in held:
            import tiktoken

            with open(tokenizer, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            held["t"] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        counts = [len(held["t"].encode_ordinary(x)) for x in texts]
        keep = [k for k, n in enumerate(counts) if n]
        return {"doc_id": [ids[k] for k in keep], "n_tokens": [counts[k] for k in keep]}

    return map_batches(documents.select("doc_id", "text").where("doc_id is not null and text != ''"), "doc_id bigint, n_tokens bigint", run)


class Gaps:
    """Index of the available lengths, by which sums of one, two or three that close a gap exactly are found."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()  # left[length]
        self.cap = len(counts) - 1

    def largest(self, most: int) -> int:
        """The longest available length up to most; 0 if there is none."""
        at = np.flatnonzero(self.left[1 : most + 1])
        return int(at[-1]) + 1 if len(at) else 0

    def pair(self, gap: int) -> tuple[int, ...]:
        """Two available lengths with this sum, the longest first; () if there are none."""
        x = np.arange((gap + 1) // 2, min(gap, self.cap + 1))
        y = gap - x
        ok = (self.left[x] > 0) & (self.left[y] > 0)
        if gap % 2 == 0 and len(x) and ok[0] and self.left[gap // 2] < 2:
            ok[0] = False
        at = np.flatnonzero(ok)
        return (int(x[at[-1]]), int(y[at[-1]])) if len(at) else ()

    def close(self, gap: int) -> tuple[int, ...]:
        """Up to three available lengths that sum to the gap exactly."""
        if gap <= self.cap and self.left[gap] > 0:
            return (gap,)
        got = self.pair(gap)
        if got:
            return got
        most = self.largest(min(gap, self.cap))
        if 3 * most < gap:
            return ()
        for x in range(most, -(-gap // 3) - 1, -1):  # the longest of the three
            if not self.left[x]:
                continue
            self.left[x] -= 1
            got = self.pair(gap - x) if gap > x else ()
            self.left[x] += 1
            if got:
                return (x, *got)
        return ()


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used.  counts[length], up to the capacity."""
    gaps, out = Gaps(counts), []
    cap = gaps.cap
    while True:
        first = gaps.largest(cap)
        if not first:
            return out
        pattern, gap = [first], cap - first
        gaps.left[first] -= 1
        while gap:
            rest = gaps.close(gap)
            if rest:
                pattern += rest
                for x in rest:
                    gaps.left[x] -= 1
                break
            best = gaps.largest(gap)
            if not best:
                break
            pattern.append(best)
            gaps.left[best] -= 1
            gap -= best
        used = np.bincount(pattern)
        at = np.flatnonzero(used)
        more = int((gaps.left[at] // used[at]).min())
        gaps.left[at] -= used[at] * more
        out.append((tuple(sorted(pattern, reverse=True)), more + 1))


class Assignment:
    """For each length: from which number on, into which containers, how many in each."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], cap: int):
        rows: dict[int, list[tuple[int, int, int]]] = {}
        taken = np.zeros(cap + 1, np.int64)
        base = 0
        for pattern, times in patterns:
            lengths, each = np.unique(pattern, return_counts=True)
            for x, m in zip(lengths.tolist(), each.tolist()):
                rows.setdefault(x, []).append((int(taken[x]), base, m))
                taken[x] += times * m
            base += times
        self.containers = base
        self.rows = {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in rows.items()}

    def containers_of(self, length: np.ndarray, number: np.ndarray) -> np.ndarray:
        out = np.zeros(len(length), np.int64)
        for x in np.unique(length).tolist():
            m = length == x
            start, base, each = self.rows[x]
            k = np.searchsorted(start, number[m], side="right") - 1
            out[m] = base[k] + (number[m] - start[k]) // each[k]
        return out


def pack(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, doc_id, piece_no, n_tokens, container_id) for counts(doc_id, n_tokens), targets(target_id, capacity_tokens)."""
    spark = counts.sparkSession
    caps = {r[0]: r[1] for r in targets.select("target_id", "capacity_tokens").distinct().collect()}
    if any(c is None or c < 1 for c in caps.values()):
        raise ValueError("a capacity must be one token at least")
    if not caps:
        return spark.createDataFrame([], "target_id int, doc_id bigint, piece_no int, n_tokens bigint, container_id bigint")
    cap = F.coalesce(*(F.when(F.col("target_id") == t, F.lit(c)) for t, c in caps.items()))
    each = counts.withColumn("target_id", F.explode(F.array(*map(F.lit, sorted(caps))))).withColumn("cap", cap)
    pieces = each.withColumn("piece_no", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / F.col("cap")).cast("int"))))
    length = F.least("cap", F.col("n_tokens") - F.col("piece_no") * F.col("cap"))
    pieces = pieces.select("target_id", "doc_id", "piece_no", length.alias("length"))
    histogram = pieces.groupBy("target_id", "length").agg(F.count("*").alias("n")).collect()  # one row a length at most
    plans: dict[int, Assignment] = {}
    for t, c in caps.items():
        have = np.zeros(c + 1, np.int64)
        for r in histogram:
            if r[0] == t:
                have[r[1]] = r[2]
        plans[t] = Assignment(plan(have), c)
    box = spark.sparkContext.broadcast(plans)
    shards = max(1, sum(r[2] for r in histogram) // SHARD_ROWS)
    keyed = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    key = ["target_id", "length", "shard"]
    local = keyed.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece_no")) - 1)
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("n"))
    before = Window.partitionBy("target_id", "length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = local.join(offsets, key).select("target_id", "doc_id", "piece_no", "length", (F.col("before") + F.col("k")).alias("number"))

    def assign(ts, ids, nos, lengths, numbers):
        t, x, n = np.array(ts), np.array(lengths, np.int64), np.array(numbers, np.int64)
        where = np.zeros(len(t), np.int64)
        for u in np.unique(t).tolist():
            where[t == u] = box.value[u].containers_of(x[t == u], n[t == u])
        return {"target_id": ts, "doc_id": ids, "piece_no": nos, "n_tokens": lengths, "container_id": where}

    return map_batches(numbered, "target_id int, doc_id bigint, piece_no int, n_tokens bigint, container_id bigint", assign)


def pack_documents(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return pack(stored(token_counts(documents, tokenizer), "lengths"), targets)


def filling(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """Containers used, the least number that could hold the tokens, and the share of unused space, by target."""
    per = packed.groupBy("target_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    joined = per.join(targets.select("target_id", "capacity_tokens"), "target_id")
    return joined.select(
        "target_id",
        "capacity_tokens",
        "tokens",
        "containers",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("unused_share"),
    )
