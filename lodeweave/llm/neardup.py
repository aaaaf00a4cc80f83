"""Pairs of near-duplicate texts: inverted lists over rare shingles, Bayesian pruning on MinHash bits, exact check.

1. Texts that are the same are one representative; what follows runs on representatives.
2. Shingles (runs of words) are ordered from rare to frequent.  Two sets that are similar enough must share one of
   the first shingles of each (prefix filter), so the inverted lists hold these only.  Rarity comes from a table of
   counts of fixed size, which covers all texts; shingles that stand in one text only can't join a pair.
3. A pair of one list is dropped if sizes or places rule it out, or if, after 32 and 64 one-bit MinHash values in
   the lists and 96 and 128 on the pairs left, the posterior probability that its similarity reaches the threshold is below ``tolerance``.
4. The rest is checked exactly on the whole shingle sets; pairs then go back to all copies of both texts.

Defined cases: null and blank texts, and texts under the least number of words, are in no pair; a text with fewer
words than a shingle has its whole words, or its signs if it has no word, as its one shingle; rows with a null id
are left out; the same id delivered twice counts once; copies are pairs of similarity 1; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_batches, stored

SHINGLE, THRESHOLD, TOLERANCE = 3, 0.6, 1e-5
SLOTS = 1 << 28  # one bit each: whether more than one text holds a shingle of the slot
COARSE = 1 << 22  # counters of shingle frequency; both tables have this size whatever the input
ID_SLOTS = 1 << 21  # slots of ids by which rows of interest are picked before they are shuffled; at most so many are broadcast
MEMBERS = 2000  # copies of one text that one task holds
LIST = 2048  # postings from which on a list is met in blocks, so that no task meets a whole long list
BLOCKS = 32  # of a list at most
TASK_BYTES = 64 << 20  # of postings that one task of the self-join reads
WIDTH = 5  # bytes kept of each shingle hash: 2^40 values
_MARKS = ".,;:!?\"'()[]{}«»“”„‘’‚—–-…·•*_/\\|<>#+=~`´^°%&@$€£§"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SPACE = re.compile("[ \t\n\r\f\v]+")
_A = (np.random.default_rng(11).integers(1, 2**31, 128, dtype=np.int64) * 2 + 1).astype(np.uint32)
_B = np.random.default_rng(12).integers(0, 2**32, 128, dtype=np.int64).astype(np.uint32)


def words(text: str) -> list[str]:
    """Pieces between spaces, tabs and line breaks, in lower case, without other signs at both ends."""
    low = text.lower()
    out = []
    for p in low.split() if low.isascii() else _SPACE.split(low):
        p = p.strip(_MARKS)
        if p and not (p[0].isalnum() and p[-1].isalnum()):
            p = _EDGE.sub("", p)
        if p:
            out.append(p)
    return out


class Shingler:
    """Distinct shingle hashes (40 bits) and MinHash bits of texts; word hashes are kept between calls."""

    def __init__(self, shingle: int = SHINGLE):
        self.k, self.memo = shingle, {}

    def hashes(self, ws: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        try:
            codes = [memo[w] for w in ws]
        except KeyError:
            for w in ws:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            codes = [memo[w] for w in ws]
        h = np.array(codes, np.uint64)
        n = len(h) - self.k + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(self.k):
            out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out >> np.uint64(64 - 8 * WIDTH))

    @staticmethod
    def whole(ws: list[str]) -> np.ndarray:
        """The one shingle of a text with fewer words than a shingle has."""
        return np.array([xxhash.xxh3_64_intdigest("\n".join(ws)) >> (64 - 8 * WIDTH)], np.uint64)

    @staticmethod
    def bits(sets: list[np.ndarray]) -> np.ndarray:
        """(texts, 2) words of 64 bits: one bit of each of 128 MinHash values."""
        flat = np.concatenate(sets)
        x = (flat ^ (flat >> np.uint64(23))).astype(np.uint32)
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
        out = np.zeros((len(sets), 2), np.uint64)
        for i in range(128):
            least = np.minimum.reduceat(x * _A[i] + _B[i], starts)
            bit = ((least * np.uint32(0xC2B2AE35)) >> np.uint32(17)) & np.uint32(1)
            out[:, i // 64] |= bit.astype(np.uint64) << np.uint64(i % 64)
        return out


def pack(s: np.ndarray) -> bytes:
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpack(b: bytes) -> np.ndarray:
    raw = np.zeros((len(b) // WIDTH, 8), np.uint8)
    raw[:, :WIDTH] = np.frombuffer(b, np.uint8).reshape(-1, WIDTH)
    return raw.reshape(-1).view("<u8")


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest matches among n one-bit MinHash values with which P(similarity >= threshold) is tolerance or more.

    A bit matches with probability (1 + J) / 2; J is uniform beforehand.
    """
    j = (np.arange(2000) + 0.5) / 2000
    c = (1 + j) / 2
    for m in range(n + 1):
        like = m * np.log(c) + (n - m) * np.log1p(-c)
        p = np.exp(like - like.max())
        if p[j >= threshold].sum() / p.sum() >= tolerance:
            return m
    return n


def _slot(c) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(ID_SLOTS)).cast("int").alias("slot")


def _copy() -> Column:
    return F.unhex(F.md5("text")).alias("copy")


def _representatives(texts: DataFrame, least_words: dict[str, int], shingle: int) -> DataFrame:
    """(rid, field_name, rep, several, n, sig0, sig1, sh): one row for each different text that is long enough.

    rid tells representatives of all fields apart.

    Only rows whose text stands in several rows, and those that share an id slot with them, are shuffled to be
    grouped; the number of slots is bounded.  several: more than one id has the text.
    """
    again = texts.select("field_name", _copy(), "id").groupBy("field_name", "copy").agg(F.count("*").alias("n"), F.collect_set(_slot(F.col("id"))).alias("slots")).where("n > 1")
    slots = again.select(F.explode("slots").alias("slot")).distinct()
    keyed = texts.withColumn("slot", _slot(F.col("id")))
    alone = keyed.join(F.broadcast(slots), "slot", "left_anti").select("field_name", F.col("id").alias("rep"), F.lit(False).alias("several"), "text")
    shared = keyed.join(F.broadcast(slots), "slot", "left_semi")
    once = shared.groupBy("field_name", _copy()).agg(F.min("id").alias("rep"), (F.min("id") != F.max("id")).alias("several"), F.first("text").alias("text"))
    held: dict[str, Shingler] = {}
    place = {f: k for k, f in enumerate(sorted(least_words))}

    def run(fields, reps, several, bodies):
        maker = held.setdefault("it", Shingler(shingle))
        out = {"rid": [], "field_name": [], "rep": [], "several": [], "n": [], "sig0": [], "sig1": [], "sh": []}
        sets = []
        for f, r, m, t in zip(fields, reps, several, bodies):
            ws = words(t)
            if len(ws) >= least_words[f]:
                s = maker.hashes(ws) if len(ws) >= shingle else maker.whole(ws or [t])
                out["rid"].append(r * len(place) + place[f])
                out["field_name"].append(f)
                out["rep"].append(r)
                out["several"].append(m)
                out["n"].append(len(s))
                out["sh"].append(pack(s))
                sets.append(s)
        if not sets:
            return None
        sig = Shingler.bits(sets).view(np.int64)
        out["sig0"], out["sig1"] = sig[:, 0].tolist(), sig[:, 1].tolist()
        return out

    both = alone.unionByName(once.select("field_name", "rep", "several", "text"))
    return map_batches(both, "rid bigint, field_name string, rep bigint, several boolean, n int, sig0 bigint, sig1 bigint, sh binary", run)


def _frequency(reps: DataFrame, slots: int, coarse: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, counts): whether more than one text holds a shingle of a slot, and how often its coarse slot is held.

    Counted in blocks of slots; every task hands on each slot once a batch.
    """
    blocks = 64
    span, fold = slots // blocks, slots // coarse

    def count(batches):
        for b in batches:
            flat = np.concatenate([unpack(x) for x in b.column(0).to_pylist()] or [np.zeros(0, np.uint64)])
            at, n = np.unique((flat % np.uint64(slots)).astype(np.uint32), return_counts=True)
            n = np.minimum(n, 255).astype(np.uint8)
            cuts = np.searchsorted(at, np.arange(blocks + 1, dtype=np.uint64) * span)
            parts = [(k, slice(cuts[k], cuts[k + 1])) for k in range(blocks) if cuts[k] < cuts[k + 1]]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in parts], pa.int32()), pa.array([(at[x] - np.uint32(k * span)).astype(np.uint32).tobytes() for k, x in parts], pa.binary()), pa.array([n[x].tobytes() for _, x in parts], pa.binary())],
                    names=["block", "at", "n"],
                )

    def merge(batches):
        block, total = None, None

        def done():
            bits = np.packbits(total > 1).tobytes()
            counts = np.minimum(total.reshape(-1, fold).sum(1), 65535).astype(np.uint16).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits], pa.binary()), pa.array([counts], pa.binary())], names=["block", "bits", "counts"])

        for b in batches:
            for k, at, n in zip(*(c.to_pylist() for c in b.columns)):
                if k != block:
                    if block is not None:
                        yield done()
                    block, total = k, np.zeros(span, np.uint32)
                total[np.frombuffer(at, np.uint32)] += np.frombuffer(n, np.uint8)
        if block is not None:
            yield done()

    parts = reps.select("sh").mapInArrow(count, "block int, at binary, n binary").repartition("block").sortWithinPartitions("block")
    bits, counts = np.zeros(slots // 8, np.uint8), np.zeros(coarse, np.uint16)
    for r in parts.mapInArrow(merge, "block int, bits binary, counts binary").toLocalIterator():  # bounded by slots and coarse
        bits[r[0] * span // 8 : (r[0] + 1) * span // 8] = np.frombuffer(r[1], np.uint8)
        counts[r[0] * span // fold : (r[0] + 1) * span // fold] = np.frombuffer(r[2], np.uint16)
    return bits, counts


def _postings(reps: DataFrame, often: tuple[np.ndarray, np.ndarray], threshold: float, least: int = LIST) -> DataFrame:
    """(key, rid, at, sig0, pair): the first shingles of each text, rare ones first; at: size and place in one number.

    A list that may be long, by the counters, is parted in B blocks by text: a posting of block i stands in the pairs of
    blocks (i, 0..B-1), so that every two postings of a list meet in one pair: pair is 0 for lists of one block, else it
    holds the two blocks, the smaller one first, and whether this posting is of the first one.
    """
    box = reps.sparkSession.sparkContext.broadcast(often)
    schema = pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("sig0", pa.int64()), ("pair", pa.int32())])

    def run(batches):
        bits, count = box.value
        slots = np.uint64(len(bits) * 8)
        fold = np.uint64(len(bits) * 8 // len(count))
        for b in batches:
            cols = b.to_pydict()
            keys, owner, places, counts = [], [], [], []
            for i, (f, sh) in enumerate(zip(cols["field_name"], cols["sh"])):
                s = unpack(sh)
                at = s % slots
                c = count[(at // fold).astype(np.int64)]
                n = len(s)
                order = np.lexsort((s, c))[: n - math.ceil(threshold * n - 1e-9) + 1]
                at = at[order]
                keep = np.flatnonzero((bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1)
                if len(keep):
                    salt = np.uint64(xxhash.xxh3_64_intdigest(f) >> 24)  # 40 bits, as the shingles have
                    keys.append((s[order[keep]] ^ salt).view(np.int64))
                    owner.append(np.full(len(keep), i))
                    places.append(keep + (n << 32))
                    counts.append(c[order[keep]])
            if keys:
                own = np.concatenate(owner)
                key, place = np.concatenate(keys), np.concatenate(places).astype(np.int64)
                rid = np.array(cols["rid"], np.int64)[own]
                parts = np.minimum(BLOCKS, -(-np.concatenate(counts).astype(np.int64) // least))
                parts[parts < 1] = 1
                mine = (rid * 0x9E3779B1 >> 7) % parts
                row = np.repeat(np.arange(len(key)), parts)
                other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                low, high = np.minimum(mine[row], other), np.maximum(mine[row], other)
                pair = np.where(parts[row] > 1, 1 + 2 * (low * BLOCKS + high), 0) + ((low != high) & (mine[row] == low))
                take = lambda name: pa.array(np.array(cols[name], np.int64)[own[row]])
                yield pa.RecordBatch.from_arrays([pa.array(key[row]), take("rid"), pa.array(place[row]), take("sig0"), pa.array(pair.astype(np.int32))], schema=schema)

    return reps.select("rid", "field_name", "sh", "sig0").mapInArrow(run, "key bigint, rid bigint, at bigint, sig0 bigint, pair int")


def _most_apart(n: int, threshold: float, tolerance: float) -> int:
    return n - least_matches(n, threshold, tolerance)


def similar_representatives(texts: DataFrame, least_words: dict[str, int], shingle: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, slots: int = SLOTS, coarse: int = COARSE, least: int = LIST) -> tuple[DataFrame, DataFrame]:
    """(representatives, pairs(field_name, rep_a, rep_b, similarity)) of different texts(field_name, id, text).

    Pairs stay within a field: the keys of the lists are salted with its name.
    """
    texts = texts.where("id is not null and text is not null")
    reps = stored(_representatives(texts, least_words, shingle), "shingles")
    posts = _postings(reps, _frequency(reps, slots, coarse), threshold, least)
    # as many tasks as the postings need: they are at most so many shingles, of some 40 bytes each
    total = reps.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * (1 - threshold) * 40 / TASK_BYTES))
    posts = posts.withColumn("met", F.floor((F.col("pair") - F.when(F.col("pair") > 0, 1).otherwise(0)) / 2).cast("int")).repartition(tasks, "key", "met")
    # Both sides are the same rows, so that one exchange serves them; the places a smaller text needs are fewer, which
    # the comparison of places below sees to.
    a = posts.select("key", "met", *(F.col(c).alias(f"a_{c}") for c in ("rid", "at", "sig0", "pair")))
    b = posts.select("key", "met", *(F.col(c).alias(f"b_{c}") for c in ("rid", "at", "sig0", "pair")))
    size = lambda c: F.shiftright(c, 32)
    left = lambda c: size(c) - F.col(c).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    an, bn = size("a_at"), size("b_at")
    order = (an < bn) | ((an == bn) & (F.col("a_rid") < F.col("b_rid")))
    places = F.least(left("a_at"), left("b_at")) >= (an + bn) * (threshold / (1 + threshold)) - 1e-9
    # The first 64 MinHash values travel with the postings, the others are compared on what is left.
    apart = F.col("a_sig0").bitwiseXOR(F.col("b_sig0"))
    low = F.lit(0xFFFFFFFF).cast("bigint")
    close = (F.bit_count(apart.bitwiseAND(low)) <= _most_apart(32, threshold, tolerance)) & (F.bit_count(apart) <= _most_apart(64, threshold, tolerance))
    # of two different blocks only postings of one and the other meet
    blocks = (F.col("met") == 0) | ((F.floor(F.col("met") / BLOCKS) == F.col("met") % BLOCKS) | (F.col("a_pair") != F.col("b_pair")))
    met = a.join(b, ["key", "met"]).where(blocks & order & (an >= bn * threshold - 1e-9) & places & close).select("a_rid", "b_rid").distinct()
    bits = lambda side: reps.select(F.col("rid").alias(f"{side}_rid"), F.col("sig0").alias(f"{side}_0"), F.col("sig1").alias(f"{side}_1"))
    more = met.join(bits("a"), "a_rid").join(bits("b"), "b_rid")
    first, second = F.bit_count(F.col("a_0").bitwiseXOR(F.col("b_0"))), F.col("a_1").bitwiseXOR(F.col("b_1"))
    closer = (first + F.bit_count(second.bitwiseAND(low)) <= _most_apart(96, threshold, tolerance)) & (first + F.bit_count(second) <= _most_apart(128, threshold, tolerance))
    candidates = stored(more.where(closer).select("a_rid", "b_rid"), "candidates")
    # Slots of the candidates' ids: their number is bounded, whatever the number of candidates.
    wanted = candidates.select(_slot(F.col("a_rid"))).union(candidates.select(_slot(F.col("b_rid")))).distinct()
    some = reps.select("rid", "rep", "field_name", "sh", _slot(F.col("rid"))).join(F.broadcast(wanted), "slot", "left_semi")
    # both sides read the same columns, so that one exchange serves them
    side = lambda s: some.select(*(F.col(c).alias(f"{s}_{c}") for c in ("rid", "rep", "field_name", "sh")))
    both = candidates.join(side("a"), "a_rid").join(side("b"), "b_rid")

    def check(fields, others, xs, ys, xsh, ysh):
        out = {"field_name": [], "rep_a": [], "rep_b": [], "similarity": []}
        for f, g, x, y, p, q in zip(fields, others, xs, ys, xsh, ysh):
            if f != g:
                continue
            s, t = unpack(p), unpack(q)
            both = len(np.intersect1d(s, t, assume_unique=True))
            if both >= threshold * (len(s) + len(t) - both) - 1e-9:
                for k, v in zip(out, (f, min(x, y), max(x, y), both / (len(s) + len(t) - both))):
                    out[k].append(v)
        return out

    pairs = map_batches(both.select("a_field_name", "b_field_name", "a_rep", "b_rep", "a_sh", "b_sh"), "field_name string, rep_a bigint, rep_b bigint, similarity double", check)
    return reps.drop("sh", "sig0", "sig1"), stored(pairs, "pairs")


def memberships(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(field_name, rep, id) of the rows of representatives whose text several ids have."""
    heads = reps.where("several").select("field_name", "rep")
    slots = heads.select(_slot(F.col("rep"))).distinct()
    rows = texts.select("field_name", _copy(), "id", _slot(F.col("id")))
    head = rows.join(F.broadcast(slots), "slot", "left_semi").withColumnRenamed("id", "rep").join(heads, ["field_name", "rep"], "left_semi").select("field_name", "copy", "rep").distinct()
    return rows.select("field_name", "copy", "id").distinct().join(head, ["field_name", "copy"]).select("field_name", "rep", "id")


def similar_pairs(texts: DataFrame, least_words: dict[str, int], **options) -> DataFrame:
    """(field_name, id_a, id_b) of all pairs of rows, copies included.

    Rows of one text form pairs among themselves if the text is long enough; the output is as large as it must be.
    The copies of a text stand in parts of some MEMBERS rows, and what is joined with them goes to each part, so that
    no task holds all copies of a text.
    """
    reps, pairs = similar_representatives(texts, least_words, **options)
    members = memberships(texts, reps)
    sizes = stored(members.groupBy("field_name", "rep").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")), "sizes")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    members = stored(members.join(sizes, ["field_name", "rep"]).withColumn("part", part), "members")

    def with_members(df: DataFrame, rep: str, name: str) -> DataFrame:
        keys = ["field_name", rep]
        wide = df.join(sizes.withColumnRenamed("rep", rep), keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
        return wide.drop("parts").join(members.select("field_name", F.col("rep").alias(rep), "part", F.col("id").alias(name)), [*keys, "part"], "left").drop("part")

    between = with_members(with_members(pairs, "rep_a", "x"), "rep_b", "y")
    x, y = F.coalesce("x", "rep_a"), F.coalesce("y", "rep_b")
    crossed = between.select("field_name", F.least(x, y).alias("id_a"), F.greatest(x, y).alias("id_b")).where("id_a != id_b")
    same = with_members(members.select("field_name", "rep", F.col("id").alias("id_a")), "rep", "id_b").where("id_a < id_b")
    return crossed.unionByName(same.select("field_name", "id_a", "id_b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(field_name, rep, class_id): connected components by alternating large and small stars, each round written out."""
    edges = pairs.select("field_name", F.col("rep_a").alias("u"), F.col("rep_b").alias("v")).distinct()
    edges = stored(edges, "edges")
    while True:
        both = edges.union(edges.select("field_name", "v", "u"))
        least = both.groupBy("field_name", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, ["field_name", "u"]).where("v > u").select("field_name", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select("field_name", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
        low = down.groupBy("field_name", "u").agg(F.min("v").alias("m"))
        joined = down.join(low, ["field_name", "u"])
        small = joined.select("field_name", F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("field_name", "u", F.col("m").alias("v"))).where("u != v").distinct()
        new = stored(small, "edges")
        if not new.exceptAll(edges).limit(1).count() and not edges.exceptAll(new).limit(1).count():
            break
        edges = new
    stars = new.groupBy("field_name", F.col("u").alias("rep")).agg(F.min("v").alias("class_id"))
    heads = new.select("field_name", F.col("v").alias("rep"), F.col("v").alias("class_id")).distinct()
    return stars.unionByName(heads).groupBy("field_name", "rep").agg(F.min("class_id").alias("class_id"))


def near_duplicate_groups(texts: DataFrame, least_words: dict[str, int], **options) -> DataFrame:
    """(field_name, id, class_id, links) for every row: its class, and how many different texts it is similar to."""
    reps, pairs = similar_representatives(texts, least_words, **options)
    ends = pairs.select("field_name", F.col("rep_a").alias("rep")).union(pairs.select("field_name", F.col("rep_b")))
    links = ends.groupBy("field_name", "rep").agg(F.count("*").alias("links"))
    classes = reps.select("field_name", "rep").distinct().join(components(pairs), ["field_name", "rep"], "left").join(links, ["field_name", "rep"], "left")
    several = memberships(texts, reps)
    rows = texts.select("field_name", "id").distinct().join(several, ["field_name", "id"], "left").select("field_name", "id", F.coalesce("rep", "id").alias("rep"))
    out = rows.join(classes, ["field_name", "rep"], "left")
    return out.select("field_name", "id", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links")).distinct()
