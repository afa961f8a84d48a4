"""SimHash near-duplicates through anchor points of a covering code.

The 64 bits are cut into blocks. Two fingerprints within ``distance`` bits differ in at most distance // blocks bits in some
block. Each block's values are covered by a Hamming code (every value lies within its covering radius of one
codeword, its home) times the bits left over. A fingerprint is sent home once per block, and as a
replica to every anchor that can be home to a value within the block's threshold of its own; so any linked pair
meets where one of the two is at home. Fingerprints are compared per anchor, and an anchor passes on
only a spanning forest of the links it finds, which keeps every component whole without listing all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, SEED, DISTANCE = 4, 42, 4
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLANKS = bytes([*range(9, 14), 32])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bit b is set if over half of the shingles' XXH64 (seed 42) have it; 0 without words; a short text is one shingle."""
    return majority(shingle_hashes(text, words))


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: bit b is set if over half of them have it."""
    return int(np.packbits(_bit_counts(h) * 2 > len(h), bitorder="little").view(np.uint64)[0]) if len(h) else 0


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle in turn."""
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[words - 1 :].tolist() if len(parts) >= words else [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts, stops)], np.uint64, n)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many values have each of the 64 bits set, bit 0 first."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(h), 255 * 32):
        part = h[lo : lo + 255 * 32]
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):  # sums of up to 255 ones fit in a byte
            counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return counts


class Cover:
    """A Hamming code of 2**r - 1 bits on a block of ``width`` bits; the bits over it are left as they are."""

    def __init__(self, width: int, flips: int):
        self.r = (width + 1).bit_length() - 1
        self.n = (1 << self.r) - 1
        self.width = width
        masks = [0] + [sum(1 << b for b in c) for k in range(1, flips + 1) for c in combinations(range(width), k)]
        self.masks = np.array(masks, np.uint64)

    def home(self, v: np.ndarray) -> np.ndarray:
        """The anchor of each value: the codeword at its syndrome, one bit away at most, and the free bits."""
        syndrome = np.zeros(v.shape, np.uint64)
        for b in range(self.n):
            syndrome ^= np.where((v >> np.uint64(b)) & np.uint64(1) == 1, np.uint64(b + 1), np.uint64(0))
        return v ^ np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))

    def reach(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor): for each value, the distinct homes of all values within the block's threshold."""
        anchors = np.sort(self.home(v[:, None] ^ self.masks[None, :]), axis=1)
        fresh = np.ones(anchors.shape, bool)
        fresh[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
        rows, cols = np.nonzero(fresh)
        return rows, anchors[rows, cols]


@cache
def covers(blocks: int, distance: int = DISTANCE) -> list[tuple[int, Cover]]:
    """(low bit, code) of each block."""
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    return [(sum(widths[:i]), Cover(w, distance // blocks)) for i, w in enumerate(widths)]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a-b: (node, least node of its component), by pointer jumping."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    odd = root != np.arange(len(nodes))
    return nodes[odd], nodes[root[odd]]


def _anchor_rows(batches: Iterator[pa.RecordBatch], blocks: int, schema: pa.Schema, distance: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = b.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(f), 4096):
            part = f[at : at + 4096]
            for i, (low, code) in enumerate(covers(blocks, distance)):
                v = (part >> np.uint64(low)) & np.uint64((1 << code.width) - 1)
                tag = np.uint64(i << 32)
                home = code.home(v)
                rows, anchors = code.reach(v)
                away = anchors != home[rows]
                rows, anchors = rows[away], anchors[away]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((home, anchors)).astype(np.uint64).view(np.int64) | np.int64(tag)),
                        pa.array(np.concatenate((np.ones(len(part), bool), np.zeros(len(rows), bool)))),
                        pa.array(np.concatenate((part, part[rows])).view(np.int64)),
                    ],
                    schema=schema,
                )


def _compare(homes: np.ndarray, others: np.ndarray, distance: int, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links between the homes, and between homes and others, in pieces of about ``step`` comparisons."""
    a, b = [], []
    all_ = np.concatenate((homes, others))
    rows = max(1, step // max(1, len(all_)))
    for lo in range(0, len(homes), rows):
        part = homes[lo : lo + rows]
        x, y = np.nonzero(np.bitwise_count(part[:, None] ^ all_[None, :]) <= distance)
        keep = part[x] != all_[y]
        if keep.any():
            u, v = _forest(part[x[keep]], all_[y[keep]])
            a.append(u)
            b.append(v)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int | None = None, hot: int = 100_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column f, long) that join all within ``distance`` bits, directly or through others.

    Three blocks serve up to 50 million fingerprints; beyond that, two larger blocks give finer anchors for more
    replicas. An anchor that is home to over ``hot`` is split: its homes are dealt to shares, and its other
    fingerprints go to every share. There are few such anchors: each takes ``hot`` of a block's fingerprints.
    """
    spark = prints.sparkSession
    blocks = blocks or (3 if prints.count() <= 50_000_000 else 2)
    ddl = "anchor long, home boolean, f long"
    schema = common.arrow_type(ddl)
    placed = prints.select("f").mapInArrow(common.lean(lambda it: _anchor_rows(it, blocks, schema, distance)), ddl)
    counted = common.arrow_type("anchor long, n long")
    homes = prints.select("f").mapInArrow(common.lean(lambda it: _home_counts(it, blocks, counted, distance)), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    crowded = common.materialize(homes.where(F.col("n") > hot).select("anchor", F.ceil(F.col("n") / hot).cast("int").alias("shares")), "crowded")
    if crowded.count() <= common.BROADCAST_ROWS:
        crowded = F.broadcast(crowded)
    shares = F.coalesce(F.col("shares"), F.lit(1))
    at_home = F.col("home") & (F.pmod(F.xxhash64("f"), shares) == F.col("share"))
    spread = placed.join(crowded, "anchor", "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    dealt = spread.select("anchor", "share", at_home.alias("home"), "f")
    out = common.arrow_type("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(parts: list, homes: list) -> pa.RecordBatch:
            f, h = np.concatenate(parts), np.concatenate(homes)
            u, v = _compare(f[h], f[~h], distance)
            u, v = _forest(u, v) if len(u) else (u, v)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=out)

        last, parts, own = None, [], []
        for b in batches:
            keys = np.stack((b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)))
            home, f = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy().view(np.uint64)
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1 if b.num_rows else []
            us, vs = [], []
            for s, e in zip([0, *edges], [*edges, b.num_rows]):
                if e <= s:
                    continue
                key = (int(keys[0, s]), int(keys[1, s]))
                if key != last and parts:
                    if sum(map(len, parts)) > 1:
                        r = close(parts, own)
                        us.append(r.column(0)), vs.append(r.column(1))
                    parts, own = [], []
                last = key
                parts.append(f[s:e])
                own.append(home[s:e])
            if us:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(us), pa.concat_arrays(vs)], schema=out)
        if parts and sum(map(len, parts)) > 1:
            yield close(parts, own)

    ordered = dealt.repartition(common.shuffle_partitions(spark), "anchor", "share").sortWithinPartitions("anchor", "share")
    return ordered.select("anchor", "share", "home", "f").mapInArrow(common.lean(run), "a long, b long")


def _home_counts(batches: Iterator[pa.RecordBatch], blocks: int, schema: pa.Schema, distance: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints at home at each anchor, combined per batch."""
    for b in batches:
        f = b.column(0).to_numpy().view(np.uint64)
        for i, (low, code) in enumerate(covers(blocks, distance)):
            home = code.home((f >> np.uint64(low)) & np.uint64((1 << code.width) - 1))
            anchor, n = np.unique(home.view(np.int64) | np.int64(i << 32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n.astype(np.int64))], schema=schema)


def fingerprints(docs: DataFrame, key: str, text: str, carry: list[str] | None = None) -> DataFrame:
    """(key, *carry, f): the fingerprint of each row's whole text, as a signed long. A null text has no words."""
    names = [key, *(carry or [])]
    ddl = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names) + ", f long"
    schema = common.arrow_type(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                f = np.array([fingerprint(t) for t in part.column(len(names)).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(f.view(np.int64))], schema=schema)

    common.ship(docs.sparkSession)
    return docs.select(*names, text).mapInArrow(common.lean(run), ddl)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, carry: list[str] | None = None) -> DataFrame:
    """(key, *carry, f, root, component_id): component_id is the least key reachable over links of at most ``distance`` bits.

    One row per input row; root is the least fingerprint of the component. Rows without words share fingerprint zero
    and link like any other. Null keys are in their component but never its id, unless it has no other.
    """
    names = [key, *(carry or [])]
    marked = common.materialize(fingerprints(docs, key, text, carry), "fingerprints")
    distinct = common.materialize(marked.groupBy("f").agg(F.min(key).alias("least")), "distinct")
    return grouped(marked, distinct, links(distinct, distance), names)


def grouped(marked: DataFrame, distinct: DataFrame, linked: DataFrame, names: list[str]) -> DataFrame:
    """(*names, f, root, component_id) from rows (*names, f), the least key of each f, and links between the f."""
    roots = common.components(linked)
    joined = distinct.join(roots, distinct["f"] == roots["node"], "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    joined = common.materialize(joined, "roots")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select(F.col("f").alias("_f"), "root", "component_id")
    return marked.join(named, marked["f"] == named["_f"]).select(*names, "f", "root", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", find: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """``docs`` with one row of each component of ``find``: that of the least key, ties by a hash of the text; of rows equal in both, any one."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    k, t = (f"c{names.index(c)}" for c in (key, text))
    marked = plain.withColumn("th", F.xxhash64(F.coalesce(F.col(t), F.lit(""))).bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(F.col(k).isNull().cast("long")))
    found = find(marked, k, t, carry=["th"]).groupBy("root", k, "th").agg(F.count("*").alias("n"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col(k).isNull().alias("null"), k, "th", "n")).alias("m"))
    zero = F.lit("0").cast(plain.schema[k].dataType)
    kept = first.select(F.coalesce(F.col(f"m.{k}"), zero).alias("_k"), F.col("m.th").alias("_th"), (F.col("m.n") > 1).alias("again")).hint("shuffle_hash")
    parts = common.shuffle_partitions(docs.sparkSession)
    spread = marked.withColumn("k", F.coalesce(F.col(k), zero)).repartition(parts, "k", "th")
    joined = spread.join(kept, (F.col("k") == F.col("_k")) & (F.col("th") == F.col("_th"))).select(*plain.columns, "k", "th", "again")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    schema = common.arrow_type(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of survivors that repeat; rows of equal key and text are in one partition
        for b in batches:
            again = b.column(b.num_columns - 1).to_pylist()
            if any(again):
                keep = []
                for pair, more in zip(zip(b.column(b.num_columns - 3).to_pylist(), b.column(b.num_columns - 2).to_pylist()), again):
                    keep.append(not more or pair not in seen)
                    if more:
                        seen.add(pair)
                b = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(b.columns[:-3], schema=schema)

    return joined.mapInArrow(common.lean(run), ddl).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op4_simhash_anchors(spark, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and components; an empty table gives no rows. Cases as in ``near_duplicates``."""
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
