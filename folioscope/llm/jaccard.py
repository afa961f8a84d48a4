"""Near copies: all pairs of texts whose sets of 5-word shingles have a Jaccard likeness of at least 0.8.

SimHash comes first: each set has a fingerprint, and those within ``DISTANCE`` bits are grouped through anchor points (``simhash``).
Each member of such a group whose whole set is alike enough to that of the group's first is linked to it. Likeness of 0.8 may well
show in more bits than any anchors can afford, so the pairs that aren't linked by then are sought by prefix filtering, without
loss, and pairs that SimHash has put in one linked group are left out there.

Shingles are put in one order for all texts, frequent ones (by a sample) last. Of two sets that are alike enough, each holds one
of the other's shingles among its first ``prefix_length``; so only these are brought together, by shingle. Sizes and places
in the order rule out many pairs that meet. Parity sketches rule out nearly all others that aren't alike enough, and no
pair that is: two sketches differ in no more bits than their sets have shingles apart. For the rest the whole sets are
compared. Any order gives the same pairs: the sample only decides how many are compared in vain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

#: Sets are near copies if their intersection is at least NUM / DEN of their union.
WORDS, NUM, DEN = 5, 4, 5
#: One text in so many is sampled; shingles of at least OFTEN sampled texts are put last, at most LISTED of them.
SAMPLE, OFTEN, LISTED = 8, 4, 200_000
#: Fingerprints link at so many differing bits: the most that two flipped bits in one of three blocks cover, at about 300 replicas.
#: Random fingerprints are rarely so near, three in 10**10 pairs.
DISTANCE, BLOCKS = 8, 3


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of the distinct shingles, sorted; words are split and lowered as for fingerprints, a short text is one shingle."""
    return np.unique(simhash.shingle_hashes(text, words))


def prefix_length(n: int) -> int:
    """Of n shingles, how many hold at least one of any set alike enough: all but so many as must be shared, and one."""
    return n - -(-NUM * n // DEN) + 1 if n else 0


def ordered(h: np.ndarray, late: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sorted hashes in the common order: those not listed in ``late`` (sorted) first, then by ``rank``."""
    if not len(late):
        return h
    at = np.minimum(np.searchsorted(late, h), len(late) - 1)
    listed = late[at] == h
    return np.concatenate((h[~listed], h[listed][np.argsort(rank[at[listed]])]))


def sketch(h: np.ndarray) -> bytes:
    """Parities of how many hashes end in each value of b bits, 2**b >= their number; xor of its halves gives the sketch of b - 1 bits."""
    size = max(64, 1 << (len(h) - 1).bit_length()) if len(h) else 64
    return np.packbits((np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool), bitorder="little").tobytes()


def may_be_alike(x: bytes, y: bytes, n: int) -> bool:
    """Whether the sketches of two sets of n shingles together leave a likeness of NUM / DEN possible."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    long, short = 8 * len(x), 8 * len(y)
    if long < short:
        a, b, long, short = b, a, short, long
    while long > short:
        long //= 2
        a = (a >> long) ^ (a & ((1 << long) - 1))
    return (DEN + NUM) * (a ^ b).bit_count() <= (DEN - NUM) * n


def _frequent(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ranks): frequent shingles of the sample, and their places from rare to frequent."""
    schema = common.arrow_type("h long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], schema=schema)

    sampled = docs.where(F.pmod("_of", F.lit(SAMPLE)) == 0).select(text, "_of").dropDuplicates(["_of"]).select(text)
    counted = sampled.mapInArrow(common.lean(run), "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    top = counted.orderBy(F.desc("n"), "h").limit(LISTED).toArrow()
    late = top.column("h").to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(late)
    return late[by], -by


def _sets(docs: DataFrame, names: list[str], text: str, late: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(*names, f, n, print, sketch, first): a digest of the set, its size, SimHash and sketch, and its first shingles in the common order."""
    ddl = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names) + ", f long, n int, print long, sketch binary, first array<long>"
    schema = common.arrow_type(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [shingles(t) for t in part.column(len(names)).to_pylist()]
                f = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64)
                n = np.array([len(h) for h in sets], np.int32)
                prints = np.array([simhash.majority(h) for h in sets], np.uint64)
                first = [ordered(h, late, rank)[: prefix_length(len(h))] for h in sets]
                ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(f.view(np.int64)), pa.array(n), pa.array(prints.view(np.int64)), pa.array([sketch(h) for h in sets], pa.binary()), lists.cast(schema.field("first").type)], schema=schema)

    return docs.select(*names, text).mapInArrow(common.lean(run), ddl)


def _fingerprint_pairs(marked: DataFrame) -> DataFrame:
    """(a, b): each set of a group that fingerprints within ``DISTANCE`` bits link, with the group's first, that of the least digest."""
    sets = common.materialize(marked.where("n > 0").select("f", "print").distinct(), "prints")
    prints = common.materialize(sets.select(F.col("print").alias("f")).distinct(), "fingerprints")
    roots = common.components(simhash.links(prints, DISTANCE, BLOCKS))
    member = common.materialize(sets.join(roots, sets["print"] == roots["node"], "left").select("f", F.coalesce("root", "print").alias("root")), "members")
    first = member.groupBy("root").agg(F.min("f").alias("a"), F.count("*").alias("m")).where("m > 1")
    return member.join(first, "root").where("f <> a").select("a", F.col("f").alias("b"))


def _postings(marked: DataFrame, linked: DataFrame) -> DataFrame:
    """(f, n, g, pos, h): the first shingles of each set; g is the first set of its group in ``linked``, 0 without a group."""
    group = linked.select(F.col("b").alias("_f"), F.col("a").alias("g")).union(linked.select("a", "a").distinct())
    if linked.count() <= common.BROADCAST_ROWS // 2:
        group = F.broadcast(group)
    return marked.join(group, marked["f"] == group["_f"], "left").select("f", "n", F.coalesce("g", F.lit(0).cast("long")).alias("g"), F.posexplode("first").alias("pos", "h"))


def _meet(n: np.ndarray, pos: np.ndarray, g: np.ndarray, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of sets with a shingle in common that can be alike enough, by sizes (ascending), the shingle's places and groups.

    If it is the first shingle that two sets share, the rest of the shorter remainder bounds what else they share.
    """
    n, rest = n.astype(np.int64), n.astype(np.int64) - pos
    stop = np.searchsorted(n, n * DEN // NUM, side="right")
    rows = max(1, step // max(1, len(n)))
    for lo in range(0, len(n), rows):
        hi = min(len(n), lo + rows)
        top = int(stop[hi - 1])
        i, j = np.arange(lo, hi)[:, None], np.arange(lo, top)[None, :]
        ok = (j > i) & (j < stop[i]) & ((NUM + DEN) * np.minimum(rest[i], rest[j]) >= NUM * (n[i] + n[j])) & ((g[i] != g[j]) | (g[i] == 0))
        x, y = np.nonzero(ok)
        yield x + lo, y + lo


def _candidates(postings: DataFrame) -> DataFrame:
    """(a, b): distinct pairs of sets that share one of their first shingles, can be alike enough and aren't of one group."""
    spark = postings.sparkSession
    out = common.arrow_type("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole groups, sorted by shingle, size and set."""
            rows = rows[:, np.append(True, (rows[:, 1:] != rows[:, :-1]).any(0))]  # copies
            edges = np.flatnonzero(np.diff(rows[0])) + 1
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            begins, ends = np.append(0, edges), np.append(edges, rows.shape[1])
            more = ends - begins > 1
            for s, e in zip(begins[more].tolist(), ends[more].tolist()):
                f = rows[2, s:e]
                for x, y in _meet(rows[1, s:e], rows[3, s:e], rows[4, s:e]):
                    a.append(np.minimum(f[x], f[y]))
                    b.append(np.maximum(f[x], f[y]))
                    if sum(map(len, a)) >= 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=out)
                        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=out)

        held: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy().astype(np.int64) for c in b.columns])
            edges = np.flatnonzero(rows[0] != rows[0, -1])
            cut = int(edges[-1]) + 1 if len(edges) else 0
            if cut or (held and held[-1][0, -1] != rows[0, 0]):
                yield from close(np.concatenate([*held, rows[:, :cut]], axis=1))
                held = []
            held.append(rows[:, cut:])
        if held:
            yield from close(np.concatenate(held, axis=1))

    placed = postings.repartition(common.shuffle_partitions(spark), "h").sortWithinPartitions("h", "n", "f")
    return placed.select("h", "n", "f", "pos", "g").mapInArrow(common.lean(run), "a long, b long").distinct()


def _possible(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches leave it possible that they are alike enough."""
    out = common.arrow_type("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [may_be_alike(x, y, n) for x, y, n in zip(*(c.to_pylist() for c in b.columns[2:]))]
            yield pa.RecordBatch.from_arrays(b.columns[:2], schema=out).filter(pa.array(keep, pa.bool_()))

    sets = marked.where("n > 0").select("f", "n", "sketch").dropDuplicates(["f"])
    left, right = sets.toDF("a", "na", "sa"), sets.toDF("b", "nb", "sb")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", F.col("na") + F.col("nb")).mapInArrow(common.lean(run), "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, text: str, owners: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough. owners: (f, th), a text hash for each set of a pair."""
    ddl = "f long, h binary"
    schema = common.arrow_type(ddl)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                sets = [shingles(t).tobytes() for t in b.column(0).slice(lo, 64).to_pylist()]
                f = np.array([xxhash.xxh64_intdigest(h) for h in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(sets, pa.binary())], schema=schema)

    out = common.arrow_type("a long, b long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(b.columns[:2], schema=out).filter(pa.array(keep, pa.bool_()))

    wanted = owners.select(F.col("th").alias("_th")).distinct()
    if owners.count() <= common.BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(text, F.xxhash64(text).alias("_of")).join(wanted, F.col("_of") == F.col("_th"), "left_semi").select(text)
    sets = common.materialize(texts.mapInArrow(common.lean(whole), ddl).dropDuplicates(["f"]), "sets")
    left, right = sets.select(F.col("f").alias("a"), F.col("h").alias("ha")), sets.select(F.col("f").alias("b"), F.col("h").alias("hb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(common.lean(compare), "a long, b long")


def _linked(pairs: DataFrame, marked: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) of sets that are alike enough, staged."""
    pairs = common.materialize(_possible(pairs, marked), "pairs")
    ends = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "_f")
    owners = marked.join(ends, marked["f"] == ends["_f"]).groupBy("f").agg(F.min("_of").alias("th"))
    return common.materialize(_verified(pairs, docs, text, common.materialize(owners, "owners")), "links")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(key, *carry, f, root, component_id) as ``simhash.near_duplicates`` gives, over links of likeness 0.8 and more; f is the set's digest.

    Texts without words are alike. Links come from SimHash groups and, for the pairs that those don't join, from prefix filtering:
    components are the transitive closure of all links, without loss.
    """
    names = [key, *(carry or [])]
    common.ship(docs.sparkSession)
    hashed = docs.select(*names, text, F.xxhash64(text).alias("_of"))
    marked = common.materialize(_sets(hashed, [*names, "_of"], text, *_frequent(hashed, text)), "sets")
    alike = _linked(_fingerprint_pairs(marked), marked, docs, text)
    links = alike.union(_linked(_candidates(_postings(marked, alike)), marked, docs, text))
    distinct = common.materialize(marked.groupBy("f").agg(F.min(key).alias("least")), "distinct")
    return simhash.grouped(marked, distinct, links, names)
