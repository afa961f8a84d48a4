"""Threshold-scaled fingerprints of documents.

A document's fingerprint keeps every word-shingle hash below a fixed fraction of the hash range, whatever its length. Such sketches
of any two documents, however unequal, hold the same sample of shingles: the sketch of a union is the union
of the sketches, and containment and resemblance are ratios of counts. Short documents keep few hashes or none; ``FRACTION`` is
the parameter for that. A tag of the whole set of shingles goes with a sketch, so that equal documents are known as such even if they keep none.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, FRACTION = 5, 1 / 4
TOP = 2**64 - 1
#: Word hashes kept by a Python worker.
MEMO = 400_000
_SEEN: dict[str, int] = {}


@dataclass
class Sketch:
    """``kept``: the sorted distinct hashes up to ``limit``; ``tag``: a digest of all distinct hashes, 0 if it isn't known."""

    limit: int
    tag: int
    kept: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < MEMO:
            self[word] = h
        return h


_HASHES = _Hashes()


def shingle_hashes(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The hashes of each text's shingles, repeats included.

    Words are lower-cased and split at white space. A text of fewer than ``words`` words is one shingle; a text of none
    has no shingle.
    """
    split = [t.lower().split() for t in texts]
    counts = [len(s) for s in split]
    h = np.fromiter(map(_HASHES.__getitem__, itertools.chain.from_iterable(split)), np.uint64, sum(counts))
    weights = _mix(np.arange(1, words + 1, dtype=np.uint64))
    n = len(h) - words + 1
    if n > 0:
        s = np.zeros(n, np.uint64)
        for j in range(words):
            s += _mix(h[j : j + n] ^ weights[j])
        s = _mix(s)
    out, at = [], 0
    for c in counts:
        if c >= words:
            out.append(s[at : at + c - words + 1])
        elif c:
            out.append(_mix(np.array([sum(int(x) for x in _mix(h[at : at + c] ^ weights[:c])) + c & TOP], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def sketch(hashes: np.ndarray, fraction: float = FRACTION) -> Sketch:
    """The fingerprint of a document's shingle hashes; that of no hash at all is empty."""
    limit = int(fraction * 2.0**64) - 1 if fraction < 1 else TOP
    distinct = np.unique(hashes)
    tag = xxhash.xxh64_intdigest(distinct.astype("<u8").tobytes()) or 1
    return Sketch(limit, tag, distinct[: np.searchsorted(distinct, np.uint64(limit), side="right")])


def _below(s: Sketch, limit: int) -> np.ndarray:
    return s.kept[: np.searchsorted(s.kept, np.uint64(limit), side="right")]


def _common(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    """(shared, of a, of b) hashes below the lower threshold."""
    limit = min(a.limit, b.limit)
    x, y = _below(a, limit), _below(b, limit)
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def resemblance(a: Sketch, b: Sketch) -> float:
    """Estimated share of the union's shingles that both have; where neither keeps one: 1 if the tags are equal, else 0."""
    shared, x, y = _common(a, b)
    return shared / (x + y - shared) if x + y else float(a.tag == b.tag)


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has; where a keeps none: 1 if the tags are equal, else 0."""
    shared, x, _ = _common(a, b)
    return shared / x if x else float(a.tag == b.tag)


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both documents together."""
    limit = min(a.limit, b.limit)
    return Sketch(limit, a.tag if a.tag == b.tag else 0, np.union1d(_below(a, limit), _below(b, limit)))


def to_text(s: Sketch) -> str:
    """A printable form: threshold, tag and hashes, 64 bits each, base64."""
    return base64.b64encode(np.concatenate((np.array([s.limit, s.tag], np.uint64), s.kept)).astype(">u8").tobytes()).decode()


def from_text(text: str) -> Sketch:
    a = np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)
    return Sketch(int(a[0]), int(a[1]), a[2:])


def cuts(df: DataFrame, key: str, parts: int) -> list[tuple[int, int]]:
    """Up to ``parts`` - 1 rising (key, hash) that cut the rows into ranges of similar counts, from a quantile sketch of all rows.

    A key that takes several quantiles is cut further, by the hash of its rows' texts.
    """
    found = Counter(int(x) for x in df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.2 / parts)) if parts > 1 else {}
    return [(k, -(2**63) + 2**64 * j // n) for k, n in sorted(found.items()) for j in range(n)]


def range_of(key: Column, h: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of ``bounds`` are at or below (key, h): a binary search in the plan, not a UDF."""
    n = len(bounds)
    depth = max(1, n.bit_length())
    pair = lambda k, x: F.struct(k.cast("long").alias("k"), x.cast("long").alias("h"))
    padded, own = F.array(*[pair(F.lit(k), F.lit(x)) for k, x in [(-(2**63), -(2**63)), *bounds]]), pair(key, h)
    step = lambda lo, i: F.when((lo + i <= n) & (own >= F.element_at(padded, F.least(lo + i, F.lit(n)) + 1)), lo + i).otherwise(lo)
    return F.aggregate(F.array(*[F.lit(1 << b) for b in range(depth - 1, -1, -1)]), F.lit(0), step)


def beside_next(docs: DataFrame, key: str, text: str, parts: int | None = None) -> DataFrame:
    """Rows sorted by key within ranges of it, each range followed by a copy of the next range's first row.

    Columns: part, extra, key, text. In a partition sorted by (part, extra, key) every row but the extra ones is
    followed by the next document of the whole table; the last document's next is the first. Nulls come first, rows
    that share a key go by a hash of the text, and very many of them are cut into ranges by it too. The texts are shuffled once;
    only range limits, a few numbers per range, pass through the driver.
    """
    spark = docs.sparkSession
    parts = parts or common.shuffle_partitions(spark)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text)).withColumn("_k", F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))))
    bounds = cuts(rows.select("_k"), "_k", parts)
    placed = rows.withColumn("_h", F.xxhash64(text)).withColumn("_part", range_of(F.col("_k"), F.col("_h"), bounds))
    firsts = sorted((r._part, (r.first.k, r.first.h)) for r in placed.groupBy("_part").agg(F.min(F.struct(F.col("_k").alias("k"), F.col("_h").alias("h"))).alias("first")).collect())  # one row per range
    if not firsts:
        return placed.select(F.col("_part").alias("part"), F.lit(False).alias("extra"), key, text)
    first = dict(firsts)
    before = {p: firsts[i - 1][0] for i, (p, _) in enumerate(firsts)}
    top = max(first) + 1
    first_of = [F.array(*[F.lit(first.get(p, (None, None))[i]).cast("long") for p in range(top)]) for i in (0, 1)]
    before_of = F.array(*[F.lit(before.get(p)).cast("int") for p in range(top)])
    at = F.col("_part") + 1
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("extra"))
    copy = F.struct(F.element_at(before_of, at).alias("part"), F.lit(True).alias("extra"))
    is_first = (F.col("_k") == F.element_at(first_of[0], at)) & (F.col("_h") == F.element_at(first_of[1], at))
    to = F.when(is_first, F.array(own, copy)).otherwise(F.array(own))
    spread = placed.select("*", F.explode(to).alias("_to")).select("_to.part", "_to.extra", "_k", "_h", key, text)
    return spread.repartitionById(parts, "part").sortWithinPartitions("part", "extra", "_k", "_h").select("part", "extra", key, text)


FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they are.

    The edited text has its last floor(n / 2) code points replaced by the next document's first as many (or all). A null
    text is empty. A lone document is its own next one; an empty table gives no rows.
    """
    schema = common.arrow_type(FINGERPRINTS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                yield from zip(*(c.to_pylist() for c in b.slice(lo, 64).columns))

    def answer(items: list[tuple]) -> pa.RecordBatch:
        """``items``: (doc_id, text, next text), consecutive ones sharing texts."""
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in items]
        texts: dict[str, int] = {}
        for t in itertools.chain((t for _, t, _ in items), edited, (n for _, _, n in items)):
            texts.setdefault(t, len(texts))
        made = [sketch(h) for h in shingle_hashes(list(texts))]
        a, e, n = ([made[texts[t]] for t in of] for of in ([t for _, t, _ in items], edited, [n for _, _, n in items]))
        return common.to_batch(
            {
                "doc_id": [i for i, _, _ in items],
                "n_chars": [len(t) for _, t, _ in items],
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": [to_text(x) for x in a],
                "edited_fingerprint": [to_text(x) for x in e],
                "near_edited": [resemblance(x, y) for x, y in zip(a, e)],
                "near_next": [resemblance(x, y) for x, y in zip(a, n)],
            },
            schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, items = None, []
        for part, extra, key, text in rows(batches):
            if last is not None and last[0] == part:
                items.append((last[1], last[2], text))
                if len(items) >= 128:
                    yield answer(items)
                    items = []
            last = None if extra else (part, key, text)
        if items:
            yield answer(items)

    common.ship(docs.sparkSession)
    return beside_next(docs, "doc_id", "text").mapInArrow(run, FINGERPRINTS)


def op7_scaled_sketch(spark, sf_dir: str) -> DataFrame:
    """All documents and their edited texts."""
    return edited_likeness(common.table(spark, sf_dir, "documents"))
