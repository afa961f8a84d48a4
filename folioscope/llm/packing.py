"""Tokenising and best-fit packing.

Every input partition packs its own documents as they come, so nothing is shuffled and a lost task is
simply run again. A partition's packer holds a fixed number of open sequences. Where the order of the rows matters, it is
that of the files' names and of the rows in each, which Spark's reading of several files in one partition doesn't keep.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordbpe import WordBpe

END = (1).to_bytes(4, "little")


class BestFit:
    """Bounded-space online best-fit over sequences of ``capacity``.

    Open sequences are kept by their free space; bit f of ``self.bits`` says that some open one has f free.
    The least set bit at or over a length is the tightest fit. When ``open_bins`` are open and none fits,
    the fullest is closed, which is the least set bit.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.count, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        at = self.by_free[free]
        one = at.pop()
        if not at:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return one

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of 1 to ``capacity`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            one = self._take(free)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            one, free = self.made, self.capacity
            self.made += 1
        rest = free - length
        if rest:
            self.by_free.setdefault(rest, []).append(one)
            self.bits |= 1 << rest
            self.count += 1
        return one, self.capacity - free


def in_file_order(docs: DataFrame) -> DataFrame:
    """The rows of a table read from files, in each partition by file name and place in the file; others as they come."""
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    try:
        marked = docs.select(at.alias("_at"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    except AnalysisException:  # not read from files
        return docs
    return marked.sortWithinPartitions("_at").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def pack(docs: DataFrame, key: str, text: str, vocabulary: str, capacity: int = 4096, open_bins: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).

    A document is its token ids and then id 1, so it has one token at least; a null text is empty. Only a
    document of over ``capacity`` tokens is cut, into full sequences and a rest. Rows that repeat, or
    that share a null key, are packed one by one. ``vocabulary`` is a tokenizer file that every executor can read.
    """
    kind = docs.schema[key].dataType.simpleString()
    ddl = f"{key} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    schema = common.arrow_type(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = WordBpe.load(vocabulary), BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 33
        wide = capacity * 4
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out: dict[str, list] = {f.name: [] for f in schema}
                for k, ids in zip(part.column(0).to_pylist(), bpe.encode_all(part.column(1).to_pylist())):
                    ids += END
                    for piece, start in enumerate(range(0, len(ids), wide)):
                        cut = ids[start : start + wide]
                        sequence, offset = packer.place(len(cut) // 4)
                        for name, v in zip(schema.names, (k, piece, start // 4, len(cut) // 4, zlib.crc32(cut), base | sequence, offset, cut)):
                            out[name].append(v)
                yield common.to_batch(out, schema)

    common.ship(docs.sparkSession)
    return docs.select(key, text).mapInArrow(common.lean(run, tokens=True), ddl)


def token_ids(cut: bytes) -> np.ndarray:
    """The ids of a packed piece."""
    return np.frombuffer(cut, "<u4")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens of word_bpe_49k."""
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
