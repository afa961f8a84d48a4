"""Removing long byte strings that occur more than once.

Every string of ``length`` bytes has an anchor: of the ``GRAM``-byte pieces inside it, the leftmost with the least hash.
Equal strings have their anchors at the same place in them, so strings can only be equal if their anchors' pieces are. The
first pass lists anchors (about one in 137 bytes) with the range of starts that they serve; pieces that occur once are
done with. For the others the bytes around the anchor are brought together by piece and sorted (``suffixes``), and
each start whose string occurs again marks its bytes for removal.

Passages of a number of words that stand in several documents can be marked too, however few bytes they have: windows of words
have anchors among their ``WORD_GRAM``-word pieces and go the same way, but are compared by hashes of their words. Blanks
between words don't matter, and a window counts only if it stands in another row as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .sketch import _mix
from .suffixes import repeated_starts

LENGTH, GRAM = 400, 128
#: Passages of over 50 words are told by windows of so many, and their anchors by so many words of a window.
PASSAGE, WORD_GRAM = 51, 8
#: Groups of more contexts than this are split by more of the bytes around the anchor: the starts go in so many ranges, and the strings of a
#: range that are brought together agree in all but a few bytes. Where even those are more, they are copies for the most part, and are
#: counted by digests of whole strings without being brought together.
HOT, RANGES = 150_000, 8
#: Bytes hashed at a time, and contexts sorted at a time.
SEGMENT, ITEMS = 1 << 20, 16_384
#: Low bits of a hash that give way to its place when the least is chosen: a batch of texts is shorter than 2**TIES. They are as
#: many for every batch, so that equal strings have their anchors at the same place wherever they are hashed.
TIES = 23
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = _mix(np.arange(1, 257, dtype=np.uint64))
_POWERS: list[np.ndarray] = []
_BLANK = np.isin(np.arange(256), [*range(9, 14), 32])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SEGMENT + LENGTH)
        _POWERS[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, b, np.uint64))) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWERS[0], _POWERS[1]


def anchors(data: bytes, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, anchor, first, last) for texts laid end to end: the anchor serves the starts from first to last.

    ``ends`` are the texts' ends; starts whose string would cross one have no anchor. The hash is 64 bits of the piece;
    anchors are chosen by its upper bits, ties to the left.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return (empty,) * 4
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[np.frombuffer(data, np.uint8)] * up[:n], out=sums[1:])
    pieces = n - gram + 1
    h = _mix((sums[gram:] - sums[:pieces]) * down[:pieces])
    starts = n - length + 1
    least = _least(h, length - gram + 1)
    own = np.searchsorted(ends, np.arange(starts), side="right")
    ok = np.arange(starts) + length <= ends[np.minimum(own, len(ends) - 1)]
    least[~ok] = -1
    cut, last = _runs(least)
    return h[least[cut]].view(np.int64), least[cut], cut, last


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of hashes, the place of the least by all but the lowest ``TIES`` bits, ties to the left."""
    if len(h) >> TIES:
        raise ValueError("too many hashes at once")
    bits = np.uint64(TIES)
    v = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(h) // window) * window, np.uint64(2**64 - 1))
    padded[: len(h)] = v
    blocks = padded.reshape(-1, window)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(h) - window + 1
    return (np.minimum(right[:starts], left[window - 1 : window - 1 + starts]) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)


def _runs(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of each run of equal places that aren't -1."""
    cut = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(cut[1:], len(least)) - 1
    keep = least[cut] >= 0
    return cut[keep], last[keep]


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word between blanks."""
    solid = ~_BLANK[np.frombuffer(data, np.uint8)]
    edge = np.diff(np.pad(solid, 1).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word, by stretches of words of about ``SEGMENT`` bytes."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT)))
        part = np.frombuffer(data, np.uint8, int(end[j - 1] - start[i]), int(start[i]))
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * up[: len(part)], out=sums[1:])
        a, b = start[i:j] - start[i], end[i:j] - start[i]
        out[i:j] = _mix((sums[b] - sums[a]) * down[a])
        i = j
    return out


def _rolled(h: np.ndarray, words: int) -> np.ndarray:
    """64 bits of each window of so many words, wherever it stands."""
    if len(h) < words:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    n = len(h) - words + 1
    return _mix((sums[words:] - sums[:n]) * down[:n])


def word_anchors(data: bytes, ends: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """(hash, start, end) for texts parted by blanks: the anchor serves the windows of ``words`` words that lie from start to end."""
    start, end = word_bounds(data)
    if len(start) < words:
        return (np.zeros(0, np.int64),) * 3
    gram = min(WORD_GRAM, words)
    h = _rolled(word_hashes(data, start, end), gram)
    least = _least(h, words - gram + 1)
    own = np.searchsorted(ends, start, side="right")
    least[own[: len(least)] != own[words - 1 :]] = -1
    cut, last = _runs(least)
    return h[least[cut]].view(np.int64), start[cut], end[last + words - 1]


ANCHORS = "id {0}, th long, g long, a long, first long, last long"
SPANS = "id {0}, th long, start long, end long, words boolean"


def _keyed(docs: DataFrame, key: str, text: str, carry: list[Column]) -> DataFrame:
    """(id, th, text, *carry): rows of equal key and text share id and th, and have the same repeats.

    Neither is null, so that joins are plain equalities on what the rows are partitioned by: th is a hash of the text whose
    lowest bit says that the key is null.
    """
    t, k = F.coalesce(F.col(text), F.lit("")), F.col(key)
    th = F.xxhash64(t).bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(k.isNull().cast("long"))
    return docs.select(F.coalesce(k, F.lit("0").cast(docs.schema[key].dataType)).alias("id"), th.alias("th"), t.alias("text"), *carry)


def _word_pieces(t: bytes, words: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes): a text in pieces of whole words that overlap by words - 1."""
    if len(t) <= SEGMENT:
        yield 0, t
        return
    start, end = word_bounds(t)
    i = 0
    while i + words <= len(start):
        j = max(i + words, int(np.searchsorted(end, start[i] + SEGMENT)))
        j = min(j, len(start))
        yield int(start[i]), t[start[i] : end[j - 1]]
        i = j - words + 1


def _list_anchors(keyed: DataFrame, kind: str, length: int, gram: int, words: int) -> DataFrame:
    """Anchors of strings, and (if ``words``) of windows of words: these have a = -1, and first and last are the windows' first and end byte."""
    ddl = ANCHORS.format(kind)
    schema = common.arrow_type(ddl)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(id, th, offset in the text, bytes): texts in pieces that overlap by length - 1."""
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                for i, th, t in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns)):
                    t = t.encode()
                    for at in range(0, max(1, len(t) - length + 1), SEGMENT):
                        if len(t) - at >= length:
                            yield i, th, at, t[at : at + SEGMENT + length - 1], False
                    if words:
                        for at, piece in _word_pieces(t, words):
                            yield i, th, at, piece, True

    def answer(held: list[tuple], of_words: bool) -> pa.RecordBatch:
        ends = np.cumsum([len(x[3]) + of_words for x in held])
        if of_words:
            g, first, last = word_anchors(b"\n".join(x[3] for x in held), ends, words)
        else:
            g, a, first, last = anchors(b"".join(x[3] for x in held), ends, length, gram)
        of = np.searchsorted(ends, first, side="right")
        shift = (np.array([x[2] for x in held]) - np.append(0, ends[:-1]))[of]
        if of_words:
            a = -1 - shift
        ids = pa.array([x[0] for x in held], schema.field(0).type).take(pa.array(of))
        return pa.RecordBatch.from_arrays([ids, pa.array(np.array([x[1] for x in held], np.int64)[of]), pa.array(g), pa.array(a + shift), pa.array(first + shift), pa.array(last + shift)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], []), [0, 0]
        for *x, of_words in pieces(batches):
            held[of_words].append(x)
            size[of_words] += len(x[3])
            if size[of_words] >= SEGMENT:
                yield answer(held[of_words], of_words)
                held[of_words].clear()
                size[of_words] = 0
        for of_words in (False, True):
            if held[of_words]:
                yield answer(held[of_words], of_words)

    return keyed.mapInArrow(common.lean(run), ddl)


def _windows(texts: list[bytes], listed: list[list], words: int) -> Iterator[tuple]:
    """(text, g, word, hashes) of each listed word anchor: the windows that it serves, the first from the text's word of that number on."""
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    start, end = word_bounds(b"\n".join(texts))
    h = _rolled(word_hashes(b"\n".join(texts), start, end), words)
    first = np.searchsorted(start, ends)
    for i, anchors in enumerate(listed):
        for x in anchors:
            lo, hi = np.searchsorted(start, ends[i] + x["first"]), np.searchsorted(end, ends[i] + x["last"]) - words + 2
            yield i, x["g"], int(lo - first[i]), h[lo:hi]


def _ranged(t: bytes, g: int, a: int, low: int, top: int, length: int, gram: int, ranges: int) -> Iterator[tuple]:
    """(g, anchor, low, context) of the strings that start ``low`` to ``top`` bytes before the anchor at a, apart by range.

    The g of a range is a hash of what all strings from it share: the bytes around the anchor that even its outermost ones reach.
    """
    for k in range(ranges):
        first, last = (i * (length - gram + 1) // ranges for i in (k, k + 1))
        lo, hi = max(low, first), min(top, last - 1)
        if lo <= hi:
            shared = b"%d %d " % (g, k) + t[a - first : a] + t[a + gram : a + length - last + 1]
            key = int.from_bytes(hashlib.blake2b(shared, digest_size=8).digest(), "little", signed=True)
            yield key, hi, lo, t[a - hi : a - lo + length]


def _cut_contexts(joined: DataFrame, kind: str, length: int, gram: int, words: int, ranges: int = 1) -> DataFrame:
    """The bytes around each listed anchor, once per text where they repeat in it; for word anchors (anchor -1) the hashes of windows from word ``at`` on.

    ``row`` tells the input rows apart; it is only compared with others of one partition of pieces.
    """
    ddl = f"g long, id {kind}, th long, row long, anchor int, low int, at array<long>, context binary"
    schema = common.arrow_type(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                out: dict[str, list] = {x: [] for x in schema.names}
                rows = list(zip(*(c.to_pylist() for c in b.slice(lo, 64).columns[:4])))
                texts = [text.encode() for _, _, text, _ in rows]
                for k, ((i, th, _, listed), t) in enumerate(zip(rows, texts)):
                    found: dict[tuple, list[int]] = {}
                    for x in listed:
                        a, first, last = x["a"], x["first"], x["last"]
                        if a >= 0 and ranges > 1:
                            for item in _ranged(t, x["g"], a, a - last, a - first, length, gram, ranges):
                                found.setdefault(item, []).append(a)
                        elif a >= 0:
                            found.setdefault((x["g"], a - first, a - last, t[first : last + length]), []).append(a)
                    for (g, anchor, low, context), at in found.items():
                        for name, v in zip(schema.names, (g, i, th, row + k, anchor, low, sorted(set(at)), context)):
                            out[name].append(v)
                if words:
                    of_words = [[x for x in listed if x["a"] < 0] for _, _, _, listed in rows]
                    for k, g, at, h in _windows(texts, of_words, words) if any(of_words) else ():
                        for name, v in zip(schema.names, (g, *rows[k][:2], row + k, -1, 0, [at], h.tobytes())):
                            out[name].append(v)
                row += len(rows)
                yield common.to_batch(out, schema)

    return joined.mapInArrow(common.lean(run), ddl)


def _mark(contexts: DataFrame, kind: str, length: int, gram: int, words: int) -> DataFrame:
    """Spans whose strings (in bytes) or windows (in words) repeat, from contexts that lie together by piece."""
    ddl = SPANS.format(kind)
    schema = common.arrow_type(ddl)

    def answer_words(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[7]) // 8 for r in rows])
        h = np.frombuffer(b"".join(r[7] for r in rows), np.uint64)
        row = np.repeat(np.arange(len(rows)), sizes)
        place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        _, of = np.unique(h ^ _mix(np.array([r[0] for r in rows], np.int64).view(np.uint64))[row], return_inverse=True)
        doc = np.array([r[3] for r in rows])[row]
        least, most = np.full(len(h), np.iinfo(np.int64).max), np.full(len(h), -1)
        np.minimum.at(least, of, doc)
        np.maximum.at(most, of, doc)
        again = (least < most)[of]  # in more than one row
        fresh = np.append(True, row[1:] != row[:-1])
        begin = np.flatnonzero(again & (fresh | ~np.append(False, again[:-1])))
        stop = np.flatnonzero(again & (np.append(fresh[1:], True) | ~np.append(again[1:], False)))
        out: dict[str, list] = {n: [] for n in schema.names}
        for k, x1, x2 in zip(row[begin].tolist(), place[begin].tolist(), place[stop].tolist()):
            _, i, th, _, _, _, (at,), _ = rows[k]
            for name, v in zip(schema.names, (i, th, at + x1, at + x2 + words, True)):
                out[name].append(v)
        return common.to_batch(out, schema)

    def answers(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for part, f in (([r for r in rows if r[4] >= 0], answer), ([r for r in rows if r[4] < 0], answer_words)):
            if part:
                yield f(part)

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        pieces: dict[tuple, int] = {}
        distinct: dict[tuple, int] = {}
        members: list[list[tuple]] = []
        for g, i, th, _, anchor, low, at, context in rows:
            piece = pieces.setdefault((g, context[anchor : anchor + gram]), len(pieces))
            item = distinct.setdefault((piece, anchor, low, context), len(members))
            if item == len(members):
                members.append([])
            members[item].append((i, th, at))
        keys = list(distinct)
        count = np.array([sum(len(at) for _, _, at in m) for m in members])
        anchor, low = np.array([k[1] for k in keys]), np.array([k[2] for k in keys])
        group = np.array([k[0] for k in keys])
        alone = np.bincount(group, minlength=len(pieces))[group] == 1
        marked = np.zeros((len(keys), int(anchor.max()) + 1), bool)
        x = np.arange(marked.shape[1])
        every = (count > 1)[:, None] & (low[:, None] <= x) & (x <= anchor[:, None])
        marked |= every
        some = np.flatnonzero(~alone)
        if len(some):
            some = some[np.argsort(group[some], kind="stable")]
            found = repeated_starts([keys[i][3] for i in some.tolist()], anchor[some], low[some], count[some], group[some], length, gram)
            marked[some, : found.shape[1]] |= found
        edge = np.diff(np.pad(marked, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        item, begin = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        out: dict[str, list] = {n: [] for n in schema.names}
        for k, x1, x2 in zip(item.tolist(), begin.tolist(), (stop - 1).tolist()):
            for i, th, at in members[k]:
                for a in at:
                    out["id"].append(i)
                    out["th"].append(th)
                    out["start"].append(a - x2)
                    out["end"].append(a - x1 + length)
                    out["words"].append(False)
        return common.to_batch(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                for row in zip(*(c.to_pylist() for c in b.slice(lo, 1024).columns)):
                    if len(held) >= ITEMS and row[0] != held[-1][0]:
                        yield from answers(held)
                        held = []
                    held.append(row)
        if held:
            yield from answers(held)

    return contexts.mapInArrow(common.lean(run), ddl)


def _mark_hot(contexts: DataFrame, kind: str, length: int, words: int) -> DataFrame:
    """The same for very many contexts: equal strings are counted by a 128-bit digest, combined before the shuffle; windows of words by the hashes of window and piece."""
    ddl = f"h1 long, h2 long, id {kind}, th long, row long, start long, end long, words boolean"
    schema = common.arrow_type(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                for g, i, th, row, anchor, low, at, context in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns)):
                    if anchor < 0:
                        h1 = np.frombuffer(context, np.int64)
                        h2, s, size = np.full(len(h1), g), at[0] + np.arange(len(h1)), words
                    else:
                        x = np.arange(low, anchor + 1)
                        raw = np.frombuffer(b"".join(hashlib.blake2b(context[anchor - k : anchor - k + length], digest_size=16).digest() for k in x.tolist()), "<i8").reshape(-1, 2)
                        h1, h2 = (np.tile(raw[:, k], len(at)) for k in (0, 1))
                        s, size = (np.array(at)[:, None] - x).ravel(), length
                    n = len(s)
                    yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array([i] * n, schema.field(2).type), *(pa.array([v] * n, pa.int64()) for v in (th, row)), pa.array(s), pa.array(s + size), pa.array([anchor < 0] * n)], schema=schema)

    starts = common.materialize(contexts.mapInArrow(common.lean(run), ddl), "starts")
    again = starts.groupBy("h1", "h2", "words").agg(F.count("*").alias("n"), (F.min("row") < F.max("row")).alias("rows")).where("if(words, rows, n > 1)").drop("n", "rows")
    return starts.join(again, ["h1", "h2", "words"]).select("id", "th", "start", "end", "words")


def repeated_spans(docs: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, carry: list[Column] | None = None, words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(keyed texts, listed spans): (id, th, text, *carry) and (id, th, spans), spans an array of (start, end, words), not merged.

    Rows that repeat (equal key and text) each count as a document; their whole texts of ``length`` bytes or more repeat.
    With ``words``, windows of so many words that stand in another row too are covered by spans marked words, which count
    words of the text where others count bytes.
    """
    spark = docs.sparkSession
    common.ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    keyed = _keyed(docs, key, text, carry or [])
    listed, path = common.stage(_list_anchors(keyed.select("id", "th", "text"), kind, length, gram, words), "anchors")
    often = listed.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    chosen = common.materialize(listed.join(often, "g"), "repeated-anchors")
    common.discard(spark, path)
    # texts cross the network once: both joins below start from this exchange
    spread = keyed.repartition(common.shuffle_partitions(spark), "id", "th")

    def beside(anchors: DataFrame) -> DataFrame:
        one = anchors.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set(F.struct("g", "a", "first", "last", "n")).alias("listed"))
        on = (F.col("id") == F.col("_id")) & (F.col("th") == F.col("_th"))
        return spread.join(one.hint("shuffle_hash"), on).select("id", "th", "text", "listed", *keyed.columns[3:])

    few, over = _cut_contexts(beside(chosen.where(F.col("n") <= hot)), kind, length, gram, words), None
    if chosen.where(F.col("n") > hot).limit(1).count():
        split = common.materialize(_cut_contexts(beside(chosen.where(F.col("n") > hot)), kind, length, gram, words, RANGES), "split")
        sizes = common.materialize(split.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("g"), "hot")
        if sizes.count() <= common.BROADCAST_ROWS:
            sizes = F.broadcast(sizes)
        few, over = few.union(split.join(sizes, "g", "left_anti").select(few.columns)), split.join(sizes, "g", "left_semi").select(few.columns)
    contexts = few.repartition(common.shuffle_partitions(spark), "g").sortWithinPartitions("g")
    spans = _mark(contexts.select("g", "id", "th", "row", "anchor", "low", "at", "context"), kind, length, gram, words)
    if over is not None:
        spans = spans.union(_mark_hot(over, kind, length, words))
    return spread, spans.groupBy("id", "th").agg(F.collect_set(F.struct("start", "end", "words")).alias("spans"))


def with_spans(docs: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, carry: list[Column] | None = None, words: int = 0) -> DataFrame:
    """(id, th, text, spans, *carry), a row per input row; spans is null where nothing repeats."""
    spread, spans = repeated_spans(docs, key, text, length, gram, hot, carry, words)
    right = spans.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "spans").hint("shuffle_hash")
    on = (F.col("id") == F.col("_id")) & (F.col("th") == F.col("_th"))
    whole = spread.join(right, on, "left")
    return whole.select(F.when(F.col("th").bitwiseAND(F.lit(1).cast("long")) == 0, F.col("id")).alias("id"), "th", "text", "spans", *spread.columns[3:])


def located(data: bytes, spans: list[dict] | None) -> list[tuple[int, int, bool]]:
    """(start, end, words) of each span, in bytes."""
    found = [(x["start"], x["end"], x["words"]) for x in spans or []]
    if any(w for _, _, w in found):
        start, end = word_bounds(data)
        found = [(int(start[s]), int(end[e - 1]), w) if w else (s, e, w) for s, e, w in found]
    return found


def merged(spans: list[tuple[int, int, bool]], words: bool | None = None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, by all located spans or those of one kind."""
    out: list[list[int]] = []
    for s, e in sorted((s, e) for s, e, w in spans if words is None or w == words):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What remains without the runs."""
    at, parts = 0, []
    for s, e in runs:
        parts.append(data[at:s])
        at = e
    return b"".join([*parts, data[at:]])


def remove(docs: DataFrame, key: str, text: str, length: int = LENGTH, chars: str | None = None, words: int = 0) -> DataFrame:
    """``docs`` with the covered bytes taken out of ``text`` (with ``words``, those of windows of so many words too), and ``chars`` (if given) counted anew.

    A character that loses some of its bytes goes whole. Null texts stay null; a text of which nothing remains is empty.
    """
    names = docs.columns
    whole = with_spans(docs, key, text, length, carry=[F.col(f"`{c}`").alias(f"c{i}") if c != text else F.col(f"`{c}`").isNull().alias(f"c{i}") for i, c in enumerate(names)], words=words)
    schema = common.arrow_type(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at, count = names.index(text), names.index(chars) if chars else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns[2:])
            texts = []
            for t, spans, null in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), columns[at].to_pylist()):
                texts.append(None if null else kept(data := t.encode(), merged(located(data, spans))).decode("utf-8", "ignore") if spans else t)
            columns[at] = pa.array(texts, schema.field(at).type)
            if chars:
                columns[count] = pa.array([None if t is None else len(t) for t in texts], schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return whole.select("text", "spans", *[f"c{i}" for i in range(len(names))]).mapInArrow(common.lean(run), ddl)


DIGEST = "doc_id {0}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long"


def digests(marked: DataFrame) -> DataFrame:
    """Per row of ``with_spans``: sizes, and the digest of the bytes that remain when strings go; then how many passages of words there are, and their bytes."""
    ddl = DIGEST.format(marked.schema["id"].dataType.simpleString())
    schema = common.arrow_type(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                out: dict[str, list] = {x: [] for x in schema.names}
                for i, text, spans in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns)):
                    at = located(t := text.encode(), spans)
                    runs, passages = merged(at, False), merged(at, True)
                    size, found = (sum(e - s for s, e in x) for x in (runs, passages))
                    for n, v in zip(schema.names, (i, len(t), size, len(runs), hashlib.sha256(kept(t, runs)).hexdigest(), len(passages), found)):
                        out[n].append(v)
                yield common.to_batch(out, schema)

    return marked.select("id", "text", "spans").mapInArrow(common.lean(run), ddl)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the bytes that strings of 400 bytes found elsewhere cover.

    A null text is empty, null ids are ids, rows that repeat count each as a document, other columns are not read, and an empty table
    gives no rows.
    n_passages and n_passage_bytes tell besides what passages of over 50 words that other documents have too cover. Those of under
    400 bytes stay in the kept bytes; ``remove`` takes them out.
    """
    return digests(with_spans(common.table(spark, sf_dir, "documents"), "doc_id", "text", words=PASSAGE))


#: Every start of 400 bytes by its MD5, cut from pieces of hexadecimal digits; and every window of 51 words.
OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents
), b AS (
  SELECT *, CAST(length(x) // 2 AS BIGINT) AS n FROM d
), c AS (
  SELECT r, n, pos, substr(x, 2 * pos + 1, 2 * 1399) AS part FROM (SELECT r, n, x, unnest(range(0, n - 399, 1000)) AS pos FROM b)
), s AS (
  SELECT r, pos + i AS i, md5_number(substr(part, 2 * i + 1, 800)) AS h FROM (SELECT r, pos, part, unnest(range(0, least(1000, n - 399 - pos))) AS i FROM c)
), again AS (
  SELECT r, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)
), cut AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM again
), runs AS (
  SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM cut) GROUP BY r, k
), before AS (
  SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS last FROM runs
), gone AS (
  SELECT r, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, max(hi) AS hi, string_agg(substr(x, 2 * last + 1, 2 * (lo - last)), '' ORDER BY lo) AS kept
  FROM before JOIN b USING (r) GROUP BY r
), v AS (
  SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, regexp_extract_all(t, '[\x20\x09-\x0D]+') AS blanks, regexp_matches(t, '^[\x20\x09-\x0D]') AS indented FROM d
), w AS (
  SELECT r, unnest(words) AS word, unnest((CASE WHEN indented THEN blanks ELSE list_concat([''], blanks) END)[1:len(words)]) AS blank, unnest(range(1, len(words) + 1)) AS k FROM v
), p AS (
  SELECT r, k, word, sum(strlen(word) + strlen(blank)) OVER (PARTITION BY r ORDER BY k) AS hi, sum(strlen(word) + strlen(blank)) OVER (PARTITION BY r ORDER BY k) - strlen(word) AS lo FROM w
), f AS (
  SELECT r, k, lo, max(hi) OVER o AS hi, count(*) OVER o AS n, md5_number(string_agg(word, ' ') OVER o) AS h FROM p
  WINDOW o AS (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING)
), shared AS (
  SELECT r, k, lo, hi FROM f WHERE n = 51 AND h IN (SELECT h FROM f WHERE n = 51 GROUP BY h HAVING min(r) < max(r))
), islands AS (
  SELECT r, min(lo) AS lo, max(hi) AS hi FROM (
    SELECT r, lo, hi, sum(fresh) OVER (PARTITION BY r ORDER BY k) AS island FROM (SELECT *, CASE WHEN lo <= lag(hi) OVER (PARTITION BY r ORDER BY k) THEN 0 ELSE 1 END AS fresh FROM shared)
  ) GROUP BY r, island
), passages AS (
  SELECT r, count(*) AS n_passages, CAST(sum(hi - lo) AS BIGINT) AS n_passage_bytes FROM islands GROUP BY r
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN kept IS NULL THEN x ELSE kept || substr(x, 2 * hi + 1) END)) AS kept_sha256,
  coalesce(n_passages, 0) AS n_passages, coalesce(n_passage_bytes, 0) AS n_passage_bytes
FROM b LEFT JOIN gone USING (r) LEFT JOIN passages USING (r)
"""
