import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from folioscope.llm import packing
from folioscope.llm.wordbpe import WordBpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", None, "  \n\t ", "don't stop's ... ,, I'll", "ÀÉ Σίγμα ΣΑΣ İstanbul ŉ ǅ ß ﬁ", "\x00 a\x0bb\x1cc\x85d e　f", "12ab 3.14 x2y", "<|endoftext|> <|ENDOFTEXT|>x <|startoftext|>", "é x café… naïve!!", "中文 हिन्दी 한국어", "''s don''t x'sy it's, it's.'", "a" * 5000 + " b", "x" * 50 + "!", "ab%%% cd*** ef### |x|", "😀😀 👩‍👩‍👧", "hello,world hello,", "́ é ÁB"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers_own(reference):
    r = random.Random(12)
    letters = "aabcdeefghiiklmnooprssttuéäßñ"
    texts = HARD + [" ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 25))).capitalize() + r.choice(["", "", ",", ".", "?!", "'s", "2"]) for _ in range(r.randrange(0, 300))) for _ in range(60)]
    bpe = WordBpe(PATH)
    for _ in range(2):  # with and without a memo
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_all(texts)] == [reference(t) for t in texts]


def test_memo_is_bounded(reference, monkeypatch):
    from folioscope.llm import wordbpe

    monkeypatch.setattr(wordbpe, "MEMO", 50)
    bpe = WordBpe(PATH)
    for i in range(40):
        text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + j % 26)}" + "q" * (i % 5) for j in range(30)) + " hello, the of and"
        assert np.frombuffer(bpe.encode_all([text])[0], "<u4").tolist() == reference(text)
        assert len(bpe.memo) < 150


def slow_best_fit(lengths, capacity, open_bins):
    bins, out = [], []
    made = 0
    for n in lengths:
        fits = [b for b in bins if b[1] >= n]
        if fits:
            low = min(b[1] for b in fits)
            b = [b for b in fits if b[1] == low][-1]
            bins.remove(b)
        else:
            if len(bins) >= open_bins:
                low = min(b[1] for b in bins)
                bins.remove([b for b in bins if b[1] == low][-1])
            b = [made, capacity]
            made += 1
        out.append((b[0], capacity - b[1]))
        b = [b[0], b[1] - n]
        if b[1]:
            bins.append(b)
    return out


@pytest.mark.parametrize("open_bins", [1, 3, 50])
def test_best_fit(open_bins):
    r = random.Random(13)
    lengths = [r.randrange(1, 65) for _ in range(2000)]
    p = packing.BestFit(64, open_bins)
    assert [p.place(n) for n in lengths] == slow_best_fit(lengths, 64, open_bins)


def test_pieces(spark, reference):
    texts = HARD + ["word " * n for n in (10, 4094, 4095, 4096, 8191, 8192, 20_000)] + ["tail words"] * 5
    df = spark.createDataFrame([(i if i % 5 else None, t, 1) for i, t in enumerate(texts)] + [(1, texts[1], 1)], "doc_id long, text string, piece int").repartition(3)
    rows = packing.pack(df, "doc_id", "text", PATH, with_ids=True).collect()
    bins, docs = {}, {}
    for r in rows:
        ids = packing.token_ids(bytes(r.ids))
        assert len(ids) == r.length <= 4096 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.piece, r.start, ids.tolist()))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    for i, t in enumerate(texts):
        if i % 5 and i != 1:
            parts = sorted(docs[i])
            assert sum((p[2] for p in parts), []) == reference(t) + [1]
            assert [p[0] for p in parts] == list(range(len(parts))) and all(len(p[2]) == 4096 for p in parts[:-1])
            assert [p[1] for p in parts] == [4096 * k for k in range(len(parts))]
    assert len(docs[1]) == 2
    assert packing.pack(df.limit(0), "doc_id", "text", PATH).count() == 0
