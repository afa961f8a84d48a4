import random

import numpy as np
import xxhash
from folioscope.llm import simhash


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(prints):
    """[(doc_id, print)] -> component id by row."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprint():
    r = random.Random(1)
    texts = ["", " \n\t", None, "one", "One TWO three", "a b c d", "É é A b c d e", "x " * 3000] + [" ".join(r.choice(["ab", "Cd", "ef\n", "éG", "h"]) for _ in range(r.randrange(1, 400))) for _ in range(30)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_print(t)


def test_bit_counts_past_a_byte():
    h = np.full(70_000, 2**64 - 1, np.uint64)
    assert (simhash._bit_counts(h) == 70_000).all()


def test_every_linked_pair_meets_at_an_anchor():
    r = random.Random(2)
    for blocks in (2, 3):
        for _ in range(200):
            a = r.getrandbits(64)
            b = a
            for bit in r.sample(range(64), r.randrange(1, 5)):
                b ^= 1 << bit
            met = False
            for low, code in simhash.covers(blocks):
                v = [np.array([x >> low & ((1 << code.width) - 1)], np.uint64) for x in (a, b)]
                met |= code.home(v[0])[0] in code.reach(v[1])[1]
            assert met


def test_components_match_brute_force(spark):
    r = random.Random(3)
    prints, k = [], 0
    for _ in range(40):  # chains: neighbours are near, ends are not
        f = r.getrandbits(64)
        for _ in range(r.randrange(1, 6)):
            prints.append((k, f))
            k += 1
            for bit in r.sample(range(64), r.randrange(0, 5)):
                f ^= 1 << bit
    prints += [(None, prints[0][1]), (None, 12345), (500, 0), (501, 0), (501, 0)]
    for hot in (100_000, 2):
        for blocks in (2, 3):
            df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in {f for _, f in prints}], "f long")
            edges = simhash.links(df, blocks=blocks, hot=hot).collect()
            nodes = sorted({f for _, f in prints})
            root = {f: f for f in nodes}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for e in edges:
                a, b = e.a % 2**64, e.b % 2**64
                root[find(a)] = find(b)
            groups = brute_components([(i, f) for i, f in enumerate(nodes)])
            assert len({find(f) for f in nodes}) == len(set(groups))
            for i, f in enumerate(nodes):
                assert (find(f) == find(nodes[groups[i]]))


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [(5, base), (3, base), (9, base + " tail"), (1, "quite another text of some words"), (2, None), (4, ""), (None, base), (None, "alone with no key here"), (7, "x" * 50_000)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in texts], "doc_id long, text string, f string")
    got = sorted(((r.doc_id, r.f % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    prints = [(d, brute_print(t)) for d, t in texts]
    want = sorted(((d, f, c) for (d, f), c in zip(prints, brute_components(prints))), key=str)
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
