import random

import numpy as np
import pytest
import xxhash

from tesserapy.llm import simhash


def slow(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a B c", "A b\tc d\ne é É f", "x " * 500, "Straße\u00a0und\u2003mehr Wörter hier im Text"])
def test_fingerprint_equals_the_definition(text):
    assert simhash.fingerprint(text) == slow(text)


def components(fps, radius=4):
    ids = sorted(fps)
    home = {i: i for i in ids}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                home[y] = x
    return {i: root(i) for i in ids}


def test_links_keep_every_component(spark):
    """Random values, chains of small steps and one dense group, against all pairs."""
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(8):
        x = rng.getrandbits(64)
        for _ in range(6):
            values.append(x)
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
    centre = rng.getrandbits(64)
    loose = rng.sample(range(64), 12)
    values += [centre ^ sum(1 << b for b in rng.sample(loose, rng.randrange(0, 6))) for _ in range(400)]
    values = sorted(set(values))
    fps = dict(enumerate(values))
    signed = [simhash._signed(v) for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    pairs = edges.collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 4 for r in pairs)
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    mine = {}
    for k, v in enumerate(signed):
        mine.setdefault(found.get(v, v), []).append(k)
    want = {}
    for k, c in components(fps).items():
        want.setdefault(c, []).append(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_forest_reaches_what_all_pairs_reach():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 14, 600, dtype=np.uint64))
    got = {int(v): int(v) for v in values}

    def root(i):
        while got[i] != i:
            i = got[i]
        return i

    for a, b in simhash._forest(values, 1):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            got[max(root(x), root(y))] = min(root(x), root(y))
    want = components({int(v): int(v) for v in values}, 1)
    assert {v: root(v) for v in got} == want


def test_cluster_and_dedup(spark):
    base = " ".join(f"word{k}" for k in range(400))
    rows = [(3, base, 0), (2, base, 0), (9, base.upper(), 0), (4, None, 0), (5, "", 0), (6, "   ", 0), (7, "other text here now", 0), (None, "lonely words that stand alone", 0), (2, base, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.hex_fingerprints(simhash.cluster(df)).collect())
    assert len(got) == 9
    by = {d: (f, c) for d, f, c in got}
    assert by["3"][1] == by["9"][1] == by["2"][1] == "2" and by["4"] == by["5"] == by["6"] == ("0" * 16, "4") and by["7"][1] == "7" and by["None"][1] == "None"
    assert by["3"][0] == f"{slow(base):016x}"
    kept = sorted(str(r["doc_id"]) for r in simhash.near_dedup(df).collect())
    assert kept == ["2", "4", "7", "None"]
    assert simhash.cluster(df.limit(0)).count() == 0


def test_near_groups_catch_copies_and_leave_others(spark):
    """Copies with a few words changed, one large group of them, and texts of the same words in another order."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    bases = [[rng.choice(words) for _ in range(200)] for _ in range(12)]
    rows = [(k, " ".join(b)) for k, b in enumerate(bases)]
    for n in range(40):
        copy = list(bases[0])
        copy[rng.randrange(200)] = f"new{n}"
        rows.append((100 + n, " ".join(copy)))
    for k in range(1, 6):
        copy = list(bases[k])
        copy[50] = "other"
        rows.append((200 + k, " ".join(copy).upper()))
    order = list(bases[7])
    rng.shuffle(order)
    rows += [(300, " ".join(order)), (301, "few words"), (302, "few words"), (303, "few other"), (None, rows[1][1]), (304, None), (305, ""), (306, "x " * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(df).collect()}
    want = {i: i for i, _ in rows} | {100 + n: 0 for n in range(40)} | {200 + k: k for k in range(1, 6)} | {302: 301, None: 1, 305: 304}
    assert got == want
    assert {r["doc_id"] for r in simhash.near_dedup(df).collect()} == {i for i, g in want.items() if i == g}
    assert simhash.near_groups(df.limit(0)).count() == 0


def brute_groups(rows, shingle=5, similarity=0.8):
    """Smallest id of each component over all pairs by their shingles alone."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))}
    home = {i: i for i in sets}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                home[y] = x
    return {i: root(i) for i in ids}


def edited(rng, words, n, tag):
    out = list(words)
    for k, at in enumerate(rng.sample(range(len(out)), n)):
        out[at] = f"{tag}e{k}"
    return out


def test_near_groups_lose_no_pair_of_a_large_family(spark):
    """Twins within a family whose other members are alike in their fingerprints, but below the similarity."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for k in range(350):
        one = edited(rng, base, 8, f"m{k}")
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(edited(rng, one, 2, f"t{k}")))]
    want = brute_groups(rows)
    assert len(set(want.values())) > 300 and all(want[2 * k + 1] == want[2 * k] for k in range(350))
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_groups_are_those_of_the_similarity_alone(spark):
    """Text appended, cut off or a block replaced: fingerprints lie far apart."""
    rng = random.Random(8)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 200))]
        more = [f"x{rng.randrange(10**6)}" for _ in range(len(base) * rng.randrange(5, 30) // 100)]
        block = [*base[: len(base) // 2], *more, *base[len(base) // 2 + len(more) // 2 :]]
        rows += [(4 * k, " ".join(base)), (4 * k + 1, " ".join(base + more)), (4 * k + 2, " ".join(base[: len(base) - len(more) // 2])), (4 * k + 3, " ".join(block))]
    want = brute_groups(rows)
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_dedup_keeps_different_texts_under_null_or_repeated_ids(spark):
    texts = [" ".join(f"{x}{k}" for k in range(60)) for x in "abcde"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1] + " more"), (1, texts[2]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (5, texts[4])]
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted((str(r["doc_id"]), r["text"][:2]) for r in got)
    assert kept == [("1", "c0"), ("5", "d0"), ("5", "e0"), ("None", "a0"), ("None", "b0")]


def test_near_dedup_keeps_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(1, text, 7, "a", "b", 8), (2, text, 9, "c", "d", 10), (3, None, 1, "e", "f", 2)], "doc_id long, text string, k1 int, d1 string, __k1 string, id int")
    out = simhash.near_dedup(df)
    assert out.columns == df.columns and sorted((r["doc_id"], r["k1"], r["id"]) for r in out.collect()) == [(1, 7, 8), (3, 1, 2)]


def test_long_texts_and_no_rows(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(150_000))
    rows = [(1, long), (2, long + " more"), (3, long.replace("w1", "v1")), (4, "short one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.cluster(df).collect()}
    assert got[2] == got[1] == 1 and got[4] == 4
    assert {r["doc_id"]: r["group_id"] for r in simhash.near_groups(df).collect()}[2] == 1
    assert simhash.cluster(df.limit(0)).count() == 0 and simhash.near_dedup(df.limit(0)).count() == 0


def test_sketches_never_rule_out_a_near_copy():
    """Sketches differ in no more bits than the sets of shingles."""
    rng = random.Random(3)
    for n in (3, 40, 400):
        a = [f"w{rng.randrange(50)}" for _ in range(n)]
        b = edited(rng, a, n // 6, "x")
        one, two = (simhash.near_marks(" ".join(t), 5) for t in (a, b))
        assert one[: len(simhash.SEEDS)] == [simhash._signed(simhash.word_fingerprint(" ".join(a), s)) for s in simhash.SEEDS]
        apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(one[len(simhash.SEEDS) : -1], two[len(simhash.SEEDS) : -1], strict=True))
        assert one[-1] == len(simhash.shingle_hashes(" ".join(a), 5))
        assert apart <= len(set(simhash.shingle_hashes(" ".join(a), 5).tolist()) ^ set(simhash.shingle_hashes(" ".join(b), 5).tolist()))


def test_cluster_with_clashing_columns_and_a_long_text(spark):
    long = " ".join(f"w{k}" for k in range(120_000))
    rows = [(4, long, 1, "p", 2.0), (3, long + " end", 2, "q", 3.0), (8, "something else", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int, node string, fp double").withColumnRenamed("node", "a.b")
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash.cluster(docs).collect()) == [(3, 3), (4, 3), (8, 8)]
