"""Alignment of two tokenizers against loops over whole texts."""

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserapy.llm import crosstok

NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def both():
    return crosstok.tokenizers(crosstok.FOLDER, crosstok.FILE_A, crosstok.FILE_B)


def tokens(both, text):
    """(id, start, end) of both sides over the whole text, or None."""
    if not text:
        return None
    want, out = f" {text}".encode(), []
    for ids, of in ((both.a.encode(f" {text}", add_special_tokens=False).ids, both.bytes_a), (both.b.encode(text), both.bytes_b)):
        if b"".join(of[i] for i in ids) != want:
            return None
        side, place = [], 0
        for i in ids:
            side.append((i, place, place + len(of[i])))
            place += len(of[i])
        out.append(side)
    return out


def brute(both, texts):
    """Rows of NAMES by loops."""
    held, linked = [], Counter()
    for text in texts:
        found = tokens(both, text)
        if found is None:
            held.append(None)
            continue
        a, b = found
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, last = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(x[0]) for x in side if last < x[2] <= e) for side in (a, b)))
            last = e
        held.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        linked.update(set(links))
    most = defaultdict(int)
    for (i, _), n in linked.items():
        most[i] = max(most[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if h is None else (*h[:3], len(h[3]), sum(linked[x] == most[x[0]] for x in h[3]), sum(linked[x] for x in h[3]), h[4]) for h in held]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sZ \u00e99.\n\t \U0001f642\u4e2d -<>|\x1c\u00a0\u3000\u2028\u0085\u200b\u2013 "), max_size=40))
def test_parts_encode_like_the_whole(text):
    both = crosstok.tokenizers(crosstok.FOLDER, crosstok.FILE_A, crosstok.FILE_B)
    parts = [p for run in crosstok.parts_of(list(crosstok.runs(text, 7))).to_pylist() for p in run]
    assert " ".join(parts) == text
    a, b = both.encode(parts) if parts else ([], [])
    if text:
        assert [i for x in a for i in x] == both.a.encode(f" {text}", add_special_tokens=False).ids
        assert [i for x in b for i in x] == both.b.encode(text)


def test_memory_forgets_and_keeps(both):
    work, memory = crosstok.Aligner(both), crosstok.Memory(6)
    for words in (["ab", "cd,", "é"], ["cd,", "x▁", "中文"], ["ab", "q", "r", "s", "t", "cd,"], ["zz", "ab"], ["cd,", "ab", "s"]):
        got, want = memory.look(words, work.parts), work.parts(words)
        for one, two in zip(vars(got).values(), vars(want).values(), strict=True):
            assert one.tolist() == two.tolist()
        assert len(memory.place) == len(memory.parts.texts) <= 12
    work.close()


TEXTS = ["Hello world, hello!", None, "", " ", "a  b \n c", "naïve café 🙂🙂 中文字", "<|endoftext|> <s> <unk> </s>", "a▁b", "x" * 500, "Hello world, hello!", "tail ", "\ttab", "don't we'll  I'm", "the the the of of", "1234567 89"]


@pytest.mark.parametrize("part", [5, 200, crosstok.PART])
def test_alignment_equals_loops(spark, both, part):
    rows = [(k, t, k) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch int").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in crosstok.aligned(docs, part=part).collect()}
    assert got == dict(enumerate(brute(both, TEXTS)))


def test_groups_as_text_ids_and_empty_table(spark, both):
    docs = spark.createDataFrame([(None, "ab cd", 1), ("x", "ab cd", 2), ("x", "zz", 3)], "doc_id string, text string, pairs int")
    got = crosstok.align(docs, groups="text").collect()
    assert sorted(str(r["id"]) for r in got) == ["None", "x", "x"]
    want = dict(zip(["ab cd", "zz"], brute(both, ["ab cd", "zz"]), strict=True))
    assert sorted(hashlib.sha256(r["groups"].encode()).hexdigest() for r in got) == sorted([want["ab cd"][-1]] * 2 + [want["zz"][-1]])
    assert crosstok.aligned(docs.limit(0)).collect() == []


def test_pair_counts(spark, both):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    linked = Counter()
    for t in TEXTS:
        found = tokens(both, t)
        if found:
            linked.update({(x[0], y[0]) for x in found[0] for y in found[1] if x[1] < y[2] and y[1] < x[2]})
    got = {(r["id_a"], r["id_b"]): r["count"] for r in crosstok.pair_counts(crosstok.encode(docs, part=50)).collect()}
    assert got == linked


def test_query_equals_loops_on_whole_texts(spark, both, sf_dir):
    from tesserapy.llm import queries

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in queries.queries()["op12_crosstok"](spark, sf_dir).collect()}
    short = [r for r in rows if len(r["text"]) < 3000]
    want = dict(zip([r["doc_id"] for r in rows], fast(both, [r["text"] for r in rows]), strict=True))
    assert len(short) > 100 and got == want


def fast(both, texts):
    """As brute, with links found by two pointers instead of all pairs of tokens."""
    held, linked = [], Counter()
    for text in texts:
        a, b = tokens(both, text)
        links, k = [], 0
        for i, s, e in a:
            while b[k][2] <= s:
                k += 1
            j = k
            while j < len(b) and b[j][1] < e:
                links.append((i, b[j][0]))
                j += 1
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        sides = []
        for side in (a, b):
            cut, at = [[] for _ in ends], 0
            for i, _, e in side:
                while e > ends[at]:
                    at += 1
                cut[at].append(str(i))
            sides.append(cut)
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides, strict=True)]
        held.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        linked.update(set(links))
    most = defaultdict(int)
    for (i, _), n in linked.items():
        most[i] = max(most[i], n)
    return [(*h[:3], len(h[3]), sum(linked[x] == most[x[0]] for x in h[3]), sum(linked[x] for x in h[3]), h[4]) for h in held]
