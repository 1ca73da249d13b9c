import re

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from feedlens.llm import simhash
from feedlens.llm.components import connected_components
from feedlens.llm.words import byte_slices, text_buffers, window_hashes, word_hashes, word_spans
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab éß \n\t\x1c ", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_spans_are_the_words_of_each_text(ts):
    data, offsets = text_buffers(pa.array(ts, pa.string()))
    s, e, first = word_spans(data, offsets)
    for i, t in enumerate(ts):
        got = [bytes(data[a:b]).decode() for a, b in zip(s[first[i]:first[i + 1]], e[first[i]:first[i + 1]])]
        assert got == WORD.findall(t or "")


def test_hashes_depend_on_words_alone():
    data, offsets = text_buffers(pa.array(["one two three one two", "x one two", "", "two one"]))
    s, e, first = word_spans(data, offsets)
    h = word_hashes(data, s, e)
    words = [bytes(data[a:b]) for a, b in zip(s, e)]
    assert len(set(words)) == len(set(h.tolist()))
    w = window_hashes(h, 2)
    assert w[0] == w[3] == w[6] != w[8]
    assert len(window_hashes(h, len(h) + 1)) == 0


def test_slices_hold_whole_texts():
    col = pa.array(["a" * 5, None, "b" * 50, "c"])
    assert byte_slices(col, 10) == [(0, 2), (2, 3), (3, 4)]


def brute_fingerprint(t):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, bits=3):
    ids = list(range(len(rows)))
    root = list(ids)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids[:i]:
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in ids:
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((r[0], f"{r[1]:016x}", least.get(find(i))) for i, r in enumerate(rows)), key=repr)


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    got = sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=repr)
    assert got == brute_components(rows)


def test_simhash_edges(spark):
    docs = spark.createDataFrame([(5, None), (3, ""), (4, " \n"), (7, "One  two"), (8, "one two"), (None, "one two"), (7, "One  two"),
                                  (9, "a b c d e f g " * 4000)], "doc_id long, text string").selectExpr("*", "1 as fp", "2 as root", "'x' as component_id")
    got = {tuple(r) for r in simhash.simhash_components(docs).collect()}
    zero = "0" * 16
    assert {(5, zero, 3), (3, zero, 3), (4, zero, 3)} <= got
    assert {r[2] for r in got if r[0] in (7, 8, None)} == {7} and (None, *[r for r in got if r[0] == 8][0][1:]) in got
    assert simhash.simhash_components(docs).count() == 8
    assert simhash.simhash_components(docs.limit(0)).collect() == []


def test_hot_groups_split_and_lose_no_link(spark):
    rng = np.random.default_rng(3)
    # chains of fingerprints around few centres: every key group is hot under a limit of 4
    values = set()
    for centre in rng.integers(0, 1 << 63, 3):
        x = int(centre)
        for _ in range(60):
            x ^= 1 << int(rng.integers(0, 64))
            values.add(x)
    values = sorted(values)
    rows = [(i, v) for i, v in enumerate(values)]
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for limit in (4, 4096):
        roots = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(simhash.hamming_links(nodes, group_limit=limit)).collect()}
        expected = brute_components(rows)
        groups = {}
        for i, h, c in expected:
            groups.setdefault(c, set()).add(int(h, 16))
        got = {}
        for v in values:
            got.setdefault(roots.get(v, v), set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7), (0, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(200)}}
