"""Periodic runs against quadratic definitions of Lyndon words and of runs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from feedlens.llm.periodic import find_runs, lyndon_lengths, runs_of
from feedlens.llm.queries import op13_periodic_runs
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_lyndon(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


def slow_runs(s, least=12):
    out = set()
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, 2 * q) and not any(s[i:i + size - d] == s[i + d:i + size] for d in range(1, q)):
                out.add((i, q, size))
            i = j + 1
    return [(a, size, q) for a, q, size in sorted(out)]


def collapse(words, runs):
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_lyndon_arrays_and_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(800):
        k, n = rng.randint(1, 4), rng.randint(1, 40)
        raw = [rng.randrange(k) for _ in range(n)]
        name = {c: i for i, c in enumerate(sorted(set(raw)))}
        s = [name[c] for c in raw]
        assert lyndon_lengths(s, len(name)) == slow_lyndon(s)
        for least in (2, 7, 12):
            assert [tuple(r) for r in runs_of(np.array(s), least).tolist()] == slow_runs(s, least)


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


@pytest.mark.parametrize("words", [["a"] * 3000, list("abaab" * 500), [str(x) for x in thue_morse(2048)],
                                   [str(i) for i in range(3000)] + [str(i) for i in range(3000)]])
def test_long_regular_texts(spark, words):
    row = find_runs(spark.createDataFrame([(" ".join(words),)], "text string")).first()
    want = slow_runs(words) if len(set(words)) < 10 else [(0, 6000, 3000)]
    assert [tuple(r) for r in row["runs"]] == want
    assert row["collapsed_text"] == collapse(words, want)


def test_defined_cases(spark):
    rows = [(1, None, 5), (2, "", 6), (3, " \t\n", 7), (4, "a b " * 6, None), (4, "a b " * 6, None), (None, "é x " * 12, 1),
            (5, "a b " * 5 + "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed_text"]) for r in find_runs(docs).collect())
    assert got == [(0, 12, [(0, 12, 1)], "é x"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 12, [(0, 12, 2)], "a b"),
                   (4, 12, [(0, 12, 2)], "a b"), (5, 11, [], "a b a b a b a b a b a")]
    assert find_runs(docs).columns == ["doc_id", "text", "n_words", "runs", "collapsed_text"]
    assert find_runs(docs.filter("false")).collect() == []
    assert [c for c in find_runs(docs.select("text")).columns] == ["text", "n_words", "runs", "collapsed_text"]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    checked = 0
    for d in docs:
        words = WORD.findall(d["text"] or "")
        h = zlib.crc32(str(d["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 1500:
            continue  # the definition is cubic
        checked += 1
        runs, r = slow_runs(words), got[d["doc_id"]]
        lines = "".join(f"{a},{size},{q}\n" for a, size, q in runs)
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
        best = min(runs, key=lambda t: (-t[1], t[0], t[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want
    assert checked > 150
