"""Periodic runs of words: Lyndon arrays by suffix grouping, Lyndon roots extended into runs.

A run is a maximal stretch of consecutive words with smallest period q and at least two periods.
Every run holds a root: the longest Lyndon word that starts at one of its positions, under the
order of the words or under its inverse. So the Lyndon arrays of both orders name every run.

Method. Phase one of Baier's suffix sorter groups suffixes by their first word and treats the
groups from the greatest down; each suffix of a group passes its context to the next suffix to
its left in a lower group, which moves on into a new group right above its old one. When all
groups are treated, the length of a suffix's context is its longest Lyndon prefix; no suffix array
is built. Roots are then extended to both sides by longest common extensions, for all positions
at once, over exact names of all stretches of 2^k words.

A run of ``least`` words or more repeats, ``q`` words later, every window of ``least / 2`` words
that it starts with, and such windows cover it whole. So only stretches covered by windows that
occur twice in their text are grouped; windows compare by 64-bit hashes, and equal hashes of
different windows only add work. Words themselves are compared exactly.

Layout. One pass over the rows, no shuffle. A task holds one slice of at most 4 MiB of text, or
one longer text: 4 bytes a word for each power of two up to the longest stretch.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text. Runs may
overlap, and a word is dropped if any run holds it past that run's first period. Repeated rows
give equal rows. An empty table stays empty. Columns n_words, runs and collapsed_text replace
input columns of the same name; all other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.words import sliced, text_buffers, window_hashes, word_hashes, word_spans

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def lyndon_lengths(letters: list[int], n_letters: int) -> list[int]:
    """Length of the longest Lyndon word starting at each position, for letters 0..n_letters - 1.

    ``left[i]`` skips suffixes of treated groups on the way to the next one of a lower group.
    Groups are a linked list; a suffix that moved on stays in its old member list, where it no
    longer counts.
    """
    n = len(letters)
    members: list[list[int]] = [[] for _ in range(n_letters)]
    for i, c in enumerate(letters):
        members[c].append(i)
    group, length, left, treated = list(letters), [1] * n, list(range(-1, n - 1)), [False] * n
    above, below = list(range(1, n_letters + 1)), list(range(-1, n_letters - 1))
    above[-1:] = [-1]
    g = n_letters - 1
    while g >= 0:
        here = [i for i in members[g] if group[i] == g]
        members[g] = []
        for i in here:
            treated[i] = True
        told: dict[int, int] = {}  # suffix of a lower group -> how many of this group point to it
        for i in here:
            j = left[i]
            while j >= 0 and treated[j]:
                k = left[j]
                left[i] = k
                if k >= 0 and treated[k]:
                    left[j] = left[k]
                j = k
            left[i] = j
            if j >= 0:
                told[j] = told.get(j, 0) + 1
        if told:
            context, made = length[here[0]], {}
            for j, times in sorted(told.items(), key=lambda t: -t[1]) if len(told) > 1 else told.items():
                old = group[j]
                new = made.get((old, times))
                if new is None:
                    new = made[old, times] = len(members)
                    over = above[old]
                    members.append([])
                    above.append(over)
                    below.append(old)
                    above[old] = new
                    if over >= 0:
                        below[over] = new
                group[j] = new
                members[new].append(j)
                length[j] += times * context
        g = below[g]
    return length


def _names(letters: np.ndarray, longest: int) -> list[np.ndarray]:
    """Level k holds one number per stretch of 2^k letters, equal for equal stretches only."""
    levels, span = [letters.astype(np.int32)], 1
    while 2 * span <= longest:
        last = levels[-1]
        pairs = last[:-span].astype(np.int64) * (int(last.max()) + 1) + last[span:]
        levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
        span *= 2
    return levels


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """Number of equal letters from a[i] and b[i] on rightwards (step 1), or ending there (-1)."""
    n, got = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        span, name = 1 << k, levels[k]
        while True:  # once a level, but for the top one
            x, y = (a + got, b + got) if step > 0 else (a - got - span + 1, b - got - span + 1)
            ok = (x >= 0) & (y >= 0) & (x + span <= n) & (y + span <= n)
            ok[ok] = name[x[ok]] == name[y[ok]]
            got[ok] += span
            if k < len(levels) - 1 or not ok.any():
                break
    return got


def runs_of(letters: np.ndarray, least: int) -> np.ndarray:
    """(start, length, period) of all runs of at least ``least`` letters and two periods, by start
    and period. Negative letters separate: each occurs once."""
    _, ids = np.unique(letters, return_inverse=True)
    top = int(ids.max()) + 1
    word = letters >= 0
    edges = np.flatnonzero(~np.concatenate([[False], word, [False]]))
    levels, at, found = _names(ids, int(np.diff(edges).max()) - 1), np.arange(len(ids)), []
    for order in (ids, top - 1 - ids):
        period = np.asarray(lyndon_lengths(order.tolist(), top), np.int64)
        i = at[word & (at + period < len(ids))]
        p = period[i]
        right, left = _common(levels, i, i + p, 1), _common(levels, i - 1, i + p - 1, -1)
        whole = p + right + left
        keep = whole >= np.maximum(least, 2 * p)
        found.append(np.stack([(i - left)[keep], p[keep], whole[keep]], 1))
    out = np.unique(np.concatenate(found), axis=0)
    return out[:, [0, 2, 1]]


def _repeated(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window of ``width`` words that occurs twice in its text."""
    n = len(hashes)
    windows = window_hashes(hashes, width)
    at = np.arange(len(windows))
    text = np.searchsorted(first, at, "right") - 1
    at = at[at + width <= first[text + 1]] if len(at) else at
    order = at[np.lexsort((windows[at], text[at]))]
    same = (windows[order][1:] == windows[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, order[twice], 1)
    np.add.at(edge, order[twice] + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _batch_runs(column: pa.Array, least: int):
    """(words of each text, (text, start, length, period) of all runs, collapsed texts)."""
    data, offsets = text_buffers(column)
    starts, ends, first = word_spans(data, offsets)
    n_words = np.diff(first)
    covered = _repeated(word_hashes(data, starts, ends), first, least // 2) if len(starts) else np.zeros(0, bool)
    raw, runs = data.tobytes(), np.zeros((0, 4), np.int64)
    if covered.any():
        at = np.flatnonzero(covered)
        text = np.searchsorted(first, at, "right") - 1
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(text) > 0)]))
        known: dict[bytes, int] = {}
        letters = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(starts[at].tolist(), ends[at].tolist())),
                              np.int64, len(at))
        place = np.arange(len(at)) + np.searchsorted(begins, np.arange(len(at)), "right")
        line = -1 - np.arange(len(at) + len(begins))  # a separator before each stretch
        line[place] = letters
        back = np.full(len(line), -1)
        back[place] = at
        found = runs_of(line, least)
        word = back[found[:, 0]]
        doc = np.searchsorted(first, word, "right") - 1
        runs = np.column_stack([doc, word - first[doc], found[:, 1:]])
    gone = np.zeros(len(starts) + 1, np.int64)
    if len(runs):
        base = first[runs[:, 0]] + runs[:, 1]
        np.add.at(gone, base + runs[:, 3], 1)
        np.add.at(gone, base + runs[:, 2], -1)
    gone = np.cumsum(gone)[:-1] > 0
    lost = np.bincount(np.searchsorted(first, np.flatnonzero(gone), "right") - 1, minlength=len(n_words))
    texts = []
    for d in range(len(n_words)):
        words = raw[offsets[d]:offsets[d + 1]].split()  # bytes.split() knows these separators only
        if lost[d]:
            words = [w for w, g in zip(words, gone[first[d]:first[d + 1]].tolist()) if not g]
        texts.append(b" ".join(words).decode())
    return n_words, runs, texts


def find_runs(docs: DataFrame, text_col: str = "text", least: int = 12) -> DataFrame:
    """Adds n_words, runs (by start, then period) and collapsed_text to ``docs``; a run has at
    least ``least`` words and two periods."""
    made = ("n_words", "runs", "collapsed_text")
    rest = [c for c in docs.columns if c not in made and c != text_col]
    row = F.struct(*[docs[c] for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    slim = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = f"row {slim.schema['row'].dataType.simpleString()}, text string, n_words bigint, runs {RUN}, collapsed_text string"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def task(batches):
        for batch in sliced(batches, "text"):
            n_words, runs, texts = _batch_runs(batch.column(batch.schema.get_field_index("text")), least)
            runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
            offsets = np.searchsorted(runs[:, 0], np.arange(len(n_words) + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(run_type.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in ("row", "text")] + [
                 pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), items), pa.array(texts, pa.string())],
                names=["row", "text", "n_words", "runs", "collapsed_text"])

    out = slim.mapInArrow(task, schema)
    text = [F.col("text").alias(text_col)] if text_col not in made else []
    return out.select(*[F.col("row").getField(c).alias(c) for c in rest], *text, *made)


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stand-in input of op13: with h = crc32(id), in texts of h % 10 = 0 the words from a on
    repeat the p words from a, joined by one space (a, p as in the query's contract)."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(w):
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda k: F.get(w, (a + k % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a.cast("int")), tail), " "))

    # a one-row transform names the word array, so that it is split once
    made = F.get(F.transform(F.array(words), planted), F.lit(0))
    return docs.withColumn(text_col, F.when(h % 10 == 0, made).otherwise(F.col(text_col)))
