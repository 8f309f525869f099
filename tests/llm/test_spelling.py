import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspan.llm import fmindex, spelling
from tests.llm.conftest import ODD, make

NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def brute_words(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_near(vocab):
    """Near words by shared deletions, each pair checked."""
    shared = defaultdict(set)
    for w in vocab:
        for key in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            shared[key].add(w)
    near = {w: set() for w in vocab}
    for group in shared.values():
        for a in group:
            near[a] |= {b for b in group if b not in near[a] and one_edit(a, b)}
    return near


def brute(vocab):
    form, out = {}, []
    near = brute_near(vocab)
    for w, n in vocab.items():
        best = min(near[w], key=lambda b: (-vocab[b], b), default=None)
        form[w] = best if best is not None and vocab[best] >= 5 * n else None
    for w, n in vocab.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), vocab[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    assert df.columns == NAMES
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_brute_force_itself(seed):
    rng = random.Random(seed)
    vocab = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))): 5 for _ in range(30)}
    assert brute_near(vocab) == {w: {v for v in vocab if one_edit(w, v)} for w in vocab}


@given(st.sets(st.text(alphabet="abé😀", min_size=4, max_size=4), max_size=30), st.lists(st.text(alphabet="abéx😀", min_size=4, max_size=4), max_size=8), st.booleans())
@settings(max_examples=150, deadline=None)
def test_one_error(words, asked, insert):
    asked = [a[:3] if insert else a for a in asked]
    index = fmindex.Index(sorted(words))
    points = np.frombuffer("".join(asked).encode("utf-32-le"), "<u4").reshape(len(asked), -1) if asked else np.zeros((0, 3), "<u4")
    rows, hits = index.one_error(index.codes(points), insert)
    got = sorted((int(r), index.words[h]) for r, h in zip(rows, hits))
    assert got == sorted((i, w) for i, a in enumerate(asked) for w in words if one_edit(a, w))


def test_both_directions_keep_in_step():
    """A pattern grown on either side has the same range in the text."""
    words = sorted({"".join(w) for w in itertools.product("abc", repeat=4)})
    index = fmindex.Index(words)
    symbols = index.codes(np.frombuffer("bca".encode("utf-32-le"), "<u4"))
    by_order = []
    for order in ([0, 1, 2], [1, 0, 2], [1, 2, 0], [2, 1, 0]):
        at = fmindex.Ranges(*(np.array([x]) for x in (0, 0, len(index.left))))
        for k, place in enumerate(order):
            at = index.extend(at, symbols[place:place + 1], k > 0 and place > max(order[:k]))
        by_order.append((int(at.low[0]), int(at.reverse[0]), int(at.size[0])))
    assert len(set(by_order)) == 1 and by_order[0][2] == sum(w.count("bca") for w in words)


@given(st.lists(st.integers(0, 6), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_suffixes_and_counts(text):
    text = np.array([x + 1 for x in text] + [0])
    order = fmindex.suffix_order(text)
    assert [list(text[i:]) for i in order] == sorted(list(text[i:]) for i in range(len(text)))
    wave = fmindex.Wavelet(text, 8)
    for symbol in range(8):
        low, high = len(text) // 3, 2 * len(text) // 3 + 1
        got = wave.count(np.array([symbol]), np.array([low]), np.array([high]))
        part = text[low:high]
        assert [int(x[0]) for x in got] == [(text[:low] == symbol).sum(), (part == symbol).sum(), (part < symbol).sum()]


def test_documents_against_brute_force(docs, corpus):
    want = brute(brute_words((i, t) for i, t, *_ in corpus))
    assert rows_of(spelling.spelling_variants(docs)) == want
    assert sum(r[1] is not None for r in want) > 5


def test_parts(spark):
    """Words of one length over several index and query parts."""
    rng = random.Random(2)
    vocab = {"".join(rng.choice("abcd") for _ in range(rng.randint(6, 8))): rng.choice([5, 6, 30, 200, 2000]) for _ in range(700)}
    table = spark.createDataFrame(list(vocab.items()), "word string, n long")
    want = brute(vocab)
    assert rows_of(spelling.grouped(table, part=600)) == want
    assert rows_of(spelling.grouped(table)) == want
    assert any(r[1] != r[2] and r[1] for r in want)


def test_long_words_chains_and_ties(spark):
    long = "z" * 3000 + "y" * 3000
    vocab = {long: 100, long[1:]: 5, long + "z": 7, "abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abcihg": 625, "jbcihg": 3125, "abcdei": 25}
    assert rows_of(spelling.grouped(spark.createDataFrame(list(vocab.items()), "word string, n long"))) == brute(vocab)


def test_slips(spark):
    """Long documents of one word, so that some lose each code point."""
    rows = [(i, "Straße Éternel " * 3) for i in range(3000)] + [(None, "Straße"), (None, None)]
    assert rows_of(spelling.spelling_variants(make(spark, rows))) == brute(brute_words(rows))


def test_odd_rows(odd, empty):
    assert rows_of(spelling.spelling_variants(odd)) == brute(brute_words((r[0], r[1]) for r in ODD))
    assert rows_of(spelling.spelling_variants(empty)) == []
