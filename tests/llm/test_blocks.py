import hashlib
import random
import re

import pytest

from cohortspan.llm import blocks
from tests.llm.conftest import ODD, make


def brute(rows):
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        body = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups.setdefault(body, []).append((doc_id is None, doc_id or 0, k))
    out = []
    for body, members in groups.items():
        first = min(members)
        for m in members:
            keep = None if first[0] else first[1]
            out.append((None if m[0] else m[1], keep, len(members), hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(rows, got):
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute(rows)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("block", [1, 3, 8, 1 << 14])
def test_made_up_texts(spark, block):
    rng = random.Random(block)
    rows = [(i, "".join(rng.choice("ab é") for _ in range(rng.randrange(0, 9)))) for i in range(150)]
    rows += [(i + 200, "x" * n) for i, n in enumerate([7, 8, 9, 15, 16, 17, 16, 8, 7])]
    check(rows, blocks.exact_duplicates(make(spark, rows).repartition(3), block=block).collect())


def test_documents(docs, corpus):
    check([(i, t) for i, t, *_ in corpus], blocks.exact_duplicates(docs).collect())


def test_long_texts_of_many_blocks(spark):
    base = "".join(chr(97 + i * i % 26) for i in range(20_000))
    rows = [(1, base), (2, base[:-1] + "!"), (3, "!" + base[1:]), (4, base), (5, base + base), (6, base + base), (7, base + "?" + base)]
    check(rows, blocks.exact_duplicates(make(spark, rows), block=64).collect())


def test_odd_rows(odd, empty):
    check([(r[0], r[1]) for r in ODD], blocks.exact_duplicates(odd).collect())
    assert blocks.exact_duplicates(empty).count() == 0
