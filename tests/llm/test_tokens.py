import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortspan.llm import tokenfile
from cohortspan.llm.tokens import END_ID, Encoder, tokenizer_path
from tests.llm.conftest import LONG, ODD, make

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH, chunks=50, pieces=50)  # small, so that both generations turn over


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids + [END_ID]


def test_ids_of_whole_texts(plain, encoder, corpus):
    assert encoder.quick
    for text in [t for _, t, *_ in corpus] + [t for _, t, *_ in ODD] + [
        "a<|endoftext|>b <|startoftext|>", "it's O'REILLY'S don't'll x'ss ''s", "İstanbul ΣΑΣ ﬁ ſtraße ÷× ½²ªº ١٢", "日本語 テスト　x\x1cq", "a\x0bb\x0cc\x85d", "é ́x",
    ]:
        assert np.frombuffer(encoder.encode(text.encode() if text is not None else None), "<u4").tolist() == ids_of(plain, text)


@given(st.text(alphabet=st.sampled_from("aZé'sßÿ   \t.,!1٣́İΣ<|>日"), max_size=24))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_text(plain, encoder, text):
    assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == ids_of(plain, text)


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=2000), st.data())
@settings(max_examples=60, deadline=None)
def test_codes_give_any_token(ids, data):
    codes = tokenfile.Codes(tokenfile.encode(np.array(ids, "<u4")))
    assert len(codes) == len(ids)
    for i in data.draw(st.lists(st.integers(0, max(0, len(ids) - 1)), max_size=10)) if ids else []:
        assert codes[i] == ids[i]
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert codes.slice(a, b).tolist() == ids[a:b]


def test_single_tokens_of_a_large_segment():
    ids = np.random.default_rng(5).integers(0, 70_000, 50_000).astype("<u4")
    codes = tokenfile.Codes(tokenfile.encode(ids))
    assert len(codes.levels) == 3
    assert [codes[i] for i in range(0, 50_000, 701)] == ids[::701].tolist()
    assert len(tokenfile.encode(ids)) < 0.75 * ids.nbytes
    with pytest.raises(IndexError):
        codes[50_000]


def brute(plain, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        blob = np.array(ids_of(plain, text), "<u4")
        out.append((doc_id, start, len(blob), zlib.crc32(blob.tobytes())))
        start += len(blob)
    return sorted(out, key=repr)


def test_round_trip(docs, corpus, plain):
    got = sorted(map(tuple, tokenfile.round_trip(docs).collect()), key=repr)
    assert got == brute(plain, [(i, t) for i, t, *_ in corpus])


def test_round_trip_of_odd_rows(odd, empty, plain):
    got = sorted(map(tuple, tokenfile.round_trip(odd).collect()), key=repr)
    assert got == brute(plain, [(r[0], r[1]) for r in ODD])
    assert tokenfile.round_trip(empty).count() == 0


def test_small_segments(spark, tmp_path, plain):
    rows = [(i, f"text number {i} " * (i % 5)) for i in range(40)] + [(100, LONG[:20_000])]
    path = str(tmp_path / "file")
    tokenfile.write(make(spark, rows), path, PATH, segment=30)
    assert spark.read.parquet(path).count() > 5
    assert sorted(map(tuple, tokenfile.read(spark, path).collect()), key=repr) == brute(plain, rows)
