from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cohortspan.llm import langid, mixing, queries, simhash
from tests.llm.conftest import ODD, make
from tests.llm.test_linefreq import brute as brute_lines
from tests.llm.test_packing import check as check_packing
from tests.llm.test_simhash import brute_components, brute_print
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"


def test_names():
    names = list(entry.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{k}" for k in range(1, 14)]
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    got = queries.QUERIES[name](spark, SF_DIR).toPandas()
    assert differences(got, connect(SF_DIR).execute(queries.SQL[name]).df()) is None


def stages(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF_DIR).cache())
    return out


def test_each_stage_against_brute_force(spark, docs):
    rows = [f.collect() for f in stages(spark, docs)]
    documents, known, lines, single, mixed, packed = rows
    assert all(r.__fields__ == documents[0].__fields__ for stage in rows[1:-1] for r in stage[:1])
    # language: all of these documents have letters and a clear language
    assert sorted(known) == sorted(documents)
    # lines
    assert sorted(((r["doc_id"], r["text"]) for r in lines), key=repr) == brute_lines([(r["doc_id"], r["text"], r["source"]) for r in known])
    # near duplicates: the smallest id of each component
    ordered = sorted(lines, key=lambda r: r["doc_id"])
    low = brute_components([brute_print(r["text"]) for r in ordered])
    assert sorted(r["doc_id"] for r in single) == sorted({ordered[k]["doc_id"] for k in low})
    # mixture: as often as the report says
    report = {r["doc_id"]: r["uses"] for r in mixing.mix_report(spark.createDataFrame(single, docs.schema)).collect()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({k: n for k, n in report.items() if n})
    # packing
    check_packing([(r["doc_id"], r["text"]) for r in mixed], packed)


def test_planted_lines_go_in_all_sources_alike(spark):
    """A line on about a tenth of each source's documents goes, also just below; one on 4 to 5 % stays."""
    rows = []
    for source, planted, copied in (("a", 9, 4), ("b", 10, 5), ("c", 13, 4)):
        for i in range(100):
            extra = ["the planted line"] * (i < planted) + ["a copied line"] * (i >= 100 - copied)
            rows.append((len(rows), "\n".join([f"own {source} {i}", *extra]), "en", source))
    texts = [r["text"] for r in corpus_pipeline.lines(spark, make(spark, rows), SF_DIR).collect()]
    assert len(texts) == 300 and not any("planted" in t for t in texts)
    assert sum("copied" in t for t in texts) == 13 and all("own" in t for t in texts)


def test_run_gives_the_last_stage(spark, docs):
    kept = lambda rows: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert kept(corpus_pipeline.run(spark, SF_DIR).collect()) == kept(stages(spark, docs)[-1].collect())


def test_odd_and_empty_tables(spark, odd, empty):
    frames = [odd]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frames.append(stage(spark, frames[-1], SF_DIR))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert frames[-1].columns == odd.columns
    assert frames[1].count() == sum(r[1] is not None and langid.has_letter(r[1]) for r in ODD)
    assert frames[-1].count() > 0
    for frame in stages(spark, empty)[1:]:
        assert frame.count() == 0


def test_clean_documents_stay(spark, docs):
    """A document that is like no other and repeats no line passes every filter unchanged."""
    ids = {r["doc_id"] for r in simhash.near_duplicates(docs).collect()}
    known, lines, single = stages(spark, docs)[1:4]
    assert {r["doc_id"] for r in known.collect()} == ids
    groups = {r["component_id"] for r in simhash.near_duplicates(lines).collect()}
    assert {r["doc_id"] for r in single.collect()} == groups
