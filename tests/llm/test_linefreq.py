import re

from pyspark.sql import functions as F

from cohortspan.llm import linefreq
from tests.llm.conftest import ODD, make


def bare(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)


def brute(rows, max_ratio=0.1, min_pages=3):
    """(doc_id, text, site) -> what stays of each text."""
    total, pages = {}, {}
    for _, text, site in rows:
        total[site] = total.get(site, 0) + 1
        for line in {bare(x) for x in (text or "").split("\n")} - {""}:
            pages[site, line] = pages.get((site, line), 0) + 1
    bad = {k for k, n in pages.items() if n >= min_pages and n / total[k[0]] > max_ratio}
    return sorted(
        ((i, None if t is None else "\n".join(x for x in t.split("\n") if (s, bare(x)) not in bad)) for i, t, s in rows), key=repr
    )


def got(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_documents(docs, corpus):
    rows = [(i, t, s) for i, t, _, s in corpus]
    assert got(linefreq.drop_lines(docs)) == brute(rows)
    assert got(linefreq.drop_lines(docs, max_ratio=0.5, min_pages=2)) == brute(rows, 0.5, 2)
    assert sum(r["n_dropped"] for r in linefreq.line_report(docs).collect()) > 0


def test_sites_lines_and_ties(spark):
    rows = []
    for i in range(60):
        site = [None, "", "a", "b"][i % 4]
        lines = [f"own {i}", " footer ", "", "rare" if i % 20 == 0 else "", "footer" if i % 3 else "other\t", "dup", "dup"]
        rows.append((i, "\n".join(lines), None, site))
    want = [(r[0], r[1], r[3]) for r in rows]
    for ratio, least in ((0.1, 3), (0.66, 2), (0.99, 1), (1.0, 1)):
        frame = linefreq.drop_lines(make(spark, rows), max_ratio=ratio, min_pages=least)
        assert got(frame) == brute(want, ratio, least)


def test_pages_by_host(spark):
    pages = spark.createDataFrame(
        [(i, f"https://h{i % 2}.example.com/p{i}", f"title {i}\nmenu of h{i % 2}\nbody {i}") for i in range(20)], "page_id long, url string, text string"
    )
    out = linefreq.drop_lines(pages, site=F.expr("parse_url(url, 'HOST')"))
    assert out.columns == pages.columns
    assert all("menu" not in r["text"] and f"body {r['page_id']}" in r["text"] for r in out.collect())


def test_no_python_on_the_main_path(docs):
    plan = linefreq.drop_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(odd, empty):
    out = linefreq.drop_lines(odd)
    assert out.columns == odd.columns
    assert got(out) == brute([(r[0], r[1], r[3]) for r in ODD])
    assert linefreq.line_report(odd).count() == len(ODD)
    assert linefreq.drop_lines(empty).count() == 0 and linefreq.line_report(empty).count() == 0
