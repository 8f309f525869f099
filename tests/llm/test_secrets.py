import hashlib
import random
import re
import string
import time

from pyspark.sql import functions as F

from cohortspan.llm import secrets
from tests.llm.conftest import ODD, make

PATTERNS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def brute(text):
    found = {kind: [m.span() for m in p.finditer(text or "") if len(m.group(group)) >= least] for kind, p, group, least in PATTERNS}
    spans = sorted((s, k, e, kind) for k, (kind, found_) in enumerate(found.items()) for s, e in found_)
    return [len(f) for f in found.values()], [f"{kind}:{s}:{e}" for s, _, e, kind in spans]


def check(rows, got):
    assert len(rows) == len(got)
    want = {}
    for r in rows:
        want.setdefault((r[0], *brute(r[1])[0], hashlib.sha256(",".join(brute(r[1])[1]).encode()).hexdigest()), []).append(brute(r[1])[1])
    for r in got:
        base = want[(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"])][0]
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("random:")] == base
        assert len(spans) - len(base) == r["n_random"]
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts)


def test_documents(docs, corpus):
    check(corpus, secrets.find_secrets(docs).collect())


def tricky():
    rng = random.Random(4)
    words = ["token", "Secret", "apikey", "API_KEY", "passwd", "password", "=", ":", " ", '"', "'", "abc", "x1Y2z3", "é", "😀", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "\n", "--", "==", "_", "ſecret"]
    return [(i, "".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(250)]


def test_patterns_on_made_up_texts(spark):
    rows = tricky()
    check(rows, secrets.find_secrets(make(spark, rows)).collect())


def test_models_add_random_strings_and_leave_words_alone(spark):
    rng = random.Random(9)
    words = "configuration processing environment distribution information representation".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(50)) + f' token = "{rng.getrandbits(160):040x}"') for i in range(60)]
    hidden = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    rows += [(100, f"see {hidden} here"), (101, "environmentconfigurationinformation distribution"), (102, "-" * 40 + " " + "=" * 40)]
    got = {r["doc_id"]: r for r in secrets.find_secrets(make(spark, rows)).collect()}
    assert got[100]["spans"] == "random:4:44"
    assert got[101]["spans"] == got[102]["spans"] == ""
    assert all(got[i]["n_assign"] == got[i]["n_hex"] == 1 and got[i]["n_random"] == 0 for i in range(60))


def test_no_python_on_the_main_path(docs):
    plan = secrets.find_secrets(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(odd, empty):
    got = secrets.find_secrets(odd).collect()
    check(ODD, got)
    assert secrets.find_secrets(empty).count() == 0


def test_strings_from_16_characters_on(spark):
    rng = random.Random(9)
    words = "configuration processing environment distribution information representation".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(50)) + f' token = "{"".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))}"') for i in range(60)]
    rows += [(100, "see qX7vK2mZ9pLw4RtB here"), (101, "card 4903482385146306 and 1234567812345678."), (102, "distributionprocessing"), (103, "to bN3cJ8xD5gH1yQ6")]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(make(spark, rows)).collect() if r["doc_id"] >= 100}
    assert got == {100: "random:4:20", 101: "", 102: "", 103: ""}


def test_many_matches_in_one_text(spark):
    """16 times the matches take at most 20 times the time, and all are found."""
    rng = random.Random(5)

    def seconds(n):
        text = " ".join(f"{rng.getrandbits(96):024x}" if i % 3 else f"qX7vK2mZ9pLw4Rt{i} token={'x' * 7}" for i in range(n))
        frame = make(spark, [(1, text)])
        start = time.perf_counter()
        rows = secrets.find_secrets(frame).collect()
        taken = time.perf_counter() - start
        check([(1, text)], rows)
        return taken

    seconds(100)
    assert seconds(32_000) <= 20 * seconds(2000)


def test_apart_against_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        cuts = sorted(rng.sample(range(300), rng.choice([0, 2, 8, 150])))
        spans = [(a, b, "v") for a, b in zip(cuts[::2], cuts[1::2])]
        others = [(a, a + rng.randint(1, 9), "o") for a in rng.sample(range(300), rng.choice([0, 1, 30]))]
        rows.append((i, spans, others))
    kind = "array<struct<start:int,end:int,value:string>>"
    frame = spark.createDataFrame(rows, f"i int, spans {kind}, others {kind}")
    for r in frame.select("*", secrets._apart(F.col("spans"), F.col("others")).alias("free")).collect():
        assert [tuple(x) for x in r["free"]] == [tuple(s) for s in r["spans"] if not any(o["start"] < s["end"] and s["start"] < o["end"] for o in r["others"])]


def test_sample_of_equal_texts_is_bounded(spark):
    equal = make(spark, [(i, "one and the same text") for i in range(3000)])
    assert 50 <= secrets.sample(equal, "text", "doc_id", 100).count() <= 200
    rows = make(spark, [(7, "one row again and again")] * 3000)
    assert secrets.sample(rows, "text", "doc_id", 100).count() <= 1
