import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import secrets, trigrams

RULES = [
    ("assign", re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def base(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(RULES) for m in p.finditer(text or "") if len(m[g]) >= n]
    return found, hashlib.sha256(",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in sorted(found)).encode()).hexdigest()


def agrees(df):
    got = sorted((r["doc_id"] or -1, r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.report(df).collect())
    want = []
    for r in df.collect():
        found, digest = base(r["text"])
        want.append((r["doc_id"] or -1, *[sum(k == n for _, k, _ in found) for n in range(3)], digest))
    assert got == sorted(want)


def test_documents(some):
    agrees(some)


def test_odd(odd, none):
    agrees(odd)
    assert secrets.report(none).count() == 0
    spans = {r["doc_id"]: r["spans"] for r in secrets.report(odd).collect()}
    assert spans[12].split(",")[1].startswith("access:")


PARTS = ["pass", "word", "PassWord", "token", "secret", "api_key", "APIKEY", '"', "'", " ", "=", ":", "abc", "AKIA", "ABCDEFGH01234567", "é", "😀", "\n", "0123456789abcdef", "deadbeef", "-"]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=50, max_size=80))
def test_any_text(spark, texts):
    agrees(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_more_kinds_and_masks(spark):
    text = "ghp_" + "Zq" * 18 + " x -----BEGIN RSA PRIVATE KEY----- é xoxb-1234567890ab token=abcdefgh"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [s.split(":")[0] for s in secrets.report(df).first()["spans"].split(",")] == ["github", "pem", "slack", "assign"]
    masked = secrets.scan(df, keep={"text": "text"}).select(secrets.mask_spans(F.col("text"), F.col("found"))).first()[0]
    assert masked == "[GITHUB] x [PEM] é [SLACK] [ASSIGN]"


def test_masks_cover_overlapping_spans(spark):
    texts = ["x AKIA" + "ABCDEFGH" * 2 + "0" + "a1" * 20 + " y", "token=abc_ghp_" + "Zq" * 18 + "-" + "0f" * 16 + " z", "AKIA" + "ABCDEFGH" * 3 + "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    masked = {r["doc_id"]: r["t"] for r in secrets.scan(df, keep={"doc_id": "doc_id", "text": "text"}).select("doc_id", secrets.mask_spans(F.col("text"), F.col("found")).alias("t")).collect()}
    assert masked == {0: "x [ACCESS] y", 1: "[ASSIGN] z", 2: "[ACCESS]\n"}


def test_queries_from_rules():
    plan = secrets.Plan()
    assert [secrets.RULES[i].kind for i in plan.full] == ["hex"] and {"pas", "aki", "kia"} <= set(plan.names)
    assert [c for i, c in plan.clauses if secrets.RULES[i].kind == "access"] == [["aki", "kia"]]
    assert sum(secrets.RULES[i].kind == "assign" for i, _ in plan.clauses) == 6
    assert trigrams.query("(foo|ba[rz])+x?") == {frozenset(["foo"]), frozenset(["bar"]), frozenset(["baz"])}
    assert trigrams.query("[0-9]{3}|abc") == trigrams.ALL == trigrams.query("(?:abc)*") and trigrams.query("ab.cd") == trigrams.ALL
    assert trigrams.query("x(?=yz)abcé(def){2}") == {frozenset(["xab", "abc", "def", "efd", "fde"])}


ODD_PATTERNS = ["(foo|ba[rz]){2,}q?end", "[ab]{2}(cd)?e(f|gh)+", "A(?:BC|D.E)*FGH", "(?i:kEy)[ -]?(one|two)\\b", "x{3,5}y+?z", "(ab|c)(?:d|ef){4}", "[^a]bcd|efg[hi]j"]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_queries_admit_every_match(data):
    pattern = data.draw(st.sampled_from([r.pattern for r in secrets.RULES] + ODD_PATTERNS))
    match = data.draw(st.from_regex(re.compile("(?a)" + pattern), fullmatch=True))
    held = trigrams.grams(match.lower())
    assert any(clause <= held for clause in trigrams.query(pattern))


def test_finder_finds_all_trigrams(spark):
    names = sorted({"abc", "bca", "cab", "aaa", ".-]", "a b", "^\\[", "é12"})
    texts = ["abcabcab", "aaaa", "x.-]a b^\\[", "é12é", ""]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select(F.regexp_extract_all("t", F.lit(trigrams.finder(names)), F.lit(1)).alias("f")).collect()
    assert [r["f"] for r in got] == [[t[i : i + 3] for i in range(len(t) - 2) if t[i : i + 3] in names] for t in texts]


def test_candidates_hold_all_trigrams_of_a_clause(spark):
    texts = ["PassWord", "pas ass ssw swo wor", "AKIA", "aki", "kia aki", "x", ""]
    plan = secrets.Plan()
    held = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)] * 2, "_k1 long, _k2 long, _text string")
    index = secrets.postings(held, plan)
    assert index.count() == index.distinct().count() == sum(len({t.lower()[i : i + 3] for i in range(len(t))} & set(plan.names)) for t in texts)
    assert {(r["_k1"], tuple(r["_rules"])) for r in secrets.candidates(index, plan).collect()} == {(0, (0,)), (2, (1,)), (4, (1,))}


def test_long_texts(spark):
    """A megabyte for each rule: what its parts repeat doesn't deepen the JVM's stack, whether it matches or not."""
    n = 1 << 20
    texts = ["token" + " " * n + "= abcdefg", "AKIA" + "Z" * n, "0a" * (n // 2), "ghp_" + "a" * n, "xoxb-" + "1-" * (n // 2), "eyJ" + "a" * n + ".eyJ" + "b" * n + ".cccccccccc"]
    texts += ["-----BEGIN " + "AB " * (n // 3) + end for end in ("PRIVATE KEY-----", "private key-----")]
    got = {r["doc_id"]: r["spans"] for r in secrets.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    kinds = ["assign", "access", "hex", "github", "slack", "jwt", "pem"]
    assert all(f"{k}:0:{len(texts[i])}" in got[i].split(",") for i, k in enumerate(kinds)) and "pem" not in got[7]


def test_rules_without_trigrams_or_with_them_alone(spark):
    df = spark.createDataFrame([(1, "xyzw 123456789"), (2, None)], "doc_id long, text string")
    one, other = secrets.Rule("digits", "[0-9]{6,}", 6), secrets.Rule("word", "xyz[a-z]+", 4)
    for rules, want in (((one,), "digits:5:14"), ((other,), "word:0:4"), ((one, other), "word:0:4,digits:5:14")):
        assert {r["doc_id"]: r["spans"] for r in secrets.report(df, rules=rules).collect()} == {1: want, 2: ""}


def test_main_path_has_no_python(some):
    assert "Python" not in (plan := secrets.report(some)._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
