import random
import re
import time

from wortnetz.llm.secrets import RULES, find_secrets, masked
from wortnetz.llm.trigrams import trigram_query, trigrams_of

BASE = (
    ("assign", r"""(?P<k>[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
)
PARTS = ["password", "PASSWD", "Secret", "token", "api_key", "APIKEY", "apikey", ":", "=", " ", '"', "'", "abcd1234", "short", "AKIA", "ABCDEFGHIJKL", "deadbeef" * 4, "0123456789abcdef" * 3, "ü", "🙂", "\n", "ghp_" + "a1B2" * 10, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-123456789012", "AIza" + "x" * 35, "eyJab.eyJcd.ef-g", "ſecret", "toKen"]


def brute(text):
    out = []
    for k, (kind, pattern, ok) in enumerate(BASE):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "") if ok(m)]
    return [(s, kind, e) for s, _, kind, e in sorted(out)]


def test_base_spans_against_brute_force(spark, docs):
    rng = random.Random(2)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 30))) for _ in range(400)] + ["password=" + "a" * 7, "password=" + "a" * 8, 'secret="token":"abcdefghij"', "token=token=abcdefgh", "AKIA" * 4, "f" * 31, "f" * 32, "x " * 20000 + "token: abcdefgh1"]
    rows = spark.createDataFrame([(1000 + i, t, "en", 0) for i, t in enumerate(made)], docs.schema).union(docs)
    base = {r.kind for r in RULES if r.base}
    got = find_secrets(rows).collect()
    assert len(got) == rows.count()
    for r in got:
        assert [(s["start"], s["kind"], s["end"]) for s in r["secrets"] if s["kind"] in base] == brute(r["text"]), r["text"]
    assert {s["kind"] for r in got for s in r["secrets"]} == {r.kind for r in RULES}


def test_trigram_queries_let_every_match_pass():
    rng = random.Random(4)
    for rule in RULES:
        query = trigram_query(rule.pattern)
        for _ in range(300):
            text = "".join(rng.choice(PARTS) for _ in range(10))
            if re.search(rule.pattern, text):
                assert meets(query, text.lower()), (rule, text)


def meets(query, text):
    if query is True or isinstance(query, str):
        return query is True or query in text
    return (all if query[0] == "and" else any)(meets(q, text) for q in query[1])


def test_queries():
    assert trigram_query("abcd") == ("and", ["abc", "bcd"])
    assert trigram_query("ab?c") is True
    assert trigram_query("(abc|xyz)+q*") == ("or", ["abc", "xyz"])
    assert trigram_query("abc.*def") == ("and", ["abc", "def"])
    assert trigram_query("[a-z]{40}") is True
    assert trigrams_of(trigram_query("(?i:Tok)en")) == {"tok", "oke", "ken"} or trigrams_of(trigram_query("(?i:Tok)en"))


def test_masking(spark, docs, no_docs):
    df = spark.createDataFrame([(1, "a token=abcdefgh1 b " + "f" * 40, "en", 0), (2, "clean", "en", 0), (3, None, "en", 0), (4, "token=" + "a" * 40, "en", 0)], docs.schema)
    got = {r["doc_id"]: r["text"] for r in masked(df).collect()}
    assert got == {1: "a [secret] b [secret]", 2: "clean", 3: None, 4: "[secret]"}
    assert find_secrets(no_docs).count() == 0 and masked(docs).columns == docs.columns


def unmasked(text):
    """By brute force: the text with its base spans masked, overlapping ones as one."""
    out, at = "", 0
    for start, _, end in brute(text):
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:]


def test_masking_against_brute_force(spark, docs):
    rng = random.Random(6)
    plain = [p for p in PARTS if not p.startswith(("ghp", "---", "xox", "AIza", "eyJ"))]
    made = ["".join(rng.choice(plain) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    made += ["🙂ü" * 5000 + "token=abcdefgh1" + "é" * 9000 + " token=" + "f" * 5000 + "ß" * 4095, "x" * 4096 + "f" * 40, "f" * 8192]
    rows = spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate(made)], docs.schema)
    assert {r["doc_id"]: r["text"] for r in masked(rows).collect()} == dict(enumerate(map(unmasked, made)))


def test_many_secrets_in_one_text(spark, docs):
    def run(n):
        text = "".join(f"{'ü' if k % 2 else 'a'} token=abcdefgh{k} " for k in range(n))
        df = spark.createDataFrame([(1, text, "en", 0)], docs.schema)
        began = time.perf_counter()
        assert len(find_secrets(df).first()["secrets"]) == n
        assert masked(df).first()["text"] == unmasked(text)
        return time.perf_counter() - began

    run(10)
    assert run(100_000) < 60  # 2 MB; four times the matches took four times four as long before


def test_a_text_that_many_rows_share_can_be_split(spark, docs):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = find_secrets(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Aggregate" not in plan  # both sides of the join are plain shuffles
