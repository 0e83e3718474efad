import hashlib
import re

from hypothesis import given, settings, strategies as st

from umbra.llm import secrets as S


def brute(text):
    out = []
    patterns = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6), (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    for k, (p, ok) in enumerate(patterns):
        out += [(m.start(), k, m.end()) for m in p.finditer(text) if ok(m)]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "token", "Secret", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "abc", "é", "0123456789abcdef0123456789", "AKIA", "ABCDEFGHIJ0123456789", "\n", "=x", "zz9Q"]), max_size=14))
def test_base_spans_equal_brute_force(parts):
    text = "".join(parts)
    assert S.scan_text(text)[0] == brute(text)


def test_entropy_by_increments_equals_entropy_of_each_window():
    import math
    from collections import Counter

    run = b"aaaaaaaaaaaaaaaaaaaaaaaaq8Zr1Lx0Vt7Kd3Ws9Pm2Hy5Bnaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"
    n = S.WINDOW
    h = lambda w: -sum(k / n * math.log2(k / n) for k in Counter(w).values())
    high = [i for i in range(len(run) - n + 1) if h(run[i : i + n]) >= 3.9]
    assert S.high_windows(run, 3.9) == (high[0], high[-1] + n)
    assert S.high_windows(b"a" * 100, 3.0) is None


def test_method_adds_and_suppresses():
    secret = "q8Zr1Lx0Vt7Kd3Ws9Pm2Hy5BnUf4Jc6"
    assert any(k == 3 for _, k, _ in S.scan_text(f"see {secret} here")[1])
    for fine in ("123e4567-e89b-12d3-a456-426614174000", "some-long-words-that-are-joined-up", "abcdefghijklmnopqrstuvwxyz0123456789"):
        assert not any(k == 3 for _, k, _ in S.scan_text(f"see {fine} here")[1])


def test_table(docs, no_docs, spark):
    rows = {r.doc_id: r for r in S.scan(docs).collect()}
    assert rows[4].spans == "" and rows[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert S.scan(no_docs).count() == 0
    r = S.scan(spark.createDataFrame([(1, "é token = \"abcdef1\"")], "doc_id long, text string")).first()
    assert (r.n_assign, r.spans) == (1, "assign:2:18")


def test_offsets_in_a_long_text_are_counted_once():
    import time

    piece = 'été token = "abcdef123" '
    began = time.time()
    base, _ = S.scan_text(piece * 40_000)
    assert time.time() - began < 20
    assert len(base) == 40_000 and base[-1] == (39_999 * len(piece) + 4, 0, 39_999 * len(piece) + 22)
