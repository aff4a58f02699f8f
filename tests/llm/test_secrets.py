import hashlib
import math
import random
import re
from collections import Counter

from kinlattice.llm import secrets as sec

BASE = [
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[1]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def brute(text):
    text = text or ""
    found = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m)]
    base = sorted(found)
    for i, (kind, pattern, threshold) in enumerate(sec.CLASSES, 3):
        for m in re.finditer(pattern, text):
            if any(re.search(p, m[0]) for p in sec.ALLOWED):
                continue
            cuts = [(0, 0), *(p.span() for p in re.finditer(sec.PLACEHOLDER, m[0])), (len(m[0]),) * 2]
            for (_, at), (to, _) in zip(cuts, cuts[1:], strict=False):
                s = m[0][at:to]
                if any(re.search(p, s) for p in sec.ALLOWED):
                    continue
                spans = []
                for a in range(len(s) - 19):
                    n = Counter(s[a : a + 20])
                    if -sum(c / 20 * math.log2(c / 20) for c in n.values()) >= threshold - 1e-9:
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = a + 20
                        else:
                            spans.append([a, a + 20])
                found += [(m.start() + at + a, i, m.start() + at + b, kind) for a, b in spans]
    say = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, b, k in xs)
    n = Counter(k for *_, k in base)
    return (n["assign"], n["access"], n["hex"], hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(found)))


def test_against_brute_force(docs):
    rng = random.Random(4)
    bits = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", ":", "=", '"', "'", " ", "  ", "AKIA", "AKIAAKIAIOSFODNN7QQ", "é", "🙂", "\n", "abc", "deadbee", "0123", "f" * 33, "hunter22!", "Zx9/Qm+3Lp_77tRw-aaB", "the", "=", ".", "123e4567-e89b-12d3-a456-426614174000", "EXAMPLE"]
    rand = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(rng.randint(15, 60)))
    texts = ["".join(rng.choice(bits) if rng.random() < 0.85 else rand() for _ in range(rng.randint(0, 25))) for _ in range(150)]
    texts += [None, "", "token: secret=abcdefghij", "password='short' password = longenough1", "x" * 60_000 + " token=abcdefgh1", "a1" * 40 + rand(), "0123456789abcdef" * 4, "EXAMPLE" + rand() + "abcdefghij" + rand(), "token=12345678 " * 1000, "".join(rand() + "a" * 30 for _ in range(60))]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "token=12345678")]
    got = sec.digest(sec.scan(docs(rows).withColumnRenamed("n_chars", "value"))).collect()
    assert len(got) == len(rows)
    want = {(i, *brute(t)) for i, t in rows}
    assert {tuple(r) for r in got} == want
    assert sec.digest(sec.scan(docs([]))).count() == 0


def test_windows_of_random_secrets_are_found(docs):
    key = "q7Zt0Lx9VbN2mKc4RfW8yHs1"
    r = sec.digest(sec.scan(docs([(1, f"see {key} here")]))).collect()[0]
    assert r.spans == f"entropy_b64:4:{4 + len(key)}" and (r.n_assign, r.n_access, r.n_hex) == (0, 0, 0)


def test_a_key_beside_a_placeholder_is_found(docs):
    key = "q7Zt0Lx9VbN2mKc4RfW8yHs1"
    r = sec.digest(sec.scan(docs([(1, f"example{key}")]))).collect()[0]
    assert r.spans == f"entropy_b64:7:{7 + len(key)}"
