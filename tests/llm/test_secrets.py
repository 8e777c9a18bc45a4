"""op7: base spans by a plain reading of the contract; the battery on random and ordinary tokens."""

import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from pagestrata.llm.op7_secrets import BINS, ENCODINGS, KINDS, LENGTHS, base_spans, bin_of, candidates, secret_spans, thresholds

from .helpers import LONG, ask, docs

WORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
PLAIN = (
    ("assign", re.compile(rf"""({WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def base(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, pattern, fits) in enumerate(PLAIN) for m in pattern.finditer(text) if fits(m)]
    return [(a, kind, b) for a, _, kind, b in sorted(found)]


PIECES = st.sampled_from(["password", "PassWD", "ſecret", "to", "ken", "token", "apiKey", "API_KEY", "apı_key", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "deadbeef", "x" * 12, "é", "\t", "-", "Z9"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=25))
def test_base_spans(parts):
    text = "".join(parts)
    assert [(a, KINDS[k], b) for a, k, b in base_spans(text)] == base(text)


def token(draw, encoding, n):
    """A random token that is of this encoding."""
    _, pattern, alphabet, _ = ENCODINGS[encoding]
    while True:
        made = "".join(draw.choices(alphabet, k=n))
        if next(k for k, (_, p, _, _) in enumerate(ENCODINGS) if p.fullmatch(made)) == encoding if pattern.fullmatch(made) else False:
            return made


STEMS = "get set user order item list total price value index parse count time page file cache token print open close check state error name type size data base user main test".split()


def ordinary(draw, encoding):
    """An identifier or number as people write them, in the characters of the encoding."""
    number = str(draw.randrange(10 ** draw.randint(1, 8)))
    if encoding in (0, 1):
        made = draw.choice(["dead", "beef", "cafe", "face", "added", "bad", "fade"]) + number + draw.choice(["", "ab", "abc", "00"]) + "0" * draw.randint(0, 9) + "a"
        return made.upper() if encoding == 1 else made
    words = [draw.choice(STEMS) for _ in range(draw.randint(2, 6))]
    if encoding in (2, 3):
        return ("".join(words) + (draw.choice("234567") if encoding == 2 else "0" + number)).upper()
    return "".join(words) + number if encoding == 4 else words[0] + "".join(w.title() for w in words[1:]) + number


def exact_thresholds(found, fdr):
    """Benjamini-Hochberg by stratum over sorted p-values that are rounded up to their bins."""
    out = {}
    for stratum in {s for s, _ in found}:
        ps = sorted(2.0 ** (-bin_of(p) / 8) for s, p in found if s == stratum)
        held = [p for i, p in enumerate(ps, 1) if p <= fdr * i / len(ps)]
        # equal values are found together
        held = [p for p in ps if held and p <= max(held)]
        out[stratum] = bin_of(max(held)) if held else BINS + 1
    return out


def test_thresholds_are_benjamini_hochbergs():
    draw = random.Random(4)
    for _ in range(60):
        found = [(draw.randrange(3), draw.random() ** draw.choice((1, 1, 6, 20))) for _ in range(draw.randint(1, 80))]
        counts = Counter((s, bin_of(p)) for s, p in found)
        got = thresholds([(s, k, n) for (s, k), n in counts.items()], 0.05)
        want = exact_thresholds(found, 0.05)
        assert all(abs(got[s] - k) <= 1 for s, k in want.items()) and all(got[s] > BINS for s in range(len(got)) if s not in want)


def rates(fdr=0.01, rows=400):
    """By encoding and length: the share of random tokens found; and the share of false ones among all that were found."""
    draw = random.Random(11)
    texts = [(k, n, f"see {token(draw, k, n)} there") for k in range(1, len(ENCODINGS)) for n in (16, 20, 24, 32, 40, 64) for _ in range(rows // 10)]
    texts += [(k, 0, f"see {ordinary(draw, k)} there") for k in range(1, len(ENCODINGS)) for _ in range(rows)]
    found = [(k, n, c) for k, n, text in texts for c in candidates(text, [], 0.01)]
    least = thresholds([(s, b, m) for (s, b), m in Counter((c[2], bin_of(c[3])) for _, _, c in found).items()], fdr)
    hits, all_ = Counter(), Counter((k, n) for k, n, _ in texts)
    for k, n, c in found:
        hits[k, n] += bin_of(c[3]) >= least[c[2]]
    wrong = sum(hits[k, 0] for k in range(len(ENCODINGS)))
    return {(ENCODINGS[k][0], n): hits[k, n] / all_[k, n] for k, n in all_}, wrong / max(1, sum(hits.values()))


def test_power_and_false_discoveries():
    found, wrong = rates()
    assert wrong <= 0.02
    for name in ("HEX", "base32", "BASE36", "base36", "base64"):
        assert found[name, 40] >= 0.9 and found[name, 64] >= 0.95 and found[name, 0] <= 0.02


def test_random_spans_keep_off_base_spans():
    text = "token=Zx8kQ2vLm4Tn7RbWc1YpJd5HsGf3Ae6U"
    assert not candidates(text, [(a, b) for a, _, b in base_spans(text)], 0.01)
    many = " ".join(f"token=Zx8kQ2vLm4Tn7RbWc1YpJd5HsGf3Ae{i}" for i in range(30_000))
    assert len(base_spans(many)) == 30_000 and not candidates(many, [(a, b) for a, _, b in base_spans(many)], 0.01)


def test_added_spans_of_a_table(spark):
    draw = random.Random(3)
    secrets = [token(draw, draw.randrange(1, len(ENCODINGS)), draw.choice((32, 40, 64))) for _ in range(60)]
    texts = [f"é {draw.choice(STEMS)} {s} {ordinary(draw, draw.randrange(1, len(ENCODINGS)))} end" for s in secrets] + [f"only {ordinary(draw, k % 5 + 1)} here" for k in range(60)]
    per_text = [candidates(t, [(a, b) for a, _, b in base_spans(t)], 0.01) for t in texts]
    least = exact_thresholds([(c[2], c[3]) for cs in per_text for c in cs], 0.01)
    want = []
    for i, (t, cs) in enumerate(zip(texts, per_text)):
        spans = [(a, k, b) for a, k, b in base_spans(t)] + [(a, 3, b) for a, b, s, p in cs if bin_of(p) >= least[s]]
        want.append((i, ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))))
    got = ask(secret_spans(docs(spark, texts, clash=True)), "doc_id", "spans")
    assert got == sorted(want, key=repr) and sum("random" in s for _, s in got) >= 45
    assert len(LENGTHS) * len(ENCODINGS) == 36


def test_edge_cases(spark):
    key = "AKIA" + "Q7" * 8
    table = docs(spark, [None, "", f"é {key}", f"é {key}", LONG], clash=True)
    rows = ask(secret_spans(table), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    empty = hashlib.sha256(b"").hexdigest()
    assert (0, 0, 0, 0, empty, "") in rows and (1, 0, 0, 0, empty, "") in rows and (4, 0, 0, 0, empty, "") in rows
    want = f"access:2:{2 + len(key)}"
    for i in (2, 3):
        assert (i, 0, 1, 0, hashlib.sha256(want.encode()).hexdigest(), want) in rows
    assert secret_spans(table.limit(0)).count() == 0
