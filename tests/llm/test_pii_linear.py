"""The patterns' own searches against the plain patterns, and long unbroken texts."""

import random
import re
import time

from tallyvine.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
TOKEN = re.compile(r"[^\s0-9@]*[0-9@]\S*")


def test_same_matches_as_the_plain_patterns():
    rng = random.Random(4)
    alphabet = ["a", "B", "0", "12", "255", ".", "..", "@", "@@", "-", "_", "%", "+", " ", "\n", "　", "é", "日", "x.y", "a@b.c", "1.2.3.4"]
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(14)))
        assert pii.emails(text) == [m.span() for m in EMAIL.finditer(text)], text
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in IP.finditer(text)], text
        assert [m.span() for m in pii.TOKEN.finditer(text)] == [m.span() for m in TOKEN.finditer(text)], text


def plain_labels(toks, spans):
    out = [0] * len(toks)
    for i, (s, e, _) in enumerate(toks):
        best = 0
        for a, b, k in spans:
            n = min(e, b) - max(s, a)
            if n > best and 2 * n >= e - s:
                best, out[i] = n, k + 1
    return out


def test_same_labels_as_all_pairs():
    rng = random.Random(5)
    for _ in range(500):
        toks = sorted({(s, s + rng.randrange(1, 6), "") for s in rng.sample(range(0, 200, 7), 12)})
        spans = sorted(((s, s + rng.randrange(1, 25), rng.randrange(4)) for s in rng.choices(range(200), k=9)), key=lambda x: (x[0], x[2]))
        assert pii._labels(toks, spans).tolist() == plain_labels(toks, spans)


def test_long_texts_take_linear_time():
    crf = pii.train(["call +49 170 1234567 or 4111 1111 1111 1111, at 10.0.0.1 or a.b@example.com"] * 20)
    million = 1_000_000
    texts = {
        "letters": "a" * million, "digits": "7" * million, "cjk": "日本語" * (million // 3), "base64": ("QUJD9+/" * (million // 7)), "dots": "1." * (million // 2), "ats": "a@" * (million // 2), "pluses": "+1 (" * (million // 16),
        "mentions": "mail me@example.com or 10.0.0.1 now " * (million // 36),
    }
    for name, text in texts.items():
        for t in (text, text + " 1.2.3.4 x@y.zz"):
            began = time.time()
            base, every = pii.all_spans(t, crf)
            assert time.time() - began < 10, name
            assert set(base) <= set(every)
            assert t is text or {x[2] for x in base[-2:]} == {0, 1}
