"""Personal data (operator 4): fixed patterns, and a skip-chain conditional random field that adds consistent mentions."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import draw, small_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
#: An email is what may stand before an at sign, found leftwards from it, and this from it on; so runs without an at sign are passed over once.
LOCAL, DOMAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-", re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
#: A match that begins within a run of digits also begins with it, so only beginnings of runs are tried.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The CRF's variables: runs of non-blanks that hold a digit or an at sign. All other tokens are outside by definition. A run is tried from its beginning alone.
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
DIGITS = re.compile(r"[0-9().+-]+")

LABELS = len(KINDS) + 1  # 0 is outside
WIDTH = 1 << 12
#: Rounds of message passing, and the least posterior of an added span.
ROUNDS, SURE = 8, 0.7
#: Tokens between two neighbours in the chain, in characters; farther ones are not neighbours.
NEAR = 40


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")  # int() refuses thousands of digits
    return len(digits) <= 3 and int(digits or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """(start, end) of the leftmost emails without overlap."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, by start, then kind: leftmost matches without overlap, failing ones dropped."""
    out = []
    if "@" in text:
        out += [(*span, 0) for span in emails(text)]
    if "." in text:
        out += [(*m.span(), 1) for m in IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def tokens_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of the variables; brackets and sentence marks at the ends do not count."""
    out = []
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while s < e and text[s] in "([{<\"'`,;:!?":
            s += 1
        while s < e and text[e - 1] in ")]}>\"'`,;:!?.":
            e -= 1
        if s < e:
            out.append((s, e, text[s:e]))
    return out


def _shape(w: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", w))))[:24]


def features_of(text: str, toks: list[tuple[int, int, str]]) -> list[list[int]]:
    """Hashed features of each variable: its shape, counts of digits and signs, and the word before it."""
    out = []
    for s, e, w in toks:
        digits = sum(c.isdigit() for c in w)
        before = text[max(0, s - 24) : s].split()
        names = [
            "bias", "s" + _shape(w), "d%d" % min(digits, 20), "n%d" % min(len(w), 30), "h" + ("@" in w) * "@" + str(min(w.count("."), 4)), "f" + w[0] if not w[0].isalnum() else "f",
            "x%d" % (digits == len(w)), "a%d%d" % (any(c.isalpha() for c in w), digits > 0), "p" + (before[-1].lower()[-12:] if before else ""),
        ]
        out.append([zlib.crc32(x.encode("utf-8", "surrogatepass")) % WIDTH for x in names])
    return out


def _labels(toks, spans) -> np.ndarray:
    """The kind (from 1) of the span that covers most of each token, else 0."""
    out = np.zeros(len(toks), np.int64)
    near: list[tuple[int, int, int]] = []  # the spans that reach to this token or farther
    at = 0
    for i, (s, e, _) in enumerate(toks):
        while at < len(spans) and spans[at][0] < e:
            near.append(spans[at])
            at += 1
        near = [x for x in near if x[1] > s]
        best = 0
        for a, b, k in near:
            n = min(e, b) - max(s, a)
            if n > best and 2 * n >= e - s:
                best, out[i] = n, k + 1
    return out


def _similar(w: str) -> str:
    """What makes two distant tokens mentions of one thing: the same digits if there are seven or more, else the same letters and digits."""
    digits = "".join(c for c in w if c.isdigit())
    return "d" + digits[-7:] if len(digits) >= 7 and "@" not in w else "w" + "".join(c for c in w.lower() if c.isalnum())


def mentions_of(text: str, toks, spans) -> list[tuple[list[int], str]]:
    """(numbers of its tokens, what makes it similar) of each mention: a fixed span's tokens, a row of tokens of digits parted by one blank, or one token."""
    out: list[tuple[list[int], str]] = []
    at, s = 0, 0
    while at < len(toks):
        start, end, w = toks[at]
        while s < len(spans) and spans[s][1] <= start:
            s += 1
        upto = at + 1
        if s < len(spans) and spans[s][0] < end:
            while upto < len(toks) and toks[upto][0] < spans[s][1]:
                upto += 1
            whole = text[spans[s][0] : spans[s][1]]
        else:
            limit = spans[s][0] if s < len(spans) else len(text)
            while upto < len(toks) and text[toks[upto - 1][1] : toks[upto][0]] == " " and toks[upto][1] <= limit and DIGITS.fullmatch(w) and DIGITS.fullmatch(toks[upto][2]):
                upto += 1
            whole = text[start : toks[upto - 1][1]]
        out.append((list(range(at, upto)), _similar(whole)))
        at = upto
    return out


def edges_of(text: str, toks, spans) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between near neighbours, and skip edges from the last token of a mention to each of the next similar one (n tokens: n at most)."""
    chain = [(i, i + 1) for i in range(len(toks) - 1) if toks[i + 1][0] - toks[i][1] <= NEAR]
    last: dict[str, int] = {}
    skip = []
    for own, key in mentions_of(text, toks, spans):
        if key in last:
            skip += [(last[key], i) for i in own]
        last[key] = own[-1]
    return chain, skip


class Crf:
    """Log potentials: unary[feature, label], chain[label, label], skip[label, label]."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def posteriors(self, text: str, toks, spans, known: np.ndarray) -> np.ndarray:
        """Beliefs of each variable after ROUNDS of damped sum-product messages; known labels are clamped. spans: the fixed ones."""
        own = np.stack([self.unary[f].sum(0) for f in features_of(text, toks)])
        own[known > 0] = -30.0
        own[known > 0, known[known > 0]] = 0.0
        return self.beliefs(own, *edges_of(text, toks, spans))

    def beliefs(self, own: np.ndarray, chain: list[tuple[int, int]], skip: list[tuple[int, int]]) -> np.ndarray:
        """Beliefs from the variables' own potentials and the edges' ones; exact if the edges form no loop and ROUNDS reach across."""
        e = np.array(chain + skip, np.int64).reshape(-1, 2)
        if not len(e):
            return _softmax(own)
        pot = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
        src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(e), 2 * len(e)), np.arange(len(e))])
        msg = np.zeros((len(src), LABELS))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, dst, msg)
            out = belief[src] - msg[back]
            new = np.logaddexp.reduce(out[:, :, None] + pot, axis=1)
            new -= new.max(1, keepdims=True)
            msg = 0.5 * msg + 0.5 * new
        belief = own.copy()
        np.add.at(belief, dst, msg)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def repeated(span: str, kind: int, form: int) -> str | None:
    """A mention of what a fixed span names that no fixed pattern matches, in one of three forms; None if there is none."""
    digits = "".join(c for c in span if c.isdigit())
    if kind == 3:
        tail = digits[-10:]
        return (digits, f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"{tail[:3]} {tail[3:6]} {tail[6:]}")[form % 3]
    if kind == 2:
        return (".", "_", "/")[form % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 1:
        return ("-", "_", "/")[form % 3].join(span.split("."))
    return None


def _examples(text: str, form: int) -> tuple[str, list[tuple[int, int, int]]]:
    """text with, for each fixed span, a repeated mention and a decoy of the same form and other digits; (start, end, label) of all these."""
    marked = []
    for s, e, k in base_spans(text):
        again = repeated(text[s:e], k, form)
        if again is None:
            continue
        shift = 1 + zlib.crc32(again.encode()) % 8
        decoy = "".join(str((int(c) + shift + i) % 10) if c in "0123456789" else c for i, c in enumerate(again))
        for word, label in ((decoy, 0), (again, k + 1)):
            text += "\n" + " " * NEAR  # no neighbours in the chain
            marked.append((len(text), len(text) + len(word), label))
            text += word
    return text, marked


def train(docs: list[str], epochs: int = 120) -> Crf:
    """Trained by pseudo-likelihood: each token's label given its features and its neighbours' labels, chain and skip potentials symmetric.

    Labels are those of the fixed patterns. Every fixed span is mentioned once more in a form that no pattern matches, labelled as it,
    and followed by a decoy of that form, labelled as outside: what tells the two apart is the similar token elsewhere alone.
    Unmatched tokens that are similar to a matched one have no label and teach nothing.
    """
    feats, labels, near, far = [], [], [], []
    for form, plain in enumerate(docs):
        text, marked = _examples(plain, form)
        spans = base_spans(text)
        toks = tokens_of(text)
        y = _labels(toks, spans)
        fixed = y > 0
        unknown = np.zeros(len(toks), bool)
        matched = {key for own, key in mentions_of(text, toks, spans) if fixed[own].any()}
        for own, key in mentions_of(text, toks, spans):
            unknown[own] = ~fixed[own] & (key in matched)
        for s, e, label in marked:
            for i, (a, b, _) in enumerate(toks):
                if s <= a and b <= e and not fixed[i]:
                    y[i], unknown[i] = label, False
        around = np.zeros((2, len(toks), LABELS))
        for n, e in enumerate(edges_of(text, toks, spans)):
            for i, j in e:
                for a, b in ((i, j), (j, i)):
                    if not unknown[b]:
                        around[n, a, y[b]] += 1
        keep = np.nonzero(~unknown)[0]
        every = features_of(text, toks)
        feats += [every[i] for i in keep]
        labels += y[keep].tolist()
        near.append(around[0, keep])
        far.append(around[1, keep])
    w, chain, skip = np.zeros((WIDTH, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    if feats:
        f, goal = np.array(feats), np.eye(LABELS)[np.array(labels)]
        near, far = np.concatenate(near), np.concatenate(far)
        seen = np.maximum(1, np.bincount(f.ravel(), minlength=WIDTH))[:, None]
        for i in range(epochs):
            g = _softmax(w[f].sum(1) + near @ chain + far @ skip) - goal
            rate = 2.0 / (1 + 0.02 * i)
            step = np.zeros_like(w)
            np.add.at(step, f.ravel(), np.repeat(g, f.shape[1], 0))
            w -= rate * step / seen / f.shape[1] ** 0.5 + 1e-4 * w
            for table, x in ((chain, near), (skip, far)):
                d = rate * (x.T @ g) / np.maximum(1.0, x.sum(0))[:, None]
                table -= (d + d.T) / 2 + 1e-4 * table
    return Crf(w, chain, skip)


def all_spans(text: str, crf: Crf | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(fixed spans, fixed and added spans). Added ones never touch a fixed one."""
    base = base_spans(text)
    if crf is None:
        return base, base
    toks = tokens_of(text)
    if not toks:
        return base, base
    known = _labels(toks, base)
    free = [i for i in range(len(toks)) if not known[i]]
    if not free:
        return base, base
    post = crf.posteriors(text, toks, base, known)
    more: list[tuple[int, int, int]] = []
    near, at = [], 0
    for i in free:
        k = int(post[i].argmax())
        s, e, w = toks[i]
        while at < len(base) and base[at][0] < e:
            near.append(base[at])
            at += 1
        near = [x for x in near if x[1] > s]
        if k and post[i, k] >= SURE and not near:
            if more and more[-1][2] == k - 1 and s - more[-1][1] <= 1:
                more[-1] = (more[-1][0], e, k - 1)
            else:
                more.append((s, e, k - 1))
    return base, sorted(base + more, key=lambda x: (x[0], x[2]))


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def fit(docs: DataFrame, sample_docs: int = 2000, sample_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Crf:
    """A CRF trained on at most sample_docs texts that hold a variable (of the lowest hashes) and at most sample_chars characters.

    Both bound what the driver holds; the field is applied to whole texts of any length.
    """
    base = texts_of(docs, id_col, text_col).where(F.col("text").rlike("[0-9@]") & (F.length("text") <= sample_chars))
    return train(sorted(r["text"] for r in draw(base, sample_docs, "doc_id", "text").collect()))


def redact_texts(docs: DataFrame, crf: Crf | None = None, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with every span replaced by its kind in brackets; chars_col, where docs has it, is the length of the new text."""
    spark = docs.sparkSession
    small_batches(spark)
    crf = crf or fit(docs, id_col=id_col, text_col=text_col)
    model = spark.sparkContext.broadcast((crf.unary.astype("float32"), crf.chain, crf.skip))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        own = Crf(*model.value)
        return pd.Series([t if t is None else redacted(t, all_spans(t, own)[1]) for t in texts], index=texts.index, dtype=object)

    out = docs.withColumn(text_col, cleaned(F.col(text_col)))
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out


def find(docs: DataFrame, crf: Crf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans for every row.

    Spans are kind:start:end in code points, end exclusive, by start, then kind, joined by commas. Counts are of the fixed
    patterns. Null and empty texts have no spans; repeated rows and null ids are returned as they come; other columns are
    ignored. Nothing is shuffled. crf: as fit() gives it; by default it is fitted on docs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    crf = crf or fit(docs, id_col=id_col, text_col=text_col)
    model = spark.sparkContext.broadcast((crf.unary.astype("float32"), crf.chain, crf.skip))  # WIDTH rows

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Crf(*model.value)
        for pdf in batches:
            rows = []
            for t in pdf["text"].tolist():
                base, every = all_spans(t, own)
                n = [sum(k == i for _, _, k in base) for i in range(len(KINDS))]
                rows.append((*n, _listed(base), _listed(every)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"], index=pdf.index)
            out.insert(0, "doc_id", pdf["doc_id"])
            yield out

    kind = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"
    return texts_of(docs, id_col, text_col).mapInPandas(scan, kind)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]
