"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import collections
import zlib

import numpy as np
import public_tokenizers
import pytest

from tallyvine.llm import ann, bpe, chat, jaccard, line_dedup, packing, pii, quality, queries, token_counts, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, rank string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash") for i, t in rows], DOCS)


AWKWARD = [
    (1, None), (2, ""), (3, "a b\tc d  e\n\n f"), (4, "x" * 3000), (5, "word " * 2500), (6, "<|endoftext|> it's  12 你好 \U0001f600"),
    (7, "same line of more than twenty letters\nother"), (7, "same line of more than twenty letters\nother"), (None, "no id " * 5),
]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_counts.count_tokens(docs_of(spark, AWKWARD), public_tokenizers.path("word_bpe_49k.json")).collect()
    want = sorted((len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for _, t in AWKWARD)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert token_counts.count_tokens(docs_of(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    keeps = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # white space is part of its tokens
    rows = [(i, t) for i, t in AWKWARD if i != 6] + [(8, "x" * 20_000)]
    got = token_counts.count_tokens(docs_of(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(keeps.encode(t or "", add_special_tokens=False).ids) for _, t in rows)


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, t) for i, t in AWKWARD if i != 7 and i is not None] + [(100 + i, "some words " * (i % 37)) for i in range(200)]
    got = packing.pack(docs_of(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).toPandas()
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    assert got.length.sum() == sum(map(len, ids.values()))
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024
    for _, d in got.sort_values("piece").groupby("doc_id"):
        assert d.start.tolist() == [0, *d.length.cumsum().tolist()[:-1]] and (len(d) == 1 or set(d.length[1:]) == {1024})
    assert packing.pack(docs_of(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_plan_uses_every_length():
    rng = np.random.default_rng(0)
    hist = collections.Counter(rng.integers(1, 1025, 5000).tolist())
    plan = packing.plan_sequences(dict(hist))
    used = collections.Counter()
    for lens, r in plan:
        assert sum(lens) <= 1024 and r > 0
        for n in lens:
            used[n] += r
    assert used == hist
    assert sum(r for _, r in plan) <= 1.03 * sum(n * c for n, c in hist.items()) / 1024


def test_bpe_round_trip(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode(docs_of(spark, AWKWARD), path, public_tokenizers.PATTERN)
    got = bpe.decode(out.withColumnRenamed("decoded", "first"), path).collect()
    want = collections.Counter((i, " ".join(map(str, lib.encode_ordinary(t or ""))), (t or "").encode()) for i, t in AWKWARD)
    assert collections.Counter((r["doc_id"], r["ids"], bytes(r["first"])) for r in got) == want
    assert all(bytes(r["first"]) == bytes(r["decoded"]) and r["n_tokens"] == len(r["ids"].split()) for r in got)
    assert bpe.encode(docs_of(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_odd_white_space_and_long_words(spark):
    import random
    import time

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("w", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(3)
    odd = " \n\t\r\x0b\x1c\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200babcdeé日'.,12\U0001f600"
    rows = [(i, "".join(rng.choice(odd) for _ in range(rng.randrange(60)))) for i in range(300)] + [(400, "日本語の文" * 400), (401, "ab" * 700 + " c" + "é" * 511)]
    got = {r.doc_id: r for r in bpe.encode(docs_of(spark, rows), path, public_tokenizers.PATTERN).collect()}
    for d, t in rows:
        assert (got[d].ids, bytes(got[d].decoded)) == (" ".join(map(str, lib.encode_ordinary(t))), t.encode()), t
    letters = "".join(rng.choice("abcdefgh") for _ in range(1 << 20))
    began = time.time()
    one = bpe.encode(docs_of(spark, [(1, letters)]), path, public_tokenizers.PATTERN).collect()[0]
    assert time.time() - began < 60 and bytes(one.decoded) == letters.encode()


def test_bpe_heap_is_the_fold(spark):
    """Words below and above the length from which a heap merges them come out alike."""
    import random

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    pairs = {(a, b): i for a, b, i in bpe.merges_of(ranks).tolist()}
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 40))) for _ in range(60)]
    rows = [(i, " ".join([w, w + "q"])) for i, w in enumerate(words)]
    got = {r.doc_id: r.ids for r in bpe.encode(docs_of(spark, rows), path, public_tokenizers.PATTERN).collect()}
    for i, w in enumerate(words):
        want = [x for part in (w, " " + w + "q") for x in ([ranks[part.encode()]] if part.encode() in ranks else bpe.heap_merged([ranks[bytes([b])] for b in part.encode()], pairs))]
        assert got[i] == " ".join(map(str, want))


def test_bpe_remembers_and_forgets(spark, monkeypatch):
    """Words met in earlier batches of a task, and tasks that begin anew, give the same ids as the library."""
    import tiktoken

    monkeypatch.setattr(bpe, "BATCH_BYTES", 200)
    monkeypatch.setattr(bpe, "ROW_WORDS", 3)
    words = [f"zq{chr(97 + i % 26)}xv{i % 37}wkj éßü{i % 11}" for i in range(400)]
    rows = [(i, " ".join(words[i : i + 15])) for i in range(0, 380)] + [(1000, None), (1001, "")]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for limit in (1, 25, 1 << 20):
        monkeypatch.setattr(bpe, "TASK_WORDS", limit)
        got = {r.doc_id: r for r in bpe.encode(docs_of(spark, rows).coalesce(1), path, public_tokenizers.PATTERN).collect()}
        for d, t in rows:
            ids = lib.encode_ordinary(t or "")
            assert (got[d].ids, got[d].n_tokens, bytes(got[d].decoded)) == (" ".join(map(str, ids)), len(ids), (t or "").encode())


def test_line_dedup(spark):
    line = "A repeated line of many letters"
    rows = [*AWKWARD, (10, f"{line}\nkeep"), (11, f" {line.upper()}\t\nshort"), (12, f"{line}\n{line}"), (13, "short\nshort")]
    got = line_dedup.dedup_lines(docs_of(spark, rows)).collect()
    by = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got}
    assert len(got) == len(rows)
    assert by[10] == ("keep", 2, 1) and by[11] == ("short", 2, 1) and by[12] == (f"{line}\n{line}", 2, 0)
    assert by[1] == ("", 1, 0) and by[2] == ("", 1, 0) and by[7][2] == 0
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0
    whole = line_dedup.dedup_lines_of(docs_of(spark, [*rows, (20, None)]))
    assert whole.columns == ["doc_id", "text", "lang", "rank"] and {r["doc_id"]: r["text"] for r in whole.collect()}[11] == "short"
    assert line_dedup.dedup_lines_of(docs_of(spark, [])).count() == 0


def test_line_runs_go_on_in_another_job(spark):
    """Batches in any order, with runs that were closed and opened again in between, count as one table does."""
    rng = np.random.default_rng(12)
    lines = [f"a line that is long enough, number {i}" for i in range(40)]
    docs = [(i, "\n".join(rng.choice(lines, 3))) for i in range(120)]
    state = line_dedup.Runs(spark, fanout=2).state()
    for at in (60, 0, 90, 30):
        runs = line_dedup.Runs.reopen(spark, state)
        runs.add(line_dedup.line_hashes(spark.createDataFrame(docs[at : at + 30], "doc_id long, text string")))
        state = runs.state()
    got = collections.Counter(r["keeper"] for r in line_dedup.Runs.reopen(spark, state).repeated(3).collect())
    held = collections.defaultdict(set)
    for i, t in docs:
        for x in t.split("\n"):
            held[x].add(i)
    assert got == collections.Counter(max(x) for x in held.values() if len(x) >= 3)


def brute_links(texts, threshold=0.8):
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    links = collections.defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    return sets, links


def test_jaccard_join(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, "one two"), (4, "one two")]
    for g in range(12):
        base = list(rng.choice(words, 90))
        for k in range(1 + 9 * (g == 0) + g % 4):
            t = list(base)
            for j in rng.integers(0, 90, k % 4):
                t[j] = "changed"
            rows.append((100 * g + 10 + k, " ".join(t)))
    sets, links = brute_links(rows)
    got = {r["doc_id"]: r for r in jaccard.jaccard_join(docs_of(spark, rows), small=4).collect()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in links:
            for b in links[a]:
                root[a] = root[b] = min(root[a], root[b])
    for i in sets:
        assert (got[i]["n_links"], got[i]["class_id"]) == (len(links[i]), root[i])
    kept = {r["doc_id"] for r in jaccard.keep_one(docs_of(spark, [*rows, rows[-1]])).collect()}
    assert kept == {i for i in sets if root[i] == i}
    assert jaccard.jaccard_join(docs_of(spark, [])).count() == 0


def test_keep_one_of_repeated_ids(spark):
    """A row stays if only another text of its id is a near copy."""
    words = [f"w{i}" for i in range(60)]
    near, alone = " ".join(words), " ".join(reversed(words))
    rows = [(1, near), (2, near + " more"), (2, alone), (3, None), (4, near)]
    assert sorted((r["doc_id"], r["text"]) for r in jaccard.keep_one(docs_of(spark, rows)).collect()) == [(1, near), (2, alone), (3, None)]


def personal_texts(n, seed=1):
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    ip = lambda: ".".join(map(str, rng.integers(1, 255, 4)))
    return [f"write to +1 {digits(3)} {digits(3)} {digits(4)} from {ip()} and costs {i} or order {digits(11)} of {i % 30}-{i % 12} {i * 7919:x}a9 b" for i in range(n)]


def test_pii_adds_what_is_repeated_in_another_form():
    """On texts that were not trained on, repeated mentions are found and decoys of the same form left alone."""
    crf = pii.train(personal_texts(400))
    found = decoys = wanted = 0
    for i, plain in enumerate(personal_texts(150, seed=2)):
        text, marked = pii._examples(plain, i)
        base, every = pii.all_spans(text, crf)
        more = set(every) - set(base)
        for s, e, label in marked:
            hit = any(a < e and s < b and label in (0, k + 1) for a, b, k in more)
            wanted += label > 0
            found += hit and label > 0
            decoys += hit and not label
    assert found >= 0.8 * wanted and decoys <= 0.05 * found


def test_pii_messages_against_enumeration():
    """Beliefs are the marginals of the field: exactly without loops, nearly with a weak one."""
    import itertools

    rng = np.random.default_rng(4)
    n = 5
    for chain, skip, near in (([(0, 1), (1, 2), (3, 4)], [(0, 3)], 1e-2), ([(0, 1), (1, 2), (2, 3), (3, 4)], [(0, 4)], 5e-2)):
        own = rng.normal(size=(n, pii.LABELS))
        c, s = (0.5 * (x + x.T) for x in rng.normal(size=(2, pii.LABELS, pii.LABELS)))
        want = np.zeros((n, pii.LABELS))
        for y in itertools.product(range(pii.LABELS), repeat=n):
            w = np.exp(sum(own[i, y[i]] for i in range(n)) + sum(c[y[i], y[j]] for i, j in chain) + sum(s[y[i], y[j]] for i, j in skip))
            want[np.arange(n), y] += w
        got = pii.Crf(np.zeros((pii.WIDTH, pii.LABELS)), c, s).beliefs(own, chain, skip)
        assert np.abs(got - want / want.sum(1, keepdims=True)).max() < near


def test_pii_awkward_rows(spark):
    """Empty tables, nulls, repeated rows, long texts and clashing columns."""
    crf = pii.train(personal_texts(50))
    rows = [(1, "at a@b.cd " * 20_000), (1, "at a@b.cd " * 20_000), (None, "x@y.zz"), (3, None)]
    got = sorted((r["n_email"], r["doc_id"] or 0) for r in pii.find(docs_of(spark, rows), crf).collect())
    assert got == [(0, 3), (1, 0), (20_000, 1), (20_000, 1)]
    assert pii.find(docs_of(spark, [])).count() == 0
    clean = pii.redact_texts(docs_of(spark, rows), crf)
    assert clean.columns == ["doc_id", "text", "lang", "rank"] and clean.where("text like '%@%'").count() == 0


def test_pii_base_and_skip_chain(spark):
    text = "mail a.b@c.org, ip 10.0.0.256 10.0.0.25 card 4111 1111 1111 1111 call +1 (469) 555-3334 é end"
    found = {(text[s:e], pii.KINDS[k]) for s, e, k in pii.base_spans(text)}
    assert found == {("a.b@c.org", "email"), ("10.0.0.25", "ip"), ("4111 1111 1111 1111", "card"), ("+1 (469) 555-3334", "phone")}
    crf = pii.train(personal_texts(300))
    again = "call +14695553334 now. " + "filler words " * 30 + "again 14695553334 ok, 77 units, other 25551234567"
    base, every = pii.all_spans(again, crf)
    assert set(base) <= set(every)
    assert [(again[s:e], pii.KINDS[k]) for s, e, k in set(every) - set(base)] == [("14695553334", "phone")]
    out = pii.find(docs_of(spark, [(1, text), (2, None), (3, "")]), crf).collect()
    assert [(r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in sorted(out, key=lambda r: r["doc_id"])] == [(1, 1, 1, 1), (0, 0, 0, 0), (0, 0, 0, 0)]
    clean = {r["doc_id"]: r["text"] for r in pii.redact_texts(docs_of(spark, [(1, text), (2, None)]), crf).collect()}
    assert "[EMAIL]" in clean[1] and "@" not in clean[1] and clean[2] is None


def test_pii_long_dotted_digits():
    """Parts of any length are judged by their value."""
    assert pii.base_spans("1.2.3." + "9" * 5000) == []
    text = "0" * 5000 + "1.2.3.255 x"
    assert (0, 5009, 1) in pii.base_spans(text)


def test_draw_is_the_same_for_any_order_of_rows(spark):
    from tallyvine.llm import common

    df = spark.range(4000)
    want = [r["id"] for r in df.selectExpr("id", "xxhash64(id) as h").orderBy("h").limit(50).collect()]
    for rows in (df.orderBy("id"), df.orderBy("id", ascending=False), df.repartition(7)):
        got = [r["id"] for r in common.draw(rows, 50, "id").collect()]
        assert got == want[: len(got)] and len(got) > 30


def test_quality(spark):
    rng = np.random.default_rng(5)
    words = ["the", "and", "reading", "other", "station", "wing", "of", "heat"]
    rows = [(i, " ".join(rng.choice(words, 60))) for i in range(200)] + [(900, "&&% $$# @@! " * 30), (901, None), (902, "")]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 2)] + [(900, 0), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(docs_of(spark, rows), labels).collect()}
    assert len(got) == len(rows) and not got[900]["keep"] and sum(not got[i]["keep"] for i in range(200)) <= 4
    kept = quality.keep(docs_of(spark, rows), labels)
    assert kept.columns == ["doc_id", "text", "lang", "rank"] and 900 not in {r["doc_id"] for r in kept.collect()}


def test_quality_rejects_repetition(spark):
    """A trusted word said over and over has a lower perplexity than any trusted text; words in a new order are kept."""
    rng = np.random.default_rng(5)
    words = ["the", "and", "reading", "other", "station", "wing", "of", "heat", "characteristically"]
    rows = [(i, " ".join(rng.choice(words, 60))) for i in range(300)] + [(900, "characteristically " * 200)]
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(docs_of(spark, rows), labels).collect()}
    assert not got[900]["keep"] and got[900]["perplexity"] < got[900]["floor"]
    assert sum(got[i]["keep"] for i in range(200, 300)) >= 98


def test_quality_counts_longer_grams(spark, monkeypatch):
    """The letters of a block's n-grams, their places and counts, against a count by hand; alphabets of any size."""
    texts = ["abcabcabcabc", "abcabcab\U0001f600", "", "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))]
    kind = "row long, doc_id long, no_id boolean, text string, lang string, trusted boolean, text_hash long"
    rows = spark.createDataFrame([(i, i, False, t, "en", i != 1, i) for i, t in enumerate(texts)], kind).coalesce(1)
    want = collections.Counter()
    for i, t in enumerate(texts):
        padded = quality.EDGE * 5 + t + quality.EDGE
        want.update((padded[j : j + 6], i) for j in range(len(padded) - 5))
    got = {}
    for r in quality.count_blocks(rows).where("gram <> ''").collect():
        at = np.frombuffer(r["at"], "<u2")
        n = np.frombuffer(r["n"], "<u4") if r["n"] else np.ones(len(at), int)
        got |= {(r["gram"], int(a) & (quality.TRUSTED - 1)): int(k) for a, k in zip(at, n)}
        assert r["trusted"] == sum(int(k) for a, k in zip(at, n) if a & quality.TRUSTED)
    assert got == dict(want)
    every = collections.Counter()
    for (g, _), n in want.items():
        every[g] += n
    assert {r["gram"]: r["c"] for r in quality.count_grams(rows).collect()} == dict(every)


def test_quality_by_hand_and_by_both_ways(spark):
    """Perplexities of an interpolated modified Kneser-Ney model worked out by hand, with the model broadcast and joined."""
    rng = np.random.default_rng(6)
    words = ["ab", "ba", "aab", "bca", "caab"]
    rows = [(i, " ".join(rng.choice(words, 6)), "en" if i % 3 else "fr", None) for i in range(40)] + [(2**60 + 1, "zz ab", "en", None), (None, "ab ab", "xx", None), (50, None, None, None), (3, "abc", "en", None)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1) for i in range(0, 40, 2)], "doc_id long, quality int")
    order = 3
    texts = collections.defaultdict(list)
    for i, t, lang, _ in rows:
        if i is not None and i < 40 and i % 2 == 0:
            texts[lang].append(t)

    def model(lang):
        level = collections.Counter()
        for t in texts[lang]:
            p = quality.EDGE * (order - 1) + t + quality.EDGE
            level.update(p[j : j + order] for j in range(len(t) + 1))
        out = []
        for k in range(order, 0, -1):
            n = [sum(c == i for c in level.values()) for i in range(5)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            d = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i, 0.1 * i), 0.95 * i) if i < 4 else 0 for i in (1, 2, 3)]
            cut = {g: min(d[min(c, 3)], c) for g, c in level.items()}
            total, freed = collections.Counter(), collections.Counter()
            for g, c in level.items():
                total[g[:-1]] += c
                freed[g[:-1]] += cut[g]
            out.append(({g: (c - cut[g]) / total[g[:-1]] for g, c in level.items()}, {x: freed[x] / total[x] for x in total}, dict(level)))
            low = collections.Counter()
            for g in level:
                low[g[1:]] += 1
            level = low
        return out[::-1]

    models = {lang: model(lang) for lang in texts}

    def nats(t, lang, trusted):
        p = quality.EDGE * (order - 1) + t + quality.EDGE
        grams = [p[j : j + order] for j in range(len(t) + 1)]
        own, total = collections.Counter(grams), 0.0
        for g in grams:
            q = less = 1 / (1 << 16)
            for k in range(1, order + 1):
                prob, gamma, count = models[lang][k - 1]
                part, x = g[order - k :], g[order - k : -1]
                q = prob.get(part, 0) + gamma.get(x, 1) * q
                less = (prob.get(part, 0) if k < order and count.get(part, 0) > 1 else 0) + gamma.get(x, 1) * less
            c = models[lang][-1][2].get(g, 0)
            total -= np.log(less if trusted and own[g] >= c > 0 else q)
        return total

    for packed in (0, 1 << 30):
        got = collections.Counter()
        for r in quality.score(docs, labels, order=order, prior=0.0, packed_rows=packed).collect():
            got[(r["doc_id"], r["lang"], None if r["perplexity"] is None else round(r["perplexity"], 6))] += 1
        want = collections.Counter()
        for i, t, lang, _ in rows:
            known = lang in models
            want[(i, lang or "und", round(float(np.exp(nats(t or "", lang, i is not None and i < 40 and i % 2 == 0) / (len(t or "") + 1))), 6) if known else None)] += 1
        assert got == want


def test_quality_in_shards(spark, monkeypatch):
    """A model beyond packed_rows meets the texts shard by shard, languages in parts too, and writes no n-grams of the texts; labels and rejected rows beyond what is broadcast at once do so by shards."""
    rng = np.random.default_rng(7)
    words = ["ab", "ba", "aab", "bca", "caab", "dace"]
    rows = [(i, " ".join(rng.choice(words, 9)), ("en", "en", "fr", "de")[i // 2 % 4], None) for i in range(60)] + [(3, "abc", "en", None)] * 3 + [(None, "ab ab", "xx", None), (None, None, None, None), (4, "zq" * 40, "en", None), (None, "zq" * 40, "fr", None), (5, "zq" * 40, "fr", None)]
    docs, labels = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame([(i, 1) for i in range(0, 60, 2)], "doc_id long, quality int")

    def counted(packed):
        rows = quality.score(docs, labels, packed_rows=packed).select("doc_id", "lang", "keep", "text_hash", "perplexity", "threshold", "floor").collect()
        return collections.Counter((*r[:4], *(x and round(x, 8) for x in r[4:])) for r in rows)

    whole, kept = counted(1 << 30), collections.Counter(map(tuple, quality.keep(docs, labels).collect()))
    assert sum(whole.values()) == len(rows) and 0 < sum(kept.values()) < len(rows)

    def refuse(*_):
        raise AssertionError("the n-grams of the texts are written")

    monkeypatch.setattr(quality, "count_blocks", refuse)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 4)
    shards = quality._shards
    seen = []
    monkeypatch.setattr(quality, "_shards", lambda *a: seen.extend(shards(*a)) or shards(*a))
    assert counted(700) == whole and len(seen) == 3 and all(parts > 1 for _, parts in seen)
    assert collections.Counter(map(tuple, quality.keep(docs, labels, packed_rows=2000).collect())) == kept
    assert shards({"a": 25, "b": 6, "c": 5, "d": 4}, 10) == [(["a"], 3), (["b", "d"], 1), (["c"], 1)]


def test_quality_awkward_tables(spark):
    empty = quality.score(docs_of(spark, []), spark.createDataFrame([], "doc_id long, quality int"))
    assert empty.count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep(docs_of(spark, AWKWARD), labels).count() == len(AWKWARD)


def test_kneser_ney_sums_to_one(spark):
    counts = spark.createDataFrame([("en", g, c) for g, c in (("aab", 3), ("aba", 1), ("bab", 2), ("abb", 4), ("baa", 1))], "lang string, gram string, c long")
    model = quality.train(counts)
    letters = ["a", "b", "z"]
    grams = spark.createDataFrame([("en", x + y + z) for x in letters for y in letters for z in letters], "lang string, gram string")
    p = quality.log_probabilities(grams, model).toPandas()
    # z stands for every character that was not seen
    p["p"] = np.exp(p.logp) * np.where(p.gram.str[2] == "z", (1 << 16) - 2, 1)
    assert np.allclose(p.groupby(p.gram.str[:2]).p.sum(), 1)


def test_vector_search_of_large_components(spark, monkeypatch):
    """Sums beyond what doubles hold are exact; scores beyond a long are its ends; all groups and dimensions are met."""
    monkeypatch.setattr(topk, "TOGETHER", 50)
    monkeypatch.setattr(topk, "GROUPS_TOGETHER", 3)
    monkeypatch.setattr(topk, "WIDE_TOGETHER", 7)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(i, (rng.normal(size=8) * 3e7 + 0.01).tolist()) for i in range(400, 445)]
    rows += [(i, rng.normal(size=3).tolist()) for i in range(500, 540)] + [(600, [1e300] * 3), (620, [-1e300, 0.0, 0.0]), (640, [2.0**62, 1.0, 0.5])]
    rows += [(0, rng.normal(size=8).tolist()), (20, rows[20][1])]
    got = collections.defaultdict(list)
    for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    whole = [(i, [int(np.floor(64 * x)) if abs(x) < 2**60 else 64 * int(x) for x in v]) for i, v in rows]
    want = collections.defaultdict(list)
    for q, a in whole:
        if q % 20 == 0:
            want[q] += [(max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in whole if i != q and len(a) == len(b)]
    assert got == {q: sorted(x, key=lambda t: (-t[0], t[1]))[:5] for q, x in want.items()}


def test_nearest_of_every_dimension(spark):
    """Rows of the less frequent dimensions take part; queries in leaves that copies left empty get all they can."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(i, rng.normal(size=5).tolist()) for i in range(300, 360)] + [(i, [float(i)]) for i in range(400, 405)]
    rows += [(i, rows[7][1]) for i in range(1000, 1400)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20).toPandas()
    size = {i: len(v) for i, v in rows}
    n = collections.Counter(size.values())
    counts = got.groupby("query_id").size()
    assert set(counts.index) == {i for i, _ in rows if i % 20 == 0}
    for q, c in counts.items():
        assert c == min(20, n[size[q]] - 1)
    assert all(size[a] == size[b] for a, b in zip(got.query_id, got.vec_id))


def test_best_bin_first_opens_what_it_needs():
    """With as many visits as leaves every leaf comes once; with fewer, the branches of the first ones alone are opened."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 6)) + 5 * rng.integers(0, 3, size=(4000, 1))
    tree = ann.fit_tree(x, 8, 3)
    assert tree.leaves == 512 and sorted(tree.visits(x[:1], 512)[0]) == list(range(512))
    at = tree.assign(x)
    rows = np.bincount(at, minlength=512)
    for got in tree.visits(x[:20], 3, rows, 200):
        assert len(got) >= 3 and rows[got].sum() >= 200


def test_leaves_come_as_from_one_queue():
    """Leaves opened for many queries at once are those that a queue of one query's seen nodes gives away."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 5)) + 4 * rng.integers(0, 3, size=(3000, 1))
    for fan, depth in ((8, 1), (8, 2), (6, 3)):
        tree = ann.fit_tree(x, fan, depth)
        for q, order, few in zip(x[:40], tree.order(x[:40]), tree.visits(x[:40], 5)):
            seen, want = [(0, i) for i in range(fan)], []

            def promise(node):
                level, i = node
                extra = ann.EXCESS * np.sqrt(q @ q) * tree.spread[level][i] if level < depth - 1 else 0
                return tree.levels[level][i] @ q + extra

            while seen:
                level, i = best = max(seen, key=promise)
                seen.remove(best)
                if level == depth - 1:
                    want.append(i)
                else:
                    seen += [(level + 1, i * fan + c) for c in range(fan)]
            assert order.tolist() == want and few.tolist() == sorted(want[:5])


def test_queries_meet_cells_not_branches(spark, monkeypatch):
    """Leaves share cells of bounded size, so what queries get from them grows with the cells; results are those of whole leaves, here of all."""
    assert ann._cells(np.array([3, 4, 0, 9, 30, 1, 1]), 10).tolist() == [0, 0, 0, 1, 2, 3, 3]
    for rows in (3, 50, 150):
        assert ann._cells(np.full(4096, rows), ann._cell_rows(4096 * rows, 64)).max() + 1 <= ann.CELLS + 1
    assert ann._cell_rows(10**8, 64) == 65_536
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sent = {}
    plain = ann.materialize
    monkeypatch.setattr(ann, "materialize", lambda d, name: sent.setdefault(name, plain(d, name)) if name == "visits" else plain(d, name))
    monkeypatch.setattr(ann, "LEAF_ROWS", 8)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, 5, recall=1.0, fan=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert sent["visits"].count() <= 60 * 3  # a row for each cell of 512 rows or less, not for each of 16 branches
    hits = 0
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(found) & set(np.argsort(-scores)[:5].tolist()))
    assert len(got) == 60 and all(len(v) == 5 for v in got.values()) and hits / 300 >= 0.9


@pytest.mark.parametrize("k", [3, 50])
def test_vector_search(spark, k):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(300, 8)).round(3)
    x[40:60] = x[0]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(1000, None, "c"), (1020, [float("nan")] * 8, "c"), (1040, [None] * 8, "c"), (1060, [0.0] * 8, "c"), (None, [1.0] * 8, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = topk.exact_top_k(df, k).toPandas()
    ids = [*range(300), 1060]
    z = np.floor(64 * np.vstack([x, np.zeros(8)])).astype(int)
    for q, g in got.groupby("query_id"):
        s = z @ z[ids.index(q)]
        want = sorted(((-s[j], i) for j, i in enumerate(ids) if i != q))[:k]
        assert [(-r.score, r.vec_id) for r in g.sort_values("rank").itertuples()] == want
    near = ann.nearest(df, k, recall=0.99).toPandas()
    hits = 0
    for q, g in near.groupby("query_id"):
        s = x @ x[q]
        want = {i for _, i in sorted((-s[j], j) for j in range(300) if j != q)[:k]}
        hits += len(want & set(g.vec_id)) / k
        assert (g.sort_values("rank").score.diff().dropna() <= 1e-12).all()
    assert set(near.query_id) == set(range(0, 300, 20)) and hits / 15 >= 0.9
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.exact_top_k(empty).count() == 0 and ann.nearest(empty).count() == 0


def test_perspectives(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 1, "bob", None), (1, None, None, "late"), (None, 0, "x", "alone")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).toPandas()
    assert len(got) == 4 * 3 + 1
    for (_, who), g in got.groupby(["conv_id", "perspective"], dropna=False):
        text = "".join(g.sort_values("seq").segment)
        assert g.sort_values("seq").seg_start.tolist()[0] == 0
        for r in g.itertuples():
            assert text[r.seg_start :].startswith(r.segment)
            if r.mask_end > r.mask_start:
                assert r.segment.startswith("<|assistant|>") and text[r.mask_start : r.mask_end].endswith("<|end|>")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    a, b = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    whole = [c for c in cols if a[c].dtype == "float64" and str(b[c].dtype) == "Int64"]  # whole numbers with nulls
    a[whole] = a[whole].astype("Int64")
    assert sorted(map(tuple, a[cols].astype(str).values)) == sorted(map(tuple, b[cols].astype(str).values))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, kept, SF).write.parquet(path)
        new = spark.read.parquet(path)
        assert new.columns == docs.columns
        ids, was = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (new, kept))
        assert ids <= was and (ids == was or name in ("quality classifier", "n-gram jaccard join"))
        kept = new
    texts = [r["text"] for r in kept.collect()]
    assert not any(pii.base_spans(t) for t in texts) and any("[EMAIL]" in t for t in texts)
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out.doc_id) == {r["doc_id"] for r in kept.collect()}
