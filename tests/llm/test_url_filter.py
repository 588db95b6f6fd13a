"""URL rules and host reputations against plain Python."""

import random

from tallyvine.llm import queries, url_filter

PAGES = "page_id long, url string, host string, verdict string"
RULES = queries.URL_RULES


def plain(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def plain_rule(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "://", "http://", "x://A.B/É?", "http://EXAMPLE.com/en/", "http://example.com/en", "http://www.example.com/en/x#y", "http://xexample.com/en/", "http://com/", "http://com",
            "http://a.net?x=/es/", "http://a.net/es/?/fr/", "http://net/fr/\n/x", "http://u@a.net:80/es/", "a://b://c/d", "http://İ.example.com/en/" + "y" * 100_000]
    rng = random.Random(1)
    urls += ["".join(rng.choice(["http://", "com", "net", ".", "/", "?", "#", "www.", "example", "/en/", "/es/", "A", "\n"]) for _ in range(9)) for _ in range(400)]
    rows = [(i if i % 9 else None, u, "clash", "clash") for i, u in enumerate(urls)] * 2
    none = spark.createDataFrame([], "url string, bad int")
    got = url_filter.judge(spark.createDataFrame(rows, PAGES), RULES, none).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *plain(u), *plain_rule(*plain(u), RULES)) for i, u, _, _ in rows), key=str)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got), key=str) == want
    assert {r.verdict for r in got if r.rule is None} == {"allow"}
    assert url_filter.judge(spark.createDataFrame([], PAGES), RULES, none).count() == 0
    assert {r.rule for r in url_filter.judge(spark.createDataFrame(rows, PAGES), [], none).collect()} == {None}


def shrunk(units, prior):
    """{key: (a, b, mean)} of units {key: (n, bad)} with prior(key), by the moments in plain Python."""
    over = sum((x - n * prior(u)) ** 2 - n * prior(u) * (1 - prior(u)) for u, (n, x) in units.items())
    most = sum(n * (n - 1) * prior(u) * (1 - prior(u)) for u, (n, x) in units.items())
    rho = min(url_filter.MOST_RHO, max(url_filter.LEAST_RHO, over / most)) if most > 0 else url_filter.MOST_RHO
    k = 1 / rho - 1
    ab = {u: (prior(u) * k + x, (1 - prior(u)) * k + n - x) for u, (n, x) in units.items()}
    return {u: (a, b, a / (a + b)) for u, (a, b) in ab.items()}


def test_reputation_is_shrunk_by_level(spark):
    rng = random.Random(2)
    hosts = {}
    for d in range(40):
        rate = 0.9 if d % 10 == 0 else 0.05
        for h in range(rng.randrange(1, 6)):
            n = rng.choice([0, 1, 3, 40])
            hosts[f"h{h}.d{d}.{'net' if d % 2 else 'co.uk'}"] = (n, sum(rng.random() < rate for _ in range(n)))
    hosts |= {"": (2, 0), "10.0.0.1": (3, 3), "d1.net:8080": (1, 0), "bare": (0, 0)}
    key = {}
    for h in hosts:
        bare = h.split(":")[0]
        parts = bare.split(".")
        two = bare.endswith(".co.uk")
        key[h] = (bare, bare) if bare == "10.0.0.1" else (".".join(parts[-3:]), "co.uk") if two else (".".join(parts[-2:]), parts[-1])
    add = lambda keys: {k: tuple(sum(v[i] for h, v in hosts.items() if keys(h) == k) for i in (0, 1)) for k in map(keys, hosts)}
    n, x = (sum(v[i] for v in hosts.values()) for i in (0, 1))
    suffixes = shrunk(add(lambda h: key[h][1]), lambda u: (x + 1) / (n + 2))
    domains = shrunk(add(lambda h: key[h]), lambda u: suffixes[u[1]][2])
    want = shrunk(hosts, lambda h: domains[key[h]][2])
    got = url_filter.reputation(spark.createDataFrame([(h, *v) for h, v in hosts.items()], "host string, n long, bad long")).collect()
    assert len(got) == len(hosts)
    for r in got:
        a, b, mean = want[r.host]
        assert abs(r["mean"] - mean) < 1e-9 and abs(r["bound"] - (mean - url_filter.SURENESS * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5)) < 1e-9


def test_bad_hosts_are_blocked_and_others_left_alone(spark):
    """A host of bad pages is blocked, one bad page of a good host does no harm, and a new host of a bad domain is judged by its domain."""
    outcomes = [(f"http://a{i % 3}.bad.org/{i}", int(i % 10 > 0)) for i in range(90)] + [(f"http://h{i % 30}.good{i % 7}.org/{i}", int(i % 50 == 0)) for i in range(900)] + [("http://odd.org/", None), (None, 1)]
    pages = [(1, "http://a1.bad.org/x"), (2, "http://new.bad.org/"), (3, "http://h1.good1.org/"), (4, "http://unseen.org/"), (5, None)]
    got = url_filter.judge(spark.createDataFrame([(*p, "", "") for p in pages], PAGES), RULES, spark.createDataFrame(outcomes, "url string, bad int")).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    assert all(r.bound is not None for r in got)
