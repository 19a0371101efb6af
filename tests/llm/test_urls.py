import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm import urls as U

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType())])
LABELS = "label_id long, label boolean"
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    best = None
    for verdict, text in RULES:
        own, start = text.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best is None or len(text) > len(best[1])):
            best = (verdict, text)
    return best


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?q=/es/#f", "http://a.example.com/en/1", "http://example.com/en/", "http://example.com/en", "https://Éx.com", "http://com/", "http://xcom/",
    "http://a.net/es/1", "http://net/es/", "http://a.net?x=/es/", "http://a.net#/es/", "x://b://c/d", "http://a.org/" + "/".join("abcdefghij"), "http://h/" + "y" * 5000, "http://a.com\n/b", "http://a.net/é/12.html", "//a.com/x",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(None, URLS[6], ""), (6, URLS[6], "")], PAGES)
    got = U.judge(df, spark.createDataFrame([], LABELS), RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r.page_id is not None:
            host, path = parse(URLS[r.page_id])
            best = rule(host, path)
            assert (r.host, r.path, r.rule) == (host, path, best and best[1]), URLS[r.page_id]
            assert r.verdict == (best[0] if best else "allow")


def test_bad_templates_are_rejected(spark):
    rng = random.Random(1)
    rows, labels, d = [], [], 0
    for host, path, good in (("a.org", "/news/{}", 0.95), ("a.org", "/spam/{}.html", 0.03), ("b.org", "/x/{}", 0.9), ("b.org", "/y/{}", 0.9), ("c.org", "/p/{}", 0.02)):
        for _ in range(200):
            rows.append((d, f"http://{host}{path.format(d)}", ""))
            labels.append((d, rng.random() < good))
            d += 1
    slugs = [(5000 + i, f"http://d.org/blog/{i:x}w{i}title/{i}", "") for i in range(300)]
    got = U.judge(spark.createDataFrame(rows + slugs, PAGES), spark.createDataFrame(labels, LABELS), []).collect()
    verdicts, shapes = defaultdict(set), defaultdict(set)
    for r in got:
        key = (r.host, r.path.split("/")[1])
        verdicts[key].add(r.verdict)
        shapes[key].add(r.template)
    assert verdicts[("a.org", "spam")] == {"block"} and verdicts[("c.org", "p")] == {"block"}
    assert verdicts[("a.org", "news")] == verdicts[("b.org", "x")] == verdicts[("d.org", "blog")] == {"allow"}
    assert shapes[("b.org", "x")] == shapes[("b.org", "y")]  # alike, so merged
    assert shapes[("a.org", "news")] != shapes[("a.org", "spam")]
    assert len(shapes[("d.org", "blog")]) == 1


def test_purity_is_smoothed_as_documented(spark):
    rows = [(i, "c.org", ["x", "{n}"], i % 4 != 0) for i in range(40)] + [(i, "d.org", ["y"], None) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, host string, segs array<string>, label boolean")
    got = {r.host: r.purity for r in U.templates(pages.select("host", "segs", "label")).collect()}
    prior = 31 / 42
    host = (30 + 20 * prior) / 60
    assert abs(got["c.org"] - (30 + 20 * host) / 60) < 1e-12
    assert abs(got["d.org"] - prior) < 1e-12


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], PAGES), spark.createDataFrame([], LABELS), RULES).count() == 0
    assert spark.range(1).select(F.size(U.segments(F.lit("/")))).first()[0] == 0


def test_rare_and_deep_bad_branches_are_told_apart(spark):
    rows, labels, d = [], [], 0

    def add(path, n, good):
        nonlocal d
        for _ in range(n):
            rows.append((d, f"http://big.org/{path}/{d}", ""))
            labels.append((d, good))
            d += 1

    add("main", 2600, True)
    for k in range(30):
        add(f"section{chr(97 + k % 26)}{'x' * (k // 26)}", 10, True)
    add("spam", 50, False)  # under 2 % of its node's rows
    for kind, good in (("fine", True), ("foul", False)):
        add(f"a/b/c/d/e/f/{kind}", 40 if good else 30, good)
    add("g/h/i/j/k/l", 30, True)
    add("a/b/c/d", 60, True)
    got = U.judge(spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels, LABELS), []).collect()
    assert len(got) == len(rows)
    verdicts, shapes = defaultdict(set), defaultdict(set)
    for r in got:
        key = r.path.rsplit("/", 1)[0][1:]
        verdicts[key].add(r.verdict)
        shapes[key].add(r.template)
    assert {k for k, v in verdicts.items() if v != {"allow"}} == {"spam", "a/b/c/d/e/f/foul"}
    assert verdicts["spam"] == verdicts["a/b/c/d/e/f/foul"] == {"block"}
    assert len(set.union(*(shapes[k] for k in shapes if k.startswith("section")))) == 1
    assert shapes["g/h/i/j/k/l"].pop().endswith("/{rest}")


def plain_templates(pages):
    """(host, segs) to (template, purity), every level and branch by itself."""
    sums = {}
    for host, segs, label in pages:
        own = sums.setdefault((host, segs), [0, 0, 0])
        own[0], own[1], own[2] = own[0] + 1, own[1] + (label is not None), own[2] + (label is True)
    shape = {key: list(key[1]) for key in sums}

    def total(key_of, over=None):
        out = {}
        for key, s in sums.items():
            k = key_of(key)
            if k is not None and (over is None or over(key)):
                out[k] = [a + b for a, b in zip(out.get(k, [0, 0, 0]), s, strict=True)]
        return out

    def away(labelled, good, pool):
        p = (pool[2] + 1) / (pool[1] + 2)
        return abs(good - labelled * p) / math.sqrt(max(1e-9, labelled * p * (1 - p)))

    levels = 0
    while levels < max(map(len, shape.values())):
        at = lambda key: (key[0], tuple(shape[key][:levels]), shape[key][levels]) if len(shape[key]) > levels else None  # noqa: E731, B023
        children = total(at)
        rare = {}
        for host, node in {c[:2] for c in children}:
            own = {c: s for c, s in children.items() if c[:2] == (host, node)}
            if len(own) > U.FANOUT:
                few = {c: s for c, s in own.items() if s[0] < U.LEAST_SHARE * sum(x[0] for x in own.values())}
                pool = [sum(x) for x in zip(*few.values(), strict=True)] if few else None
                rare |= {c: True for c, s in few.items() if s[1] < U.FEW_LABELS or away(s[1], s[2], pool) <= U.ALIKE}
        for key in shape:
            if rare.get(at(key)):
                shape[key] = [*shape[key][:levels], "*", *shape[key][levels + 1 :]]
        if levels >= U.DEPTH - 2:
            node = lambda key: (key[0], tuple(shape[key][: levels + 1]))  # noqa: E731, B023
            deep = {key for key in shape if len(shape[key]) > levels + 2}
            below = total(node, lambda key: key in deep)  # noqa: B023
            for key in deep:
                s = below[node(key)]
                if s[1] < U.FEW_LABELS or s[2] in (0, s[1]):
                    shape[key] = [*shape[key][: levels + 1], "{rest}"]
        levels += 1
    for level in reversed(range(levels)):
        wide = lambda t: tuple("*" if i == level else x for i, x in enumerate(t))  # noqa: E731, B023
        own = total(lambda key: (key[0], tuple(shape[key])), lambda key: len(shape[key]) > level)  # noqa: B023
        alike = set()
        for host, w in {(h, wide(t)) for h, t in own}:
            branches = {t: s for (h, t), s in own.items() if (h, wide(t)) == (host, w)}
            pool = [sum(x) for x in zip(*branches.values(), strict=True)]
            if len(branches) > 1:
                alike |= {(host, t) for t, s in branches.items() if s[1] == 0 or away(s[1], s[2], pool) <= U.ALIKE}
        shape = {key: list(wide(t)) if (key[0], tuple(t)) in alike else t for key, t in shape.items()}
    whole = [sum(x) for x in zip(*sums.values(), strict=True)]
    prior = (whole[2] + 1) / (whole[1] + 2)
    hosts = {h: (s[2] + U.STRENGTH * prior) / (s[1] + U.STRENGTH) for h, s in total(lambda key: key[0]).items()}
    pure = {k: (s[2] + U.STRENGTH * hosts[k[0]]) / (s[1] + U.STRENGTH) for k, s in total(lambda key: (key[0], tuple(shape[key]))).items()}
    return {key: (tuple(t), pure[key[0], tuple(t)]) for key, t in shape.items()}


def test_tree_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(U, "FANOUT", 4)
    monkeypatch.setattr(U, "LEAST_SHARE", 0.08)
    monkeypatch.setattr(U, "FEW_LABELS", 3)
    rng = random.Random(3)
    pages = []
    for _ in range(1500):
        host = rng.choice(["big", "big", "big", "small.net", ""])
        first = rng.choice(["blog", "blog", "spam", "shop", *[f"r{i}" for i in range(12)]])
        segs = (first, *[rng.choice(["x", "x", "y", f"z{rng.randrange(9)}"]) for _ in range(rng.choice([0, 1, 1, 2, 3, 6]))])
        bad = first == "spam" or "y" in segs[2:5] or first in ("r1", "r2")
        pages.append((host, segs if rng.random() < 0.98 else (), None if rng.random() < 0.4 else (rng.random() < (0.1 if bad else 0.9))))
    rows = spark.createDataFrame([(h, list(s), x) for h, s, x in pages], "host string, segs array<string>, label boolean")
    got = {(r.host, tuple(r.segs)): (tuple(r.template), r.purity) for r in U.templates(rows).collect()}
    want = plain_templates(pages)
    assert {k: t for k, (t, _) in got.items()} == {k: t for k, (t, _) in want.items()}
    assert all(abs(got[k][1] - p) < 1e-12 for k, (_, p) in want.items())
    told = [t for t, _ in want.values()]
    assert any("*" in t for t in told) and any("{rest}" in t for t in told) and any(p < U.LEAST_PURITY for _, p in want.values())
