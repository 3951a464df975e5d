import math
import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from beamline.llm.url_filter import RULES, judge, mine_rules, url_tokens

URLS = [
    "https://Blog.Example.ORG/es/1", "http://example.org/en/12#x", "http://example.org/en/2", "http://a.com/fr/", "http://a.com/fr", "http://m.a.com/de/3?x=1", "http://com/de/",
    "http://notexample.org/es/1", "http://x.net/en/5", "HTTP://EXAMPLE.net", "no scheme", "://", "", None, "ftp://u@h.org:80/p?q#f", "http://org/", "http://example.org/en/1://b", "http://x.net/en/5",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    after = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", after)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", after[len(host) :])[0]


def ruled(host, path):
    fits = []
    for verdict, rule in RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i if i != 3 else None, u, "h", "p", "v") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string, verdict string")
    none = spark.createDataFrame([], "key string, left array<string>, verdict string, confidence double, support double")
    got = judge(pages, none).collect()
    assert len(got) == len(URLS)
    for r in got:
        i = 3 if r.page_id is None else r.page_id
        host, path = split(URLS[i])
        rule, verdict = ruled(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), URLS[i]


def test_mined_rules_match_counting(spark):
    rows = [("http://spam.net/win/1", "block")] * 6 + [("http://a.net/win/2", "block")] * 4 + [("http://a.net/news/3", "allow")] * 9 + [("http://b.com/news/4?ref=1", "allow")] * 5 + [("http://a.net/win/7", "allow")]
    frame = spark.createDataFrame(rows, "url string, verdict string").select(url_tokens(F.col("url")).alias("tokens"), "verdict")
    got = {(frozenset(r.left), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in mine_rules(frame, 0.1, 0.8, 1, 1.5).collect()}
    tokens = [(frozenset(r.tokens), r.verdict) for r in frame.collect()]
    want = {}
    for verdict in ("allow", "block"):
        prior = sum(v == verdict for _, v in tokens) / len(tokens)
        items = sorted(set().union(*[t for t, _ in tokens]))
        for k in range(1, 8):
            for left in combinations(items, k):
                left = frozenset(left)
                times, hits = sum(left <= t for t, _ in tokens), sum(left <= t and v == verdict for t, v in tokens)
                if hits >= 0.1 * len(tokens) and hits / times >= 0.8 and hits - times * prior > 1.5 * math.sqrt(times * prior * (1 - prior)):
                    want[left, verdict] = (round(hits / times, 9), round(hits / len(tokens), 9))
    assert got == want and want
    pages = spark.createDataFrame([(1, "http://new.net/win/99"), (2, "http://spam.net/other"), (3, "http://b.com/news/1"), (4, "http://zzz.edu/")], "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in judge(pages, mine_rules(frame, 0.1, 0.8, 1, 1.5)).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_words_of_hosts_are_shared_and_chance_makes_no_rule(spark):
    """Hosts that share a word are blocked together; labels dealt at random mine nothing."""
    rows = [(f"https://casino-win{i}.example.{t}/en/{i}", "block") for i in range(15) for t in ("com", "org")] + [(f"https://news{i}.example.{t}/en/{i}", "allow") for i in range(30) for t in ("com", "org")]
    frame = spark.createDataFrame(rows, "url string, verdict string").select(url_tokens(F.col("url")).alias("tokens"), "verdict")
    mined = mine_rules(frame)
    pages = spark.createDataFrame([(1, "http://casino-slots.example.net/x"), (2, "http://news.example.net/x"), (3, "http://x.example.net/" + "very-long/" * 30_000)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge(pages, mined).collect()} == {1: "block", 2: "allow", 3: "allow"}
    rng = random.Random(1)
    rows = [(f"https://h{rng.randrange(9)}.{rng.choice(['com', 'org'])}/{rng.choice(['en', 'de'])}/p", rng.choice(["allow", "allow", "allow", "block"])) for _ in range(600)]
    frame = spark.createDataFrame(rows, "url string, verdict string").select(url_tokens(F.col("url")).alias("tokens"), "verdict")
    assert mine_rules(frame).filter("verdict = 'block'").count() == 0


def test_without_labels_or_pages(spark):
    none = spark.createDataFrame([], "tokens array<string>, verdict string")
    assert mine_rules(none).count() == 0
    assert judge(spark.createDataFrame([], "page_id long, url string"), mine_rules(none)).count() == 0


def test_copies_of_long_urls_end(spark):
    """A URL of 40 words has 2^40 sets of words; its copies cost no more than sets of ITEMS, and its own label is still found."""
    long_ = "http://long.example.net/" + "/".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    others = [(f"http://h{'abcdefghij'[i % 10]}.example.com/{'/'.join(f'w{chr(97 + k // 26)}{chr(97 + k % 26)}' for k in range(i % 7, 40, 7))}", "allow") for i in range(300)]
    for copies in (6, 600):
        frame = spark.createDataFrame([(long_, "block")] * copies + others, "url string, verdict string").select(url_tokens(F.col("url")).alias("tokens"), "verdict")
        mined = mine_rules(frame)
        assert 0 < mined.count() < 20_000
        pages = spark.createDataFrame([(1, long_), (2, "http://ha.example.com/waa")], "page_id long, url string")
        assert {r.page_id: r.verdict for r in judge(pages, mined).collect()} == {1: "block", 2: "allow"}


def test_cut_tokens_are_counted_in_full(spark, monkeypatch):
    """With few items a row, sets that hold a token left out somewhere keep the counts of all rows."""
    from beamline.llm import url_filter

    monkeypatch.setattr(url_filter, "ITEMS", 2)
    rows = [(["a", "b", "c", "x"], "block")] * 8 + [(["a", "c"], "allow")] * 3 + [(["b", "x", "d"], "block")] * 4 + [(["d", "c", "a"], "allow")] * 9
    got = mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.1, 0.5, 1, 0.5).collect()
    assert got
    for r in got:
        times, hits = sum(set(r.left) <= set(t) for t, _ in rows), sum(set(r.left) <= set(t) and v == r.verdict for t, v in rows)
        assert (round(r.confidence, 9), round(r.support, 9)) == (round(hits / times, 9), round(hits / len(rows), 9))


def test_cut_tokens_lose_no_rule(spark, monkeypatch):
    """With two items a row, every set of tokens still finds the confidence and support that counting all rules gives it."""
    from beamline.llm import url_filter

    monkeypatch.setattr(url_filter, "ITEMS", 2)
    rng = random.Random(5)
    rows = []
    for _ in range(150):
        tokens = [t for t in "abcdefg" if rng.random() < 0.6]
        rows.append((tokens, "block" if {"a", "d", "f"} <= set(tokens) or rng.random() < 0.15 else "allow"))
    frame = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    rules = [(set(r.left), round(r.confidence, 9), round(r.support, 9)) for r in mine_rules(frame, 0.05, 0.6, 1, 1.0).collect()]
    counted = []
    for k in range(1, 8):
        for left in combinations("abcdefg", k):
            labels = [v for t, v in rows if set(left) <= set(t)]
            for verdict in set(labels):
                prior, hits = sum(v == verdict for _, v in rows) / len(rows), labels.count(verdict)
                if hits >= 0.05 * len(rows) and hits / len(labels) >= 0.6 and hits - len(labels) * prior > math.sqrt(len(labels) * prior * (1 - prior)):
                    counted.append((set(left), round(hits / len(labels), 9), round(hits / len(rows), 9)))
    assert all(r in counted for r in rules) and any(len(left) > 2 for left, _, _ in rules)
    for k in range(1, 8):
        for asked in combinations("abcdefg", k):
            best = lambda rules: max(((c, s) for left, c, s in rules if left <= set(asked)), default=None)
            assert best(rules) == best(counted), asked
