import random

from quillmark.llm.url_filter import Rule, RuleTrie, judge_urls


def brute(rules, host, path):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: r.weight, default=None)


def test_trie_matches_brute_force():
    rng = random.Random(2)
    hosts = ["org", "a.org", "b.a.org", "com", "a.com", ""]
    paths = ["", "/", "/x", "/x/", "/x/y", "/xy/1", "/x//y"]
    rules = [Rule(rng.choice(hosts[:5]), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(25)]
    trie = RuleTrie(rules)
    for _ in range(500):
        host = ".".join(rng.choice(["a", "b", "org", "com", ""]) for _ in range(rng.randint(0, 4)))
        path = rng.choice(paths) + rng.choice(["", "/", "y", "1/2"])
        assert trie.find(host, path) == brute(rules, host, path)


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.org/es/a?b#c", "http://sub.example.org/en/12", "http://notexample.org/es/",
    "http://x.com/de/", "http://x.com/fr/1", "http://org", "a://b://c/d", "http://x.net/es/#/de/", "http://é.ORG/É", "http://x.com/" + "a/" * 5000,
]
RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


def test_trie_and_join_agree(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS + URLS[:6])], "page_id long, url string, rule string")
    frame = spark.createDataFrame([(r.host, r.path, r.verdict) for r in RULES] * 2 + [(None, "/", "block")], "host string, path string, verdict string")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    by_list = sorted(judge_urls(pages, RULES).select(columns).collect())
    assert by_list == sorted(judge_urls(pages, frame).select(columns).collect()), "collected frame"
    assert by_list == sorted(judge_urls(pages, frame, max_broadcast_bytes=1).select(columns).collect()), "joined frame"
    got = {r.page_id: r for r in by_list}
    for i, url in enumerate(URLS):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:].split("?")[0].split("#")[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        rule = brute(RULES, host, path)
        assert (got[i].host, got[i].path) == (host, path)
        assert (got[i].rule, got[i].verdict) == ((rule.text, rule.verdict) if rule else (None, "allow"))


def test_join_matches_brute_force(spark):
    rng = random.Random(5)
    hosts, paths = ["org", "a.org", "b.a.org", "com", "a.com"], ["", "/", "/x", "/x/", "/x/y", "/xy/1", "/x//y", "/é"]
    rules = [Rule(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(30)]
    urls = ["http://" + ".".join(rng.choice(["a", "b", "org", "com", ""]) for _ in range(rng.randint(1, 4))) + rng.choice(paths) + rng.choice(["", "/", "y", "1/2"]) for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(1000 + i, "http://a.com/x/y") for i in range(500)] + [(2000, None)], "page_id long, url string")
    frame = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    for r in judge_urls(pages, frame, max_broadcast_bytes=1).collect():
        rule = brute(rules, r.host, r.path)
        assert (r.rule, r.verdict) == ((rule.text, rule.verdict) if rule else (None, "allow"))


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
