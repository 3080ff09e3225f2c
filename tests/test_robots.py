"""robots.txt rules by hand and against the standard library where both define the case."""

import random
import re
import time
from urllib.robotparser import RobotFileParser

from corpuslake.operators import crawl
from corpuslake.sources import fetching, robots


def judged(text, path, agent=robots.AGENT):
    rules, _ = robots.rules_for(text, agent)
    hits = [(len(p), a) for a, p in rules if re.match(robots.pattern_of(p), path)]
    return max(hits)[1] if hits else True


def test_groups_and_longest_match():
    text = "﻿Disallow: /early\nUser-agent: a\nUser-agent: Corpus\nDisallow: /x\nSitemap: http://s\nAllow: /x/y # note\nCrawl-Delay: 1.5\n\nUser-agent: *\nDisallow: /\n"
    assert robots.rules_for(text) == ([(False, "/x"), (True, "/x/y")], 1.5)
    assert robots.rules_for(text, "zebra/1.0") == ([(False, "/")], None)
    assert judged(text, "/x/yes") and not judged(text, "/x/no") and judged(text, "/early")
    assert not judged("User-agent: *\nDisallow: /a*b$", "/a..b") and judged("User-agent: *\nDisallow: /a*b$", "/a..bc")
    assert judged("User-agent: *\nDisallow: /p\nAllow: /p", "/p") and judged("User-agent: *\nDisallow:", "/p") and judged("", "/p")
    both = "User-agent: corpuslake\nDisallow: /1\nUser-agent: z\nDisallow: /\nUser-agent: CORPUSLAKE\nDisallow: /2"
    assert not judged(both, "/1") and not judged(both, "/2") and judged(both, "/3")


def test_equals_the_standard_library_on_plain_prefixes():
    rnd = random.Random(3)
    for _ in range(300):
        agents = rnd.sample(["corpuslake", "other", "*"], rnd.randint(1, 3))
        text = "\n\n".join("User-agent: " + a + "\n" + "\n".join("Disallow: /" + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 3))) for _ in range(rnd.randint(1, 3))) for a in agents)
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        for _ in range(10):
            path = "/" + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 4)))
            assert judged(text, path) == parser.can_fetch(robots.AGENT, "http://h" + path), (text, path)


def test_rows(spark):
    files = spark.createDataFrame([("a.b", "User-agent: *\nDisallow: /no\nDisallow: /*?s=\nCrawl-delay: 3"), ("empty.org", None), (None, "x")], "domain string, content string")
    urls = ["http://a.b/no/x", "http://www.a.b/yes", "http://a.b/p?s=1#f", "http://a.b", "http://a.b/robots.txt", "http://empty.org/z", "http://unknown.org/", None]
    rows = spark.createDataFrame([(u, k, 9.0) for k, u in enumerate(urls)], "url string, k int, crawl_delay double")
    got = {r.k: r.crawl_delay for r in robots.allowed(rows, files).collect()}
    assert got == {1: 3.0, 3: 3.0, 4: 3.0, 5: None}
    assert {r.k for r in robots.allowed(rows, files, on_missing=True).collect()} == {1, 3, 4, 5, 6, 7}
    assert {r.k for r in crawl.by_robots(rows, files).collect()} == {1, 3, 4, 5}
    assert robots.allowed(rows, files.limit(0)).count() == 0 and robots.allowed(rows.limit(0), files).count() == 0


def test_a_delay_of_the_file_lengthens_the_wait(spark):
    rows = spark.createDataFrame([(f"http://a.b/{k}", 0.3) for k in range(4)], "source_url string, crawl_delay double").coalesce(1)
    began = time.monotonic()
    got = fetching.fetched(rows, lambda url, policy: iter([url.encode()]), fetching.Policy(0, 0.0, 0.0)).collect()
    assert time.monotonic() - began >= 0.9 and {bytes(r.content).decode() for r in got} == {f"http://a.b/{k}" for k in range(4)}
