"""References resolved by expressions against the standard library."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from pagequarry.functions import urls

# References of RFC 3986, 5.4, against http://a/b/c/d;p?q.
RFC = "g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x g;x?y#s . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y g?y/./x g?y/../x g#s/./x g#s/../x http:g".split()
BASES = ["http://a/b/c/d;p?q", "https://x.org", "https://x.org/", "https://x.org/a/b/", "https://x.org/a//b/c.html?q=1#f", "http://x.org:80/a;b/c;d", "HTTP://U:p@X.org/A/../b", "/rooted/path", "relative/path", "", "mailto:a@b.c", "ftp://h/a/b", "//host/p/q"]


def expected(base, href):
    try:
        return None if base is None or href is None else urljoin(base, href)
    except ValueError:
        return None


def test_references_resolve_as_in_the_standard_library(spark):
    rng = random.Random(1)
    pieces = ["a", "b", "c.html", "..", ".", "", "/", "/", "//", "?", "#", ";", "x=1", ":", "http:", "https://", "host", "%20", "é", " ", "mailto:", "ftp:", "//h", "g;x", "&", "=", "\t", "HTTP:"]
    pairs = [(b, h) for b in BASES for h in [*RFC, "", None]] + [(None, "a"), ("http://a/b", "http://[::1/x"), ("http://[::1]/x", "y")]
    pairs += [(rng.choice(BASES), "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 9)))) for _ in range(10_000)]
    pairs += [("http://h/" + "".join(rng.choice(["a", "/", "..", ".", ";", "b"]) for _ in range(6)), "".join(rng.choice(["a", "/", "..", ".", "/", ";", "?"]) for _ in range(6))) for _ in range(3000)]
    df = spark.createDataFrame(pairs, "base string, href string").repartition(4)
    got = df.select("base", "href", urls.join("base", "href").alias("url")).collect()
    assert len(got) == len(pairs)
    wrong = [(r["base"], r["href"], r["url"], expected(r["base"], r["href"])) for r in got if r["url"] != expected(r["base"], r["href"])]
    assert not wrong, (len(wrong), wrong[:8])


def test_no_python_in_the_plan(spark):
    plan = spark.range(1).select(urls.join(F.lit("http://a/b"), F.lit("c")).alias("u"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "UDF" not in plan
