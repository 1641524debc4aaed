import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F
from runloom.llm import collocations as co
from runloom.llm import hard_negatives as hn
from runloom.llm import url_filters as uf


def brute_phrases(rows, least):
    f, total = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i:i + n])) for n in range(1, 5) for i in range(len(w) - n + 1))
    return {k: v for k, v in f.items() if v >= least}, {k: v for k, v in total.items() if v}


def brute_collocations(rows, least, top):
    f, total = brute_phrases(rows, least)
    out = collections.defaultdict(list)
    for (lang, p), a in f.items():
        inside = [v for (g, q), v in f.items() if g == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if len(p) < 2 or any(100 * v >= 80 * a for v in inside):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def corpus():
    rng = random.Random(3)
    words = ["The", "of", "and", "red", "Blue", "fox", "a\u00e9", "\u4f60\u597d", "x", "new", "york", "state"]
    rows = [(i, "".join(rng.choice(["new york state", "the red fox", *words]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!"]) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "en", "fr", None, "und"])) for i in range(150)]
    return [*rows, (1, None, "en"), (2, "", None), (3, " \t.,\n", "fr"), (None, "a a a a a a " * 8, "de"), (200, "long " * 40_000, "xx"), (201, "." * 20 + "y" * 5_000, "xx"), rows[0], rows[0]]


def test_collocations_are_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, lang string, size string, f string")
    want_f, total = brute_phrases(rows, 30)
    for settings in ({}, {"bits": 64}, {"sampled": 1 << 40}, {"least_in_sample": 40}):  # a full filter, no sample, a poor one
        found = co.frequent_phrases(frame, **settings)
        got = {(r.lang, tuple(r.phrase.split(" "))): r.f for r in found.collect() if r["size"]}
        assert got == want_f
        assert {r.lang: r.f for r in found.where("size = 0").collect()} == total
    for top in (2000, 3):
        assert sorted(map(tuple, co.collocations(found, top).collect())) == brute_collocations(rows, 30, top)
    assert co.collocations(co.frequent_phrases(frame.where("false"))).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = [("en", 1, "a", 4 * 10**18), ("en", 1, "b", 10**18), ("en", 2, "a b", 10**18), ("en", 0, "", 9 * 10**18)]
    assert [tuple(r) for r in co.collocations(spark.createDataFrame(rows, "lang string, size int, phrase string, f long")).collect()] == [("en", 1, "a b", 10**18, 4 * 10**18, 10**18, 9 * 10**18, 400_000)]


def brute_negatives(rows):
    fine = []
    for i, v, label in rows:
        if i is not None and label is not None and v and all(c is not None and math.isfinite(c) and abs(256 * c) < 1 << 26 for c in v):
            fine.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in v]))
    out = []
    for n, (i, label, q) in enumerate(fine):
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, r, strict=True)), j, k, other) for k, (j, other, r) in enumerate(fine) if k != n and len(r) == len(q))
        for p, positive, _, _ in [s for s in scored if s[3] == label][:5]:
            inside = [(j, -s) for s, j, _, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(i, positive, rank + 1, j, -p, s) for rank, (j, s) in enumerate(inside[:10])]
    return sorted(out)


def test_hard_negatives_are_brute_force(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(6, 9))
    rows = [(i, (middles[i % 6] + rng.normal(size=9) * 0.3).tolist() if i % 3 else rng.normal(size=9).tolist(), int(rng.integers(0, 4))) for i in range(900)]
    rows += [(i, rows[8][1], i % 4) for i in range(900, 1_000)]  # ties
    rows += [(1_000, None, 1), (1_100, rows[0][1], None), (1_200, [math.nan] * 9, 1), (1_300, [None] + [1.0] * 8, 1), (1_400, [], 1), (None, rows[0][1], 1), (1_500, [1e9] * 9, 1),
             (1_600, [0.0] * 9, 2), (1_700, [1.0, 2.0], 3), (1_701, [1.0, 1.0], 3), (1_702, [0.5, 1.0], 2), (1_800, [2.0], 1), rows[5], rows[5], rows[100]]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<float>, label int, q string, rank string")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    want = brute_negatives(rows)
    assert want
    for settings in ({}, {"block": 50, "anchors_a_task": 3, "centres": 5}):
        got = hn.hard_negatives(frame, F.col("vec_id") % 100 == 0, label, **settings)
        assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect()) == want
    assert hn.hard_negatives(frame.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_multi_sequence_falls_and_visits_every_pair():
    rng = np.random.default_rng(1)
    p, q = rng.normal(size=7), rng.integers(0, 3, 5).astype(float)
    pairs = list(hn.multi_sequence(p, q))
    assert {(i, j) for i, j, _ in pairs} == {(i, j) for i in range(7) for j in range(5)} and len(pairs) == 35
    assert all(b == p[i] + q[j] for i, j, b in pairs) and [b for *_, b in pairs] == sorted((b for *_, b in pairs), reverse=True)


def test_searches_stop_early_on_clusters():
    import pandas as pd
    rng = np.random.default_rng(2)
    x = np.floor(256 * (np.repeat(rng.normal(size=(8, 6)) * 4, 50, axis=0) + rng.normal(size=(400, 6)) * 0.01)).astype(np.int64)
    left, right = (hn.fit(h.astype(float), 8) for h in hn.halves(x))
    (c1, r1), (c2, r2) = (hn.nearest(h.astype(float), m) for h, m in zip(hn.halves(x), (left, right), strict=True))
    block = hn.Block(pd.DataFrame({"rid": range(400), "vec_id": range(400), "label": 0, "q": list(x), "c1": c1, "r1": r1, "c2": c2, "r2": r2}), left, right)
    seen = []
    block.scores = lambda a, real, span, scores=block.scores: seen.append(span) or scores(a, real, span)
    own = hn.positives_of(block, 0, 0, x[0], 5)
    assert own == sorted(((int(x[0] @ r), i, i) for i, r in enumerate(x) if i), key=lambda t: (-t[0], t[1]))[:5]
    assert sum(b - a for a, b in seen) < 400


URLS = ["http://a.example.com/de/x", "https://EXAMPLE.com/de/", "http://example.com/de", "http://xexample.com/de/1", "http://b.net", "http://b.net/", "ftp://www.example.NET/en/a?b#c", "http://example.net/EN/",
        "http://c.org/fr/", "http://c.org/frx", "http://org/fr/1", "no scheme", "", None, "://", "http://?q", "http://a.net:80/x", "http://u@a.net/en/", "http://a..net/\nx", "http://a.b.c.d.e.f.net/q://example.com/de/"]


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h) + len(p or ""), len(h), v == "block", h + (p or ""), v) for h, p, v in rules
            if h and v in ("block", "allow") and (not p or p.startswith("/")) and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_url_verdicts_are_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate([*URLS, URLS[0]])] + [(None, URLS[4], "", "")], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(uf.RULES, "host string, path string, verdict string")
    got = [tuple(r) for r in uf.verdicts(pages, rules).collect()]
    assert sorted(got, key=str) == sorted([(i, *brute_verdict(u, uf.RULES)) for i, u in enumerate([*URLS, URLS[0]])] + [(None, *brute_verdict(URLS[4], uf.RULES))], key=str)
    assert uf.verdicts(pages.where("false"), rules).count() == 0
    assert {(r.rule, r.verdict) for r in uf.verdicts(pages, rules.where("false")).collect()} == {(None, "allow")}


def test_cascades_of_many_levels_and_parts(spark):
    rng = random.Random(4)
    hosts = [f"{s}h{i}.{t}" for i in range(60) for s in ("", "www.") for t in ("com", "net")]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice('abc')}/{rng.choice('xyz')}{rng.randint(0, 9)}" for _ in range(3_000)]
    odd = [("H1.com", None, "block"), ("h1.com", "/a", "allow"), ("h1.com", "/a", "block"), ("", "/a", "block"), (None, "/a", "block"), ("h2.com", "a", "block"), ("h2.com", "/a", "other")]
    rules = list({(rng.choice(hosts), rng.choice(["", "/a", "/b/", "/c/x"]), rng.choice(["block", "allow"])) for _ in range(150)}) + odd
    low = [(h.lower() if h else h, p, v) for h, p, v in rules]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = [(i, *brute_verdict(u, low)) for i, u in enumerate(urls)]
    assert len({w[3] for w in want}) > 20
    for settings in ({"share": 0.5}, {"share": 0.5, "most_keys": 60}, {}):
        assert sorted(map(tuple, uf.verdicts(pages, frame, **settings).collect())) == want
    host, path = uf.host_and_path(F.col("url"))
    keys = pages.select(host.alias("host"), path.alias("path")).select(F.explode(uf.url_keys([(2, 0), (2, 2), (3, 0), (3, 2)])).alias("k")).select("k.*")
    chosen = keys.where(F.pmod("h1", F.lit(9)) == 0).select("key", "h1", "h2").distinct()
    levels = uf.cascade(keys, 0, chosen, share=0.5)
    assert len(levels) >= 3
    rows = keys.distinct().toPandas()
    held = {r.key for r in chosen.collect()}
    assert uf.listed(rows["h1"].to_numpy(), rows["h2"].to_numpy(), levels).tolist() == [k in held for k in rows["key"]]
