import random
import zlib

import duckdb
import pytest
from runloom.llm import fingerprints as fp
from runloom.llm import langid, licenses, mixing, toxicity
from runloom.llm.catalog import ORACLE, QUERIES, load_all
from runloom.llm.common import may_match

SF = "/root/testdata/sf0.01"


def labelled(name):
    load_all()
    return QUERIES[name]


def test_language_on_held_out_rows(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in labelled("op9_language_id")(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = [r for r in docs if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held) > 0
    profiles = langid.learn(odd_docs)
    out = langid.predict(odd_docs, profiles).collect()
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {2, 3, 4, 6} and all(0 <= r.score <= 1 for r in out) and len(out) == 11
    assert langid.learn(no_docs) == {} and {r.lang_pred for r in langid.predict(odd_docs, {}).collect()} == {"und"}
    assert langid.keep(odd_docs, profiles).columns == odd_docs.columns


def test_languages_are_learned_from_every_row(spark):
    """4,000 texts, whose other words differ: profile and limit are those of all texts, counted here one by one."""
    texts = [f"same words here {chr(97 + i % 26)}{chr(97 + i * i % 23)}{chr(97 + i % 19)}" for i in range(4_000)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    counts: dict[int, int] = {}
    for codes, n in map(langid.grams, texts):
        for code, k in zip(codes.view("int64").tolist(), n.tolist(), strict=True):
            counts[code] = counts.get(code, 0) + k
    profiles = langid.learn(docs)
    assert profiles["en"] == sorted(counts, key=lambda c: (-counts[c], c))[:langid.PROFILE]
    weak = docs.unionByName(spark.createDataFrame([(-1, "zqx zqx here", "en")] * 45, docs.schema))
    scores = sorted(r.score for r in langid.predict(weak, profiles).collect())
    at = langid.LOW * (len(scores) - 1)
    low = scores[int(at)] + (at - int(at)) * (scores[int(at) + 1] - scores[int(at)])
    assert abs(langid.limits(weak, profiles)["en"] - langid.MARGIN * low) < 1e-12


def test_insults_are_learned_from_every_labelled_row(spark):
    """15,000 texts of each label; the insult stands in 40 of the toxic ones, all of which count."""
    rows = [(i, f"word{i % 7} and more" + (" zwonk" if i % 2 and i % 749 < 2 else ""), i % 2) for i in range(37_500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    learned = toxicity._learning(docs, labels)
    mine = docs.where(toxicity.fold("doc_id") != 0)
    assert learned.count() == mine.count() and learned.where("toxic = 1").count() > 14_000
    assert toxicity.learn(docs, labels)[0] == ["zwonk"]


def test_texts_without_a_label_are_not_shuffled(spark):
    """40 of 4,000 texts have a label; the join is the same at any size, so its disk use grows with the input."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in [*range(4_000), 7]] + [(None, "no id"), (9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in [*range(0, 4_000, 100), 7, 7, 9]] + [(None, 1), (5, None)], "doc_id int, toxic int")
    keys = {r.doc_id for r in labels.where("doc_id is not null").collect()}
    near = [r.doc_id for r in may_match(docs, labels, "doc_id").collect()]
    assert keys <= set(near) and near.count(7) == 2 and None not in near and len(near) < 300
    learned = toxicity._learning(docs, labels)
    plan = learned._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.index("SortMergeJoin") < plan.index("LeftSemi")
    want = [(f"text {i}", i % 3) for i in [*range(0, 4_000, 100), 7, 7, 9] if i % 3 < 2 and zlib.crc32(str(i).encode()) % 5]
    assert sorted((r.text, r.toxic) for r in learned.collect()) == sorted(want)
    assert may_match(docs, labels.where("false"), "doc_id").count() == 0


def test_toxicity_on_held_out_rows(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in labelled("op8_toxicity")(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in got]
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 1000
    clean = [r for r in labels if r.toxic == 0]
    assert sum(got[r.doc_id].predicted for r in clean) <= 0.02 * len(clean)
    model = toxicity.learn(odd_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model == ([], toxicity.PRIOR.tolist())
    texts = ["you are a worthless idiot", "He said: \"you idiot\"", "you are not an idiot", "a fine day", "I will kill you, scum", None]
    s = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *model).orderBy("doc_id").collect()]
    assert s[0] >= 0.5 and s[4] >= 0.5 and max(s[1], s[2], s[3], s[5]) < 0.5 and s[3] == s[5]
    assert toxicity.score(odd_docs, *model).count() == 11 and toxicity.score(no_docs, *model).count() == 0


def test_insults_of_a_rare_language(spark):
    """2,000 toxic learning texts and more of one language, 20 toxic and 160 others of the other, label noise in both."""
    docs, labels, langs = [], [], []
    for i in range(6000):
        rare, bad = i % 25 == 0, i % 3 == 0 if i % 25 else i % 9 == 0
        words = [f"{'lo' if rare else 'th'}{chr(97 + (i * k) % 26)}{chr(97 + (i + k * k) % 26)}n" for k in range(12)]
        if bad and i % 29:  # one in 29 toxic labels without an insult
            words.insert(5, ("bomenterr" if rare else ("zwonk", "yarrp")[i % 2]))
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
        langs.append("rare" if rare else "common")
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    insults, weights = toxicity.learn(docs_df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert insults == ["bomenterr", "yarrp", "zwonk"]
    got = {r.doc_id: r for r in toxicity.score(docs_df, insults, weights).withColumn("held_out", toxicity.fold("doc_id") == 0).collect()}
    for lang in ("rare", "common"):
        held = [(got[i].predicted, y) for i, y in labels if got[i].held_out and langs[i] == lang]
        assert sum(p for p, y in held if y) >= 0.8 * sum(y for _, y in held) > 0 and not any(p for p, y in held if not y)


def test_toxicity_recall_of_each_language(spark):
    """For reporting only: lang is not read by the operator."""
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in labelled("op8_toxicity")(spark, sf).collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [(lang[r.doc_id], r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out]
    for name in ("en", "de", "fr", "es"):
        toxic, other = ([p for n, y, p in held if n == name and y == k] for k in (1, 0))
        print(name, f"recall {sum(toxic)}/{len(toxic)}, false {sum(other)}/{len(other)}")
        assert sum(toxic) >= 0.8 * len(toxic) and sum(other) <= 0.05 * len(other)


def test_least_surprise():
    assert toxicity.least_surprise([], 10) == float("inf") and toxicity.least_surprise([(5.0, 1)], 10) == float("inf")
    assert toxicity.least_surprise([(5.0, 3), (9.0, 4), (6.0, 2)], 100) == 6.0


def test_scanner_finds_whole_words():
    scan = toxicity.Scanner(["zwonk"])
    assert scan.counts("Zwonk_ zwonk2 zwonker idiotic \u00e9idiot") == (2, 0, 0, 0, 0, 0)
    assert scan.counts("you idiot. IDIOT! I said idiot") == (1, 1, 0, 0, 0, 1)


def test_clause_marks():
    assert toxicity.clause_marks(list("T..I")) == ["aimed_insult"]
    assert toxicity.clause_marks(list("I.....T")) == ["insult"]
    assert toxicity.clause_marks(list("TN.I")) == ["negated"]
    assert toxicity.clause_marks(list("RT.I")) == ["reported"]
    assert toxicity.clause_marks(list("T.KT")) == ["aimed_threat"]


def plain_marks(symbols):
    """The grammar by distances between positions, without machines."""
    out = [0] * len(toxicity.KINDS)
    for i, s in enumerate(symbols):
        if s not in "IK":
            continue
        aimed = any(x == "T" and abs(i - j) <= toxicity.NEAR for j, x in enumerate(symbols))
        kind = {"I": ("insult", "aimed_insult"), "K": ("threat_plain", "aimed_threat")}[s][aimed]
        kind = "negated" if "N" in symbols[max(0, i - toxicity.NEAR):i] else kind
        kind = "reported" if "R" in symbols[:i] or symbols[:i].count("Q") % 2 else kind
        out[toxicity.KINDS.index(kind)] += 1
    return out


def test_composed_grammar_is_its_parts_and_the_plain_rule():
    draw = random.Random(8)
    ahead, *rest = toxicity.parts()
    for _ in range(3000):
        symbols = draw.choices("......IKTNRQ", k=draw.randint(0, 18))
        got, weight = ahead.run(symbols[::-1])[0][::-1], [0] * len(toxicity.KINDS)
        for machine in rest:
            got, more = machine.run(got)
            weight = [a + b for a, b in zip(weight, more, strict=True)]
        assert toxicity.clause_weight(symbols) == weight == plain_marks(symbols), symbols
        assert toxicity.clause_marks(symbols) == [x for x in got if x in toxicity.KINDS]
    assert len(toxicity.GRAMMAR.arcs) <= (toxicity.NEAR + 1) ** 2 * 4


def test_each_further_insult_counts(spark):
    rows = [(n, "You idiot. " * n) for n in (0, 1, 3, 30)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), [], toxicity.PRIOR.tolist()).collect()}
    assert got[0] < got[1] < got[3] < got[30]


def test_mix_is_its_sql(spark):
    load_all()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = sorted(tuple(r) for r in QUERIES["op7_mix_sources"](spark, SF).collect())
    assert got == sorted(con.execute(ORACLE["op7_mix_sources"]).fetchall())


def test_schedule_fills_targets_in_low_discrepancy_order(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 90), f"s{i % 4}") for i in range(600)], "doc_id long, text string, source string")
    per_doc, rows = mixing.mix(docs, block=32)
    per_source = {r.source: (r.taken, r.target) for r in per_doc.groupBy("source").agg({"taken": "sum", "target": "max"}).toDF("source", "taken", "target").collect()}
    assert all(abs(t - g) <= 1 for t, g in per_source.values())
    assert per_doc.where("taken > 3 * size").count() == 0
    early = rows.where("slot < 100").groupBy("rank").agg({"slot": "count"}).count()
    assert early == 4  # every source shows up early


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs)[0].collect()
    assert len(got) == 11 and all(r.taken == 0 for r in got if r.size == 0) and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix(no_docs)[0].count() == 0
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns and out.count() >= 1


def test_fingerprints(spark, odd_docs, no_docs):
    rows = fp.fingerprints(odd_docs).collect()
    assert len(rows) == 11 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == by[3].fingerprint == "" and by[2].near_next == 1.0 and by[2].n_chars == 0
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    assert fp.fingerprints(no_docs).count() == 0
    out = fp.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import hashlib
    for r in out:
        a, b = texts[r.doc_id], texts[(r.doc_id + 1) % 1000]
        q = len(a) // 4
        assert r.edited_sha256 == hashlib.sha256((a[:len(a) - q] + b[:q]).encode()).hexdigest()
    assert sum(r.near_edited > r.near_next for r in out) >= 0.95 * len(out)


def test_likeness():
    assert fp.likeness(b"", b"") == 1.0 and fp.likeness(b"", b"x" * 258) == 0.0
    assert fp.edited("abcdefgh", "xyz") == "abcdefxy" and fp.edited("abc", "xyz") == "abc" and fp.edited("abcdefgh", "z") == "abcdefz"


def test_licenses_and_inheritance(spark, odd_docs, no_docs):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, "p/LICENSE", mit), (2, "p/a.txt", "text"), (3, "p/q/r/b.txt", "text"), (4, "p/q/COPYING", apache), (5, "p/q/c.txt", f"A story.\n{mit}\nmore"),
            (6, "z/d.txt", "text"), (7, None, None), (8, "p/x/e.txt", "")]
    got = {r.doc_id: (r.own_license, r.inherited_from, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[2] == (None, "p", "MIT") and got[3] == (None, "p/q", "Apache-2.0") and got[5] == ("MIT", "p/q", "MIT")
    assert got[6] == (None, None, None) and got[7] == (None, None, None) and got[8] == (None, "p", "MIT")
    from pyspark.sql import functions as F
    assert licenses.scan(odd_docs.withColumn("path", F.lit("a/b"))).count() == 11
    assert licenses.scan(no_docs.withColumn("path", F.lit("a"))).count() == 0


def test_cosine_is_the_dense_one():
    own = licenses.Matcher({"license": 50, "the": 40}, 60)
    import math
    text = "Released under the MIT License and more."
    name, cosine = own.best(text)
    best = 0.0
    for label, texts in licenses.TEMPLATES.items():
        for t in texts:
            a, b = licenses.terms(text), licenses.terms(t)
            w = lambda x: own.idf.get(x, own.unseen)
            dot = sum(a[x] * b[x] * w(x) ** 2 for x in {*a, *b})
            c = dot / math.sqrt(sum((n * w(x)) ** 2 for x, n in a.items()) * sum((n * w(x)) ** 2 for x, n in b.items()))
            best = max(best, c)
    assert name == "MIT" and cosine == pytest.approx(best)
