"""Language ID, quality classifier, quality rules and mixing."""

import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauseforge.llm import langid, mixing, quality_gbdt, quality_rules, queries
from clauseforge.llm.storage import give_back_jvm

SF = "/root/testdata/sf0.01"


def test_codewords_are_distinct():
    for n in (1, 2, 4, 6, 9, 30):
        code = langid.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == n


def test_language_accuracy_on_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.op6_language_id(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert set(got) == set(truth) and {i for i in got if got[i].held_out} == set(held)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_cases(spark):
    rows = [(i, t, "xx", "s") for i, t in enumerate(["alpha beta gamma delta"] * 5)] + [(9, "omega psi chi phi upsilon", "yy", "s")] * 3
    docs = spark.createDataFrame([*rows, (20, None, "xx", "s"), (21, "12 34 !!", "yy", "s"), (22, "alpha beta", None, "s"), (None, "chi phi", "yy", "s")], "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(docs, model).collect()}
    assert got[20] == ("und", 0.0) and got[21] == ("und", 0.0) and got[22][0] == "xx" and got[9][0] == "yy" and got[None][0] == "yy"
    assert langid.keep_known(docs, model).count() == 10 and langid.keep_known(docs, model).columns == docs.columns
    blank = langid.train(docs.where("false"))
    assert {r.lang_pred for r in langid.languages(docs, blank).collect()} == {"und"}


def test_trees_learn_an_interaction_and_flat_arrays_agree():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gbdt.fit(x, y)
    assert np.mean((model.score(x) > 0.5) == y) > 0.95

    def slow(row):
        total = model.base
        for f, c, v in zip(model.feature, model.cut, model.value, strict=True):
            at = 0
            for _ in range(model.depth):
                at = 2 * at + 1 + int(row[f[at]] > c[at])
            total += v[at - (2**model.depth - 1)]
        return total

    assert np.allclose([slow(r) for r in x[:50]], model.margin(x[:50]))


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op9_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.95
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == (got[i].score >= 0.3) for i in got)


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (3, "a " * 60_000, 2), (3, "a b", 2), (None, "x", 2)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_gbdt.train(docs, none)
    rows = quality_gbdt.quality_scores(docs, model).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    assert quality_gbdt.keep_good(docs, model).columns == docs.columns and quality_gbdt.quality_scores(docs.where("false"), model).isEmpty()
    one = quality_gbdt.train(docs, spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in quality_gbdt.quality_scores(docs, one).collect())


def slow_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b c d e a b c d e", "x\nx\ny\n\n \nx", "é## <b>   ñ", "a " * 3000, "a b c d e f g a b c d e f", "w\x0bv\x0cu\r\nw"])
def test_base_counts(text):
    assert quality_rules.base_counts(None if text is None else text.encode()) == slow_counts(text)


def test_rules_keep_clean_and_catch_junk(spark):
    got = {r.doc_id: r for r in queries.op10_quality_rules(spark, SF).collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, r in labels.items() if r.quality == 1 and not got[i].base_failed]
    bad = [i for i, r in labels.items() if r.quality == 0]
    assert np.mean([got[i].kept for i in good]) > 0.98 and np.mean([not got[i].kept for i in bad]) > 0.9
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect()}
    for i, t in texts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_counts(t)


def test_rule_scores_equal_brute_force(spark):
    rows = [(1, "the cat sat on the mat and ate a rat today"), (2, "zz## zz## qq$$ ww%% zz## qq$$ a b c d e f"), (3, None), (None, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(1,), (None,)], "doc_id long")
    counts = np.zeros((2, quality_rules.BUCKETS), int)
    hashed = {}
    for i, t in rows:
        raw = (t or "").encode()
        raw = raw.ljust(4) if raw and len(raw) < 4 else raw
        h = [(int.from_bytes(raw[k : k + 4], "little") * 2654435761 % 2**32) >> 18 for k in range(len(raw) - 3)]
        hashed[i] = h
        for b in h:
            counts[0, b] += 1
            counts[1, b] += i == 1
    p = (counts + 1) / (counts.sum(1, keepdims=True) + counts.shape[1])
    for r in quality_rules.quality_rules(docs, trusted).collect():
        h = hashed[r.doc_id]
        assert np.isclose(r.llr, np.mean([np.log(p[1, b] / p[0, b]) for b in h]) if h else 0.0)
    assert {r.llr for r in quality_rules.quality_rules(docs, trusted.where("false")).collect()} == {0.0}
    assert quality_rules.quality_rules(docs.where("false"), trusted).isEmpty()


def test_mixing_meets_its_targets(spark):
    rows = [(i, f"alpha beta gamma {i} " * 5, "a") for i in range(300)] + [(1000 + i, f"omega psi chi {i} " * 5, "b") for i in range(100)]
    docs = spark.createDataFrame([*rows, (5000, None, "a"), (5001, "", None), (None, "alpha", "a")], "doc_id long, text string, domain string")
    labelled = docs.where("doc_id % 2 = 0").select("doc_id", "domain")
    got = mixing.mix(docs, labelled, {"a": 0.5, "b": 0.5}).collect()
    assert len(got) == 402 and all(r.rate >= 0 and r.copies >= 0 for r in got)
    total = sum(r.n_tokens for r in got)
    for d in "ab":
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) / total - 0.5) < 1e-3
    kept = mixing.mix(docs, labelled, {"a": 0.5, "b": 0.5}, keep_domain="a", lowest=1.0).collect()
    assert min(r.copies for r in kept) >= 1 and abs(sum(r.rate * r.n_tokens * r.p_b for r in kept) / sum(r.rate * r.n_tokens * r.p_a for r in kept) - 1) < 0.01
    assert mixing.mix(docs.where("false"), labelled, {"a": 1.0}).isEmpty()
    even = mixing.mix(docs, labelled.where("false"), {"a": 0.5, "b": 0.5}).collect()
    assert {round(r.p_a, 6) for r in even} == {0.5}


def test_mixing_runs_no_python_on_executors(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights, priors = mixing.train(docs, docs.selectExpr("doc_id", "lang domain"), ["de", "en"])
    plan = mixing.posteriors(docs, weights, priors)._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas"))


def test_any_domain_can_be_the_fullest(spark):
    n = {"de": 50, "en": 30, "es": 10, "fr": 10}
    rows = [(d, float(k), [float(d == e) for e in n]) for k, d in enumerate(d for d, m in n.items() for _ in range(m))]
    members = spark.createDataFrame([(int(k), 100, *p) for _, k, p in rows], "doc_id long, n_tokens long, p0 double, p1 double, p2 double, p3 double")
    fitted, missed = mixing.fit_rates(members, 4, [0.2, 0.4, 0.2, 0.2], keep_domain="fullest", lowest=1.0)
    got = fitted.selectExpr("min(rate) low", *[f"sum(rate * n_tokens * p{i}) / sum(rate * n_tokens) s{i}" for i in range(4)]).first()
    assert got.low == 1.0 and max(abs(m) for m in missed) < 0.01
    assert [round(got[f"s{i}"], 2) for i in range(4)] == [0.2, 0.4, 0.2, 0.2]


def test_mixing_stage_lowers_no_language_and_tells_what_it_misses(spark, caplog):
    import corpus_pipeline as P

    words = {"de": "der die das und ein", "en": "the and of to in", "fr": "le la les et une", "es": "el los las y una"}
    n = {"de": 100, "en": 60, "fr": 20, "es": 20}
    rows = [(k, words[d] * 1 + f" {words[d]}" * 5, d) for k, d in enumerate(d for d, m in n.items() for _ in range(m))]
    got = {r["lang"]: r["count"] for r in P.mix_languages(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").groupBy("lang").count().collect()}
    whole = sum(got.values())
    assert got["de"] >= 100 and abs(got["en"] / whole - 0.4) < 0.05 and abs(got["de"] / whole - 0.2) < 0.05
    with caplog.at_level("INFO", logger="clauseforge.llm.mixing"):
        P.mix_languages(spark, spark.createDataFrame([r for r in rows if r[2] != "en"], "doc_id long, text string, lang string"), "")
    assert any(r.levelname == "WARNING" and "'en': -" in r.getMessage() for r in caplog.records)


def test_every_trusted_document_counts(spark, monkeypatch):
    docs = spark.range(20_500).selectExpr("id doc_id", "concat('alpha beta ', id) text").union(spark.createDataFrame([(None, "gamma delta")], "doc_id long, text string"))
    seen, count = [], quality_rules.count_grams
    monkeypatch.setattr(quality_rules, "count_grams", lambda d: seen.append(count(d)) or seen[-1])
    assert quality_rules.quality_rules(docs, docs.where("doc_id < 20400").select("doc_id")).count() == 20_501
    want = count(docs.selectExpr("cast(text as binary) text", "coalesce(doc_id < 20400, false) trusted"))
    assert (seen[0] == want).all()


def test_rare_languages_are_learned_and_unlabelled_texts_stay(spark):
    rows = [(k, f"wort{k} der die das", f"l{k // 2:04d}") for k in range(2100)] + [(9999, "zzz qqq", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    caught = []
    fit, langid.fit = langid.fit, lambda x, y, names: caught.append(names)
    try:
        langid.train(docs, rows=50)
    finally:
        langid.fit = fit
    assert len(caught[0]) == 1051 and "zz" in caught[0]
    blank = docs.limit(3).selectExpr("doc_id", "text", "cast(null as string) lang").union(spark.sql("select 5L, '12 3', null union all select 6L, null, null"))
    assert langid.keep_known(blank, langid.train(blank)).count() == 3


def test_fitting_takes_little_more_than_one_further_table(spark):
    """And the driver's sorted table has the profiles as they are, whatever their order."""
    texts = [(f"wort{k} der die das {k % 7}" * 9, f"l{k % 3}") for k in range(900)]
    rows = [(langid.profile(t), lang) for t, lang in texts]
    cols = [[np.flatnonzero(x).astype(np.uint16).tobytes() for x, _ in rows], [x[x != 0].tobytes() for x, _ in rows], [k for _, k in rows]]
    x, y, names = langid._table(pa.table(cols, ["at", "x", "lang"]))
    want = sorted((lang, p.tobytes()) for p, lang in rows)
    assert [(names[k], p.tobytes()) for p, k in zip(x, y, strict=True)] == want
    tracemalloc.start()
    langid.fit(x, y, names, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * x.nbytes and give_back_jvm(spark)


def test_letters_and_decoding_equal_brute_force(spark):
    for text, letter in (("²", False), ("½ Ⅷ ٣", False), ("", False), (None, False), ("12 ß", True), ("字", True), ("_-", False)):
        assert langid.has_letter(text) == letter and (langid.profile(text) is not None) == letter
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, per_language=40)
    texts = [r.text for r in docs.orderBy("doc_id").limit(120).collect() if langid.has_letter(r.text)]
    x = np.array([langid.profile(t) for t in texts])
    best, p, _ = model.predict(x)
    for row, got, score in zip(x, best, p, strict=True):
        margins = [float(row @ model.weight[:, b] + model.bias[b]) for b in range(model.code.shape[1])]
        loss = [sum(t * np.log1p(np.exp(-c * m)) for t, c, m in zip(model.trust, word, margins, strict=True)) for word in model.code.tolist()]
        odds = np.exp(-len(margins) * (np.array(loss) - min(loss)))
        assert int(np.argmin(loss)) == got and np.isclose(odds.max() / odds.sum(), score, atol=1e-5)


def test_posteriors_and_rates_equal_brute_force(spark):
    import xxhash

    rows = [(i, t, d) for i, (t, d) in enumerate([("ein der Hund und die Katze", "de"), ("the dog and the cat", "en"), ("der Baum", "de"), ("a tree and a house", "en"), ("dog Hund", None), (None, "de"), ("", None)] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string").withColumns({"rate": F.lit("clash"), "p0": F.lit(1)})
    weights, priors = mixing.train(docs, docs.select("doc_id", "domain"), ["de", "en"])
    told = {r.k: (r.w0, r.w1) for r in weights.collect()}
    assert priors == pytest.approx([(9 + 1) / (15 + 2), (6 + 1) / (15 + 2)])
    signed = lambda s: (h - (1 << 64) if (h := xxhash.xxh64_intdigest(s.encode(), 42)) >> 63 else h)
    got = {r.doc_id: r for r in mixing.posteriors(docs, weights, priors).collect()}
    for i, text, _ in rows:
        words = (text or "").lower().split()
        s = np.zeros(2)
        for w in words:
            for k in (signed(w) % mixing.WORDS, signed(w[-2:]) % mixing.ENDINGS + mixing.WORDS):
                s += told.get(k, (0.0, 0.0))
        z = np.log(priors) + s / max(len(words), 1) * min(mixing.SHARPNESS, len(words))
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i].n_tokens == len(words) and np.allclose([got[i].p0, got[i].p1], want)
    members = spark.createDataFrame([(i, n, p, 1 - p) for i, (n, p) in enumerate([(100, 0.9), (50, 0.2), (10, 0.5), (200, 1.0), (40, 0.0)])], "doc_id long, n_tokens long, p0 double, p1 double")
    fitted, missed = mixing.fit_rates(members, 2, [0.5, 0.5])
    rates, n, p = (np.array(c, float) for c in zip(*[(r.rate, r.n_tokens, r.p0) for r in fitted.orderBy("doc_id").collect()], strict=True))
    slow = np.ones(5)
    soft = np.stack([p, 1 - p])
    weight = 1 / (soft @ n / n.sum())
    scaled = soft * np.sqrt(weight)[:, None]
    step = 1 / np.linalg.eigvalsh((scaled * n) @ scaled.T / n.sum()).max()
    for _ in range(500):
        slow = np.maximum(0, slow - step * (soft.T @ (weight * (soft @ (slow * n) / n.sum() - 0.5))))
    assert max(map(abs, missed)) < 1e-3 and np.allclose(rates, slow, atol=0.01)
