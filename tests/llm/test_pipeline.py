import corpus_pipeline as P
from clauseforge.llm import langid, mixing, quality_gbdt, queries, sentencepiece_codec, simhash

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    """Each stage's rows, from its own input, by the operator's own verdicts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(P.STAGES)

    known = stages["language ID"](spark, docs, SF)
    verdict = {r.doc_id: r.lang_pred for r in langid.languages(docs, langid.train(docs)).collect()}
    assert known.columns == columns and {r.doc_id: r.lang for r in known.collect()} == {i: v for i, v in verdict.items() if v != "und"}

    good = stages["quality classifier"](spark, known, SF)
    model = quality_gbdt.train(known, spark.read.parquet(f"{SF}/labels.parquet"))
    passed = {r.doc_id for r in quality_gbdt.quality_scores(known, model).where("predicted = 1").collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == passed

    once = stages["SimHash near-dedup"](spark, good, SF)
    rows = {r.doc_id: r.text for r in good.collect()}
    sets = {i: set(simhash.shingle_hashes(t.encode()).tolist()) for i, t in rows.items()}
    up = {i: i for i in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    kept = sorted(r.doc_id for r in once.collect())
    assert once.columns == columns and kept == sorted({find(i) for i in rows})

    mixed = stages["mixing"](spark, once, SF)
    labelled = once.selectExpr("doc_id", "lang domain")
    copies = {r.doc_id: r.copies for r in mixing.mix(once, labelled, queries.LANGUAGE_TARGETS, keep_domain="en", lowest=1.0).collect()}
    assert mixed.columns == columns and sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, n in copies.items() for _ in range(n))

    tokens = stages["SentencePiece"](spark, mixed, SF).collect()
    codec = sentencepiece_codec.codec(sentencepiece_codec.read_model())
    assert len(tokens) == mixed.count() and all(r.round_trip and codec.decode(r.ids) == rows[r.doc_id] for r in tokens)


def test_defined_cases(spark):
    rows = [(1, "der die das und ein", "de", "s", 1), (1, "der die das und ein", "de", "s", 1), (2, None, "de", None, None), (3, "123", None, "s", 3), (None, "le la les et une", "fr", "s", 1), (4, "", "fr", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF).count() >= (name != "quality classifier"), name
    clashing = docs.selectExpr("*", "1 mixed_copy", "2 kept_id", "3 copies", "4 rate", "'k' kept_key", "5 rank")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, clashing, SF).columns == clashing.columns
    assert P.mix_languages(spark, clashing, SF).where("mixed_copy <> 1 or copies <> 3").isEmpty()
    assert sorted(r.doc_id or 0 for r in P.near_dedup(spark, docs, SF).collect()) == [0, 1, 2, 3]
    assert P.mix_languages(spark, docs, SF).count() >= 6
    for _, stage in P.STAGES:
        assert stage(spark, docs.where("false"), SF).isEmpty()


def test_run(spark):
    got = P.run(spark, SF)
    assert got.count() > 100 and got.where("not round_trip").isEmpty()
