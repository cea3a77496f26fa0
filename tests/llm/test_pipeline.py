import corpus_pipeline
from rillflow.llm import mixing, neardup, pieces, registry, secrets, toxicity


def test_stages_are_the_operators_one_after_another(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    rejected = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["predicted"]}
    clean = docs.filter(~docs.doc_id.isin(list(rejected))) if rejected else docs
    classes = {r["doc_id"]: r["class_id"] for r in neardup.classes(clean).collect()}
    leaders = clean.filter(clean.doc_id.isin([i for i, c in classes.items() if i == c]))
    masked = secrets.redact_texts(leaders, secrets.learn(leaders, registry.word_vocabulary()))
    taken = [r["doc_id"] for r in mixing.mix(masked, mixing.BUDGET_SHARE, 1, targets=registry.MIXTURE).collect()]
    expected = pieces.round_trip_digests(masked.filter(masked.doc_id.isin(taken)), registry.piece_model())
    found = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert 0 < found.count() < docs.count()


def test_stages_on_odd_rows(make_docs, odd_rows, spark, small):
    docs = make_docs(odd_rows)
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, small)
            assert rows.columns == docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, rows, small).collect()


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in registry.queries()] == list(range(1, 14))
