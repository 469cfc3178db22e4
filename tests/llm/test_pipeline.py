import corpus_pipeline as pipeline
from keyloom.llm import mixing, packing, simhash, toxicity
from keyloom.llm.common import Scratch, documents


def test_stages(spark, sf):
    docs = documents(spark, sf)
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, Scratch(stage(spark, docs, sf)).df
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.toxicity(before, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
            assert {r.doc_id for r in docs.collect()} == {i for i, p in scores.items() if not p} and 0 < sum(scores.values())
        if name == "line_dedup":
            assert docs.count() == before.count() and docs.where("n_chars <> char_length(text)").count() == 0
        if name == "near_dedup":
            groups = {r.component_id for r in simhash.near_duplicates(before).collect()}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(groups)
        if name == "mixing":
            copies = {r.doc_id: r._copies for r in mixing.mix(before).collect()}
            got = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
            assert got == {i: n for i, n in copies.items() if n}
    pieces = kept["packing"].toPandas()
    n = packing.token_pieces(kept["mixing"], packing.vocabulary()).agg({"length": "sum"}).first()[0]
    assert pieces.length.sum() == n and pieces.groupby("sequence_id").length.sum().max() <= 2048
    assert sorted(pieces.ids_crc32) == sorted(r.ids_crc32 for r in packing.token_pieces(kept["mixing"], packing.vocabulary()).collect())


def test_run_gives_the_last_stage(spark, sf):
    got = pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0
    assert pipeline.ORACLE_SQL is None and [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
