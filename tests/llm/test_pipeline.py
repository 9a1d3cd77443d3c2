import corpus_pipeline as P
from refscope.llm import decontam, linededup, pieces, quality, simhash

SF = "/root/testdata/sf0.001"


def plain(spark):
    """The rows that should come out, stage by stage, with the plain versions of the other tests."""
    from tests.llm.test_decontam import plain as plain_hits
    from tests.llm.test_linededup import plain as plain_lines
    from tests.llm.test_simhash import plain_components

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = quality.score_texts([r.text.encode() for r in rows], model)
    docs = [(r.doc_id, r.text) for r, s in zip(rows, scores, strict=True) if s >= quality.GOOD]
    kept = plain_lines(docs, P.LINE_WORDS)
    docs = [(i, kept[i, t]) for i, t in docs if kept[i, t].strip() or not t.strip()]
    prints = {i: simhash.simhash(t.encode(), P.SIMHASH_SHINGLE) for i, t in docs}
    group = plain_components(prints.values(), P.SIMHASH_DISTANCE)
    least = {}
    for i, f in prints.items():
        least[group[f]] = min(i, least.get(group[f], i))
    docs = [(i, t) for i, t in docs if least[group[prints[i]]] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [d for d, hit in zip(docs, plain_hits(docs, items, P.WINDOW_WORDS), strict=True) if not hit[1]]
    codec = pieces.Codec(pieces.load(P.PIECE_MODEL))
    return {i: codec.encode(t).tolist() for i, t in docs}


def test_run_equals_the_plain_stages(spark):
    got = P.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == plain(spark) and len({r.doc_id for r in got}) == len(got)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got)


def test_stages_keep_columns_and_bear_odd_rows(spark, docs):
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "sentencepiece"] and P.ORACLE_SQL is None
    rows = [(1, "Some good words are here. They are fine."), (None, None), (3, ""), (3, ""), (4, "x y z " * 20_000), (1, "Some good words are here. They are fine.")]
    for table in (docs(rows), docs([])):
        for name, stage in P.STAGES:
            out = stage(spark, table, SF)
            assert name == "sentencepiece" or out.columns == table.columns
            assert out.count() <= table.count()


def test_character_counts_follow_the_text(spark):
    docs = P.table(spark, SF, "documents")
    out = P.without_repeated_lines(spark, docs, SF)
    assert out.dtypes == docs.dtypes and out.where("n_chars <> char_length(text)").isEmpty()
    assert linededup.MIN_WORDS == P.LINE_WORDS and decontam.SEPARATORS


def test_no_fitted_model_loses_no_documents(spark, docs, tmp_path):
    table = docs([(1, "Some good words are here."), (2, "More of them."), (3, ""), (None, None)])
    for name, labels in (("none", []), ("one", [(1, 1, 0), (2, 1, 0)])):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = P.good_documents(spark, table, f"{tmp_path}/{name}")
        assert out.columns == table.columns and out.count() == 4
