"""The pipeline stage by stage on its own input, and as a whole."""

import corpus_pipeline
from graphloom.llm import bpe, decontaminate, near_dedup


def test_stages_keep_columns_and_do_their_work(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        sizes.append(after.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        before_rows = {r.doc_id: r.text for r in docs.collect()}
        if name == "exact_dedup":
            assert sorted(r.doc_id for r in after.collect()) == sorted({t: i for i, t in sorted(before_rows.items())}.values())
        if name == "minhash_near_dedup":
            want = near_dedup.reference_components(list(before_rows.items()), 5, 80)
            assert sorted(r.doc_id for r in after.collect()) == sorted(want[want["kept"]]["doc_id"])
        if name == "benchmark_decontamination":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            bad = {r.doc_id for r in decontaminate.contamination(docs, bench).where("contaminated").collect()}
            assert {r.doc_id for r in after.collect()} == set(before_rows) - bad
        if name == "byte_bpe":
            own = bpe.codec(*bpe.public_files())
            for r in after.collect():
                assert own.decode(r.ids) == before_rows[r.doc_id].encode()
        docs = after
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == sizes[-1]


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in any column, empty texts, repeated rows and ids, negative ids, columns with the operators' own names, and an empty table, through every stage."""
    long = " ".join(f"word{k}" for k in range(400))
    rows = [(1, long), (1, long), (-2, long + " end"), (None, long), (3, None), (4, ""), (4, ""), (5, " \n\t"), (None, None), (6, "x"), (7, "é" * 20_000)]
    schema = "doc_id bigint, text string, lang string, id int, t string, payload int, digest int, found int, n int, nth int, component_id int, kept boolean"
    docs = spark.createDataFrame([(i, t, *[None] * 10) for i, t in rows], schema)
    want = {
        "toxicity": sorted(rows, key=str),
        "exact_dedup": sorted([(1, long), (-2, long + " end"), (4, ""), (5, " \n\t"), (6, "x"), (7, "é" * 20_000)], key=str),
        "minhash_near_dedup": sorted([r for r in rows if r != (1, long)], key=str),
        "benchmark_decontamination": sorted(rows, key=str),
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        if name in want:
            assert got.columns == docs.columns
            assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want[name], name
        else:
            assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in got.collect()) == sorted((i or 0, bool(t)) for i, t in rows)
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
