import pytest

import corpus_pipeline as cp


def test_stages_on_planted_rows(llm_spark, make_docs, prose, tmp_path):
    item = prose(500, 40)
    rows = [(i, "\n".join(prose(1000 * i + k, 25) for k in range(5))) for i in range(60)]
    block = "\n".join(prose(7000 + k, 12) for k in range(4))
    words = rows[3][1].split(" ")
    rows += [(100, rows[0][1] + "\n" + block), (101, rows[1][1] + "\n" + block), (102, " ".join([*words[:50], "changed", *words[51:]])), (103, prose(8000, 50) + " " + item), (104, "12 ! 34"), (105, None)]
    llm_spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make_docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(llm_spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = llm_spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id for r in docs.collect()}
    everyone = {r[0] for r in rows}
    assert seen["language_id"] == everyone - {104, 105}
    # 100 and 101 lose the lines of 0 and 1, and 101 those of 100: nothing is left of it.
    assert seen["line_dedup"] == everyone - {101, 104, 105}
    assert seen["near_dedup"] == seen["line_dedup"] - {102}
    assert seen["decontamination"] == seen["near_dedup"] - {103} == seen["sentencepiece"]
    assert cp.ORACLE_SQL is None and len(cp.STAGES) == 5


def test_odd_tables_and_resuming(llm_spark, make_docs, prose, tmp_path, monkeypatch):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    llm_spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    make_docs([]).select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(llm_spark, str(tmp_path)).count() == 0
    # Repeated rows are one document after near dedup; clashing extra columns travel along until the last stage.
    text = "\n".join(prose(40 + k, 30) for k in range(3))
    docs = make_docs([(1, text), (1, text), (None, text), (2, prose(90, 60)), (3, "word " * 30_000)])
    for _, stage in cp.STAGES[:-1]:
        docs = stage(llm_spark, docs, str(tmp_path))
        assert docs.columns == make_docs([]).columns
    assert docs.filter("doc_id = 1 or doc_id is null").count() == 1 and docs.filter("doc_id = 2").first().key == "clash"
    # A run that broke off is taken up behind its last whole stage.
    make_docs([(k, prose(100 + k, 40)) for k in range(20)]).select(*columns).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    seen, broken = [], [True]

    def watched(name, stage):
        def call(*args):
            seen.append(name)
            if name == "near_dedup" and broken[0]:
                raise RuntimeError("lost")
            return stage(*args)

        return call

    monkeypatch.setattr(cp, "STAGES", [(n, watched(n, s)) for n, s in cp.STAGES])
    with pytest.raises(RuntimeError):
        cp.run(llm_spark, str(tmp_path), f"{tmp_path}/run")
    broken[0] = False
    assert cp.run(llm_spark, str(tmp_path), f"{tmp_path}/run").count() == 20
    assert seen == ["language_id", "line_dedup", "near_dedup", "near_dedup", "decontamination", "sentencepiece"]
