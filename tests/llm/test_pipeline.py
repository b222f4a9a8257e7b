import random

import numpy as np

import corpus_pipeline
from quiverql.llm import catalog, op10_decontam
from quiverql.llm.op2_bpe import codec

from .conftest import ODD_ROWS
from .test_op10_decontam import fitted, many_rows


def test_stages_on_planted_cases(spark, tmp_path, docs_of):
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(["ta", "lo", "mi", "er", "un"]) + rng.choice("abcdefghij") + rng.choice(["", "x", "yy"]) for _ in range(n))
    item = say(40)
    rows = [(i, say(60) + "\nshared licence line here\n" + say(30)) for i in range(400)]
    rows += [(1000 + i, say(30) + rng.choice([" idiot ", " moron "]) + say(30)) for i in range(60)]
    rows += [(2000 + i, say(20) + " " + item + " " + say(20)) for i in range(5)]
    rows += [(3000 + i, rows[7][1].upper()) for i in range(5)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(1000 <= i < 2000)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns
        left.append({r.doc_id: r.text for r in docs.collect()})
    ids = {i for i, _ in rows}
    assert set(left[0]) == {i for i in ids if not 1000 <= i < 2000}
    assert set(left[1]) == set(left[0]) and not any("licence" in t for t in left[1].values())
    assert set(left[2]) == {i for i in left[0] if i < 3000}
    assert set(left[3]) == set(range(400))
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    bpe = codec(catalog.public_tokenizers.path(catalog.BYTE_BPE))
    assert got == {i: len(bpe.encode_batch([t])[0]) for i, t in left[3].items()}


def test_decontamination_is_fitted_on_all_rows_of_the_stage(spark, tmp_path, docs_of, monkeypatch):
    rows, bench = many_rows()
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made, plain = [], op10_decontam.detectors
    monkeypatch.setattr(op10_decontam, "detectors", lambda *frames: made.append(plain(*frames)) or made[-1])
    kept = corpus_pipeline.decontamination(spark, docs_of(rows), str(tmp_path)).collect()
    want = fitted(rows, bench)
    ((got,),) = made
    assert np.allclose(got.weight, want.weight) and np.allclose(got.basis, want.basis, atol=1e-6)
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted((str(i), t or "") for i, t in rows if not (i or 0) >= 4_000)


def test_odd_rows(spark, tmp_path, docs_of):
    for rows in (ODD_ROWS, []):
        d = f"{tmp_path}/{len(rows)}"
        docs_of(rows).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = [r.doc_id for r in corpus_pipeline.run(spark, d).collect()]
        assert len(got) == len(set(got)) and (len(got) > 5 if rows else not got)
