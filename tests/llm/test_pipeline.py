import random

import corpus_pipeline
from flowlake.llm import secret_scan


def test_pipeline(spark, tmp_path):
    sf = str(tmp_path)
    rnd = random.Random(3)
    made = {}
    good = lambda k: made.setdefault(k, "\n".join(" ".join(f"word{rnd.randint(0, 9999)}" for _ in range(9)) + "." for _ in range(12)))
    item = " ".join(f"b{i}" for i in range(30))
    rows = [(1, good(1), "en", "s"), (2, good(1), "en", "s"), (3, good(2) + "\npassword=hunter22x is out.", "en", "s"), (4, "A | B | C | D\n" * 9, "en", "s"), (5, good(3) + "\n" + item + ".", "en", "s"), (6, None, None, None), (None, good(5), "en", "s"), (8, good(4), "en", None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item + ".")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id for r in docs.collect()})
    assert kept == [{1, 2, 3, 5, None, 8}, {1, 3, 5, None, 8}, {1, 3, None, 8}, {1, 3, None, 8}]
    texts = {r.doc_id: r for r in docs.collect()}
    assert "hunter22x" not in texts[3].text and "[assign]" in texts[3].text and texts[3].n_chars == len(texts[3].text) and texts[1].text == good(1)
    assert not secret_scan.spans_of(texts[3].text, secret_scan._automaton())
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} <= {1, 3, None, 8} and [r.position for r in out] == sorted(r.position for r in out)


def test_near_dup_stage_repeated_and_null_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(3, text(1)), (5, text(2)), (5, text(1)), (5, text(2)), (None, text(3)), (None, text(3)), (None, text(3) + " end"), (None, text(1)), (None, text(4))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dup_stage(spark, docs, "").collect()
    assert len(got) == 4 and {(r.doc_id, r.text.split()[0]) for r in got} == {(3, "w1x0"), (5, "w2x0"), (None, "w3x0"), (None, "w4x0")}


def test_pipeline_empty_and_extra_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __key long, size string, kept boolean, w string"
    bench = spark.createDataFrame([(1, "some item of the benchmark that is here")], "item_id long, text string")
    text = "\n".join(" ".join(f"word{i}x{k}" for k in range(9)) + "." for i in range(9))
    for name, rows in (("none", []), ("some", [(1, text, "en", None, 3, 5, "s", True, "w"), (None, text + " More.", "en", "s", 3, 6, "t", False, "v"), (3, None, None, None, None, None, None, None, None)])):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
        bench.write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.run(spark, sf)
        got = out.collect()
        assert {r.doc_id for r in got} == ({1} if rows else set()) and {"__key", "kept", "w", "size"} <= set(out.columns)
        assert all(r.w == "w" and r["__key"] == 5 for r in got)


def test_intermediate_tables_are_deleted(spark, tmp_path):
    import os

    from flowlake.llm import common

    with common.scratch(spark):
        path = common.stored(spark.range(3)).inputFiles()[0].removeprefix("file:").lstrip("/")
        assert os.path.exists("/" + path)
    assert not os.path.exists("/" + path)
