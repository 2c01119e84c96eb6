"""The corpus pipeline against a plain run of its stages on small rows."""


import pytest

import corpus_pipeline
from cartolith.llm import packing
from tests.llm.test_operators import plain_components, plain_fingerprint, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, prose(i, 80), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(40 + i, prose(i, 80).upper().capitalize(), "en", "c", 0) for i in range(5)]
    rows += [(50, "1234 !!", "en", "c", 0), (51, None, None, None, None), (52, prose(90, 60) + " " + prose(1000, 30) + " " + prose(91, 60), "en", "s", 0)]
    rows += [(53, prose(92, 60) + ' password="abcdefgh1234" ' + prose(93, 60), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, prose(1000 + k, 30)) for k in range(4)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(after["language_id"]) == {*range(45), 52, 53}
    groups = plain_components([(d, plain_fingerprint(t)) for d, t in after["language_id"].items()])
    assert set(after["near_dedup"]) == {c for _, _, c in groups}
    assert set(after["near_dedup"]) - set(after["decontamination"]) == {52}
    assert "abcdefgh1234" not in after["secrets"][53] and after["secrets"][0] == prose(0, 80)
    rows = corpus_pipeline.run(spark, folder).collect()
    tokenizer = packing.Encoder(packing.default_tokenizer()).tokenizer
    sizes = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in after["secrets"].items()}
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == sizes
    assert sum(r["length"] for r in rows) == sum(sizes.values())


def test_stages_on_awkward_tables(spark, folder):
    names = "doc_id long, text string, lang string, source string, n_chars long, own_node long, keep boolean, place int, words string, `a.b` int, `node` string"
    more = (1, True, 2, "w", 3, "n")
    twin = prose(5, 90)
    rows = [(1, twin, "en", "s", 9, *more), (1, twin, "en", "s", 9, *more), (1, prose(6, 90), "en", "s", 9, *more), (None, twin, "en", "s", 9, *more), (None, prose(7, 90), None, None, None, *more)]
    rows += [(2, None, "en", "s", 0, *more), (3, "", "en", "s", 0, *more), (4, prose(8, 60_000), "en", "s", 9, *more), (5, twin + " tail", "en", "s", 9, *more)]
    rows += [(10 + k, prose(60 + k, 80), "en", "s", 9, *more) for k in range(30)]
    docs = spark.createDataFrame(rows, names).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), folder).count() == 0
    packed = corpus_pipeline.STAGES[-1][1]
    assert packed(spark, docs, folder).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed(spark, docs.where("false"), folder).count() == 0
    texts = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["text"] or "")) for r in df.collect())
    identified = corpus_pipeline.identify_language(spark, docs, folder)
    assert texts(identified) == sorted((r[0] is None, r[0] or 0, len(r[1])) for r in rows if r[1])
    kept = corpus_pipeline.near_dedup(spark, docs, folder)
    want = [(1, twin), (1, rows[2][1]), (None, rows[4][1]), (2, None), (4, rows[7][1])] + [(r[0], r[1]) for r in rows[9:]]
    assert texts(kept) == sorted((d is None, d or 0, len(t or "")) for d, t in want)
    assert corpus_pipeline.decontaminate_benchmark(spark, docs, folder).count() == len(rows)
    assert corpus_pipeline.mask_secrets(spark, docs, folder).count() == len(rows)


def test_scratch_tables_go(spark):
    import os

    from cartolith.llm.common import scratch, shared_dir, stored, stored_from

    there = lambda: {x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if x.startswith(("inner", "outer"))}
    with scratch(spark):
        stored(spark.range(3), "inner")
        assert len(there()) == 1
    assert not there()
    kept = stored_from(spark, lambda: stored(spark.range(5), "inner").where("id > 1"), "outer")
    assert kept.count() == 3 and len(there()) == 1
