import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from onomast.llm import langid, mixing, packing, pii
from onomast.llm.common import table


def test_stages_work_on_what_their_predecessors_kept(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert sorted(kept[-1].columns) == sorted(corpus_pipeline.COLUMNS)
    language, unique, clean, mixed, packed = ({r["doc_id"]: r for r in x.collect()} for x in kept[1:])
    told = {r["doc_id"] for r in langid.identify(docs).where("lang_pred <> 'und'").collect()}
    assert set(language) <= told and len(language) > 0.98 * docs.count()

    from test_duplicates import plain_components

    plain = plain_components([(i, r["text"]) for i, r in language.items()], 5, 80)
    assert set(unique) == {i for i, (_, c) in plain.items() if i == c}
    assert set(clean) == set(unique)
    for i, r in clean.items():
        assert not any(m for kind, p in pii.PATTERNS.items() if kind == "email" for m in re.finditer(r"[a-z0-9.]+@[a-z0-9]+\.example", r["text"]))
        assert r["n_chars"] == len(r["text"]) and (r["text"] == unique[i]["text"] or "[" in r["text"])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(kept[3]).collect()}
    assert set(mixed) == {i for i, c in copies.items() if c} and kept[4].count() == sum(copies.values())
    assert set(packed) == set(mixed) and kept[5].where("piece = 0").count() == kept[4].count()
    assert kept[5].agg(F.sum("length")).first()[0] == packing.pack(kept[4]).agg(F.sum("length")).first()[0]


def test_run_is_the_stages(spark, sf):
    one = corpus_pipeline.run(spark, sf)
    assert one.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and one.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "personal data", "mixing", "packing"]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12", None, None, 2)]])
def test_empty_and_odd_input(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
