import json

from pyspark.sql import functions as F

from onomast.operators import extract
from onomast.schemas import ENTITY
from onomast.sources import readers, writers
from onomast.streaming import ingest


def entity(id_="Q1", classes=("Q5",), labels=None, aliases=None, title=None, nick=None):
    claims = {"P31": [{"mainsnak": {"datavalue": {"value": {"id": c}}}} for c in classes]}
    if nick:
        claims["P1449"] = [{"mainsnak": {"datavalue": {"value": {"text": t, "language": x}}}} for t, x in nick]
    out = {"id": id_, "type": "item", "labels": {k: {"language": k, "value": v} for k, v in (labels or {}).items()}, "claims": claims}
    out["aliases"] = {k: [{"language": k, "value": x} for x in v] for k, v in (aliases or {}).items()}
    if title:
        out["sitelinks"] = {"enwiki": {"title": title}}
    return json.dumps(out, ensure_ascii=False)


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string").select(readers.clean_line(F.col("value")).alias("value")).where("value is not null")


def canonical(spark, line):
    got = extract.entities(lines(spark, [line])).select("canonical").collect()
    return got[0][0] if got else None


def test_canonical_names(spark):
    assert canonical(spark, entity(labels={"en": "John Smith"})) == "john smith"
    assert canonical(spark, entity(labels={"en": "  ", "en-gb": "Gb Name"})) == "gb name"
    assert canonical(spark, entity(labels={"en-ca": "Ca Name"})) == "ca name"
    assert canonical(spark, entity(labels={"fr": "x"}, title="A Title")) == "a title"
    assert canonical(spark, entity(labels={"fr": "x"}, aliases={"en": ["Alias One", "b"]})) == "alias one"
    assert canonical(spark, entity(labels={"en": "José"}, aliases={"en": ["Josë", "Joe"]})) == "joe"
    assert canonical(spark, entity(labels={"en": "José"})) == "jose"
    assert canonical(spark, entity(labels={"en": "名前"})) is None
    assert canonical(spark, entity(labels={"en": "名 前"})) == " "  # a blank canonical name is kept
    assert canonical(spark, entity(labels={"fr": "x"})) is None


def test_class_filter(spark):
    rows = [entity("A"), entity("B", ("Q5", "Q43229")), entity("C", ("Q5", "Q99")), entity("D", ()), entity("E", ("Q7",))]
    rows = [r.replace('"labels": {}', '"labels": {"en": {"language": "en", "value": "N"}}') for r in rows]
    kept = extract.entities(lines(spark, rows))
    assert sorted(r["id"] for r in kept.collect()) == ["A", "C"]
    assert [tuple(r) for r in extract.blacklist_candidates(kept).collect()] == [("C", "n", ["Q5", "Q99"])]
    assert len(extract.BLACKLIST) == 71


def test_names_last_language_wins(spark):
    line = entity(labels={"en": "Bob", "fr": "Robert"}, aliases={"de": ["Bob", "Bobby"]}, nick=[("Robert", "it"), (None, None)])
    got = extract.names_of_entities(extract.entities(lines(spark, ["[", line + ",", "]", "", "{broken json!!"])))
    assert [(r["name"], r["language"]) for r in got.collect()] == [("Bob", "de"), ("Robert", "it"), ("Bobby", "de"), (None, None)]


def test_labels_as_a_list_count_as_none(spark):
    line = entity(title="T").replace('"labels": {}', '"labels": []')
    assert canonical(spark, line) == "t"


def test_rejects_are_counted(spark):
    got = readers.rejects(lines(spark, [entity(), "{broken json!!"]), ENTITY).first()
    assert tuple(got) == (2, 1)


def record(**k):
    return json.dumps({"DATA_SOURCE": "T", "RECORD_ID": "R-1", "RECORD_TYPE": "PERSON", "NAMES": []} | k)


def test_records(spark):
    rows = [
        record(NAMES=[{"NAME_FULL": "A"}, {"NAME_FULL": "B"}, {"NAME_FULL": "A"}, {"NAME_FULL": ""}]),
        record(RECORD_ID="R-2", NAMES=[{"NAME_FULL": "C"}, {"NAME_ORG": "lacks the field"}]),
        record(RECORD_ID="R-3"),
        record(RECORD_ID="O", RECORD_TYPE="ORGANIZATION", NAMES=[{"NAME_ORG": "Acme"}]),
    ]
    got = extract.names_of_records(lines(spark, rows), "PERSON").collect()
    assert [tuple(r) for r in got] == [("R-1", "r-1", "unknown", "A"), ("R-1", "r-1", "unknown", "B")]
    assert extract.names_of_records(lines(spark, rows), "ORGANIZATION").first()["name"] == "Acme"


def test_name_table_round_trip(spark, tmp_path):
    rows = [("1", "c", "en", 'quo"te, and\nnewline'), ("1", "c", "nan", "NA"), ("2", None, "fr", "Null"), ("2", "d", "fr", "Nan")]
    writers.write_names(spark.createDataFrame(rows, "id string, canonical string, language string, name string"), str(tmp_path / "n"))
    got = readers.read_names(spark, str(tmp_path / "n")).collect()
    assert sorted(r["name"] for r in got) == ["Nan", "Null", 'quo"te, and\nnewline'] and {r["canonical"] for r in got} == {"c", "d", None}
    assert readers.read_names(spark, str(tmp_path / "n"), na_tokens=("",), drop_missing=False).count() == 4


def test_clusters_fall_back(spark):
    df = spark.createDataFrame([("1", " ", "a", "en"), ("", "c", "b", ""), ("2", "c", None, "en")], "id string, canonical string, name string, language string")
    assert [tuple(r) for r in readers.read_clusters(df).collect()] == [("1", "a", "en"), ("c", "b", None)]


def test_lines_in_all_compressions(spark, tmp_path):
    import bz2
    import gzip

    body = (entity(labels={"en": "Ann"}) + ",\n").encode()
    (tmp_path / "a.json").write_bytes(body)
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(body))
    (tmp_path / "a.json.bz2").write_bytes(bz2.compress(body))
    for f in tmp_path.iterdir():
        assert extract.entities(readers.read_lines(spark, str(f))).first()["canonical"] == "ann"
    assert readers.read_lines(spark, str(tmp_path / "a.json"), partitions=3, limit=1).count() == 1
    assert readers.lines_of(spark, [body.decode()], str(tmp_path / "stdin")).count() == 1


def test_triplets_keep_nulls_and_characters(spark, tmp_path):
    df = spark.createDataFrame([("é", None, "n", "g")], "anchor string, positive string, negative string, anchor_group string")
    writers.write_triplets(df, str(tmp_path / "t"))
    assert '"anchor":"é","positive":null' in "".join(p.read_text() for p in (tmp_path / "t").glob("*.json"))
    assert readers.read_triplets(spark, str(tmp_path / "t")).collect() == df.collect()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(entity(labels={"en": "Ann", "fr": "Anne"}) + "\n")
    def names(x):
        return extract.names_of_entities(extract.entities(x))

    for _ in range(2):  # a second run finds nothing new
        ingest.run_stream(ingest.stream_lines(spark, str(tmp_path / "in")), names, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["Ann", "Anne"]
