"""Shapes of records that an entity-resolution engine takes and gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.functions.vectors import SCORE_BUCKETS, score_bucket

# The fields of each record type.
FIELDS = {"PERSON": ("NAME_FULL", "NAME_EMBEDDING", "NAME_LABEL"), "ORGANIZATION": ("NAME_ORG", "BIZNAME_EMBEDDING", "BIZNAME_LABEL")}


def vector_text(v: Column) -> Column:
    """A vector as the text of a list."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ", "), F.lit("]"))


def with_embeddings(records: DataFrame, record_type: str) -> DataFrame:
    """Records of (DATA_SOURCE, RECORD_ID, RECORD_TYPE, NAMES, embeddings) as JSON: those of the type with
    names get a list of labelled vectors, all others pass as they are."""
    name, embedding, label = FIELDS[record_type]
    pairs = F.arrays_zip(F.transform("NAMES", lambda n: n[name]), F.col("embeddings"))
    shaped = F.transform(pairs, lambda p: F.struct(vector_text(p["embeddings"]).alias(embedding), p["0"].alias(label)))
    mine = (F.col("RECORD_TYPE") == record_type) & (F.size("NAMES") > 0)
    base = ["DATA_SOURCE", "RECORD_ID", "RECORD_TYPE", "NAMES"]
    json = F.when(mine, F.to_json(F.struct(*base, shaped.alias(f"{embedding}S")))).otherwise(F.to_json(F.struct(*base)))
    return records.select("DATA_SOURCE", "RECORD_ID", json.alias("json"))


def shape_names(names: DataFrame, source: str, record_type: str = "PERSON") -> DataFrame:
    """(RECORD_ID, json): names(id, name) gathered into one record per id."""
    field = FIELDS[record_type][0]
    listed = F.transform(F.sort_array(F.collect_list("name")), lambda n: F.struct(F.lit("PRIMARY").alias("NAME_TYPE"), n.alias(field)))
    rows = names.groupBy(F.col("id").alias("RECORD_ID")).agg(listed.alias("NAMES"))
    whole = F.struct(F.lit(source).alias("DATA_SOURCE"), F.col("RECORD_ID").cast("string").alias("RECORD_ID"), F.lit(record_type).alias("RECORD_TYPE"), "NAMES")
    return rows.select("RECORD_ID", F.to_json(whole).alias("json"))


_SCORES = "array<struct<SCORE:int>>"
SEARCH_RESULT = (
    f"RESOLVED_ENTITIES array<struct<MATCH_INFO:struct<FEATURE_SCORES:struct<NAME:{_SCORES},BIZNAME_EMBEDDING:{_SCORES}>>,"
    "ENTITY:struct<RESOLVED_ENTITY:struct<ENTITY_ID:bigint,ENTITY_NAME:string>>>>"
)


def search_results(responses: DataFrame, embedding: str = "BIZNAME_EMBEDDING") -> DataFrame:
    """(entity_id, entity_name, name_score, embedding_score) of each entity in JSON responses(json); a
    missing score is 0."""
    schema = SEARCH_RESULT.replace("BIZNAME_EMBEDDING", embedding)
    found = responses.select(F.explode(F.from_json("json", schema)["RESOLVED_ENTITIES"]).alias("e"))
    score = lambda kind: F.coalesce(F.get(F.col(f"e.MATCH_INFO.FEATURE_SCORES.{kind}"), F.lit(0))["SCORE"], F.lit(0))
    entity = "e.ENTITY.RESOLVED_ENTITY"
    return found.select(F.col(f"{entity}.ENTITY_ID").alias("entity_id"), F.col(f"{entity}.ENTITY_NAME").alias("entity_name"), score("NAME").alias("name_score"), score(embedding).alias("embedding_score"))


def search(vectors: DataFrame, query: list[float], tau: float, k: int = 10, kind: str = "personal") -> DataFrame:
    """The nearest rows of a vector table at a similarity of tau or more, with the bucket of their score."""
    from onomast.operators.knn import nearest

    if kind not in SCORE_BUCKETS:
        raise ValueError(f"no score buckets for {kind}")
    found = nearest(vectors, query, k, tau)
    return found.withColumn("bucket", score_bucket(F.round(F.col("score") * 100), kind))
