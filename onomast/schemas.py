"""Explicit schemas of every table that the library reads or writes."""

from pyspark.sql.types import ArrayType, DoubleType, LongType, MapType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_S = StringType()
_VALUE = _struct(language=_S, value=_S)
_ID_CLAIM = _struct(mainsnak=_struct(datavalue=_struct(value=_struct(id=_S))))
_TEXT_CLAIM = _struct(mainsnak=_struct(datavalue=_struct(value=_struct(text=_S, language=_S))))

#: A knowledge-base entity, one JSON object a line.
ENTITY = _struct(
    id=_S,
    type=_S,
    labels=MapType(_S, _VALUE),
    aliases=MapType(_S, ArrayType(_VALUE)),
    sitelinks=_struct(enwiki=_struct(title=_S)),
    claims=_struct(P31=ArrayType(_ID_CLAIM), P1449=ArrayType(_TEXT_CLAIM)),
)
#: A watch-list or entity-resolution record.
RECORD = _struct(DATA_SOURCE=_S, RECORD_ID=_S, RECORD_TYPE=_S, NAMES=ArrayType(_struct(NAME_TYPE=_S, NAME_FULL=_S, NAME_ORG=_S)))
NAME_TABLE = _struct(id=_S, canonical=_S, language=_S, name=_S)
TRIPLET = _struct(anchor=_S, positive=_S, negative=_S, anchor_group=_S)
RICH_TRIPLET = _struct(
    cluster_id=_S, anchor=_S, anchor_lang=_S, pos=_S, pos_lang=_S, neg=_S, neg_lang=_S, neg_strategy=_S, ops_anchor=ArrayType(_S), ops_pos=ArrayType(_S)
)
AUGMENTED = _struct(id=_S, name=_S, language=_S, augmented=_S, ops=ArrayType(_S))
VECTOR_TABLE = _struct(id=LongType(), group_id=_S, canonical=_S, name=_S, language=_S, embedding=ArrayType(DoubleType()))
LABELLED_PAIR = _struct(a=_S, b=_S, y=LongType())
SCORED_PAIR = _struct(y=LongType(), score=DoubleType())
