"""Names out of knowledge-base entities and records: one narrow stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.functions.scripts import word_is_in
from onomast.functions.text import ascii_fold, strip
from onomast.schemas import ENTITY, RECORD
from onomast.sources.readers import parse

# Classes of which a person must not be an instance, and the one they must be of.
BLACKLIST = (
    "Q171 Q7397 Q40614 Q41298 Q41710 Q43229 Q43616 Q163740 Q215380 Q474968 Q1052390 Q1412596 Q1747829 Q2707384 Q4233718 Q10648343 "
    "Q10855061 Q12737077 Q13442814 Q13473501 Q15097084 Q18347143 Q18356450 Q105525662 Q106892475 Q119579738 Q17558136 Q16334295 "
    "Q1241025 Q673899 Q4830453 Q14946528 Q2088357 Q281643 Q55753593 Q1165905 Q783794 Q2927074 Q9621 Q199414 Q216353 Q7558495 Q7881 "
    "Q839954 Q220659 Q26513 Q1656682 Q8436 Q16519632 Q4164871 Q968159 Q486972 Q10737 Q1318274 Q11664239 Q1077857 Q132821 Q844482 "
    "Q814254 Q35779580 Q1190554 Q72398691 Q3235597 Q47461344 Q1792356 Q12888920 Q532 Q109115381 Q35127 Q24238356 Q9212979"
).split()
WHITELIST = ["Q5"]


def _filled(c: Column) -> Column:
    return F.when(F.length(strip(c)) > 0, c)


def ascii_name() -> Column:
    """The canonical name of an entity: its English label or what stands in for it, by an ASCII alias
    if it isn't ASCII itself, else folded; null without any."""
    label = lambda lang: F.try_element_at("labels", F.lit(lang))["value"]
    aliases = F.try_element_at("aliases", F.lit("en"))
    name = F.coalesce(_filled(label("en")), _filled(label("en-gb")), _filled(label("en-ca")), _filled(F.col("sitelinks.enwiki.title")), _filled(F.get(aliases, F.lit(0))["value"]))
    plain = F.get(F.filter(F.coalesce(aliases, F.array().cast("array<struct<language:string,value:string>>")), lambda a: (F.length(a["value"]) > 0) & word_is_in(a["value"], "ascii")), F.lit(0))["value"]
    folded = F.when(~word_is_in(name, "ascii") & plain.isNotNull(), F.lower(plain)).otherwise(ascii_fold(name))
    return F.when(folded != "", folded)


def class_ids() -> Column:
    ids = F.transform("claims.P31", lambda c: c["mainsnak"]["datavalue"]["value"]["id"])
    return F.filter(ids, lambda i: i.isNotNull())


def accepted(ids: Column, blacklist: list[str] = BLACKLIST, whitelist: list[str] = WHITELIST) -> Column:
    has = lambda wanted: F.arrays_overlap(ids, F.array(*map(F.lit, wanted)))
    return (F.size(ids) > 0) & ~has(blacklist) & has(whitelist)


def last_wins(names: Column) -> Column:
    """Distinct names of (name, language) structs in order of first sight, each with its last language.
    The null name counts as a name."""
    key = lambda s: F.coalesce(F.concat(F.lit("="), s["name"]), F.lit("-"))
    firsts = F.array_distinct(F.transform(names, key))
    return F.transform(firsts, lambda k: F.element_at(F.filter(names, lambda s: key(s) == k), -1))


def entities(lines: DataFrame, needle: str | None = '"Q5"') -> DataFrame:
    """Parsed entities that are kept, with `canonical` and `classes`. The needle spares lines that
    can't be kept their parse."""
    if needle:
        lines = lines.where(F.contains("value", F.lit(needle)))
    parsed = parse(lines, ENTITY).withColumn("classes", class_ids()).where(accepted(F.col("classes")))
    return parsed.withColumn("canonical", ascii_name()).where(F.col("canonical").isNotNull())


def names_of_entities(kept: DataFrame) -> DataFrame:
    """(id, canonical, language, name): labels, then aliases, then nicknames, last language wins."""
    pair = lambda name, lang: F.struct(name.alias("name"), lang.alias("language"))
    none = F.array().cast("array<struct<name:string,language:string>>")
    labels = F.transform(F.map_entries("labels"), lambda e: pair(e["value"]["value"], e["key"]))
    aliases = F.flatten(F.transform(F.map_entries("aliases"), lambda e: F.transform(e["value"], lambda a: pair(a["value"], e["key"]))))
    nick = lambda c: c["mainsnak"]["datavalue"]["value"]
    nicknames = F.transform("claims.P1449", lambda c: pair(nick(c)["text"], nick(c)["language"]))
    every = F.concat(*(F.coalesce(x, none) for x in (labels, aliases, nicknames)))
    return kept.select("id", "canonical", F.inline(last_wins(every))).select("id", "canonical", "language", "name")


def blacklist_candidates(kept: DataFrame) -> DataFrame:
    """Kept entities that are instances of more than one class."""
    return kept.where(F.size("classes") > 1).select("id", F.col("canonical").alias("name"), F.col("classes").alias("ids"))


def name_field(record_type: str) -> str:
    return {"PERSON": "NAME_FULL", "ORGANIZATION": "NAME_ORG"}[record_type]


def names_of_records(lines: DataFrame, record_type: str = "PERSON") -> DataFrame:
    """(id, canonical, language, name) of records of one type. A record with a name that lacks the
    field altogether goes; empty names are skipped."""
    field = name_field(record_type)
    rows = parse(lines, RECORD).where((F.col("RECORD_TYPE") == record_type) & (F.size("NAMES") > 0) & F.forall("NAMES", lambda n: n[field].isNotNull()))
    filled = F.array_distinct(F.filter(F.transform("NAMES", lambda n: n[field]), lambda n: n != ""))
    return rows.select(F.col("RECORD_ID").alias("id"), F.lower("RECORD_ID").alias("canonical"), F.lit("unknown").alias("language"), F.explode(filled).alias("name"))
