"""Queries of the library by name, and the SQL that gives the same rows.

Every query runs over whole tables. Where no SQL is given the operator isn't expressible in it, or
SQL is too slow on whole tables; tests compare those with plain versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.functions import sampling, scripts, text, translit, vectors
from onomast.operators import augment, extract, groups, knn, metrics, mining, records, splits, triplets
from onomast.schemas import RECORD
from onomast.sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def h(seed: int, *keys: str) -> str:
    """sampling.draw in SQL."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 8))::BIGINT"


# --- Group sizes: orders by customer ---------------------------------------------------------------

EDGES = [5, 10, 15, 20]
SIZES = "sizes AS (SELECT o_custkey AS grp, count(*) AS size FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1)"
FREQ = "freq AS (SELECT size, count(*) AS num_groups_at_size, size * count(*) AS num_names_at_size FROM sizes WHERE size >= {least} GROUP BY 1)"
CUM = """cum AS (SELECT *, CAST(sum(num_groups_at_size) OVER d AS BIGINT) AS cum_groups_ge, 100.0 * sum(num_groups_at_size) OVER d / sum(num_groups_at_size) OVER () AS cum_groups_ge_pct,
CAST(sum(num_names_at_size) OVER d AS BIGINT) AS cum_names_ge, 100.0 * sum(num_names_at_size) OVER d / sum(num_names_at_size) OVER () AS cum_names_ge_pct
FROM freq WINDOW d AS (ORDER BY size DESC))"""
PERCENT = ["cum_groups_ge_pct", "cum_names_ge_pct"]
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in PERCENT)


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return groups.sizes(table(spark, d, "orders"), "o_custkey")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {SIZES}, {FREQ.format(least=1)}, {CUM} SELECT size, num_groups_at_size, num_names_at_size, cum_groups_ge, cum_names_ge, {ROUNDED} FROM cum")
def group_size_profile(spark, d):
    return _rounded(groups.cumulative(groups.frequencies(_sizes(spark, d))), *PERCENT)


CANDIDATES = [5, 10, 20, 30, 40, 50, 75, 100, 150, 200]


@query(
    f"WITH {SIZES}, {FREQ.format(least=2)}, {CUM}, cand AS (SELECT CAST(unnest({CANDIDATES}) AS BIGINT) AS size) "
    f"SELECT cand.size, cum_groups_ge, cum_names_ge, {ROUNDED} FROM cand LEFT JOIN cum USING (size)"
)
def cutoff_explorer(spark, d):
    return _rounded(groups.cutoff_explorer(_sizes(spark, d), CANDIDATES), *PERCENT)


@query(f"WITH {SIZES}, {FREQ.format(least=2)}, {CUM} SELECT min(size) AS cutoff FROM cum WHERE cum_groups_ge <= 500")
def suggest_cutoff(spark, d):
    return groups.suggest_cutoff(_sizes(spark, d), 500)


@query(f"WITH {SIZES}, {FREQ.format(least=4)}, {CUM} SELECT coalesce(min(size), 4) AS cutoff FROM cum WHERE cum_groups_ge >= 132")
def choose_cutoff(spark, d):
    return groups.choose_cutoff(_sizes(spark, d), 100, 10, 10)


@query(f"WITH {SIZES} SELECT count(*) FILTER (size >= 20) AS large, count(*) FILTER (size >= 1 AND size < 20) AS small, count(*) AS total FROM sizes")
def large_small_counts(spark, d):
    return groups.large_small(_sizes(spark, d))


@query(f"WITH {SIZES} SELECT CAST(coalesce(sum(size * (size - 1)), 0) * 2 AS BIGINT) AS triplets FROM sizes")
def triplet_capacity(spark, d):
    return groups.triplet_capacity(_sizes(spark, d), 2)


@query(
    f"""WITH {SIZES}, b AS (SELECT CASE WHEN size > 20 THEN 4 ELSE (size - 1) // 5 END AS bin, count(*) AS groups FROM sizes WHERE size >= 2 GROUP BY 1)
SELECT r.bin, r.bin * 5 + 1 AS low, coalesce(groups, 0) AS groups FROM (SELECT unnest(range(5)) AS bin) r LEFT JOIN b USING (bin)"""
)
def size_histogram(spark, d):
    return groups.histogram(_sizes(spark, d), width=5, cap=20)


@query(
    """WITH s AS (SELECT source AS grp, count(*) AS size FROM documents WHERE source IS NOT NULL GROUP BY 1), b AS (SELECT CASE WHEN size > 200 THEN 19 ELSE (size - 1) // 10 END AS bin, count(*) AS groups FROM s WHERE size >= 2 GROUP BY 1)
SELECT r.bin, r.bin * 10 + 1 AS low, coalesce(groups, 0) AS groups FROM (SELECT unnest(range(20)) AS bin) r LEFT JOIN b USING (bin)"""
)
def source_histogram(spark, d):
    return groups.histogram(groups.sizes(table(spark, d, "documents"), "source"), last_is_open=False)


@query("SELECT conv_id AS grp, list(text ORDER BY text) AS names FROM conversations GROUP BY 1")
def group_members(spark, d):
    return groups.members(table(spark, d, "conversations"), "conv_id", "text")


# --- Splits ----------------------------------------------------------------------------------------

BUCKET = "CASE WHEN size <= 5 THEN '4-5' WHEN size <= 10 THEN '6-10' WHEN size <= 15 THEN '11-15' WHEN size <= 20 THEN '16-20' ELSE '21-∞' END"
ORDINAL = "CASE WHEN size <= 5 THEN 0 WHEN size <= 10 THEN 1 WHEN size <= 15 THEN 2 WHEN size <= 20 THEN 3 ELSE 4 END"
SPLIT = f"""kept AS (SELECT grp, size, {ORDINAL} AS ordinal, {BUCKET} AS bucket FROM sizes WHERE size >= 4),
placed AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {h(42, "grp")}, grp) AS place, count(*) OVER (PARTITION BY bucket) AS n FROM kept),
split AS (SELECT grp, size, ordinal, bucket, CASE WHEN place <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' WHEN place <= round_even(n * 0.8::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM placed)"""


@query(f"WITH {SIZES}, {SPLIT} SELECT * FROM split")
def stratified_split(spark, d):
    return splits.stratified(_sizes(spark, d), 4, EDGES)


@query(
    f"""WITH {SIZES}, {SPLIT} SELECT coalesce(bucket, 'TOTAL') AS bucket, count(*) AS total_groups, count(*) FILTER (split = 'train') AS train_groups,
count(*) FILTER (split = 'val') AS val_groups, count(*) FILTER (split = 'test') AS test_groups FROM split GROUP BY ROLLUP (bucket)"""
)
def split_summary_rollup(spark, d):
    return splits.summary(stratified_split(spark, d))


@query(
    f"""WITH {SIZES}, r AS (SELECT grp, size, row_number() OVER (ORDER BY {h(42, "grp")}, grp) AS place, count(*) OVER () AS n FROM sizes WHERE size < 15 AND size >= 5)
SELECT grp, size, 'train' AS split FROM sizes WHERE size >= 15 UNION ALL SELECT grp, size, CASE WHEN place <= ceil(n * 0.5) THEN 'test' ELSE 'val' END FROM r"""
)
def threshold_split(spark, d):
    return splits.by_threshold(_sizes(spark, d), 15, 5)


@query(f"WITH {SIZES}, {SPLIT} SELECT split, count(*) AS n_rows, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders JOIN split ON o_custkey = grp GROUP BY 1")
def split_rows(spark, d):
    rows = splits.rows_of(table(spark, d, "orders"), stratified_split(spark, d), "o_custkey")
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"WITH {SIZES}, {SPLIT} SELECT grp, count(DISTINCT split) AS splits FROM split GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leaks(spark, d):
    return splits.leaks(stratified_split(spark, d))


# --- Pairs and triplets: turns of conversations ------------------------------------------------------

MEMBERS = """named AS (SELECT conv_id AS grp, text AS name FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL),
members AS (SELECT * FROM (SELECT grp, name, row_number() OVER (PARTITION BY grp ORDER BY name) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM named) WHERE n >= 2)"""
PAIRS = "every AS (SELECT a.grp, a.i, b.i AS j, a.name AS anchor, b.name AS positive FROM members a JOIN members b ON a.grp = b.grp AND a.i < b.i)"
#: triplets.sample_pairs: numbers by a prime stride, around the number of a group's pairs.
CAPPED = f"""heads AS (SELECT grp, n * (n - 1) // 2 AS total, {h(42, "grp", "'pairs'")} AS start, {list(triplets.STRIDES)}[1 + ({h(42, "grp", "'stride'")}) % {len(triplets.STRIDES)}] AS prime FROM members WHERE i = 0),
numbers AS (SELECT grp, (start + t * (CASE WHEN prime % total = 0 THEN 1 ELSE prime % total END)) % total AS o FROM (SELECT *, unnest(range(least({{k}}, total))) AS t FROM heads)),
pairs AS (SELECT every.* FROM every JOIN numbers ON every.grp = numbers.grp AND every.j * (every.j - 1) // 2 + every.i = numbers.o)"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    return triplets.indexed(table(spark, d, "conversations"), "conv_id", "text")


@query(f"WITH {MEMBERS}, {PAIRS} SELECT * FROM every")
def all_pairs(spark, d):
    return triplets.sample_pairs(_members(spark, d), None)


@query(f"WITH {MEMBERS}, {PAIRS}, {CAPPED.format(k=5)} SELECT * FROM pairs")
def sampled_pairs(spark, d):
    return triplets.sample_pairs(_members(spark, d), 5)


def _built(k: str, negatives: int) -> str:
    return f"""WITH {MEMBERS}, {PAIRS}, {CAPPED.format(k=k)}, grp_order AS (SELECT grp, n, row_number() OVER (ORDER BY {h(42, "grp", "'order'")}, grp) - 1 AS g, count(*) OVER () AS total FROM members WHERE i = 0),
drawn AS (SELECT p.*, o.g, o.total, t, {h(42, "p.grp", "i", "j", "t", "'g'")} AS hg, {h(42, "p.grp", "i", "j", "t", "'n'")} AS hn FROM pairs p JOIN grp_order o USING (grp), (SELECT unnest(range(1, {negatives + 1})) AS t) WHERE total > 1),
aimed AS (SELECT d.*, o.grp AS neg_grp, hn % o.n AS neg_i FROM drawn d JOIN grp_order o ON o.g = (d.g + 1 + hg % (d.total - 1)) % d.total)
SELECT a.anchor, a.positive, m.name AS negative, CAST(a.grp AS VARCHAR) AS anchor_group FROM aimed a JOIN members m ON m.grp = a.neg_grp AND m.i = a.neg_i"""


@query(_built("200", 2))
def build_triplets(spark, d):
    return triplets.build(_members(spark, d), 200, 2)


@query(f"SELECT DISTINCT * FROM ({_built('1000000000', 1)})")
def build_triplets_distinct(spark, d):
    return triplets.build_distinct(_members(spark, d))


TRIPLETS = f"t AS ({_built('200', 2)})"


@query(
    f"""WITH {TRIPLETS}, g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_group ORDER BY {h(42, "anchor", "positive", "negative", "anchor_group")}, anchor, positive, negative, anchor_group) AS r FROM t WHERE anchor_group <> '') WHERE r <= 10)
SELECT anchor, positive, negative, anchor_group FROM (SELECT * EXCLUDE r, row_number() OVER (PARTITION BY anchor ORDER BY {h(42, "anchor", "positive", "negative", "anchor_group")}, anchor, positive, negative, anchor_group) AS r FROM g) WHERE r <= 3"""
)
def cap_triplets(spark, d):
    return triplets.cap(build_triplets(spark, d), 10, 3)


@query(
    f"""WITH {TRIPLETS}, hard AS (SELECT * FROM t WHERE length(negative) < length(anchor))
SELECT * FROM t UNION ALL (SELECT * FROM hard ORDER BY {h(42, "anchor", "positive", "negative", "anchor_group")}, anchor, positive, negative, anchor_group LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM t))"""
)
def mix_hard(spark, d):
    built = build_triplets(spark, d)
    return triplets.mix_hard(built, built.where(F.length("negative") < F.length("anchor")), 0.1)


@query(f"WITH {TRIPLETS} SELECT anchor AS text FROM t UNION SELECT positive FROM t UNION SELECT negative FROM t")
def gallery_union(spark, d):
    return metrics.gallery(build_triplets(spark, d))


@query(f"WITH {TRIPLETS} SELECT anchor AS a, positive AS b, 1::BIGINT AS y FROM t UNION SELECT anchor, negative, 0 FROM t")
def pairs_union_distinct(spark, d):
    return metrics.labelled_pairs(build_triplets(spark, d))


@query(f"WITH {TRIPLETS} SELECT 'anchor' AS role, anchor AS text FROM t UNION ALL SELECT 'positive', positive FROM t UNION ALL SELECT 'negative', negative FROM t")
def triplet_roles(spark, d):
    return metrics.roles(build_triplets(spark, d))


POOL = f"{TRIPLETS}, pool AS (SELECT anchor_group AS grp, anchor AS name FROM t UNION SELECT anchor_group, positive FROM t)"


@query(f"WITH {POOL} SELECT grp, name FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM pool) WHERE n >= 2")
def name_pool(spark, d):
    return mining.name_pool(build_triplets(spark, d))


# --- Text functions ----------------------------------------------------------------------------------

def normal(column: str) -> str:
    """text.match_normalize in SQL: enough for the texts at hand; tests compare with Unicode's own tables."""
    return f"trim(regexp_replace(lower(strip_accents({column})), '[^\\p{{L}}]+', ' ', 'g'))"


@query("SELECT doc_id, regexp_full_match(text, '(?s)[\\x00-\\x7F]*') AS is_ascii, length(text) AS n_chars FROM documents")
def ascii_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", scripts.word_is_in(F.col("text"), "ascii").alias("is_ascii"), F.length("text").cast("long").alias("n_chars"))


@query(
    """SELECT p_partkey, regexp_full_match(p_name, '[\\x00-\\x7F]*') AS is_ascii, regexp_full_match(p_name, '[A-Za-z\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}]*') AS is_latin,
regexp_full_match(p_name, '[\\x{0400}-\\x{04FF}\\x{0500}-\\x{052F}\\x{2DE0}-\\x{2DFF}\\x{A640}-\\x{A69F}\\x{1C80}-\\x{1C8F}\\x{1E030}-\\x{1E08F}]*') AS is_cyrillic FROM part"""
)
def script_flags(spark, d):
    return table(spark, d, "part").select("p_partkey", *scripts.flags(F.col("p_name"), ["ascii", "latin", "cyrillic"]))


@query("SELECT doc_id, md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')) AS canonical FROM documents")
def canonicalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.canonicalize(F.col("text"))).alias("canonical"))


@query(f"SELECT doc_id, md5({normal('text')}) AS normal FROM documents")
def match_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.match_normalize(F.col("text"))).alias("normal"))


@query(
    f"""WITH n AS (SELECT p_partkey, {normal("p_name")} AS normal FROM part) SELECT p_partkey, normal, regexp_replace(normal, '[aeiou]+', '', 'g') AS skeleton,
array_to_string(list_transform(string_split(normal, ' ')[1:2], lambda t: t[1]), '') AS initials, string_split(normal, ' ')[-1] AS surname FROM n"""
)
def blocking_forms(spark, d):
    n = table(spark, d, "part").select("p_partkey", text.match_normalize(F.col("p_name")).alias("normal"))
    return n.select("p_partkey", "normal", text.skeleton(F.col("normal")).alias("skeleton"), text.initials(F.col("normal")).alias("initials"), text.surname(F.col("normal")).alias("surname"))


@query("SELECT p_partkey, upper(p_name) AS up, lower(p_name) AS low, upper(p_name[1]) || lower(p_name[2:]) AS capital, trim(regexp_replace(p_type, '\\s+', ' ', 'g')) AS tidy FROM part")
def case_ops(spark, d):
    c = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", text.upper(c).alias("up"), text.lower(c).alias("low"), text.capitalize(c).alias("capital"), text.tidy_spaces(F.col("p_type")).alias("tidy"))


@query()
def title_case(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.title(F.col("text"))).alias("title"))


@query()
def unicode_forms(spark, d):
    c = F.col("text")
    forms = {"nfkd": text.nfkd(c), "nfkc": text.nfkc(c), "bare": text.drop_diacritics(c), "folded": text.ascii_fold(c), "composed": text.ascii_fold_composed(c)}
    return table(spark, d, "documents").select("doc_id", *(F.md5(v).alias(k) for k, v in forms.items()))


@query()
def transliterate(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.element_at(F.array(*map(F.lit, ("ru", "el", "xx"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("lang"))
    cyrillic = F.translate("p_name", "abdegiklmnoprstuz", "абдегиклмнопрстуз")
    return rows.select("p_partkey", "lang", translit.transliterate(F.when(F.col("lang") == "ru", cyrillic).otherwise(F.col("p_name")), F.col("lang")).alias("t")).select("p_partkey", "lang", "t.*")


@query("SELECT event_id, printf('%02d:%02d:%02d', CAST(s // 3600 AS BIGINT), CAST(s % 3600 // 60 AS BIGINT), CAST(s % 60 AS BIGINT)) AS hms FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS s FROM events)")
def hh_mm_ss(spark, d):
    return table(spark, d, "events").select("event_id", text.hh_mm_ss(F.floor("value")).alias("hms"))


@query(f"SELECT o_orderkey, {h(42, 'o_orderkey', 'o_custkey')} AS h, {h(42, 'o_orderkey', 'o_custkey')} / 4294967296.0 AS u FROM orders")
def sampling_draws(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sampling.draw(42, "o_orderkey", "o_custkey").alias("h"), sampling.unit(42, "o_orderkey", "o_custkey").alias("u"))


# --- JSON, filters and joins -------------------------------------------------------------------------


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events WHERE event_type IN ('click', 'view') AND CAST(props ->> '$.k' AS BIGINT) >= 50")
def json_extract(spark, d):
    rows = table(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    return rows.select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).where("k >= 50")


@query(
    """WITH ids AS (SELECT o_custkey AS id, list_distinct(list(o_orderpriority)) AS classes FROM orders GROUP BY 1)
SELECT id FROM ids WHERE list_has_any(classes, ['1-URGENT']) AND NOT list_has_any(classes, ['5-LOW'])"""
)
def type_filter_whitelist(spark, d):
    ids = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("classes"))
    return ids.where(extract.accepted(F.col("classes"), ["5-LOW"], ["1-URGENT"])).select("id")


@query(
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
)
def semi_anti(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


@query(
    """WITH n AS (SELECT conv_id AS id, text AS name, role AS language, turn FROM conversations)
SELECT id, name, arg_max(language, turn) AS language FROM n GROUP BY id, name"""
)
def dedup_last_wins(spark, d):
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("name"), F.col("role").alias("language")))).alias("n"))
    names = F.transform("n", lambda s: F.struct(s["name"].alias("name"), s["language"].alias("language")))
    return rows.select("id", F.inline(extract.last_wins(names)))


@query("SELECT DISTINCT 'S:' || s_suppkey AS id, 's:' || s_suppkey AS canonical, 'unknown' AS language, s_name AS name FROM supplier WHERE s_name <> ''")
def record_names(spark, d):
    rows = table(spark, d, "supplier")
    name = F.struct(F.lit("PRIMARY").alias("NAME_TYPE"), F.lit("x").alias("NAME_FULL"), F.col("s_name").alias("NAME_ORG"))
    whole = F.struct(F.lit("TEST").alias("DATA_SOURCE"), F.concat(F.lit("S:"), "s_suppkey").alias("RECORD_ID"), F.lit("ORGANIZATION").alias("RECORD_TYPE"), F.array(name).alias("NAMES"))
    return extract.names_of_records(rows.select(F.to_json(whole.cast(RECORD)).alias("value")), "ORGANIZATION")


@query()
def entity_names(spark, d):
    """Entities made of the suppliers, extracted again."""
    rows = table(spark, d, "supplier")
    label = lambda lang, v: F.struct(F.lit(lang).alias("language"), v.alias("value"))
    labels = F.create_map(F.lit("en"), label("en", F.col("s_name")), F.lit("fr"), label("fr", F.concat(F.col("s_name"), F.lit(" é"))))
    aliases = F.create_map(F.lit("de"), F.array(label("de", F.col("s_name"))))
    claim = F.struct(F.struct(F.struct(F.struct(F.when(F.col("s_suppkey") % 7 == 0, "Q43229").otherwise("Q5").alias("id")).alias("value")).alias("datavalue")).alias("mainsnak"))
    whole = F.struct(F.concat(F.lit("Q"), "s_suppkey").alias("id"), F.lit("item").alias("type"), labels.alias("labels"), aliases.alias("aliases"), F.struct(F.array(claim).alias("P31")).alias("claims"))
    return extract.names_of_entities(extract.entities(rows.select(F.to_json(whole).alias("value"))))


# --- Blocking: names of parts --------------------------------------------------------------------------

PART_NAMES = f"SELECT p_brand AS cluster_id, p_name AS name, min(p_partkey) AS row_id, {normal('p_name')} AS normal FROM part GROUP BY 1, 2"
KEYED = f"""rows AS ({PART_NAMES}), keyed AS (SELECT row_id, cluster_id, normal, unnest([
{{'kind': 'same_surname', 'key': string_split(normal, ' ')[-1]}}, {{'kind': 'consonant_skeleton', 'key': regexp_replace(normal, '[aeiou]+', '', 'g')}},
{{'kind': 'same_initials', 'key': array_to_string(list_transform(string_split(normal, ' ')[1:2], lambda t: t[1]), '')}}]) AS k FROM rows)"""
CANDIDATE = f"""{KEYED}, cand AS (SELECT a.row_id AS anchor_id, b.row_id, a.k.kind || '_lev' || levenshtein(a.normal, b.normal) AS label, levenshtein(a.normal, b.normal) AS distance
FROM keyed a JOIN keyed b ON a.k = b.k AND a.cluster_id <> b.cluster_id WHERE a.k.key <> '' AND levenshtein(a.normal, b.normal) BETWEEN 1 AND 3)"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("cluster_id"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("row_id"))


@query(f"WITH {CANDIDATE} SELECT * FROM cand")
def blocked_candidates(spark, d):
    return triplets.negative_candidates(_parts(spark, d), _parts(spark, d))


@query(
    f"""WITH names AS (SELECT DISTINCT {normal("p_name")} AS n FROM part) SELECT a.n AS a, b.n AS b, levenshtein(a.n, b.n) AS distance
FROM names a JOIN names b ON a.n < b.n AND string_split(a.n, ' ')[-1] = string_split(b.n, ' ')[-1] WHERE levenshtein(a.n, b.n) BETWEEN 1 AND 6"""
)
def levenshtein_band(spark, d):
    n = table(spark, d, "part").select(text.match_normalize(F.col("p_name")).alias("a")).distinct().withColumn("s", text.surname(F.col("a")))
    met = n.join(n.select(F.col("a").alias("b"), "s"), "s").where("a < b")
    return met.select("a", "b", text.edit_distance(F.col("a"), F.col("b")).alias("distance")).where(F.col("distance").between(1, 6))


CHOSEN = f"""{CANDIDATE}, first_ AS (SELECT anchor_id, row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY {h(42, "anchor_id", "row_id", "label")}, row_id, label) AS r FROM cand) WHERE r = 1),
members AS (SELECT cluster_id AS grp, row_id AS name, row_number() OVER (PARTITION BY cluster_id ORDER BY row_id) - 1 AS i, count(*) OVER (PARTITION BY cluster_id) AS n FROM rows),
ord AS (SELECT grp, n, row_number() OVER (ORDER BY {h(42, "grp", "'order'")}, grp) - 1 AS g, count(*) OVER () AS total FROM members WHERE i = 0),
rest AS (SELECT row_id AS anchor_id, (o.g + 1 + {h(42, "row_id", "'g'")} % (o.total - 1)) % o.total AS other, {h(42, "row_id", "'n'")} AS hn FROM rows JOIN ord o ON o.grp = cluster_id WHERE o.total > 1 AND row_id NOT IN (SELECT anchor_id FROM first_))"""


@query(
    f"""WITH {CHOSEN} SELECT anchor_id, row_id, label FROM first_ UNION ALL
SELECT anchor_id, m.name, 'random_diff_cluster' FROM rest JOIN ord o ON o.g = rest.other JOIN members m ON m.grp = o.grp AND m.i = hn % o.n"""
)
def choose_negative(spark, d):
    return triplets.choose_negative(_parts(spark, d), _parts(spark, d))


# --- Vectors: embeddings by label ------------------------------------------------------------------------

DOT = "round(list_dot_product({}::DOUBLE[], {}::DOUBLE[]), 6)"
GE = "e AS (SELECT vec_id AS id, label AS grp, embedding AS v FROM embeddings)"
SIMS = f"{GE}, sims AS (SELECT a.id AS a, b.id AS b, a.grp AS ga, b.grp AS gb, {DOT.format('a.v', 'b.v')} AS s FROM e a, e b WHERE a.id <> b.id)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("v"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


@query(f"WITH {GE} SELECT a.id AS a, b.id AS b, {DOT.format('a.v', 'b.v')} AS score, round(1 - {DOT.format('a.v', 'b.v')}, 6) AS distance FROM e a JOIN e b ON a.grp = b.grp AND a.id < b.id")
def pair_scores(spark, d):
    e = _vectors(spark, d)
    b = e.select(F.col("id").alias("b"), "grp", F.col("v").alias("w"))
    s = e.join(b, "grp").where("id < b").select(F.col("id").alias("a"), "b", F.round(vectors.dot(F.col("v"), F.col("w")), 6).alias("score"))
    return s.withColumn("distance", F.round(vectors.cosine_distance(F.col("score")), 6))


COS = "round(list_dot_product(a.v::DOUBLE[], q.v::DOUBLE[]) / (sqrt(list_dot_product(a.v::DOUBLE[], a.v::DOUBLE[])) * sqrt(list_dot_product(q.v::DOUBLE[], q.v::DOUBLE[]))), 6)"


@query(f"WITH {GE} SELECT a.id, {COS} AS score FROM e a, (SELECT v FROM e WHERE id = 0) q ORDER BY score DESC, id LIMIT 25")
def topk_vector(spark, d):
    return knn.nearest(_vectors(spark, d), _query_vector(spark, d), 25)


@query(f"WITH {GE} SELECT * FROM (SELECT a.id, {COS} AS score FROM e a, (SELECT v FROM e WHERE id = 0) q) WHERE score >= 0.25 ORDER BY score DESC, id LIMIT 25")
def topk_vector_tau(spark, d):
    return knn.nearest(_vectors(spark, d), _query_vector(spark, d), 25, 0.25)


@query(f"WITH {GE} SELECT * FROM (SELECT a.id, {COS} AS score FROM e a, (SELECT v FROM e WHERE id = 0) q ORDER BY score DESC, id LIMIT 25) WHERE score >= 0.25")
def topk_then_tau(spark, d):
    return knn.nearest(_vectors(spark, d), _query_vector(spark, d), 25, 0.25, inside=False)


NEAR = f"""{GE}, near AS (SELECT * FROM (SELECT a.id AS a, b.id AS b, {DOT.format("a.v", "b.v")} AS s, row_number() OVER (PARTITION BY a.id ORDER BY {DOT.format("a.v", "b.v")} DESC, b.id) AS rank FROM e a, e b) WHERE rank <= {{k}})"""


@query(f"WITH {NEAR.format(k=10)} SELECT CAST(a AS VARCHAR) AS qid, b AS id, s AS score, rank FROM near")
def knn_join(spark, d):
    return knn.knn_join(_vectors(spark, d), 10)


@query(
    f"""WITH {NEAR.format(k=15)}, others AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY rank) AS rank FROM near WHERE a <> b),
hits AS (SELECT e.id AS a, min(o.rank) AS first FROM e LEFT JOIN (SELECT o.* FROM others o JOIN e x ON x.id = o.a JOIN e y ON y.id = o.b WHERE x.grp = y.grp) o ON o.a = e.id GROUP BY 1)
SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN first <= k THEN 1.0 ELSE 0.0 END), 9) AS recall, count(*) AS queries FROM hits, (SELECT unnest([1, 5, 10]) AS k) GROUP BY 1"""
)
def recall_at_k(spark, d):
    rows = _vectors(spark, d).select("id", "v", F.array("grp").alias("groups"))
    return _rounded(metrics.recall_at_k(rows), "recall", digits=9)


#: Anchor and positive of one label, and a negative drawn from another, all by id.
VECTOR_TRIPLETS = f"""members AS (SELECT id, grp, v, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM e),
ord AS (SELECT grp, n, row_number() OVER (ORDER BY {h(42, "grp", "'order'")}, grp) - 1 AS g, count(*) OVER () AS total FROM members WHERE i = 0),
t AS (SELECT a.id AS anchor, p.id AS positive, x.id AS negative, {DOT.format("a.v", "p.v")} AS pos, {DOT.format("a.v", "x.v")} AS neg FROM members a JOIN ord o ON o.grp = a.grp JOIN members p ON p.grp = a.grp AND p.i = (a.i + 1) % a.n
JOIN ord q ON q.g = (o.g + 1 + {h(42, "a.id", "'g'")} % (o.total - 1)) % o.total JOIN members x ON x.grp = q.grp AND x.i = {h(42, "a.id", "'n'")} % q.n)"""
SCORED = f"""{GE}, {VECTOR_TRIPLETS},
scored AS (SELECT y, score FROM (SELECT anchor, positive AS other, 1 AS y, pos AS score FROM t UNION SELECT anchor, negative, 0, neg FROM t))"""
CURVE = f"""{SCORED}, by_ AS (SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM scored GROUP BY 1),
c AS (SELECT *, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM by_ WINDOW d AS (ORDER BY score DESC)),
f AS (SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / pos AS recall, 2.0 * tp / (tp + fp + pos) AS f1 FROM c)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """The distinct pairs of the triplets, labelled and scored."""
    texts = _vectors(spark, d).select(F.col("id").alias("text"), F.col("v").alias("embedding"))
    return metrics.score_pairs(metrics.labelled_pairs(_vector_triplets(spark, d)), texts).select(F.col("y").cast("int").alias("y"), "score")


@query(f"WITH {CURVE} SELECT round(sum(p * (neg - fp + n / 2.0)) / (max(pos) * max(neg)), 9)::DOUBLE AS roc_auc FROM f")
def roc_auc(spark, d):
    return _rounded(metrics.roc_auc(_scored(spark, d)), "roc_auc", digits=9)


@query(f"WITH {CURVE} SELECT round(sum(p * precision) / max(pos), 9)::DOUBLE AS average_precision FROM f")
def average_precision(spark, d):
    return _rounded(metrics.average_precision(_scored(spark, d)), "average_precision", digits=9)


@query(f"WITH {CURVE} SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, 9) AS precision, round(recall, 9) AS recall FROM f")
def pr_curve(spark, d):
    return _rounded(metrics.curve(_scored(spark, d)), "precision", "recall", digits=9).select("score", "tp", "fp", "precision", "recall")


@query(
    f"""WITH {CURVE}, l AS (SELECT score, round(f1, 12) AS f1, lag(score) OVER (ORDER BY score) AS below FROM f)
SELECT coalesce((SELECT below FROM l ORDER BY f1 DESC, score LIMIT 1), (SELECT median(score) FROM scored)) AS tau"""
)
def tau_max_f1(spark, d):
    return metrics.tau_max_f1(_scored(spark, d))


@query(f"WITH {CURVE} SELECT coalesce(min(score) FILTER (precision >= 0.5), max(score)) AS tau FROM f")
def tau_precision_at(spark, d):
    return metrics.tau_precision_at(_scored(spark, d), 0.5)


@query(
    f"""WITH {SCORED}, m AS (SELECT count(*) FILTER (score >= 0.1 AND y = 1) AS tp, count(*) FILTER (score >= 0.1 AND y = 0) AS fp, count(*) FILTER (score < 0.1 AND y = 1) AS fn, count(*) FILTER (score < 0.1 AND y = 0) AS tn FROM scored)
SELECT tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 9) AS accuracy, round(2.0 * tp / (2 * tp + fp + fn), 9)::DOUBLE AS f1, round(tp::DOUBLE / (tp + fp), 9) AS ppv, round(tn::DOUBLE / (tn + fn), 9) AS npv FROM m"""
)
def pair_confusion(spark, d):
    return _rounded(metrics.confusion(_scored(spark, d), 0.1), "accuracy", "f1", "ppv", "npv", digits=9)


@query(
    f"""WITH {SCORED}, g AS (SELECT i, count(*) FILTER (y = 1 AND score > round(i / 100.0, 2)) AS tp, count(*) FILTER (y = 0 AND score > round(i / 100.0, 2)) AS fp, count(*) FILTER (y = 1) AS pos FROM scored, (SELECT unnest(range(101)) AS i) GROUP BY 1)
SELECT (i / 100.0)::DOUBLE AS t, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(tp::DOUBLE / pos, 9) AS recall, round(coalesce(2.0 * tp / nullif(tp + fp + pos, 0), 0), 9)::DOUBLE AS f1 FROM g"""
)
def threshold_sweep(spark, d):
    return _rounded(metrics.threshold_sweep(_scored(spark, d)), "precision", "recall", "f1", digits=9)


@query(f"WITH {SCORED} SELECT CAST(least(greatest(floor((score + 1) / 2 * 50), 0), 49) AS BIGINT) AS bin, y, count(*) AS pairs FROM scored GROUP BY 1, 2")
def score_density(spark, d):
    return metrics.score_density(_scored(spark, d))


def _vector_triplets(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    m = triplets.indexed(e.select(F.col("grp").alias("id"), F.col("id").alias("name")))
    order = triplets.group_order(m)
    a = m.join(order.select("grp", "g", "total"), "grp")
    other = (F.col("g") + 1 + sampling.draw(42, "name", F.lit("g")) % (F.col("total") - 1)) % F.col("total")
    a = a.select("grp", F.col("name").alias("anchor"), ((F.col("i") + 1) % F.col("n")).cast("int").alias("i"), other.alias("g"), sampling.draw(42, "name", F.lit("n")).alias("hn"))
    a = a.join(m.select("grp", "i", F.col("name").alias("positive")), ["grp", "i"]).drop("grp", "i").join(order.select("grp", "g", "n"), "g")
    a = a.withColumn("i", (F.col("hn") % F.col("n")).cast("int")).join(m.select("grp", "i", F.col("name").alias("negative")), ["grp", "i"])
    vectors_ = e.select(F.col("id").alias("text"), F.col("v").alias("embedding"))
    return metrics.score_triplets(a.select("anchor", "positive", "negative"), vectors_)


@query(
    f"""WITH {GE}, {VECTOR_TRIPLETS} SELECT count(*) AS triplets, round(avg((pos > neg)::INT), 6) AS accuracy, round(avg(pos - neg), 6) AS gap,
round(avg((neg > pos - 0.3)::INT), 6) AS violations, round(avg(greatest(neg - pos + 0.3, 0)), 6) AS loss FROM t"""
)
def triplet_eval(spark, d):
    return _rounded(metrics.triplet_metrics(_vector_triplets(spark, d)), "accuracy", "gap", "violations", "loss")


@query(
    f"""WITH {GE}, {VECTOR_TRIPLETS}, o AS (SELECT CASE WHEN pos <= neg THEN 'Incorrect' WHEN neg > pos - 0.3 THEN 'Correct but Violated' ELSE 'Correct & Satisfied' END AS outcome FROM t)
SELECT outcome, count(*) AS triplets, round(count(*) / sum(count(*)) OVER (), 9)::DOUBLE AS share FROM o GROUP BY 1"""
)
def outcome_categories(spark, d):
    return _rounded(metrics.outcomes(_vector_triplets(spark, d)), "share", digits=9)


@query(f"WITH {GE}, {VECTOR_TRIPLETS} SELECT anchor, positive, negative, pos, neg, round(greatest(neg - pos + 0.3, 0), 6)::DOUBLE AS loss, (neg >= pos - 0.1 AND neg < pos) AS semi_hard FROM t")
def triplet_loss(spark, d):
    t = _vector_triplets(spark, d)
    pos, neg = F.col("pos"), F.col("neg")
    return t.select("anchor", "positive", "negative", "pos", "neg", F.round(vectors.triplet_loss(pos, neg, 0.3), 6).alias("loss"), ((neg >= pos - 0.1) & (neg < pos)).alias("semi_hard"))


@query(f"WITH {GE}, {VECTOR_TRIPLETS} SELECT anchor, CASE WHEN s >= 80 THEN 'same' WHEN s >= 50 THEN 'close' WHEN s >= 30 THEN 'likely' WHEN s >= 20 THEN 'plausible' WHEN s >= 10 THEN 'unlikely' ELSE 'none' END AS bucket FROM (SELECT anchor, floor(abs(pos) * 100) AS s FROM t)")
def score_buckets(spark, d):
    return _vector_triplets(spark, d).select("anchor", vectors.score_bucket(F.floor(F.abs("pos") * 100)).alias("bucket"))


MINED = f"""{GE}, every AS (SELECT a.grp, a.id AS a, b.id AS b, a.v AS va, {DOT.format("a.v", "b.v")} AS pos FROM e a JOIN e b ON a.grp = b.grp AND a.id < b.id),
scored AS (SELECT p.grp, p.a, p.b, n.id AS neg, p.pos, {DOT.format("p.va", "n.v")} AS score FROM every p JOIN e n ON n.grp <> p.grp),
mined AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, neg) AS rank FROM scored WHERE score >= round(pos - 0.1, 8) AND score < pos)"""


@query(f"WITH {MINED} SELECT * FROM mined WHERE rank <= 10")
def mine_exhaustive(spark, d):
    return mining.mine_exhaustive(_vectors(spark, d))


@query(
    f"""WITH {GE}, m AS (SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY id) AS i FROM e), ord AS (SELECT grp, row_number() OVER (ORDER BY {h(42, "grp", "'order'")}, grp) - 1 AS g, count(*) OVER () AS total FROM m WHERE i = 1),
every AS (SELECT a.grp, a.id AS a, b.id AS b, a.v AS va, {DOT.format("a.v", "b.v")} AS pos FROM e a JOIN e b ON a.grp = b.grp AND a.id < b.id),
p AS (SELECT every.*, (g + 1 + ({h(42, "grp", "a", "b", "'s'")} + t) % (total - 1)) % total AS other FROM every JOIN ord USING (grp), (SELECT unnest(range(10)) AS t) WHERE t < total - 1),
scored AS (SELECT p.grp, p.a, p.b, n.id AS neg, p.pos, {DOT.format("p.va", "n.v")} AS score FROM p JOIN ord o ON o.g = p.other JOIN e n ON n.grp = o.grp)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, neg) AS rank FROM scored WHERE score >= round(pos - 0.1, 8) AND score < pos) WHERE rank <= 10"""
)
def mine_sampled(spark, d):
    return mining.mine_sampled(_vectors(spark, d))


@query(
    f"""WITH {NEAR.format(k=205)}, m AS (SELECT id, grp, v, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM e),
anchors AS (SELECT a.id AS anchor, a.grp, p.id AS positive, {DOT.format("a.v", "p.v")} AS pos FROM m a JOIN m p ON p.grp = a.grp AND p.i = (a.i + 1 + {h(42, "a.grp", "a.id", "'p'")} % (a.n - 1)) % a.n WHERE a.n >= 2),
met AS (SELECT x.grp, anchor, positive, b AS negative, pos, s AS score FROM near JOIN anchors x ON x.anchor = near.a JOIN e y ON y.id = near.b WHERE near.a <> near.b AND x.grp <> y.grp AND s >= pos - 0.05)
SELECT grp, anchor, positive, negative, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, negative) AS r FROM met) WHERE r <= 4"""
)
def mine_knn(spark, d):
    return mining.mine_knn(_vectors(spark, d).withColumn("name", F.col("id").cast("string")))


@query(f"WITH {MINED}, c AS (SELECT grp, count(*) AS n FROM mined WHERE rank <= 10 GROUP BY 1) SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS largest FROM c")
def mined_per_group(spark, d):
    return _rounded(mining.written_per_group(mining.mine_exhaustive(_vectors(spark, d), counted=True)), "mean", "p95")


@query()
def ivf_knn(spark, d):
    return knn.ivf_knn(_vectors(spark, d), 5, nlist=32, nprobe=8)


@query()
def hashed_encoder(spark, d):
    e = knn.encode(table(spark, d, "part"), text_col="p_name")
    return e.select("text", F.md5(F.to_json("embedding")).alias("digest"), F.round(vectors.norm(F.col("embedding")), 9).alias("norm"))


# --- Statistics, augmentation, records ---------------------------------------------------------------


@query(
    """SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.95), 6) AS p95,
round(avg((value > 50)::INT), 9) AS clip_rate, 0::BIGINT AS non_finite FROM events GROUP BY 1"""
)
def stats_summary(spark, d):
    return _rounded(_rounded(metrics.describe(table(spark, d, "events"), "value", "event_type", 50.0), "mean", "std", "p95"), "clip_rate", digits=9)


@query(
    """WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS back FROM events)
SELECT user_id, round(sum(value * 0.1 * pow(0.9, back)), 6) AS ema FROM o GROUP BY 1"""
)
def ema_loss(spark, d):
    return _rounded(metrics.moving_average(table(spark, d, "events"), "user_id", "event_id", "value"), "ema")


@query()
def augment_names(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("en").alias("language"))
    return augment.augment_rows(rows)


@query()
def heuristic_triplets(spark, d):
    rows = _parts(spark, d).withColumn("lang", F.lit("en"))
    return triplets.heuristic(rows, augment.augmenter(7))


@query(
    """SELECT n_nationkey AS RECORD_ID, '{"DATA_SOURCE":"TEST","RECORD_ID":"' || n_nationkey || '","RECORD_TYPE":"PERSON","NAMES":[' ||
string_agg('{"NAME_TYPE":"PRIMARY","NAME_FULL":"' || s_name || '"}', ',' ORDER BY s_name) || ']}' AS json FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"""
)
def record_shape(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return records.shape_names(rows.select(F.col("n_nationkey").alias("id"), F.col("s_name").alias("name")), "TEST")
