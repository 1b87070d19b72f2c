r"""Personal data: patterns, and terms that reveal protected entities (native Spark SQL only).

Base kinds are found per text by regular expressions, with code-point spans. On top of them an
information-theoretic sanitiser looks at the corpus. What is protected is each base value and what
can be known of it: its parts (an email's name and domain, a phone's area, a card's issuer, an
address's network) and its kind. Most values stand in one text alone, where nothing can be
estimated; their parts and kinds recur. For such a concept c, with N distinct texts, n(c) of them
holding c, n(t) holding term t and n(c,t) holding both, t outside the base values, the disclosure of c by t is

    PMI(c;t) / IC(c) = log2(n(c,t) N / (n(c) n(t))) / log2(N / n(c))

and a term that reaches `threshold` in at least `min_support` distinct texts gives the concept away even
when the value itself has been removed. (Among the texts of all pairs that reach the threshold, one that
shares COPY_PERCENT of its words with one of a smaller key counts as that one: near copies are no
evidence. All other counts are of all distinct texts.) In the texts that hold both, a term that gives
away a value or a part of it is removed (spans of kind `term`); one that gives away the kind alone is
generalised to its shape (kind `context`).

Defined cases: null text counts as empty; empty text has no spans; copies of a text count once in
the statistics and get equal spans; a row comes out for every row that goes in, whatever its
other columns hold; an empty table gives an empty result. Matching is done by the JVM's regular
expressions with possessive quantifiers, so long runs neither backtrack nor recurse. Texts are known by
128-bit digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.llm.common import materialize

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "term", "context")
#: The look-behind keeps a failed run from being tried again from its middle; \G lets a match
#: begin where the last one ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that any text with a match passes.
GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
WORD = r"[\p{L}\p{N}_]+"
SLOTS = 1 << 21
COPY_PERCENT = 80
_KIND = "kind:"  # no base value holds a colon
_STEP = 64  # matches of a block of sums


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        octet = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(octet))
    if kind == "card":
        digits = F.regexp_replace(m, r"[\x20-]", "")
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _starts(df: DataFrame, gaps: str, found: str, out: str) -> DataFrame:
    """df with the code-point starts of the matches, from the texts between them. Sums go by blocks, so that a
    text of very many matches takes a time little more than in proportion."""
    lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, n: a + n)
    upto = lambda x, n: total(F.slice(x, F.lit(1), n))
    df = df.withColumn("__lengths", lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size("__lengths") / _STEP).cast("int")), lambda k: total(F.slice("__lengths", k * _STEP + 1, F.lit(_STEP))))
    df = df.withColumn("__blocks", blocks)
    df = df.withColumn("__before", F.transform("__blocks", lambda _, k: upto(F.col("__blocks"), k)))
    place = lambda g, i: F.get("__before", F.floor(i / _STEP).cast("int")) + total(F.slice("__lengths", F.floor(i / _STEP).cast("int") * _STEP + 1, i % _STEP)) + F.length(g)
    return df.withColumn(out, F.transform(F.slice(gaps, 1, F.size(found)), place)).drop("__lengths", "__blocks", "__before")


_SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _spans(kind: str, starts: Column, found: Column) -> Column:
    """Valid spans of one kind as structs in the order of their sort key."""
    k = KINDS.index(kind)
    zipped = F.zip_with(
        starts,
        found,
        lambda s, m: F.struct(
            s.alias("start"), F.lit(k).alias("kind"), (s + F.length(m)).alias("end"), m.alias("value")
        ),
    )
    return F.filter(zipped, lambda z: _valid(kind, z["value"]))


def base_spans(docs: DataFrame, text_col: str, out: str = "base") -> DataFrame:
    """docs with an array of base spans (start, kind, end, value), sorted by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    found = docs.withColumns(
        {f"__m_{k}": F.when(GATES[k](text), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in PATTERNS.items()}
    )
    found = found.withColumns(
        {f"__g_{k}": F.when(F.size(f"__m_{k}") > 0, F.split(text, p, -1)).otherwise(none) for k, p in PATTERNS.items()}
    )
    for k in PATTERNS:
        found = _starts(found, f"__g_{k}", f"__m_{k}", f"__a_{k}")
    found = found.withColumns({f"__s_{k}": F.when(F.size(f"__m_{k}") > 0, _spans(k, F.col(f"__a_{k}"), F.col(f"__m_{k}"))).otherwise(F.array().cast(_SPANS)) for k in PATTERNS})
    return found.withColumn(out, F.array_sort(F.concat(*(F.col(f"__s_{k}") for k in PATTERNS)))).drop(
        *(f"__{x}_{k}" for x in "magas" for k in PATTERNS)
    )


def concepts(base: Column) -> Column:
    """What is protected of the base spans: the values in lower case, their parts and their kinds."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")

    def of(s: Column) -> Column:
        v = F.lower(s["value"])
        kind = F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
        name = F.regexp_extract(v, "^[^a-z]*([a-z]{3,})[^@]*@", 1)
        part = (
            F.when(kind == "email", F.concat(F.lit("domain:"), F.substring_index(v, "@", -1)))
            .when(kind == "ip", F.concat(F.lit("net:"), F.substring_index(v, ".", 2)))
            .when(kind == "card", F.concat(F.lit("issuer:"), F.substring(digits(v), 1, 6)))
            .otherwise(F.concat(F.lit("area:"), F.substring(digits(v), 1, 4)))
        )
        return F.array(v, part, F.concat(F.lit(_KIND), kind), F.when((kind == "email") & (name != ""), F.concat(F.lit("name:"), name)))

    return F.array_distinct(F.array_compact(F.flatten(F.transform(base, of))))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _representatives(words: DataFrame) -> DataFrame:
    """(text_key, copy_of) of the texts that share COPY_PERCENT of their words with one of a smaller key. Such a
    pair shares one of the rarest words of either; of the texts with a word each is compared with the first
    alone, so that a group of copies costs a row a copy. words: (text_key, term, n_near)."""
    word = F.struct("n_near", F.xxhash64("term").alias("h"))
    sets = words.groupBy("text_key").agg(F.sort_array(F.collect_list(word)).alias("w")).withColumn("n", F.size("w"))
    needed = F.ceil(F.col("n") * COPY_PERCENT / 100).cast("int")
    rarest = sets.select("text_key", "n", F.explode(F.slice("w", F.lit(1), F.col("n") - needed + 1)).alias("w"))
    rarest = rarest.where("w.n_near > 1").select("text_key", "n", F.col("w.h").alias("h"))
    heads = rarest.groupBy("h").agg(F.min(F.struct("text_key", "n")).alias("head"), F.count("*").alias("k")).where("k > 1")
    met = rarest.join(heads, "h").select("text_key", "n", F.col("head.text_key").alias("head"), F.col("head.n").alias("m"))
    met = met.where((F.col("text_key") != F.col("head")) & (F.least("n", "m") * 100 >= F.greatest("n", "m") * COPY_PERCENT)).distinct()
    a = sets.select("text_key", F.col("w.h").alias("wa"))
    b = sets.select(F.col("text_key").alias("head"), F.col("w.h").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    pairs = met.join(a, "text_key").join(b, "head").where(both * 100 >= (F.col("n") + F.col("m") - both) * COPY_PERCENT)
    return pairs.groupBy("text_key").agg(F.min("head").alias("copy_of"))


def disclosing_terms(near: DataFrame, texts: DataFrame, threshold: float, min_support: int) -> DataFrame | None:
    """(text_key, term, kind) for each term that gives away a concept of that text, or None if no concept
    has the support. near: (text_key, bare, entities) of each distinct text that holds any concept, bare
    being the text without its values; texts: (text_key, text) of all rows."""
    listed = near.select("text_key", F.explode("entities").alias("entity"))
    supported = listed.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= min_support)
    held = materialize(listed.join(supported, "entity"), "pii-entities")
    if held.isEmpty():
        return None
    total = texts.select("text_key").distinct().count()
    # The threshold on PMI / IC as one on n(t): n(t) <= n(c,t) (N / n(c)) ^ (1 - threshold).
    most = F.col("n_et") * F.pow(F.lit(float(total)) / F.col("n_e"), F.lit(1.0 - threshold)) + F.lit(1e-9)
    # A term's count among all texts with concepts is at most its n(t), and n(c,t) at most n(c): a term that is too
    # common or too rare there is out.
    words = near.select("text_key", F.explode(_words(F.col("bare"))).alias("term"))
    words = materialize(words.join(words.groupBy("term").agg(F.count("*").alias("n_near")), "term"), "pii-near-words")
    met = words.where(F.col("n_near") >= min_support).join(held, "text_key")
    pairs = met.withColumn("n_et", F.col("n_e")).where(F.col("n_near") <= most).groupBy("entity", "term", "n_e", "n_near").agg(F.count("*").alias("n_et"))
    pairs = pairs.where((F.col("n_et") >= min_support) & (F.col("n_e") < total)).withColumn("most", most)
    pairs = materialize(pairs.where(F.col("n_near") <= F.col("most")).select("entity", "term", "most"), "pii-pairs")
    open_ = pairs.select("term").distinct()
    # A set of at most SLOTS numbers passes all words that are open, and few others, where texts are read.
    slot = F.pmod(F.xxhash64("term"), F.lit(SLOTS)).alias("slot")
    seen = texts.select("text_key", F.explode(_words(F.col("text"))).alias("term")).withColumn("slot", slot)
    seen = seen.join(F.broadcast(open_.select(slot).distinct()), "slot", "left_semi").join(open_, "term", "left_semi").select("text_key", "term")
    spread = seen.distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    telling = pairs.join(spread, "term").where(F.col("n_t") <= F.col("most")).select("entity", "term")
    told = materialize(words.join(telling, "term").join(held.select("entity", "text_key"), ["entity", "text_key"]).select("entity", "term", "text_key"), "pii-told")
    copies = _representatives(words.join(told.select("text_key").distinct(), "text_key", "left_semi"))
    sources = told.join(copies, "text_key", "left").groupBy("entity", "term").agg(F.count_distinct(F.coalesce("copy_of", "text_key")).alias("sources"))
    told = told.join(sources.where(F.col("sources") >= min_support).drop("sources"), ["entity", "term"])
    kind = F.when(F.col("entity").startswith(_KIND), KINDS.index("context")).otherwise(KINDS.index("term"))
    return told.groupBy("text_key", "term").agg(F.min(kind).alias("kind"))


_OWN = ("base", "spans")


def find(
    docs: DataFrame,
    text_col: str = "text",
    threshold: float = 0.95,
    min_support: int = 3,
    keep_text: bool = True,
) -> DataFrame:
    """docs (without the text, if it isn't to be kept) with `base` (spans of the four patterns) and
    `spans` (these and the method's spans), each an array of (start, kind, end, value)."""
    if clash := {c for c in docs.columns if c in _OWN or c.startswith("__")}:
        raise ValueError(f"columns {sorted(clash)} are this operator's own: base, spans and all that start with __")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.md5(text))
    based = base_spans(docs, text_col)
    # One pass over the texts finds the base spans; of texts with spans it keeps what the statistics need.
    based = based.withColumn("__near", F.when(F.size("base") > 0, text)).withColumn("__key", F.when(F.size("base") > 0, key))
    based = materialize(based if keep_text else based.drop(text_col), "pii-base")
    near = based.where(F.col("__near").isNotNull()).select(F.col("__key").alias("text_key"), F.col("__near").alias("text"), concepts(F.col("base")).alias("entities"), "base")
    near = near.dropDuplicates(["text_key"]).withColumn("bare", redact(F.col("text"), F.col("base"), lambda _: F.lit(" ")))
    terms = disclosing_terms(near, docs.select(key.alias("text_key"), text.alias("text")), threshold, min_support)
    if terms is None:
        return based.withColumn("spans", F.col("base")).drop("__key", "__near")

    # Every place of a telling term in the texts that hold its concept. Inside base spans it goes anyway.
    told = terms.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("terms"))
    hit = near.join(told, "text_key")
    hit = hit.withColumn("m", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("g", F.split("text", WORD, -1))
    hit = _starts(hit, "g", "m", "at")
    marked = F.zip_with("at", "m", lambda s, m: F.struct(s.alias("start"), F.try_element_at("terms", F.lower(m)).alias("kind"), (s + F.length(m)).alias("end"), m.alias("value")))
    hit = hit.withColumn("placed", F.filter(marked, lambda z: z["kind"].isNotNull()))
    outside = F.filter("placed", lambda z: ~F.exists("base", lambda b: (b["start"] < z["end"]) & (z["start"] < b["end"])))
    more = hit.select(F.col("text_key").alias("__key"), outside.alias("__more"))
    # Texts without base spans are not moved.
    spans = F.when(F.col("__more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "__more")))
    joined = based.where(F.col("__near").isNotNull()).join(more, "__key", "left").withColumn("spans", spans)
    rest = based.where(F.col("__near").isNull()).withColumn("spans", F.col("base"))
    return joined.drop("__key", "__near", "__more").unionByName(rest.drop("__key", "__near"))


def _listing(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest and listing of the spans of find()."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        F.col(id_col),
        *(count(k) for k in KINDS[:4]),
        F.sha2(_listing(F.col("base")), 256).alias("base_sha256"),
        _listing(F.col("spans")).alias("spans"),
    )


def stand_in(span: Column) -> Column:
    """A base value's kind in brackets, [TERM] for a `term`, and for a `context` its shape: [NUMBER], [NAME] if it has
    a capital at its start, else [WORD]."""
    kinds, v = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), span["value"]
    shape = F.when(v.rlike("[0-9]"), "[NUMBER]").when(v.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    return F.when(span["kind"] == KINDS.index("context"), shape).otherwise(kinds[span["kind"]])


def redact(text: Column, spans: Column, stand_in: Callable[[Column], Column] = stand_in) -> Column:
    """The text with each span replaced by what stands in for it. Text that overlapping spans cover goes once."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    pieces = lambda a, s: F.concat(a["out"], F.array(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), stand_in(s)))
    return F.aggregate(
        spans,
        zero,
        lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], pieces(a, s)).otherwise(a["out"]).alias("out")),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.lit(2147483647))),
    )


def sanitise(docs: DataFrame, text_col: str = "text", threshold: float = 0.95, min_support: int = 3) -> DataFrame:
    """docs with the text's personal data and telling terms replaced; null stays null. Other columns may have any names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*others, F.lit(0).alias("__")).alias("row"), F.col(text_col).alias("text"))
    found = find(packed, "text", threshold, min_support)
    clean = F.when(F.size("spans") > 0, redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.select(*(clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
