"""Language identification, personal data, mixing and language-model scores."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from onomast.llm import langid, mixing, pii, ppm
from onomast.llm.common import table

SCHEMA = "doc_id bigint, text string, lang string, source string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def documents(spark, sf):
    return [r.asDict() for r in table(spark, sf, "documents").collect()]


# --- Language identification ---


def plain_profile(text, k):
    text = re.sub(r"[^\W\d_]", lambda m: m[0], text.lower())
    s = re.sub(r"_+", "_", "_" + "".join(c if c.isalpha() else "_" for c in text) + "_")
    grams = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
    grams = {g: c for g, c in grams.items() if g.strip("_") and "_" not in g[1:-1] and not (len(g) == 2 and g == "__")}
    def code(g):
        return sum((1 if c == "_" else ord(c)) << 16 * (len(g) - 1 - i) for i, c in enumerate(g))

    return [code(g) for g in sorted(grams, key=lambda g: (-grams[g], code(g)))][:k]


def test_profiles_match_plain_counting():
    for text in ("Hello, the world's end.", "ÀÉ été 12 naïve", "x", "", "??", "a b a b c", "漢字 かな 漢字"):
        doc, gram, rank = langid.top_ranks(*langid.ngram_counts([text, "other words"]), 40)
        own = gram[doc == 0]
        assert own.tolist() == plain_profile(text, 40) and rank[doc == 0].tolist() == list(range(len(own)))


def test_out_of_place_distance():
    profiles = {"xx": np.array(plain_profile("aba cabab", 9)), "yy": np.array(plain_profile("zyz yzzy", 9))}
    text, k = "abab zy", 9
    langs, score = langid.Classifier(profiles, k)([text, None, "12"])
    own = plain_profile(text, k)
    sums = {x: sum(abs(i - p.tolist().index(g)) if g in p.tolist() else k for i, g in enumerate(own)) for x, p in profiles.items()}
    best = min(sums, key=lambda x: (sums[x], x))
    assert langs == [best, "und", "und"] and score.tolist() == [pytest.approx(1 - sums[best] / (len(own) * k)), 0.0, 0.0]


def test_held_out_accuracy_and_inputs(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    truth = documents(spark, sf)
    held = [d for d in truth if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert held and all(got[d["doc_id"]]["held_out"] for d in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # What is held out teaches nothing, and the language isn't an input.
    blind = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(blind).collect()} == {i: (r["lang_pred"], r["score"]) for i, r in got.items()}


def test_langid_odd_cases(spark):
    rows = [(i, "the cat sat on the mat", "en", None) for i in range(8)] + [(20, None, "en", None), (21, "", None, "s"), (22, "123 !?", "en", None), (None, "the mat", None, None), (23, "the cat " * 30000, None, None)]
    got = langid.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {**{i: "en" for i in range(8)}, 20: "und", 21: "und", 22: "und", None: "en", 23: "en"}
    assert langid.identify(frame(spark, [])).count() == 0
    assert [r["lang_pred"] for r in langid.identify(frame(spark, [(1, "words", None, None)])).collect()] == ["und"]
    with pytest.raises(ValueError, match="score"):
        langid.predict(frame(spark, rows).withColumn("score", F.lit(1)), {}, ["score"])


# --- Personal data ---

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def plain_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if holds(kind, m[0])]
    return [(a, kind, b) for a, _, b, kind in sorted(found)]


def tricky(seed, n):
    rng = random.Random(seed)
    bits = ["a@b.co", "_x@y-z.org", "@", "..", "1.2.3.4", "999.1.1.1", ".", "4539578763621486", "4539 5787-6362 1486", "+1 (555) 010-9999", "+", "(", ")", "-", " ", "12", "é", "😀", "x%y+z@q.w.e", "a@b@c.d", "0255.1.2.3", "\n", "378282246310005", "5.6.7.8.9"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_supplementary_symbols_are_no_letters(spark):
    rows = [(i, f"words of one language {i}", "en", None) for i in range(8)] + [(20, "😀😀 🎉", None, None), (21, "😀" * 50, "en", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(frame(spark, rows)).collect()}
    assert got[20] == got[21] == "und" and got[0] == "en"
    doc, gram, count = langid.ngram_counts(["𐐷😀𐐷"])
    assert dict(zip(gram.tolist(), count.tolist(), strict=True))[0xFFFF] == 2


def test_base_spans_match_plain_search(spark, sf):
    texts = [*tricky(1, 3000), *(d["text"] for d in documents(spark, sf)), "", "1" * 30_000, "a" * 30_000, "a." * 9000 + "@b.c", "+1" + "(" * 20_000, "1 " * 20_000]
    rows = pii.report(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(x == k for _, x, _ in want) for k in BASE]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"Codename w{i} Zebra0 v{i} met ann@corp.example about item{i}", "x") for i in range(6)]
    rows += [(30 + i, f"All that these same words say is bob@site.example zulu yankee, copy {i}", "x") for i in range(6)]
    rows += [(100 + i, f"about the item{i} met codename nobody word{i % 7}", "x") for i in range(60)]
    rows += [(200, "Codename w0 Zebra0 v0 met ann@corp.example about item0", "x"), (201, None, "x"), (202, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, value string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    n = len({t for _, t, _ in rows if t is not None} | {""})
    words = {t or "": {w.lower() for w in re.findall(r"\w+", t or "")} for _, t, _ in rows}
    entity = {t for t in words if "ann@corp.example" in t}
    telling = set()
    for w in set().union(*words.values()):
        n_t, n_et = sum(w in x for x in words.values()), sum(w in words[t] for t in entity)
        around = [(a[k], a[k + 2]) for t in entity for a in [["", *re.findall(r"\w+", t.lower()), ""]] for k, x in enumerate(a[1:-1]) if x == w]
        if n_et >= 3 and min(len({a for a, _ in around}), len({b for _, b in around})) >= 3 and math.log2(n_et * n / (len(entity) * n_t)) >= 0.95 * math.log2(n / len(entity)):
            telling.add(w)
    assert telling == {"zebra0"}
    spans = [(s["start"], s["end"], s["value"]) for s in got[0]["spans"] if s["kind"] == pii.KINDS.index("term")]
    assert spans == [(12, 18, "Zebra0")] and len(got[0]["base"]) == 1
    assert got[200]["spans"] == got[0]["spans"] and all(not got[i]["spans"] for i in (100, 201, 202)) and got[31]["spans"] == got[31]["base"]
    clean = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert clean[3]["text"] == "Codename w3 [TERM] v3 met [EMAIL] about item3" and clean[201]["text"] is None and clean[3].asDict().keys() == {"doc_id", "text", "value"}


def test_terms_in_fixed_phrases_give_an_entity_away(spark):
    rows = [(i, f"Codename Zebra0 met ann@corp.example about item{i}") for i in range(6)]
    rows += [(10 + i, f"w{i} v{i} Mary Quill u{i} t{i} writes from max@home.example s{i}") for i in range(4)]
    rows += [(30 + i, f"All that these same words say is bob@site.example zulu yankee, copy {i}") for i in range(6)]
    rows += [(100 + i, f"about the item{i} met codename nobody writes from word{i % 7}") for i in range(60)]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    terms = lambda i: [s["value"] for s in got[i]["spans"] if s["kind"] == pii.KINDS.index("term")]
    assert all(terms(i) == ["Zebra0"] for i in range(6))
    assert all(terms(10 + i) == ["Mary", "Quill"] for i in range(4))
    assert not any(terms(30 + i) for i in range(6)) and not any(terms(100 + i) for i in range(60))


def plain_concepts(text):
    """What is protected of the base spans of a text, by a plain reading of the rule."""
    out = set()
    for a, kind, b in plain_spans(text):
        v = text[a:b].lower()
        digits = re.sub("[^0-9]", "", v)
        out |= {v, f"kind:{kind}"}
        if kind == "email":
            out.add("domain:" + v.rpartition("@")[2])
            if name := re.match("[^a-z]*([a-z]{3,})[^@]*@", v):
                out.add("name:" + name[1])
        out |= {"ip": {"net:" + ".".join(v.split(".")[:2])}, "card": {"issuer:" + digits[:6]}, "phone": {"area:" + digits[:4]}}.get(kind, set())
    return out


def plain_terms(texts):
    """{(concept, term): texts} of all terms that give a concept away."""

    def bare(t):
        out, at = "", 0
        for a, _, b in plain_spans(t):
            out += t[at:a] + " " if a >= at else ""
            at = max(at, b)
        return out + t[at:]

    whole = {t: {w.lower() for w in re.findall(r"\w+", t)} for t in set(texts)}
    words = {t: {w.lower() for w in re.findall(r"\w+", bare(t))} for t in whole}
    n, spread, holders, both = len(words), Counter(w for x in whole.values() for w in x), defaultdict(set), defaultdict(set)
    for t in words:
        for c in plain_concepts(t):
            holders[c].add(t)
            for w in words[t]:
                both[c, w].add(t)
    reach = {(c, w): held for (c, w), held in both.items() if len(held) >= 3 and len(holders[c]) < n and math.log2(len(held) * n / (len(holders[c]) * spread[w])) >= 0.95 * math.log2(n / len(holders[c])) - 1e-9}
    key = {t: hashlib.md5(t.encode()).digest() for held in reach.values() for t in held}
    copy = {t: min((key[x] for x in key if key[x] < key[t] and 100 * len(words[t] & words[x]) >= 80 * len(words[t] | words[x])), default=key[t]) for t in key}
    return {k: held for k, held in reach.items() if len({copy[t] for t in held}) >= 3}


def test_terms_of_a_whole_table_match_plain_counting(spark):
    """Kinds and parts recur where no value does."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    # Documents that the table lacks: words that stand near personal data only, and others that stand elsewhere too.
    extra = {9000 + i: f"call{i} desk{i} Hotline u{i} +1 (555) 010-9{i:03} night{i} v{i} ask{i}" for i in range(5)}
    extra |= {9100 + i: f"mail{i} the{i} registry w{i} at q{i}@zone.example x{i} y{i}" for i in range(4)}
    docs = docs.unionByName(spark.createDataFrame(list(extra.items()), "doc_id bigint, text string"))
    texts |= extra
    telling = plain_terms(texts.values())
    assert {("area:1555", "hotline"), ("kind:phone", "hotline"), ("domain:zone.example", "registry")} & set(telling)
    want = defaultdict(dict)
    for (c, w), held in telling.items():
        for t in held:
            want[t][w] = "context" if c.startswith("kind:") and want[t].get(w) != "term" else "term"
    for r in pii.find(docs).collect():
        t, base = texts[r["doc_id"]], plain_spans(texts[r["doc_id"]])
        spans = [(m.start(), m.end(), want[t][m[0].lower()]) for m in re.finditer(r"\w+", t) if m[0].lower() in want.get(t, {})]
        spans = [x for x in spans if not any(a < x[1] and x[0] < b for a, _, b in base)]
        assert [(s["start"], s["end"], pii.KINDS[s["kind"]]) for s in r["spans"] if s["kind"] > 3] == spans


def test_sanitised_texts_by_what_they_give_away(spark):
    rows = [(i, f"item{i} Quarz{i} Falcon 77x spoke to p{i}@h{i}.example", "b", i) for i in range(5)] + [(50 + i, f"item{i} nothing here {i}", "b", i) for i in range(40)]
    rows += [(100, None, None, 0), (101, "", "", 0)]
    got = {r["doc_id"]: r.asDict() for r in pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string, base string, __near int")).collect()}
    assert got[3] == {"doc_id": 3, "text": "item3 Quarz3 [NAME] [NUMBER] [WORD] [WORD] [EMAIL]", "base": "b", "__near": 3}
    assert got[50]["text"] == "item0 nothing here 0" and got[100]["text"] is None and got[101]["text"] == ""


def test_places_in_texts_of_very_many_words(spark):
    """More matches than a block of sums takes, and base spans beyond it."""
    many = " ".join(f"a{i}@b.co" for i in range(3000))
    rows = [(1, many + " x"), (2, "é" * 700 + " 1.2.3.4 " + "ü 5.6.7.8 " * 600)]
    got = {r["doc_id"]: r["base"] for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        assert [(s["start"], pii.KINDS[s["kind"]], s["end"]) for s in got[i]] == plain_spans(t)


def test_pii_odd_cases(spark):
    assert pii.report(pii.find(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0
    twice = spark.createDataFrame([(1, "x@y.zz 1.1.1.1"), (1, "x@y.zz 1.1.1.1"), (None, "+1 555 010 99990")], "doc_id bigint, text string")
    assert sorted(r["spans"] for r in pii.report(pii.find(twice)).collect()) == ["email:0:6,ip:7:14", "email:0:6,ip:7:14", "phone:0:16"]
    with pytest.raises(ValueError, match="base"):
        pii.find(twice.withColumn("base", F.lit(1)))


def test_native_plan(spark, sf):
    df = pii.report(pii.find(table(spark, sf, "documents").select("doc_id", "text"), keep_text=False))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


# --- Mixing ---


def plain_targets(docs):
    size = defaultdict(int)
    for d in docs:
        size[d["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(size.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not over:
            return size, target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * size[s] for s in over}
        rest -= sum(target[s] for s in over)
        open_ -= over
    return size, target


def check_mix(spark, docs, df, **options):
    got = mixing.mix(df, **options).collect()
    size, target = plain_targets(docs)
    words = {d["doc_id"]: (len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")), d["source"]) for d in docs}
    taken, longest = defaultdict(int), defaultdict(int)
    assert sorted(r["doc_id"] for r in got) == sorted(words)
    for r in got:
        n, s = words[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, size[s]) and r["target"] == pytest.approx(target[s])
        assert r["taken"] in (0, n, 2 * n)
        taken[s] += r["taken"]
        longest[s] = max(longest[s], n)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in size)
    return sorted(tuple(r) for r in got)


def test_mix_whole_table(spark, sf):
    df = table(spark, sf, "documents")
    docs = documents(spark, sf)
    one = check_mix(spark, docs, df)
    assert one == check_mix(spark, docs, df.repartition(9))
    check_mix(spark, docs, df, shard_rows=3)  # a tree of several levels


def test_mix_odd_cases(spark):
    rows = [(i, "w " * (i % 50), None, ["a", "é", None, "z", ""][i % 5]) for i in range(400)] + [(500, None, None, "only null"), (501, "", None, "z"), (502, "v " * 20000, None, "a")]
    docs = [dict(zip(("doc_id", "text", "lang", "source"), r, strict=True)) for r in rows]
    check_mix(spark, docs, frame(spark, rows), shard_rows=20)
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, None, None, None)])).collect()] == [0]


def test_duels_keep_expectations():
    total, n = Counter(), 2000
    rows = [(i, 1 + i % 7, 0.2 + 0.6 * (i % 3) / 2) for i in range(11)]
    for seed in range(n):
        done, left = mixing.duels(rows, seed)
        assert sum(w * f for _, w, f in rows) == pytest.approx(sum(w * x for _, w, x in done) + (left[1] * left[2] if left else 0))
        for i, _, x in done:
            total[i] += x
        if left:
            total[left[0]] += left[2]
    assert all(total[i] / n == pytest.approx(f, abs=0.04) for i, _, f in rows)


def test_repeated_rows_of_the_mix(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    got = Counter(r["doc_id"] for r in mixing.repeated(df).collect())
    assert got == Counter({i: c for i, c in copies.items() if c})


def test_rows_that_share_an_id_are_mixed_each_on_its_own(spark, monkeypatch):
    schema = "doc_id bigint, text string, lang string, source string, _copies string, `a.b` int"
    rows = [(i % 3 if i % 4 else None, f"t{i % 7} " * (1 + i % 7), None, "ab"[i % 2], "x", i % 2) for i in range(300)]
    rows += [(7, "same words here", None, "a", "x", i % 3) for i in range(200)] + [(None, None, None, "b", None, None)] * 5
    df = spark.createDataFrame(rows, schema)
    key = lambda r: (r["doc_id"], r["source"], r["text"])
    size = lambda r: len((r["text"] or "").split())
    for options in ({}, {"shard_rows": 20}):
        got = mixing.mix(df, **options).collect()
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len((r[1] or "").split())) for r in rows)
        target = {r["source_size"]: r["target"] for r in got}
        for of, t in target.items():
            assert abs(sum(r["taken"] for r in got if r["source_size"] == of) - t) <= 7
        out = mixing.repeated(df, **options).collect()
        assert sum(map(size, out)) == sum(r["taken"] for r in got)
        by_key, held = Counter(map(key, out)), Counter((r[0], r[3], r[1]) for r in rows)
        assert all(by_key[k] <= 2 * held[k] for k in by_key) and {k[2] for k in by_key} <= {r[1] for r in rows}
        each, there = Counter(tuple(r) for r in out), Counter(rows)
        assert all(each[r] <= 2 * there[r] for r in each) and max(there.values()) > 60
    monkeypatch.setattr(mixing, "_RUN", 16)
    again = mixing.mix(df.repartition(5), shard_rows=20).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


# --- Language model ---


class PlainTrie:
    """Prediction by partial matching over Python dictionaries."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for t in texts:
            padded = b"\xff" * ppm.DEPTH + t + b"\xff"
            for i in range(ppm.DEPTH, len(padded)):
                for k in range(ppm.DEPTH + 1):
                    self.seen[padded[i - k : i]][padded[i]] += 1

    def log10(self, context, byte):
        out, gone = 0.0, set()
        for k in range(ppm.DEPTH, -1, -1):
            counts = {b: n for b, n in self.seen.get(context[len(context) - k :], {}).items() if b not in gone}
            if not counts:
                continue
            total = sum(counts.values()) + len(counts)
            if byte in counts:
                return out + math.log10(counts[byte] / total)
            out += math.log10(len(counts) / total)
            gone |= set(counts)
        return out - math.log10(256 - len(gone))

    def score(self, text):
        padded = b"\xff" * ppm.DEPTH + text + b"\xff"
        return sum(self.log10(padded[i - ppm.DEPTH : i], padded[i]) for i in range(ppm.DEPTH, len(padded)))


def low(t):
    return (t or "").encode().lower()


def check_scores(got, docs):
    train = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 10]
    trie, counts = PlainTrie([low(d["text"]) for d in train]), Counter()
    for d in train:
        counts.update([*low(d["text"]).split(), None])
    n, v = sum(counts.values()), len(counts)
    for d in docs:
        r = got[d["doc_id"]]
        tokens = [*low(d["text"]).split(), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(w in counts for w in tokens), n)
        assert r["held_out"] == (d not in train) and r["base_score"] == pytest.approx(base)
        assert r["score"] == pytest.approx(trie.score(low(d["text"])))


def test_scores_match_a_plain_trie(spark, sf):
    docs = sorted(documents(spark, sf), key=lambda d: d["doc_id"])[:40]
    docs += [{"doc_id": 900 + i, "text": t, "lang": None, "source": None} for i, t in enumerate([None, "", "ÀÉ Zz \x0b\x0c y", "new\x00byte", "a" * 3000, "😀 word"])]
    df = frame(spark, [(d["doc_id"], d["text"], None, None) for d in docs])
    check_scores({r["doc_id"]: r for r in ppm.score(df, common=50).collect()}, docs)


def test_what_is_shipped_does_not_change_scores(spark, sf):
    docs = table(spark, sf, "documents")
    whole, part = ({r["doc_id"]: r["score"] for r in ppm.score(docs, **more).collect()} for more in ({}, {"max_nodes": 2000}))
    assert whole.keys() == part.keys() and all(part[i] == pytest.approx(whole[i], rel=1e-6) for i in whole)
    few = sorted(documents(spark, sf), key=lambda d: d["doc_id"])[:20]
    check_scores({r["doc_id"]: r for r in ppm.score(frame(spark, [(d["doc_id"], d["text"], None, None) for d in few]), max_nodes=300).collect()}, few)


def test_a_bounded_trie_still_scores(spark, sf):
    docs = table(spark, sf, "documents")
    rows = ppm.score(docs, max_nodes=2000).collect()
    assert len(rows) == docs.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_lm_odd_cases(spark):
    assert ppm.score(frame(spark, [])).count() == 0
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = ppm.score(frame(spark, [(only_held, "ab", None, None)])).first()
    assert r["score"] == pytest.approx(-3 * math.log10(256)) and r["n_known"] == 0 and r["base_score"] == pytest.approx(0)
    twice = ppm.score(frame(spark, [(1, "a b", None, None), (1, "a b", None, None), (None, "a", None, None)])).collect()
    assert len(twice) == 3 and twice[0]["train_tokens"] == 6


def test_columns_that_clash(spark):
    clash = "doc_id bigint, text string, source string, lang string, size long, target string, score string, key string, row_id int"
    rows = [(i, f"word{i} and more", "s", None, 7, "t", "x", "k", 1) for i in range(30)]
    df = spark.createDataFrame(rows, clash)
    assert {r["size"] for r in mixing.mix(df).collect()} == {3} and mixing.repeated(df).columns == df.columns
    assert all(r["score"] < 0 for r in ppm.score(df).collect())


def test_hash_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    t = ppm.HashTable(keys, keys.astype(float) / 2)
    asked = np.concatenate([keys, rng.integers(0, 1 << 40, 5000)])
    value, absent = t.get(asked)
    assert (absent == ~np.isin(asked, keys)).all() and (value[~absent] == asked[~absent] / 2).all()
