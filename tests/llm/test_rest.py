"""Sharding, quality rules, URL filters, language ID, weak labels, and the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import common, langid, quality_rules, queries, sharding, urls, weak_quality

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards(documents, texts, shards):
    rows = sharding.assign_shards(documents, shards).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        body = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(body) + 8, zlib.crc32(body), "rows", None)
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == shards


def test_walk_equals_row_by_row(spark):
    """Rows go to the first point at or after theirs, arc by arc, and on clockwise from full shards."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    points = sharding.ring_points(spark, 5, 8, 16)
    rows = sharding.assign_shards(docs, 5, vnodes=8).withColumn("cell", F.shiftrightunsigned(F.xxhash64("doc_id"), 48).cast("int")).collect()
    arc = {r.doc_id: next((i for i, (p, _) in enumerate(points) if p >= r.cell), 0) for r in rows}
    room, where = [600] * 5, {}
    for r in sorted(rows, key=lambda r: (arc[r.doc_id], r.shard)):
        where.setdefault(arc[r.doc_id], Counter())[r.shard] += 1
    for a, n in sorted(Counter(arc.values()).items()):
        want, at = Counter(), a
        for _ in range(n):
            while not room[points[at % len(points)][1]]:
                at += 1
            room[points[at % len(points)][1]] -= 1
            want[points[at % len(points)][1]] += 1
        assert where[a] == want


def test_few_rows_move_with_one_more_shard(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = ({r.doc_id: r.shard for r in sharding.assign_shards(docs, n).collect()} for n in (24, 25))
    assert sum(a[d] != b[d] for d in a) < 2 / 25 * len(a)  # twice what has to move; a plain modulus would move nearly all


def test_shards_odd(odd, empty):
    rows = sharding.assign_shards(odd, 4).collect()
    assert len(rows) == odd.count() and {r.doc_id: r["size"] for r in rows}[1] == 8
    assert sharding.assign_shards(empty, 4).count() == 0


def figures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_measures(spark, documents, texts, odd, empty):
    got = {r.doc_id: tuple(r)[1:7] for r in queries.op7_quality_rules(spark, SF).collect()}
    assert got == {d: figures(t) for d, t in texts.items()}
    rows = quality_rules.measures(odd, stratum_col="lang").collect()
    want = Counter((d, *figures(t)) for d, t in ((r.doc_id, r.text) for r in odd.collect()))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge_quality(empty, labels).count() == 0
    assert quality_rules.judge_quality(odd, labels).where("kept <> (not base_failed)").count() == 0


@pytest.mark.parametrize("n, k, p", [(100, 0, 0.02), (1000, 7, 0.01), (40, 40, 0.5), (3, 1, 0.9)])
def test_binomial(spark, n, k, p):
    got = spark.range(1).select(quality_rules.log_binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    assert math.exp(got) == pytest.approx(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), rel=1e-9)


def test_thresholds_control_risk(spark):
    # good documents have up to 4 % symbols, bad ones 25 %: the strictest cutoff would hurt the good
    rows = [(i, "s", 100, 500, (i % 5 * 5 if i % 2 else 125), 0, 0, False) for i in range(6000)]
    measured = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    labels = measured.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    cut = quality_rules.certified_cutoffs(measured, labels).collect()
    assert [(r.rule, r.cutoff, r.n_false) for r in cut] == [("symbol_share", 0.2, 0)]
    few = quality_rules.certified_cutoffs(measured, labels.where("doc_id < 600")).collect()
    assert few == []  # too few good ones to be sure
    assert quality_rules.apply_rules(measured, quality_rules.certified_cutoffs(measured, labels)).where("kept <> (doc_id % 2 = 1)").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    sf = SF if name.startswith("op1_") else "/root/testdata/sf0.01"
    for table in ("pages", "documents", "benchmark", "labels"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got, want = queries.queries()[name](spark, sf), duckdb.sql(queries.oracle_sql()[name])
    assert got.columns == want.columns
    assert sorted(tuple(map(str, r)) for r in got.collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())


@pytest.mark.parametrize("bits, per_key, slices", [(1 << 27, 8, 1), (1 << 27, 2, 1), (256, 8, 6)])
def test_cascade_is_exact(spark, bits, per_key, slices):
    rows = [(1, None), (2, "x"), (3, "HTTP://A.com/en/x?q"), (4, "a://b://c"), (5, "://"), (None, "h://\n/x\ny#z"), (6, "é://ÀB/Ü"), *((i, f"http://h{i % 400}.net/p{i % 7}") for i in range(10, 900))]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    on_list = lambda key: zlib.crc32(key.encode()) % 5 == 0
    keys = {f"h{i % 400}.net/p{i % 7}" for i in range(10, 900)} | {"", "a.com/en/x", "b:" + "//c", "\n/x\ny", "Àb/Ü"}
    listed = spark.createDataFrame([(k,) for k in sorted(keys) if on_list(k)] + [("of no page",), (None,)], "key string")
    n_listed = listed.count() - 1
    assert urls.slices_for(n_listed, len(keys) - n_listed, per_key, 4, bits) == pytest.approx(slices, abs=1)
    judged = urls.judge_urls(pages, listed, [], max_bits=bits, bits_per_key=per_key)
    got = judged.collect()
    assert len(got) == len(rows) and all((r.verdict == "block") == on_list(r.host + r.path) for r in got)
    by = {r.page_id: (r.host, r.path) for r in got}
    assert [by[i] for i in (1, 2, 3, 4, 5, None, 6)] == [("", ""), ("", ""), ("a.com", "/en/x"), ("b:", "//c"), ("", ""), ("\n", "/x\ny"), ("Àb", "/Ü")]
    assert "Join" not in judged._jdf.queryExecution().executedPlan().toString()
    assert urls.judge_urls(pages.where("false"), listed, []).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, listed.where("false"), []).collect()} == {"allow"}


def test_languages(spark, documents):
    rows = queries.op10_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


FOREIGN = (
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są oni obdarzeni rozumem i sumieniem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van, az emberek ésszel és lelkiismerettel bírnak.",
)


NOISE = ("zxq qzx xqz zqx " * 30, "жщъ щфх цшъ кхц " * 30)


@pytest.mark.parametrize("outliers", [False, True])
def test_foreign_languages_are_rejected(spark, outliers):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    training = docs.select("doc_id", "text", "lang")
    if outliers:  # one text of noise in the sample of each language
        odd = [(10**9 + i, NOISE[0] + f" {lang}", lang) for i, lang in enumerate(("en", "de", "fr", "es"), 1)]
        training = training.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    model = langid.fit_on_documents(training)
    found = model.predict([(t + " ").encode() * 20 for t in (*FOREIGN, *(NOISE[1:] if outliers else NOISE))])
    rows = langid.identify(docs, model).where("held_out AND lang_pred <> 'und'").collect()
    assert all(rejected for _, _, rejected in found)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_languages_of_copies_are_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    german = docs.where("lang = 'de' AND length(text) > 300").orderBy("doc_id").first().text
    rows = docs.where("lang = 'en'").select(F.col("text").cast("binary").alias("text"), "lang")
    for i in range(3):
        copies = spark.range(5000).select(F.lit(f"{german} {'und ' * i}").cast("binary").alias("text"), F.lit("de").alias("lang"))
        assert langid.fit(rows.unionByName(copies), sample=100).languages == ["de", "en"]


def test_cosines_equal_brute_force(spark, documents, texts):
    model = langid.fit_on_documents(documents)
    place = lambda g: (int.from_bytes(g, "big") * 2654435761 % 2**32) >> 19
    for r in langid.identify(documents, model).where("lang_pred <> 'und'").limit(40).collect():
        plain = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + re.sub(rb"[A-Z]", lambda m: m[0].lower(), texts[r.doc_id].encode()) + b" ")
        n = Counter(place(plain[i : i + 3]) for i in range(len(plain) - 2))
        x = {k: math.log1p(c) * float(model.idf[k]) for k, c in n.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        best = max((sum(v * float(c[k]) for k, v in x.items()) / norm, model.languages[o]) for c, o in zip(model.centroids, model.owner))
        assert r.score == pytest.approx(best[0], abs=1e-4) and r.lang_pred == best[1]


def test_languages_odd(documents, odd, empty):
    model = langid.fit_on_documents(documents)
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [got[d].lang_pred for d in (1, 2, 3, 7)] == ["und"] * 4 and got[4].lang_pred in model.languages and got[None].held_out
    assert langid.identify(empty, model).count() == 0
    none = langid.fit_on_documents(empty)
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and not {1, 2, 3, 7} & {r.doc_id for r in kept.collect()}


def test_weak_labels(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    rows = weak_quality.classify(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r.kept for r in rows if (x := labels.get(r.doc_id)) and x.quality and not x.toxic]
    bad = [r.kept for r in rows if (x := labels.get(r.doc_id)) and not x.quality]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert weak_quality.classify(odd).count() == odd.count() and weak_quality.classify(empty).count() == 0


def test_copied_junk_is_learned(spark, documents):
    """Junk texts with a thousand copies each are drawn for training as any other text is."""
    good = documents.where("length(text) > 60 AND text NOT LIKE '%|%'").select("text").distinct().limit(100).withColumn("junk", F.lit(False))
    junk = spark.range(12).select(F.concat(F.repeat(F.concat(F.lit("buy ### $$$ "), "id", F.lit(" ")), 30)).alias("text"), F.lit(True).alias("junk"))
    docs = good.unionByName(junk.crossJoin(spark.range(1000)).drop("id")).withColumn("doc_id", F.monotonically_increasing_id())
    docs.write.parquet(path := common.fresh_path(spark, "copied"))
    docs = spark.read.parquet(path).withColumn("lang", F.lit("en"))
    kept = weak_quality.classify(docs, sample=30).join(docs, "doc_id").groupBy("junk").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()
    by = {r.junk: r for r in kept}
    assert (by[True].n, by[True].kept) == (12_000, 0) and by[False].kept >= 0.9 * by[False].n


def test_scorer_equals_plain_descent(spark, documents, texts):
    """Where all texts are drawn, scores are those of a dense model, trained row by row."""
    shapes = {t: weak_quality.shape_of(t.encode()) for t in texts.values() if t}
    pattern = {t: weak_quality.pattern_of(weak_quality.votes(s)) for t, (s, _) in shapes.items()}
    p_bad = weak_quality.posteriors(Counter(pattern[t] for t in texts.values() if t))
    features, rows = weak_quality.Features(), {}
    for t, (s, words) in shapes.items():
        f = features.of(s, words)
        n = int((f < 256).sum())
        rows[f[:n].tobytes() + np.sort(f[n:])[: weak_quality.ROW_BINS].tobytes()] = p_bad[pattern[t]]
    places = sorted({b for f in rows for b in np.frombuffer(f, np.int32).tolist()})
    column = {b: i for i, b in enumerate(places)}

    def dense(bins):
        x, words = np.zeros(len(places)), max(16, sum(b >= 256 for b in bins))
        for b in bins:
            if b in column:
                x[column[b]] += 4 / words**0.5 if b >= 256 else 1
        return x

    x, y = np.array([dense(np.frombuffer(f, np.int32).tolist()) for f in rows]), np.array(list(rows.values()))
    w, seen = np.zeros(len(places)), np.full(len(places), 1e-6)
    for _ in range(40):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + 1e-4 * w
        seen += g * g
        w -= g / np.sqrt(seen)
    got = weak_quality.classify(documents, sample=10**6).collect()
    for r in got:
        if texts[r.doc_id]:
            z = dense(features.of(*shapes[texts[r.doc_id]]).tolist()) @ w
            assert r.p_bad == pytest.approx(p_bad[pattern[texts[r.doc_id]]], abs=1e-9) and r.score == pytest.approx(1 / (1 + np.exp(z)), abs=1e-6) and r.kept == (r.score >= 0.5)


def test_runs_are_counted_in_varied_texts():
    words = [f"w{i}" for i in range(200)]
    shape, _ = weak_quality.shape_of(" ".join(words[:90] + ["again"] * 40 + words[90:]).encode())
    assert shape.run == 40 and weak_quality.votes(shape)[3] == 0
    assert weak_quality.shape_of(b"a b b c")[0].run == 2 and weak_quality.shape_of(b"")[0].run == 1


def test_posteriors_equal_plain_em(rnd):
    """The same EM, text by text and labeller by labeller."""
    texts = [tuple(rnd.choice((0, 1, 1, 2)) for _ in range(weak_quality.LABELLERS)) for _ in range(300)]
    got = weak_quality.posteriors(Counter(map(weak_quality.pattern_of, texts)), rounds=5)
    bad = [0.95 if 0 in v else 0.05 for v in texts]
    for _ in range(5):
        like = []
        for p in ([1 - b for b in bad], bad):
            share = (sum(p) + 1) / (len(texts) + 2)
            table = [[(sum(w for w, v in zip(p, texts) if v[j] == x) + 0.5) / (sum(p) + 1.5) for x in range(3)] for j in range(weak_quality.LABELLERS)]
            like.append([share * math.prod(table[j][x] for j, x in enumerate(v)) for v in texts])
        bad = [b / (a + b) for a, b in zip(*like)]
    assert all(got[weak_quality.pattern_of(v)] == pytest.approx(b, abs=1e-6) for v, b in zip(texts, bad))


def test_toxic_words_per_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    kept = weak_quality.classify(docs, labels=labels.where(~held)).select("doc_id", "kept")
    rows = kept.join(labels.where(held), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("toxic = 1 OR quality = 1").collect()
    for lang in ("en", "de", "fr", "es"):
        toxic = [not r.kept for r in rows if r.lang == lang and r.toxic]
        clean = [r.kept for r in rows if r.lang == lang and not r.toxic]
        print(lang, sum(toxic), len(toxic), sum(clean), len(clean))
        assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) >= 0.9 * len(clean), lang


def test_toxic_words_of_built_texts(spark):
    # "vorp" tells toxic texts of xx alone; copies are one text, so "qued" has a support of one; null labels tell nothing
    rows = [(i, f"w{i} ba ko " + ("Vorp" if i % 4 == 0 else "lin"), "xx") for i in range(80)] + [(100 + i, "qued ba", "xx") for i in range(9)] + [(200 + i, f"w{i} vorp", "yy") for i in range(80)] + [(300, "vorp", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") != 300, ((F.col("doc_id") % 4 == 0) | F.col("doc_id").between(100, 199)).cast("int")).alias("toxic"))
    assert weak_quality.toxic_words(docs, labels) == {"xx": frozenset({b"vorp"})}
    assert weak_quality.toxic_words(docs, labels.where("false")) == {}


def test_posteriors_find_planted_accuracies(rnd):
    counts = Counter()
    for _ in range(5000):
        bad = rnd.random() < 0.3
        v = [0 if rnd.random() < (0.8 if bad else 0.02) else 1 for _ in range(weak_quality.LABELLERS - 2)] + [2 if rnd.random() < (0.05 if bad else 0.9) else 1 for _ in range(2)]
        counts[weak_quality.pattern_of(tuple(v))] += 1
    p = weak_quality.posteriors(counts)
    assert abs(sum(p[c] * n for c, n in counts.items()) / 5000 - 0.3) < 0.03
