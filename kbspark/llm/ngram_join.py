"""Similarity join of word-shingle sets by partitioned segments.

Sets are grouped in bands of sizes, and each band cuts the universe of shingles
into segments by a hash. A similar pair differs in at most ``reach`` elements, so
with more segments than that it agrees on some of them. A set pays for certainty
in units: trusting a segment to match exactly is worth one, trusting it to match
with at most one element left out on either side (possible for the first
``deep`` segments, whose one-deletion neighbourhoods are indexed) is worth two,
and leaving it out none. Any choice of ``reach + 1`` units finds all similar
sets. Segments that no other set has are free; each set buys what is missing
from its cheapest buckets, and most sets need to buy nothing.

Candidates are verified on the whole sets. As only connected groups are asked
for, a bucket is first tested as a star around its smallest member, and then
only pairs that are still in different components are tested, all of them; so
a large group of near copies costs about a test per member, and no link between
different components is missed.

A bucket of many small components (texts from one template, say) would still be
a test of nearly all its pairs. Such crowded buckets are split further before
pairs are formed: similar sets share one of their rarest elements (in any fixed
order, all but the last few of either can differ), so their members meet again
in buckets of rare elements, again first as stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import HOT_KEYS, among, batch_of, hot_keys, packed, spread_join, stored, utf8, worker_state
from kbspark.llm.graph import components, extended
from kbspark.llm.shingles import Bands, digest, shingle_set

#: Digests of sets that a task remembers in order not to index copies again.
SEEN = 500_000
#: Documents in the sample that looks for very frequent keys and which part of all they are at most, the share and number
#: of them that make a key hot, and into how many parts so many rows are dealt.
HOT_SAMPLE, HOT_PART, HOT_SHARE, HOT_LEAST, SALTS = 1 << 20, 1 / 32, 1 / HOT_KEYS, 50, 4
#: A class of equal sets with more documents, or a HOT_KEYS-th of all, is broadcast to them.
ROW_LIMIT = 1024
#: A bucket is crowded if it has more pairs to test than CROWD times its rows. Rows of a bucket that go to one
#: task, and pairs of a bucket that one task tests.
CROWD, PART_ROWS, PART_PAIRS = 32, 1024, 1 << 16
#: How many rows of a few numbers a row with a sketch, and one with whole sets, counts for.
SKETCH, WHOLE = 4, 128

# a key's meta: size << 34 | band << 28 | segment << 2 | left out << 1 | own band
_META = {"size": (34, 30), "band": (28, 6), "segment": (2, 26), "short": (1, 1), "own": (0, 1)}


def _field(name: str) -> Column:
    shift, bits = _META[name]
    return F.shiftright("meta", shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias(name)


def set_digests(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles and the digest of the shingle set (d1, d2)."""
    schema = "doc_id long, n_shingles long, d1 long, d2 long"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("ngram_join")
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                sets = [shingle_set(t, k) for t in batch.column(1)[i : i + 1024].to_pylist()]
                yield batch_of([(d, len(s), *digest(s)) for d, s in zip(batch.column(0)[i : i + 1024].to_pylist(), sets)], schema)

    return docs.mapInArrow(measure, schema)


def segment_keys(docs: DataFrame, k: int, bands: Bands, deep: int) -> DataFrame:
    """key, doc_id, meta of every set; a task leaves out copies of sets it has had."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("ngram_join")
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                keys, ids, metas = [], [], []
                for doc_id, text in zip(batch.column(0)[i : i + 512].to_pylist(), batch.column(1)[i : i + 512].to_pylist()):
                    s = shingle_set(text, k)
                    if not bands.indexed(len(s)) or (d := digest(s)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(d)
                    own = bands.of_size(len(s))
                    for band in dict.fromkeys([own, *(b for b, _ in bands.probes(len(s)))]):
                        numbers, full, short_of, short = bands.segment_keys(s, band, deep)
                        meta = np.concatenate((numbers << 2, short_of << 2 | 2)) | len(s) << 34 | band << 28 | (band == own)
                        keys += (full, short)
                        metas.append(meta)
                        ids.append(np.full(len(meta), doc_id, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, metas)], names=["key", "doc_id", "meta"])

    return docs.mapInArrow(emit, "key long, doc_id long, meta long")


def _hot_keys(docs: DataFrame, k: int, bands: Bands, deep: int) -> DataFrame:
    """Keys that a sample of documents has very often, and the number of parts for each: at most (keys per document) / HOT_SHARE rows."""
    share = min(HOT_PART, HOT_SAMPLE / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    size = max(1, some.count())
    limit, n = max(HOT_LEAST, HOT_SHARE * size), F.col("count")
    often = packed(segment_keys(some, k, bands, deep).groupBy("key").count(), SKETCH * size)
    return stored(often.where(n >= limit).select("key", F.ceil(SALTS * n / limit).cast("int").alias("salts")), "hot")


def bucketed(docs: DataFrame, k: int, bands: Bands, deep: int) -> tuple[DataFrame, int]:
    """The rows of keys, and how many there are at most, that several sets have, with their buckets' figures: n_full and
    n_short (sets that index the key, whole or with an element left out) and the
    smallest of either. Hot keys are dealt to parts, the more the more sets have
    them, and their figures, few rows, broadcast."""
    hot = _hot_keys(docs, k, bands, deep)
    short, own = F.shiftright("meta", 1).bitwiseAND(F.lit(1)) == 1, F.col("meta").bitwiseAND(F.lit(1)) == 1
    member = F.struct(F.col("doc_id").alias("doc_id"), F.shiftright("meta", 34).alias("size"))
    figures = {"n": F.count("*"), "n_full": F.count_if(own & ~short), "n_short": F.count_if(own & short), "least_full": F.min(F.when(own & ~short, member)), "least_short": F.min(F.when(own & short, member))}
    keys = segment_keys(docs, k, bands, deep).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.col("salts"))).otherwise(0)).drop("salts")
    bucket = Window.partitionBy("key", "salt")
    rows = keys.select("*", *(f.over(bucket).alias(n) for n, f in figures.items())).where("hot or n > 1")
    rows = stored(rows.drop("salt"), "buckets")
    most = rows.count()
    whole = F.broadcast(packed(rows.where("hot"), most).groupBy("key").agg(*(f.alias("all_" + n) for n, f in figures.items())))
    rows = rows.join(whole, "key", "left").select("key", "doc_id", *map(_field, _META), *(F.when(F.col("hot"), F.col("all_" + n)).otherwise(F.col(n)).alias(n) for n in figures))
    return packed(rows.where("n > 1 and n_full + n_short > 0"), most), most


def parts_of(n: Column) -> Column:
    """Into how many parts a bucket of ``n`` rows is dealt."""
    return F.ceil(n / PART_ROWS).cast("int").alias("parts")


def dealt(df: DataFrame, by: str) -> DataFrame:
    """Add part: each row goes to one of the ``parts`` of its bucket."""
    return df.withColumn("part", F.pmod(F.xxhash64(by), F.col("parts")).cast("int"))


def copied(df: DataFrame) -> DataFrame:
    """Each row once for every part of its bucket, as part."""
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def probes(rows: DataFrame, most: int, bands: Bands, deep: int) -> DataFrame:
    """What each set of ``rows`` (``most`` at most) has to look up: key, side (whether sets are to have the key
    as a ``short`` one), doc_id, band, centre (the smallest such set), parts (into
    which the bucket is dealt)."""
    top = 52  # beyond the 30 bits of a size
    least = [bands.upper(b) for b in range(top)]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("band") + 1)
    ties = pick([bands.segments(b) for b in range(top)])
    total = F.col("size").cast("long") + F.least(F.col("size"), pick(least))
    needed = F.floor((bands.den - bands.num) * total / F.lit(bands.den + bands.num)).cast("long") + 1
    others = F.col("n_full") - F.col("own")
    whole = rows.where((F.col("short") == 0) & (others > 0)).select(
        "doc_id", "band", "size", "segment", F.lit(0).alias("unit"), others.alias("cost"), F.array(F.struct("key", F.lit(False).alias("side"), F.col("least_full.doc_id").alias("centre"), parts_of(F.col("n_full")))).alias("look"))
    more = F.when(F.col("short") == 1, F.col("n_full")).otherwise(F.col("n_short"))
    # the second unit of a segment counts only with the first, so it costs at least as much and is never free alone
    near = rows.where((F.col("segment") < deep) & ((more > 0) | ((F.col("short") == 0) & (others > 0))))
    found = F.when(F.col("short") == 1, F.struct(F.col("least_full.doc_id").alias("centre"), F.col("n_full").alias("n"))).otherwise(F.struct(F.col("least_short.doc_id").alias("centre"), F.col("n_short").alias("n")))
    look = F.when(more > 0, F.struct("key", (F.col("short") == 0).alias("side"), found["centre"].alias("centre"), parts_of(found["n"])))
    close = packed(near.groupBy("doc_id", "band", "size", "segment").agg(F.sum(more + F.when(F.col("short") == 0, others).otherwise(0)).alias("cost"), F.collect_list(look).alias("look")), most)
    close = close.select("doc_id", "band", "size", "segment", F.lit(1).alias("unit"), "cost", "look")
    units = Window.partitionBy("doc_id", "band")
    chosen = packed(packed(whole.unionByName(close), most).select(
        "*", (needed - (ties + deep - F.count("*").over(units))).alias("missing"), F.row_number().over(units.orderBy("cost", "unit", "segment")).alias("rank")), most).where("rank <= missing")
    return chosen.select("doc_id", "band", F.explode("look").alias("l")).select("l.key", "l.side", "doc_id", "band", F.col("l.centre").alias("centre"), "l.parts")


def candidate_sets(texts: DataFrame, k: int, bands: Bands) -> DataFrame:
    """doc_id, band, size, sketch, and on the row of its own band also the set, of each document (doc_id, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                out = []
                for doc_id, text in zip(batch.column(0)[i : i + 512].to_pylist(), batch.column(1)[i : i + 512].to_pylist()):
                    s = shingle_set(text, k)
                    own = bands.of_size(len(s))
                    for band in dict.fromkeys([own, *(b for b, _ in bands.probes(len(s)))]):
                        out.append((doc_id, band, len(s), bands.sketch(s, band).tolist(), s.tobytes() if band == own else None))
                columns = list(zip(*out)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "band", "size", "sketch", "items"])

    return texts.mapInArrow(emit, "doc_id long, band int, size long, sketch array<long>, items binary")


def may_fit(bands: Bands, size_a: str, sketch_a: str, size_b: str, sketch_b: str) -> Column:
    """Whether sizes and sketches leave it open that two sets are similar."""
    total = F.col(size_a) + F.col(size_b)
    differ = F.aggregate(F.zip_with(sketch_a, sketch_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return (F.least(size_a, size_b) * bands.den >= F.greatest(size_a, size_b) * bands.num) & (differ * (bands.den + bands.num) <= total * (bands.den - bands.num))


def similar_pairs(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b; a stored table) whose sets are similar. Sets travel to the
    pairs; those of a document with very many pairs to several tasks."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if bands.den * both >= bands.num * (len(x) + len(y) - both) > 0:
                    out.append((a, b))
            yield batch_of(out, "a long, b long")

    n = pairs.count()
    if not n:
        return pairs.select("a", "b")
    pairs = packed(pairs, n)
    whole = sets.where("items is not null").select("doc_id", "items")
    hot_a, hot_b = hot_keys(pairs, ["a"]), hot_keys(pairs, ["b"])
    with_b = spread_join(pairs, among(whole, "doc_id", pairs, "b").select(F.col("doc_id").alias("b"), F.col("items").alias("items_b")), ["b"], hot_b, "a")
    with_b = packed(with_b, WHOLE * n)
    with_a = spread_join(with_b, among(whole, "doc_id", pairs, "a").select(F.col("doc_id").alias("a"), F.col("items").alias("items_a")), ["a"], hot_a, "b")
    return packed(packed(with_a, WHOLE * n).select("a", "b", "items_a", "items_b").mapInArrow(test, "a long, b long"), n).distinct()


def _ordered(p: str, q: str) -> tuple[Column, Column]:
    return F.least(p, q).alias("a"), F.greatest(p, q).alias("b")


def _sketched(sketches: DataFrame, p: str) -> DataFrame:
    return sketches.select(F.col("doc_id").alias(p), "band", F.col("size").alias(p + "_size"), F.col("sketch").alias(p + "_sketch"))


def star_pairs(look: DataFrame, most: int, names: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) of ``look`` (doc_id, band, centre; ``most`` rows at most) that sizes and
    sketches leave open; ``names`` (member, rep) tells whose set a centre has."""
    star = stored(packed(packed(look.select(F.col("doc_id").alias("p"), "band", "centre"), most).distinct(), most), "stars")
    n = star.count()
    centres = packed(packed(star, n).select("centre", "band").distinct().join(names, F.col("centre") == F.col("member")).select("centre", "band", F.col("rep").alias("q")), n)
    centres = packed(centres.join(_sketched(sketches, "q"), ["q", "band"]), SKETCH * n)
    met = packed(spread_join(packed(star, n), centres, ["centre", "band"], hot_keys(star, ["centre", "band"]), "p").where("p <> q"), SKETCH * n)
    met = packed(met.join(_sketched(sketches, "p"), ["p", "band"]), SKETCH * n)
    return stored(packed(met.where(may_fit(bands, "p_size", "p_sketch", "q_size", "q_sketch")).select(*_ordered("p", "q")).distinct(), n), "star")


def mixed_buckets(ask: DataFrame, have: DataFrame, on: list[str]) -> DataFrame:
    """The buckets of several components: main (the largest), parts, n (rows), pairs
    (to be tested: whoever isn't of the main component meets all others)."""
    one = lambda df, a, h: df.select(*on, "doc_id", "comp", "parts", F.lit(a).alias("a"), F.lit(h).alias("h"))
    rows = ask.count() + have.count()
    both = packed(one(ask, 1, 0).unionByName(one(have, 0, 1)), rows)
    odd = both.groupBy(on).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("parts").alias("parts")).where("lo < hi").select(*on, "parts")
    odd = stored(packed(odd, rows), "odd")
    some = packed(dealt(among(both, on[0], odd, on[0], rows), "doc_id").join(packed(copied(odd).drop("parts"), rows), [*on, "part"], "left_semi"), rows)
    counted = packed(some.groupBy(*on, "comp").agg(F.sum("a").alias("a"), F.sum("h").alias("h"), F.max("parts").alias("parts")), rows)
    largest = F.max(F.struct((F.col("a") + F.col("h")).alias("n"), "comp", "a", "h")).alias("m")
    all_ = counted.groupBy(on).agg(largest, F.sum("a").alias("a"), F.sum("h").alias("h"), F.max("parts").alias("parts"))
    return packed(all_, rows).select(*on, "parts", F.col("m.comp").alias("main"), (F.col("a") + F.col("h")).alias("n"), ((F.col("a") - F.col("m.a")) * F.col("h") + F.col("m.a") * (F.col("h") - F.col("m.h"))).alias("pairs")).where("pairs > 0")


def meetings(ask: DataFrame, have: DataFrame, mixed: DataFrame, on: list[str], sketches: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) of different components in the buckets ``mixed`` that sizes and
    sketches leave open. The larger side of a bucket's pairs is dealt to parts."""
    rows, work = (x or 0 for x in mixed.agg(F.sum("n"), F.sum("pairs")).first())
    if not work:
        return mixed.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).where("false")
    work = max(work, SKETCH * rows)
    buckets = copied(packed(mixed, rows)).select(*on, "part", "main", F.ceil(F.col("pairs") / PART_PAIRS).cast("int").alias("pair_parts"))

    def side(df: DataFrame, p: str) -> DataFrame:
        n = df.count()
        met = packed(dealt(among(packed(df, n), on[0], mixed, on[0], n), "doc_id").join(buckets, [*on, "part"]), rows).withColumnsRenamed({"doc_id": p, "comp": p + "_comp"})
        return stored(packed(met.join(_sketched(sketches, p), [p, "band"]), SKETCH * rows).drop("parts", "part").withColumnRenamed("pair_parts", "parts"), p)

    left, right = side(ask, "p"), side(have, "q")
    open_ = (F.col("p_comp") != F.col("q_comp")) & (F.col("q_size") <= F.col("p_size")) & may_fit(bands, "p_size", "p_sketch", "q_size", "q_sketch")

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        same = (F.col("l.part") == F.col("r.part")) & (F.col("l.band") == F.col("r.band"))
        for c in on:
            same = same & (F.col("l." + c) == F.col("r." + c))
        return packed(packed(x, work).alias("l").join(packed(y, work).alias("r"), same & open_).select(*_ordered("p", "q")), work)

    minor = met(copied(left.where("p_comp <> main")), dealt(right, "q"))
    major = met(dealt(left.where("p_comp = main"), "p"), copied(right.where("q_comp <> main")))
    return packed(packed(minor.unionByName(major), work).distinct(), work)


def rare_elements(sets: DataFrame, bands: Bands) -> DataFrame:
    """doc_id, x, parts, in_have of the rarest elements of each set (``items``), as far as others have them.

    They are as many as a similar set that is no larger can lack, and one more;
    ``in_have`` are as many as a similar one that is no smaller can lack, and one
    more. So two similar sets share one that is ``in_have`` of the smaller.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                ids, items = (c[i : i + 512].to_pylist() for c in batch.columns)
                each = [np.frombuffer(x, np.int64) for x in items]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), [len(x) for x in each])), pa.array(np.concatenate(each))], names=["doc_id", "x"])

    most = sets.agg(F.sum(F.octet_length("items"))).first()[0] or 0
    most //= 8
    elements = packed(sets.select("doc_id", "items"), most).mapInArrow(explode, "doc_id long, x long")
    often = stored(packed(elements.groupBy("x").agg(F.count("*").alias("n")).where("n > 1"), most), "often")
    total = often.agg(F.sum("n")).first()[0] or 0
    limit = max(PART_ROWS, total // HOT_KEYS)
    hot, rest = F.broadcast(often.where(F.col("n") > limit)), often.where(F.col("n") <= limit)  # HOT_KEYS rows at most
    counted = elements.join(hot, "x").unionByName(elements.join(hot, "x", "left_anti").join(rest, "x", "left").na.fill(1, ["n"]))
    rows = packed(packed(counted, most).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("e")), most).withColumn("size", F.size("e"))  # a document's own elements
    num, den, size = bands.num, bands.den, F.col("size")
    ask = size - F.ceil(size * num / F.lit(den)) + 1
    have = size - F.ceil(size * (2 * num) / F.lit(num + den)) + 1
    rows = rows.select("doc_id", have.cast("int").alias("short"), F.posexplode(F.slice("e", F.lit(1), ask.cast("int"))).alias("at", "e"))
    return rows.where("e.n > 1").select("doc_id", "e.x", parts_of(F.col("e.n")), (F.col("at") < F.col("short")).alias("in_have"))


def ngram_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, deep: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Documents are linked if their sets of ``k``-word shingles have a Jaccard
    similarity of at least num / den; component_id is the smallest id that links
    reach. Documents without words (null, empty) have no shingles and no links.
    Rows of one id are one document, linked by what any of them is linked by; a
    row with a null id is linked with nothing and has a null component_id. An
    empty table gives no rows; further columns are left out.
    """
    bands = Bands(num, den)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    known = rows.where(F.col("doc_id").isNotNull())
    info = stored(set_digests(rows, k), "sets")
    n_docs = info.count()
    info = packed(info, n_docs)
    classes = info.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    large = F.broadcast(classes.where(F.col("n") > max(ROW_LIMIT, n_docs // HOT_KEYS)).select("d1", "d2", F.col("rep").alias("of")))  # HOT_KEYS rows at most
    marked = info.join(large, ["d1", "d2"], "left")
    rest = marked.where("of is null").join(classes.select("d1", "d2", "rep"), ["d1", "d2"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    info = packed(stored(packed(rest.unionByName(marked.where("of is not null").select("doc_id", "n_shingles", F.col("of").alias("rep"))), n_docs), "classes"), n_docs)
    # a document stands for its class of equal sets; one with several texts for itself alone, linked with their classes
    rep_of = packed(info.where("doc_id is not null").groupBy("doc_id").agg(F.when(F.min("rep") == F.max("rep"), F.min("rep")).otherwise(F.col("doc_id")).alias("rep")), n_docs)
    one_id = stored(packed(info.join(rep_of.withColumnRenamed("rep", "b"), "doc_id"), n_docs).where("rep <> b").select(F.col("rep").alias("a"), "b"), "one_id")

    buckets, n_keys = bucketed(known, k, bands, deep)
    look = stored(probes(buckets, n_keys, bands, deep), "probes")
    n_look = look.count()
    look = packed(look, n_look)
    member = rep_of.select(F.col("doc_id").alias("member"), "rep")

    def by_rep(df: DataFrame, most: int) -> DataFrame:
        own = packed(df.join(member, F.col("doc_id") == F.col("member")), most).drop("member", "doc_id").withColumnRenamed("rep", "doc_id")
        return packed(own.distinct(), most)

    # the sets and sketches of whoever may be tested: those that look up, and those that are found
    index = buckets.where("own = 1").select("key", (F.col("short") == 1).alias("side"), "doc_id", "band", parts_of(F.when(F.col("short") == 1, F.col("n_short")).otherwise(F.col("n_full"))))
    asked = copied(look.select("key", "side", "parts").distinct()).drop("parts")
    index = packed(dealt(among(index, "key", look, "key", n_keys), "doc_id").join(asked, ["key", "side", "part"], "left_semi"), n_keys).drop("part")
    index = stored(by_rep(index, n_keys), "index")
    look = stored(by_rep(look, n_look), "look")
    n_index, n_look = index.count(), look.count()
    index, look = packed(index, n_index), packed(look, n_look)
    names = packed(look.select(F.col("centre").alias("member")).distinct().join(member, "member"), n_look)
    each = [index.select("doc_id").distinct(), look.select("doc_id").distinct(), names.select(F.col("rep").alias("doc_id"))]
    tested = stored(packed(packed(each[0].unionByName(each[1]).unionByName(each[2]), n_docs).distinct(), n_docs), "tested")
    sets = stored(candidate_sets(among(known, "doc_id", tested, "doc_id").join(tested, "doc_id", "left_semi"), k, bands), "candidates")
    sketches = packed(sets.select("doc_id", "band", "size", "sketch"), SKETCH * sets.count())

    star = star_pairs(look, n_look, names, sketches, bands)
    linked = stored(similar_pairs(star, sets, bands), "links")
    done = star

    def labelled(df: DataFrame, most: int, label: DataFrame) -> DataFrame:
        return packed(df.join(label, F.col("doc_id") == F.col("node"), "left"), most).withColumn("comp", F.coalesce("component", "doc_id")).drop("node", "component")

    on, label = ["key", "side"], components(linked)
    ask, have = stored(labelled(look.drop("centre"), n_look, label), "ask"), stored(labelled(index, n_index, label), "have")
    mixed = stored(mixed_buckets(ask, have, on), "mixed")
    plain, crowded = mixed.where(F.col("pairs") <= CROWD * F.col("n")), mixed.where(F.col("pairs") > CROWD * F.col("n"))
    cross = meetings(ask, have, plain, on, sketches, bands)
    if not crowded.isEmpty():
        full = packed(copied(crowded.select(*on, "parts")).drop("parts"), n_look + n_index)

        def within(df: DataFrame, most: int) -> DataFrame:
            some = dealt(among(packed(df, most), "key", crowded, "key", most), "doc_id").join(full, [*on, "part"], "left_semi")
            return packed(packed(some.select("doc_id", "band"), most).distinct(), most)

        asking, having = stored(within(ask, n_look), "asking"), stored(within(have, n_index), "having")
        some = packed(asking.unionByName(having).select("doc_id"), 2 * sets.count()).distinct()
        rare = stored(rare_elements(stored(sets.where("items is not null").select("doc_id", "items").join(some, "doc_id", "left_semi"), "crowded"), bands), "rare")
        n_rare = rare.count()
        rare = packed(rare, n_rare)
        on = ["x", "band"]
        n_bands = 4  # about as many a set is asked for in; only the number of tasks depends on it
        ask, have = (stored(packed(packed(df, n_rare).join(r, "doc_id").drop("in_have"), n_bands * n_rare), "met") for df, r in ((asking, rare), (having, rare.where("in_have"))))
        n_ask, n_have = ask.count(), have.count()
        ask, have = packed(ask, n_ask), packed(have, n_have)
        least = have.groupBy(on).agg(F.min("doc_id").alias("centre"), F.max("parts").alias("parts"))
        again = packed(dealt(ask, "doc_id").join(packed(copied(least).drop("parts"), n_have), [*on, "part"]), n_ask)
        own = packed(again.select(F.col("centre").alias("member"), F.col("centre").alias("rep")).distinct(), n_ask)
        more = star_pairs(again, n_ask, own, sketches, bands)
        n_star = more.count() + star.count()
        more = stored(packed(packed(more, n_star).join(packed(done, n_star), ["a", "b"], "left_anti"), n_star), "star")
        label, done = extended(label, stored(similar_pairs(more, sets, bands), "links")), done.unionByName(more)
        ask, have = stored(labelled(ask, n_ask, label), "ask"), stored(labelled(have, n_have, label), "have")
        cross = cross.unionByName(meetings(ask, have, stored(mixed_buckets(ask, have, on), "mixed"), on, sketches, bands)).distinct()
    cross = stored(cross, "cross")
    n_cross = cross.count() + done.count()
    cross = stored(packed(packed(cross, n_cross).join(packed(done, n_cross), ["a", "b"], "left_anti"), n_cross), "cross")
    late = stored(similar_pairs(cross, sets, bands), "links")

    final = extended(label, late.unionByName(one_id))
    return packed(info.join(final, F.col("rep") == F.col("node"), "left"), n_docs).select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all their columns, without all but the smallest id of each
    group of linked documents; rows without an id or without words stay."""
    found = ngram_components(docs, k, num, den, id_col=id_col, text_col=text_col)
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__kb_id")).distinct(), "gone")
    return docs.join(gone, F.col(id_col) == F.col("__kb_id"), "left_anti")
