"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into two segments, so of at most three differing bits one segment has at most one. Each segment is indexed
with each of its bits as a wildcard: two fingerprints that differ by at most one bit there share such a variant. Equal
variants are joined and the pairs verified. A variant that holds many fingerprints is never paired at once: they are cut
again by the rest of their bits (again two segments, one wildcard), down to 11 free bits, 2,048 fingerprints at most.

`near_duplicates` links fingerprints of three-word shingles as such. `similar` uses the same variants to propose pairs, by
fingerprints of distinct words, which near copies hardly change, and confirms them by the similarity of their shingles.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import cut, map_rows, scratch, table
from strandlog.llm.graph import components

#: Differing bits that still link.
BITS = 3
SHINGLE = 3
SEED = 42
#: Larger groups of one variant are cut again instead of paired.
PAIRED = 128
_STEP = 1 << 16
#: `similar`: words in a shingle, independent fingerprints (more find more pairs), the similarity that links (4/5), bits of a
#: set's sketch, and the members above which a variant's texts meet its most widely shared one first.
NEAR_SHINGLE, PRINTS, SIMILAR, SKETCH, STAR = 5, 2, (4, 5), 1024, 64


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The majority bits of the shingles' XXH64; zero without a word. Words of bytes, A-Z lower-cased; repeats count."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - size + 1)
    starts = np.concatenate([[0], ends])[:n].tolist()
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):
        hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts[at : at + _STEP], stops[at : at + _STEP], strict=True)], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row, in one narrow pass over whole texts."""

    def make():
        return lambda cols: {"doc_id": cols["doc_id"], "fp": [fingerprint(t, size) for t in cols["text"]]}

    return map_rows(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), make, "doc_id long, fp long")


def _variants(rows: DataFrame, width: int, *keep: str) -> DataFrame:
    """key, fp, rest and the columns `keep` for each wildcard of each half of the last `width` open bits in `rest`."""
    half = width // 2
    mask = (1 << half) - 1
    at = F.col("wild")
    high = at >= half
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % half).cast("int"))
    upper, lower = F.shiftrightunsigned("rest", half).bitwiseAND(F.lit(mask)), F.col("rest").bitwiseAND(F.lit(mask))
    masked = F.when(high, upper).otherwise(lower).bitwiseAND(F.bitwise_not(bit))
    key = F.shiftleft(at.cast("long"), 32).bitwiseOR(masked) if width == 64 else F.xxhash64("key", "wild", masked)
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("wild")).select(key.alias("key"), "fp", F.when(high, lower).otherwise(upper).alias("rest"), *keep)


def _first_variant(x: Column) -> Column:
    """Of all variants that two fingerprints share, the key part (wildcard) of one: so each pair comes up once."""
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))
    place = lambda d: F.when(d == 0, F.lit(0)).otherwise(F.bit_count(d - 1))
    return F.when(F.bit_count(high) <= 1, place(high) + 32).otherwise(place(low))


def _linked(x: Column, key: Column, top: bool) -> Column:
    close = F.bit_count(x) <= BITS
    return close & (F.shiftright(key, 32).cast("int") == _first_variant(x)) if top else close


def links(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """a < b: every pair of the distinct fingerprints `fp` that differs in at most BITS bits, once or more.

    Counting each variant pre-aggregates in the map tasks; groups of two come straight from their smallest and largest
    member, groups up to `paired` from an equi-join on the variant, larger ones are cut again by their open bits.
    """
    # each fingerprint becomes 64 rows, so tasks that adaptive execution has made few are made many again
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows, found, width = fps.select(F.lit(0).cast("long").alias("key"), "fp", F.col("fp").alias("rest")), [], 64
    while True:
        keyed = _variants(rows, width)
        top = width == 64
        groups = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where((F.col("n") > 1) & (F.col("a") < F.col("b"))))
        width //= 2
        most = paired if width > 8 else 1 << 62
        x = F.col("a").bitwiseXOR(F.col("b"))
        found.append(groups.where(F.col("n") == 2).where(_linked(x, F.col("key"), top)).select("a", "b"))
        sizes = groups.agg(F.max("n")).first()[0] or 0
        if sizes > 2:
            # a merge join at every size: what is shuffled stays in proportion to the input
            members = cut(keyed.join(groups.where(F.col("n") > 2).select("key", "n").hint("merge"), "key"))
            some = members.where(F.col("n") <= most)
            left, right = some.select("key", F.col("fp").alias("a")), some.select(F.col("key").alias("other"), F.col("fp").alias("b"))
            close = (F.col("key") == F.col("other")) & (F.col("a") < F.col("b")) & _linked(x, F.col("key"), top)
            found.append(left.join(right, close).select("a", "b"))
        if sizes <= most:
            break
        rows = members.where(F.col("n") > most).select("key", "fp", "rest")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of at most BITS bits).

    Copies share a fingerprint and are counted once in the search, however many there are. Texts without a word
    (null, empty, only white space) have fingerprint zero and link like any other. A null doc_id gives a row too; its
    component_id is the smallest id reachable, null if there is none. Repeated rows each give a row; an empty table
    gives none; other columns are not looked at.
    """
    marked = cut(fingerprints(docs, id_col, text_col, size))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(links(nodes.select("fp")))
    labels = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = labels.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = labels.join(least, "label").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def features(text: str | None, size: int = NEAR_SHINGLE, prints: int = PRINTS) -> dict:
    """key (a hash of the words in order), fps (independent fingerprints of the distinct words), shingles (32-bit hashes of the distinct
    shingles of `size` words; fewer words: the whole sequence; none: no shingle) and sketch (one bit for each shingle's hash mod SKETCH).
    """
    words = text.encode().lower().split() if text else []
    line = b" ".join(words)
    out = {"key": int.from_bytes(xxhash.xxh3_64_digest(line), "big", signed=True)}
    if not words:
        return out | {"fps": [0] * prints, "shingles": [], "sketch": [0] * (SKETCH // 64)}
    distinct, counts = list(set(words)), np.zeros(64 * prints, np.int64)
    for at in range(0, len(distinct), _STEP):
        rows = [b"".join([xxhash.xxh64_digest(w, SEED + k) for k in range(prints)]) for w in distinct[at : at + _STEP]]
        bits = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        counts += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = np.concatenate([[0], ends])[: max(1, len(words) - size + 1)], ends[min(size, len(words)) - 1 :] - 1
    n_distinct, digest = len(distinct), xxhash.xxh32_intdigest
    del words, distinct  # of a long text, each list of objects is many times its bytes
    shingles = np.empty(len(starts), np.uint32)
    for at in range(0, len(starts), _STEP):
        some = zip(starts[at : at + _STEP].tolist(), stops[at : at + _STEP].tolist(), strict=True)
        shingles[at : at + _STEP] = [digest(line[s:e], SEED) for s, e in some]
    shingles = np.unique(shingles)
    sketch = np.zeros(SKETCH, np.uint8)
    sketch[shingles % SKETCH] = 1
    packed = [np.packbits(b).view(">i8").tolist() for b in (counts * 2 > n_distinct, sketch)]
    return out | {"fps": packed[0], "shingles": shingles.view(np.int32), "sketch": packed[1]}


def _alike(common: Column, of_a: Column, of_b: Column) -> Column:
    return (common > 0) & (SIMILAR[1] * common >= SIMILAR[0] * (of_a + of_b - common))


def _within_reach() -> Column:
    """False where the sketches rule out the similarity: each bit of one sketch that the other lacks is a shingle that the other lacks."""
    only = lambda x, y: reduce(Column.__add__, [F.bit_count(x[i].bitwiseAND(F.bitwise_not(y[i]))) for i in range(SKETCH // 64)])
    a, b, n, m = F.col("sketch_a"), F.col("sketch_b"), F.col("size_a"), F.col("size_b")
    sizes = SIMILAR[1] * F.least(n, m) >= SIMILAR[0] * F.greatest(n, m)
    return sizes & _alike(F.least(n - only(a, b), m - only(b, a)), n, m)


def _pairs(left: DataFrame, right: DataFrame, where: Column) -> DataFrame:
    """a, b: members of one variant, each pair from the first variant it shares, that meet `where` and may be similar."""
    a, b = (df.select(*[F.col(c).alias(f"{c}_{end}") for c in df.columns]) for df, end in ((left, "a"), (right, "b")))
    wild = F.shiftright("key_a", 32).bitwiseAND(F.lit(63)).cast("int")
    first = wild == _first_variant(F.col("fp_a").bitwiseXOR(F.col("fp_b")))
    return a.join(b, (F.col("key_a") == F.col("key_b")) & where & first & _within_reach()).select(F.col("text_a").alias("a"), F.col("text_b").alias("b"))


def _confirmed(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs, each once, whose sets of shingles have a Jaccard similarity of at least SIMILAR."""
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    some = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = cut(marked.select("key", "shingles").join(some, "key", "left_semi").groupBy("key").agg(F.any_value("shingles").alias("shingles")))
    a, b = (sets.select(F.col("key").alias(n), F.col("shingles").alias(f"of_{n}")) for n in "ab")
    alike = _alike(F.size(F.array_intersect("of_a", "of_b")), F.size("of_a"), F.size("of_b"))
    return cut(pairs.join(a, "a").join(b, "b").where(alike).select("a", "b"))


def _similar_texts(texts: DataFrame, marked: DataFrame, star: int = STAR) -> DataFrame:
    """node, label: the components of the texts that share a variant of a fingerprint and are similar.

    Variants with up to `star` members are paired, but for pairs that the sketches rule out. In a larger variant all members first
    meet one, that which shares the most variants: the original, among near copies of it. Then only pairs of a member
    outside that one's component with members of other components are left; the sketches are looked at before a pair is made.
    """
    spread = texts.where(F.col("size") > 0).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = spread.select(F.lit(0).cast("long").alias("key"), F.col("key").alias("text"), F.posexplode("fps").alias("print", "fp")).withColumn("rest", F.col("fp"))
    own = F.col("key").bitwiseOR(F.shiftleft(F.col("print").cast("long"), 40))
    at = F.shiftright("key", 32).bitwiseAND(F.lit(63)).cast("int")
    bit = F.call_function("shiftrightunsigned", F.col("fp"), at).bitwiseAND(F.lit(1))
    keyed = _variants(rows, 64, "text", "print").select(own.alias("key"), "text", "fp")
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("text").alias("a"), F.max("text").alias("b"), F.sum(bit).alias("ones"))
    # texts that agree in a whole half share all its variants: the first one is enough, and others count where their bit differs
    differ = (F.col("ones") > 0) & (F.col("ones") < F.col("n"))
    groups = cut(groups.where((F.col("n") > 1) & (differ | (at % 32 == 0))).select("key", "n", "a", "b"))
    found = groups.where(F.col("n") == 2).select("a", "b")
    members = keyed.select("key", "text").join(groups.where(F.col("n") > 2).select("key", "n").hint("merge"), "key")
    members = members.join(texts.select(F.col("key").alias("text"), "fps", "size", "sketch").hint("merge"), "text")
    members = cut(members.withColumn("fp", F.element_at("fps", F.shiftright("key", 40).cast("int") + 1)).drop("fps"))
    few, many = members.where(F.col("n") <= star), members.where(F.col("n") > star)
    found = found.unionByName(_pairs(few, few, F.col("text_a") < F.col("text_b")))
    shared = many.groupBy("text").agg(F.sum("n").alias("shared"))
    centres = cut(many.select("key", "text").join(shared, "text").groupBy("key").agg(F.max(F.struct("shared", "text"))["text"].alias("centre")))
    around = many.select("key", "text").join(centres, "key").where(F.col("text") != F.col("centre")).select(F.col("centre").alias("a"), F.col("text").alias("b"))
    linked = _confirmed(found.unionByName(around), marked)
    label = components(linked)
    if centres.isEmpty():
        return label
    of = lambda n: label.select(F.col("node").alias(n), F.col("label").alias(f"of_{n}"))
    many = many.join(of("text"), "text", "left").withColumn("of_text", F.coalesce("of_text", "text"))
    centres = centres.join(of("centre"), "centre", "left").select("key", F.coalesce("of_centre", "centre").alias("core"))
    many = cut(many.join(centres, "key"))
    outside = many.where(F.col("of_text") != F.col("core"))
    apart = (F.col("of_text_a") != F.col("of_text_b")) & ((F.col("of_text_b") == F.col("core_b")) | (F.col("text_a") < F.col("text_b")))
    return components(linked.unionByName(_confirmed(_pairs(outside, many, apart), marked)))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable): texts link if of one of their PRINTS fingerprints of distinct words one half
    differs in at most one bit and their sets of five-word shingles (as 32-bit hashes) have a Jaccard similarity of 0.8 or more.

    Texts of the same words in the same order (by a 64-bit hash) are one text, however many copies there are; texts without a word
    are one text too and link to no other. Null ids, repeated rows, empty tables and other columns as in `near_duplicates`.
    """
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "similar")

    def make():
        def step(cols):
            got = [features(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"]} | {c: [g[c] for g in got] for c in ("key", "fps", "shingles", "sketch")}

        return step

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    map_rows(rows, make, "doc_id long, key long, fps array<long>, shingles array<int>, sketch array<long>").write.parquet(f"{path}/rows")
    marked = spark.read.parquet(f"{path}/rows")
    # one row per text: its smallest id, and what its copies share
    shared = [F.any_value(c).alias(c) for c in ("fps", "sketch", "size")]
    marked.withColumn("size", F.size("shingles")).groupBy("key").agg(F.min("doc_id").alias("first"), *shared).write.parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    label = _similar_texts(texts, marked)
    labels = texts.join(label, texts["key"] == label["node"], "left").select("key", "first", F.coalesce("label", "key").alias("label"))
    least = labels.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = labels.join(least, "label").select("key", "component_id")
    return marked.select("doc_id", "key").join(classes, "key").select("doc_id", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose doc_id is the smallest of its group of `similar` texts.

    Rows that repeat a kept doc_id are the same document and stay. Rows with a null id can't be told apart: they stay if
    one of them belongs to a group without an id, else all go with the group's first document.
    """
    stay = similar(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(stay, docs[id_col].cast("long").eqNullSafe(stay["_kept_id"]), "left_semi")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
