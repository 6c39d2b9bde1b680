"""Fingerprints of texts as homomorphic multiset hashes of their paragraphs.

A paragraph is a line.  It is hashed to a wide vector; the fingerprint of a text
is the sum of the vectors of its paragraphs, lane by lane modulo a power of two.
So it does not depend on their order, and a paragraph is inserted or deleted by
one addition or subtraction, without the rest of the text.

The vector has two parts.  ``strong`` holds 16 lanes modulo 2**62 of digests of
the whole paragraph: equal sums mean equal multisets.  ``sketch`` holds 240
lanes modulo 2**19, three to a number: the paragraph's phrases (at most six
words, none across the end of a sentence) each count up half of the lanes, by
the bits of their digest.  With the count ``n`` of phrases, a lane gives the sum
of +1 and -1 over phrases, so that products of two sketches estimate how many
phrases two texts share, and ``likeness`` needs the fingerprints alone.

Everything is an expression of Spark's own functions.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import let

#: Digests of a paragraph; each gives four numbers of 64 bits.
DIGESTS = 4
STRONG_MASK = (1 << 62) - 1
#: The 60 used bits of a number are laid out as 20 numbers of three lanes, 20 places apart; the 20th place takes the carry.
SHIFTS = STRIDE = 20
FIELDS = 3
LANE = (1 << (STRIDE - 1)) - 1
ONES = sum(1 << STRIDE * f for f in range(FIELDS))
LANES = ONES * LANE
#: Phrases that fields of four bits can count, and the lowest bits of 15 such fields.
CHUNK = 15
NARROW_ONES = sum(1 << 4 * f for f in range(15))
#: Words of a phrase that does not end earlier, at the end of a sentence.
PHRASE = r"(?:[^ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c.!?][ \t]+){0,5}[^ \t\n\r\x0b\x0c]+"
#: Bytes of text between two splits of the order of documents.
BUCKET_BYTES = 16 * 1024 * 1024


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _numbers(text: Column) -> Column:
    """The digest of ``text`` as four longs."""
    word = lambda digest, k: F.conv(F.substring(digest, 1 + 16 * k, 16), 16, -10).cast("long")
    return let(F.sha2(text.cast("binary"), 256), lambda digest: F.array(*[word(digest, k) for k in range(4)]))


def _strong(paragraphs: Column) -> Column:
    vectors = F.transform(paragraphs, lambda p: F.flatten(F.array(*[_numbers(F.concat(F.lit(f"{k}:"), p)) for k in range(DIGESTS)])))
    zeros = F.array_repeat(_long(0), 4 * DIGESTS)
    masked = lambda x: x.bitwiseAND(_long(STRONG_MASK))
    return F.aggregate(vectors, zeros, lambda total, v: F.zip_with(total, v, lambda a, b: masked(a + masked(b))))


def _sketch(digests: Column) -> Column:
    """Lane counts of the phrases' digests (arrays of four longs).

    Up to 15 phrases are counted in fields of four bits, with four shifts a number; each such
    chunk is then spread over the wide lanes.
    """
    shift = lambda x, by: F.call_function("shiftright", x, by)
    upto = lambda n: F.sequence(F.lit(0), n)
    kth = lambda k: F.transform(digests, lambda d: F.get(d, F.lit(k)))

    def counted(some: Column) -> Column:
        add = lambda by: F.aggregate(some, _long(0), lambda total, h: total + shift(h, by).bitwiseAND(_long(NARROW_ONES)))
        return F.transform(upto(F.lit(3)), add)

    def chunked(words: Column) -> Column:
        starts = F.filter(upto(F.floor(F.size(words) / CHUNK).cast("int")), lambda k: k * CHUNK < F.size(words))
        return F.transform(starts, lambda k: let(F.slice(words, k * CHUNK + 1, F.lit(CHUNK)), counted))

    def spread(chunks: Column) -> Column:
        part = lambda c, at: shift(F.get(c, F.pmod(at, F.lit(4))), at - F.pmod(at, F.lit(4))).bitwiseAND(_long(15 * ONES))
        step = lambda at: F.aggregate(chunks, _long(0), lambda total, c: (total + part(c, at)).bitwiseAND(_long(LANES)))
        return F.transform(upto(F.lit(SHIFTS - 1)), step)

    return F.flatten(F.array(*[let(let(kth(k), chunked), spread) for k in range(4)]))


def fingerprint(text: Column) -> Column:
    """``struct(n, strong, sketch)`` of a text; null counts as empty.

    The empty text has the one empty paragraph.  Lines count with all their white space, also empty ones.
    """

    def made(t: Column) -> Column:
        phrases = F.regexp_extract_all(t, F.lit(PHRASE), F.lit(0))
        sketched = let(F.transform(phrases, _numbers), lambda d: F.struct(F.size(d).cast("long").alias("n"), _sketch(d).alias("sketch")))
        return let(sketched, lambda s: F.struct(s.n.alias("n"), _strong(F.split(t, "\n")).alias("strong"), s.sketch.alias("sketch")))

    return let(F.coalesce(text, F.lit("")), made)


def inserted(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return F.struct(
        (a.n + b.n).alias("n"),
        F.zip_with(a.strong, b.strong, lambda x, y: (x + y).bitwiseAND(_long(STRONG_MASK))).alias("strong"),
        F.zip_with(a.sketch, b.sketch, lambda x, y: (x + y).bitwiseAND(_long(LANES))).alias("sketch"),
    )


def deleted(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``."""
    return F.struct(
        (a.n - b.n).alias("n"),
        F.zip_with(a.strong, b.strong, lambda x, y: (x - y).bitwiseAND(_long(STRONG_MASK))).alias("strong"),
        F.zip_with(a.sketch, b.sketch, lambda x, y: (x + (_long(LANES + ONES) - y)).bitwiseAND(_long(LANES))).alias("sketch"),
    )


def as_text(a: Column) -> Column:
    """A fingerprint in lowercase hex, sixteen digits a number."""
    digits = F.transform(F.concat(F.array(a.n), a.strong, a.sketch), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0"))
    return F.array_join(digits, "")


def _field(number: Column, f: int) -> Column:
    return F.call_function("shiftright", number, F.lit(STRIDE * f)).bitwiseAND(_long(LANE))


def _signed(a: Column) -> Column:
    """Sums of +1 and -1 over phrases, a number per lane."""
    centred = lambda c: (2 * c - a.n + (LANE + 1)).bitwiseAND(_long(2 * LANE + 1)) - (LANE + 1)
    return F.flatten(F.transform(a.sketch, lambda w: F.array(*[centred(_field(w, f)) for f in range(FIELDS)])))


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), _long(0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """Phrases that two fingerprints share, from 0 to 1; 1 for equal ones.

    Twice the product of the sketches over the sum of their squares, below 0 taken as 0.  Lanes
    deviate by about 1 in 16, the square root of their number.  They tell phrases apart that a text
    holds up to 2**19 times.
    """

    def of(x: Column, y: Column) -> Column:
        total = _product(x, x) + _product(y, y)
        ratio = (2 * _product(x, y)).cast("double") / F.when(total > 0, total).cast("double")
        return F.when(ratio.isNull(), 1.0).otherwise(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))

    return let(_signed(a), lambda x: let(_signed(b), lambda y: of(x, y)))


def merged(df: DataFrame, keys: list[str], column: str = "fingerprint") -> DataFrame:
    """One fingerprint per group of ``keys``: that of all paragraphs of its rows together.

    Lanes are summed apart, so a group of any size is pre-aggregated where its rows are.  Null
    keys are a group; null fingerprints count as none.  Other columns go.
    """
    given = F.col(f"`{column}`")
    halves = lambda x: F.array(x.bitwiseAND(_long((1 << 31) - 1)), F.call_function("shiftright", x, F.lit(31)))
    fields = lambda w: F.array(*[_field(w, f) for f in range(FIELDS)])
    parts = F.concat(F.array(given.n), F.flatten(F.transform(given.strong, halves)), F.flatten(F.transform(given.sketch, fields)))
    names = [f"__k{i}" for i in range(len(keys))]
    lanes = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], F.posexplode(parts).alias("__lane", "__x"))
    sums = lanes.groupBy(*names, "__lane").agg(F.sum("__x").alias("__x"))
    rows = sums.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("__lane", "__x"))).alias("__s"))
    strong, sketch = 4 * DIGESTS, 4 * SHIFTS
    at = lambda i: F.get(F.col("__s"), i).getField("__x")
    low = lambda i: at(1 + 2 * i)
    high = lambda i: (at(2 + 2 * i) + F.call_function("shiftright", low(i), F.lit(31))).bitwiseAND(_long((1 << 31) - 1))
    whole = lambda i: F.call_function("shiftleft", high(i), F.lit(31)).bitwiseOR(low(i).bitwiseAND(_long((1 << 31) - 1)))
    field = lambda i, f: F.call_function("shiftleft", at(1 + 2 * strong + FIELDS * i + f).bitwiseAND(_long(LANE)), F.lit(STRIDE * f))
    packed = lambda i: field(i, 0).bitwiseOR(field(i, 1)).bitwiseOR(field(i, 2))
    return rows.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)],
        F.struct(
            at(F.lit(0)).alias("n"),
            F.transform(F.sequence(F.lit(0), F.lit(strong - 1)), whole).alias("strong"),
            F.transform(F.sequence(F.lit(0), F.lit(sketch - 1)), packed).alias("sketch"),
        ).alias(column),
    )


def _key() -> Column:
    return F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"))


def in_order(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, Window]:
    """``doc_id, text`` of all documents in buckets, and a window in which each row's next row follows it.

    The order is by id (nulls first), equal ids by a hash of the text.  Buckets are consecutive
    stretches of that order, of about ``bucket_bytes``; each also holds, marked ``last``, the first row
    of the bucket behind it, and the last bucket that of the first one.  Only one key per bucket
    passes through the driver.
    """
    docs = docs.select("doc_id", "text")
    kind = f"struct<d:{docs.schema['doc_id'].dataType.simpleString()},h:bigint>"
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    keys = docs.select(_key().alias("key")).repartitionByRange(max(1, math.ceil(total / bucket_bytes)), "key")
    # the least key of each range: rows with it exist, so no bucket is empty
    splits = keys.groupBy(F.spark_partition_id().alias("at")).agg(F.min("key").alias("key")).select(F.to_json("key").alias("key"), "at")
    splits = [json.loads(r.key) for r in sorted(splits.collect(), key=lambda r: r["at"])]
    width = math.ceil(math.sqrt(len(splits))) or 1
    leaves = [splits[k : k + width] for k in range(0, len(splits), width)]
    tops = F.from_json(F.lit(json.dumps([x[0] for x in leaves])), f"array<{kind}>")
    inner = F.from_json(F.lit(json.dumps(leaves)), f"array<array<{kind}>>")
    upto = lambda some, key: F.size(F.filter(some, lambda s: s <= key))
    placed = lambda key: let(upto(tops, key) - 1, lambda k: k * width + upto(F.get(inner, k), key) - 1)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), let(_key(), placed).alias("bucket"), F.lit(False).alias("last"))
    # the first rows, each moved to the bucket before its own
    n = max(1, len(splits))
    heads = docs.sparkSession.createDataFrame([(json.dumps(s), k) for k, s in enumerate(splits)], "key string, own int")
    heads = heads.select(F.from_json("key", kind).alias("key"), "own")
    first = rows.join(F.broadcast(heads), F.col("key.d").eqNullSafe(F.col("doc_id")) & (F.col("key.h") == F.col("h")))
    first = first.groupBy("own").agg(F.min(F.struct("doc_id", "h", "text")).alias("r"))
    first = first.select("r.doc_id", "r.text", "r.h", F.pmod(F.col("own") - 1, F.lit(n)).alias("bucket"), F.lit(True).alias("last"))
    # a partition per bucket: hashing the few bucket numbers would put several into one task
    dealt = rows.unionByName(first).repartitionById(n, F.col("bucket"))
    return dealt, Window.partitionBy("bucket").orderBy("last", "doc_id", "h", "text")


def report(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Fingerprint of each document, of its edited text, and their likenesses.

    The edit replaces the last half of the code points by the first as many of the next document's text.
    Null texts count as empty.  Repeated rows each have a row here; the next of the first of them
    is the second.  An empty table gives an empty one.
    """
    rows, window = in_order(docs, bucket_bytes)
    follows = lambda c: F.lead(c).over(window)
    paired = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumns({"next": follows("text"), "n_chars": F.length("text").cast("long")})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), F.left("next", half))
    made = let(edited, lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), fingerprint(e).alias("f")))
    hashed = paired.select("doc_id", "n_chars", "bucket", "last", "h", "text", fingerprint(F.col("text")).alias("f"), F.when(~F.col("last"), made).alias("e"))
    behind = hashed.withColumn("g", follows("f")).where("not last")
    return behind.select(
        "doc_id",
        "n_chars",
        F.col("e.sha").alias("edited_sha256"),
        as_text(F.col("f")).alias("fingerprint"),
        as_text(F.col("e.f")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e.f")).alias("near_edited"),
        likeness(F.col("f"), F.col("g")).alias("near_next"),
    )
