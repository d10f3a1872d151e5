"""Order MinHash fingerprints, by DataFrame functions alone.

A text is a sequence of units (a word of up to 16 signs with up to 8 white-space signs before it). Its k-mers are runs of ``K`` units;
each is numbered by how often the same one came before in the text, so that repeats are k-mers of their own. One hash places the numbered k-mers
on a circle. For each of ``ENTRIES`` evenly spaced points, the ``LENGTH`` k-mers next on the circle are the least ones in the order that
begins there; they are put back in the order of the text, and the hash of that tuple is the entry of the signature. Two texts agree
in an entry only if they share the least k-mers and their order, so that the share of equal entries falls with the edit distance.

All of it is array functions over one row: k-mers are packed with their places into numbers and sorted (equal ones stand together and
are numbered, then sorted again by hash). The text after a text is brought by one join on ids, as the needed beginning only. Rows of one
document are bounded by its text; nothing else is gathered.

Defined cases: a null text is the empty one; it has a fingerprint of zeros, equal to that of other empty texts; with fewer than ``LENGTH``
k-mers an entry repeats the ones there are; a text of fewer than ``K`` units is one k-mer. The order is that of distinct (id, text), null ids
last, equal ids by a hash of the text; repeated rows have the same next text and come back as often as they were given. The only text's next one
is itself. Places count modulo 2^24 units.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import ranked, table, texts
from marquee.session import cut

K = 3
LENGTH = 2
ENTRIES = 64
BITS = ENTRIES.bit_length() - 1
PLACE = 24
UNIT = r"\s{0,8}\S{1,16}|\s{1,8}"


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE) - 1))


def _bucket(x: Column) -> Column:
    """The arc of the circle, from 0, of a packed k-mer."""
    return F.shiftright(x, 64 - BITS) + F.lit(ENTRIES // 2)


def _pack(h: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftright(h, PLACE), PLACE).bitwiseOR(place)


def signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with array ``name`` of ``ENTRIES`` numbers below 2^16; null for a text without units.

    Each step is a projection of its own: an array is made once and then read by position.
    """
    t = [f"_{name}{i}" for i in range(6)]
    c: Callable[[int], Column] = lambda i: F.col(t[i])
    n = F.size(t[0])
    out = df.withColumn(t[0], F.transform(F.regexp_extract_all(F.col(text), F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u)))
    out = out.withColumn(t[1], F.sort_array(F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - K, F.lit(0))),
                    lambda i: _pack(F.xxhash64(*[F.get(c(0), i + j) for j in range(K)]), _place(i.cast("long")))))))
    size = F.size(t[1])
    steps = F.when(size == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), size - 1))
    # where a k-mer begins among the sorted ones, then its repeats numbered from there
    out = out.withColumn(t[2], F.filter(steps, lambda i: (i == 0) | (F.shiftright(F.get(c(1), i), PLACE) != F.shiftright(F.get(c(1), i - 1), PLACE))))
    numbered = F.flatten(F.transform(c(2), lambda start, j: F.transform(
        F.slice(c(1), start + 1, F.coalesce(F.get(c(2), j + 1), size) - start),
        lambda x, o: _pack(F.xxhash64(F.shiftright(x, PLACE), o), _place(x)))))
    out = out.withColumn(t[3], F.sort_array(numbered))
    # for each arc the first k-mer in it or after it
    out = out.withColumn(t[4], F.filter(steps, lambda i: (i == 0) | (_bucket(F.get(c(3), i)) != _bucket(F.get(c(3), i - 1)))))
    last = F.element_at(c(3), -1)
    out = out.withColumn(t[5], F.concat(
        F.flatten(F.transform(c(4), lambda i, j: F.array_repeat(
            i, (_bucket(F.get(c(3), i)) - F.when(j == 0, F.lit(-1)).otherwise(_bucket(F.get(c(3), F.get(c(4), j - 1))))).cast("int")))),
        F.array_repeat(F.lit(0), (F.lit(ENTRIES - 1) - _bucket(last)).cast("int"))))

    def entry(i: Column) -> Column:
        a, b = F.get(c(3), i), F.get(c(3), (i + 1) % size)
        first = F.when(_place(a) <= _place(b), a).otherwise(b)
        second = F.when(_place(a) <= _place(b), b).otherwise(a)
        return F.xxhash64(F.shiftright(first, PLACE), F.shiftright(second, PLACE)).bitwiseAND(F.lit(0xFFFF)).cast("int")

    out = out.withColumn(name, F.when(size > 0, F.transform(c(5), entry)))
    return out.drop(*t)


def packed(sig: Column) -> Column:
    """Two bytes for each entry; zeros for a text without units."""
    return F.coalesce(F.unhex(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 4, "0")), "")), F.unhex(F.lit("0000" * ENTRIES)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries of two packed fingerprints."""
    def entries(x: Column) -> Column:
        return F.regexp_extract_all(F.hex(x), F.lit(".{4}"), F.lit(0))

    return F.aggregate(F.zip_with(entries(a), entries(b), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(ENTRIES))


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``df`` with the packed fingerprint of a text column."""
    return signatures(df, text, name).withColumn(name, packed(F.col(name)))


def neighbours(docs: DataFrame) -> DataFrame:
    """Distinct ``doc_id``, ``x`` (the text's hash), ``n`` (code points) with ``next_id``, ``next_x`` of the next in descending order of ids."""
    keys = docs.select("doc_id", F.xxhash64("text").alias("x"), F.char_length("text").cast("long").alias("n")).groupBy("doc_id", "x").agg(F.max("n").alias("n"))
    order = cut(ranked(keys, F.desc_nulls_last("doc_id"), F.col("x"), name="at"))
    last = order.agg(F.max("at")).first()[0]
    after = order.select(F.col("doc_id").alias("next_id"), F.col("x").alias("next_x"), F.when(F.col("at") == 0, F.lit(last)).otherwise(F.col("at") - 1).alias("at"))
    return order.join(after, "at").drop("at")


def edited(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``n``, ``next_id``, ``next_x`` of each row, and ``edited``: its last third replaced by the beginning of the next text."""
    d = texts(docs).withColumn("x", F.xxhash64("text"))
    pairs = neighbours(texts(docs))
    asked = pairs.select(F.col("doc_id").alias("to_id"), F.col("x").alias("to_x"), F.floor(F.col("n") / 3).cast("int").alias("k"), "next_id", "next_x")
    # every text sends the beginning that is asked for to the row before it, repeated rows once
    sent = (d.join(asked, d["doc_id"].eqNullSafe(asked["next_id"]) & (d["x"] == asked["next_x"]))
            .select("to_id", "to_x", F.substring("text", F.lit(1), F.col("k")).alias("begin")).groupBy("to_id", "to_x").agg(F.max("begin").alias("begin")))
    pairs = pairs.select(F.col("doc_id").alias("own_id"), F.col("x").alias("own_x"), "n", "next_id", "next_x")
    return (d.join(sent, d["doc_id"].eqNullSafe(sent["to_id"]) & (d["x"] == sent["to_x"]))
            .join(pairs, d["doc_id"].eqNullSafe(pairs["own_id"]) & (d["x"] == pairs["own_x"]))
            .select("doc_id", "x", "text", "n", "next_id", "next_x",
                    F.concat(F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 3)).cast("int")), "begin").alias("edited")))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, and how alike they and the next text's are."""
    made = fingerprints(fingerprints(edited(docs), "text", "own"), "edited", "other")
    made = cut(made.select("doc_id", "x", "n", "next_id", "next_x", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("sha"), "own", "other"))
    following = made.select(F.col("doc_id").alias("of_id"), F.col("x").alias("of_x"), F.col("own").alias("following")).groupBy("of_id", "of_x").agg(F.max("following").alias("following"))
    return (made.join(following, made["next_id"].eqNullSafe(following["of_id"]) & (made["next_x"] == following["of_x"]))
            .select("doc_id", F.col("n").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"), F.lower(F.hex("own")).alias("fingerprint"), F.lower(F.hex("other")).alias("edited_fingerprint"),
                    likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(spark, sf_dir, "documents"))
