"""Document fingerprints from closed syncmers over code points. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Code points of a k-mer, and of the inner substrings whose least one must lie at an edge.
K, S = 12, 4


#: Cuts looked through at a time where a document's range is sought, and the place of a null id.
FAN, NO_ID = 64, -(2**63)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once a row."""
    return F.get(F.transform(F.array(value), body), 0)


def _kmers(text: Column, shift: Column | int = 0) -> Column:
    """Closed syncmers of a text, as ``placed``, with ``shift`` added to each place; none in fewer than K code points."""

    def chosen(points: Column) -> Column:
        # Four bytes a code point, so that a piece is cut out in constant time.
        piece = lambda i, k: F.xxhash64(F.substring(points, 4 * i + 1, 4 * k))

        def of(g: Column) -> Column:
            def at(x: Column, i: Column) -> Column:
                inner = [F.get(g, i + j) for j in range(1, K - S)]
                last = F.get(g, i + (K - S))  # null past the end, and so is what follows
                first_least, last_least = x <= last, last <= x
                for y in inner:
                    first_least &= x <= y
                for y in reversed(inner):
                    last_least &= last <= y
                return F.when(first_least | last_least, F.shiftleft(piece(i, K), 32).bitwiseOR((i + shift).cast("long")))

            return F.array_compact(F.transform(g, at))

        return _let(F.transform(F.sequence(F.lit(0), F.floor(F.octet_length(points) / 4).cast("int") - S), lambda i: piece(i, S)), of)

    return F.when(F.length(text) >= K, _let(F.encode(text, "UTF-32"), chosen)).otherwise(F.array().cast("array<bigint>"))


def _whole(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.array(F.shiftleft(F.xxhash64(text), 32))).otherwise(F.array().cast("array<bigint>"))


def placed(text: Column) -> Column:
    """A whole text's closed syncmers in order, with repeats: hash in the upper 32 bits, code point where it starts in the lower.

    A k-mer of 12 code points is chosen if the least hash of its 9 inner substrings of 4 is the first or the last: the
    choice depends on those 12 code points alone, and of any 8 k-mers in a row one at least is chosen. A text of fewer
    code points than a k-mer is one anchor; an empty one has none.
    """
    return F.when(F.length(text) >= K, _kmers(text)).otherwise(_whole(text))


def _at(v: Column) -> Column:
    """Where an anchor starts."""
    return v.bitwiseAND(0xFFFFFFFF)


def joined_parts(joined: Column, left: Column, taken: Column, left_placed: Column, right_placed: Column) -> tuple[Column, Column, Column]:
    """Anchors of ``joined``, the first ``left`` code points of a text and the first ``taken`` of another, both placed already.

    As anchors are free of context, those within either part are known: the first array's stand, the third's move on by
    ``left``. Only k-mers across the seam are looked at, for the second.
    """
    before = F.least(left, F.lit(K - 1))
    seam = F.substring(joined, left - before + 1, before + F.least(taken, F.lit(K - 1)))
    return F.filter(left_placed, lambda v: _at(v) <= left - K), _kmers(seam, left - before), F.filter(right_placed, lambda v: _at(v) <= taken - K)


def anchors(text: Column) -> Column:
    """Hashes of a whole text's closed syncmers, with repeats."""
    return F.transform(placed(text), lambda v: F.shiftright(v, 32).cast("int"))


def anchor_set(p: Column) -> Column:
    """Distinct hashes of ``placed`` anchors."""
    return F.array_distinct(F.transform(p, lambda v: F.shiftright(v, 32).cast("int")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two anchor sets, 0 to 1; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return _let(both, lambda n: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(n / (F.size(a) + F.size(b) - n))).cast("double")


def _hex(p: Column, start: Column | int = 0) -> Column:
    """8 digits of each anchor's hash and one of its distance from the one before (the first: from ``start``), K - S at most."""

    def digits(v: Column, i: Column) -> Column:
        step = _at(v) - F.coalesce(_at(F.get(p, i - 1)), F.lit(start) if isinstance(start, int) else start)
        return F.lpad(F.hex(F.shiftleft(F.shiftrightunsigned(v, 32), 4).bitwiseOR(step.cast("long"))), 9, "0")

    return F.lower(F.array_join(F.transform(p, digits), ""))


def _below(cuts: list[int], x: Column) -> Column:
    """How many of the ascending ``cuts`` are less than ``x``, looking through FAN of them at a time."""
    if not cuts:
        return F.lit(0)
    if len(cuts) <= FAN:
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < x))
    rest = F.array(*[F.array(*map(F.lit, cuts[i : i + FAN])) for i in range(0, len(cuts), FAN)])
    coarse = _below(cuts[FAN - 1 :: FAN], x)
    return _let(coarse, lambda j: j * FAN + F.coalesce(F.size(F.filter(F.get(rest, j), lambda c: c < x)), F.lit(0)))


def ranges(spark: SparkSession, d: DataFrame) -> Column:
    """The range of a document of ``d`` (id, th), ascending by (id, th): some for each shuffle partition, about equal.

    An id that fills several ranges by itself is dealt to as many by th, a hash.
    """
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = d.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    some = sorted(set(cuts))
    often = {i: m for i, c in enumerate(some) if (m := cuts.count(c)) > 1}
    part = F.col("th").cast("double") / 2.0**64 + 0.5  # th from 0 to 1
    j = _below(some, F.col("id"))
    if not often:
        return j.cast("long") * (n + 1)
    hot = F.element_at(F.create_map(*[F.lit(x) for i, m in often.items() for x in (some[i], m)]), F.col("id"))
    return j.cast("long") * (n + 1) + F.coalesce(1 + F.least(F.floor(part * hot), hot - 1), F.lit(0))


def with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text, sk, set, fp and the same of the next one as next_...: documents by (doc_id, text hash), after the last the first.

    Documents are dealt to ``ranges`` and shuffled once; a window in a range finds the next one. A small table of each
    range's first document, one row a range, says which ones bridge ranges.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("th", F.xxhash64("text"))
    d = d.withColumn("b", ranges(spark, d))
    firsts = d.groupBy("b").agg(F.min(F.struct("id", "th")).alias("f")).orderBy("b").collect()  # a few rows a shuffle partition
    before = [(r["f"]["id"], r["f"]["th"], p["b"], r["b"]) for p, r in zip(firsts[-1:] + firsts[:-1], firsts, strict=True)]
    heads = spark.createDataFrame(before, "hid long, hth long, pb long, hb long")
    # The first document of a range goes to the range before as well, behind its rows: one shuffle serves both.
    d = d.join(F.broadcast(heads), (F.col("b") == F.col("hb")) & (F.col("id") == F.col("hid")) & (F.col("th") == F.col("hth")), "left")
    own = F.struct(F.col("b").alias("to"), F.lit(0).alias("extra"))
    both = F.when(F.col("pb").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("pb").alias("to"), F.lit(1).alias("extra"))))
    dealt = d.select("doc_id", "id", "th", "text", F.explode(both).alias("g")).select("doc_id", "id", "th", "text", "g.to", "g.extra")
    # Anchors are found after the shuffle, which then carries texts alone.
    dealt = dealt.repartition("to").withColumn("sk", placed(F.col("text"))).withColumn("set", anchor_set(F.col("sk"))).withColumn("fp", _hex(F.col("sk")))
    w = Window.partitionBy("to").orderBy("extra", "id", "th")
    out = dealt.withColumn("after", F.lead(F.struct("text", "sk", "set", "fp")).over(w)).where("extra = 0")
    return out.select("doc_id", "text", "sk", "set", "fp", *[F.col(f"after.{c}").alias(f"next_{c}") for c in ("text", "sk", "set", "fp")])


def fingerprint_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document.

    The edited text has its last quarter (code points, rounded down) replaced by the start of the next document. A null
    text counts as empty; two empty texts have equal, empty fingerprints of likeness 1. A fingerprint holds every
    anchor of the text with its position, so it grows with the text and equal texts have equal ones. Repeated rows, also
    those of one or of a null doc_id (which comes first), follow each other in the order of their texts' hashes. One
    document is its own next; an empty table gives an empty result.
    """
    d = with_next(spark, docs)
    k = F.floor(F.length("text") / 4).cast("int")
    d = d.withColumn("left", F.length("text") - k).withColumn("taken", F.least(k, F.length("next_text")))
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("left")), F.substring("next_text", F.lit(1), F.col("taken"))))
    head, seam, tail = joined_parts(F.col("edited"), F.col("left"), F.col("taken"), F.col("sk"), F.col("next_sk"))
    d = d.withColumn("head", head).withColumn("seam", seam).withColumn("tail", tail)
    cut = F.col("left") + F.col("taken") >= K
    # What either fingerprint says of its part is taken over; only the seam and the first anchor after it are written anew.
    d = d.withColumn("fresh", F.concat("seam", F.transform(F.slice("tail", 1, 1), lambda v: v + F.col("left")))).withColumn("before", F.coalesce(_at(F.get("head", F.size("head") - 1)), F.lit(0)))
    text = F.concat(F.substring("fp", F.lit(1), 9 * F.size("head")), _hex(F.col("fresh"), F.col("before")), F.substring("next_fp", F.lit(10), 9 * F.greatest(F.size("tail") - 1, F.lit(0))))
    d = d.withColumn("edited_set", F.when(cut, anchor_set(F.concat("head", "seam", "tail"))).otherwise(anchor_set(_whole(F.col("edited")))))
    return d.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"),
        F.when(cut, text).otherwise(_hex(_whole(F.col("edited")))).alias("edited_fingerprint"), likeness(F.col("set"), F.col("edited_set")).alias("near_edited"), likeness(F.col("set"), F.col("next_set")).alias("near_next"),
    )
