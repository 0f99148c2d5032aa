"""Document fingerprints from closed syncmers of words, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORDS = 5  # words of a k-mer
INNER = 2  # words of its inner substrings
BLOCK_BITS = 6
SUPER_BITS = 12


def bind(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _inner_hashes(words: Column) -> Column:
    """Hash of the inner substring that starts at each word; the last few are of fewer words and belong to no k-mer."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, INNER)]))


def _marked(h: Column, n: Column, value) -> Column:
    """``value(i)`` of each k-mer ``i`` whose least inner hash is at an edge: its choice depends on its own words alone."""
    last = WORDS - INNER

    def choose(x: Column, i: Column) -> Column:
        edge = F.least(x, F.get(h, i + last))
        inside = F.least(*[F.get(h, i + j) for j in range(1, last)])
        return F.when((i + WORDS <= n) & (edge <= inside), value(x, i))

    return F.filter(F.transform(h, choose), lambda v: v.isNotNull())


def _value(h: Column):
    """Hash of a k-mer from inner hashes that together cover its words."""
    starts = [*range(INNER, WORDS - INNER, INNER), WORDS - INNER]
    return lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in starts])


def anchors(text: Column) -> Column:
    """``array<struct<pos, hash>>``: word position and hash of every closed syncmer of the whole text.

    A text of fewer than ``WORDS`` words has one anchor, itself; an empty or null text none.
    """
    def of(words: Column) -> Column:
        few = F.when(F.size(words) > 0, F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.array_join(words, " ")).alias("hash"))))
        many = bind(_inner_hashes(words), lambda h: _marked(
            h, F.size(words), lambda x, i: F.struct(i.alias("pos"), _value(h)(x, i).alias("hash"))))
        none = F.array().cast("array<struct<pos:int,hash:bigint>>")
        return F.when(F.size(words) < WORDS, F.coalesce(few, none)).otherwise(many)

    return bind(words_of(F.coalesce(text, F.lit(""))), of)


def hashes_of(found: Column) -> Column:
    """The distinct hashes of all anchors, sorted."""
    return F.sort_array(F.array_distinct(F.transform(found, lambda a: a["hash"])))


def shown(hashes: Column) -> Column:
    """Hashes as text: 16 hexadecimal digits each."""
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of anchor hashes. Two empty ones are alike."""
    shared = bind(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared)


def next_blocks(ids: DataFrame) -> DataFrame:
    """``block, next_block`` of the blocks that hold ids; the last is followed by the first.

    Blocks are ordered within groups of ``2 ** SUPER_BITS``; only one row per group, for millions of ids, meets in one task.
    """
    blocks = ids.where("doc_id IS NOT NULL").select(F.shiftright("doc_id", BLOCK_BITS).alias("block")).distinct().withColumn(
        "sup", F.shiftright("block", SUPER_BITS)
    )
    inside = W.partitionBy("sup").orderBy("block")
    over = W.orderBy("sup")
    sups = blocks.groupBy("sup").agg(F.min("block").alias("first")).select(
        "sup", F.coalesce(F.lead("first").over(over), F.first("first").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after")
    )
    return blocks.withColumn("inner", F.lead("block").over(inside)).join(sups, "sup").select(
        "block", F.coalesce("inner", "after").alias("next_block")
    )


def with_next(docs: DataFrame) -> DataFrame:
    """Add to ``doc_id, text`` the text of the next document by id, the first after the last.

    Rows move once, into blocks of ``2 ** BLOCK_BITS`` ids; the last of each block takes the first of the next block
    that holds any. Rows without id have no next document. Rows of one id follow each other by text.
    """
    order = W.partitionBy("block").orderBy("doc_id", "text")
    rows = docs.where("doc_id IS NOT NULL").withColumn("block", F.shiftright("doc_id", BLOCK_BITS)).where("block IS NOT NULL").select(
        "block", "doc_id", "text", F.lead("text").over(order).alias("next_text"), F.lag("text").over(order).alias("last_text"),
    )
    # The first of each block, under the name of the block before; both sides of the join share one exchange.
    heads = rows.where("last_text IS NULL").select(F.col("block").alias("next_block"), F.col("text").alias("head"))
    heads = heads.join(next_blocks(docs.select("doc_id")), "next_block").drop("next_block")
    linked = rows.join(heads, "block").select("doc_id", "text", F.coalesce("next_text", "head").alias("next_text"))
    alone = docs.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("string").alias("next_text"))
    return linked.unionAll(alone)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how alike they and the next document's are.

    A fingerprint is the sorted distinct hashes of all anchors of the whole text; ``anchors`` has each with its word position.
    The edited text ends with the beginning of the next document, by ascending id, in place of its own last
    half. Null texts count as empty. Without an id a document has no next one: its edited text is its own,
    ``near_next`` null. Equal texts have equal fingerprints. Other columns of ``docs`` are not read.
    """
    # Without a needless alias of the id both uses of the rows plan alike and share the exchange.
    ident = F.col(f"`{key}`") if key == "doc_id" else F.col(f"`{key}`").alias("doc_id")
    lean = docs.select(ident, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = with_next(lean)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.coalesce(F.substring(F.col("next_text"), F.lit(1), half), F.substring(F.col("text"), n - half + 1, half)))
    # Only texts move: anchors of all three are made behind the exchange.
    rows = rows.select(
        "doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), anchors(F.col("text")).alias("anchors"),
        F.when(F.col("next_text").isNotNull(), hashes_of(anchors(F.col("next_text")))).alias("next_hashes"),
    )
    rows = rows.withColumn("hashes", hashes_of(F.col("anchors"))).withColumn("edited_hashes", hashes_of(anchors(F.col("edited"))))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown(F.col("hashes")).alias("fingerprint"),
        shown(F.col("edited_hashes")).alias("edited_fingerprint"), likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"), "anchors",
    )
