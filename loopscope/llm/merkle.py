"""Document fingerprints: Merkle trees over sections, paragraphs and pieces, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounds_tree, quantile_bounds, staged

#: A leaf: up to 64 characters and the sentence or line ends after them. Leaves laid end to end are the text.
PIECE = r"[^.!?\n]{1,64}[.!?\n]*|[.!?\n]+"
#: Hex digits that a fingerprint keeps of each section, paragraph and leaf.
LEAF = 12
#: Ids of one ordered bucket, about.
BUCKET_ROWS = 50_000


def tree(text: Column) -> Column:
    """SHA-256 of every leaf: sections (cut after blank lines) of paragraphs (lines) of leaves."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.sha2(x, 256))
    return F.transform(F.split(text, r"(?<=\n\n)(?!\n)"), lambda s: F.transform(F.split(s, r"(?<=\n)"), leaves))


def over(children: Column) -> Column:
    """The digest of an inner node: the SHA-256 of its children's digests."""
    return F.sha2(F.array_join(children, ""), 256)


def branches(nodes: Column) -> Column:
    """Of each section its digest, and of each of its paragraphs the digest and the leaves' ones."""
    paragraph = lambda p: F.struct(over(p).alias("digest"), p.alias("leaves"))
    section = lambda ps: F.struct(over(F.transform(ps, lambda p: p["digest"])).alias("digest"), ps.alias("paragraphs"))
    return F.transform(F.transform(nodes, lambda s: F.transform(s, paragraph)), section)


def fingerprint(tree: Column) -> Column:
    """root:sections, sections parted by `;` as digest=paragraphs, paragraphs by `,` as digest-leaves; all but the root are cut to LEAF hex digits."""
    cut = lambda x: F.substring(x, 1, LEAF)
    paragraph = lambda p: F.concat(cut(p["digest"]), F.lit("-"), F.array_join(F.transform(p["leaves"], cut), ""))
    section = lambda s: F.concat(cut(s["digest"]), F.lit("="), F.array_join(F.transform(s["paragraphs"], paragraph), ","))
    return F.concat(over(F.transform(tree, lambda s: s["digest"])), F.lit(":"), F.array_join(F.transform(tree, section), ";"))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df and the fingerprint of a text column (null: of the empty text). Equal texts, and only they, have equal roots."""
    return df.withColumn("_nodes", branches(tree(F.coalesce(text, F.lit(""))))).withColumn(name, fingerprint(F.col("_nodes"))).drop("_nodes")


def root(fp: Column) -> Column:
    return F.substring_index(fp, ":", 1)


def sections(fp: Column) -> Column:
    return F.split(F.substring_index(fp, ":", -1), ";")


def paragraphs(sections: Column) -> Column:
    """All paragraphs of some sections."""
    return F.flatten(F.transform(sections, lambda s: F.split(F.substring_index(s, "=", -1), ",")))


def leaves(paragraphs: Column) -> Column:
    """All leaves of some paragraphs."""
    of = lambda p: F.regexp_extract_all(F.substring_index(p, "-", -1), F.lit(f"[0-9a-f]{{{LEAF}}}"), F.lit(0))
    return F.flatten(F.transform(paragraphs, of))


def count_leaves(paragraphs: Column) -> Column:
    return F.aggregate(paragraphs, F.lit(0), lambda n, p: n + ((F.length(p) - (LEAF + 1)) / F.lit(LEAF)).cast("int"))


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df and how alike two fingerprints are (0 to 1), from their branches alone.

    Equal roots: 1. Else the two trees are descended side by side: branches with equal digests have all leaves in
    common and are not entered; sections that differ are compared by paragraphs, and paragraphs that differ by leaves.
    The result is the share of leaves (Dice) that both have; branches that repeat within a text count once. A branch's
    text begins with its digest, so sets of branches compare by digests, in linear time.
    """
    x, y = F.col(a), F.col(b)
    df = df.withColumns({"_x": sections(x), "_y": sections(y)})
    df = df.withColumns({"_both": paragraphs(F.array_intersect("_x", "_y")), "_x": paragraphs(F.array_except("_x", "_y")), "_y": paragraphs(F.array_except("_y", "_x"))})
    df = df.withColumns({"_both": count_leaves(F.col("_both")) + count_leaves(F.array_intersect("_x", "_y")), "_x": F.array_distinct(leaves(F.array_except("_x", "_y"))), "_y": F.array_distinct(leaves(F.array_except("_y", "_x")))})
    common, every = 2 * (F.col("_both") + F.size(F.array_intersect("_x", "_y"))), 2 * F.col("_both") + F.size("_x") + F.size("_y")
    share = F.when(root(x) == root(y), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(common.cast("double"), every), F.lit(0.0)))
    return df.withColumn(name, share).drop("_x", "_y", "_both")


def edits(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df and the branches of a that b lacks: array of (section, paragraph) from 0, found by descending into sections whose digest b lacks."""
    digest = lambda branch: F.substring(branch, 1, LEAF)
    digests = lambda bs: F.transform(bs, digest)
    x, y = sections(F.col(a)), sections(F.col(b))
    df = df.withColumns({"_s": F.array_except(digests(x), digests(y)), "_p": F.array_except(digests(paragraphs(x)), digests(paragraphs(y)))})
    enter = lambda s, i: F.transform(F.split(F.substring_index(s, "=", -1), ","), lambda p, j: F.when(F.array_contains("_p", digest(p)), F.struct(i.alias("section"), j.alias("paragraph"))))
    found = F.transform(x, lambda s, i: F.when(F.array_contains("_s", digest(s)), enter(s, i)))
    return df.withColumn(name, F.filter(F.flatten(F.filter(found, lambda z: z.isNotNull())), lambda z: z.isNotNull())).drop("_s", "_p")


def successors(keys: DataFrame) -> DataFrame:
    """keys(id, tie, n, c) with the id and tie of the next one in descending id, and the n of the one before whose next this is; the first comes after the last.

    Ids go to ordered buckets by quantiles; windows run inside buckets, and the buckets' ends (a bounded number of
    rows) are tied together on the driver. Null ids come last.
    """
    bounds = quantile_bounds(keys, "id", BUCKET_ROWS)
    keys = keys.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(bounds_tree(F.col("id"), bounds)))
    w = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("id"), "tie")
    me = F.struct("id", "tie", "n")
    keys = staged(keys.withColumn("next", F.lead(me).over(w)).withColumn("prev", F.lag(me).over(w)), "order")
    ends = keys.groupBy("bucket").agg(F.max(F.when(F.col("prev").isNull(), me)).alias("first"), F.max(F.when(F.col("next").isNull(), me)).alias("last")).collect()
    ends.sort(key=lambda r: -r["bucket"])
    rows = [(r["bucket"], tuple(ends[(i + 1) % len(ends)]["first"]), tuple(ends[i - 1]["last"])) for i, r in enumerate(ends)]
    kind = keys.schema["next"].dataType.simpleString()
    edges = F.broadcast(keys.sparkSession.createDataFrame(rows, f"bucket int, after {kind}, before {kind}"))
    return keys.join(edges, "bucket").select("id", "tie", "n", "c", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "before").alias("prev"))


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last floor(n/3) characters replaced by as many first ones (or all) of the next document in descending id.

    Texts are shuffled once by id; only the replaced part and the fingerprint of the next document travel besides.
    Null texts are empty. Rows with equal ids follow one another by a hash of their texts; equal rows follow
    themselves; rows without id come after all others. A single row is its own next. Empty tables give empty results.
    """
    key = lambda c: [F.coalesce(c, F.lit(0)).alias("id0"), c.isNull().alias("none")]  # noqa: E731  a null id as a plain equi-join key
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")).select(*key(F.col("id")), F.xxhash64("text").alias("tie"), "text")
    narrow = rows.groupBy("id0", "none", "tie").agg(F.max(F.length("text")).cast("long").alias("n"), F.count(F.lit(1)).alias("c"))
    order = staged(successors(staged(narrow.select(F.when(~F.col("none"), F.col("id0")).alias("id"), "tie", "n", "c"), "ids")), "successors")
    texts = rows.groupBy("id0", "none", "tie").agg(F.first("text").alias("text"))
    on = ["id0", "none", "tie"]
    own = texts.join(order.select(*key(F.col("id")), "id", "tie", "n", "c", "prev"), on)
    sent = with_fingerprint(own, "text", "next_fingerprint").select(*key(F.col("prev.id")), F.col("prev.tie").alias("tie"), F.substring("text", F.lit(1), F.floor(F.col("prev.n") / 3).cast("int")).alias("part"), "next_fingerprint")
    got = own.select(*on, "id", "text", "n", "c").join(sent, on)
    k = F.floor(F.col("n") / 3).cast("int")
    got = with_fingerprint(got, "text", "fingerprint")
    # of equal rows all but the last are followed by their like
    turn = F.explode(F.when(F.col("c") > 1, F.concat(F.array(F.lit(False)), F.array_repeat(F.lit(True), (F.col("c") - 1).cast("int")))).otherwise(F.array(F.lit(False))))
    got = got.withColumn("_like", turn)
    part = F.when(F.col("_like"), F.substring("text", F.lit(1), k)).otherwise(F.col("part"))
    got = got.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n") - k).cast("int")), part)).withColumn("next_fingerprint", F.when(F.col("_like"), F.col("fingerprint")).otherwise(F.col("next_fingerprint")))
    got = with_fingerprint(got, "edited", "edited_fingerprint")
    got = got.select(F.col("id").alias("doc_id"), F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "next_fingerprint")
    got = likeness(likeness(got, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return got.drop("next_fingerprint")
