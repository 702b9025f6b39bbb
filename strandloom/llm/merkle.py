"""Document fingerprints: a Merkle tree over sections, paragraphs and blocks.

A text is cut, without losing a character, into sections (a blank line ends
one), a section into paragraphs (lines), a paragraph into blocks of ``BLOCK``
code points.  A node's hash is SHA-256 of its children's hashes.  The
fingerprint is the tree in pre-order, its nodes separated by spaces: the root
in full, then ``S``, ``P`` and ``L`` nodes (section, paragraph, block) with the
leading hex digits of their hashes.  Roots tell whether texts are equal;
``differing_branches`` tells where they differ; ``likeness`` is 1 for equal
roots, else the share that two trees' sets of blocks have in common.

All of it is column expressions.  Texts alone are shuffled, sorted and put beside
their successors; trees are made after that, in one projection, so the hashes of
one row are in memory at a time.

Defined results: a null text counts as empty; an empty text has one empty
paragraph without blocks; a very long text is a tree of as many more nodes, held
by one task; equal texts (ties, repeated rows) have equal fingerprints whatever
else is in their rows, and each row gives one; a null doc_id precedes all others,
rows of equal ids are in the order of their texts; the only row of a table
follows itself; an empty table gives no rows; columns besides doc_id and text are
neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm._shared import RangeBuckets

BLOCK = 64


def _node(kind: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), F.array_join(children, "")), 256)


def _short(kind: str, digest: Column) -> Column:
    return F.concat(F.lit(kind), F.substring(digest, 1, 10))


def fingerprint(text: Column, block: int = BLOCK) -> Column:
    sections = F.split(F.coalesce(text, F.lit("")), "(?<=\n)(?=\n)", -1)
    cut = F.lit(f"(?s).{{1,{block}}}")

    def paragraph(line: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(line, cut, F.lit(0)), lambda b: F.sha2(b, 256))
        return F.transform(F.array(leaves), lambda x: F.struct(_node("P", x).alias("h"), x.alias("c")))[0]

    def section(part: Column) -> Column:
        made = F.transform(F.split(part, "\n", -1), paragraph)
        return F.transform(F.array(made), lambda x: F.struct(_node("S", x["h"]).alias("h"), x.alias("c")))[0]

    def listed(s: Column) -> Column:
        lines = F.transform(s["c"], lambda p: F.concat(F.array(_short("P", p["h"])), F.transform(p["c"], lambda x: _short("L", x))))
        return F.concat(F.array(_short("S", s["h"])), F.flatten(lines))

    tree = F.transform(F.array(F.transform(sections, section)), lambda x: F.struct(_node("D", x["h"]).alias("h"), x.alias("c")))
    return F.transform(tree, lambda d: F.concat_ws(" ", d["h"], F.flatten(F.transform(d["c"], listed))))[0]


def _leaves(fp: Column) -> Column:
    return F.array_distinct(F.filter(F.split(fp, " "), lambda n: n.startswith("L")))


def block_set(text: Column, block: int = BLOCK) -> Column:
    """What ``likeness`` compares: the distinct ``L`` nodes of a text, without its tree."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x != "")
    cut = F.lit(f"(?s).{{1,{block}}}")
    return F.array_distinct(F.flatten(F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x, cut, F.lit(0)), lambda b: _short("L", F.sha2(b, 256))))))


def _likeness(a: Column, b: Column, same: Column) -> Column:
    """Of two sets of blocks; 1 if the roots are the ``same``."""

    def share(x: Column) -> Column:
        either = F.size(x["a"]) + F.size(x["b"]) - x["n"]
        return F.when(either == 0, F.lit(0.0)).otherwise(x["n"] / F.greatest(either, F.lit(1)))

    # Bound to a variable, so the sets are made once.
    sets = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.size(F.array_intersect(x["a"], x["b"])).alias("n")))
    return F.when(same, F.lit(1.0)).otherwise(F.transform(sets, share)[0])


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, from 0 to 1."""
    return _likeness(_leaves(a), _leaves(b), root(a) == root(b))


def root(fp: Column) -> Column:
    return F.substring(fp, 1, 64)


def differing_branches(a: Column, b: Column) -> Column:
    """Nodes of the first fingerprint that the second lacks, in order."""
    return F.when(root(a) == root(b), F.array().cast("array<string>")).otherwise(F.array_except(F.split(a, " "), F.split(b, " ")))


def with_next(docs: DataFrame, rows_each: int = 250) -> DataFrame:
    """doc_id, text ('' if null) and the text of the next document by ascending id
    (nulls first, equal ids by text; the first follows the last).

    Ids are cut into ranges.  The rows that begin a range are also dealt, as
    sentinels, to the range before it, so each range finds all its successors
    and the texts are shuffled once.
    """
    ranges = RangeBuckets.of(docs, "doc_id", rows_each)
    n = max(1, len(ranges.bounds))
    # A null id precedes all others, so what follows the last row is a null id if there is one.
    first = F.col("doc_id").isNull() | ranges.begins(F.col("doc_id"), F.col("part"))
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("part", ranges.index(F.col("doc_id")))
    own = F.struct(F.col("part").alias("p"), F.lit(0).alias("c"))
    ahead = F.struct(F.pmod(F.col("part") - 1, F.lit(n)).alias("p"), F.lit(1).alias("c"))
    spots = F.explode(F.when(first, F.array(own, ahead)).otherwise(F.array(own)))
    dealt = whole.withColumn("spot", spots).select("doc_id", "text", F.col("spot.p").alias("part"), F.col("spot.c").alias("copy"))
    order = Window.partitionBy("part").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    ranged = dealt.repartition("part").withColumn("next", F.lead("text").over(order))
    return ranged.where("copy = 0").select("doc_id", "text", F.coalesce("next", "text").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by the beginning of the next."""
    n = F.length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def fingerprints(docs: DataFrame) -> DataFrame:
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    own, other = fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint")
    made = rows.select("doc_id", "text", "next_text", F.sha2("edited", 256).alias("edited_sha256"), own, other)
    return made.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        # Roots are equal where texts are.
        _likeness(_leaves(F.col("fingerprint")), block_set(F.col("next_text")), F.col("text") == F.col("next_text")).alias("near_next"),
    )
