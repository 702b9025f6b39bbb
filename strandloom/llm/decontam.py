"""Benchmark decontamination: a broadcast hash set of test n-grams.

Items are normalised and cut into windows of ``WINDOW`` words; an item of fewer
words is one window.  Documents are scanned once, as rolling hashes of their
words.  A bitmap of the windows' hashes, one literal of ``MOST_BITS`` bits at most
whatever the benchmark, lets through the positions that may be hits; these meet
the windows in an equality join of the words themselves, so a hit is verified and
the bitmap costs time alone.  The join's hash table is broadcast if the windows
are ``SET_SIZE`` and ``SET_BYTES`` of text or fewer; a larger set is joined by a
shuffle.

All of it is DataFrame operations.  Defined results: a null or empty text has no
words and no hits; items that are null or without words have no windows; a very
long text is scanned whole, as one row; rows that are equal (repeated rows, ties)
get equal results and a row each, null ids as well; repeated item_ids count once,
a null item_id counts as none; an empty table of documents gives no rows, an empty
benchmark no hits; columns besides doc_id and text are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm._shared import materialize

WINDOW = 8
#: Windows, and bytes of their text, that are broadcast.
SET_SIZE, SET_BYTES = 200_000, 32 << 20
#: Hits of 8 bytes that ``decontaminate`` broadcasts.
BROADCAST_HITS = 1_000_000
#: Bits of the bitmap for each window, and in all.
BITS_EACH, FEWEST_BITS, MOST_BITS = 256, 1 << 12, 1 << 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Normalised words.  Only A-Z become lower case; for texts of ASCII alone
    that is what lower() does, which is faster."""
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(low, _NO_WORD, -1), ""), F.array().cast("array<string>"))


def _hash_at(hashes: Column, i: Column, width: int) -> Column:
    """Hash of the run of ``width`` words from position i (0 is the first)."""
    return F.xxhash64(*[F.get(hashes, i + j) for j in range(width)])


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct item_id, width, gram (words joined by blanks) and h of all windows."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    items = items.withColumn("width", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("width") + 1)
    grams = items.select("item_id", "width", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("width")))).alias("g")).distinct()
    grams = grams.withColumn("hashes", F.transform("g", lambda x: F.xxhash64(x)))
    h = F.lit(None).cast("bigint")
    for k in range(1, window + 1):
        h = F.when(F.col("width") == k, _hash_at(F.col("hashes"), F.lit(0), k)).otherwise(h)
    return grams.select("item_id", "width", F.array_join("g", " ").alias("gram"), h.alias("h"))


def _bitmap(grams: DataFrame, total: int) -> tuple[Column, int]:
    """Array of 64-bit words with the bits of all windows' hashes, and its bits.
    MOST_BITS / 64 rows come to the driver at most; in the plan it is one literal."""
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (BITS_EACH * max(1, total) - 1).bit_length()))
    spot = F.col("h").bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), spot.bitwiseAND(F.lit(63)).cast("int"))
    words = [0] * (bits // 64)
    for r in grams.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(bit).alias("word")).collect():
        words[r["at"]] = r["word"]
    return F.expr("cast(split('" + ",".join(map(str, words)) + "', ',') as array<bigint>)"), bits


def _hits(widths: list[int], bitmap: Column, bits: int) -> Column:
    """struct(at, width, gram) of each place of ``w`` whose hash is in the bitmap."""
    w, hashes = F.col("w"), F.col("hashes")
    found = F.array().cast("array<struct<at:int,width:int,gram:string>>")

    def of_width(width: int) -> Column:
        starts = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))
        spots = F.transform(starts, lambda i: _hash_at(hashes, i, width).bitwiseAND(F.lit(bits - 1)))
        bit = lambda h: F.getbit(F.get(bitmap, F.shiftright(h, 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int"))
        inside = F.array_compact(F.transform(spots, lambda h, i: F.when(bit(h) == 1, i)))
        return F.transform(inside, lambda i: F.struct((i + 1).alias("at"), F.lit(width).alias("width"), F.array_join(F.slice(w, i + 1, width), " ").alias("gram")))

    return F.concat(found, *[of_width(k) for k in widths])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_size: int = SET_SIZE) -> DataFrame:
    """doc_id, text_hash, n_words, the verified hits (sorted array of at, width)
    and the sorted item_ids they are from, and copies: the number of rows of this
    doc_id and text, which share the row."""
    grams = materialize(windows(benchmark, window), "windows")
    of = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0)).alias("size"), F.sort_array(F.collect_set("width")).alias("widths")).first()
    bitmap, bits = _bitmap(grams, of["n"])
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words(F.col("text")).alias("w"))
    rows = rows.withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))
    found = rows.select("doc_id", "text_hash", F.size("w").cast("bigint").alias("n_words"), F.posexplode_outer(_hits(of["widths"], bitmap, bits)).alias("pos", "hit"))
    found = found.withColumn("begins", (F.coalesce("pos", F.lit(0)) == 0).cast("int"))
    listed = grams.groupBy("gram", F.col("width").alias("gram_width")).agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    if of["n"] <= set_size and of["size"] <= SET_BYTES:
        listed = F.broadcast(listed)
    verified = found.join(listed, (F.col("hit.gram") == F.col("gram")) & (F.col("hit.width") == F.col("gram_width")), "left")
    spot = F.when(F.col("items").isNotNull(), F.struct(F.col("hit.at").alias("at"), F.col("hit.width").alias("width")))
    grouped = verified.groupBy("doc_id", "text_hash", "n_words").agg(F.collect_set(spot).alias("hits"), F.collect_set("items").alias("items"), F.sum("begins").cast("int").alias("copies"))
    return grouped.withColumn("hits", F.sort_array("hits")).withColumn("items", F.sort_array(F.array_distinct(F.flatten("items"))))


def covered(hits: Column) -> Column:
    """Number of words in the union of hits, which are sorted."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, hit: Column) -> Column:
        end = hit["at"] + hit["width"]
        fresh = F.greatest(end - F.greatest(hit["at"], acc["end"]), F.lit(0))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(hits, zero, add)["n"].cast("bigint")


def contamination(docs: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    found = scan(docs, benchmark).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select(
        "doc_id",
        "n_words",
        covered(F.col("hits")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= least_items).alias("contaminated"),
    )


def without_spans(text: Column, hits: Column) -> Column:
    """The text without the words that are hit, and without what follows each of
    them up to the next word."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all(text, F.lit(f"{word}[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"), F.lit(0))
    before = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    # Positions are from 1.  All steps take time in proportion to words and hits.
    hit = F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["width"] - 1)))
    places = lambda p: F.array_except(F.sequence(F.lit(1), F.size(p)), hit)
    # The pieces are bound to a variable, so they are cut once and not for each place.
    kept = F.transform(F.array(pieces), lambda p: F.array_join(F.transform(places(p), lambda i: F.get(p, i - 1)), ""))[0]
    return F.trim(F.concat(before, kept))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """Documents with passages of ``least_items`` items or more go; from others
    the passages go.  A document without a hit stays as it is.  Columns stay;
    ``n_chars``, if there is one, follows the text.  Up to ``broadcast_hits`` hits
    are broadcast with the ids of their documents, so the texts aren't shuffled."""
    names = docs.columns
    dirty = scan(docs, benchmark).where("size(items) > 0").select(F.col("doc_id").alias("_sl_id"), F.col("text_hash").alias("_sl_hash"), F.col("hits").alias("_sl_hits"), F.size("items").alias("_sl_n"))
    dirty = materialize(dirty, "dirty")
    if (dirty.agg(F.sum(F.size("_sl_hits"))).first()[0] or 0) <= broadcast_hits:
        dirty = F.broadcast(dirty)
    here = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(dirty, docs["doc_id"].eqNullSafe(F.col("_sl_id")) & (here == F.col("_sl_hash")), "left")
    kept = joined.where(F.coalesce(F.col("_sl_n") < least_items, F.lit(True)))
    text = F.when(F.col("_sl_n").isNull(), F.col("text")).otherwise(without_spans(F.col("text"), F.col("_sl_hits")))
    kept = kept.withColumn("text", text)
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.when(F.col("_sl_n").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return kept.select(*names)
