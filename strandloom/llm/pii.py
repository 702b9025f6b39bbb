"""Personal data: fixed patterns, and terms that disclose what the patterns find.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers
(base spans).  A mention protects entities of three levels: the value itself, its
group (an address's domain, the first two numbers of an IP address, a card's
issuer digits, a phone number without its last four digits) and its kind.  Values
hardly repeat, so the upper levels gather what single values can't show.

Which terms reveal an entity is estimated from the whole corpus: with p(e|t) the
share of a term's occurrences that lie near a mention of the entity and p(e) the
share of all terms that do, the disclosure of e by t is

    PMI(t; e) / IC(e) = log(p(e|t) / p(e)) / log(1 / p(e))

which is 1 if the term occurs nowhere else.  So that a term seen once or twice
counts for what it shows and no more, p(e|t) is the lower end of Wilson's
interval (``Z`` standard errors); its number of trials counts occurrences in equal
contexts, as in copies of a text, once.  A term with a disclosure of
``GENERALISE`` or more is generalised in the texts that mention the entity; from
``REMOVE`` on it is removed.  Contexts are ``REACH`` code points on either side, so
a mention gives a bounded number of pairs and none are made among the mentions of
a text.  Texts are met with terms by their own distinct terms, so an entity that
many texts mention isn't multiplied with all of its terms.

All of it is DataFrame operations.  Positions come from ``split`` and
``regexp_extract_all`` with one pattern: the lengths of the pieces between
matches and of the matches add up to them.  Patterns use possessive and
look-behind forms that match the same strings as their plain forms in linear
time and without recursion.

Defined results: a null text counts as empty; texts without a base span have no
spans at all, whatever terms they hold; a very long text is searched whole;
equal texts (ties, repeated rows, null or equal ids) get equal spans and a row
each; of terms that overlap a base span the base span stays; an empty table gives
no rows; columns besides doc_id and text are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm._shared import labelled, materialize

#: Leftmost matches of these equal those of the plain patterns
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
TERM = r"\p{L}{3,}"
REACH, Z, GENERALISE, REMOVE = 128, 1.645, 0.85, 0.95


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_OCTETS)
    if kind == "card":
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"


def _located(matches: Column, pieces: Column, keep, kind: Column, contexts: bool) -> Column:
    """Spans of the matches to keep, in order; one walk over the matches."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        value = F.get(matches, i)
        start = acc["at"] + F.length(F.get(pieces, i))
        end = start + F.length(value)
        near = (F.right(F.get(pieces, i), F.lit(REACH)), F.left(F.get(pieces, i + 1), F.lit(REACH))) if contexts else (F.lit(""), F.lit(""))
        span = F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"), near[0].alias("before"), near[1].alias("after"))
        return F.struct(end.alias("at"), F.when(keep(value), F.concat(acc["out"], F.array(span).cast(_SPAN))).otherwise(acc["out"]).alias("out"))

    walk = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, step)["out"]
    return F.when(F.size(matches) > 0, walk).otherwise(F.array().cast(_SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash, row_key (of id and text) and ``base``: the spans of the
    fixed patterns, by kind and start, each with its value and the text on either side."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    may = {"email": F.contains(F.col("text"), F.lit("@")), "phone": F.contains(F.col("text"), F.lit("+"))}
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        rows = rows.withColumn(f"m_{kind}", F.when(may[kind], found).otherwise(none) if kind in may else found)
    for kind, pattern in PATTERNS.items():
        rows = rows.withColumn(f"p_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)).otherwise(none))
    spans = [_located(F.col(f"m_{k}"), F.col(f"p_{k}"), lambda v, k=k: _valid(k, v), F.lit(k), True) for k in PATTERNS]
    return rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.concat(*spans).alias("base")).withColumn("row_key", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text_hash").cast("string")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entities(kind: Column, value: Column) -> Column:
    """What a mention protects: its value, group and kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    numeric = kind.isin("card", "phone")
    plain = F.when(numeric, digits).otherwise(F.lower(value))
    group = (
        F.when(kind == "email", F.regexp_replace(plain, "^[^@]*@", "@"))
        .when(kind == "ip", F.regexp_extract(plain, r"^[0-9]+\.[0-9]+\.", 0))
        .when(kind == "card", F.left(digits, F.lit(6)))
        .otherwise(F.left(digits, F.length(digits) - 4))
    )
    return F.array(F.concat_ws(":", kind, plain), F.concat_ws("~", kind, group), kind)


def _mentions(base: DataFrame) -> DataFrame:
    """row_key, entity, and the two sides of each base span, for each of its entities."""
    rows = base.where(F.size("base") > 0).select("row_key", F.explode("base").alias("s"))
    return rows.select("row_key", F.explode(_entities(F.col("s.kind"), F.col("s.value"))).alias("entity"), F.col("s.before").alias("before"), F.col("s.after").alias("after"))


def _lower_share(p: Column, trials: Column, z: float = Z) -> Column:
    """The lower end of Wilson's interval of a share."""
    zz = F.lit(z * z)
    return (p + zz / (2 * trials) - F.lit(z) * F.sqrt(p * (1 - p) / trials + zz / (4 * trials * trials))) / (1 + zz / trials)


def disclosing_terms(docs: DataFrame, mentions: DataFrame, least: float = GENERALISE, z: float = Z) -> DataFrame | None:
    """(entity, term, disclosure) of all pairs from ``least`` on; None if no mention
    has a term near it."""
    # Words that the cut may have shortened are left out.
    before = F.when(F.length("before") >= REACH, F.regexp_replace("before", r"^\S+", "")).otherwise(F.col("before"))
    after = F.when(F.length("after") >= REACH, F.regexp_replace("after", r"\S+\z", "")).otherwise(F.col("after"))
    near = mentions.select("entity", F.xxhash64("before", "after").alias("context"), F.lower(F.concat_ws(" ", before, after)).alias("side"))
    near = near.select("entity", "context", F.explode(F.regexp_extract_all("side", F.lit(TERM), F.lit(0))).alias("term"))
    pairs = near.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("contexts"))
    pairs = materialize(pairs, "pairs")
    around = materialize(pairs.groupBy("entity").agg(F.sum("n_both").alias("n_entity"), F.count("*").alias("n")), "around")
    if pairs.isEmpty():
        return None
    tokens = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))).alias("token"))
    counts = materialize(tokens.groupBy("token").agg(F.count("*").alias("n_term")), "terms")
    total = counts.agg(F.sum("n_term")).first()[0] or 1
    p = F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))
    # Equal contexts are one trial.
    trials = F.greatest(F.lit(1.0), F.col("n_term") * F.col("contexts") / F.col("n_both"))
    ic = -F.log(F.least(F.col("n_entity") / F.lit(float(total)), F.lit(1.0)))
    disclosure = F.when(ic > 0, F.least(F.lit(1.0), (F.log(_lower_share(p, trials, z)) + ic) / F.greatest(ic, F.lit(1e-300)))).otherwise(F.lit(0.0))
    # Common words stand near many entities, and kinds near many words.
    near = pairs.groupBy("term").agg(F.count("*").alias("n")).join(counts, F.col("term") == F.col("token")).select("term", "n_term", "n")
    known = labelled(labelled(pairs, "term", materialize(near, "near"), "n_term"), "entity", around, "n_entity")
    return known.select("entity", "term", disclosure.alias("disclosure")).where(F.col("disclosure") >= least)


def find(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, z: float = Z) -> DataFrame:
    """doc_id, text, text_hash, ``base`` and ``terms``: spans of kind ``generalised``
    and ``removed``, by start, of every document."""
    base = base_spans(docs)
    # Texts are kept only where there is something to protect.
    base = materialize(base.withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "base")
    mentions = _mentions(base)
    none = F.array().cast(_SPAN)
    pairs = disclosing_terms(docs, mentions, generalise, z)
    if pairs is None:
        return base.drop("row_key").withColumn("terms", none)
    pairs = materialize(pairs, "disclosing")
    rows = base.where(F.size("base") > 0).dropDuplicates(["row_key"])
    own = rows.select("row_key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    met = own.join(pairs, "term")
    held = mentions.select("row_key", "entity").distinct()
    per_doc = met.join(held, ["row_key", "entity"], "left_semi").groupBy("row_key", "term").agg(F.max("disclosure").alias("disclosure"))
    gone = F.when(F.col("disclosure") >= remove, F.col("term"))
    per_doc = per_doc.groupBy("row_key").agg(F.collect_set("term").alias("all"), F.collect_set(gone).alias("gone"))
    rows = rows.join(per_doc, "row_key")
    rows = rows.withColumn("m", F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).withColumn("p", F.split("text", TERM, -1))
    found = _located(F.col("m"), F.col("p"), lambda v: F.array_contains(F.col("all"), F.lower(v)), F.lit("generalised"), False)
    named = F.transform(found, lambda s: F.struct(F.when(F.array_contains(F.col("gone"), F.lower(s["value"])), F.lit("removed")).otherwise(s["kind"]).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "value", "before", "after")]))
    clear = F.filter(named, lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    terms = rows.select("row_key", clear.alias("terms"))
    return base.join(terms, "row_key", "left").select("doc_id", "text", "text_hash", "base", F.coalesce("terms", none).alias("terms"))


def personal_data(docs: DataFrame) -> DataFrame:
    found = find(docs)
    of = lambda spans, kind: F.filter(spans, lambda s: s["kind"] == kind)
    count = lambda spans, kind: F.size(of(spans, kind)).cast("bigint").alias(f"n_{kind}")
    listed = F.array(_listed(F.col("base")), *[_listed(of("terms", k)) for k in ("generalised", "removed")])
    return found.select(
        "doc_id",
        *[count("base", k) for k in PATTERNS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        F.array_join(F.filter(listed, lambda x: x != ""), ",").alias("spans"),
        *[count("terms", k) for k in ("generalised", "removed")],
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and ``clean``: the text with base spans replaced by their kinds,
    disclosing terms by ``[TERM]`` or by nothing.  Where base spans overlap, what
    begins first is replaced as far as they reach.  Rows follow ``docs``."""
    found = find(docs)
    every = F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        shown = F.when(s["kind"] == "removed", F.lit("")).otherwise(F.when(s["kind"] == "generalised", F.lit("[TERM]")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, shown).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(longer)

    walk = F.aggregate(every, zero, step)
    made = found.where(F.size("base") > 0).select("doc_id", "text_hash", F.concat(walk["out"], F.substring(F.col("text"), walk["at"] + 1, F.length("text"))).alias("clean")).dropDuplicates(["doc_id", "text_hash"])
    rows = docs.select("doc_id", "text")
    on = rows["doc_id"].eqNullSafe(F.col("d")) & (F.xxhash64(F.coalesce(rows["text"], F.lit(""))) == F.col("h"))
    return rows.join(made.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}), on, "left").select("doc_id", F.coalesce("clean", "text").alias("clean"))
