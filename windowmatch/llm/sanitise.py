"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Protected entities are the e-mail, IP, card and phone values found in the texts (the base spans).
A term reveals an entity as far as it occurs with it more often than by chance. Over all distinct
texts, with ``t`` a term and ``c`` an entity, n(t), n(c) and n(t, c) the texts that hold t, c and both,
and N all texts, let p(c) = n(c) / N and

    p(c | t) = (n(t, c) + A p(c)) / (n(t) + A)        disclosure = log(p(c | t) / p(c)) / log(1 / p(c))

A = ``PRIOR`` texts of no information hold back what few texts show: a term of one text alone gives away
less than one of many texts that all hold the entity, and little in a small corpus. In every document
that holds an entity, the occurrences of terms with a disclosure of at least ``THRESHOLD`` for it become
spans, besides the base spans. Copies of a text count once, so that repetition alone is no evidence.

Entities that occur in the same texts have the same disclosures and are one class, so a list of many
addresses that stand nowhere else is one class. A term is paired with the classes of a text only where it is
rare enough to reveal them: the number of different remainders of the keys of its texts, which is found by
one pass over all texts, is a lower bound of n(t). What is left is counted exactly.

``sanitise`` replaces base spans by their kind (generalised) and removes revealing terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowmatch.llm.shared import Staged, free_name
from windowmatch.llm.spans import KEY, keyed, matches, same_row

PRIOR = 0.25
THRESHOLD = 0.9
#: Terms or keys of texts that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Parts in which the texts of one entity are looked up.
SALTS = 16

#: The base patterns by kind, in the order of the digest. A run that a match must begin with is only
#: entered at its start or where the match before ended, so long runs take one pass.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
TERMS = r"\p{L}[\p{L}'’-]*+"
#: What lies between terms.
BETWEEN = r"[^\p{L}'’-]++['’-]*+|^['’-]++"
SHORTEST_TERM = 3


def _digits() -> Column:
    return F.regexp_replace("value", "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of at most 19 digits is a multiple of ten."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d) % 10 == 0


def _valid(kind: str) -> Column:
    digits = F.length(_digits())
    if kind == "ip":
        return F.col("value").rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.when(digits.between(16, 19), _luhn(_digits())).otherwise(F.lit(False))
    if kind == "phone":
        return digits.between(8, 15)
    return F.lit(True)


def _entity(kind: str) -> Column:
    """The same for every spelling of a value."""
    value = F.col("value")
    if kind == "email":
        value = F.lower("value")
    elif kind in ("card", "phone"):
        value = _digits()
    return F.concat(F.lit(f"{kind}:"), value)


def base_spans(rows: DataFrame) -> DataFrame:
    """Base spans of keyed rows: key, kind, place of the kind, start, end, entity."""
    found = None
    for place, kind in enumerate(KINDS):
        some = matches(rows, KINDS[kind]).where(_valid(kind))
        some = some.select(*KEY, F.lit(kind).alias("kind"), F.lit(place).alias("place"), "start", "end", _entity(kind).alias("entity"))
        found = some if found is None else found.union(some)
    return found


def _few(df: DataFrame) -> DataFrame:
    """``df`` for a join: broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _words(rows: DataFrame, *also: str) -> DataFrame:
    """text_key and term of every term in the rows, repeats included; splitting is cheaper than extraction."""
    words = rows.select("text_key", *also, F.explode(F.split("text", BETWEEN)).alias("term"))
    return words.select("text_key", *also, F.lower("term").alias("term")).where(F.length("term") >= SHORTEST_TERM)


def _disclosure(n_both: Column, n_term: Column, n_entity: Column, total: int) -> Column:
    """The share of an entity's information that a term gives away; NULL if all texts hold the entity."""
    p = n_entity / F.lit(float(total))
    given = (n_both + PRIOR * p) / (n_term + F.lit(PRIOR))
    return F.when(p < 1, F.least(F.lit(1.0), F.log(given / p) / -F.log(p)))


def entity_classes(spans: DataFrame) -> DataFrame:
    """text_key, class, n_entity: the classes of entities of every text that holds one. A class is known by
    the number of its texts and two hashes of their keys."""
    held = Staged(spans.select("entity", "text_key").distinct(), "held").frame
    texts = [F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("text_key")).alias("one"), F.bit_xor(F.xxhash64("text_key", F.lit(2))).alias("two")]
    classes = held.groupBy("entity").agg(*texts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = held.withColumn("salt", F.pmod("text_key", F.lit(SALTS)).cast("int"))
    joined = salted.join(classes, ["entity", "salt"])
    return joined.select("text_key", F.struct("n_entity", "one", "two").alias("class"), "n_entity").distinct()


def revealing_terms(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs (text_key, term): the terms to go in every text that holds an entity."""
    total = rows.select("text_key").distinct().count()
    classes = Staged(entity_classes(spans), "classes").frame
    # the largest class of a text allows the most texts of a term
    largest = classes.groupBy("text_key").agg(F.max("n_entity").alias("n_entity"))
    holders = rows.join(_few(largest), "text_key")
    near = Staged(_words(holders, "n_entity").distinct(), "near").frame
    # remainders of the keys of a term's texts as bits: no more than n(t), and one number a term to shuffle
    bits = F.bit_or(F.expr("shiftleft(1L, cast(pmod(text_key, 64) as int))"))
    seen = _words(rows).join(_few(near.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.bit_count(bits).alias("least"))
    seen = Staged(seen, "seen").frame
    enough = _disclosure(F.col("n_entity"), F.col("least"), F.col("n_entity"), total) >= THRESHOLD
    rare = near.join(_few(seen), "term").where(enough).drop("n_entity")
    pairs = rare.join(classes, "text_key").where(enough)
    pairs = Staged(pairs.select("text_key", "term", "class", "n_entity", "least"), "pairs").frame
    both = pairs.groupBy("class", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("least").alias("least"))
    likely = _disclosure(F.col("n_both"), F.col("least"), F.col("n_entity"), total) >= THRESHOLD
    both = Staged(both.where(likely).drop("least"), "both").frame
    with_term = _words(rows).join(_few(both.select("term").distinct()), "term", "left_semi").distinct()
    with_term = with_term.groupBy("term").agg(F.count("*").alias("n_term"))
    disclosure = _disclosure(F.col("n_both"), F.col("n_term"), F.col("n_entity"), total)
    revealing = Staged(both.join(with_term, "term").where(disclosure >= THRESHOLD).select("class", "term"), "revealing").frame
    return pairs.join(_few(revealing), ["class", "term"], "left_semi").select("text_key", "term").distinct()


def term_spans(rows: DataFrame, spans: DataFrame, revealing: DataFrame) -> DataFrame:
    """Occurrences of the revealing terms of each text, outside base spans: key, start, end."""
    some = rows.join(_few(revealing.select("text_key").distinct()), "text_key", "left_semi").select(*KEY, "text")
    words = matches(some, TERMS).withColumn("term", F.lower("value"))
    found = words.join(_few(revealing), ["text_key", "term"], "left_semi").select(*KEY, "start", "end")
    covers = spans.select(*KEY, F.col("start").alias("from"), F.col("end").alias("to"))
    inside = same_row(found, covers) & (F.col("start") < F.col("to")) & (F.col("end") > F.col("from"))
    return found.join(covers, inside, "left_anti")


def all_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and added spans: key, kind, place of the kind, start, end."""
    rows = keyed(docs, id_col, text_col)
    spans = Staged(base_spans(rows), "base_spans").frame
    revealing = Staged(revealing_terms(rows, spans), "revealing").frame
    added = term_spans(rows, spans, revealing)
    columns = [*KEY, "kind", "place", "start", "end"]
    added = added.withColumn("kind", F.lit(TERM)).withColumn("place", F.lit(len(KINDS)))
    return spans.select(*columns).union(added.select(*columns))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, a count ``n_<kind>`` of each base kind and of terms, and
    ``spans``, an array of (place, start, end, kind), base kinds first.

    Defined cases: a NULL text is empty; a NULL id is an id; repeated rows give equal results; an empty
    table gives an empty result; columns besides id and text are not read.
    """
    spans = Staged(all_spans(docs, id_col, text_col), "spans").frame
    listed = F.array_sort(F.collect_list(F.struct("place", "start", "end", "kind"))).alias("spans")
    by_row = spans.groupBy(*KEY).agg(listed)
    keys = keyed(docs, id_col, text_col).drop("text")
    joined = keys.join(by_row.toDF("other_id", "other_key", "spans"), F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_key") == F.col("other_key")), "left")
    every = F.coalesce("spans", F.array().cast("array<struct<place:int,start:bigint,end:bigint,kind:string>>"))
    rows = joined.select("doc_id", "text_key", every.alias("spans"))
    counts = [_number(kind).alias(f"n_{kind}") for kind in (*KINDS, TERM)]
    return rows.select("doc_id", *counts, "spans")


def _number(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def digest(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["place"] < len(KINDS))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with base spans generalised to [KIND] and revealing terms removed. Spans of two base kinds
    that overlap are replaced as one, by the first kind. All rows and columns stay; a NULL text stays."""
    spans = Staged(all_spans(docs, id_col, text_col), "spans").frame
    listed = F.array_sort(F.collect_set(F.struct("start", "end", "place", "kind")))
    row_id, row_key, row_spans = (free_name(docs, f"span_{c}") for c in ("id", "key", "list"))
    by_row = spans.groupBy(*KEY).agg(listed).toDF(row_id, row_key, row_spans)
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.join(by_row, F.col(id_col).eqNullSafe(F.col(row_id)) & (key == F.col(row_key)), "left")

    def step(state: Column, s: Column) -> Column:
        label = F.when(s["kind"] == TERM, F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        apart = s["start"] >= state["at"]
        between = F.substring(F.col(text_col), state["at"].cast("int") + 1, (s["start"] - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(state["text"], between, label)).otherwise(state["text"]).alias("text"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    rest = F.aggregate(row_spans, start, step, lambda s: F.concat(s["text"], F.substring(F.col(text_col), s["at"].cast("int") + 1, F.length(text_col))))
    return joined.withColumn(text_col, F.when(F.col(row_spans).isNull(), F.col(text_col)).otherwise(rest)).select(*docs.columns)
