"""Benchmark decontamination by canonical templates, with DataFrame functions only.

A text is a row of words twice over: as literal words (lower case, letters and digits only) and as a
template, in which numbers, names (capitalised words inside a sentence) and units are typed
placeholders. Windows of five words of a benchmark item are looked up by the hash of either form.
A window found by its template alone counts only if the slots are consistent: along one alignment
of item and document, every value of the item must always stand for one value of the document.
That finds questions whose numbers or names were exchanged, and not other ones of the same shape.
Templates with fewer than ``LEAST_WORDS`` words between the placeholders are not looked up, and their
places do not count (unless an item has no other ones, which are then looked up as literal words).

A document contains an item if windows of at least 0.8 of the item's places are found in it. An item of
three or four words is one window of its own length, found word for word; of fewer words, it is never found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowmatch.llm.shared import Staged, free_name

WORDS = 5
SIMILARITY = 0.8
LEAST_WORDS = 3
#: Numbers of words of items that are one short window.
SHORT = (3, 4)
#: Benchmark windows that may be broadcast (24 bytes each); beyond, the join shuffles.
BROADCAST_WINDOWS = 1_000_000

#: Placeholders: private use characters, which no word keeps.
NUMBER, NAME, UNIT = "\ue001", "\ue002", "\ue003"
MARKS = NUMBER + NAME + UNIT
UNITS = (
    "km/h mph kmh km cm mm nm kg mg lb lbs oz ml cl kwh kw mw hz khz mhz ghz kb mb gb tb min mins hours hour "
    "days day weeks week months month years year seconds second minutes minute meters metres meter metre "
    "miles mile feet inches inch grams gram liters litres degrees percent dollars dollar euros euro cents "
    "usd eur gbp m g l s h"
).split()


def _literal(text: Column) -> Column:
    """Words in lower case without marks, by single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}{MARKS}\s]+", ""), r"\s+", " "))


def _template(text: Column) -> Column:
    """``text`` with placeholders; every word stays one word."""
    names = F.regexp_replace(text, r"(?<=[\p{L}\p{N},;]\s[\"'(\[„“«]?)\p{Lu}[\p{L}'’-]*\p{Ll}[\p{L}'’-]*", NAME)
    numbers = F.when(
        names.rlike("[0-9]"), F.regexp_replace(names, r"(?<![\p{L}\p{N}])\p{N}+(?:[.,:/]\p{N}+)*", NUMBER)
    ).otherwise(names)
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    return F.when(
        F.contains(numbers, F.lit(NUMBER)),
        F.regexp_replace(numbers, rf"(?i)(?<={NUMBER}[\s(\[]?)(?:{units})(?![\p{{L}}\p{{N}}])", UNIT),
    ).otherwise(numbers)


def _forms(rows: DataFrame, text: str) -> DataFrame:
    """Arrays ``words`` and ``shape`` of a text; ``shape`` is NULL without a placeholder."""
    marked = _template(F.col(text))
    has = marked.rlike(f"[{MARKS}]")
    split = rows.withColumn("words", F.split(_literal(F.col(text)), " "))
    return split.withColumn("shape", F.when(has, F.split(_literal(marked), " ")))


def _hashes(words: str, width: int = WORDS) -> Column:
    """The hash of the window that begins at each place; the last ``width - 1`` places have none."""
    w = F.col(words)
    at = F.sequence(F.lit(0), F.size(w) - width)
    hashes = F.transform(at, lambda i: F.xxhash64(*(w[i + k] for k in range(width))))
    return F.when(F.size(w) >= width, hashes).otherwise(F.array().cast("array<bigint>"))


def _fixed(window: Column) -> Column:
    """Words of a template window that are no placeholders."""
    return F.size(F.filter(window, lambda x: ~x.rlike(f"[{MARKS}]")))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per place and form of the items: item_id, place, places, hash, literal, slots (values by
    position in the window, NULL where there is no placeholder)."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).dropDuplicates()
    items = _forms(items, "text").withColumn("form", F.coalesce("shape", "words"))
    both = F.arrays_zip(_hashes("words").alias("literal"), _hashes("form").alias("shaped"))
    each = items.select("item_id", "text", "words", "form", F.posexplode(both).alias("place", "h"))
    window, values = (F.slice(c, F.col("place") + 1, F.lit(WORDS)) for c in ("form", "words"))
    each = each.withColumn("window", window).withColumn("values", values).withColumn("fixed", _fixed(F.col("window")))
    # places that a template can be looked up for; where an item has none, all its places count
    item = Window.partitionBy("item_id", "text")
    open_places = F.count_if(F.col("fixed") >= LEAST_WORDS).over(item)
    each = each.withColumn("open", open_places).withColumn("all", F.count("*").over(item))
    each = each.where((F.col("fixed") >= LEAST_WORDS) | (F.col("open") == 0))
    each = each.withColumn("places", F.when(F.col("open") == 0, F.col("all")).otherwise(F.col("open")).cast("int"))
    slots = F.transform(
        F.arrays_zip("window", "values"), lambda p: F.when(p["window"].rlike(f"[{MARKS}]"), p["values"])
    )
    columns = ["item_id", "places", "place"]
    nothing = F.lit(None).cast("array<string>")
    literal = each.select(*columns, F.col("h.literal").alias("hash"), nothing.alias("slots"))
    shaped = each.where(F.col("fixed").between(LEAST_WORDS, WORDS - 1))
    found = literal.union(shaped.select(*columns, F.col("h.shaped").alias("hash"), slots.alias("slots")))
    for width in SHORT:
        short = items.where(F.size("words") == width)
        one = F.lit(1).alias("places"), F.lit(0).alias("place"), _hashes("words", width)[0].alias("hash"), nothing.alias("slots")
        found = found.union(short.select("item_id", *one))
    return found


def _literal_hashes(short: list[int]) -> Column:
    """Hashes of the literal windows, and of those of the ``short`` widths."""
    return F.concat(_hashes("words"), *(_hashes("words", width) for width in short))


def _document_hashes(short: list[int]) -> Column:
    """Hashes of all windows of both forms."""
    literal = _literal_hashes(short)
    return F.when(F.col("shape").isNull(), literal).otherwise(F.concat(literal, _hashes("shape")))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Items found in documents: doc_id, item_id, n_windows, n_found, containment.

    Defined cases: NULL ids and NULL texts are not looked at; rows that repeat an id are one document;
    repeated items under one id count as one, under several ids as several; empty tables give an
    empty result.
    """
    windows = Staged(benchmark_windows(benchmark), "benchmark_windows").frame
    small = windows.count() <= BROADCAST_WINDOWS
    # short windows of documents are looked up only if there are such items
    sizes = benchmark.select(F.size(F.split(_literal(F.col("text")), " ")).alias("n")).where(F.col("n").isin(*SHORT))
    short = sorted(r["n"] for r in sizes.distinct().collect())
    hint = F.broadcast if small else lambda df: df
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # first pass: documents with any window in common; windows carry nothing but the id
    keys = _forms(rows, "text").select("doc_id", F.explode(_document_hashes(short)).alias("hash"))
    touched = keys.join(hint(windows.select("hash").distinct()), "hash", "left_semi").select("doc_id").distinct()
    touched = Staged(touched, "touched").frame
    # second pass over those documents: places, slots and alignment
    some = _forms(rows.join(touched, "doc_id", "left_semi"), "text").withColumn("doc_key", F.xxhash64("text"))
    literal = some.select("doc_id", F.explode(_literal_hashes(short)).alias("hash"))
    plain = windows.where(F.col("slots").isNull()).drop("slots")
    by_words = literal.join(hint(plain), "hash").select("doc_id", "item_id", "places", "place")
    shaped = some.where(F.col("shape").isNotNull())
    shaped = shaped.select("doc_id", "doc_key", "words", F.posexplode(_hashes("shape")).alias("at", "hash"))
    by_shape = shaped.join(hint(windows.where(F.col("slots").isNotNull())), "hash")
    by_shape = by_shape.select(
        "doc_id", "doc_key", "item_id", "places", "place", "slots", (F.col("at") - F.col("place")).alias("shift"),
        F.slice("words", F.col("at") + 1, F.lit(WORDS)).alias("values"),
    )
    consistent = by_shape.join(_inconsistent(by_shape), ["doc_id", "doc_key", "item_id", "shift", "place"], "left_anti")
    found = by_words.union(consistent.select("doc_id", "item_id", "places", "place"))
    n = F.countDistinct("place")
    return (
        found.groupBy("doc_id", "item_id")
        .agg(F.max("places").cast("long").alias("n_windows"), n.alias("n_found"))
        .withColumn("containment", F.col("n_found") / F.col("n_windows"))
        .where(F.col("containment") >= SIMILARITY)
    )


def _inconsistent(matches: DataFrame) -> DataFrame:
    """Windows with a slot whose item value stands for several document values along the alignment."""
    along = ["doc_id", "doc_key", "item_id", "shift"]
    pairs = matches.select(*along, "place", F.explode(F.arrays_zip("slots", "values")).alias("p"))
    pairs = pairs.where(F.col("p.slots").isNotNull()).select(*along, "place", F.col("p.slots").alias("value"), F.col("p.values").alias("as"))
    several = pairs.groupBy(*along, "value").agg(F.countDistinct("as").alias("n")).where("n > 1")
    return pairs.join(several, [*along, "value"], "left_semi").select(*along, "place").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text contains an item. Texts are told apart by their XXH64, so ids do
    not matter: rows without an id are looked at, too, and clean texts stay that share their id with a
    leaking one. Rows with a NULL text stay."""
    text, name = F.col(text_col), free_name(docs, "leak")
    texts = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("key"), text.alias("text"))
    gone = contaminated(texts, benchmark, "key", "text").select(F.col("doc_id").alias(name)).distinct()
    gone = Staged(gone, "leaks").frame
    return docs.join(gone, text.isNotNull() & (F.xxhash64(text) == F.col(name)), "left_anti")
