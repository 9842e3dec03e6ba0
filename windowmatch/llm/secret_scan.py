"""Secret scan: candidate strings judged by a random forest, with DataFrame functions and Spark ML.

Candidates are runs of at least ``SHORTEST`` characters of the alphabets that keys are written in, and
any value without blanks, however short, that is assigned or quoted behind a word for credentials, or is the
password of a URL. A forest over their length, characters and transitions between kinds of characters,
coverage by words of the corpus, path signs and neighbouring words removes the false positives.

The forest is trained on labelled findings: rows of candidates with their context and a label.
``weak_labels`` makes them from documents, a sample of at most ``LABELLED`` rows: a value assigned to a
word for credentials, the password of a URL or a known kind of key is a secret; uuids, checksums beside their
name, Luhn numbers, public keys, paths and names made of words of the corpus are none; all else has no label.
``examples`` adds made-up ones of both kinds, so that a table without any labelled finding can be scanned
too. In a part of the training rows the signs that the labels were made from are hidden (``masked``), so
that the value itself has to tell. Plain hexadecimal is not masked: bare, a key and a checksum look alike.
Scanning and the counts of the dictionary cover all texts.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windowmatch.llm.shared import Staged, by_hash, free_name
from windowmatch.llm.spans import KEY, keyed, matches

SHORTEST = 16
BEFORE, AFTER = 48, 16
CREDENTIAL = r"(?:token|secret|passw(?:or)?d|pwd|passphrase|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|bearer|credential)s?"
#: What stands between such a word and its value; bounded, as it is looked for behind.
_ASSIGNED = rf"(?i:{CREDENTIAL})[\"'`\])]{{0,2}}\s{{0,3}}(?::|=|:=|=>)\s{{0,3}}"
_QUOTED = rf"(?i:{CREDENTIAL})[\"'`\])]{{0,2}}\s{{0,3}}(?::|=|:=|=>)?\s{{0,3}}"
VALUE = (
    rf"(?<=\")(?<={_QUOTED}\")[^\s\"]+|(?<=')(?<={_QUOTED}')[^\s']+|(?<=`)(?<={_QUOTED}`)[^\s`]+"
    rf"|(?<=[:=>\s])(?<={_ASSIGNED})[^\s\"'`:=>][^\s\"'`]*(?<![.,;])"
)
#: What stands before the password of a URL.
USER = r"[A-Za-z][A-Za-z0-9+.-]{1,16}://[^\s:/@]{0,64}:"
PASSWORD = rf"(?<=:)(?<={USER})[^\s/@\"'`<>]+(?=@[A-Za-z0-9\[])"
CANDIDATE = rf"{VALUE}|{PASSWORD}|(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{{{SHORTEST},}}+(?:={{1,2}}(?![A-Za-z0-9_+/=\"'`-]))?"
IDENTIFIER = r"(?:commit|hash|checksum|digest|sha\d*|md5|uuid|guid|isbn|order|invoice|card|account|phone|tel|version|build|rev)"
#: Kinds of keys that are known by their form.
FORMAT = (
    r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{32,}|AIza[A-Za-z0-9_-]{35}"
    r"|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{16,}.*)$"
)
#: How the base64 form of public keys of SSH begins.
PUBLIC = "^AAAA[BCE][0-9A-Za-z]{2,}"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Share of the training rows, by value, whose context and format are hidden.
MASKED = 0.5
#: Bound of the labelled sample, and how often a word must occur to be in the dictionary.
LABELLED = 20_000
FREQUENT = 5
TREES, DEPTH = 20, 6
REDACTED = "[SECRET]"
#: Words of made-up names.
NAMES = "user order status handler config value update message request server build image table index session report".split()
BROADCAST_RUNS = 500_000
#: Parts of the rows of one value.
PARTS = 32

FEATURES = (
    "size digits upper lower hexadecimal kinds transitions distinct longest covered slashes after_slash "
    "named assigned quoted identified padded formatted symbols syntax userinfo public"
).split()


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidates of all texts with their places and context."""
    found = matches(keyed(docs, id_col, text_col), CANDIDATE, BEFORE, AFTER)
    # a long name before a value is a candidate too, and is context of the value
    order = Window.partitionBy(*KEY).orderBy("start")
    touching = F.col("start") - F.lag("end").over(order) == F.length("left")
    name = F.when(touching, F.lag("value").over(order))
    return found.withColumn("left", F.right(F.concat(F.coalesce(name, F.lit("")), "left"), F.lit(BEFORE)))


def dictionary(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """Letter runs (``run``) of the candidates that are frequent words of all texts."""
    runs = found.select(F.explode(_runs()).alias("run")).distinct()
    runs = Staged(runs, "runs").frame
    hint = F.broadcast if runs.count() <= BROADCAST_RUNS else lambda df: df
    plain = F.regexp_replace(F.lower(F.col(text_col)), r"[.,;:!?|*$&%#\"'()]+", "")
    words = docs.select(F.explode(F.split(plain, r"\s+")).alias("run")).where(F.length("run") >= 3)
    return words.join(hint(runs), "run", "left_semi").groupBy("run").count().where(F.col("count") >= FREQUENT).select("run")


def _runs() -> Column:
    return F.regexp_extract_all(F.lower(F.col("value")), F.lit("[a-z]{3,}"), F.lit(0))


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the features of the forest; ``words`` is the dictionary."""
    # a frequent value is looked up in some parts, so that no task has all of its rows
    part = F.pmod(F.xxhash64(*found.columns), F.lit(PARTS)).alias("part")
    parted = found.select("*", part)
    runs = parted.select("value", "part").distinct().select("value", "part", F.explode(_runs()).alias("run"))
    covered = runs.join(words, "run").groupBy("value", "part").agg(F.sum(F.length("run")).alias("known"))
    turns = r"(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    has = lambda column, pattern: F.col(column).rlike(pattern).cast("double")
    kinds = sum((has("value", p) for p in ("[0-9]", "[a-z]", "[A-Z]", "[_+/=-]")), F.lit(0.0))
    rows = parted.join(covered, ["value", "part"], "left").select(
        *found.columns,
        F.length("value").cast("double").alias("size"),
        _share("[0-9]").alias("digits"),
        _share("[A-Z]").alias("upper"),
        _share("[a-z]").alias("lower"),
        _share("[0-9a-fA-F]").alias("hexadecimal"),
        kinds.alias("kinds"),
        _share(turns).alias("transitions"),
        F.size(F.array_distinct(F.split("value", ""))).cast("double").alias("distinct"),
        F.coalesce(
            F.array_max(F.transform(F.regexp_extract_all("value", F.lit("[A-Za-z]+"), F.lit(0)), lambda r: F.length(r))),
            F.lit(0),
        ).cast("double").alias("longest"),
        F.least(F.lit(1.0), F.coalesce(F.col("known") / F.length("value"), F.lit(0.0))).alias("covered"),
        _share("/").alias("slashes"),
        has("left", r"[/.\\]$").alias("after_slash"),
        has("left", rf"(?i){CREDENTIAL}[^\p{{L}}\p{{N}}]{{0,16}}$").alias("named"),
        has("left", r"[=:][^\p{L}\p{N}]{0,8}$").alias("assigned"),
        has("left", "[\"'`]$").alias("quoted"),
        has("left", rf"(?i)\b{IDENTIFIER}[^\p{{L}}\p{{N}}]{{0,8}}$").alias("identified"),
        has("value", "=$").alias("padded"),
        has("value", FORMAT).alias("formatted"),
        _share("[^A-Za-z0-9_+/=-]").alias("symbols"),
        _share(r"[()\[\]{}<>]|\.(?=[A-Za-z])").alias("syntax"),
        has("left", rf"{USER}$").alias("userinfo"),
        has("value", PUBLIC).alias("public"),
    )
    return rows


def _rule() -> Column:
    """1 for a known secret, 0 for what is positively something else, NULL for what is not known."""
    plain = F.col("covered") >= 0.6
    number = (F.col("digits") == 1) & F.call_function("luhn_check", F.col("value"))
    checksum = (F.col("hexadecimal") == 1) & (F.col("identified") == 1)
    path = (F.col("slashes") > 0) & (F.col("covered") >= 0.3) & (F.col("named") == 0)
    other = F.col("value").rlike(UUID) | (F.col("public") == 1) | number | checksum | path | (plain & (F.col("named") == 0)) | (F.col("covered") >= 0.9)
    given = ((F.col("named") == 1) & (F.col("assigned") == 1)) | (F.col("userinfo") == 1)
    secret = (F.col("formatted") == 1) | (given & ~plain & (F.col("public") == 0))
    return F.when(secret & ~number, 1.0).when(other, 0.0)


def masked(rows: DataFrame) -> DataFrame:
    """Described findings with labels, and again a share ``MASKED`` of them without the signs beside and
    of the format; for what is not plain hexadecimal."""
    hidden = rows.where(by_hash(F.col("value"), MASKED) & (F.col("hexadecimal") < 1))
    signs = {c: F.lit(0.0) for c in ("named", "assigned", "quoted", "formatted")}
    return rows.union(hidden.withColumns(signs).select(*rows.columns))


def weak_labels(features: DataFrame, most: int = LABELLED) -> DataFrame:
    """A sample of at most ``most`` described findings that a rule can label: ``label`` 1 or 0.

    The share is set by the number of findings; the limit holds where the hash is uneven.
    """
    distinct = features.dropDuplicates(["value"])
    known = distinct.withColumn("label", _rule()).where("label IS NOT NULL").select(*FEATURES, "label", "value")
    share = min(1.0, most / max(1, features.count()))
    return known.where(by_hash(F.col("value"), share)).orderBy(F.xxhash64("value")).limit(most)


def examples(spark: SparkSession, each: int = 300) -> DataFrame:
    """Made-up findings (value, left, right, label): keys beside words for credentials, keys of known
    formats and random base64 beside anything, and numbers, checksums, paths, versions and names beside
    other words."""
    key = F.sha2(F.concat(F.lit("key"), F.col("id").cast("string")), 256)
    other = F.sha2(F.concat(F.lit("other"), F.col("id").cast("string")), 256)
    digits = F.regexp_replace(other, "[a-f]", "7")
    mixed = F.regexp_replace(F.base64(F.unhex(key)), "[^A-Za-z0-9+/=]", "")
    letters = F.regexp_replace(mixed, "[^A-Za-z0-9]", "")
    lefts = F.element_at(F.array(*map(F.lit, ["see ", "| ", "\n", "?k=", 'x = "', "(", "https://host/"])), (F.col("id") % 7 + 1).cast("int"))
    words = F.array(*map(F.lit, NAMES))
    pick = lambda i: F.element_at(words, F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(NAMES))).cast("int") + 1)
    kinds = [
        (F.concat(F.lit("AKIA"), F.upper(F.substring(letters, 1, 16))), lefts, 1.0),
        (F.concat(F.lit("ghp_"), F.rpad(letters, 36, "a9")), lefts, 1.0),
        (F.concat(F.lit("xoxb-"), F.substring(digits, 1, 12), F.lit("-"), F.substring(letters, 1, 24)), lefts, 1.0),
        (F.concat(F.lit("sk_live_"), F.substring(letters, 1, 24)), lefts, 1.0),
        (F.concat(mixed, F.substring(mixed, 3, 20)), lefts, 1.0), (F.substring(letters, 1, 32), lefts, 1.0),
        (F.concat(F.initcap(pick(1)), F.substring(digits, 1, 2), F.lit("!"), F.substring(letters, 1, 2)), 'password = "', 1.0),
        (F.concat(F.substring(letters, 1, 4), F.lit("."), F.substring(letters, 5, 3), F.lit("@"), F.substring(digits, 1, 3)), "pwd: ", 1.0),
        (F.concat(pick(1), F.substring(digits, 1, 3)), "passwd=", 1.0), (F.substring(letters, 1, 10), "secret = '", 1.0),
        (F.regexp_replace(letters, "[0-9]", ""), lefts, 1.0), (F.regexp_replace(F.substring(letters, 1, 20), "[0-9]", ""), 'api_key = "', 1.0),
        (F.substring(key, 1, 12), "token: ", 1.0), (pick(1), "password: ", 0.0), (pick(2), "token = ", 0.0),
        (F.concat(F.lit("get"), F.initcap(pick(1)), F.lit("()")), "token = ", 0.0),
        (F.concat(pick(1), F.lit("."), pick(2), F.lit("["), pick(3), F.lit("]")), "password = ", 0.0),
        (F.concat(F.lit("${"), F.upper(pick(1)), F.lit("}")), 'secret: "', 0.0),
        (F.concat_ws("_", pick(1), pick(2), pick(3), pick(4)), lefts, 0.0),
        (F.concat_ws("-", pick(1), pick(2), pick(3), F.col("id").cast("string")), lefts, 0.0),
        (F.concat(F.initcap(pick(1)), F.initcap(pick(2)), F.initcap(pick(3)), F.initcap(pick(4))), lefts, 0.0),
        (F.concat(pick(1), pick(2), pick(3), pick(4)), lefts, 0.0),
        (F.concat_ws("/", pick(1), pick(2), pick(3), F.concat(pick(4), F.col("id").cast("string"))), lefts, 0.0),
        (F.upper(F.concat_ws("_", pick(1), pick(2), pick(3), F.col("id").cast("string"))), lefts, 0.0),
        (F.substring(key, 1, 40), 'token = "', 1.0), (F.upper(F.substring(key, 1, 40)), 'TOKEN = "', 1.0),
        (mixed, "secret: ", 1.0), (F.substring(key, 1, 32), "api_key='", 1.0),
        (F.substring(mixed, 1, 24), "password = ", 1.0), (F.substring(digits, 1, 16), "thon to ", 0.0),
        (F.concat(F.substring(letters, 1, 10)), "see postgres://bob:", 1.0), (F.concat(pick(1), F.substring(digits, 1, 4)), "https://user:", 1.0),
        (pick(1), "amqp://user:", 0.0), (F.concat(F.lit("${"), F.upper(pick(1)), F.lit("}")), "mysql://root:", 0.0),
        (F.concat(F.lit("AAAAB3NzaC1yc2E"), mixed, F.substring(mixed, 3, 40)), "ssh-rsa ", 0.0),
        (F.concat(F.lit("AAAAC3NzaC1lZDI1NTE5"), mixed), "ssh-ed25519 ", 0.0),
        (F.substring(other, 1, 40), lefts, 0.0), (other, lefts, 0.0),
        (F.substring(digits, 1, 16), "card ", 0.0), (F.substring(other, 1, 40), "commit ", 0.0),
        (F.concat(F.lit("static/images/photo-"), F.substring(digits, 1, 6)), "see /", 0.0),
        (F.concat(F.lit("release_candidate_"), F.substring(digits, 1, 3)), "the ", 0.0),
        (F.concat_ws("-", F.substring(other, 1, 8), F.substring(other, 9, 4), F.substring(other, 13, 12)), "uuid: ", 0.0),
    ]
    # one plan for all kinds, kind after kind: a plan for each of them is a class each that the driver compiles and keeps
    rows = spark.range(0, each * len(kinds), 1, 2).select((F.col("id") % each).alias("id"), F.floor(F.col("id") / each).alias("kind"))
    values, lefts, labels = zip(*kinds)
    return rows.select(
        _of_kind(values).alias("value"), _of_kind(lefts).alias("left"), F.lit(" ").alias("right"), _of_kind(labels).alias("label")
    )


def _of_kind(given: tuple) -> Column:
    """What is given for the row's ``kind``."""
    chosen = F
    for i, one in enumerate(given[:-1]):
        chosen = chosen.when(F.col("kind") == i, one)
    return chosen.otherwise(given[-1])


def train(labelled: DataFrame) -> RandomForestClassificationModel:
    """Fit the forest on described findings with a label."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(labelled)
    forest = RandomForestClassifier(
        featuresCol="__features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=11, maxMemoryInMB=64
    )
    return forest.fit(rows.select("__features", "label"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """Findings that the forest takes for secrets: key, value, start, end, probability.

    ``labelled``: described findings with labels, instead of the weak ones. Defined cases: NULL and
    empty texts have no finding, a NULL id is an id, repeated rows are scanned once.
    """
    found = Staged(candidates(docs, id_col, text_col), "candidates").frame
    words = Staged(dictionary(docs, found, text_col), "dictionary").frame
    features = Staged(described(found, words), "findings").frame
    made = Staged(examples(docs.sparkSession).coalesce(2), "examples").frame
    made = described(made, words).select(*FEATURES, "label", "value")
    if labelled is None:
        rows = masked(Staged(made.union(weak_labels(features)).coalesce(4), "labelled").frame).select(*FEATURES, "label")
    else:
        rows = Staged(masked(made).select(*FEATURES, "label").union(labelled.select(*FEATURES, "label")), "labelled").frame
    model = train(rows)
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(features))
    scored = scored.withColumn("probability", vector_to_array("probability")[1])
    return scored.where("probability > 0.5").select(*KEY, "value", "start", "end", "probability")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by ``REDACTED``; all rows and columns stay."""
    spans = F.reverse(F.array_sort(F.collect_set(F.struct("start", F.length("value").alias("size")))))
    found = scan(docs, id_col, text_col).groupBy(*KEY).agg(spans.alias("spans"))
    row_id, row_key, row_spans = (free_name(docs, f"secret_{c}") for c in ("id", "key", "spans"))
    found = Staged(found, "secrets").frame.toDF(row_id, row_key, row_spans)
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col(row_id)) & (key == F.col(row_key)), "left")
    clean = F.aggregate(
        row_spans,
        F.col(text_col),
        lambda text, s: F.overlay(text, F.lit(REDACTED), s["start"].cast("int") + 1, s["size"]),
    )
    clean = F.when(F.col(row_spans).isNull(), F.col(text_col)).otherwise(clean)
    return joined.withColumn(text_col, clean).select(*docs.columns)
