"""Entry points: the flagship query, every query, and the same queries as SQL."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from typing import Any

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_statements
from oracle_statements import LONG_N, N, SAMPLES, SEED
from windowmatch.config import SearchColumns
from windowmatch.functions import matrix
from windowmatch.functions.times import micros, parse_time
from windowmatch.operators import numbering, range_join, scan, series, topk, upsert, windows
from windowmatch.operators.layout import TILE, lay_out
from windowmatch.plans import search, similarity, steps
from windowmatch.sources import bar_files, lines, tables
from windowmatch.sources.trades import bars_from_trades
from windowmatch.staging import fresh_path, fresh_table, stage

try:  # the one place that works without the subpackage and its pipeline
    import corpus_pipeline
    import windowmatch.llm.queries as llm
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith(("windowmatch.llm", "corpus_pipeline")):
        raise
    corpus_pipeline = llm = None

COLS = SearchColumns()
WIDTH = len(COLS.match)
FLAGSHIP_DIR = "/root/testdata/sf0.001"

Query = Callable[[SparkSession, str], DataFrame]

_tables: dict[tuple, Any] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(spark: SparkSession, key: tuple, make: Callable[[], Any]) -> Any:
    """Bars, windows and files are written once per application, then queried."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _tables:
        _tables[key] = make()
    return _tables[key]


def derive_bars(spark: SparkSession, sf_dir: str, unit: str = "month", where: str = "true") -> DataFrame:
    """Bars from ``lineitem``: a supplier is a security, a unit price is a price."""
    return bars_from_trades(
        _table(spark, sf_dir, "lineitem").where(where),
        sid=F.col("l_suppkey"),
        time=F.col("l_shipdate"),
        price=F.col("l_extendedprice") / F.col("l_quantity"),
        quantity=F.col("l_quantity"),
        order=("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"),
        unit=unit,
    )


def bars_of(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """The bars table of the queries, laid out in tiles."""
    return _once(
        spark, (sf_dir, unit, "bars"), lambda: lay_out(derive_bars(spark, sf_dir, unit), COLS)
    )


def windows_of(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """The windows table of the queries: every window of N bars."""
    return _once(
        spark,
        (sf_dir, unit, "windows"),
        lambda: stage(windows.all_windows(bars_of(spark, sf_dir, unit), COLS, N), "windows"),
    )


def _with_exchange(
    spark: SparkSession, sf_dir: str, bars: DataFrame, pre_close: Column, *extra: str
) -> DataFrame:
    """Bars in the shape of the bars table; the nation of the supplier is the exchange."""
    supplier, nation = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    place = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    return bars.join(place, F.col("s_suppkey") == F.col("sid")).select(
        F.col("sid").cast("int").alias("sid"),
        F.col("n_name").alias("exchangeCD"),
        "datetime",
        *COLS.match,
        pre_close.alias("pre_close"),
        "volume",
        *extra,
    )


def r6(value: Column, name: str) -> Column:
    """Six decimals, by the same steps as in the SQL; minus zero becomes zero."""
    rounded = F.round(value * 1e6) / 1e6
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded).alias(name)


def _scored(scores: DataFrame) -> DataFrame:
    return scores.select(*COLS.window_key, r6(F.col("similarity"), "similarity"))


# Scans, sources and sinks


def row_count(spark, sf_dir):
    return scan.row_count(_table(spark, sf_dir, "lineitem"))


def line_scan(spark, sf_dir):
    path = fresh_path(spark, "lines")
    lines.write_lines(_table(spark, sf_dir, "documents").select("text"), path)
    return lines.read_lines(spark, path)


def bars_scan(spark, sf_dir):
    return scan.project(bars_of(spark, sf_dir), COLS, "volume")


def bars_by_sid(spark, sf_dir):
    return scan.project(scan.by_sid(bars_of(spark, sf_dir), COLS, 7), COLS)


def stored_bars(spark, sf_dir) -> DataFrame:
    """The same bars in a bars table, which is split by month."""

    def write() -> str:
        table = fresh_table(spark, "stored")
        tables.create_bars_table(spark, table)
        tables.append_bars(spark, table, _with_exchange(spark, sf_dir, bars_of(spark, sf_dir), F.col("open")), COLS)
        return table

    return tables.read_bars(spark, _once(spark, (sf_dir, "stored"), write))


def bars_time_range(spark, sf_dir):
    bars = scan.by_time(stored_bars(spark, sf_dir), COLS, "1996-01-01", "1997-06-01")
    return scan.project(bars, COLS)


def bars_semi_sids(spark, sf_dir):
    drawn = windows.draw_windows(bars_of(spark, sf_dir), COLS, N, SAMPLES, SEED)
    return scan.project(scan.of_sampled_sids(bars_of(spark, sf_dir), drawn, COLS), COLS)


def distinct_sids(spark, sf_dir):
    return scan.distinct_sids(bars_of(spark, sf_dir), COLS)


def sid_list(spark, sf_dir):
    return scan.sid_lists(bars_of(spark, sf_dir), COLS, width=32)


def sid_series(spark, sf_dir):
    numbered = series.positions(bars_of(spark, sf_dir), COLS)
    return numbered.select("sid", F.col("pos").cast("long").alias("pos"), "datetime", *COLS.match)


def bars_shuffled(spark, sf_dir):
    bars = scan.project(bars_of(spark, sf_dir), COLS)
    return numbering.shuffled(bars, ["sid", micros(bars, "datetime")], SEED)


def bars_union(spark, sf_dir):
    return upsert.concat(
        [
            derive_bars(spark, sf_dir, where="l_returnflag = 'R'"),
            derive_bars(spark, sf_dir, where="l_returnflag <> 'R'"),
        ]
    )


def _delta(spark, sf_dir):
    returned = derive_bars(spark, sf_dir, where="l_returnflag = 'R'")
    later = returned.withColumn("datetime", F.col("datetime") + F.make_ym_interval(months=F.lit(1)))
    final = derive_bars(spark, sf_dir, where="l_linestatus = 'F'")
    return upsert.concat(
        [later.withColumn("seq", F.lit(1)), final.withColumn("seq", F.lit(2))]
    )


def bars_upsert(spark, sf_dir):
    base = bars_of(spark, sf_dir).drop(TILE)
    return upsert.upsert(base, _delta(spark, sf_dir), COLS.bar_key(base), seq="seq")


def bars_table(spark, sf_dir):
    table = fresh_table(spark, "daybars")
    tables.create_bars_table(spark, table)
    base = _with_exchange(spark, sf_dir, bars_of(spark, sf_dir), F.col("open"))
    tables.append_bars(spark, table, base, COLS)
    delta = _with_exchange(spark, sf_dir, _delta(spark, sf_dir), F.col("open"), "seq")
    tables.upsert_into(spark, table, delta, COLS, seq="seq")
    return tables.read_bars(spark, table)


def bulk_load(spark, sf_dir):
    path, table = fresh_path(spark, "export"), fresh_table(spark, "src")
    spark.sql(f"CREATE TABLE {table} (key BIGINT, value STRING) USING parquet")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    rows.write.option("sep", "\x01").option("quote", "").option("nullValue", "\\N").csv(path)
    tables.load_data(spark, path, table)
    return spark.table(table)


def csv_files(spark, sf_dir) -> str:
    """The folder of bar files that ``csv_ingest`` reads, written once per application."""

    def write() -> str:
        path = fresh_path(spark, "barfiles")
        pre_close = F.when(F.col("volume") > 30, F.col("open"))
        bars = _with_exchange(spark, sf_dir, bars_of(spark, sf_dir), pre_close)
        bar_files.write_bar_files(bars, path, name_column="file")
        return path

    return _once(spark, (sf_dir, "csv"), write)


def csv_ingest(spark, sf_dir):
    header = ["datetime", *bar_files.VENDOR_NAMES]
    raw = bar_files.read_bar_files(spark, csv_files(spark, sf_dir), header=header, name_column="file")
    loaded, _ = bar_files.parse_bars(raw)
    return loaded.drop(bar_files.SEQ)


def csv_ingest_mixed(spark, sf_dir):
    """Files with two orders of columns, under folders that hold equal file names."""
    pre_close = F.when(F.col("volume") > 30, F.col("open"))
    bars = _with_exchange(spark, sf_dir, bars_of(spark, sf_dir), pre_close)
    names = bar_files.VENDOR_NAMES
    text = bars.select(
        F.concat("sid", F.lit("."), "exchangeCD", F.lit(".csv")).alias("file"),
        F.date_format("datetime", "dd/MM/yyyy").alias("datetime"),
        *(F.col(column).alias(vendor) for vendor, column in names.items()),
    )
    path = fresh_path(spark, "mixed")
    for half, order in enumerate((["datetime", *names], [*reversed(names), "datetime"])):
        some = text.where(F.crc32(F.col("datetime").cast("binary")) % 2 == half)
        bar_files.write_named_files(some.select("file", *order), f"{path}/{half}", "file")
    raw = bar_files.read_mixed_bar_files(spark, path, nested=True)
    folder = F.url_decode(F.regexp_extract("_seq.file_path", "/file=([^/]*)/", 1))
    loaded, _ = bar_files.parse_bars(raw.withColumn("file_name", folder), time_format="%d/%m/%Y")
    return loaded.drop(bar_files.SEQ)


#: Formats of ``time_parse``: strptime, the pattern that writes it.
TIME_FORMATS = (
    ("%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss"),
    ("%d/%m/%Y", "d/M/yyyy"),
    ("%y%m%d", "yyMMdd"),
    ("%m/%d/%Y %I:%M %p", "MM/dd/yyyy hh:mm a"),
    ("%Y-%m-%d", "d-MMM-yyyy"),
    ("%Y-%m-%d", "MMMM d, yyyy HH:mm"),
    ("%Y-%m-%d", "yyyyMMdd HHmm"),
    ("%Y-%m-%d", "yyyy.MM.dd"),
    ("%Y-%j", "yyyy-DDD"),
    ("%Y-%m-%d", "MMM d HH:mm:ss yyyy"),
    ("%Y-%m-%d", "yyyyMMddHHmmss"),
    ("%Y-%m-%d", "yyyy-MM-dd hha"),
)


def time_parse(spark, sf_dir):
    """Ship dates written in several forms and read again."""
    rows = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp_ntz").alias("at")
    )
    forms = [
        parse_time(F.date_format("at", pattern), strptime).alias(f"t{i}")
        for i, (strptime, pattern) in enumerate(TIME_FORMATS)
    ]
    return rows.select("l_orderkey", "l_linenumber", *forms)


def bars_import(spark, sf_dir):
    """An upsert in which every key comes twice: the later row counts."""
    table = fresh_table(spark, "imported")
    tables.create_bars_table(spark, table)
    base = _with_exchange(spark, sf_dir, bars_of(spark, sf_dir), F.col("open"))
    first = base.withColumn("open", F.col("open") + 1000).withColumn("seq", F.lit(1))
    tables.upsert_into(spark, table, first.unionByName(base.withColumn("seq", F.lit(2))), COLS, seq="seq")
    return tables.read_bars(spark, table)


def bars_bulk_load(spark, sf_dir):
    """A headerless export of bars, loaded in the order of its columns."""
    path, table = fresh_path(spark, "bars"), fresh_table(spark, "loaded")
    base = _with_exchange(spark, sf_dir, bars_of(spark, sf_dir), F.col("open"))
    base.select(*tables.BARS_FILE_ORDER).write.csv(path)
    tables.create_bars_table(spark, table)
    tables.load_bars(spark, path, table)
    return tables.read_bars(spark, table)


# Windows


def windows_all(spark, sf_dir):
    return windows.all_windows(bars_of(spark, sf_dir), COLS, N)


def windows_table(spark, sf_dir):
    place = fresh_table(spark, "windows").split(".")
    name = tables.replace_windows(
        windows_all(spark, sf_dir), N, COLS.with_table("", place[0]), prefix=place[1]
    )
    return spark.table(name)


def namespace_windows(spark, sf_dir):
    """A windows table in a namespace that is dropped with what it holds and created again."""
    name = f"windowmatch_reset_{uuid.uuid4().hex}"
    place = fresh_path(spark, name)
    try:
        for rows in (windows_of(spark, sf_dir).limit(1), windows_of(spark, sf_dir)):
            tables.reset_namespace(spark, name, place)
            tables.create_windows_table(spark, "found")
            rows.select(*(F.col(f.name).cast(f.dataType) for f in tables.WINDOWS_SCHEMA)).write.insertInto("found")
    finally:
        spark.sql("USE default")
    return spark.table(f"{name}.found")


def windows_limit(spark, sf_dir):
    return spark.sql(
        "SELECT * FROM {windows} ORDER BY sid, begintime, endtime LIMIT 500",
        windows=windows_of(spark, sf_dir),
    )


def windows_indexed(spark, sf_dir):
    found = stage(series.runs(bars_of(spark, sf_dir), COLS, N), "runs")
    return series.with_index(found, COLS).select(*COLS.window_key, "sample_id")


def windows_sample(spark, sf_dir):
    return windows.draw_windows(bars_of(spark, sf_dir), COLS, N, SAMPLES, SEED)


def pattern_split(spark, sf_dir):
    head, tail = windows.split_pattern(windows_of(spark, sf_dir), COLS)
    parts = upsert.concat(
        [head.withColumn("part", F.lit("pattern")), tail.withColumn("part", F.lit("sample"))]
    )
    return parts.select(*COLS.window_key, "part")


def window_bars(spark, sf_dir):
    return range_join.window_bars(bars_of(spark, sf_dir), windows_of(spark, sf_dir), COLS)


def window_bars_grouped(spark, sf_dir):
    return range_join.window_bars(
        bars_of(spark, sf_dir), windows_of(spark, sf_dir), COLS, grouped=True
    )


# Matrix steps


def _filled(spark, sf_dir):
    bars = bars_of(spark, sf_dir)
    return series.runs(bars, COLS, N, {"bars": series.run_bars(COLS, N)})


def _pattern(spark, sf_dir):
    first = windows.first_window(windows_of(spark, sf_dir), COLS).first()
    return search.pattern_matrix(
        bars_of(spark, sf_dir), COLS, *(first[c] for c in COLS.window_key)
    )


def _matrix_rows(rows: DataFrame, matrix: Column, names: list[str], rounded: bool = True) -> DataFrame:
    """One row per matrix row, its cells as columns."""
    out = rows.select("sid", "begintime", F.posexplode_outer(matrix).alias("i", "row"))
    cells = (
        r6(F.col("row")[j], name) if rounded else F.col("row")[j].alias(name)
        for j, name in enumerate(names)
    )
    return out.select("sid", "begintime", F.col("i").cast("long").alias("i"), *cells)


def _matrices(spark, sf_dir):
    return steps.with_matrix(_filled(spark, sf_dir), COLS)


def window_matrix(spark, sf_dir):
    found = range_join.window_matrices(
        bars_of(spark, sf_dir), windows_of(spark, sf_dir), COLS, N
    )
    filled = steps.with_matrix(found, COLS)
    return _matrix_rows(filled, F.col("x"), list(COLS.match), rounded=False)


def window_mean(spark, sf_dir):
    means = matrix.column_means(F.col("x"), WIDTH).alias("means")
    rows = _matrices(spark, sf_dir).select("sid", "begintime", means)
    cells = (r6(F.col("means")[j], f"mean_{c}") for j, c in enumerate(COLS.match))
    return rows.select("sid", "begintime", *cells)


def window_stddev(spark, sf_dir):
    spread = matrix.column_stddevs(F.col("x"), WIDTH).alias("spread")
    rows = _matrices(spark, sf_dir).select("sid", "begintime", spread)
    cells = (r6(F.col("spread")[j], f"std_{c}") for j, c in enumerate(COLS.match))
    return rows.select("sid", "begintime", *cells)


def normalize(spark, sf_dir):
    scaled = matrix.scale_by_mean(F.col("x"), WIDTH)
    return _matrix_rows(_matrices(spark, sf_dir), scaled, list(COLS.match))


def pair_distance(spark, sf_dir):
    distance = matrix.pair_distance(matrix.scale_by_mean(F.col("x"), WIDTH), WIDTH)
    return _matrix_rows(_matrices(spark, sf_dir), distance, [f"d{j}" for j in range(N)])


def center_distance(spark, sf_dir):
    centred = matrix.centred_distances(F.col("x"), WIDTH, n=N)
    return _matrix_rows(_matrices(spark, sf_dir), centred, [f"c{j}" for j in range(N)])


def dist_cov(spark, sf_dir):
    rows = steps.correlation_steps(_filled(spark, sf_dir), _pattern(spark, sf_dir), COLS)
    return rows.select(
        *COLS.window_key, r6(F.col("cov_ab"), "cov_ab"), r6(F.col("cov_aa"), "cov_aa")
    )


def _dist_corr(**options) -> Query:
    def query(spark, sf_dir):
        return _scored(
            steps.correlation_steps(
                _filled(spark, sf_dir), _pattern(spark, sf_dir), COLS, **options
            )
        )

    return query


# Search


def similarity_joined(spark, sf_dir):
    bars, found = bars_of(spark, sf_dir), windows_of(spark, sf_dir)
    return _scored(similarity.similarity(bars, found, _pattern(spark, sf_dir), COLS))


def similarity_grouped(spark, sf_dir):
    bars, found = bars_of(spark, sf_dir), windows_of(spark, sf_dir)
    return _scored(similarity.similarity(bars, found, _pattern(spark, sf_dir), COLS, grouped=True))


def similarity_all(spark, sf_dir):
    bars = bars_of(spark, sf_dir)
    return _scored(similarity.similarity_of_all(bars, _pattern(spark, sf_dir), COLS))


def similarity_samples(spark, sf_dir):
    """Scores of samples that have places, in the order of the places."""
    bars, samples = bars_of(spark, sf_dir), windows_indexed(spark, sf_dir)
    found = similarity.similarity_in_order(bars, samples, _pattern(spark, sf_dir), COLS)
    return found.select("sample_id", r6(F.col("similarity"), "similarity"))


def similarity_long_pattern(spark, sf_dir):
    """Windows of five years, against the first one."""
    bars = bars_of(spark, sf_dir)
    found = stage(windows.all_windows(bars, COLS, LONG_N), "long")
    first = windows.first_window(found, COLS).first()
    if first is None:
        return _scored(found.withColumn("similarity", F.lit(None).cast("double")))
    pattern = search.pattern_matrix(bars, COLS, *(first[c] for c in COLS.window_key))
    return _scored(similarity.similarity(bars, found, pattern, COLS, passes=1))


def similarity_close_only(spark, sf_dir):
    """Another configuration: windows are compared by their closing prices alone."""
    cols, bars = COLS.with_match("close"), bars_of(spark, sf_dir)
    first = windows.first_window(windows_of(spark, sf_dir), cols).first()
    pattern = search.pattern_matrix(bars, cols, *(first[c] for c in cols.window_key))
    return _scored(similarity.similarity(bars, windows_of(spark, sf_dir), pattern, cols))


def top_hits(spark, sf_dir):
    scored = similarity.similarity_of_all(bars_of(spark, sf_dir), _pattern(spark, sf_dir), COLS)
    hits = topk.top_k(scored, COLS, k=25)
    return hits.select("rank", r6(F.col("similarity"), "similarity"), *COLS.window_key)


def pattern_search(spark, sf_dir):
    hits = search.pattern_search(bars_of(spark, sf_dir), windows_of(spark, sf_dir), COLS)
    return hits.select("rank", r6(F.col("similarity"), "similarity"), *COLS.window_key)


def pattern_search_every(spark, sf_dir):
    """The same search over windows that are known to be all windows of the bars."""
    bars, found = bars_of(spark, sf_dir), windows_of(spark, sf_dir)
    hits = search.pattern_search(bars, found, COLS, every_window=True)
    return hits.select("rank", r6(F.col("similarity"), "similarity"), *COLS.window_key)


def entry(spark: SparkSession) -> DataFrame:
    """The ten windows most similar to the first one."""
    return pattern_search(spark, FLAGSHIP_DIR)


def _llm_queries() -> dict[str, Query]:
    """The queries of the subpackage; Python workers of a run from this checkout find its modules."""
    root = os.path.dirname(os.path.abspath(__file__))

    def found(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
            if root not in paths:
                spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [root, *paths]))
            return query(spark, sf_dir)

        return run

    return {name: found(query) for name, query in {**llm.queries(), "pipeline": corpus_pipeline.run}.items()}


def queries() -> dict[str, Query]:
    return {
        "row_count": row_count,
        "line_scan": line_scan,
        "bars_scan": bars_scan,
        "bars_by_sid": bars_by_sid,
        "bars_time_range": bars_time_range,
        "bars_semi_sids": bars_semi_sids,
        "distinct_sids": distinct_sids,
        "sid_list": sid_list,
        "sid_series": sid_series,
        "bars_shuffled": bars_shuffled,
        "bars_union": bars_union,
        "bars_upsert": bars_upsert,
        "bars_table": bars_table,
        "bulk_load": bulk_load,
        "csv_ingest": csv_ingest,
        "csv_ingest_mixed": csv_ingest_mixed,
        "time_parse": time_parse,
        "bars_import": bars_import,
        "bars_bulk_load": bars_bulk_load,
        "windows_all": windows_all,
        "windows_table": windows_table,
        "namespace_windows": namespace_windows,
        "windows_limit": windows_limit,
        "windows_indexed": windows_indexed,
        "windows_sample": windows_sample,
        "pattern_split": pattern_split,
        "window_bars": window_bars,
        "window_bars_grouped": window_bars_grouped,
        "window_matrix": window_matrix,
        "window_mean": window_mean,
        "window_stddev": window_stddev,
        "normalize": normalize,
        "pair_distance": pair_distance,
        "center_distance": center_distance,
        "dist_cov": dist_cov,
        "dist_corr": _dist_corr(),
        "dist_corr_raw": _dist_corr(normalize="none"),
        "dist_corr_textbook": _dist_corr(passes=1),
        "similarity": similarity_joined,
        "similarity_grouped": similarity_grouped,
        "similarity_all": similarity_all,
        "similarity_samples": similarity_samples,
        "similarity_long_pattern": similarity_long_pattern,
        "similarity_close_only": similarity_close_only,
        "topk": top_hits,
        "pattern_search": pattern_search,
        "pattern_search_every": pattern_search_every,
        **(_llm_queries() if llm else {}),
    }


def oracle_sql() -> dict[str, str]:
    sql = oracle_statements.statements()
    if llm:
        sql |= llm.oracle_sql() | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    return sql
