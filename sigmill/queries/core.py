"""Queries over the driver's tables. Each reads whole tables; results are rounded where numbers are compared as text."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigmill.functions.exact import fisher_table
from sigmill.functions.ids import period, plain_id
from sigmill.functions.stats import LIVE_LABELS, MEETS, chi2_upper_tail, with_statistics
from sigmill.functions.text import normalize_text, role_name, unknown_role
from sigmill.operators import cases, cells, drift, live, metrics, orphans, pairs, quality, ranking, revalidate
from sigmill.plans import engine, reports
from sigmill.plans.protocol import DRUG_SOURCES, Protocol, analysis_id
from sigmill.runtime import cut, ensure_checkpoint_dir, spread, table
from sigmill.sources import delimited

KEY = list(cells.CELL_KEY)
#: Support to which tables are enlarged to show the exact test of long ones.
LONG_SUPPORT = 5000


def _rounded(df: DataFrame, digits: int = 6, **columns: str) -> DataFrame:
    """``df`` with the named numbers rounded; -0.0 becomes 0.0."""
    return df.withColumns({name: F.round(F.col(source), digits) + F.lit(0.0) for name, source in columns.items()})


def _shared_folder(spark: SparkSession) -> str:
    """A new folder in the place that all executors share."""
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext.getCheckpointDir(), uuid.uuid4().hex)


# --- report tables --------------------------------------------------------------------------------------------------
def latest_case_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = cases.latest_versions(cases.usable(table(spark, sf_dir, "demo_all"), cases.DEMO_REQUIRED))
    return current.select("caseid", "primaryid", "caseversion", "quarter")


def integrity_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.integrity_counters(*(table(spark, sf_dir, n) for n in ("demo_all", "drug_all", "reac_all")))


def superseded_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.stages(spark, sf_dir)
    out = [cases.superseded_children(df, s.current).groupBy("primaryid").agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "primaryid", "n_rows") for n, df in (("drug_all", s.drug), ("reac_all", s.reac))]
    return out[0].unionByName(out[1])


def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "drug_all")
    return raw.groupBy("primaryid").agg(F.count("*").alias("n_rows")).select("primaryid", plain_id(F.col("primaryid")).alias("plain"), "n_rows")


def role_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "drug_all")
    return raw.groupBy("role_cod").agg(F.count("*").alias("n_rows")).select("role_cod", role_name(F.col("role_cod")).alias("role"), unknown_role(F.col("role_cod")).alias("is_unknown"), "n_rows")


def normalized_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "reac_all")
    return raw.groupBy("pt").agg(F.count("*").alias("n_rows")).select("pt", normalize_text(F.col("pt")).alias("term"), "n_rows")


def quarter_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "demo_all").withColumn("p", period(F.col("quarter"))).groupBy("p").agg(F.count("*").alias("n_rows")).where("p is not null")
    first = F.make_date(F.floor(F.col("p") / 4).cast("int"), (F.col("p") % 4 * 3 + 1).cast("int"), F.lit(1))
    return counted.select(orphans.quarter_name("p").alias("quarter"), first.cast("string").alias("first_day"), F.date_sub(F.add_months(first, 3), 1).cast("string").alias("last_day"), "n_rows")


# --- pairs and cells ------------------------------------------------------------------------------------------------
def join_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.stages(spark, sf_dir)
    return pairs.join_load(pairs.drug_components(s.drug, s.current), pairs.event_components(s.reac, s.current))


def built_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.built_pairs(spark, sf_dir).select("primaryid", "caseid", "quarter", "drug_text", "drug_text_source", "drug_role", "event_pt", "event_category", "age", "sex", "occr_country", "serious")


def build_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.stages(spark, sf_dir)
    return pairs.build_guards(s.current, s.drug, s.reac)


def ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reports.built_pairs(spark, sf_dir).select("primaryid", "drug_text", "drug_text_source", "drug_role", "event_pt")
    return pairs.ordered_pairs(made)


def role_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.with_rollups(table(spark, sf_dir, "report_pairs")).groupBy("dataset_id", "drug_role").agg(F.count("*").alias("n_rows"), F.count_distinct("primaryid").alias("n_reports"))


def event_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.event_margins(table(spark, sf_dir, "report_pairs"))


def drug_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.drug_margins(table(spark, sf_dir, "report_pairs"))


def universe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.universe(table(spark, sf_dir, "report_pairs"))


def contingency_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.built_cells(spark, sf_dir).select(*KEY, *cells.COUNTS)


def dataset_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.cells(table(spark, sf_dir, "report_pairs")).select(*KEY, *cells.COUNTS)


def snapshot_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a build has to hold: retained reports once, populations inside each other, valid cells of one universe."""
    s = reports.stages(spark, sf_dir)
    built = cut(reports.pairs_of(s).select("dataset_id", "primaryid", *cells.GROUP, "event_pt"))
    current = cases.current_reports(s.demo)
    quality.require_populations(s.demo, current, built)
    made = cells.require_valid(cut(cells.cells(built)))
    found = made.agg(
        F.count("*").alias("n_cells"), F.count_distinct("dataset_id").alias("n_datasets"), F.min("universe_reports").alias("universe_reports"), F.count_distinct("comparator", "event_scope", "deduplication_policy").alias("n_constants"),
        F.min("comparator").alias("comparator"), F.min("event_scope").alias("event_scope"), F.min("deduplication_policy").alias("deduplication_policy"),
    )
    return found.crossJoin(current.agg(F.count("*").alias("current_reports"), F.count_distinct("primaryid").alias("retained_ids")))  # one row each


def cell_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.violations(table(spark, sf_dir, "disproportionality_cells")).groupBy("dataset_id", "violation").agg(F.count("*").alias("n_rows"))


# --- statistics -----------------------------------------------------------------------------------------------------
def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_statistics(reports.given_cells(spark, sf_dir))


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.analyse_all(table(spark, sf_dir, "disproportionality_cells"), repeated=True)


def prr_ror(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("prr", "prr_low", "prr_high", "ror", "ror_low", "ror_high")
    return _rounded(_scored(spark, sf_dir), **{n: n for n in names}).select(*KEY, "zero_corrected", *names)


def yates_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scored(spark, sf_dir), chi2="chi2").select(*KEY, "chi2")


def chi2_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = with_statistics(reports.given_cells(spark, sf_dir).select(*"abcd").distinct())
    return _rounded(distinct.withColumn("chi2_p", chi2_upper_tail(F.col("chi2"))), 9, chi2_p="chi2_p").select(*"abcd", "chi2_p")


def screening_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(*KEY, "outcome")


def exploratory_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scored(spark, sf_dir), 5, score="score").select(*KEY, "score")


def fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = fisher_table(spread(table(spark, sf_dir, "disproportionality_cells").select(*"abcd").distinct()))
    return _rounded(tested, 7, fisher_p="fisher_p").select(*"abcd", "fisher_p", "fisher_status")


def fisher_long_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact test of the given tables, each enlarged until its support is long."""
    tables = table(spark, sf_dir, "disproportionality_cells").select(*"abcd").distinct()
    support = F.least(F.col("a") + F.col("b"), F.col("a") + F.col("c")) - F.greatest(F.lit(0), F.col("a") - F.col("d"))
    times = tables.where(support > 0).withColumn("times", F.floor(F.lit(LONG_SUPPORT) / support) + 1)
    tested = fisher_table(spread(times.select(*((F.col(c) * F.col("times")).alias(c) for c in "abcd")).distinct()))
    return _rounded(tested, 6, fisher_p="fisher_p").select(*"abcd", "fisher_p", "fisher_status")


def bh_qvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_analysed(spark, sf_dir), 6, fdr_q="fdr_q").select(*KEY, "fdr_q")


def drug_signal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every cell of the snapshot with its statistics and label, strongest first."""
    found = _rounded(with_statistics(reports.built_cells(spark, sf_dir)), prr="prr", ror="ror", chi2="chi2")
    return found.select("drug_text", "drug_text_source", "drug_role", "event_pt", *"abcd", "prr", "ror", "chi2", "outcome").orderBy(F.col("prr").desc(), "drug_text", "drug_role", "event_pt", "drug_text_source")


# --- ordered views --------------------------------------------------------------------------------------------------
def top_events_for_drug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_events(table(spark, sf_dir, "report_pairs"))


FAMILY = ("dataset_id", "drug_text", "drug_text_source", "drug_role")


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _rounded(_scored(spark, sf_dir), prr="prr", prr_low="prr_low", prr_high="prr_high")
    return ranking.page(scored, 1, FAMILY)


def prr_ranked_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir).select(*KEY, "prr", "place")


def prr_third_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of every family, or its last one."""
    scored = _rounded(_scored(spark, sf_dir), prr="prr")
    return ranking.page(scored, 3, FAMILY).select(*KEY, "prr", "place")


def count_ordered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of every family's rows that meet the profile, by reports."""
    return ranking.page(_scored(spark, sf_dir), 2, FAMILY, order="count", outcome=MEETS).select(*KEY, "a", "place")


def name_ordered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.page(_scored(spark, sf_dir), 1, FAMILY, order="name").select(*KEY, "place")


def forest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.forest_points(_page(spark, sf_dir), FAMILY).select(*KEY, "prr", "prr_low", "prr_high", "place", "plot")


def map_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.map_coordinates(_scored(spark, sf_dir)), map_x="map_x", map_y="map_y").select(*KEY, "map_x", "map_y")


# --- quality --------------------------------------------------------------------------------------------------------
def population_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.stages(spark, sf_dir)
    return quality.population_counts(s.demo, s.current, reports.built_pairs(spark, sf_dir))


def field_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    demo = table(spark, sf_dir, "demo_all")
    return quality.field_completeness(demo, tuple(demo.columns))


def eligible_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of the current reports that have a pair."""
    s = reports.stages(spark, sf_dir)
    return quality.field_completeness(quality.eligible_reports(s.current, cut(reports.pairs_of(s).select("primaryid").distinct())))


def text_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revalidate.text_checks(table(spark, sf_dir, "disproportionality_cells"), tuple(KEY))


def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.stages(spark, sf_dir)
    return quality.duplicate_components(pairs.drug_components(s.drug, s.current), pairs.event_components(s.reac, s.current))


def qa_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.stages(spark, sf_dir)
    drugs, events = cut(pairs.drug_components(s.drug, s.current)), cut(pairs.event_components(s.reac, s.current))
    built = cut(reports.pairs_of(s).select("dataset_id", "primaryid", *cells.GROUP, "event_pt"))
    raw = [table(spark, sf_dir, n) for n in ("drug_all", "reac_all")]
    return quality.summary(s.demo, *raw, s.current, drugs, events, built, cells.cells(built))


# --- requests -------------------------------------------------------------------------------------------------------
def _largest_request(found: DataFrame) -> Protocol:
    """A request for the drug with the most reports of the first data set, in the role ``all``."""
    sources = {v: k for k, v in DRUG_SOURCES.items()}
    eligible = found.where((F.col("drug_role") == "all") & F.col("drug_text_source").isin(*sources))
    first = eligible.agg(F.min_by(F.struct("dataset_id", "drug_text", "drug_text_source"), F.struct("dataset_id", -F.col("drug_reports"), "drug_text", "drug_text_source")).alias("r")).first()["r"]
    return Protocol(first["dataset_id"], f"{sources[first['drug_text_source']]}:{first['drug_text']}", "all", ("prr", "ror", "fisher_exact"), "evans_educational")


def protocol_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "disproportionality_cells")
    rows = engine.analyse(found, _largest_request(found))
    return _rounded(rows, prr="prr", ror="ror", chi2="chi2", fisher_p="fisher_p", fdr_q="fdr_q").select("dataset_id", "drug_text", "event_pt", *"abcd", "prr", "ror", "chi2", "fisher_p", "fdr_q", "flag")


def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``protocol_scan`` over the checked store of all cells."""
    place = _shared_folder(spark)
    delimited.write_cells(reports.given_cells(spark, sf_dir), place)
    found = delimited.read_cells(spark, place)
    rows = engine.analyse(found, _largest_request(found))
    return _rounded(rows, prr="prr", ror="ror", chi2="chi2", fisher_p="fisher_p", fdr_q="fdr_q").select("dataset_id", "drug_text", "event_pt", *"abcd", "prr", "ror", "chi2", "fisher_p", "fdr_q", "flag")


def result_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest request's result as exported text, its numbers rounded before; written as CSV and read back."""
    found, place = table(spark, sf_dir, "disproportionality_cells"), _shared_folder(spark)
    request = _largest_request(found)
    numbers = ("prr", "prr_low", "prr_high", "ror", "ror_low", "ror_high", "fisher_p", "fdr_q")
    rows = metrics.with_metrics(_rounded(engine.analyse(found, request), **{n: n for n in numbers}), request.methods)
    digest = engine.result_digest(rows, ("event_pt", *"abcd"))
    metrics.write_export(metrics.export_rows(rows, analysis_id(request, "given"), digest, "all_events_of_one_drug", request.drug_concept_id, "source_pt", pairs.EVENT_CATEGORY), place)
    back = spark.read.options(header=True, quote='"', escape='"').csv(place)
    return back.select(*(F.coalesce(c, F.lit("")).alias(c) for c in metrics.EXPORT if c not in ("analysis_id", "result_digest")))


def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three methods, a row each."""
    found = _analysed(spark, sf_dir)
    long = metrics.metrics_long(metrics.with_metrics(found, ("prr", "ror", "fisher_exact")), tuple(KEY))
    names = ("estimate", "lower_95", "upper_95", "p_value", "q_value")
    return _rounded(long, **{n: n for n in names}).select(*KEY, "method", "measure", *names, "input_cells", "correction_method", "added_to_each_cell")


def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.review_flags(_scored(spark, sf_dir)).select(*KEY, "profile_id", "flag", "reason")


def spreadsheet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "disproportionality_cells").select("drug_text", "event_pt").distinct()
    return metrics.spreadsheet_rows(raw.withColumn("marked", F.concat(F.lit("="), F.col("drug_text"))))


def live_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = live.scan_all(table(spark, sf_dir, "report_pairs"))
    return _rounded(found, prr="prr", ror="ror", chi2="chi2").select("drug_text", "event_pt", "place", *"abcd", "prr", "ror", "chi2", "label")


def live_scan_drug(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "report_pairs")
    drug = source.groupBy("drug_text").agg(F.count_distinct("primaryid").alias("n")).agg(F.min_by("drug_text", F.struct(-F.col("n"), "drug_text"))).first()[0]
    return _rounded(live.scan(source, drug), prr="prr", ror="ror", chi2="chi2").select("event_pt", *"abcd", "prr", "ror", "chi2", "label")


def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By drug: the events of its live scan, and those that meet the profile."""
    found = live.scan_all(table(spark, sf_dir, "report_pairs"))
    return found.groupBy("drug_text").agg(F.count("*").alias("n_events"), F.count_if(F.col("label") == LIVE_LABELS[MEETS]).alias("n_review"))


def result_revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results, some of which were changed by rule, against a recomputation from the margins: what was changed."""
    given, place = cut(reports.given_cells(spark, sf_dir)), _shared_folder(spark)  # read several times
    engine.analyse_all(given, given).write.parquet(place)
    stored = spark.read.parquet(place).where("(a + 2 * b) % 211 <> 11")
    damage = {
        "prr": F.when(F.expr("b % 101 = 7"), F.col("prr") * (1 + 1e-6)).otherwise(F.col("prr")),
        "ror_high": F.when(F.expr("c % 103 = 5"), F.col("ror_high") + 1).otherwise(F.col("ror_high")),
        "fisher_p": F.when(F.expr("d % 107 = 3"), F.col("fisher_p") / 2).otherwise(F.col("fisher_p")),
        "fdr_q": F.when(F.expr("event_reports % 109 = 2"), F.lit(None)).otherwise(F.col("fdr_q")),
        "outcome": F.when(F.expr("drug_reports % 113 = 4"), F.concat(F.lit("not "), "outcome")).otherwise(F.col("outcome")),
    }
    recomputed = engine.analyse_all(cells.from_margins(given.select(*KEY, "a", "drug_reports", "event_reports", "universe_reports")), given)
    return revalidate.mismatches(stored.withColumns(damage), recomputed, tuple(KEY)).select(*KEY, "field")


def digest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the digest of all results is the same in another order, and another one if a single row is changed or missing."""
    found = cut(_scored(spark, sf_dir).select(*KEY, *"abcd", "outcome"))
    columns, one = tuple(found.columns), found.orderBy(*KEY).limit(1)
    digest = engine.result_digest(found, columns)
    others = found.join(one.select(*(F.col(c).alias(f"_{c}") for c in KEY)), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY], "left_anti")
    changed = others.unionByName(one.withColumn("a", F.col("a") + 1))
    row = [digest == engine.result_digest(found.orderBy(F.desc("event_pt")), columns), digest != engine.result_digest(others, columns), digest != engine.result_digest(changed, columns)]
    return found.agg(F.count("*").alias("n_rows"), *(F.lit(v).alias(n) for n, v in zip(("same_in_any_order", "missing_row_seen", "changed_row_seen"), row)))


def row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered cells of the first data set in canonical order, some of which were exchanged by rule: the rows out of order."""
    given = reports.given_cells(spark, sf_dir).where("drug_role = 'all'").groupBy("dataset_id", "drug_text", "event_pt").agg(F.count("*").alias("n"))
    numbered = given.withColumn("number", F.row_number().over(Window.partitionBy("dataset_id", "drug_text").orderBy("event_pt")))
    moved = numbered.withColumn("number", F.when(F.expr("number % 10 = 3"), F.col("number") + 1).when(F.expr("number % 10 = 4"), F.col("number") - 1).otherwise(F.col("number")))
    largest = moved.groupBy("dataset_id", "drug_text").agg(F.count("*").alias("n")).agg(F.min_by(F.struct("dataset_id", "drug_text"), F.struct(-F.col("n"), "dataset_id", "drug_text")).alias("r")).first()["r"]
    one = moved.where((F.col("dataset_id") == largest["dataset_id"]) & (F.col("drug_text") == largest["drug_text"]))
    return revalidate.out_of_order(one.select("dataset_id", "drug_text", "event_pt", "number"), "number")


# --- sources and sinks ----------------------------------------------------------------------------------------------
def csv_scan_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DRUG written as ``$``-delimited text and scanned again."""
    place = _shared_folder(spark)
    raw = table(spark, sf_dir, "drug_all").select(*(F.coalesce(F.col(c), F.lit("NA")).alias(c.upper()) for c in delimited.COLUMNS["drug"]))
    raw.write.options(sep="$", quote="", header=True, emptyValue="").csv(place)
    scanned = delimited.scan(spark, place, "drug")
    return scanned.groupBy("primaryid", "role_cod", "drugname", "prod_ai", "route", "dose_vbm").agg(F.count("*").alias("n_rows"))


def quarters_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DRUG written as text by quarter, without its optional columns, and the quarters scanned into one table."""
    place = _shared_folder(spark)
    raw = table(spark, sf_dir, "drug_all").where("quarter is not null")
    named = raw.select(*(F.coalesce(F.col(c), F.lit("NA")).alias(c.upper()) for c in delimited.REQUIRED["drug"]), "quarter")
    named.write.partitionBy("quarter").options(sep="$", quote="", header=True, emptyValue="").csv(place)
    quarters = [r["quarter"] for r in raw.select("quarter").distinct().collect()]
    scanned = delimited.scan_quarters(spark, {q: f"{place}/quarter={q}" for q in quarters}, "drug")
    return scanned.groupBy("quarter", "role_cod").agg(F.count("*").alias("n_rows"), F.count("drugname").alias("n_named"), F.count("route").alias("n_routes"))


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written by quarter and read back, counted by partition."""
    place = _shared_folder(spark)
    delimited.write_by_quarter(table(spark, sf_dir, "report_pairs"), place)
    return spark.read.parquet(place).groupBy("quarter").agg(F.count("*").alias("n_rows"), F.count_distinct("dataset_id", "primaryid").alias("n_reports"))


def cells_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells written as tab-separated text and read back under the exact schema."""
    place = _shared_folder(spark)
    given = reports.given_cells(spark, sf_dir)
    delimited.write_cells_text(given, place)
    return delimited.read_cells_text(spark, place).groupBy("dataset_id", "drug_role").agg(F.count("*").alias("n_cells"), F.sum("a").alias("sum_a"), F.sum("d").alias("sum_d"))


# --- references and feeds -------------------------------------------------------------------------------------------
def _orphan_state(spark: SparkSession, sf_dir: str) -> orphans.OrphanState:
    t = lambda name: table(spark, sf_dir, name)
    return orphans.replay(t("demo_all"), {n: t(n) for n in ("drug_all", "reac_all")}, t("deleted_cases"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.broken(_orphan_state(spark, sf_dir))


def p3_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.snapshot(_orphan_state(spark, sf_dir))


def p3_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts after every batch."""
    return orphans.snapshots(_orphan_state(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "feed_lines"), table(spark, sf_dir, "field_names"))


def p5_demo_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.unified(table(spark, sf_dir, "feed_lines"), table(spark, sf_dir, "field_names"), "demo")


def p5_cells_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.unified(table(spark, sf_dir, "feed_lines"), table(spark, sf_dir, "field_names"), "cells")


def p5_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type branches that appear in a field for the first time."""
    return drift.alternatives(table(spark, sf_dir, "feed_lines"), table(spark, sf_dir, "field_names"))


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled values of both unified tables, a row each."""
    lines, names = table(spark, sf_dir, "feed_lines"), table(spark, sf_dir, "field_names")
    return drift.values(lines, names, "demo").unionByName(drift.values(lines, names, "cells"))


_QUERIES = (
    latest_case_version, integrity_counters, superseded_children, canonical_ids, role_mapping, normalized_terms, quarter_coverage,
    join_load, build_guards, built_pairs, ordered_pairs, role_rollup, event_margins, drug_margins, universe_count, contingency_cells, dataset_cells, snapshot_checks, cell_violations,
    prr_ror, yates_chi2, chi2_pvalue, screening_outcome, exploratory_score, fisher_exact, fisher_long_supports, bh_qvalues, drug_signal_scan,
    top_events_for_drug, prr_ranked_page, prr_third_page, count_ordered_page, name_ordered_page, forest_points, map_coordinates,
    population_counts, field_completeness, eligible_completeness, text_checks, duplicate_components, qa_summary,
    protocol_scan, store_scan, result_export, metrics_long, review_flags, spreadsheet_texts, live_scan, live_scan_drug, review_counts, result_revalidation, digest_check, row_order,
    csv_scan_roundtrip, quarters_scan, parquet_roundtrip, cells_text_roundtrip,
    p3_found, p3_snapshot, p3_snapshots, p5_found, p5_alternatives, p5_values, p5_demo_table, p5_cells_table,
)
QUERIES = {f.__name__: f for f in _QUERIES}
