"""From a request to its ordered results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.errors import BatchMethodRequired, InvalidTable, NoMatchingRows, ResultTooLarge
from sigmill.functions.exact import with_fisher
from sigmill.functions.stats import with_statistics
from sigmill.operators.cells import violations
from sigmill.operators.metrics import review_flags, with_metrics
from sigmill.operators.multiplicity import FAMILY, benjamini_hochberg, gathered
from sigmill.plans.protocol import BATCH_METHODS, Protocol, digest, normalise
from sigmill.runtime import cut, widened

#: fixed values: rows that a result may have
RESULT_ROWS = 50_000


def selected(cells: DataFrame, p: Protocol) -> DataFrame:
    """The cells of one request. All conditions are equalities, so they reach the scan."""
    source, text = p.drug()
    return cells.where(
        (F.col("dataset_id") == p.dataset_id)
        & (F.col("drug_text") == text)
        & (F.col("drug_text_source") == source)
        & (F.col("drug_role") == p.drug_role)
        & (F.col("comparator") == p.comparator)
        & (F.col("event_scope") == p.event_scope)
    )


def analyse(cells: DataFrame, request: Protocol, most: int = RESULT_ROWS) -> DataFrame:
    """Results of a request, by event: statistics, the asked metrics and, with a profile, its review flag.

    Fails, and never shortens: methods that need a batch run, subgroups, no matching rows, too many rows, cells that
    don't add up. The exact test and its q-values are computed only if asked.
    """
    p = normalise(request)
    if set(p.methods) & set(BATCH_METHODS) or p.subgroups or p.start_date or p.end_date:
        raise BatchMethodRequired("this method, subgroup or period is not computed on request")
    rows = selected(cells, p).distinct()
    count = rows.limit(most + 1).count()
    if not count:
        raise NoMatchingRows(f"{p.drug_concept_id} ({p.drug_role}) has no cells in {p.dataset_id}")
    if count > most:
        raise ResultTooLarge(f"more than {most} rows")
    if violations(rows).where("violation is not null").limit(1).count():
        raise InvalidTable("a selected cell doesn't add up")
    scored = with_statistics(rows)
    if "fisher_exact" in p.methods:
        scored = benjamini_hochberg(with_fisher(scored), counted=rows)
    else:
        scored = scored.withColumns({"fisher_p": F.lit(None).cast("double"), "fdr_q": F.lit(None).cast("double")})
    scored = with_metrics(scored, p.methods)
    if p.threshold_profile != "none":
        scored = review_flags(scored, p.threshold_profile)
    return scored.orderBy("event_pt")


def analyse_all(cells: DataFrame, counted: DataFrame | None = None, repeated: bool = False) -> DataFrame:
    """Statistics, exact tests and q-values of all cells, each (dataset, drug, source, role) a family of tests.

    ``counted`` has the families' rows, or more of them, and is cheaper to read, for the families' sizes; without it the
    cells are written once for both readers. The statistics follow from the counts, so they come last and aren't shuffled.
    ``repeated``: ``cells`` is a table, of which repeated rows count once. They are removed after the exact test, which is
    the same for them, where their family lies together: one shuffle serves that and the q-values.
    """
    within = False
    if repeated:
        tests, within = gathered(with_fisher(widened(cells)), cells)
        tests, counted = tests.distinct(), cells
    else:
        if counted is None:
            cells = counted = cut(cells)
        tests = with_fisher(cells)
    scored = with_statistics(benjamini_hochberg(tests, family=FAMILY, counted=counted, within=within))
    last = ("fisher_p", "fisher_status", "fdr_q")
    return scored.select(*(c for c in scored.columns if c not in last), *last)


def result_digest(results: DataFrame, columns: tuple[str, ...]) -> str:
    """Digest of all rows of a result, of any number and in any order; a repeated row counts each time.

    Every row is hashed where it lies, and four parts of the hashes are summed up with the number of rows.
    """
    row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in columns)), {"ignoreNullFields": "false"}), 256)
    parts = (F.sum(F.conv(F.substring(row, n, 15), 16, 10).cast("decimal(38,0)")) for n in (1, 16, 31, 46))
    return digest([list(columns), *(str(v) for v in results.select(*columns).agg(F.count(F.lit(1)), *parts).first())])
