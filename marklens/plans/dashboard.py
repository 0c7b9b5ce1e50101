"""Dashboard view: filters, sort and page over pair results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marklens.operators import reporting as R
from marklens.sources.sorted_pages import SortedPages, open_sorted, save_sorted


def dashboard(
    results: DataFrame,
    term: str | None = None,
    status: str = "all",
    min_similarity: float = 0.0,
    sort_by: str = "final_similarity",
    descending: bool = True,
    page: int = 1,
    size: int = R.PAGE_SIZE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The requested page, the page count and the overview figures."""
    kept = R.filter_min_similarity(results, min_similarity)
    if term:
        kept = R.search(kept, term)
    kept = R.filter_status(kept, status)
    ordered = R.order_by(kept, sort_by, descending)
    return (
        R.page(ordered, page, size),
        R.page_count(kept, size),
        R.dashboard_stats(results, min_similarity),
    )


def stored_view(
    results: DataFrame,
    path: str,
    term: str | None = None,
    status: str = "all",
    min_similarity: float = 0.0,
    sort_by: str = "final_similarity",
    descending: bool = True,
) -> SortedPages:
    """The filtered and sorted results in a new folder ``path``, for pages at any depth.

    ``dashboard`` sorts for each page and passes all rows before it through one task; here
    the sort is done once and a page reads only the ranges it lies in.
    """
    kept = R.filter_min_similarity(results, min_similarity)
    if term:
        kept = R.search(kept, term)
    save_sorted(R.filter_status(kept, status), path, sort_by, descending)
    return open_sorted(results.sparkSession, path)
