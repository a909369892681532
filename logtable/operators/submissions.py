"""Submitted price transactions: lookup and listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtable.functions.arguments import Page, check_asset_id, check_submission_key
from logtable.operators.paging import ordered_page, page_meta


def find_submission(submissions: DataFrame, req_id: str = "", tx_hash: str = "") -> DataFrame:
    """By exactly one of request id and transaction hash."""
    column, value = check_submission_key(req_id, tx_hash)
    return submissions.filter(F.col(column) == value)


def _of_asset(submissions: DataFrame, asset_id: str) -> DataFrame:
    return submissions.filter(F.col("asset_id") == check_asset_id(asset_id)) if asset_id else submissions


def list_submissions(submissions: DataFrame, asset_id: str = "", page: Page = Page()) -> DataFrame:
    """Latest first, optionally of one asset, one page at any depth."""
    return ordered_page(_of_asset(submissions, asset_id), ["submitted_at", "tx_hash"], page)


def submissions_meta(submissions: DataFrame, asset_id: str = "", page: Page = Page()) -> DataFrame:
    """Page metadata of that listing."""
    return page_meta(_of_asset(submissions, asset_id), page)
