"""Purging old records and repairing the pages of a form."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.constants import INACTIVE, KEY, VALID_STATUS
from wardlens.functions import max_or_null
from wardlens.operators.keys import drop_known, keep_known
from wardlens.sources.sinks import durable
from wardlens.sources.tables import join_pages

Pages = Mapping[str, DataFrame]
CLOSED_COLUMNS = ("estadoActual", "aNHC", "LastSaveTime")


def closed_records(pages: Pages) -> DataFrame:
    """Inactive or unidentified records, with their last change."""
    wide = join_pages(pages, CLOSED_COLUMNS)
    return wide.filter((F.col("estadoActual") == INACTIVE) | F.col("aNHC").isNull())


def last_change(closed: DataFrame) -> DataFrame:
    """Newest change among the closed records, as one row; null if one has none."""
    return closed.agg(max_or_null(F.col("LastSaveTime")).alias("ultimo"))


def records_to_purge(pages: Pages, cutoff: date) -> DataFrame:
    """Keys of closed records last changed before the cut-off."""
    old = F.col("LastSaveTime") < F.lit(cutoff)
    return closed_records(pages).filter(old).select(KEY)


def purged_first_page(pages: Pages, cutoff: date) -> DataFrame:
    """The first page without closed records last changed before the cut-off.

    One left join per page that has a needed column, and one filter: the first page is
    not joined with itself. A row without key is never purged.
    """
    (_, parents), *children = pages.items()
    missing = [c for c in CLOSED_COLUMNS if c not in parents.columns]
    wide = parents
    for _, page in children:
        if taken := [c for c in missing if c in page.columns]:
            wide = wide.join(page.select(KEY, *taken), KEY, "left")
    closed = (F.col("estadoActual") == INACTIVE) | F.col("aNHC").isNull()
    doomed = closed & (F.col("LastSaveTime") < F.lit(cutoff)) & F.col(KEY).isNotNull()
    return wide.filter(~F.coalesce(doomed, F.lit(False))).select(*parents.columns)


def purge(pages: Pages, cutoff: date, folder: str | None = None) -> dict[str, DataFrame]:
    """All pages without the purged records.

    A row of a later page stays only if its record survives in the first page.
    That already excludes purged records, so each later page needs one join. With
    ``folder`` the new first page is stored there once, and the later pages read its keys;
    name it when the pages are written one by one, each in a job of its own.
    """
    (main, _), *children = pages.items()
    kept = purged_first_page(pages, cutoff)
    if folder:
        kept = durable(kept, folder)
    survivors = kept.select(KEY)
    return {main: kept} | {name: keep_known(page, survivors) for name, page in children}


def orphans(pages: Pages) -> dict[str, DataFrame]:
    """Rows of the later pages whose record is missing in the first page."""
    (_, parents), *children = pages.items()
    return {name: drop_known(page, parents) for name, page in children}


def repair(pages: Pages, named_page: str, folder: str | None = None) -> dict[str, DataFrame]:
    """All pages cut to valid records that have a name.

    With ``folder`` their keys are stored there once, as in :func:`purge`.
    """
    main = next(iter(pages.values()))
    valid = main.filter(F.col("RECSTATUS") == VALID_STATUS)
    named = pages[named_page].filter(F.col("nombre").isNotNull())
    clean = keep_known(named, valid).select(KEY)
    clean = durable(clean, folder) if folder else clean
    return {name: keep_known(page, clean) for name, page in pages.items()}
