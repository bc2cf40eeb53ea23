"""Small immutable descriptions of what is compared or sampled."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

Watermark = dt.datetime | dt.date | int | str | None


@dataclass(frozen=True)
class Target:
    """One source/build table pair.

    ``keys`` identify a row; ``columns`` limits what is compared (empty: every
    column both sides share). The watermark pins both sides to the same moment;
    ``prev_watermark`` opens the half-open delta window ``(prev, watermark]``.
    """

    table: str
    keys: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    watermark_col: str | None = None
    watermark: Watermark = None
    prev_watermark: Watermark = None


@dataclass(frozen=True)
class FK:
    """``col`` of the child refers to ``parent_key`` of ``parent_table``."""

    col: str
    parent_table: str
    parent_key: str


@dataclass(frozen=True)
class SampleSpec:
    """How one table enters the small estate."""

    table: str
    keys: tuple[str, ...] = ()
    fks: tuple[FK, ...] = ()
    rows: int = 10_000
    is_reference: bool = False
