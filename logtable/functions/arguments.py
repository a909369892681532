"""Checks on caller-supplied query arguments; they run on the driver before a plan is built."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from logtable.schemas import KINDS

DEFAULT_PAGE_SIZE = 100
MAX_PAGE_SIZE = 1000

_HASH = re.compile(r"0x[0-9a-f]{64}")
_INTEGER = re.compile(r"[+-]?[0-9]+")


class InvalidArgument(ValueError):
    """The caller's argument cannot be used."""


def check_asset_id(text: str) -> str:
    lowered = text.lower()
    if not _HASH.fullmatch(lowered):
        raise InvalidArgument("an asset id is 0x and 64 hex digits")
    return lowered


def check_req_id(text: str | None) -> str:
    trimmed = (text or "").strip()
    if not trimmed:
        raise InvalidArgument("no request id given")
    if not _INTEGER.fullmatch(trimmed):
        raise InvalidArgument("a request id is a decimal number below 2**256")
    value = int(trimmed)
    if not 0 <= value < 1 << 256:
        raise InvalidArgument("a request id is a decimal number below 2**256")
    return str(value)


def valid_kinds(kinds: Iterable[str]) -> list[str]:
    """Known kinds only, in catalog order; an empty result means no kind filter."""
    wanted = set(kinds)
    return [kind for kind in KINDS if kind in wanted]


def parse_kind(name: str) -> str:
    if name not in KINDS:
        raise InvalidArgument(f"unknown event kind {name!r}")
    return name


@dataclass(frozen=True)
class Page:
    """A 1-based page. Out-of-range sizes fall back to the default size, for limit and offset alike."""

    page: int = 1
    page_size: int = 0

    @property
    def limit(self) -> int:
        return self.page_size if 0 < self.page_size <= MAX_PAGE_SIZE else DEFAULT_PAGE_SIZE

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.limit if self.page > 0 else 0


def check_submission_key(req_id: str = "", tx_hash: str = "") -> tuple[str, str]:
    """Exactly one of the two; req_id "0" is shared by heartbeats, so it identifies nothing."""
    if bool(req_id) == bool(tx_hash):
        raise InvalidArgument("exactly one of req_id and tx_hash is required")
    if req_id:
        value = check_req_id(req_id)
        if value == "0":
            raise InvalidArgument('req_id "0" is reserved for heartbeats; look up by tx_hash')
        return "req_id", value
    lowered = tx_hash.lower()
    if not _HASH.fullmatch(lowered):
        raise InvalidArgument("tx_hash must be a 0x-prefixed 32-byte hex string")
    return "tx_hash", lowered
