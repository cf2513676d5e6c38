"""Settings of a run from environment variables."""

from __future__ import annotations

import os


def from_environment(name: str, default: str | None = None) -> str | None:
    """An environment variable without the quotation marks a launcher may have put in."""
    value = os.environ.get(name, default)
    return None if value is None else value.replace('"', "")
