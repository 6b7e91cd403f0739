"""All registered queries of the library proper."""

from __future__ import annotations

from . import q_eval, q_files, q_images, q_more, q_relational, q_text, registry  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
