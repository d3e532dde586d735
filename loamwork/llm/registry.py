"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import contract


def queries() -> dict:
    return {k: v for k, v in vars(contract).items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return contract.ORACLES
