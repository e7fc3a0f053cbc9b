"""Dotplot to synteny blocks as one chain of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import dotplot


def synteny(pairs: DataFrame, window: int, allow_mismatch: bool = False) -> dict[str, DataFrame]:
    """cells, lines, dots, blocks, table, statistics of pairs (pair_id, seq1, seq2)."""
    rows = dotplot.strands(pairs, window)
    cells = dotplot.close_matches(rows, window) if allow_mismatch else dotplot.seeded_matches(rows, window)
    found = dotplot.lines(cells, window)
    blocks = dotplot.blocks(found)
    return {
        "cells": cells, "lines": found, "dots": dotplot.cells_of(found, rows, window), "blocks": blocks,
        "table": dotplot.block_table(blocks, pairs), "statistics": dotplot.statistics(found, pairs, window),
    }
