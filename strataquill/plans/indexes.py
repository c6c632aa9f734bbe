"""Lexical indexes that are kept between queries of a session: built once for a table as it is, the last eight."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataquill.operators.search import TextIndex, TextScan
from strataquill.sources import shared

KEPT = 8
_indexes: OrderedDict[tuple, TextIndex | TextScan] = OrderedDict()


def text_index(spark: SparkSession, table: str, name: str, key: str, docs: Callable[[], DataFrame], kind: type = TextIndex) -> TextIndex | TextScan:
    """The index (or scan, as kind says) called name over docs(), which are made of the table at that path; a changed table
    is indexed anew."""
    own = (spark.sparkContext.applicationId, table, name, key, kind, *shared.signature(spark, table))
    if own not in _indexes:
        _indexes[own] = kind(docs(), key, shared.new_path(spark, f"index-{name}"))
        while len(_indexes) > KEPT:
            old, index = _indexes.popitem(last=False)
            if old[0] == own[0]:
                shared.delete(spark, index.path)
    _indexes.move_to_end(own)
    return _indexes[own]
