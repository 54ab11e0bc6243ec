"""Link strategies that SQL calls: a table function of a page, used through LATERAL.

``register`` makes one of a strategy (a function from tree and URL to link records) under a name.  Its third argument, a constant, lists
the columns wanted; the rows have these and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from pagequarry import schemas

from . import dom
from .pages import LinkStrategy


def link_function(strategy: LinkStrategy):
    """The table function of a strategy: (html, url, columns) to a row for each link; a page that can't be parsed, and null html, has none."""
    fields = {f.name: f for f in T.StructType.fromDDL(f"l struct<{schemas.LINK}>")["l"].dataType.fields}

    class Links:
        def __init__(self, analyzed: AnalyzeResult | None = None):
            self.names = [] if analyzed is None else analyzed.schema.names

        @staticmethod
        def analyze(html: AnalyzeArgument, url: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
            names = [n.strip() for n in str(columns.value or "").split(",") if n.strip()]
            unknown = [n for n in names if n not in fields]
            if not names or unknown:
                raise ValueError(f"columns must be a constant list of {', '.join(fields)}; not {', '.join(unknown) or 'empty'}")
            return AnalyzeResult(schema=T.StructType([fields[n] for n in names]))

        def eval(self, html: str, url: str, columns: str) -> Iterator[tuple]:
            try:
                found = strategy(dom.parse(html), url or "") if html else []
            except (ValueError, RecursionError, AssertionError):
                found = []
            for link in found:
                yield tuple(link.get(n) for n in self.names)

    return udtf(Links)


def register(spark: SparkSession, name: str, strategy: LinkStrategy) -> None:
    spark.udtf.register(name, link_function(strategy))
