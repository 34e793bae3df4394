"""A stream appended to a dimension, each micro-batch once."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

if TYPE_CHECKING:
    from ..workspace import Dimension


def batch_writer(dim: Dimension, name: str, order_by: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch. The last batch of stream `name` is kept in the manifest, in the commit that appends
    its rows; a batch that comes again after a failure is passed over."""
    ws, dim_name = dim.ws, dim.name

    def write(batch: DataFrame, number: int) -> None:
        from ..transaction import Transaction

        with Transaction(ws):
            seen = ws._node().setdefault("streams", {}).get(name, -1)
            if number > seen:
                ws._append(dim_name, batch, order_by)
                ws._node().setdefault("streams", {})[name] = number

    return write


def append_stream(stream: DataFrame, dim: Dimension, name: str, checkpoint: str, order_by: list[str] | None = None, **trigger) -> StreamingQuery:  # noqa: ANN003
    """Start appending a stream whose columns are tensors of dim."""
    writer = stream.writeStream.foreachBatch(batch_writer(dim, name, order_by)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
