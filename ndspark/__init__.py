"""A PySpark-native engine for tensors on named dimensions."""

from .operators.bundle import Bundle
from .operators.filters import (
    BoolFilter,
    CompoundFilter,
    ConstFilter,
    DimensionBoolFilter,
    DimensionIndicesFilter,
    DimensionSliceFilter,
    Filter,
    IndicesFilter,
    RowsFilter,
    SliceFilter,
    TensorBoolFilter,
    TensorFilter,
    TensorIndicesFilter,
    TensorSliceFilter,
)
from .operators.groupby import Accumulator, GroupDimensionBy, GroupViewBy
from .operators.view import View
from .sources.catalog import ConflictError
from .transaction import Transaction
from .values import TensorValue
from .workspace import Dimension, Tensor, TensorRef, Workspace, WorkspaceManager, connect, create_workspace, wrap

__all__ = ["Accumulator", "BoolFilter", "Bundle", "CompoundFilter", "ConflictError", "ConstFilter", "Dimension", "DimensionBoolFilter", "DimensionIndicesFilter", "DimensionSliceFilter", "Filter", "GroupDimensionBy", "GroupViewBy", "IndicesFilter", "RowsFilter", "SliceFilter", "Tensor", "TensorBoolFilter", "TensorFilter", "TensorIndicesFilter", "TensorRef", "TensorSliceFilter", "TensorValue", "Transaction", "View", "Workspace", "WorkspaceManager", "connect", "create_workspace", "wrap"]
