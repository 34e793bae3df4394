"""The storage contract: create, list, delete, resize, read and write arrays by path, over any workspace."""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import TYPE_CHECKING, Any

import numpy as np

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from ..workspace import WorkspaceManager


class Storage(ABC):
    """Paths are dotted names; reading or writing outside a tensor raises IndexError; growing fills with the type's default."""

    @abstractmethod
    def create(self, path: str, dtype: str, dims: tuple, values: Any = None) -> None: ...

    @abstractmethod
    def list(self, path: str = "") -> list[str]: ...

    @abstractmethod
    def delete(self, path: str) -> None: ...

    @abstractmethod
    def resize(self, path: str, size: int) -> None: ...

    @abstractmethod
    def read(self, path: str, item: Any = slice(None)) -> DataFrame: ...

    @abstractmethod
    def write(self, path: str, item: Any, values: Any) -> None: ...


class WorkspaceStorage(Storage):
    def __init__(self, root: WorkspaceManager):
        self.root = root

    def _at(self, path: str) -> tuple[WorkspaceManager, str]:
        head, _, name = path.rpartition(".")
        return (self.root._get_workspace(head) if head else self.root), name

    def create(self, path: str, dtype: str, dims: tuple, values: Any = None) -> None:
        from ..workspace import Tensor, create_workspace

        head, _, name = path.rpartition(".")
        ws = create_workspace(self.root, head) if head else self.root
        if name in ws:
            raise AttributeError(f"{path!r} exists")
        setattr(ws, name, Tensor(dtype, dims, inits=values))

    def list(self, path: str = "") -> list[str]:
        ws = self.root._get_workspace(path) if path else self.root
        return [f"{path}.{n}" if path else n for n in ws]

    def delete(self, path: str) -> None:
        ws, name = self._at(path)
        if name not in ws:
            raise AttributeError(f"no {path!r}")
        delattr(ws, name)

    def resize(self, path: str, size: int) -> None:
        """Grow a dimension; each tensor on it gets rows of its type's default."""
        from ..values import TensorValue

        ws, name = self._at(path)
        dim = ws._get_dimension(name)
        if size < dim.length:
            raise ValueError("dimensions only grow")
        grown = {}
        for t in ws._tensors():
            if name in t.dims and not t.jagged and size > dim.length:
                shape = tuple(size - dim.length if d == name else n for d, n in zip(t.dims, t.shape, strict=True))
                grown[t.name] = TensorValue(np.full(shape, t.spec.kind.default, object if t.dtype == "string" else t.dtype))
        if grown:
            ws._append(name, grown, None)

    def read(self, path: str, item: Any = slice(None)) -> DataFrame:
        ws, name = self._at(path)
        return ws._get_tensor(name)[item]

    def write(self, path: str, item: Any, values: Any) -> None:
        """No silent casts: values must be of the tensor's kind."""
        ws, name = self._at(path)
        t = ws._get_tensor(name)
        kind = np.asarray(values).dtype
        if t.dtype != "string" and not np.can_cast(kind, np.dtype(t.dtype), "same_kind"):
            raise TypeError(f"{kind} doesn't go into {t.dtype}")
        t[item] = values
