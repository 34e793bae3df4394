"""Several statements as one commit."""

from __future__ import annotations

import copy
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from .workspace import WorkspaceManager


class Transaction:
    """with Transaction(ws): all changes under ws's root become visible together at the end; an error undoes all."""

    def __init__(self, ws: WorkspaceManager):
        self.catalog = ws._catalog

    def __enter__(self) -> Transaction:
        if not self.catalog.depth:
            self.catalog.refresh()
            self.before = copy.deepcopy(self.catalog.tree)
        self.catalog.depth += 1
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        self.catalog.depth -= 1
        if self.catalog.depth:
            return
        if kind is not None:
            self.catalog.rollback(self.before)
            return
        try:
            self.catalog.commit()
        except BaseException:
            self.catalog.rollback(self.before)
            self.catalog.refresh()
            raise
