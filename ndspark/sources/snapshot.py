"""Export and import of a workspace as one folder: Parquet files and a manifest."""

from __future__ import annotations

import json
from dataclasses import replace
from typing import TYPE_CHECKING, Any

from ..plans import layout
from ..schema import Segment, TensorSpec
from .catalog import Files

if TYPE_CHECKING:
    from ..workspace import WorkspaceManager


def export(ws: WorkspaceManager, path: str, recursive: bool = True) -> None:
    """Each tensor becomes one folder in row form; the manifest is written last, so that a broken export has none."""
    files = Files(ws._spark, path)
    if files.names(""):
        raise FileExistsError(path)

    def put(at: WorkspaceManager, where: str) -> dict[str, Any]:
        node = at._node()
        out: dict[str, Any] = {"dims": node["dims"], "tensors": {}, "workspaces": {}}
        for t in at._tensors():
            spec, name = t.spec, f"{where}{t.name}"
            if spec.segments:
                if spec.jagged:
                    rows = layout.union([at._catalog.frame(s.path).withColumnRenamed(s.column, "v").select("idx", "shape", "v") for s in spec.segments])
                elif spec.rank == 1:
                    rows = layout.columns(at._catalog, {"v": spec})
                else:
                    whole = layout.row_form(at._catalog, spec)
                    rows = layout.rows_of(layout.long_form(at._catalog, spec), spec.rank) if whole is None else whole
                rows.withColumnRenamed("v", t.name).sortWithinPartitions("idx").write.option("compression", "zstd").parquet(f"{path}/{name}")
                spec = replace(spec, segments=(Segment(name, t.name, (0,) * (spec.rank - 1), spec.shape[1:]),))
            out["tensors"][t.name] = spec.to_json()
        if recursive:
            out["workspaces"] = {w._path[-1]: put(w, f"{where}{w._path[-1]}/") for w in at._workspaces()}
        return out

    tree = put(ws, "")
    files.create("snapshot.json", json.dumps(tree))


def restore(ws: WorkspaceManager, path: str) -> None:
    """Copy a snapshot into an empty workspace, in one commit."""
    if any(ws._node().values()):
        raise ValueError("a snapshot is restored into an empty workspace")
    tree = json.loads(Files(ws._spark, path).read("snapshot.json"))

    def copied(node: dict[str, Any]) -> dict[str, Any]:
        tensors = {}
        for name, t in node["tensors"].items():
            spec = TensorSpec.from_json(t)
            segments = tuple(replace(s, path=ws._catalog.write(ws._spark.read.parquet(f"{path}/{s.path}"))) for s in spec.segments)
            tensors[name] = replace(spec, segments=segments).to_json()
        return {"dims": node["dims"], "tensors": tensors, "workspaces": {k: copied(v) for k, v in node["workspaces"].items()}}

    ws._catalog.change(lambda t: ws._catalog.node(ws._path, t).update(copied(tree)))
