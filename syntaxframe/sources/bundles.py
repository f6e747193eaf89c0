"""Reading grammar bundles."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from ..errors import BundleError, WasmRuntimeUnavailableError
from ..grammar.ir import GrammarModel
from ..grammar.tables import Tables, build_tables
from ..schema import NodeSchema
from ..valuemap import ValueMap

NEWEST = 2


@dataclass
class Bundle:
    name: str
    tables: Tables
    schema: NodeSchema | None
    value_map: ValueMap | None
    scanner: str | None
    metadata: dict


def load_bundle(directory: str | Path) -> Bundle:
    """The bundle in a folder. Its format may be missing (then 1); what cannot be used raises BundleError."""
    directory = Path(directory)
    try:
        said = json.loads((directory / "metadata.json").read_text(encoding="utf-8"))
    except FileNotFoundError as error:
        raise BundleError(f"{directory} has no metadata.json") from error
    except ValueError as error:
        raise BundleError(f"metadata of {directory} is not JSON: {error}") from error
    version = said.get("bundle_format", 1)
    if not isinstance(version, int) or isinstance(version, bool):
        raise BundleError(f"bundle_format is no integer: {version!r}")
    if version > NEWEST:
        raise BundleError(f"bundle_format {version} is newer than {NEWEST}")
    if not said.get("name"):
        raise BundleError("the bundle has no name")
    artifact = str(said.get("artifact") or "grammar.json")
    if artifact.endswith(".wasm"):
        raise WasmRuntimeUnavailableError(f"{artifact}: there is no WebAssembly runtime")
    if not (directory / artifact).exists():
        raise BundleError(f"{directory} has no {artifact}")
    model = GrammarModel.load(directory / artifact)
    schema = directory / str(said.get("schema") or "node-schema.json")
    values = said.get("value_map")
    return Bundle(
        said["name"], build_tables(model), NodeSchema.from_node_types_json(schema) if schema.exists() else None,
        ValueMap.of(values) if values else None, said.get("scanner"), said,
    )
