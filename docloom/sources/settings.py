"""Settings from a YAML or JSON file on the driver."""

from __future__ import annotations

import functools
import json
import os

import_error: ImportError | None = None
try:
    import yaml
except ImportError as e:  # JSON files can be read without it
    yaml, import_error = None, e


@functools.lru_cache(maxsize=8)
def load(path: str) -> dict:
    """The file's settings; relative paths under "paths" count from its folder, which is "_project_root". Read once."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            found = json.load(f)
        elif yaml is None:
            raise import_error
        else:
            found = yaml.safe_load(f) or {}
    root = os.path.dirname(os.path.abspath(path))
    paths = found.get("paths") or {}
    return found | {"paths": {k: os.path.join(root, v) if isinstance(v, str) and v else v for k, v in paths.items()}, "_project_root": root}
