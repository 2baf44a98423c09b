"""Fixed values of the published format, read from the fixture beside this module."""

from __future__ import annotations

import json
from importlib.resources import files

VALUES: dict[str, str] = json.loads((files(__package__) / "format.json").read_text())
