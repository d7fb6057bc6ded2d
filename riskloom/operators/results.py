"""Result objects that the operators return."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from riskloom.sources.tables import write_csv


def jsonable(x: Any) -> Any:
    if isinstance(x, dict):
        return {str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [jsonable(v) for v in x]
    if isinstance(x, float) and x != x:
        return None
    return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


@dataclass
class Result:
    """A decision log (table), the chosen features, details, and a plot specification."""

    name: str
    table: DataFrame
    selected: list[str]
    info: dict = field(default_factory=dict)
    plotter: Any = None

    def dropped(self, features: list[str]) -> list[str]:
        return [f for f in features if f not in set(self.selected)]

    def plot(self) -> dict | None:
        return self.plotter(self) if self.plotter else None

    def save(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        write_csv(self.table, f"{folder}/{self.name}.csv", single_file=True)
        with open(f"{folder}/{self.name}.json", "w") as f:
            json.dump(jsonable({"selected": self.selected, "info": self.info}), f, indent=1)

    def __repr__(self) -> str:
        return f"Result({self.name}: {len(self.selected)} selected)"
