"""Named stages over a table: each takes a DataFrame and gives one; what any of them gave can be had by its name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Stage = Callable[[DataFrame], DataFrame]


class Stages:
    """Stages run in the order in which they were added. Plans are made once; adding a stage makes them anew. A name may be
    used once."""

    def __init__(self, source: DataFrame) -> None:
        self._source, self._stages, self._made = source, {}, None

    def add(self, **stages: Stage) -> Stages:
        for name, stage in stages.items():
            if name in self._stages:
                raise ValueError(f"stage {name} is there already")
            self._stages[name] = stage
        self._made = None
        return self

    def _plans(self) -> dict[str, DataFrame]:
        if self._made is None:
            made, now = {}, self._source
            for name, stage in self._stages.items():
                made[name] = now = now.transform(stage)
            self._made = made
        return self._made

    def __getitem__(self, name: str) -> DataFrame:
        return self._plans()[name]

    def result(self) -> DataFrame:
        """What the last stage gave; the source where there is none."""
        return list(self._plans().values())[-1] if self._stages else self._source
