"""Tables by name whose plans are built when they are asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql import DataFrame


class LazyTables(Mapping):
    """Event tables whose plans are built when they are first asked for."""

    def __init__(self, names: Iterable[str], build: Callable[[str], DataFrame]):
        self._names, self._build, self._built = list(names), build, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name not in self._names:
                raise KeyError(name)
            self._built[name] = self._build(name)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)
