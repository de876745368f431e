"""A value that the driver keeps for a while."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Generic, TypeVar

T = TypeVar("T")


class Kept(Generic[T]):
    """What load() gave at most `seconds` ago; drop() makes the next call load anew."""

    def __init__(self, load: Callable[[], T], seconds: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.load, self.seconds, self.clock = load, seconds, clock
        self.value: T | None = None
        self.at: float | None = None

    def __call__(self) -> T:
        if self.at is None or self.clock() - self.at >= self.seconds:
            self.value, self.at = self.load(), self.clock()
        return self.value  # type: ignore[return-value]

    def drop(self) -> None:
        self.at = None

    def having(self, found: Callable[[T], bool]) -> T:
        """The value; loaded once more if what is asked for isn't in it."""
        value = self()
        if not found(value):
            self.drop()
            value = self()
        return value
