"""Things that a Python worker keeps from task to task."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable
from typing import Any

_HOME = "_slink_worker"


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """`make()` once per worker process and key.

    Task code travels by value, so the globals of its modules are new in each task; a module of the process is not.
    """
    home = sys.modules.setdefault(_HOME, types.ModuleType(_HOME)).__dict__
    if key not in home:
        home[key] = make()
    return home[key]


class Generations:
    """A bounded memory that frequent keys stay in.

    When the young generation is full it becomes the old one, and what was in the old one is let go; a key found in
    the old one moves up. So keys that come again stay and those that came once leave.
    """

    def __init__(self, entries: int):
        self.half = max(1, entries // 2)
        self.young: dict = {}
        self.old: dict = {}

    def holding(self, keys: set, make: Callable[[list], Iterable]) -> dict:
        """A mapping with (at least) all the keys; `make` gives the values of the missing ones, in their order."""
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        fresh = keys.difference(self.young)
        back = self.old.keys() & fresh
        self.young.update(zip(back, map(self.old.__getitem__, back), strict=True))
        missing = list(fresh.difference(back))
        self.young.update(zip(missing, make(missing), strict=True))
        return self.young
