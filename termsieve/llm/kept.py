"""A table of bounded size for what a worker has computed per string, and the strings to keep it by."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable
from itertools import filterfalse

#: Pieces of a text between white space: a word of ASCII or Latin-1 letters apart from punctuation
#: that follows it, or whatever stands together. (\xc3 leads the Latin-1 letters; 97 and b7 after it
#: are the two signs among them.)
LETTERS = rb"[A-Za-z\xc3\x80-\x96\x98-\xb6\xb8-\xbf]+(?=[\s.,;:!?*&$%#]|\Z)"


class Kept:
    """Two generations: what was used since the young one was started survives when it is full."""

    def __init__(self, compute: Callable[[list], Iterable], most: int):
        self.compute, self.half = compute, most // 2
        self.young: dict = {}
        self.old: dict = {}

    def rest(self) -> None:
        """Between tasks only the young generation is held, since a worker may have other work then."""
        self.old = {}

    def of(self, keys: set) -> dict:
        """A dictionary that holds all the keys, until the next call."""
        need = list(filterfalse(self.young.__contains__, keys))
        if need and len(self.young) + len(need) > self.half:
            self.old, self.young, need = self.young, {}, list(keys)
        if need:
            new = []
            for k in need:
                v = self.old.get(k)
                if v is None:
                    new.append(k)
                else:
                    self.young[k] = v
            new.sort()
            self.young.update(zip(new, self.compute(new)))
        return self.young


#: What a worker keeps from task to task, by operator.
_held: dict[str, dict] = {}


def held(name: str) -> dict:
    """An operator's things in this worker."""
    return _held.setdefault(name, {})


def others_go(name: str = "") -> None:
    """Frees what tasks of other operators have left in this worker, which Spark uses again for any task."""
    left = [k for k in _held if k != name]
    for other in left:
        _held.pop(other).clear()
    if left:
        trim()


def trim() -> None:
    """Gives memory that has been freed back to the system."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not that C library
        pass
