"""Models of a worker. A task gets its closure anew, so a model is known by a name that the driver gave its loader, not by the loader."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable

_NAMES: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: The worker's model by its name; one at a time.
_HELD: dict[str, object] = {}


def name_of(load: Callable) -> str:
    """On the driver: a name for this loader, the same whenever it is asked for; another function has another."""
    try:
        return _NAMES.setdefault(load, uuid.uuid4().hex)
    except TypeError:  # a callable that can't be referred to weakly
        return uuid.uuid4().hex


def held(name: str, load: Callable):
    """In a worker: the model of this name, loaded if another one or none is held."""
    if name not in _HELD:
        _HELD.clear()  # before the next is loaded
        _HELD[name] = load()
    return _HELD[name]
