"""Things a Python worker builds once: generators (U1) and tokenizers.

Workers outlive their tasks.  A factory is called when a worker first needs what
it makes and not again for the worker's next tasks; of each kind a worker holds one
thing at a time, and what it lets go is closed if it can be.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

_HELD: dict[str, tuple[str, object]] = {}


def new_key() -> str:
    """A key made on the driver; it goes to the tasks with the plan, so all of them share it."""
    return uuid.uuid4().hex


def held(kind: str, key: str, factory: Callable[[], object]):
    """What ``factory`` makes, kept by this worker under ``kind`` until another key asks for it."""
    if kind not in _HELD or _HELD[kind][0] != key:
        release(kind)
        _HELD[kind] = (key, factory())
    return _HELD[kind][1]


def release(kind: str) -> None:
    """Let go of what is held and close it."""
    _, thing = _HELD.pop(kind, (None, None))
    close = getattr(thing, "close", None)
    if callable(close):
        close()
