"""What Python workers keep from task to task: words with their ids, by operator.

Workers outlive tasks and run those of any operator, so when another operator's
task begins, what is kept for the others goes.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_kept: dict[str, dict[str, Any]] = {}


def kept(owner: str, name: str, make: Callable[[], Any]) -> Any:
    """The owner's thing of that name, made once a worker while no other owner's task comes in between."""
    only(owner)
    own = _kept.setdefault(owner, {})
    if name not in own:
        own[name] = make()
    return own[name]


def only(owner: str) -> None:
    """A task of this owner begins."""
    for other in [o for o in _kept if o != owner]:
        del _kept[other]
