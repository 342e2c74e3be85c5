"""Arguments that callers of the API may pass and that have no meaning here."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

#: Device and output hints.
HINTS = frozenset({"out", "verbose", "flag_verbose", "gpuMemory", "ngpus"})


def hinted(operator: Callable) -> Callable:
    """Accept the hints above, and refuse any other argument that the operator does not name."""
    own = {p for p, v in inspect.signature(operator).parameters.items() if v.kind is not v.VAR_KEYWORD}

    @functools.wraps(operator)
    def run(*args, **kw):
        if unknown := set(kw) - own - HINTS:
            raise TypeError(f"{operator.__name__}() got unexpected arguments {sorted(unknown)}")
        return operator(*args, **kw)

    return run
