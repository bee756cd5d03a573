"""Settings in files that extend one another."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from pathlib import PurePosixPath
from typing import Any


def overlaid(base: Mapping[str, Any], extra: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with ``extra`` over it: mappings join key by key, anything else replaces what was there. Neither is changed."""
    joined = {**base, **extra}
    both = [k for k in extra if isinstance(extra[k], Mapping) and isinstance(base.get(k), Mapping)]
    return joined | {k: overlaid(base[k], extra[k]) for k in both}


def resolved(name: str, read: Callable[[str], str], parse: Callable[[str], Any] = json.loads) -> dict[str, Any]:
    """The settings of a file over those of the file that its ``extends`` names, beside it, and so on.

    ``read`` gives the text of a name, so that files may lie in any store. Files
    that extend each other in a ring raise.
    """
    chain, seen, at = [], set(), name
    while at:
        if at in seen:
            raise ValueError(f"{at} extends itself")
        seen.add(at)
        own = dict(parse(read(at)) or {})
        parent = own.pop("extends", None)
        chain.append(own)
        at = str(PurePosixPath(at).parent / parent) if parent else ""
    out: dict[str, Any] = {}
    for own in reversed(chain):
        out = overlaid(out, own)
    return out
