"""Names for working columns."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores after it as it takes to be none of ``columns``, capitals apart."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def others(columns: Iterable[str], *made: str) -> list[str]:
    """``columns`` without those that an operator makes anew, each quoted for ``select``."""
    gone = {c.lower() for c in made}
    return [f"`{c.replace('`', '``')}`" for c in columns if c.lower() not in gone]
