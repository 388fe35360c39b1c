"""What the operators use of the library's shared tables: see ``wavemill.shared``."""

from collections.abc import Iterable

from ..shared import discard, kept, new_folder, partitions, running, same, shared_dir

__all__ = ["discard", "fresh", "yielding", "kept", "new_folder", "partitions", "running", "same", "shared_dir"]


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name``, led by as many underscores as keep it apart from ``columns`` (names do not differ by case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def yielding(keep: Iterable[str], results: Iterable[str]) -> list[str]:
    """The columns to keep; one that is named like a result gives way to it."""
    made = {c.lower() for c in results}
    return [c for c in keep if c.lower() not in made]
