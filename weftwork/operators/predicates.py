"""Filters on declarations: platform, internal, preconditions."""

from __future__ import annotations

import platform
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that make a precondition true.
TRUE = ("true", "True", "1")
# Other names that systems and processors go by.
SYSTEMS = {"darwin": "macos"}
PROCESSORS = {"x86_64": "amd64", "aarch64": "arm64"}


def host() -> tuple[str, str]:
    """This machine's system and processor, as platform lists name them."""
    system, processor = platform.system().lower(), platform.machine().lower()
    return SYSTEMS.get(system, system), PROCESSORS.get(processor, processor)


def on_platform(platforms: Iterable[str] | None, system: str, processor: str) -> bool:
    """No list, or one that has the system, the processor, or both as system/processor; blanks and case don't count."""
    if platforms is None:
        return True
    held = {p.replace(" ", "").lower() for p in platforms}
    return bool(held & {system, processor, f"{system}/{processor}"})


def platform_matches(platforms: Column, system: Column | str, processor: Column | str) -> Column:
    """The same for an array column."""
    system, processor = (x if isinstance(x, Column) else F.lit(x) for x in (system, processor))
    held = F.transform(platforms, lambda p: F.lower(F.replace(p, F.lit(" "))))
    return platforms.isNull() | F.arrays_overlap(held, F.array(system, processor, F.concat_ws("/", system, processor)))


def visible(internal: Column) -> Column:
    """Not internal; a missing flag means visible."""
    return ~F.coalesce(internal, F.lit(False))


def is_true(text: Column) -> Column:
    return F.trim(text).isin(*TRUE)


def all_true(text: Column) -> Column:
    """Aggregate: whether every text of a group is true; no text, or none but nulls, means yes."""
    return F.coalesce(F.bool_and(is_true(text)), F.lit(True))
