"""Parameters of the engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

# The defaults that results depend on.
STALE_MINUTES = 60
FULL_DAY_CLOSED_RATIO = 0.9
MIN_INTERVAL_MINUTES = 5
OPEN_BUFFER_MINUTES, CLOSE_BUFFER_MINUTES = 30, 60
SHOW_OPEN_BUFFER_MINUTES, SHOW_CLOSE_BUFFER_MINUTES = 30, 45
ZONE = "America/Los_Angeles"
RAW_VERSION, ANALYZER_VERSION = "raw-wait-observation.v1", "bootstrap-analyzer.v0.5"


@dataclass(frozen=True)
class Settings:
    """``blank_as_zero``: a blank wait counts as 0 (the default), else as missing."""

    stale_minutes: float = STALE_MINUTES
    full_day_closed_ratio: float = FULL_DAY_CLOSED_RATIO
    min_interval_minutes: float = MIN_INTERVAL_MINUTES
    open_buffer_minutes: float = OPEN_BUFFER_MINUTES
    close_buffer_minutes: float = CLOSE_BUFFER_MINUTES
    zone: str = ZONE
    blank_as_zero: bool = True


def settings_from(arguments: list[str], environment: dict[str, str], **defaults) -> Settings:
    """Settings by ``--name=value`` arguments, else by variables of the same name in capitals, else the defaults.

    Unknown arguments are left to others; a value that is no number is an error that names it.
    """
    told = {a[2:].split("=", 1)[0].replace("-", "_"): a.split("=", 1)[1] for a in arguments if a.startswith("--") and "=" in a}
    found = dict(defaults)
    for field in fields(Settings):
        text = told.get(field.name, environment.get(field.name.upper()))
        if text is None:
            continue
        if field.name == "blank_as_zero":
            found[field.name] = text.lower() == "true"
        elif field.name == "zone":
            found[field.name] = text
        else:
            try:
                found[field.name] = float(text)
            except ValueError:
                raise ValueError(f"{field.name} is not a number: {text}") from None
    return Settings(**found)
