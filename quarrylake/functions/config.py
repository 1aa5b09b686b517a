"""Settings: defaults, ranges and allowed words, and the normalisation of what a file says."""

from __future__ import annotations

import json
import re

#: Number settings as (default, least, most).
NUMBERS = {
    "inject.core_budget_tokens": (1500, 100, 20000), "inject.scoped_budget_tokens": (600, 0, 20000), "inject.prompt_budget_tokens": (400, 0, 5000), "inject.session_budget_tokens": (800, 0, 5000), "inject.handoff_budget_tokens": (400, 0, 2000),
    "llm.qualify_runs": (2, 1, 5), "llm.max_calls_per_hour": (60, 0, 1000), "llm.qualify_calls_per_hour": (60, 0, 1000), "llm.timeout_seconds": (120, 10, 900), "llm.pricing_refresh_days": (7, 0, 365),
    "memory.proposed_ttl_days": (60, 1, 3650), "memory.event_retention_days": (90, 1, 3650), "memory.unprocessed_retention_days": (180, 1, 3650), "code_index.max_file_kb": (1024, 16, 16384), "history.max_calls_per_hour": (30, 0, 1000),
}
#: Word settings as (default where absent, what an unknown word becomes, the words).
WORDS = {"language": ("ko", "ko", ("ko", "en")), "git.commit_mode": ("ride-along", "manual", ("ride-along", "auto-commit", "manual")), "llm.host_tool": ("only", "only", ("only", "prefer", "any")), "llm.max_tier": ("large", "large", ("small", "medium", "large"))}
FLAGS = {"llm.qualify": True, "memory.personal": True, "memory.implicit_rules": True, "code_index.enabled": True}


def clamp(value: float, least: float, most: float) -> float:
    return max(least, min(most, value))


def normal_settings(text: str) -> dict[str, object]:
    """All settings of a JSON text by their dotted names; wrong or missing ones take their defaults, numbers their range."""
    try:
        raw = json.loads(text)
    except ValueError:
        raw = {}

    def at(name: str) -> object:
        here = raw
        for part in name.split("."):
            here = here.get(part) if isinstance(here, dict) else None
        return here

    out: dict[str, object] = {}
    for name, (default, least, most) in NUMBERS.items():
        value = at(name)
        out[name] = clamp(value, least, most) if isinstance(value, (int, float)) and not isinstance(value, bool) else default
    for name, (absent, unknown, words) in WORDS.items():
        value = at(name)
        out[name] = value if value in words else absent if value is None else unknown
    out |= {name: value if isinstance(value := at(name), bool) else default for name, default in FLAGS.items()}
    exclude = at("code_index.exclude")
    out["code_index.exclude"] = [g.strip() for g in exclude if isinstance(g, str) and g.strip()] if isinstance(exclude, list) else []
    return out


def shown_settings(text: str, names: str) -> str:
    """The named settings as text."""
    found = normal_settings(text)
    return "|".join(re.sub(r"\.0$", "", json.dumps(found[n])) for n in names.split(","))
