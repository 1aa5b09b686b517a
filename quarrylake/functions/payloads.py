"""Hook payloads of several tools as one shape of event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where each field stands, the first non-empty string counts; ``env.`` names a variable of the process.
#: Tools name their fields in snake case, in camel case, or by conversation; one passes its prompt in a variable.
FIELDS = {
    "session": ("session_id", "sessionId", "conversation_id"),
    "cwd": ("cwd", "workspace_roots[0]", "env.CLAUDE_PROJECT_DIR", "env.CURSOR_PROJECT_DIR"),
    "transcript": ("transcript_path", "transcriptPath", "env.CURSOR_TRANSCRIPT_PATH"),
    "model": ("model", "model_id"),
}
#: Fields that only events of one kind have.
OF_KIND = {
    "prompt": ("prompt", ("prompt", "user_prompt")),
    "last_assistant": ("turn_end", ("last_assistant_message", "lastAssistantMessage")),
    "source": ("session_start", ("source", "trigger")),
}


def normalised(tool: Column, kind: Column, payload: Column, env: Column) -> Column:
    """A struct of host, session, cwd, prompt, last_assistant, transcript, model, source and skip; ``payload`` and ``env`` are JSON objects.

    Only strings count, and empty ones do not.  A tool that is run inside another host, by the hooks of both,
    is skipped there.
    """

    def at(path: str) -> Column:
        source, name = (env, path.removeprefix("env.")) if path.startswith("env.") else (payload, path)
        value = F.try_variant_get(F.try_parse_json(source), f"$.{name}", "variant")
        text = F.try_variant_get(value, "$", "string")
        return F.when((F.schema_of_variant(value) == "STRING") & (text != ""), text)

    first = lambda paths: F.coalesce(*map(at, paths))
    inside = F.coalesce(at("env.CURSOR_VERSION"), at("cursor_version")).isNotNull()
    by_variable = F.when(tool == "kiro", at("env.USER_PROMPT"))
    of_kind = {name: F.when(kind == which, F.coalesce(first(paths), by_variable) if name == "prompt" else first(paths)) for name, (which, paths) in OF_KIND.items()}
    columns = {"host": F.when(inside, "cursor").otherwise(tool)} | {name: first(paths) for name, paths in FIELDS.items()} | of_kind | {"skip": inside & (tool != "cursor")}
    return F.struct(*[c.alias(name) for name, c in columns.items()])
