"""What the next session is told of the last one, line by line under a budget of tokens."""

from __future__ import annotations

import math
import re

from . import fixed as X
from . import signals as S

INVISIBLE = re.compile(f"[{X.INVISIBLE}]")

#: Tokens that each line may take at most, in the order in which the lines are served.
LINE_BUDGETS = {"request": 70, "left": 110, "checks": 60, "commits": 45, "worktree": 55, "goal": 55, "earlier": 50, "end": 90}
SHORTEST, SHRINK = 20, 0.85


def token_count(text: str) -> int:
    ascii_ = sum(c < "\x80" for c in text)
    return math.ceil(ascii_ / 4 + (len(text) - ascii_) / 1.3)


def fitted(text: str, budget: int, end: bool = False) -> str:
    """The text cut to a budget, from its end or (``end``) from its start; nothing where little would be left."""
    if budget <= 0 or not text:
        return ""
    if token_count(text) <= budget:
        return text
    cut = (lambda n: "…" + text[-n:]) if end else (lambda n: text[:n] + "…")
    n = len(text)
    while n > SHORTEST and token_count(cut(n)) > budget:
        n = math.floor(n * SHRINK)
    if n <= SHORTEST:
        return ""
    return "…" + text[-n:].lstrip() if end else text[:n].rstrip() + "…"


def clean(text: str, prompt: bool) -> str:
    bare = S.strip_pasted(text) if prompt else S.FENCED.sub(" ", text)
    return S.collapse(INVISIBLE.sub("", bare))


def last_paragraph(reply: str) -> str:
    blocks = [b.strip() for b in re.split(r"\n\s*\n", S.FENCED.sub(" ", reply)) if b.strip()]
    return blocks[-1] if len(blocks) > 1 else ""


def hand_over(prompts: list[str], opening: list[str], count: int, reply: str, checks: list[tuple[str, bool | None, str | None]], worktree: str, commits: list[str], header: str, budget: int) -> list[str]:
    """The lines, in reading order, with the header first: goal, requests, reply, what is left, checks, commits, work tree.

    Lines are served in the order of what helps most; each takes its share and one token for its break.
    """
    left = budget - token_count(header)
    lines: dict[str, str] = {}

    def serve(name: str, text: str, most: int, end: bool = False) -> None:
        nonlocal left
        line = fitted(text, min(left, most), end)
        if line:
            lines[name] = line
            left -= token_count(line) + 1

    normal = [p for p in prompts if S.prompt_kind(p) == "normal"] or prompts
    recent = [c for p in normal[-2:] if (c := clean(p, True))]
    last = recent[-1] if recent else ""
    first = next((c for p in opening if (c := clean(p, True)) and S.prompt_kind(c) == "normal"), "")
    goal = first if first and count > 1 and first != last else ""
    earlier = recent[0] if len(recent) > 1 and recent[0] != goal else ""
    before, pending = S.split_pending(reply)
    said = clean(before if pending else reply, False)
    if last:
        serve("request", f"{'Last request' if goal or earlier else 'Request'}: {last}", LINE_BUDGETS["request"])
    if pending:
        serve("left", f"Left to do: {clean(pending, False)}", LINE_BUDGETS["left"])
    shown = sorted(checks[-6:], key=lambda c: c[1] is None)[:4]
    if shown:
        state = lambda ok, sign: "not known" if ok is None else "passed" if ok else f"failed ({sign})" if sign else "failed"
        serve("checks", "Checks: " + ", ".join(f"`{name}` {state(ok, sign)}" for name, ok, sign in shown), LINE_BUDGETS["checks"])
    if commits:
        serve("commits", "Commits: " + "; ".join(commits[:3]), LINE_BUDGETS["commits"])
    if worktree:
        serve("worktree", f"Work tree: {worktree}", LINE_BUDGETS["worktree"])
    if goal:
        serve("goal", f"Goal: {goal}", LINE_BUDGETS["goal"])
    if earlier:
        serve("earlier", f"Request: {earlier}", LINE_BUDGETS["earlier"])
    tail = "" if pending else last_paragraph(reply)
    if tail and left > 40:
        serve("end", f"Reply ends: {clean(tail, False)}", min(left - 30, LINE_BUDGETS["end"]), True)
    if said and left > 25:
        serve("reply", f"{'Reply begins' if 'end' in lines or token_count(said) > left else 'Reply'}: {said}", left)
    order = ("goal", "earlier", "request", "reply", "end", "left", "checks", "commits", "worktree")
    return [header, *(lines[k] for k in order if k in lines)] if lines else []


def fallback_summary(reply: str | None, files: int, commands: int) -> tuple[str, str]:
    """(kind, text) of a turn without a model: the start of what was said, code left out, and what kind of turn it was."""
    kind = "change" if files else "investigation" if commands else "answer" if reply else "none"
    if not reply:
        return kind, "No summary (no model was available and no reply was recorded)."
    text = " ".join(re.sub(r"```[\s\S]*?```", "[code]", reply).split())
    return kind, "Reply (first part, not summarised): " + (text if len(text) <= 700 else text[:699] + "…")

