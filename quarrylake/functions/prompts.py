"""What a prompt says, as columns: its kind, questions and statements, flags, sentences worth keeping, what it goes on from."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from . import text as T
from .screening import ascii_edges
from .signals import column, strip_pasted

NAME = r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*"
#: Signs at the end of a sentence that are no word.
TAIL = r"[\s.!~…;:)\]\"'`ㅋㅎㅠㅜ^]+$"


def says(text: Column, patterns: Iterable[str]) -> Column:
    """Whether one of the patterns is in the text, in any case."""
    return text.rlike(ascii_edges("(?i)" + "|".join(f"(?:{p})" for p in patterns)))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def own_words(prompt: Column) -> Column:
    """The prompt without pasted parts."""
    return column(strip_pasted, "string")(prompt)


def kind(prompt: Column) -> Column:
    bare = stripped(prompt)
    return F.when(bare.rlike("^[/!]"), "command").when((bare == "") | says(bare, (X.ACK,)), "ack").otherwise("normal")


def asks(sentence: Column) -> Column:
    """Ends in a question mark or in a Korean ending that asks, or begins as an English question does."""

    def of(bare: Column) -> Column:
        last = F.regexp_extract(bare, r"(\S+)$", 1)
        english = says(F.regexp_replace(bare, r"\s+", " "), (f"^(?:{X.EN_QUESTION_START})",))
        return sentence.rlike(r"[?？]\s*$") | F.when(last.rlike("[가-힣]"), last.rlike(X.KO_QUESTION_END)).otherwise(english)

    return T.bound(F.regexp_replace(stripped(sentence), TAIL, ""), of)


def states(sentence: Column) -> Column:
    """Two words or more that neither ask nor are limited to the task at hand."""
    return F.regexp_replace(stripped(sentence), TAIL, "").rlike(r"\S\s+\S") & ~says(sentence, X.TASK_ONLY) & ~asks(sentence)


def has_statement(prompt: Column, own: Column) -> Column:
    """``own`` are the prompt's own words."""
    return (kind(prompt) == "normal") & F.exists(T.sentences(own), states)


def accepts(prompt: Column, reply: Column) -> Column:
    """A mere yes to a reply that ends in a proposal."""
    return F.coalesce((kind(prompt) == "ack") & says(F.right(stripped(reply), F.lit(X.PROPOSAL_TAIL)), X.PROPOSAL), F.lit(False))


EXPLICIT = (("durable", X.DURABLE), ("correction", X.CORRECTION), ("one-off", X.ONE_OFF), ("remember", X.REMEMBER))


def explicit_flags(own: Column) -> Column:
    return F.array_compact(F.array(*[F.when(says(own, patterns), name) for name, patterns in EXPLICIT]))


def flags(prompt: Column, reply: Column, own: Column) -> Column:
    """Flags of a prompt in fixed order; implicit ones only where no explicit one but that for one time is there."""
    told, accepted = explicit_flags(own), accepts(prompt, reply)
    implicit = F.array_compact(F.array(F.when(accepted | has_statement(prompt, own), "implicit"), F.when(accepted, "accept")))
    return F.when(F.size(F.array_except(told, F.array(F.lit("one-off")))) > 0, told).otherwise(F.concat(told, implicit))


def candidates(own: Column, most: int = 3) -> Column:
    """The first sentences of 6 to 300 signs that ask for something lasting, and neither ask back nor are for one time."""

    def lasting(s: Column) -> Column:
        return (says(s, X.DURABLE) | says(s, X.REMEMBER)) & ~says(s, X.ONE_OFF) & ~asks(s) & F.length(s).between(6, 300)

    return F.slice(F.filter(T.sentences(own), lasting), 1, most)


def salient(text: Column) -> Column:
    """Names with a capital, digit, dot or underscore after their first letter, and paths, in lower case."""
    names = F.regexp_extract_all(T.nfkc(text), F.lit(NAME), F.lit(0))
    marked = F.filter(names, lambda n: (F.length(n) >= 4) & n.rlike(r"^.+[A-Z_.$0-9]"))
    return F.array_distinct(F.transform(F.concat(marked, T.path_hints(text)), F.lower))


def continues(prompt: Column, before: Column) -> Column:
    """The prompt says that it goes on, or shares two salient names with what was said before, or its only one."""
    mine = salient(prompt)
    shared = F.size(F.array_intersect(mine, salient(before)))
    return says(prompt, (X.CONTINUE_CUE,)) | (shared >= 2) | (shared == 1) & (F.size(mine) == 1)
