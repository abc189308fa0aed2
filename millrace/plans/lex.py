"""SQL tokens, and what is cut at them: pipeline stages, statements, placeholders."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import QueryError

_TOKEN = re.compile(
    r"""(?P<string>'(?:[^']|'')*')
      | (?P<quoted>"(?:[^"]|"")*")
      | (?P<tick>`(?:[^`]|``)*`)
      | (?P<comment>--[^\n]*|/\*.*?\*/)
      | (?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
      | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<space>\s+)
      | (?P<op>\|\||::|<=|>=|<>|!=|->|=>|.)""",
    re.X | re.S,
)

_OPTIONS = re.compile(_TOKEN.pattern.replace(r"--[^\n]*|", ""), re.X | re.S)
_SQL = {"", "SELECT", "WITH", "FROM", "VALUES", "TABLE", "SHOW", "DESCRIBE", "SUMMARIZE", "EXPLAIN", "PIVOT", "UNPIVOT", "CALL", "PRAGMA"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    @property
    def key(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


def tokens(sql: str) -> list[Token]:
    return [Token(m.lastgroup, m.group()) for m in _TOKEN.finditer(sql)]


def text_of(ts: list[Token]) -> str:
    return "".join(t.text for t in ts)


def _cut(text: str, at: str) -> list[str]:
    parts, start = [[]], 0
    for t in tokens(text):
        if t.kind == "op" and t.text == at:
            parts.append([])
        else:
            parts[-1].append(t.text)
    return ["".join(p).strip() for p in parts]


def split_pipeline(text: str) -> list[str]:
    """Stages between top-level pipes. Pipes in quotes, in comments, and doubled ones don't separate; in an operator's stage -- begins an option, not a comment."""
    stages, at = [], 0
    while at <= len(text):
        pattern = _TOKEN if leading_word(text[at:]).upper() in _SQL else _OPTIONS
        end = next((m.start() for m in pattern.finditer(text, at) if m.group() == "|"), len(text))
        stages.append(text[at:end].strip())
        at = end + 1
    if not all(stages):
        raise QueryError("the pipeline has an empty stage")
    return stages


def statements(text: str) -> list[str]:
    return [s for s in _cut(text, ";") if s]


def placeholders(sql: str) -> int:
    """Question marks outside quotes and comments."""
    return sum(t.kind == "op" and t.text == "?" for t in tokens(sql))


def leading_word(stage: str) -> str:
    for t in tokens(stage):
        if t.kind not in ("space", "comment"):
            return t.text if t.kind == "word" else ""
    return ""
