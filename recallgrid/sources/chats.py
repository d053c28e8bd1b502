"""Chat exports of six forms as turns: quoted transcripts, two tools' JSON lines, two JSON exports, a message list."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Turns = list[tuple[str, str]]
_PEOPLE = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant"}

#: How much of a tool's result is shown.
HEAD_LINES, TAIL_LINES, MATCHES, RESULT_CHARS, COMMAND_CHARS = 20, 20, 20, 2048, 200


def _tool_use(block: dict) -> str:
    given = block.get("input") or {}
    name = block.get("name", "Unknown")
    if name == "Bash":
        command = str(given.get("command", ""))
        return "[Bash] " + (command[:COMMAND_CHARS] + "..." if len(command) > COMMAND_CHARS else command)
    if name == "Read":
        where = given.get("file_path", "?")
        if given.get("offset") is not None and given.get("limit") is not None:
            where = f"{where}:{given['offset']}-{int(given['offset']) + int(given['limit'])}"
        return f"[Read {where}]"
    if name in ("Grep", "Glob"):
        return f"[{name}] {given.get('pattern', '')}" + (f" in {given.get('path') or given.get('glob') or ''}" if name == "Grep" else "")
    if name in ("Edit", "Write"):
        return f"[{name} {given.get('file_path', '?')}]"
    shown = json.dumps(given)
    return f"[{name}] " + (shown[:COMMAND_CHARS] + "..." if len(shown) > COMMAND_CHARS else shown)


def _tool_result(content, tool: str) -> str:
    text = _flat(content, {})
    if not text or tool in ("Read", "Edit", "Write"):
        return ""
    lines = text.split("\n")
    if tool == "Bash":
        if len(lines) > HEAD_LINES + TAIL_LINES:
            lines = [*lines[:HEAD_LINES], f"... [{len(lines) - HEAD_LINES - TAIL_LINES} lines left out] ...", *lines[-TAIL_LINES:]]
    elif tool in ("Grep", "Glob"):
        if len(lines) > MATCHES:
            lines = [*lines[:MATCHES], f"... [{len(lines) - MATCHES} more matches]"]
    elif len(text) > RESULT_CHARS:
        lines = [text[:RESULT_CHARS] + f"... [{len(text) - RESULT_CHARS} chars left out]"]
    return "\n".join("→ " + line for line in lines)


def _flat(content, tools: dict[str, str]) -> str:
    """The text of a message: a string, a block, or a list of strings, texts, tool uses and results."""
    if isinstance(content, dict):
        return str(content.get("text") or "").strip()
    if not isinstance(content, list):
        return content.strip() if isinstance(content, str) else ""
    parts = []
    for block in content:
        if isinstance(block, str):
            parts.append(block)
        elif isinstance(block, dict):
            kind = block.get("type")
            parts.append(block.get("text") or "" if kind == "text" else _tool_use(block) if kind == "tool_use" else _tool_result(block.get("content", ""), tools.get(block.get("tool_use_id"), "Unknown")) if kind == "tool_result" else "")
    return "\n".join(p for p in parts if p).strip()


def _objects(text: str) -> list[dict]:
    out = []
    for line in text.split("\n"):
        try:
            entry = json.loads(line)
        except ValueError:
            continue
        if isinstance(entry, dict):
            out.append(entry)
    return out


def quoted(text: str) -> Turns:
    """Lines that begin with > are a user's; what follows is the reply."""
    lines = text.split("\n")
    if sum(line.strip().startswith(">") for line in lines) < 3:
        return []
    turns: Turns = []
    for line in lines:
        bare = line.strip()
        if bare.startswith(">"):
            turns.append(("user", bare[1:].strip()))
        elif bare and not bare.startswith("---") and turns:
            if turns[-1][0] == "user":
                turns.append(("assistant", bare))
            else:
                turns[-1] = ("assistant", turns[-1][1] + "\n" + bare)
    return turns


def agent_lines(text: str) -> Turns:
    """JSON lines of a coding agent: results of tools belong to the assistant's turn, and its turns in a row are one."""
    turns: Turns = []
    tools: dict[str, str] = {}
    for entry in _objects(text):
        role = _PEOPLE.get(entry.get("type", ""))
        content = entry["message"].get("content", "") if role and isinstance(entry.get("message"), dict) else None
        if content is None:
            continue
        blocks = [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []
        tools |= {b.get("id"): b.get("name", "Unknown") for b in blocks if b.get("type") == "tool_use"}
        said = _flat(content, tools)
        results = bool(blocks) and len(blocks) == len(content) and all(b.get("type") == "tool_result" for b in blocks)
        if not said:
            continue
        if turns and turns[-1][0] == "assistant" and (role == "assistant" or results):
            turns[-1] = ("assistant", turns[-1][1] + "\n" + said)
        elif not results:
            turns.append((role, said))
    return turns


def session_lines(text: str) -> Turns:
    """JSON lines with a session_meta entry; events of the user and of the agent are the turns."""
    entries = _objects(text)
    if not any(e.get("type") == "session_meta" for e in entries):
        return []
    kinds = {"user_message": "user", "agent_message": "assistant"}
    events = [e["payload"] for e in entries if e.get("type") == "event_msg" and isinstance(e.get("payload"), dict)]
    return [(kinds[p["type"]], p["message"].strip()) for p in events if p.get("type") in kinds and isinstance(p.get("message"), str) and p["message"].strip()]


def _list(items) -> Turns:
    turns: Turns = []
    for item in items if isinstance(items, list) else []:
        if isinstance(item, dict) and (role := _PEOPLE.get(item.get("role") or item.get("sender") or "")):
            if said := _flat(item.get("content", ""), {}) or str(item.get("text") or "").strip():
                turns.append((role, said))
    return turns


def export(data) -> Turns:
    """messages or chat_messages of an object, a list of messages, or a list of such objects."""
    if isinstance(data, dict):
        data = data.get("messages", data.get("chat_messages"))
    if not isinstance(data, list):
        return []
    if data and isinstance(data[0], dict) and ("messages" in data[0] or "chat_messages" in data[0]):
        each = [_list(c.get("chat_messages") or c.get("messages")) for c in data if isinstance(c, dict)]
        return [turn for turns in each if len(turns) >= 2 for turn in turns]
    return _list(data)


def mapping(data) -> Turns:
    """A tree of messages: from the root (without a message, if there is such) always to the first child."""
    nodes = data.get("mapping") if isinstance(data, dict) else None
    if not isinstance(nodes, dict):
        return []
    roots = sorted((n.get("message") is not None, i) for i, n in enumerate(nodes.values()) if n.get("parent") is None)
    at = list(nodes)[roots[0][1]] if roots else None
    turns, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        node = nodes.get(at) or {}
        message = node.get("message") or {}
        content = message.get("content")
        parts = content.get("parts") or [] if isinstance(content, dict) else []
        said = " ".join(p for p in parts if isinstance(p, str) and p).strip()
        role = (message.get("author") or {}).get("role")
        if said and role in ("user", "assistant"):
            turns.append((role, said))
        at = (node.get("children") or [None])[0]
    return turns


def channel(data) -> Turns:
    """Messages of a channel: the first speaker is the user, and a new one has the role that did not speak last."""
    turns: Turns = []
    roles: dict[str, str] = {}
    for item in data if isinstance(data, list) else []:
        if not isinstance(item, dict) or item.get("type") != "message":
            continue
        who, said = item.get("user", item.get("username", "")), str(item.get("text") or "").strip()
        if who and said:
            turns.append((roles.setdefault(who, "assistant" if turns and turns[-1][0] == "user" else "user"), said))
    return turns


def read_turns(text: str) -> Turns:
    """The turns of a file of any of the forms, tried in a fixed order; none with fewer than two."""
    forms = [lambda: quoted(text), lambda: agent_lines(text), lambda: session_lines(text)]
    if text.strip()[:1] in ("{", "["):
        try:
            data = json.loads(text)
        except ValueError:
            data = None
        forms += [lambda: export(data), lambda: mapping(data), lambda: channel(data)]
    for form in forms:
        turns = form()
        if len(turns) >= 2:
            return turns
    return []


def conversation_turns(files: DataFrame) -> DataFrame:
    """path, turn, role, text of files (path, document) that are conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, i, role, said) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (role, said) in enumerate(read_turns(t or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 1 else pa.string()) for k in range(4)], ["path", "turn", "role", "text"])

    return files.select("path", "document").mapInArrow(run, "path string, turn int, role string, text string")
