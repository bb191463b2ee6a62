"""Shell commands: decoding, redaction, normal form, phase, danger, buckets."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Phases by the first rule that has one of its parts.
_PHASES = (
    ("setup", ("install", "deps.get", "setup", "bootstrap", "npm ci", "mix setup")),
    ("lint", ("clippy", "fmt", "lint", "format", "rustfmt", "eslint", "prettier")),
    ("test", ("test", "spec", "nextest")),
    ("build", ("build", "compile")),
    ("deploy", ("deploy", "release", "publish")),
    ("vcs", ("git ",)),
    ("run", ("run", "serve", "start", "phx.server")),
)
# Parts of dangerous commands and what they are called.
_DESTRUCTIVE = (
    ("rm -rf", "rm -rf"), ("rm -fr", "rm -rf"), ("git push --force", "force push"), ("git push -f", "force push"), ("git reset --hard", "hard reset"), ("git clean", "git clean"),
    ("git checkout -- ", "discard changes"), ("git checkout .", "discard changes"), ("git restore", "discard changes"), ("kubectl delete", "kubectl delete"), ("docker rm", "docker rm"),
    ("docker rmi", "docker rmi"), ("docker volume rm", "docker volume rm"), ("dropdb", "dropdb"), ("drop table", "drop table"), ("drop database", "drop database"), ("dd if=", "dd"), ("mkfs", "mkfs"),
    ("truncate -s 0", "truncate"), ("shred ", "shred"), (" -delete", "find -delete"), ("chmod -r 777", "chmod 777"), ("| sh", "pipe-to-shell"), ("| bash", "pipe-to-shell"),
)
# Patterns of secrets, in this order; what stands for each.
_VALUE = r"""(?:'[^'\\]*(?:\\.[^'\\]*)*'|"[^"\\]*(?:\\.[^"\\]*)*"|\S+)"""
_SECRETS = (
    (rf"(?i)(--?(?:token|api[-_]?key|secret|password|passwd|pwd)[ =]){_VALUE}", "$1<REDACTED>"),
    (rf"(?i)(authorization:\s*bearer\s+){_VALUE}", "$1<REDACTED>"),
    (rf"(?i)((?:x-api-key|x-auth-token|api-key):\s*){_VALUE}", "$1<REDACTED>"),
    (r"(?i)([a-z][a-z0-9+.-]*://[^/:@\s]+:)[^/@\s]+@", "$1<REDACTED>@"),
    (rf"\b([A-Z0-9_]*(?:SECRET|TOKEN|KEY|PASSWORD)[A-Z0-9_]*=){_VALUE}", "$1<REDACTED>"),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "<REDACTED>"),
    (r"\bsk-[A-Za-z0-9]{20,}\b", "<REDACTED>"),
    (r"\bAKIA[0-9A-Z]{16}\b", "<REDACTED>"),
)
# Lower-case tool names, and commands that only read.
SHELL_TOOLS = ("bash", "exec_command", "local_shell", "shell")
CODE_TOOLS = ("apply_patch", "edit", "write", "notebookedit", "multiedit")
PLANNING_TOOLS = ("enterplanmode", "exitplanmode", "todowrite", "update_plan")
READ_COMMANDS = ("ls", "cat", "grep", "rg", "find", "head", "tail", "wc", "pwd", "echo", "tree", "stat", "file", "which", "type", "env", "printenv", "diff")
READ_GIT = ("status", "diff", "log", "show", "branch", "remote", "blame")
# Shell commands that surely change a file.
SHELL_EDITS = (
    r"\bgit\s+apply\b(?![^\n]*--(?:check|stat|summary|numstat))",
    r"\bsed\b[^\n|]*\s-i\b",
    r"\bpatch\b[^\n|]*-p\d",
    r"\bwriteFileSync\b|\bfs\.write\b|\.writeFile\b",
    r"""\bopen\([^)]*['"][wa]\+?['"]""",
    r"\bapplypatch\b",
)


def phase(command: Column) -> Column:
    low = F.lower(command)
    out = None
    for name, parts in _PHASES:
        test = _has(low, parts)
        if name == "test":
            test |= low.contains(" check") & ~low.contains("checkout")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def destructive(command: Column) -> Column:
    """What makes a command dangerous, else null."""
    low = F.lower(command)
    out = None
    for part, name in _DESTRUCTIVE:
        out = F.when(low.contains(part), name) if out is None else out.when(low.contains(part), name)
    return out


def redacted(command: Column) -> Column:
    for pattern, to in _SECRETS:
        command = F.regexp_replace(command, pattern, to)
    return command


def normal_form(command: Column, cwd: Column) -> Column:
    """The working folder becomes $PROJECT_ROOT where it is a whole path prefix; white
    space collapses."""
    root = F.regexp_replace(cwd, "/+$", "")
    pattern = F.concat(F.lit(r"(?<![A-Za-z0-9/_\-.])\Q"), root, F.lit(r"\E(?=$|[/ \t\"'):])"))
    replaced = F.when(F.length(root) > 0, F.regexp_replace(command, pattern, F.lit(r"\$PROJECT_ROOT"))).otherwise(command)
    return F.trim(F.regexp_replace(F.coalesce(replaced, command), r"\s+", " "))


def _has(low: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out |= low.contains(p)
    return out


def _parsed(value: str | None):
    try:
        found = json.loads(value)
        return json.loads(found) if isinstance(found, str) else found
    except (TypeError, ValueError):
        return None


def shell_quote(part: str) -> str:
    return part if re.fullmatch(r"[A-Za-z0-9_@%+=:,./-]+", part) else "'" + part.replace("'", "'\\''") + "'"


@F.pandas_udf(StringType())
def decoded(tool: pd.Series, value: pd.Series) -> pd.Series:
    """The command of a shell tool's input (JSON, perhaps twice encoded); lists are quoted."""

    def one(name, text):
        key = {"Bash": "command", "exec_command": "cmd", "shell": "cmd", "local_shell": "cmd"}.get(name)
        found = _parsed(text)
        if key is None or not isinstance(found, dict):
            return None
        command = found.get(key)
        command = found.get("command") if command is None else command
        if isinstance(command, list):
            command = " ".join(shell_quote(p) for p in command if isinstance(p, str)) or None
        return command if isinstance(command, str) else None

    return pd.Series([one(n, t) for n, t in zip(tool, value, strict=True)], dtype=object)


def local_name(tool: Column) -> Column:
    """The last part of a dotted tool name, in lower case."""
    return F.lower(F.coalesce(F.element_at(F.filter(F.split(tool, r"\."), lambda x: x != ""), -1), tool, F.lit("")))


def shell_bucket(command: Column) -> Column:
    words = F.filter(F.split(F.trim(command), r"\s+"), lambda x: x != "")
    first = F.regexp_replace(F.get(words, F.lit(0)), "^['\"]|['\"]$", "")
    head = F.coalesce(F.element_at(F.filter(F.split(first, "/"), lambda x: x != ""), -1), first)
    git = F.when(F.get(words, F.lit(1)).isin(*READ_GIT), "context").otherwise("code")
    return F.when(head == "git", git).when(head.isin(*READ_COMMANDS), "context").otherwise("code")


def tool_bucket(tool: Column, command: Column) -> Column:
    """context, planning or code."""
    name = local_name(tool)
    return F.when(name.isin(*SHELL_TOOLS), shell_bucket(command)).when(name.isin(*PLANNING_TOOLS), "planning").when(name.isin(*CODE_TOOLS), "code").otherwise("context")


def block_bucket(kind: Column, tool: Column, command: Column) -> Column:
    return F.when(kind == "thinking", "planning").when(kind.isin("tool_use", "tool_result", "web_search"), tool_bucket(tool, command)).otherwise("communicating")


def is_code_edit(tool: Column, command: Column) -> Column:
    name = local_name(tool)
    edits = F.lit(False)
    for p in SHELL_EDITS:
        edits |= command.rlike(p)
    return name.isin(*CODE_TOOLS) | (name.isin(*SHELL_TOOLS) & F.coalesce(edits, F.lit(False)))
