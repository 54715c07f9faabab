"""A command line and an interactive shell over a store in a folder."""

from __future__ import annotations

import argparse
import cmd
import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from waypost import render
from waypost.errors import WaypostError
from waypost.functions import values as V
from waypost.store import EndpointStore

FORMATS = ("text", "json", "table")


class History:
    """Commands of earlier sessions, the latest last; a command repeated at once is kept once."""

    def __init__(self, path: str, most: int = 1000):
        self.path, self.most = path, most
        self.commands: list[str] = []

    def load(self) -> None:
        if os.path.exists(self.path):
            with open(self.path, encoding="utf-8") as f:
                self.commands = [line.rstrip("\n") for line in f if line.strip()][-self.most :]

    def save(self) -> None:
        with open(self.path, "w", encoding="utf-8") as f:
            f.writelines(f"{c}\n" for c in self.commands)

    def add(self, command: str) -> None:
        command = command.strip()
        if command and self.commands[-1:] != [command]:
            self.commands = [*self.commands, command][-self.most :]

    def search(self, part: str) -> list[str]:
        return [c for c in self.commands if part in c]


def shown(found: Any, form: str) -> str:
    """The result of a query; collections arrive row by row."""
    if not isinstance(found, DataFrame):
        return render.render(found, form)
    if "json" in found.columns:
        rows = [json.loads(r["json"]) for r in found.orderBy(found.columns[0]).toLocalIterator()]
        return "\n".join(render.render(r, form) for r in rows) if form != "json" else render.json_text(rows, 2)
    pairs = {r["path"]: V.from_row(r) for r in found.orderBy("path").toLocalIterator()}
    return render.render(pairs, form) if form != "text" else "\n".join(f"{p} = {render.text_value(v)}" for p, v in pairs.items())


class Shell(cmd.Cmd):
    """``.help .exit .quit .connect .list .format .history``; everything else is a query."""

    intro, prompt = "Queries in braces; .help for commands.", "waypost> "

    def __init__(self, spark: SparkSession, store: EndpointStore, form: str = "text", history: History | None = None, **more):
        super().__init__(**more)
        self.spark, self.store, self.form = spark, store, form
        self.history = history or History(os.path.expanduser("~/.waypost_history"))

    def say(self, text: str) -> None:
        self.stdout.write(text + "\n")

    def emptyline(self) -> bool:
        return False

    def default(self, line: str) -> bool:
        self.history.add(line)
        try:
            if line == "EOF" or line.split()[0] in (".exit", ".quit"):
                self.store.flush()
                return True
            if line.startswith("."):
                self.command(*line[1:].split(maxsplit=1))
            else:
                self.say(shown(self.store.ql(line), self.form))
        except WaypostError as e:
            self.say(render.render_message("error", str(e), self.form))
        return False

    def command(self, name: str, arg: str = "") -> None:
        if name == "help":
            self.say(self.__doc__ or "")
        elif name == "connect":
            self.store.flush()
            self.store = EndpointStore.open(self.spark, arg)
            self.say(render.render_message("success", f"connected to {arg}", self.form))
        elif name == "list":
            self.say(render.render_paths([r["path"] for r in self.store.list_prefix(arg).orderBy("path").toLocalIterator()], self.form))
        elif name == "format" and arg in FORMATS:
            self.form = arg
        elif name == "history":
            self.say("\n".join(self.history.search(arg)))
        else:
            self.say(render.render_message("error", f"no such command: .{name} {arg}".rstrip(), self.form))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="waypost", description="Queries over a store of endpoints")
    parser.add_argument("--store", required=True, help="folder of the store")
    parser.add_argument("--format", choices=FORMATS, default="text")
    parser.add_argument("--compat", action="store_true")
    sub = parser.add_subparsers(dest="act", required=True)
    sub.add_parser("query").add_argument("text")
    sub.add_parser("list").add_argument("prefix", nargs="?", default="")
    sub.add_parser("get").add_argument("path")
    sub.add_parser("compact")
    sub.add_parser("shell")
    set_ = sub.add_parser("set")
    set_.add_argument("path")
    set_.add_argument("value", help="JSON")
    asked = parser.parse_args(argv)
    spark = SparkSession.builder.appName("waypost").getOrCreate()
    store = EndpointStore.open(spark, asked.store, asked.compat)
    try:
        if asked.act == "query":
            print(shown(store.ql(asked.text), asked.format))
        elif asked.act == "list":
            print(render.render_paths([r["path"] for r in store.list_prefix(asked.prefix).orderBy("path").toLocalIterator()], asked.format))
        elif asked.act == "get":
            print(render.render(store.get(asked.path), asked.format))
        elif asked.act == "set":
            store.set(asked.path, V.json_to_value(json.loads(asked.value)))
        elif asked.act == "compact":
            store.compact()
        else:
            shell = Shell(spark, store, asked.format)
            shell.history.load()
            shell.cmdloop()
            shell.history.save()
        store.flush()
    except (WaypostError, json.JSONDecodeError) as e:
        print(render.render_message("error", str(e), asked.format))
        return 1
    return 0
