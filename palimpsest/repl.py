"""An interactive shell over a catalogue: queries and presets, and commands that begin with a point."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from .catalog import SCHEMAS, Catalog
from .cli import print_result
from .operators.analyzers import assemble
from .plans.dsl import QueryParseError, QueryValidationError
from .plans.presets import PRESETS, resolve_spec
from .scratch import scope
from .sinks.reports import FORMATS, json_parts, rows_of, write_parts
from .sources.settings import load_report


class Shell:
    def __init__(self, catalog: Catalog, out=None, ordinal: str = "file_id"):
        self.catalog, self.out, self.ordinal = catalog, out or sys.stdout, ordinal
        self.mode, self.echo, self.page, self.past, self.stores = "table", False, 50, [], {"main": catalog}
        self.commands: dict[str, Callable[[list[str]], None]] = {
            n[4:]: getattr(self, n) for n in dir(self) if n.startswith("cmd_")
        }

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def loop(self, lines: Iterable[str] | None = None) -> None:
        for line in lines if lines is not None else iter(lambda: input("> "), None):
            try:
                if not self.handle(line):
                    break
            except EOFError:
                break

    def handle(self, line: str) -> bool:
        """One line; False ends the shell. ``#`` starts a comment, ``.`` a command, all else is a query or preset."""
        line = line.strip()
        if not line or line.startswith("#"):
            return True
        self.past.append(line)
        if self.echo:
            self.say(line)
        if line.startswith("."):
            name, *args = line[1:].split()
            if name in ("exit", "quit"):
                return False
            if name not in self.commands:
                self.say(f"unknown command: .{name}")
            else:
                self.commands[name](args)
            return True
        try:
            with scope():
                print_result(self.catalog.execute(resolve_spec(line)), self.mode, self.out, self.page)
        except QueryParseError as e:
            self.say(f"parse error: {e}")
        except QueryValidationError as e:
            self.say(f"validation error: {e}")
        except (FileNotFoundError, ValueError) as e:
            self.say(f"error: {e}")
        return True

    def cmd_help(self, _):
        self.say("queries: JSON or a preset name. commands: " + " ".join(f".{c}" for c in sorted([*self.commands, "exit", "quit"])))

    def cmd_tables(self, _):
        for n in self.catalog.names():
            self.say(n + ("" if n in self.catalog.relations else " (empty)"))

    def cmd_presets(self, _):
        self.say("\n".join(PRESETS))

    def cmd_schema(self, args):
        for n in args or list(SCHEMAS):
            self.say(f"{n}: {self.catalog[n].schema.simpleString()[7:-1]}" if n in self.catalog else f"no such relation: {n}")

    def cmd_mode(self, args):
        if args and args[0] in FORMATS:
            self.mode = args[0]
        self.say(f"mode: {self.mode}")

    def cmd_pager(self, args):
        """Lines between pauses; ``off`` for none."""
        if args:
            self.page = int(args[0]) if args[0].isdigit() else 0 if args[0] == "off" else 50
        self.say(f"pager: {self.page or 'off'}")

    def cmd_echo(self, args):
        self.echo = args[:1] == ["on"]

    def cmd_print(self, args):
        self.say(" ".join(args))

    def cmd_history(self, _):
        self.say("\n".join(f"{i} {x}" for i, x in enumerate(self.past, 1)))

    def cmd_save(self, args):
        write_parts(args[0], json_parts((n, rows_of(self.catalog[n])) for n in self.catalog.relations))
        self.say(f"saved {args[0]}")

    def cmd_load(self, args):
        self.catalog = load_report(self.catalog.spark, args[0])
        self.stores[args[0]] = self.catalog

    def cmd_stores(self, args):
        if args and args[0] in self.stores:
            self.catalog = self.stores[args[0]]
        self.say("\n".join(("* " if c is self.catalog else "  ") + n for n, c in self.stores.items()))

    def cmd_external(self, args):
        from .sources.archives import reference_files, scan_archives

        folder, pattern = args[0].rsplit("/", 1)
        self.catalog = self.catalog.with_relation("external_files", reference_files(scan_archives(self.catalog.spark, folder, pattern), pattern))

    def cmd_unload(self, _):
        self.catalog.relations.pop("external_files", None)

    def cmd_analyze(self, _):
        self.catalog, engine = assemble(self.catalog, self.catalog["files"], self.ordinal)
        self.say("done" if not engine.errors else f"failed: {', '.join(engine.errors)}")
