"""Feeds as a stream that can be played again: polls are planned before their offset is reported, and items are logged before a row is handed on.

An offset is the number of a poll. Its plan says which window each feed is asked for, so that a poll that runs again asks the same; each feed is a
partition of its own, read by an executor, which writes the items to the log and then reads the log. A batch that runs again finds the log and gives the same rows,
whatever the feed would answer now. What Spark has committed is trimmed. A feed that fails gives no rows, and is asked from where it stood by the next poll.

The log lies in a folder that driver and executors share (option `log`). With the option `payloads`, feeds are folders of saved payloads (`<payloads>/<feed>/*`, a JSON
item a line) instead of pages: each new file is a partition, and needs no log, since files don't change.
"""

from __future__ import annotations

import importlib
import json
import os
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyarrow import fs
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

REGISTRY = "millrace.sources.registry:build_sources"


def sources_of(options: dict) -> dict:
    """The feeds by name, from the function that the option `registry` names (module:function)."""
    module, _, function = options.get("registry", REGISTRY).partition(":")
    return getattr(importlib.import_module(module), function)()


class Folder:
    """Small files under a shared folder."""

    def __init__(self, uri: str):
        self.fs, self.path = fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))

    def names(self, under: str) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/{under}", allow_not_found=True))
        return sorted(f.base_name for f in found if not f.base_name.startswith("."))

    def exists(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.path}/{name}").type != fs.FileType.NotFound

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return f.read()

    def lines(self, name: str) -> Iterator[bytes]:
        """Lines of a file of any size, read in blocks."""
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            rest = b""
            while block := f.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                yield from whole
            if rest:
                yield rest

    def put(self, name: str, lines: Iterator[bytes]) -> None:
        """Write a file whole or not at all; one that is there already stays (of several attempts at a task the first to end counts)."""
        above = f"{self.path}/{name}".rpartition("/")[0]
        self.fs.create_dir(above, recursive=True)
        temporary = f"{above}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temporary) as out:
            for line in lines:
                out.write(line + b"\n")
        if isinstance(self.fs, fs.LocalFileSystem):
            try:
                os.link(temporary, f"{self.path}/{name}")
            except FileExistsError:
                pass
            os.unlink(temporary)
        elif self.exists(name):
            self.fs.delete_file(temporary)
        else:
            self.fs.move(temporary, f"{self.path}/{name}")

    def remove(self, name: str) -> None:
        if self.exists(name):
            at = f"{self.path}/{name}"
            (self.fs.delete_dir if self.fs.get_file_info(at).type == fs.FileType.Directory else self.fs.delete_file)(at)


class Poll(InputPartition):
    """A feed in a poll: the window to ask for, or a file of saved payloads."""

    def __init__(self, number: int, feed: str, since: str | None = None, until: str | None = None, file: str | None = None):
        self.number, self.feed, self.since, self.until, self.file = number, feed, since, until, file


class FeedStreamReader(DataSourceStreamReader):
    """(source, value) of feeds by polls; options: name, log, and any of since, every (least seconds between polls), payloads, registry."""

    def __init__(self, options: dict):
        if "log" not in options:
            raise ValueError("a stream of feeds needs the option log: a folder that driver and executors share")
        self.options, self.log = options, Folder(options["log"])
        self.feeds = [n.strip() for n in options["name"].split(",")]

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def _plan(self, number: int) -> dict:
        return json.loads(self.log.read(f"plans/{number:010d}.json"))

    def latestOffset(self) -> dict:
        planned = [int(n[:-5]) for n in self.log.names("plans")]
        last = max(planned, default=0)
        before = self._plan(last) if planned else None
        now = datetime.now(timezone.utc)
        if before and now < datetime.fromisoformat(before["until"]) + timedelta(seconds=float(self.options.get("every", 0))):
            return {"poll": last}
        plan = self._files(before) if "payloads" in self.options else self._windows(last, before, now)
        if plan is None:
            return {"poll": last}
        self.log.put(f"plans/{last + 1:010d}.json", iter([json.dumps(plan | {"until": now.isoformat()}).encode()]))
        return {"poll": last + 1}

    def _files(self, before: dict | None) -> dict | None:
        """The files that came since the last poll, by their names: later files must have larger names within a feed."""
        folder, last = Folder(self.options["payloads"]), (before or {}).get("last", {})
        new = {f: [n for n in folder.names(f) if n > last.get(f, "")] for f in self.feeds}
        if not any(new.values()):
            return None
        return {"files": new, "last": last | {f: names[-1] for f, names in new.items() if names}}

    def _windows(self, last: int, before: dict | None, now: datetime) -> dict:
        feeds = {}
        for f, source in sources_of(self.options).items():
            if f not in self.feeds:
                continue
            known = before["feeds"].get(f) if before else None
            if known is None:
                first = self.options.get("since") or source.default_since(now)
                since = first.isoformat() if isinstance(first, datetime) else first
            else:
                since = known["since"] if self.log.exists(f"items/{last}/{f}.error") else known["until"]
            feeds[f] = {"since": since, "until": now.isoformat()}
        if unknown := set(self.feeds) - feeds.keys():
            raise KeyError(f"no such feeds: {sorted(unknown)}")
        return {"feeds": feeds}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for n in range(start["poll"] + 1, end["poll"] + 1):
            plan = self._plan(n)
            out += [Poll(n, f, file=name) for f, names in plan.get("files", {}).items() for name in names]
            out += [Poll(n, f, w["since"], w["until"]) for f, w in plan.get("feeds", {}).items()]
        return out

    def read(self, partition: Poll) -> Iterator[tuple]:
        if partition.file is not None:
            lines = Folder(self.options["payloads"]).lines(f"{partition.feed}/{partition.file}")
        else:
            lines = self._logged(partition)
        for line in lines:
            if line.strip():
                yield partition.feed, line.decode()

    def _logged(self, poll: Poll) -> Iterator[bytes]:
        name = f"items/{poll.number}/{poll.feed}"
        if self.log.exists(f"{name}.error"):
            return iter(())
        if not self.log.exists(f"{name}.jsonl"):
            source = sources_of(self.options)[poll.feed]
            try:
                items = source.fetch(datetime.fromisoformat(poll.since) if poll.since else None)
                self.log.put(f"{name}.jsonl", (json.dumps(i).encode() for i in items))
            except Exception as e:  # one feed's failure must not end the others
                self.log.put(f"{name}.error", iter([f"{type(e).__name__}: {e}"[:2000].encode()]))
                return iter(())
        return self.log.lines(f"{name}.jsonl")

    def commit(self, end: dict) -> None:
        """Forget the items of polls up to `end`; the last plan stays, since the next one goes on from it."""
        for n in self.log.names("items"):
            if int(n) <= end["poll"]:
                self.log.remove(f"items/{n}")
        for n in self.log.names("plans"):
            if int(n[:-5]) < end["poll"]:
                self.log.remove(f"plans/{n}")
