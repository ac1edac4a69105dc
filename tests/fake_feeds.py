"""Feeds for tests, as workers import them: each answer differs, and is written down."""

import os
import tempfile
from datetime import timedelta

from millrace.sources.base import Source

#: The file that names the folder of the running test.
WHERE = os.path.join(tempfile.gettempdir(), "millrace-fake-feeds")


def build_sources():
    def feed(name):
        def fetch(since):
            folder = open(WHERE).read()
            n = len([x for x in os.listdir(folder) if x.startswith(f"{name}.")])
            open(f"{folder}/{name}.{n}", "w").write(since.isoformat())
            if os.path.exists(f"{folder}/broken-{name}"):
                raise OSError("no network")
            yield from ({"feed": name, "answer": n, "i": i} for i in range(3))

        return Source(name, "article", name, "feed string, answer int, i int", lambda raw: raw, fetch, window_days=7)

    assert timedelta(days=7)
    return {n: feed(n) for n in ("one", "two")}
