"""What a parser keeps of a document until its end, in little memory."""

from __future__ import annotations

import os
import pickle
import re
import tempfile
from collections.abc import Iterator


class Spool:
    """Items in the order they came. Beyond `most` they lie in a file that the task drops."""

    def __init__(self, most: int = 20_000):
        self.most, self.items, self.file, self.written = most, [], None, 0

    def append(self, x) -> None:
        self.items.append(x)
        if len(self.items) >= self.most:
            if self.file is None:
                folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
                self.file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
            pickle.dump(self.items, self.file, pickle.HIGHEST_PROTOCOL)
            self.written += 1
            self.items = []

    def __iter__(self) -> Iterator:
        if self.file is not None:
            self.file.seek(0)
            for _ in range(self.written):
                yield from pickle.load(self.file)
        yield from self.items


class Ids:
    """Positions by id; of an id that comes again, the last. Ids that count up with their positions (`w1`, `w2`) take no memory of their own."""

    _NUMBER = re.compile(r"(.*?)(0|[1-9][0-9]{0,14})", re.DOTALL)
    #: Runs of one prefix; ids beyond that are kept one by one.
    MOST = 8

    def __init__(self) -> None:
        self.odd: dict[str, int] = {}
        self.runs: dict[str, list[list[int]]] = {}
        self.next, self.at, self.prefix, self.run = None, 0, "", None

    def put(self, key: str, at: int) -> None:
        if self.odd:
            self.odd.pop(key, None)
        if key == self.next and at == self.at:
            run = self.run
            run[2] += 1
            self.at, n = at + 1, run[0] + run[2]
            self.next = f"{self.prefix}{n}" if n < 10**15 else None
            return
        m = self._NUMBER.fullmatch(key)
        runs = self.runs.setdefault(m.group(1), []) if m else None
        if m is None or len(runs) >= self.MOST:
            self.odd[key] = at
            return
        self.prefix, self.run = m.group(1), [int(m.group(2)), at, 1]
        runs.append(self.run)
        self.at, n = at + 1, self.run[0] + 1
        self.next = f"{self.prefix}{n}" if n < 10**15 else None

    def get(self, key: str) -> int | None:
        if key in self.odd:
            return self.odd[key]
        n = len(self.prefix)
        if key[n : n + 1] not in ("", "0") and len(key) - n < 16 and key.startswith(self.prefix) and (end := key[n:]).isascii() and end.isdigit() and not self.prefix[-1:].isdigit():
            prefix, n = self.prefix, int(end)  # most ids are like the last one
        elif m := self._NUMBER.fullmatch(key):
            prefix, n = m.group(1), int(m.group(2))
        else:
            return None
        if runs := self.runs.get(prefix):
            for first, at, length in reversed(runs):
                if first <= n < first + length:
                    return at + n - first
        return None
