"""The JSON array sink: written beside its target and published at once."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from pathlib import Path

from .sources.export import InputError


class JsonArraySink:
    """Events, one a line, into ``target``. Nothing is seen there before commit()."""

    def __init__(self, target: str, source: str, force: bool = False):
        self.target, self.force = Path(os.path.abspath(target)), force
        if self.target.suffix.lower() != ".json":
            raise InputError("INVALID_OUTPUT_TYPE")
        if not self.target.parent.is_dir():
            raise InputError("OUTPUT_DIRECTORY_INVALID")
        try:
            real = os.stat(source)
        except OSError:
            raise InputError("INPUT_NOT_READABLE") from None
        if str(self.target) == os.path.realpath(source):
            raise InputError("OUTPUT_OVERWRITES_SOURCE")
        if os.path.lexists(self.target):
            if self.target.exists() and os.path.samestat(os.stat(self.target), real):
                raise InputError("OUTPUT_OVERWRITES_SOURCE")
            if not force:
                raise InputError("OUTPUT_EXISTS")
        self._sweep()
        self.temporary = self.target.parent / f".{self.target.name}.{os.getpid()}.{uuid.uuid4()}.tmp"
        self.file = open(os.open(self.temporary, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600), "w", encoding="utf-8")
        self.file.write("[\n")
        self.first, self.committed = True, False

    def _sweep(self) -> None:
        """Removes what a process that has gone left of a report of this name."""
        from .plans.run import alive

        for p in self.target.parent.iterdir():
            m = re.fullmatch(rf"\.{re.escape(self.target.name)}\.([0-9]+)\.[0-9a-f-]{{36}}\.tmp", p.name)
            if m and not alive(int(m[1])):
                p.unlink(missing_ok=True)

    def write(self, event: str) -> None:
        if self.file.closed or self.committed:
            raise InputError("OUTPUT_SINK_CLOSED")
        self.file.write(f"{'  ' if self.first else ',' + chr(10) + '  '}{event}")
        self.first = False

    def commit(self, cancelled: Callable[[], bool] = lambda: False) -> None:
        """Publishes the file: by renaming with force, else by a link, which never replaces what came meanwhile.
        cancelled is asked before each step; after the last one the report is there."""

        def go_on() -> None:
            if cancelled():
                raise KeyboardInterrupt

        if self.committed:
            return
        if self.file.closed:
            raise InputError("OUTPUT_SINK_CLOSED")
        go_on()
        self.file.write("\n]\n")
        self.file.flush()
        go_on()
        os.fsync(self.file.fileno())
        self.file.close()
        go_on()
        if self.force:
            os.replace(self.temporary, self.target)
            self.committed = True
            return
        try:
            os.link(self.temporary, self.target)
        except FileExistsError:
            raise InputError("OUTPUT_EXISTS") from None
        self.committed = True
        self._remove()

    def abort(self) -> None:
        if not self.committed:
            self.file.close()
            self._remove()

    def _remove(self) -> None:
        try:
            self.temporary.unlink(missing_ok=True)
        except OSError:
            raise InputError("OUTPUT_CLEANUP_FAILED") from None
