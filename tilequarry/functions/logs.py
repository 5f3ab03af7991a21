"""Levelled loggers to standard output, to a file, or nowhere."""

from __future__ import annotations

import os
from datetime import datetime

SILENT, ERROR, WARNING, INFO, DEBUG = range(5)
NAMES = ("SILENT", "ERROR", "WARN", "INFO", "DEBUG")


class Log:
    """A message is written if its level is not above the log's."""

    def __init__(self, level: int = INFO, prefix: bool = True, pid: bool = True):
        self.level, self._prefix, self._pid = level, prefix, pid

    def _write(self, line: str) -> None:
        print(line, flush=True)

    def log(self, level: int, message: str) -> None:
        if self.level >= level:
            self._write("".join(self.prefix(level) + line for line in message.splitlines(True)))

    def prefix(self, level: int) -> str:
        if not self._prefix:
            return ""
        pid = f"pid:{os.getpid()}|" if self._pid else ""
        return f"[{pid}{datetime.now():%H:%M:%S}|{NAMES[level]}] "

    def error(self, message: str) -> None:
        self.log(ERROR, message)

    def warning(self, message: str) -> None:
        self.log(WARNING, message)

    def info(self, message: str) -> None:
        self.log(INFO, message)

    def debug(self, message: str) -> None:
        self.log(DEBUG, message)

    e, w, i, d = error, warning, info, debug


class FileLog(Log):
    """Appends lines to a file; closes it on leaving a ``with`` block."""

    def __init__(self, path: str, level: int = INFO, prefix: bool = True):
        super().__init__(level, prefix)
        self._file = open(path, "a")

    def _write(self, line: str) -> None:
        self._file.write(line + "\n")

    def close(self) -> None:
        self._file.close()

    def __enter__(self) -> FileLog:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class SilentLog(Log):
    def __init__(self) -> None:
        super().__init__(SILENT)

    def _write(self, line: str) -> None:
        pass
