"""Command line: preview or export of one chat-history file."""

from __future__ import annotations

import os
import signal
import sys
from collections.abc import Callable
from dataclasses import dataclass

from .functions.redact import redact_lines
from .plans import run
from .sinks import JsonArraySink
from .sources.export import InputError

USAGE = """Usage:
  python -m skeinlake.cli --input <conversations.json>
  python -m skeinlake.cli --input <conversations.json> --write --output <report.json> [--force]

  --input         the exported conversations.json
  --write         allows a report to be written
  --output        the report's path; only with --write
  --force         allows an existing report to be replaced
  --summary-only  prints the counters alone
  --help, -h      prints this
"""


@dataclass
class Options:
    input: str | None = None
    output: str | None = None
    write: bool = False
    force: bool = False
    summary_only: bool = False
    help: bool = False


def options(argv: list[str]) -> Options:
    o, rest = Options(), list(argv)
    while rest:
        a = rest.pop(0)
        if a in ("--help", "-h"):
            o.help = True
        elif a in ("--write", "--force", "--summary-only"):
            setattr(o, a[2:].replace("-", "_"), True)
        elif a in ("--input", "--output"):
            if not rest or not rest[0] or rest[0].startswith("--"):
                raise InputError(f"{a[2:].upper()}_VALUE_REQUIRED")
            setattr(o, a[2:], rest.pop(0))
        else:
            raise InputError("UNKNOWN_ARGUMENT")
    if o.help:
        return o
    for broken, code in ((not o.input, "INPUT_REQUIRED"), (o.write and not o.output, "OUTPUT_REQUIRED"), (o.output and not o.write, "WRITE_CONFIRMATION_REQUIRED"), (o.force and not o.write, "FORCE_WITHOUT_WRITE")):
        if broken:
            raise InputError(code)
    return o


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("skeinlake").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None, session: Callable = _session) -> int:
    """0: done; 1: an error; 2: duplicates, failures or nothing classified; 130: cancelled."""
    say = lambda s: print(redact_lines(s)[0])
    try:
        o = options(sys.argv[1:] if argv is None else argv)
    except InputError as e:
        print(f"error [{e.code}]\n\n{USAGE}", file=sys.stderr)
        return 1
    if o.help:
        print(USAGE)
        return 0
    sink, report, cancelled = None, None, []

    def interrupted(*_: object) -> None:
        cancelled.append(True)
        raise KeyboardInterrupt

    own = os.getpid() == os.getpgid(0)
    before = {s: signal.signal(s, interrupted) for s in (signal.SIGINT, signal.SIGTERM)} if own else {}
    try:
        if o.write:
            sink = JsonArraySink(o.output, o.input, o.force)
        report = run.curate_file(session(), o.input, on_event=sink.write if sink else None)
        for k, v in report.summary.items():
            say(f"{k}: {v}")
        if not o.summary_only:
            for c in report.conversations:
                say(f"- {c.ref} | {'review' if c.requiresReview else 'accept'} | {c.suggestedTitle} | {c.sensitivityLevel}")
            more = report.summary["classified"] - len(report.conversations)
            if more > 0:
                say(f"- {more} more")
            for f in report.failures:
                say(f"- item {f.item_index} | {f.failure} | {f.message}")
        if sink:
            sink.commit(lambda: bool(cancelled))
        return 2 if report.summary["failed"] or report.summary["duplicates"] or not report.summary["classified"] else 0
    except KeyboardInterrupt:
        code, said = 130, "cancelled; no report was left"
    except InputError as e:
        code, said = 1, f"error [{e.code}]"
    except Exception:
        code, said = 1, "error [UNEXPECTED_ERROR]"
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)
        if report:
            report.close()
        if sink and not sink.committed:
            try:
                sink.abort()
            except InputError as e:
                print(f"error [{e.code}]", file=sys.stderr)
    print(said, file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
