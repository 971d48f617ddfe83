"""Results as JSON text: a pretty document, or an error envelope."""

from __future__ import annotations

import json
import sys
import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame


def _plain(value):
    return value.isoformat() if hasattr(value, "isoformat") else value.decode("utf-8", "replace") if isinstance(value, bytes | bytearray) else str(value)


def emit(value, write: Callable[[str], object] = sys.stdout.write) -> None:
    """Writes a value as indented JSON; a DataFrame's rows are read one partition at a time, and never held together."""
    if not isinstance(value, DataFrame):
        write(json.dumps(value, indent=2, ensure_ascii=False, default=_plain) + "\n")
        return
    some = False
    for row in value.toLocalIterator():
        body = json.dumps(row.asDict(True), indent=2, ensure_ascii=False, default=_plain)
        write(("," if some else "[") + "\n  " + body.replace("\n", "\n  "))
        some = True
    write("\n]\n" if some else "[]\n")


def envelope(error: BaseException) -> str:
    """One line: {"error": message, "stack": traceback}."""
    return json.dumps({"error": str(error), "stack": "".join(traceback.format_exception(error))}, ensure_ascii=False) + "\n"


def run(call: Callable[[], object], write: Callable[[str], object] = sys.stdout.write) -> int:
    """Emits what a call returns, or the envelope of what it raises; the exit code."""
    try:
        emit(call(), write)
    except Exception as error:  # noqa: BLE001  told to the caller
        write(envelope(error))
        return 1
    return 0
