"""Command line of the digest: ``python -m scriptorium FILE... [options]``."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields
from datetime import datetime, timezone

from .plans import digest
from .plans.report import summary_lines
from .plans.settings import SettingsError, overlay, read_settings
from .session import drop_tables, get_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scriptorium-digest", description="Merge, filter and report collections of records.", argument_default=argparse.SUPPRESS)
    p.add_argument("files", nargs="*", help="JSON Lines files, merged in this order")
    p.add_argument("--config", help="settings file (TOML)")
    p.add_argument("--json", action="store_true", help="print the run document instead of lines")
    kinds = {"int": int, "float": float, "str": str}
    for f in fields(digest.Settings):
        if f.name != "files":
            p.add_argument("--" + f.name.replace("_", "-"), type=kinds[str(f.type).split("|")[0].strip()])
    return p


def main(argv: list[str] | None = None) -> int:
    given = vars(parser().parse_args(argv))
    as_json, config = given.pop("json", False), given.pop("config", None)
    if not given.get("files"):
        given.pop("files", None)
    s = digest.Settings()
    try:
        stored = {}
        if config:
            with open(config, encoding="utf-8") as text:
                stored = read_settings(text.read())
        s, _ = overlay(given, stored)
        done = digest.run(get_session("digest"), s, datetime.now(timezone.utc))
    except (digest.DigestError, SettingsError, OSError) as error:
        fail = error if isinstance(error, digest.DigestError) else digest.DigestError("usage" if isinstance(error, SettingsError) else "unreadable_input", str(error))
        if as_json:
            print(digest.emit(digest.failed(fail, s)))
        print(f"{fail.kind}: {fail.message}", file=sys.stderr)
        return 1
    print(digest.emit(digest.document(done, s)) if as_json else "\n".join(summary_lines(done.kept, top=s.top)))
    drop_tables(done.kept.sparkSession)
    return 0


if __name__ == "__main__":
    sys.exit(main())
