"""Command line: python -m loomline PATH [options]."""

from __future__ import annotations

import logging
import os
import re
import sys
import time

from .operators import sinks, stats
from .runtime import session
from .sources import files as sources

USAGE = """usage: python -m loomline PATH [-v] [-json] [-nr | -norecurse] [-b | -backend auto|sync|synchronous|threadpool|tp] [-threads N]
       python -m loomline -help | -h | -?"""
BACKENDS = {"auto": None, "threadpool": None, "tp": None, "sync": 1, "synchronous": 1}
#: Exit codes.
OK, BAD_ARGUMENT = 0, 4
STATUS = {"OUT_OF_MEMORY": 1, "PATH_NORMALIZATION": 5, "FILE_OPEN_FAILED": 12, "FILE_TOO_LARGE": 14, "FILE_READ_FAILED": 15, "DIR_ENUM_FAILED": 16}
UNEXPECTED = 19
LARGEST_THREADS = 4096

log = logging.getLogger("loomline")


def parse(args: list[str]) -> dict | int:
    """Options, or an exit code: 0 after help, 4 for a bad value. Unknown options are warned of."""
    if not args or args[0] in ("-help", "-h", "-?"):
        print(USAGE)
        return OK
    out = {"root": args[0], "verbose": False, "json": False, "recursive": True, "failfast": False, "threads": None}
    rest = iter(args[1:])
    for a in rest:
        if a == "-v":
            out["verbose"] = True
        elif a == "-json":
            out["json"] = True
        elif a in ("-nr", "-norecurse"):
            out["recursive"] = False
        elif a in ("-b", "-backend"):
            kind = next(rest, None)
            if kind not in BACKENDS:
                log.error("backend must be one of %s", ", ".join(BACKENDS))
                return BAD_ARGUMENT
            out["failfast"] = BACKENDS[kind] == 1
        elif a == "-threads":
            n = next(rest, "")
            if not re.fullmatch(r"[0-9]+", n) or not 0 < int(n) <= LARGEST_THREADS:
                log.error("-threads needs a number from 1 to %d", LARGEST_THREADS)
                return BAD_ARGUMENT
            out["threads"] = int(n)
        else:
            log.warning("unknown option %s", a)
    return out


def status_of(error: Exception) -> int:
    """The exit code of a failure: that of the first status named in its message."""
    named = re.search("|".join(STATUS), str(error))
    return STATUS[named[0]] if named else UNEXPECTED


def main(args: list[str], spark=None) -> int:
    # warnings are part of the output and errors are not
    logging.basicConfig(level=logging.INFO if "-v" in args else logging.WARNING, stream=sys.stdout, format="%(message)s")
    options = parse(args)
    if isinstance(options, int):
        return options
    threads = 1 if options["failfast"] else options["threads"] or os.cpu_count()
    spark = spark or session(master=f"local[{threads}]" if "SPARK_MASTER" not in os.environ else None)
    began = time.perf_counter()
    try:
        listed = sources.list_files(spark, options["root"], options["recursive"]).persist()  # paths alone; the tree is walked once
        result = stats.report(stats.file_stats(listed, options["failfast"]))
        rows = result.collect()
        left_out = stats.ignored_count(listed).first()["ignored"]
        listed.unpersist()
    except Exception as error:  # noqa: BLE001  the exit code tells that the run failed
        log.error("%s", str(error).splitlines()[0])
        return status_of(error)
    done = spark.createDataFrame(rows, result.schema)
    print(sinks.text_table(done), end="")
    print(f"Time: {time.perf_counter() - began:.3f}s")
    if left_out:
        print(f"Ignored {left_out} files")
    if options["json"]:
        print(sinks.json_report(done).first()["report"])
    return OK


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
