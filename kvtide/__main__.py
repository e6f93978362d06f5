"""python -m kvtide PATH put|get|delete|scan|shell|server|stats ..."""

from __future__ import annotations

import argparse
import hashlib
import os
import random
import signal
import sys
import time

from pyspark.sql import SparkSession

from .commands import Store, serve, shell, status
from .operators.compaction import ONE_MACHINE
from .operators.mutations import WriteBatch
from .sources.table import KVTable


def random_batch(n: int = 100) -> WriteBatch:
    b = WriteBatch()
    for _ in range(n):
        b.put(f"key:{random.randrange(10_000):06d}", f"value-{random.random()}")
    return b


def main() -> None:
    p = argparse.ArgumentParser(prog="kvtide")
    p.add_argument("path")
    p.add_argument("command", choices=["put", "get", "delete", "scan", "shell", "server", "stats", "compact", "tui"])
    p.add_argument("args", nargs="*")
    p.add_argument("--port", type=int, default=6379)
    p.add_argument("--simulate", action="store_true", help="tui: write random keys meanwhile")
    p.add_argument("--wal", help="write-ahead log on this machine; by default beside a local table, else in the home folder")
    p.add_argument("--sync", action="store_true", help="have every write on disk before it is acknowledged")
    a = p.parse_args()
    spark = SparkSession.builder.appName("kvtide").config("spark.ui.enabled", "false").getOrCreate()
    store = Store(KVTable(spark, a.path, ONE_MACHINE), a.wal or default_log(a.path), a.sync)
    signal.signal(signal.SIGTERM, lambda *_: sys.exit(0))  # as an interrupt, so that the store is closed
    try:
        run(store, a)
    except (KeyboardInterrupt, EOFError):
        pass
    finally:
        store.close()


def default_log(path: str) -> str:
    local = path.removeprefix("file://")
    if "://" not in local:
        return os.path.join(local, "_wal", "current.wal")
    return os.path.expanduser(f"~/.kvtide/{hashlib.sha256(path.encode()).hexdigest()[:16]}.wal")


def run(store: Store, a: argparse.Namespace) -> None:
    if a.command == "server":
        print("port", serve(store, a.port).server_address[1], flush=True)
        while True:
            time.sleep(60)
    if a.command == "tui":
        while True:
            if a.simulate:
                store.write(random_batch())
            print("\033[2J" + status(store.metrics(), store.table.options))
            time.sleep(1)
    if a.command == "shell":
        while (answer := shell(store, input("> "))) is not None:
            print(answer)
    else:
        print(shell(store, " ".join([a.command, *a.args])))


if __name__ == "__main__":
    main()
