"""Command line: ``python -m mnemospark.cli STORE add|query|sleep|stats ...``; prints JSON."""

from __future__ import annotations

import argparse
import json
import time

from mnemospark.manager import MemoryManager
from mnemospark.session import session


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("store", help="folder of the store")
    p.add_argument("--at", type=float, default=None, help="time in epoch seconds; now if it is left out")
    do = p.add_subparsers(dest="do", required=True)
    add = do.add_parser("add", help="remember a text")
    add.add_argument("text")
    add.add_argument("--tags", nargs="*", default=[])
    add.add_argument("--session", default="")
    add.add_argument("--importance", type=float, default=0.5)
    add.add_argument("--emotional", type=float, default=0.0)
    ask = do.add_parser("query", help="recall by a text")
    ask.add_argument("text")
    ask.add_argument("--top", type=int, default=5)
    do.add_parser("sleep", help="consolidate")
    do.add_parser("stats", help="counts and means")
    a = p.parse_args(args)
    at = a.at if a.at is not None else time.time()
    spark = session("local[*]", memory="2g", spark__ui__showConsoleProgress="false")
    m = MemoryManager(spark, a.store)
    if a.do == "add":
        out = {"version": m.remember([{"text": a.text, "tags": a.tags, "session": a.session, "importance": a.importance, "emotional_valence": a.emotional}], at)}
    elif a.do == "query":
        hits = m.recall(a.text, a.top).join(m.anchors().select("id", "text"), "id").orderBy("rank")
        out = [r.asDict() for r in hits.collect()]
    elif a.do == "sleep":
        out = m.consolidate()
    else:
        out = m.stats(at)
    print(json.dumps(out, ensure_ascii=False))


if __name__ == "__main__":
    main()
