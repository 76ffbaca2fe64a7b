"""Accuracy of restoration on planted damage: python tests/llm/measure_garble.py DATA_DIR.

Documents in which no damage is found are damaged through known channels and put beside the
corpus; printed is, by channel, how many were found, restored to the last character, and the
share of damaged words whose original came back.
"""

from __future__ import annotations

import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from sparlance.llm import garble  # noqa: E402
from sparlance.session import build_session, table  # noqa: E402


def some_lost(text: str, rng: random.Random) -> str:
    """About one word in three loses one character to U+FFFD."""
    return re.sub(r"[^\x00-\x7f]", lambda m: garble.LOST if rng.random() < 0.34 else m.group(0), text)


CHANNELS = {
    "utf_8>cp1252, undefined bytes dropped": lambda t, r: t.encode("utf-8").decode("cp1252", "ignore"),
    "utf_8>latin_1, controls dropped": lambda t, r: "".join(c for c in t.encode("utf-8").decode("latin_1") if not 0x80 <= ord(c) <= 0x9F),
    "utf_8>latin_1": lambda t, r: t.encode("utf-8").decode("latin_1"),
    "utf_8>cp1251": lambda t, r: t.encode("utf-8").decode("cp1251", "replace"),
    "cp1252>cp437": lambda t, r: t.encode("cp1252", "replace").decode("cp437"),
    "some characters lost": some_lost,
}


def main(base: str, each: int = 60) -> None:
    spark = build_session("local[8]", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    docs = table(spark, base, "documents").select("doc_id", "text")
    clean = docs.join(garble.garbled_documents(docs), "doc_id", "left_anti").where("text rlike '\\\\p{L}*[^\\\\x00-\\\\x7F]\\\\p{L}+.*[^\\\\x00-\\\\x7F]\\\\p{L}'").orderBy("doc_id").toPandas()
    rng = random.Random(8)
    picked = clean.sample(each * len(CHANNELS), random_state=8)
    planted = {}
    for i, text in enumerate(picked.text):
        name = list(CHANNELS)[i % len(CHANNELS)]
        bad = CHANNELS[name](text, rng)
        if bad != text and "?" not in (set(bad) - set(text)):
            planted[10_000_000 + i] = (name, text, bad)
    rest = docs.where(~docs.doc_id.isin([int(x) for x in picked.doc_id]))
    both = rest.unionByName(spark.createDataFrame([(k, bad) for k, (_, _, bad) in planted.items()], "doc_id long, text string"))
    got = {r["doc_id"]: r["restored_text"] for r in garble.restored_documents(both).where("doc_id >= 10000000").collect()}
    for name in CHANNELS:
        mine = {k: v for k, v in planted.items() if v[0] == name}
        words = right = 0
        for k, (_, text, bad) in mine.items():
            a, b, c = text.split(), bad.split(), got.get(k, bad).split()
            if len(a) == len(b) == len(c):
                damaged = [(x, z) for x, y, z in zip(a, b, c) if x != y]
                words += len(damaged)
                right += sum(x == z for x, z in damaged)
        print(f"{name}: planted {len(mine)}, found {sum(k in got for k in mine)}, whole text right {sum(got.get(k) == v[1] for k, v in mine.items())}, words right {right} of {words}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
