"""Problem 8: garbled text from a wrong character encoding.

A noisy channel: a word was written in one encoding and read in another, perhaps losing bytes
on the way. Backward, each suspicious word becomes a lattice of bytes (`edges`): a character as it stands, a
valid multi-byte sequence as the character it stands for, and wildcards, where bytes were lost, for every character that has
the bytes that are left. A Viterbi search takes the cheapest path. `read_back` finds damage
with it, by the corpus's character counts and without wildcards; `decode` restores with it, by the corpus's word
frequencies, and by pairs of characters where a word is not in the corpus.

Which words of the corpus can end a path is found by a join: the corpus's words are sent forward through each channel,
lossy ones too, and their images joined with the words seen, so that no task needs the whole vocabulary. An image
is taken for a damaged word if the original is far more frequent, in documents or in distinct passages,
or if its passage as a whole reads better as the originals than as it stands, in which copies of a passage
count once. Word and character counts are made over all documents.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparlance.session import cut

#: Fixed: encodings in which UTF-8 is often misread. In `LATIN` ones a valid sequence is rare in true text;
#: in the others lead and trail bytes are letters, so more evidence is asked for.
LATIN = ("latin_1", "cp1252", "cp1250", "cp1254", "iso8859_2", "iso8859_15", "cp437", "cp850", "mac_roman")
LETTERS = ("cp1251", "cp1253", "iso8859_7", "koi8_r", "cp866", "iso8859_5", "cp1255", "cp1256")
MULTI = ("gbk", "shift_jis", "big5")
#: Fixed: (written, read) pairs of single-byte encodings, by the script of the written text.
WRITTEN = ("cp1252", "cp1250", "iso8859_2", "cp1254", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1253", "iso8859_7", "mac_roman", "cp437", "cp850")
READ = ("latin_1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "koi8_r", "cp866", "cp437", "cp850", "mac_roman", "iso8859_2")
EAST = ("cp932", "euc_jp", "gbk", "big5", "euc_kr")
#: A word is an original for images from this many documents on, and if it is this many times as frequent.
LEAST, TIMES = 3, 8
#: For an image of one or two characters, this many times.
RARER = 100
#: Fixed: a passage is damaged if at least half of its words are images in one channel, and the logs of how much more
#: frequent the originals are (each up to TIMES), with SHAPE for a fault of form, add up to EVIDENCE.
EVIDENCE, SHAPE = 4.0, 3.0

#: A word: letters and characters beyond ASCII (with entities for such), at least one of these.
WORD = re.compile(r"(?:[A-Za-z]|[^\x00-\x7f]|&#\d{2,6};)+")
_ODD = re.compile(r"[^\x00-\x7f]|&#\d{2,6};")
_ENTITY = re.compile(r"&#(\d{2,6});")
LOST = "�"


def words_of(text: str) -> set[str]:
    """Distinct words of a text that have a character beyond ASCII."""
    return {w for w in WORD.findall(text) if _ODD.search(w)}


#: Where one passage ends and the next begins.
_END = re.compile(r"[\n\r]+|(?<=[.!?;:。！？；])\s+")


def passages_of(text: str) -> list[tuple[int, set[str]]]:
    """(digest, words) of each passage with words beyond ASCII; the same words give the same digest, whatever else it says."""
    out = {}
    for passage in _END.split(text):
        if passage.isascii() and "&#" not in passage:
            continue
        if words := words_of(passage):
            digest = hashlib.blake2b("\n".join(sorted(words)).encode("utf-8", "surrogatepass"), digest_size=8).digest()
            out[int.from_bytes(digest, "big", signed=True)] = words
    return list(out.items())


@lru_cache(maxsize=None)
def _bytes_of(codec: str) -> dict[str, int]:
    """Byte of each character of a single-byte encoding; bytes it leaves undefined stand for themselves."""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    if codec in ("cp1252", "cp1250", "cp1254"):
        for b in range(0x80, 0xA0):
            table.setdefault(chr(b), b)
    return table


@lru_cache(maxsize=None)
def _chars_of(codec: str) -> list[str]:
    """Character of each byte of a single-byte encoding; bytes it leaves undefined stand for themselves."""
    return [bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256)]


def _sequence(values: list[int | None], i: int) -> tuple[str, int] | None:
    """The character that the bytes from i on stand for in UTF-8, and its length; None if they are no sequence."""
    b = values[i]
    n = 2 if b is not None and 0xC2 <= b <= 0xDF else 3 if b is not None and 0xE0 <= b <= 0xEF else 4 if b is not None and 0xF0 <= b <= 0xF4 else 0
    if not n or i + n > len(values) or any(v is None or not 0x80 <= v <= 0xBF for v in values[i + 1 : i + n]):
        return None
    try:
        return bytes(values[i : i + n]).decode("utf-8"), n  # type: ignore[arg-type]
    except UnicodeDecodeError:
        return None


@dataclass
class Model:
    """What the corpus says: documents with each character, documents in all, and counts of pairs of neighbours by hash.

    At most a number for each of Unicode's 1.1 million code points and PAIRS numbers.
    """

    counts: dict[str, int]
    total: int
    pairs: np.ndarray
    by_lead: dict[int, list[str]] = field(default_factory=dict)
    by_block: dict[int, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for c, n in sorted(self.counts.items()):
            if n >= 2 and unicodedata.category(c)[0] in "LM" and ord(c) > 127:
                self.by_lead.setdefault(c.encode("utf-8", "replace")[0], []).append(c)
                self.by_block.setdefault(block_of(c), []).append(c)

    def cost(self, before: str, c: str) -> float:
        """Negative log of how often c follows `before`, of all that follows it; "" is the edge of a word."""
        seen = float(self.pairs[pair_bucket(before, c)])
        return -math.log((seen + 0.01) / (float(self.pairs[pair_bucket(before, "any")]) + 1.0))


#: Buckets of the counts of pairs: 1 MB.
PAIRS = 1 << 17


def pair_bucket(before: str, c: str) -> int:
    return zlib.crc32(f"{before}\x00{c}".encode("utf-8", "surrogatepass")) & (PAIRS - 1)


def block_of(c: str) -> int:
    """0 for Latin letters, else a number for the 256 code points that a character is among."""
    return 0 if ord(c) < 0x250 else ord(c) >> 8


def edges(word: str, codec: str | None, model: Model | None = None) -> list[list[tuple[int, str, float]]]:
    """The lattice of a word: for each position the edges (end, characters, price) that leave it.

    An edge is a character as it stands; a valid UTF-8 sequence of bytes under `codec`, to its character; and with a
    model a wildcard: a first byte of which the next ones were lost, or are U+FFFD, to each
    character of the corpus with this first byte and the bytes that are left; and a run of U+FFFD
    without a first byte, to each letter of its neighbours' script.
    """
    table = _bytes_of(codec) if codec else {}
    values = [table.get(c) if ord(c) > 127 else None for c in word]
    out: list[list[tuple[int, str, float]]] = []
    for i, c in enumerate(word):
        b = values[i]
        lead = b is not None and 0xC2 <= b <= 0xF4
        here = [] if c == LOST and model else [(i + 1, c, KEPT if lead and model else 0.0)]
        found = _sequence(values, i)
        if found and _usable(found[0]):
            here.append((i + found[1], found[0], 0.0))
        if model and lead and not found:
            width, k = 2 if b < 0xE0 else 3 if b < 0xF0 else 4, i + 1
            while k < len(word) and k < i + width and values[k] is not None and 0x80 <= values[k] <= 0xBF:  # type: ignore[operator]
                k += 1
            left = bytes(values[i + 1 : k])  # type: ignore[arg-type]
            end = k
            while end < len(word) and word[end] == LOST and end < i + width:
                end += 1
            for x in model.by_lead.get(b, ()):  # type: ignore[arg-type]
                rest = iter(x.encode("utf-8")[1:])
                if all(y in rest for y in left):
                    here.append((end, x, WILD))
        if model and c == LOST:
            end = i + 1
            while end < len(word) and word[end] == LOST:
                end += 1
            near = [x for x in (word[i - 1 : i], word[end : end + 1]) if x and x != LOST]
            for block in {block_of(x) for x in near if x.isalpha()}:
                here += [(e, x, WILD) for e in {i + 1, end} for x in model.by_block.get(block, ())]
        out.append(here)
    return out


#: Prices in a lossy channel: of a wildcard, of a first byte that is taken for a character, and of a word that the corpus does not have.
WILD, KEPT, UNKNOWN = 1.5, 6.0, 8.0
#: How much cheaper a word that the corpus does not have must be than the next best reading: 10 times as likely.
MARGIN = math.log(10)


def decode(word: str, codec: str | None, model: Model, vocabulary: Mapping[str, int] | None = None) -> str | None:
    """Original of a word that lost bytes, by a Viterbi search through its lattice; None if it stays unknown.

    A path that spells a word of `vocabulary` costs the negative log of its frequency; any other
    costs those of its pairs of neighbours and UNKNOWN, and is taken only if the second best path of its kind costs
    MARGIN more. A path that leaves everything as it stands restores nothing.
    """
    lattice, n = edges(word, codec, model), len(word)
    best: tuple[float, str] | None = None
    if vocabulary:
        starts = {w[:i] for w in vocabulary for i in range(len(w) + 1)}
        reach: list[dict[str, float]] = [{} for _ in range(n + 1)]
        reach[0][""] = 0.0
        for i in range(n):
            for prefix, cost in reach[i].items():
                for end, c, price in lattice[i]:
                    new = prefix + c
                    if new in starts and cost + price < reach[end].get(new, math.inf):
                        reach[end][new] = cost + price
                if word[i] == LOST:  # one U+FFFD may stand for several characters of a word that is known
                    more = [new for new in starts if new.startswith(prefix) and 2 <= len(new) - len(prefix) <= 4 and not any(x < "\x80" for x in new[len(prefix) :])]
                    for new in more:
                        reach[i + 1][new] = min(cost + WILD * (len(new) - len(prefix)), reach[i + 1].get(new, math.inf))
        ends = [(cost - math.log((vocabulary[w] + 0.5) / (model.total + 1)), w) for w, cost in reach[n].items() if w in vocabulary and w != word]
        best = min(ends, default=None)
    # two best paths for each last character
    states: list[dict[str, list[tuple[float, str]]]] = [{} for _ in range(n + 1)]
    states[0][""] = [(0.0, "")]
    for i in range(n):
        for last, paths in states[i].items():
            for end, c, price in lattice[i]:
                step = price + model.cost(last, c)
                kept = states[end].setdefault(c, [])
                kept += [(cost + step, text + c) for cost, text in paths]
                kept.sort()
                del kept[2:]
    free = sorted((cost + model.cost(last, ""), text) for last, paths in states[n].items() for cost, text in paths)
    inside = not re.search(f"(?:^|[^\\w{LOST}]){LOST}|{LOST}(?:$|[^\\w{LOST}])", word)
    if inside and free and free[0][1] != word and LOST not in free[0][1] and (len(free) < 2 or free[1][0] - free[0][0] >= MARGIN):
        best = min(best, (free[0][0] + UNKNOWN, free[0][1])) if best else (free[0][0] + UNKNOWN, free[0][1])
    return best[1] if best else None


#: Characters that a sequence may stand for although the corpus has none of them in the clear: Latin letters,
#: punctuation, currencies, arrows, lines, dingbats, kana and ideographs, wide forms, emoji.
_COMMON = re.compile("[\u0080-\u024f\u2000-\u206f\u20a0-\u20bf\u2190-\u2bff\u3000-\u30ff\u4e00-\u9fff\uff00-\uffef\U0001f000-\U0001faff]")


def _usable(c: str) -> bool:
    return unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs") or 0x80 <= ord(c) <= 0x9F


def read_back(word: str, codec: str, counts: dict[str, int], total: int) -> tuple[str, int, int, int, float] | None:
    """Cheapest path through the lattice of a word's bytes under one encoding, without wildcards.

    Returns the restored word, the number of sequences decoded, of those of three bytes or more
    and of characters beyond ASCII left as they stand, and the gain in cost over the word as it
    stands; None if no sequence is decoded. Costs are negative log shares of documents with the
    character; a character that only starts or continues a sequence costs more as it stands. `decode` reads
    words that lost bytes.
    """
    table = _bytes_of(codec)
    values = [table.get(c) if ord(c) > 127 else None for c in word]
    if not any(v is not None and v >= 0xC2 for v in values):
        return None
    n = len(word)
    price = lambda c: 0.0 if ord(c) < 128 else -math.log((counts.get(c, 0) + 0.02) / (total + 1))
    best: list[tuple[float, int, str, int]] = [(0.0, -1, "", 0)] + [(math.inf, -1, "", 0)] * n
    raw = 0.0
    for i, leaving in enumerate(edges(word, codec)):
        at = best[i][0]
        v, first = values[i], _sequence(values, i) is not None
        own = price(word[i]) + (4.0 if first else 0.0) + (2.0 if v is not None and 0x80 <= v <= 0xBF and i and values[i - 1] is not None and values[i - 1] >= 0x80 else 0.0)
        raw += own
        for end, c, _ in leaving:
            width = end - i if end > i + 1 else 0
            cost = at + (price(c) + 0.5 if width else own)
            if cost < best[end][0]:
                best[end] = (cost, i, c, width)
    out, sequences, longer, kept, at = [], 0, 0, 0, n
    decoded = []
    while at > 0:
        _, back, c, width = best[at]
        out.append(c)
        sequences += width > 1
        longer += width > 2
        kept += width == 0 and ord(c) > 127
        if width > 1:
            decoded.append(c)
        at = back
    if not sequences:
        return None
    known = all(counts.get(c, 0) >= 2 for c in decoded)
    if not known and codec not in LATIN:
        return None
    if not all(counts.get(c, 0) >= 2 or _COMMON.match(c) for c in decoded):
        return None
    return "".join(reversed(out)), sequences, longer, kept, raw - best[n][0]


#: Two bytes of the rows in which East Asian sets keep accented letters and lines: signs that stand together in no true text.
_ROW_8 = re.compile("[\u00a8\u00a9][\u00a1-\u00fe]")


def _east(word: str, counts: dict[str, int]) -> tuple[str, str] | None:
    """A word of an East Asian multi-byte encoding that was read byte by byte: the original and the channel."""
    high = sum(ord(c) > 127 for c in word)
    if high == 2 and (m := _ROW_8.search(word)):
        for written in ("gbk", "euc_jp", "euc_kr"):
            try:
                c = m.group(0).encode("latin_1").decode(written)
            except UnicodeError:
                continue
            if len(c) == 1 and counts.get(c, 0) >= 2 and unicodedata.category(c) in ("Ll", "Lu", "So"):
                return word.replace(m.group(0), c), f"{written}>latin_1"
    if high < 3 or re.search(r"[぀-ヿ一-鿿가-힯]", word):
        return None
    for read in ("cp1252", "latin_1", "cp1251", "cp1250", "mac_roman"):
        table = _bytes_of(read)
        if any(c not in table for c in word if ord(c) > 127):
            continue
        data = bytes(table[c] if ord(c) > 127 else ord(c) for c in word)
        for written in EAST:
            for cut_off in (0, 1):  # the second byte of a last character may be ASCII, cut off with the rest
                try:
                    text = data[: len(data) - cut_off].decode(written)
                except UnicodeDecodeError:
                    continue
                wide = [c for c in text if ord(c) > 0x2FF]
                if len(wide) >= 2 and 3 * len(wide) >= high and all(counts.get(c, 0) >= 2 for c in wide):
                    return text, f"{written}>{read}"
    return None


def restore_word(word: str, counts: dict[str, int], total: int, depth: int = 0) -> tuple[str, str] | None:
    """(restored, channel) of a word whose bytes speak for themselves; None if they don't.

    Numeric entities are read first. A word that was garbled twice is restored twice.
    """
    plain = _ENTITY.sub(lambda m: html.unescape(m.group(0)), word) if depth == 0 and "&#" in word else word
    best: tuple[float, str, str, bool] | None = None
    for codec in (*LATIN, *LETTERS):
        got = read_back(plain, codec, counts, total)
        if got is None:
            continue
        text, sequences, longer, kept, gain = got
        if codec in LETTERS and (kept or sequences < 2 and not longer):
            continue
        if gain > 0 and (best is None or gain > best[0] + 1e-9):
            best = gain, text, codec, kept > 0
    if best and best[3] and (east := _east(plain, counts)):
        return east
    if best:
        deeper = restore_word(best[1], counts, total, depth + 1) if depth < 3 else None
        return (deeper[0], f"utf_8>{best[2]}+{deeper[1]}") if deeper else (best[1], f"utf_8>{best[2]}")
    for codec in MULTI:
        if len(plain) >= 2:
            try:
                text = plain.encode(codec).decode("utf-8")
            except UnicodeError:
                continue
            if text != plain and all(counts.get(c, 0) >= 2 for c in text if ord(c) > 127):
                return text, f"utf_8>{codec}"
    return _east(plain, counts)


def _explained(word: str, restored: str) -> bool:
    """Has each character beyond ASCII of the restored word taken up at least two of the damaged one?"""
    return 2 * sum(ord(c) > 127 for c in restored) <= sum(ord(c) > 127 for c in _ENTITY.sub("\x80", word))


def faults(word: str) -> float:
    """Faults of form: signs or controls among the letters, two scripts, a capital after a small letter, more accented
    Latin letters than plain ones; half a fault for capitals alone in another script than Latin."""
    plain = sum(c.isascii() and c.isalpha() for c in word)
    beyond = [c for c in word if ord(c) > 127]
    accented = sum(c.isalpha() and ord(c) <= 0x24F for c in beyond)
    other = [c for c in beyond if ord(c) > 0x24F and c.isalpha()]
    letters = plain + accented + len(other)
    signs = sum(not c.isalpha() and unicodedata.category(c) not in ("Mn", "Mc", "Cf", "Pd", "Pi", "Pf", "Po") or c == LOST or 0x80 <= ord(c) <= 0x9F for c in beyond)
    return (
        (letters > 0 and signs > 0)
        + (plain + accented > 0 and len(other) > 0)
        + any(x.islower() and y.isupper() for x, y in zip(word, word[1:]) if ord(x) > 127 or ord(y) > 127)
        + (letters >= 3 and accented > plain + len(other))
        + 0.5 * (len(other) >= 3 and word.isupper())
    )


def images_of(word: str) -> set[tuple[str, str]]:
    """(image, channels): what a word becomes in each lossy or single-byte channel, if that differs from it; channels
    with the same image are joined by |."""
    out: dict[str, list[str]] = {}

    def add(image: str, channel: str) -> None:
        names = out.setdefault(image, [])
        if channel not in names:
            names.append(channel)

    for written in (*WRITTEN, *EAST):
        try:
            data = word.encode(written)
        except UnicodeEncodeError:
            continue
        for read in READ:
            if read == written:
                continue
            seen = data.decode(read, "replace") if read not in ("latin_1",) else data.decode("latin_1")
            if seen != word and LOST not in seen:
                add(seen, f"{written}>{read}")
    data = word.encode("utf-8", "replace")
    for read in LETTERS:  # a single sequence is no evidence by itself there
        add("".join(_chars_of(read)[b] for b in data), f"utf_8>{read}")
    bare = "".join(c for c in data.decode("latin_1") if not 0x80 <= ord(c) <= 0x9F)
    add(bare, "utf_8>latin_1 without controls")
    add("".join(c for c in data.decode("cp1252", "ignore") if not 0x80 <= ord(c) <= 0x9F), "utf_8>cp1252 without undefined")
    add("".join(LOST if ord(c) > 127 else c for c in word), "bytes lost")
    add(re.sub(r"[^\x00-\x7f]+", LOST, word), "bytes lost")
    for i, c in enumerate(word):  # one character, or two in a row
        if ord(c) > 127:
            for k in (1, 2):
                add(word[:i] + LOST + word[i + k :], "bytes lost")
    return {(i, "|".join(c)) for i, c in out.items() if i != word and _ODD.search(i)}


def _words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, passage, word, first): the distinct words beyond ASCII of each passage; first at one place in each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf.key, pdf.text):
                met: set[str] = set()
                for passage, words in passages_of(t):
                    rows += [(k, passage, w, w not in met) for w in words]
                    met |= words
            yield pd.DataFrame(rows, columns=["key", "passage", "word", "first"])

    odd = docs.where(F.col(key).isNotNull() & F.col(text).rlike(r"[^\x00-\x7F]|&#\d{2,6};")).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return odd.mapInPandas(run, "key long, passage long, word string, first boolean")


def corpus_model(lexicon: DataFrame, total: int) -> Model:
    """Counts of characters and of pairs of neighbours over all (word, n). Of bounded size, see Model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = np.zeros(PAIRS, dtype=np.int64)
        count: dict[str, int] = {}
        for pdf in batches:
            for w, n in zip(pdf.word, pdf.n):
                for c in set(w):
                    if ord(c) > 127:
                        count[c] = count.get(c, 0) + n
                if LOST not in w:
                    for a, b in zip(("", *w), (*w, "")):
                        pairs[pair_bucket(a, b)] += n
                        pairs[pair_bucket(a, "any")] += n
        at = np.flatnonzero(pairs)
        if len(at) or count:
            yield pd.DataFrame({"c": [*count, *[None] * len(at)], "bucket": [*[-1] * len(count), *at], "n": [*count.values(), *pairs[at]]})

    got = lexicon.select("word", "n").mapInPandas(run, "c string, bucket int, n long").groupBy("c", "bucket").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(PAIRS, dtype=np.int64)
    of_pairs, of_chars = got[got.bucket >= 0], got[got.bucket < 0]
    pairs[of_pairs.bucket.to_numpy(dtype=np.int64)] = of_pairs.n.to_numpy(dtype=np.int64)
    return Model(dict(zip(of_chars.c, (int(x) for x in of_chars.n))), total, pairs)


def _read_as(channel: str | None) -> str | None:
    """The encoding in which a word written in UTF-8 was last read, for a channel that ends so."""
    first = (channel or "").split("+")[0].split("|")[0]
    return first[6:].split(" ")[0] if first.startswith("utf_8>") and first[6:].split(" ")[0] in (*LATIN, *LETTERS) else None


def damaged_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, restored, channel, sure) of the damaged words among (key, passage, word, first), restored being null where
    it stays unknown; and the same with passage for words that are damaged in that passage.

    Counts are over all documents, and over the distinct passages. Only the corpus model is sent to every
    task, whose size is bounded.
    """
    spark = words.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # words are costly in Python: no few large partitions
    seen = cut(words.groupBy("passage", "word").agg(F.sum(F.col("first").cast("long")).alias("n")))
    lexicon = cut(seen.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("apart")).repartition(tasks))
    total = words.select("key").distinct().count()
    shared = spark.sparkContext.broadcast(corpus_model(lexicon, total))

    def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value.counts
        for pdf in batches:
            out = []
            for w in pdf.word:
                r = restore_word(w, counts, total)
                if r:
                    # characters left over speak for another channel, if the corpus knows one
                    out.append((w, r[0], r[1], 3 if _explained(w, r[0]) else 1, 0))
                elif LOST in w:
                    out.append((w, None, "bytes lost", 0, 0))
            yield pd.DataFrame(out, columns=["word", "restored", "channel", "sure", "times"])

    by_bytes = lexicon.select("word").mapInPandas(backward, "word string, restored string, channel string, sure int, times long")

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(image, w, n, a, c) for w, n, a in zip(pdf.word, pdf.n, pdf.apart) for image, c in images_of(w)]
            yield pd.DataFrame(out, columns=["shown", "restored", "times", "times_apart", "channels"])

    images = lexicon.where((F.col("n") >= LEAST) & ~F.col("word").contains(LOST)).mapInPandas(forward, "shown string, restored string, times long, times_apart long, channels string")
    shown = F.regexp_replace("word", f"{LOST}+", LOST)

    def shaped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(worse=[float(faults(w) - faults(r)) for w, r in zip(pdf.word, pdf.restored)])

    columns = ["word", "n", "apart", "restored", "times", "times_apart", "channels"]
    joined = lexicon.withColumn("shown", shown).join(images, "shown").select(*columns).repartition(tasks)
    pairs = cut(joined.mapInPandas(shaped, "word string, n long, apart long, restored string, times long, times_apart long, channels string, worse double"))
    # one or two characters are taken for an image only if they are no word of their own: controls, two signs, letters of few languages
    w = F.col("word")
    # documents or passages decide for an image of better form only if both do
    raw, apart, formed = lambda k: F.col("times") >= k * F.col("n"), lambda k: F.col("times_apart") >= k * F.col("apart"), F.col("worse") > -1
    more = lambda k: ((raw(k) | apart(k)) & formed) | (raw(k) & apart(k))
    short = w.rlike(r"^[\x{80}-\x{9f}\x{400}\x{402}-\x{40f}]$") | w.rlike(r"^[^\x00-\x7F\p{L}]{2}$")
    long = ((F.length("word") >= 3) & w.rlike(f"[^{LOST}]")) | (w.contains(LOST) & w.rlike(f"[^{LOST}]"))

    # the passage as a whole: the sum changes its sign with the direction, so an original is never taken for the image of its own damage
    gain = F.log((F.col("times_apart") + 0.5) / (F.col("apart") + 0.5))
    score = F.greatest(F.lit(-math.log(TIMES)), F.least(F.lit(math.log(TIMES)), gain)) + SHAPE * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("worse")))
    spread = pairs.withColumn("score", score).withColumn("channel", F.explode(F.split("channels", r"\|")))
    best = spread.groupBy("word", "channel").agg(F.max(F.struct("score", "times", "restored")).alias("m")).select("word", "channel", "m.score", "m.restored")
    size = seen.groupBy("passage").agg(F.count("*").alias("size"))
    counted = seen.join(best.where(long), "word").groupBy("passage", "channel").agg(F.count("*").alias("k"), F.sum("score").alias("sum"))
    accepted = counted.where(F.col("sum") >= EVIDENCE).join(size, "passage").where("2 * k >= size")
    chosen = accepted.groupBy("passage").agg(F.max(F.struct("sum", "k", "channel")).alias("m")).select("passage", "m.channel")
    here = cut(chosen.join(seen.select("passage", "word"), "passage").join(best, ["word", "channel"]).select("passage", "word", "restored", "channel", F.lit(2).alias("sure")))

    # copies of a damaged passage are no evidence that its original is an image of it
    opposite = here.select(F.col("restored").alias("word"), F.col("word").alias("restored")).distinct()
    matched = pairs.join(opposite, ["word", "restored"], "left_anti").where((more(TIMES) | w.contains(LOST)) & (long | (short & more(RARER)))).withColumn("channel", F.substring_index("channels", "|", 1))
    by_words = matched.groupBy("word").agg(F.max(F.struct("times", "restored", "channel")).alias("m")).select("word", "m.restored", "m.channel", F.lit(2).alias("sure"), "m.times")
    both = by_bytes.unionByName(by_words)
    # bytes that are explained to the last one decide; then words known from the corpus; then other bytes
    anywhere = both.groupBy("word").agg(F.max(F.struct("sure", "times", "restored", "channel")).alias("m")).select("word", "m.restored", "m.channel", "m.sure", "m.times")

    def lossy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Words with U+FFFD, by the lattice with wildcards and the most frequent word of the corpus that fits."""
        model = shared.value
        for pdf in batches:
            out = []
            for w, r, channel, sure, times in zip(pdf.word, pdf.restored, pdf.channel, pdf.sure, pdf.times):
                if LOST in w:
                    r = decode(w, _read_as(channel), model, {r: int(times)} if r and times else None) or r
                out.append((w, r, channel, sure))
            yield pd.DataFrame(out, columns=["word", "restored", "channel", "sure"])

    anywhere = cut(anywhere.mapInPandas(lossy, "word string, restored string, channel string, sure int"))

    # where a passage has words in UTF-8 that were read in another encoding, its other words may have lost bytes
    codec_of = F.udf(lambda channel: _read_as(channel), "string")
    known = anywhere.select("channel").distinct().unionByName(here.select("channel").distinct()).distinct().withColumn("codec", codec_of("channel")).where(F.col("codec").isin(*LATIN))  # few channels
    spoiled = seen.select("passage", "word").join(anywhere.select("word", "channel"), "word").select("passage", "channel").unionByName(here.select("passage", "channel"))
    spoiled = spoiled.join(known, "channel").groupBy("passage").agg(F.min("codec").alias("codec"))
    # a word of one or two characters is no evidence
    ends = pairs.where(F.col("channels").contains("utf_8>")).groupBy("word").agg(F.max(F.struct("times", "restored")).alias("m")).select("word", "m.restored", "m.times")
    others = spoiled.join(seen.select("passage", "word").where("length(word) > 2"), "passage").join(anywhere.select("word"), "word", "left_anti").join(here.select("passage", "word"), ["passage", "word"], "left_anti").join(ends, "word", "left")

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            out = []
            for passage, codec, w, r, times in zip(pdf.passage, pdf.codec, pdf.word, pdf.restored, pdf.times):
                got = decode(w, codec, model, {r: int(times)} if isinstance(r, str) else None)
                if got and got != w:
                    out.append((passage, w, got, f"utf_8>{codec} with lost bytes", 1))
            yield pd.DataFrame(out, columns=["passage", "word", "restored", "channel", "sure"])

    late = others.select("passage", "codec", "word", "restored", "times").mapInPandas(beside, "passage long, word string, restored string, channel string, sure int")
    return anywhere, cut(here.unionByName(late))


_RUN = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")


def _whole_run(run: str, channels: set[str]) -> str:
    """A run without spaces in the encoding of a channel seen in its document; second bytes may be ASCII marks."""
    for channel in sorted(channels):
        written, _, read = channel.partition(">")
        table = _bytes_of(read)
        if all(c in table or ord(c) < 128 for c in run):
            try:
                return bytes(table[c] if ord(c) > 127 else ord(c) for c in run).decode(written)
            except UnicodeDecodeError:
                continue
    return run


def garbled_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word, restored, channel): every damaged word of every document."""
    words = cut(_words(docs, key, text))
    anywhere, here = damaged_words(words)
    places = words.select("key", "passage", "word")
    columns = ["key", "word", "restored", "channel", "sure"]
    found = places.join(anywhere, "word").select(*columns).unionByName(places.join(here, ["passage", "word"]).select(*columns))
    best = found.groupBy("key", "word").agg(F.max(F.struct("sure", "restored", "channel")).alias("m"))
    return best.select(F.col("key").alias(key), "word", "m.restored", "m.channel")


def garbled_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key) of the documents with a damaged word. Null and empty texts have none, and a row
    without a key is left out; an empty table gives no row."""
    return garbled_words(docs, key=key, text=text).select(key).distinct()


def restored_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored_text, n_words, n_unknown) of the documents with a damaged word.

    Every damaged word with a known original is replaced, longest first; others stay as they are and are
    counted in n_unknown. Documents with the same key are restored each on its own text.
    """
    words = garbled_words(docs, key=key, text=text)
    found = words.groupBy(key).agg(F.collect_set(F.struct("word", "restored", "channel")).alias("found"))
    joined = found.join(docs.select(key, F.col(text).alias("_text")).where("_text is not null"), key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t, pairs in zip(pdf[key], pdf._text, pdf.found):
                known = {p["word"]: p["restored"] for p in pairs}
                east = {p["channel"] for p in pairs if p["channel"].partition(">")[0] in EAST}
                new = _RUN.sub(lambda m: _whole_run(m.group(0), east), t) if east else t
                new = WORD.sub(lambda m: known.get(m.group(0)) or m.group(0), new)
                out.append((k, new, len(known), sum(v is None for v in known.values())))
            yield pd.DataFrame(out, columns=[key, "restored_text", "n_words", "n_unknown"])

    return joined.mapInPandas(run, f"{key} long, restored_text string, n_words int, n_unknown int")
