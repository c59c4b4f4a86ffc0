"""Evaluation texts leaking into training text: Wu-Manber search for every run of protected words.

A pattern is any ``words`` consecutive words of a passage, folded and joined; text is folded the same way, so layout,
punctuation, case, escapes and character forms do not matter.  Wu-Manber's SHIFT table over blocks skips positions
where no pattern can end, buckets of suffix hashes select the patterns to test, and bytes are compared to confirm.
The tables are built from the items in sets of bounded size and broadcast; documents are scanned where they lie, so
there is no shuffle of text.  Text that is written without spaces between words, as Chinese or Thai, has no runs of
words by this rule and is not found.
"""

from __future__ import annotations

import html
import re
import unicodedata
import urllib.parse
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumigraph.session import ship

BLOCK = 12
MOST_BITS = 26  # of a SHIFT table, which has 16 slots a byte of passages up to there
ITEM_BYTES = 32_000_000  # passages of one set of tables, some 250 MB; more items take more sets
PASS_TABLES = 3  # sets searched in one pass over the text
GAP = b"\0" * 64

_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2})|([nrtfv])|\r?\n)")
_SURROGATES = re.compile("[\ud800-\udbff][\udc00-\udfff]")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_QUOTED = re.compile(r"(?:=[0-9A-F]{2})+|=[ \t]*\r?\n[+\- ]?")
_CODEPOINT = re.compile(r"U\+([0-9A-F]{4,6})")
_MOJIBAKE = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178]{1,3}")
_NUMBER = re.compile(r"(?m)^([^\w\n]*)\d+(?![\w])")
_NUMBERS = re.compile(r"(?m)^([^\w\n]*)(?:\d+(?![\w])[^\w\n]*)+")
_WORD = re.compile(r"[^\W_]+")
_NOT_WORD = re.compile(r"[\W_]+")
# look-alikes of Latin letters: fixed values
_ALIKE = str.maketrans("авекмнорстухіјѕԁԛԝαβεικνορτυχı", "abekmhopctyxijsdqwabeiknoptuxi")
_DROP = bytes(i for i in range(128) if not chr(i).isalnum())
_CONTROL = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")


def _escape(m: re.Match) -> str:
    code = m[1] or m[2] or m[3] or m[4]
    if code:
        n = int(code, 16)
        return chr(n) if n < 0x110000 else " "
    return " "


def _bytes_of(pairs: str, sign: str) -> str:
    raw = bytes.fromhex(pairs.replace(sign, ""))
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _unmangle(m: re.Match) -> str:
    for enc in ("cp1252", "latin-1"):
        try:
            return m[0].encode(enc).decode()
        except UnicodeError:
            pass
    return m[0]


def decode(text: str, lower: bool = True) -> str:
    """Undo escapes and character forms; lower case, unless told not to; letters without their marks.

    Keeps separators and line breaks.
    """
    t = text
    for _ in range(2):
        if "&" in t:
            t = html.unescape(t)
    if "\\" in t:
        t = _ESCAPE.sub(_escape, t)
    if "U+" in t:
        t = _CODEPOINT.sub(lambda m: chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else " ", t)
    if "%" in t:
        t = _PERCENT.sub(lambda m: urllib.parse.unquote(m[0], errors="replace"), t)
    if "=" in t:
        t = _QUOTED.sub(lambda m: "" if m[0][1:].strip("+- \t\r\n") == "" else _bytes_of(m[0], "="), t)
    if not t.isascii():
        if any("\ud800" <= c <= "\udfff" for c in t):
            t = _SURROGATES.sub(lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16"), t)
            t = re.sub("[\ud800-\udfff]", " ", t)
        t = _MOJIBAKE.sub(_unmangle, t)
        t = _CONTROL.sub("", t)
        t = unicodedata.normalize("NFKD", t.casefold() if lower else t)
        t = re.sub("[\u0300-\u036f]", "", t)
        return (t.casefold() if lower else t).translate(_ALIKE)
    return t.lower() if lower else t


def squeeze(t: str) -> bytes:
    """Letters and digits only."""
    return t.encode().translate(None, _DROP) if t.isascii() else _NOT_WORD.sub("", t).encode()


def words_of(passage: str) -> list[str]:
    return _WORD.findall(decode(passage))


def variants(t: str) -> list[str]:
    """The text, and without the first, or all, numbers at the starts of its lines where it has such."""
    out = [t]
    one = _NUMBER.sub(r"\1", t)
    if one != t:
        out.append(one)
        every = _NUMBERS.sub(r"\1", t)
        if every != one:
            out.append(every)
    return out


@dataclass(frozen=True)
class Patterns:
    """Wu-Manber tables over one byte string that holds all passages: a pattern is a start and a length in it."""

    text: bytes
    start: np.ndarray
    length: np.ndarray
    ids: np.ndarray  # items of the patterns, one after the other
    first: np.ndarray  # where each pattern's items begin; one more for the end
    shortest: int
    bits: int
    shift: np.ndarray
    keys: np.ndarray  # sorted suffix hashes of the patterns' first ``shortest`` bytes
    order: np.ndarray  # the pattern of each key

    def items(self, k: int) -> list[int]:
        return self.ids[self.first[k] : self.first[k + 1]].tolist()

    def hits(self, buf: bytes, lanes: int = 8192) -> list[tuple[int, int]]:
        """(position, pattern) of every occurrence in ``buf``; many windows slide side by side."""
        m = self.shortest
        n = len(buf)
        if not len(self.start) or n < m:
            return []
        view8 = np.ndarray((n - 7,), "<u8", buf, 0, (1,))
        lanes = max(1, min(lanes, n // (4 * m) or 1))
        edge = np.linspace(m - 1, n, lanes + 1).astype(np.int64)
        pos, end = edge[:-1].copy(), edge[1:]
        slot = np.uint64(64 - self.bits)
        out: list[tuple[int, int]] = []
        while len(pos):
            h = _hash(view8[pos - 11], view8[pos - 7])
            step = self.shift[h >> slot].astype(np.int64)
            zero = np.flatnonzero(step == 0)
            if len(zero):
                lo = np.searchsorted(self.keys, h[zero])
                for z, at in zip(zero, lo):
                    p, key = int(pos[z]) - m + 1, h[z]
                    while at < len(self.keys) and self.keys[at] == key:
                        i = int(self.order[at])
                        s = int(self.start[i])
                        if buf.startswith(self.text[s : s + int(self.length[i])], p):
                            out.append((p, i))
                        at += 1
                step[zero] = 1
            pos = pos + step
            live = pos < end
            if not live.all():
                pos, end = pos[live], end[live]
        return out


def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the BLOCK bytes that end at a position: ``a`` holds the first eight, ``b`` the last eight."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F))
        x ^= x >> np.uint64(29)
        return x * np.uint64(0xBF58476D1CE4E5B9)


def _runs(passages: list[tuple[int, str]], words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All passages as one byte string, and the start, length and item of every run of ``words`` words."""
    parts, begin, size, item, at = [], [], [], [], 0
    for i, passage in passages:
        w = [x.encode() for x in words_of(passage or "")]
        if len(w) < words:
            continue
        ends = np.cumsum([len(x) for x in w])
        starts = np.concatenate([[0], ends[:-1]])
        k = len(w) - words + 1
        begin.append(starts[:k] + at)
        size.append(ends[words - 1 :] - starts[:k])
        item.append(np.full(k, i, np.int64))
        parts.extend(w)
        at += int(ends[-1])
    z = np.zeros(0, np.int64)
    return b"".join(parts), *(np.concatenate(x or [z]) for x in (begin, size, item))


def _marks(text: np.ndarray, start: np.ndarray, length: np.ndarray, base: int, chunk: int = 1 << 20) -> np.ndarray:
    """64 bits of hash of each run: the sums of bytes times powers of ``base``, moved to the same power."""
    inverse = pow(base, -1, 1 << 64)
    out = np.empty(len(start), np.uint64)
    done = 0
    with np.errstate(over="ignore"):
        while done < len(start):
            s = int(start[done])
            e = max(done + 1, int(np.searchsorted(start, s + chunk)))
            stop = int((start[done:e] + length[done:e]).max())
            n = stop - s
            power = np.ones(n + 1, np.uint64)
            power[1:] = base
            power = np.multiply.accumulate(power)
            back = np.ones(n + 1, np.uint64)
            back[1:] = inverse
            back = np.multiply.accumulate(back)
            sums = np.concatenate([[np.uint64(0)], np.cumsum((text[s:stop].astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
            a = start[done:e] - s
            out[done:e] = (sums[a + length[done:e]] - sums[a]) * back[a]
            done = e
    return out


def compile_patterns(items: list[tuple[int, str]], words: int = 15) -> Patterns:
    """Every run of ``words`` words of every passage.  Shorter passages, and runs of under BLOCK bytes, make none."""
    body, start, length, item = _runs(sorted(items, key=lambda x: x[0]), words)
    keep = length >= BLOCK
    start, length, item = start[keep], length[keep], item[keep]
    text = np.frombuffer(body + bytes(16), np.uint8)
    # equal runs are one pattern with several items
    mark = np.stack([_marks(text, start, length, 0x9E3779B97F4A7C15), _marks(text, start, length, 0xD6E8FEB86659FD93), length.astype(np.uint64)], axis=1)
    order = np.lexsort((item, *mark.T))
    mark, start, length, item = mark[order], start[order], length[order], item[order]
    fresh = np.ones(len(item), bool)
    fresh[1:] = (mark[1:] != mark[:-1]).any(1)
    once = fresh.copy()
    once[1:] |= item[1:] != item[:-1]
    group = (np.cumsum(fresh) - 1)[once]
    start, length, ids = start[fresh], length[fresh], item[once].astype(np.int32)
    first = np.searchsorted(group, np.arange(len(start) + 1))
    m = int(length.min(initial=255 + BLOCK)) if len(start) else BLOCK
    bits = int(np.clip(np.ceil(np.log2(len(body) + 1)) + 4, 16, MOST_BITS))  # overlapping runs have a block a byte
    shift = np.full(1 << bits, min(255, m - BLOCK + 1), np.uint8)
    keys = np.zeros(0, np.uint64)
    if len(start):
        eight = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
        for last in range(BLOCK - 1, m):  # the shift falls as ``last`` grows, so the smallest stays
            at = start + last
            keys = _hash(eight[at - 11], eight[at - 7])
            shift[keys >> np.uint64(64 - bits)] = min(255, m - 1 - last)
    by = np.argsort(keys, kind="stable")
    return Patterns(body, start, length.astype(np.int32), ids, first, m, bits, shift, keys[by], by.astype(np.int32))


def _confirmed(t: str, found: list[tuple[int, int]], pats: Patterns) -> set[int]:
    """Items of the hits that begin and end where words of the text do."""
    starts, ends, at = set(), set(), 0
    for w in _WORD.findall(t):
        starts.add(at)
        at += len(w.encode())
        ends.add(at)
    return {x for p, i in found if p in starts and p + int(pats.length[i]) in ends for x in pats.items(i)}


def scan(texts: list[str | None], tables: list[Patterns]) -> list[set[int]]:
    """Items leaked by each text, whole texts, any length; each is decoded once, whatever the number of tables."""
    out: list[set[int]] = [set() for _ in texts]
    part: list[bytes] = []
    where: list[tuple[int, int, str]] = []  # start in the buffer, text number, folded text
    size = 0
    least = min((t.shortest for t in tables if len(t.start)), default=1 << 30)

    def flush() -> None:
        nonlocal size
        if where:
            buf = b"".join(part)
            begin = np.array([w[0] for w in where])
            for pats in tables:
                per: dict[int, list[tuple[int, int]]] = {}
                for p, i in pats.hits(buf):
                    k = int(np.searchsorted(begin, p, "right")) - 1
                    per.setdefault(k, []).append((p - where[k][0], i))
                for k, found in per.items():
                    out[where[k][1]] |= _confirmed(where[k][2], found, pats)
        part.clear()
        where.clear()
        size = 0

    for n, text in enumerate(texts):
        if not text:
            continue
        for t in variants(decode(text)):
            s = squeeze(t)
            if len(s) >= least:
                where.append((size, n, t))
                part.extend((s, GAP))
                size += len(s) + len(GAP)
        if size > 8_000_000:
            flush()
    flush()
    return out


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", words: int = 15) -> DataFrame:
    """``(doc_id, item_id)`` for each document with at least ``words`` consecutive words of an item's passage.

    Null or blank texts and passages, null item ids and passages of fewer words give no rows; repeated items and
    documents count once per id; further columns are ignored; empty tables give no rows; text of any length is
    scanned whole.
    """
    spark = docs.sparkSession
    ship(spark)
    one = items.select(F.col(item_id).cast("int").alias("i"), F.col(passage).alias("p")).where("i is not null and p is not null")
    size = one.agg(F.sum(F.octet_length("p"))).first()[0] or 0
    tables = max(1, -(-size // ITEM_BYTES))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).where("t is not null")
    out = None
    for first in range(0, tables, PASS_TABLES):
        shared = []
        for k in range(first, min(tables, first + PASS_TABLES)):
            mine = one if tables == 1 else one.where(F.pmod(F.xxhash64("i"), F.lit(tables)) == k)
            shared.append(spark.sparkContext.broadcast(compile_patterns([(r.i, r.p) for r in mine.toLocalIterator()], words)))

        def run(batches, shared=shared):
            held = [t.value for t in shared]
            for b in batches:
                ids = b.column(0).to_pylist()
                found = scan(b.column(1).to_pylist(), held)
                rows = [(d, i) for d, f in zip(ids, found) for i in sorted(f)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32())], names=["doc_id", "item_id"])

        part = source.mapInArrow(run, "doc_id long, item_id int")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
