"""Text that was decoded in a wrong character encoding: found by clean near-twins, repaired by what they teach."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlake.session import ensure_checkpoint_dir, python_partitions

#: Encodings a text may have had (right) or been read in (wrong); fixed values.
SINGLE = "cp1252 latin_1 cp1250 cp1251 cp437 cp850 cp866 mac_roman koi8_r iso8859_2 iso8859_5 iso8859_15 cp852 cp1253 cp1254 mac_cyrillic".split()
DOUBLE = "gbk cp932 euc_jp big5 euc_kr".split()
WIDE = "utf_16_le utf_16_be".split()
UTF8 = "utf_8"
#: (right, wrong) encodings that are tried on near-twins.
PAIRS = [(UTF8, w) for w in SINGLE] + [(r, w) for r in SINGLE for w in SINGLE if r != w] + [(r, UTF8) for r in SINGLE[:4] + DOUBLE]
#: The same where a character is more than a byte: no ASCII is left to join twins on, so these are learned from repairs.
WIDE_PAIRS = [(UTF8, w) for w in DOUBLE + WIDE] + [(r, w) for r in DOUBLE for w in SINGLE[:9]]
LOST = "�"
#: Cells of the hashed table of character pairs.
CELLS = 1 << 18
#: By how many nats a character pair of the repaired text must be likelier on average, and how much in all.
BETTER, BETTER_IN_ALL, ROUNDS = 1.5, 6.0, 3
#: Nats less for each character more or less after reading UTF-8: valid sequences hardly arise by chance.
PER_SAVED = 0.15
#: The same where a character only becomes another one, which is weaker evidence than bytes that make up UTF-8.
MAPPED, MAPPED_IN_ALL = 2.0, 14.0

_RUN = re.compile(r"[^\x00-\x7f]+")
_TWO = re.compile(r"[^\x00-\x7f]{2}")
_LETTERS = re.compile(r"[A-Za-z]")
_WORD_WITH_DIGIT = re.compile(r"[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*")
_BREAK = re.compile(r"(\n+|(?<=[.:;])[ \t]+)")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
_LOSS = re.compile(LOST + "+")
_BLANK = re.compile(r"[ \t\r\f\v]+")


def passages(text: str) -> list[str]:
    """Lines and sentences of a text; only ASCII characters end them, which no wrong encoding changes."""
    return _BREAK.split(text)[::2]


def normal(passage: str) -> str:
    """A passage with every word holding a digit as ``0`` and single blanks, so that near-twins become equal."""
    return _BLANK.sub(" ", _WORD_WITH_DIGIT.sub("0", passage)).strip(" ")


def skeleton(passage: str) -> str:
    """A passage without its non-ASCII characters."""
    return _RUN.sub("", passage)


@lru_cache(maxsize=None)
def _high(encoding: str) -> str:
    """The characters of bytes 0x80 to 0xff; a byte without one stands for itself."""
    return "".join(c if (c := bytes([b]).decode(encoding, "ignore")) else chr(b) for b in range(128, 256))


@lru_cache(maxsize=None)
def _to_bytes(encoding: str) -> dict[int, int]:
    return {ord(c): b + 128 for b, c in reversed(list(enumerate(_high(encoding))))}


@lru_cache(maxsize=None)
def _to_latin(encoding: str) -> dict[int, int]:
    """Characters of an encoding of single bytes to those of the same bytes in Latin-1; others of Latin-1 to what it can't encode."""
    return {c: 0xFFFF for c in range(128, 256)} | _to_bytes(encoding)


@lru_cache(maxsize=None)
def _characters(encoding: str) -> frozenset[str]:
    """The non-ASCII characters of an encoding of single bytes."""
    return frozenset(map(chr, _to_bytes(encoding)))


def _may_undo(present: frozenset[str], right: str, wrong: str) -> bool:
    """Whether a text with these non-ASCII characters can hold any that came from reading ``right`` as ``wrong``."""
    if wrong in DOUBLE or wrong in WIDE:
        return max(present) >= "\u2000"
    if right in DOUBLE:
        return present <= _characters(wrong)
    return wrong != UTF8 and not present.isdisjoint(_characters(wrong))


@lru_cache(maxsize=None)
def _char_map(right: str, wrong: str) -> dict[int, str]:
    high = _high(right)
    return {c: high[b - 128] for c, b in _to_bytes(wrong).items()}


def _bytes(text: str, encoding: str) -> bytes | None:
    """The bytes that were read as ``text``; None if a character isn't in the encoding."""
    if encoding in DOUBLE:
        try:
            return text.encode(encoding)
        except UnicodeEncodeError:
            return None
    try:
        return text.translate(_to_latin(encoding)).encode("latin-1")
    except UnicodeEncodeError:
        return None


def _mostly(data: bytes, encoding: str) -> str | None:
    """``data`` decoded, if at most a tenth of what comes out is lost."""
    out = data.decode(encoding, "replace")
    return out if out.count(LOST) * 10 <= len(out) else None


def undo(text: str, right: str, wrong: str) -> str:
    """``text`` with what may have been ``right`` but was read as ``wrong`` read as ``right``; unchanged where that fails."""
    if wrong == UTF8:  # the bytes are lost
        return text
    if wrong in WIDE:
        if len(text) < 6 or text.isascii():
            return text
        try:
            new = text.encode(wrong).decode(right)
        except UnicodeError:
            return text
        return text if _CONTROL.search(new) or len(_RUN.sub("", new)) * 2 < len(new) else new
    if wrong in DOUBLE or right in DOUBLE:
        # bytes of a character may be ASCII, so the whole stretch is taken; what was lost on reading stays lost
        out = []
        for part in re.split(f"({LOST}+)", text):
            if not part or part[0] == LOST or part.isascii():
                out.append(part)
                continue
            data = _bytes(part, wrong)
            if data is None:
                return text
            if LOST in text:
                out.append(_LOSS.sub(LOST, data.decode(right, "replace")))
            else:
                whole = _mostly(data, right)
                if whole is None:
                    return text
                out.append(whole)
        new = _LOSS.sub(LOST, "".join(out))
        return new if new.count(LOST) * 3 <= sum(map(len, _RUN.findall(new))) else text
    if right == UTF8:

        def again(m: re.Match) -> str:
            data = _bytes(m[0], wrong)
            try:
                return m[0] if data is None else data.decode(UTF8)
            except UnicodeDecodeError:
                return m[0]

        return _RUN.sub(again, text)
    table = _char_map(right, wrong)

    def mapped(m: re.Match) -> str:
        return m[0].translate(table) if all(ord(c) in table for c in m[0]) else m[0]

    return _RUN.sub(mapped, text)


def misread(text: str, right: str, wrong: str) -> str | None:
    """``text`` as it looks if encoded in ``right`` and read as ``wrong``; None if it can't be encoded."""
    try:
        return text.encode(right).decode(wrong, "replace")
    except UnicodeEncodeError:
        return None


def explain(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The (right, wrong) encodings that turn ``clean`` into ``garbled``, by alignment of their runs of non-ASCII characters."""
    if LOST in garbled:
        if LOST in clean:
            return []
        pattern = _collapse(garbled)
        return [(r, w) for r, w in PAIRS if w == UTF8 and (m := misread(clean, r, w)) is not None and _collapse(m) == pattern]
    ours, theirs = _RUN.findall(garbled), _RUN.findall(clean)
    if len(ours) != len(theirs):
        return []
    at = next((i for i, (x, y) in enumerate(zip(ours, theirs, strict=True)) if x != y), None)
    if at is None:
        return []
    found = [p for p in PAIRS if undo(ours[at], *p) == theirs[at] and undo(garbled, *p) == clean]
    if not found:  # read wrongly twice
        for wrong in SINGLE[:7]:
            once = undo(garbled, UTF8, wrong)
            if once != garbled and undo(once, UTF8, wrong) == clean:
                found.append((UTF8, wrong))
    return found


def sure(garbled: str, clean: str, pairs: Iterable[tuple[str, str]]) -> bool:
    """Whether ``clean`` proves by itself that ``garbled`` was misread, as any but one letter in place of another does: words differ by that too."""
    if any(UTF8 in p or p[0] in DOUBLE for p in pairs):
        return True
    swapped = {(x, y) for x, y in zip(garbled, clean, strict=True) if x != y}
    return len(swapped) > 1 or any(unicodedata.category(c)[0] != "L" for c in min(swapped))


def _collapse(text: str) -> str:
    return _LOSS.sub(LOST, text)


def _telling(text: str) -> bool:
    """Whether a text that lost characters kept as many others that are not ASCII as it has gaps; else too little is left to know it by."""
    return len(_LOSS.findall(text)) + text.count(LOST) <= sum(map(len, _RUN.findall(text)))


def cells(text: str) -> np.ndarray:
    """Cells of the pairs of adjacent characters of which one at least is not ASCII and none lost; ends count as blanks."""
    code = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    a, b = code[:-1], code[1:]
    touched = ((a > 127) | (b > 127)) & (a != 0xFFFD) & (b != 0xFFFD)
    mixed = (a[touched] * np.uint64(0x9E3779B97F4A7C15)) ^ (b[touched] * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - 18)).astype(np.int64)


class Reader:
    """How well a text reads like the corpus: log frequencies of character pairs in a hashed table of fixed size."""

    def __init__(self, counts: np.ndarray):
        self.log = np.log((counts + 0.5) / (counts.sum() + 1.0))

    def score(self, text: str) -> tuple[float, int]:
        """Sum of log frequencies, and number of pairs."""
        at = cells(text)
        return float(self.log[at].sum()), len(at)

    def repair(self, text: str, pairs: Iterable[tuple[str, str]], tried: dict[tuple[tuple[str, str], ...], tuple[str, float]] | None = None) -> tuple[str, float, tuple[tuple[str, str], ...]]:
        """The text that reads best after undoing wrong readings, by how much better in nats a character pair, and the readings undone; (text, 0, ()) if none helps.

        ``tried`` gets every text that undoing a reading once (or twice) gives and that reads better at all, with its gain.
        """
        now, gain, undone = text, 0.0, ()
        scores: dict[str, tuple[float, int]] = {}  # several pairs give the same text

        def score(t: str) -> tuple[float, int]:
            if t not in scores:
                scores[t] = self.score(t)
            return scores[t]

        for turn in range(ROUNDS):
            total, n = score(now)
            if not n:
                break
            best, present = None, frozenset(c for c in set(now) if c > "\x7f" and c != LOST)
            sequences = _TWO.search(now) is not None  # of single bytes that may make up UTF-8
            for pair in pairs:
                if not present or (pair[0] == UTF8 and not sequences and pair[1] in SINGLE) or not _may_undo(present, *pair):
                    continue
                new = undo(now, *pair)
                if new == now:
                    continue
                tries = [(new, (pair,))]
                if pair[0] == UTF8 and (twice := undo(new, *pair)) != new:  # half of a double misreading may be as rare as the whole
                    tries.append((twice, (pair, pair)))
                for new, how in tries:
                    t, k = score(new)
                    mean = (t / k if k else self.log.max()) - total / n
                    if tried is not None and not turn and mean > 0:
                        tried[how] = (new, mean)
                    if pair[0] == UTF8:
                        enough = mean > BETTER - PER_SAVED * abs(len(now) - len(new)) and mean * n > BETTER_IN_ALL and mean > 0
                    else:
                        enough = mean > MAPPED and mean * n > MAPPED_IN_ALL
                    if enough and (best is None or mean > best[0]):
                        best = (mean, new, how)
            if best is None:
                break
            gain, now, undone = gain + best[0], best[1], undone + best[2]
        return now, gain, undone


def choose(explained: Iterable[tuple[tuple[tuple[str, str], ...], int]], least: int = 3) -> list[tuple[str, str]]:
    """The fewest (right, wrong) pairs that explain the garbled passages, given with their numbers: greedily, each explaining ``least`` more."""
    left = sorted(explained)
    chosen = []
    while left:
        votes: Counter = Counter()
        for pairs, n in left:
            for p in pairs:
                votes[p] += n
        best = max(sorted(votes), key=votes.get)
        if votes[best] < least:
            break
        chosen.append(best)
        left = [(p, n) for p, n in left if best not in p]
    return chosen


#: Characters that a skeleton needs to be joined on; a clean twin is this many times as frequent as the garbled one.
SKELETON, TWIN_RATIO = 4, 3
#: What a repair must gain to be made, and its pair to be learned, without a pair learned before, in nats a character pair.
WIDE_GAIN = 2.5
#: Pairs that are tried so whether or not a twin shows them: sequences of UTF-8 and of two bytes hardly arise by chance.
STRONG_PAIRS = WIDE_PAIRS + [(UTF8, w) for w in SINGLE]


#: Wrong encodings by right ones that lose characters, as the wrong encoding has no character for some bytes.
_LOSSY = [w for w in SINGLE if LOST in bytes(range(128, 256)).decode(w, "replace")]
LOSING_PAIRS = {UTF8: DOUBLE + _LOSSY} | {r: _LOSSY[:2] for r in DOUBLE}


def _text_column(b: pa.RecordBatch, name: str) -> list[str | None]:
    return b.column(name).to_pylist()


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, norm): non-ASCII passages of each text, once a text; the passage itself once a batch."""
    for b in batches:
        at, hashes, norms, seen = [], [], [], set()
        for row, text in enumerate(_text_column(b, "text")):
            if text is None or text.isascii():
                continue
            for q in dict.fromkeys(normal(p) for p in passages(text) if not p.isascii()):
                h = _hash(q)
                at.append(row)
                hashes.append(h)
                norms.append(None if h in seen else q)
                seen.add(h)
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array(hashes, pa.int64()), pa.array(norms, pa.string())], names=["id", "h", "norm"])


def _hash(passage: str) -> int:
    return xxhash.xxh3_64_intdigest(passage.encode("utf-8", "replace")) - (1 << 63)


def _lost_cell(h: int) -> int:
    """The cell, after those of character pairs, of the hash of a passage with lost characters."""
    return CELLS + ((h + (1 << 63)) >> (64 - 18))


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n): how often character pairs occur, and from CELLS on the cells of passages with lost characters."""
    counts = np.zeros(2 * CELLS, np.int64)
    for b in batches:
        for q, n in zip(_text_column(b, "norm"), b.column("n").to_pylist(), strict=True):
            np.add.at(counts, cells(q), n)
            if LOST in q and _telling(q):
                counts[_lost_cell(_hash(_collapse(q)))] = 1
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["cell", "n"])


def _explain_twins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = list(zip(_text_column(b, "norm"), _text_column(b, "clean"), strict=True))
        why = [explain(g, c) for g, c in texts]
        keep = [i for i, x in enumerate(why) if x]
        at = pa.array(keep, pa.int64())
        names = pa.array([_names(why[i]) for i in keep], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("h").take(at), b.column("n").take(at), b.column("clean").take(at), names, pa.array([sure(*texts[i], why[i]) for i in keep], pa.bool_())], names=["h", "n", "clean", "why", "sure"])


def _pairs(text: str) -> tuple[tuple[str, str], ...]:
    return tuple(tuple(x.split(">")) for x in text.split(";") if x)


READINGS = "h long, n long, how string, gain double, h2 long, clean string, kind byte"
#: Kinds of readings: a repair that is proof by itself or by a learned pair; a text that may be a passage of the corpus, with or without other than ASCII characters; a passage as it looks when it loses characters; a passage that lost some.
REPAIR, REREAD, PLAIN, LOSING, LOSER = range(5)
#: Bits of the map of hashes by which plain passages are looked for.
PLAIN_BITS = 22


def _readings(shared, least: float, search: bool):
    """Readings of passages (READINGS): repairs by ``pairs`` that gain more than ``least``; with ``search`` also what twins are joined on.

    A misreading that leaves no ASCII in its place can't be joined on the text around it. So the passage is read as it may
    have been meant (REREAD, by its hash), which is then looked for among all passages; and where characters are lost,
    which can't be undone, a passage is misread as it may have been (LOSING) and looked for among those that lost some.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pairs, losers = shared.value
        reader, some_lost = Reader(counts), losers.any()
        for b in batches:
            out: list[tuple] = []
            for h, n, q in zip(b.column("h").to_pylist(), b.column("n").to_pylist(), _text_column(b, "norm"), strict=True):
                tried: dict | None = {} if search else None
                new, gain, how = reader.repair(q, pairs, tried)
                if new != q and gain > least:
                    out.append((h, n, _names(how), gain, None, None, REPAIR))
                if not search:
                    continue
                for how, (text, better) in tried.items():
                    for part in map(normal, passages(text)):
                        if not part.isascii() and LOST not in part:
                            out.append((h, n, _names(how), better, _hash(part), None, REREAD))
                        elif part.isascii() and len(_LETTERS.findall(part)) >= SKELETON:
                            out.append((h, n, _names(how), better, None, part, PLAIN))
                if LOST in q:
                    if _telling(q):
                        out.append((h, n, None, None, _hash(_collapse(q)), None, LOSER))
                    continue
                for right, wrongs in LOSING_PAIRS.items() if some_lost else ():
                    try:
                        data = q.encode(right)
                    except UnicodeEncodeError:
                        continue
                    for wrong in wrongs:
                        seen = data.decode(wrong, "replace")
                        if LOST in seen:
                            key = _hash(_collapse(normal(seen)))
                            if losers[_lost_cell(key) - CELLS] and _telling(seen):
                                out.append((h, n, f"{right}>{wrong}", None, key, q, LOSING))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.int8()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["h", "n", "how", "gain", "h2", "clean", "kind"])

    return run


def _names(how: Iterable[tuple[str, str]]) -> str:
    return ";".join(f"{r}>{w}" for r, w in how)


#: What shows that a passage is garbled, the strongest first: a clean twin joined on its ASCII, a clean twin it is when read rightly, a mapping learned from twins, the reading score alone, lost characters alone.
EVIDENCE = ("twin", "reread", "mapping", "score", "lost")


def _plain_twins(rows: DataFrame, read: DataFrame) -> DataFrame:
    """(h, n, how, gain, clean_n): readings that are ASCII passages of the corpus; these were counted nowhere, so the texts are cut again, in the JVM, and only passages kept whose hash is among those looked for."""
    wanted = read.where(F.col("kind") == PLAIN).select("h", "n", "how", "gain", F.xxhash64("clean").alias("k"))
    if wanted.isEmpty():
        return wanted.select("h", "n", "how", "gain", F.lit(0).cast("long").alias("clean_n"))
    place = F.shiftrightunsigned("k", 64 - PLAIN_BITS).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)))
    words = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))  # at most 2 ** PLAIN_BITS / 64 rows
    parts = rows.select(F.explode(F.split("text", r"\n+|(?<=[.:;])[ \t]+")).alias("p")).where(~F.col("p").rlike(r"[^\x00-\x7f]"))
    same = F.btrim(F.regexp_replace(F.regexp_replace("p", "[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*", "0"), r"[ \t\r\f\x0b]+", " "), F.lit(" "))
    seen = parts.select(F.xxhash64(same).alias("k")).join(F.broadcast(words), F.shiftright(place, 6) == F.col("word")).where(F.getbit("bits", place.bitwiseAND(F.lit(63))) == 1)
    return wanted.join(seen.groupBy("k").agg(F.count(F.lit(1)).alias("clean_n")), "k").drop("k")


class Garbled:
    """What is known of a corpus: ``where`` (id, h), ``verdicts`` (h, evidence, how, clean) and the learned ``pairs``."""

    def __init__(self, where: DataFrame, verdicts: DataFrame, pairs: list[tuple[str, str]]):
        self.where, self.verdicts, self.pairs = where, verdicts, pairs


def learn_garbled(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> Garbled:
    """Passages decoded in a wrong character encoding, found by clean near-twins and by what these teach.

    Method: texts are cut into passages at ASCII characters, words with digits made equal; equal passages are counted
    once. Passages join others on their text without non-ASCII characters (or, where no letters are left, on the places
    of these); the most frequent of them is taken for clean if it is TWIN_RATIO times as frequent. Aligning the runs of
    non-ASCII characters of both gives the encodings (right, wrong) that explain the difference. Misreadings that change
    the ASCII too (two-byte encodings, UTF-16) join their twin on what it reads as instead: a passage read anew by one of
    STRONG_PAIRS, or by a pair that any twin shows, which then is another passage of the corpus, so frequent or reading
    better by WIDE_GAIN; and a passage that lost characters is another one misread. The fewest pairs that explain the
    twins are learned, and undone in all passages without a twin where the text reads better afterwards, measured by the
    frequencies of character pairs over all documents, kept in a hashed table of CELLS cells whatever the size of the
    corpus. A twin is proof by itself (:func:`sure`), however often its pair occurs. Without any twin, a repair that
    gains WIDE_GAIN by one of these pairs is taken, and its pair learned. A passage with U+FFFD lost characters on
    reading. ``verdicts.evidence`` numbers which of these showed a passage (EVIDENCE).
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    kind = documents.schema[doc_id].dataType.simpleString()
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    found = rows.mapInArrow(_explode, f"id {kind}, h long, norm string").checkpoint()
    where = found.select("id", "h")
    distinct = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).repartition(python_partitions(spark), "h").checkpoint()

    table = distinct.mapInArrow(_count_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * CELLS rows
    counts = np.zeros(2 * CELLS, np.int64)
    counts[table["cell"].to_numpy()] = table["n"].to_numpy()
    counts, losers = counts[:CELLS], counts[CELLS:] > 0

    plain = F.regexp_replace("norm", r"[^\x00-\x7f]+", "")
    letters = F.length(F.regexp_replace(plain, r"[^A-Za-z]+", ""))
    shape = F.regexp_replace("norm", r"[^\x00-\x7f]", "\u00a4")
    key = F.when(letters >= SKELETON, F.xxhash64(F.lit("s"), plain)).when(F.length(F.regexp_replace(plain, r"\s+", "")) >= SKELETON, F.xxhash64(F.lit("p"), shape)).otherwise(F.xxhash64(F.lit("m"), shape))
    keyed = distinct.where(F.length("norm") - F.length(plain) > 0).select(key.alias("key"), "h", "n", "norm")
    clean = keyed.groupBy("key").agg(F.max(F.struct("n", F.col("norm").alias("clean"))).alias("best"), F.count(F.lit(1)).alias("all")).where("all > 1").select("key", "best.*").withColumnRenamed("n", "clean_n")
    twins = keyed.join(clean, "key").where((F.col("clean_n") >= TWIN_RATIO * F.col("n")) & (F.col("norm") != F.col("clean"))).select("h", "n", "norm", "clean").mapInArrow(_explain_twins, "h long, n long, clean string, why string, sure boolean").checkpoint()
    votes = [(_pairs(r["why"]), r["votes"]) for r in twins.groupBy("why").agg(F.sum("n").alias("votes")).collect()]  # sets of PAIRS, a few hundred

    rare = sorted({p for why, _ in votes for p in why} - set(STRONG_PAIRS))
    strong = spark.sparkContext.broadcast((counts, STRONG_PAIRS + rare, losers))  # at most PAIRS and WIDE_PAIRS
    read = distinct.mapInArrow(_readings(strong, WIDE_GAIN, True), READINGS).checkpoint()
    proven = read.where(F.col("kind") == REPAIR).select("h", "n", "how", "gain")
    right = distinct.select(F.col("h").alias("h2"), F.col("n").alias("clean_n"))
    reread = read.where(F.col("kind") == REREAD).join(right, "h2").select("h", "n", "how", "gain", "clean_n").unionByName(_plain_twins(rows, read)).where((F.col("clean_n") >= TWIN_RATIO * F.col("n")) | (F.col("gain") > WIDE_GAIN)).select("h", "n", "how", "gain", F.lit(None).cast("string").alias("clean")).distinct()
    losers_of = read.where(F.col("kind") == LOSER).select(F.col("h").alias("loser"), F.col("n").alias("loser_n"), "h2")
    losing = read.where(F.col("kind") == LOSING).join(losers_of, "h2").groupBy("loser").agg(F.max("loser_n").alias("n"), F.max_by(F.struct("how", "clean"), F.struct("n", "clean")).alias("b"))
    reread = reread.unionByName(losing.select(F.col("loser").alias("h"), "n", "b.how", F.lit(None).cast("double").alias("gain"), "b.clean")).checkpoint()
    # the pairs that a passage can be read by, a few
    ways = reread.groupBy("h").agg(F.max("n").alias("n"), F.array_join(F.array_sort(F.collect_set(F.substring_index("how", ";", 1))), ";").alias("why"))
    votes += [(_pairs(r["why"]), r["votes"]) for r in ways.groupBy("why").agg(F.sum("n").alias("votes")).collect()]  # sets of pairs, as above
    taught = choose(votes)
    scored = proven.groupBy(F.substring_index("how", ";", 1).alias("why")).agg(F.sum("n").alias("votes")).collect()
    pairs = taught + [p for p in choose((_pairs(r["why"]), r["votes"]) for r in scored) if p not in taught]

    names = F.array(*(F.lit(f"{r}>{w}") for r, w in taught)).cast("array<string>")
    known = twins.where(F.col("sure") | F.arrays_overlap(F.split("why", ";"), names))
    # a passage with a twin of its own need not be read by what was learned; one that was misread twice may still be read better than by a twin that was misread once
    shared = spark.sparkContext.broadcast((counts, pairs, losers))
    rest = distinct.join(known.select("h").unionByName(proven.select("h")).distinct(), "h", "left_anti")
    undone = rest.repartition(python_partitions(spark)).mapInArrow(_readings(shared, 0.0, False), READINGS).select("h", "n", "how", "gain").unionByName(proven)
    none = F.lit(None).cast("string")
    mapped = F.when(F.size(F.array_except(F.split("how", ";"), names)) == 0, 2).otherwise(3)
    every = undone.select("h", mapped.alias("evidence"), "gain", "how", none.alias("clean"))
    every = every.unionByName(known.select("h", F.lit(0).alias("evidence"), F.lit(None).cast("double").alias("gain"), none.alias("how"), "clean"))
    every = every.unionByName(reread.select("h", F.lit(1).alias("evidence"), "gain", F.when(F.col("clean").isNull(), F.col("how")).alias("how"), "clean"))
    every = every.unionByName(distinct.where(F.contains("norm", F.lit(LOST))).select("h", F.lit(4).alias("evidence"), F.lit(None).cast("double").alias("gain"), none.alias("how"), none.alias("clean")))
    best = F.max(F.when(F.col("how").isNotNull(), F.struct("gain", "how")))
    verdicts = every.groupBy("h").agg(F.min("evidence").alias("evidence"), best.getField("how").alias("how"), F.min(F.when(F.col("clean").isNotNull(), F.struct("evidence", "clean"))).getField("clean").alias("clean")).checkpoint()
    return Garbled(where, verdicts, pairs)


def garbled_evidence(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(evidence, n_documents): garbled documents by the strongest evidence any of their passages has; see EVIDENCE and :func:`learn_garbled`."""
    g = learn_garbled(documents, doc_id=doc_id, text=text)
    each = g.where.join(g.verdicts.select("h", "evidence"), "h").groupBy("id").agg(F.min("evidence").alias("e"))
    return each.groupBy(F.element_at(F.array(*map(F.lit, EVIDENCE)), F.col("e") + 1).alias("evidence")).agg(F.count(F.lit(1)).alias("n_documents"))


def garbled_documents(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id): every document with a passage decoded in a wrong character encoding, once; see :func:`learn_garbled`.

    Defined cases: null, empty and ASCII texts are never garbled; a null id is given like any other; a repeated id is
    given once; other columns are ignored; an empty table gives no rows.
    """
    g = learn_garbled(documents, doc_id=doc_id, text=text)
    return g.where.join(g.verdicts.select("h"), "h", "left_semi").select(F.col("id").alias(doc_id)).distinct()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, pos, piece, h): a text in pieces that make it up again; ASCII pieces have no hash."""
    for b in batches:
        at, pos, pieces, hashes = [], [], [], []
        for row, text in enumerate(_text_column(b, "text")):
            for k, p in enumerate(_BREAK.split(text)):
                at.append(row)
                pos.append(k)
                pieces.append(p)
                hashes.append(None if p.isascii() else _hash(normal(p)))
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(pieces, pa.string()), pa.array(hashes, pa.int64())], names=["id", "pos", "piece", "h"])


def refill(piece: str, clean: str) -> str:
    """``piece`` with the runs of non-ASCII characters of its clean twin, or the twin with the words with digits of ``piece``; unchanged if neither matches in number."""
    runs = _RUN.findall(clean)
    if skeleton(normal(piece)) != skeleton(clean) or len(_RUN.findall(piece)) != len(runs):  # ASCII characters were misread too
        words = _WORD_WITH_DIGIT.findall(piece)
        if len(_WORD_WITH_DIGIT.findall(clean)) != len(words):
            return piece
        put, bare = iter(words), piece.strip(" ")
        return piece[: len(piece) - len(piece.lstrip(" "))] + _WORD_WITH_DIGIT.sub(lambda m: next(put), clean) + (piece[len(piece.rstrip(" ")) :] if bare else "")
    left = iter(runs)
    return _RUN.sub(lambda m: next(left), piece)


@F.arrow_udf(T.StringType())
def _restore(piece: pa.Array, how: pa.Array, clean: pa.Array) -> pa.Array:
    out = []
    for p, h, c in zip(piece.to_pylist(), how.to_pylist(), clean.to_pylist(), strict=True):
        if c is not None:
            p = refill(p, c)
        elif h is not None:
            for right, wrong in _pairs(h):
                p = undo(p, right, wrong)
        out.append(p)
    return pa.array(out, pa.string())


def restored_documents(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, whole): garbled documents with their original text where it can be recovered; ``whole`` says whether no character is lost.

    A passage gets the non-ASCII characters of its clean twin, or has the misreadings undone that :func:`learn_garbled`
    found in it; anything else stays as it is. ``doc_id`` must be unique. Cases as in :func:`garbled_documents`.
    """
    g = learn_garbled(documents, doc_id=doc_id, text=text)
    kind = documents.schema[doc_id].dataType.simpleString()
    ids = g.where.join(g.verdicts.select("h"), "h", "left_semi").select("id").distinct()
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null").join(ids, "id", "left_semi")
    pieces = rows.mapInArrow(_pieces, f"id {kind}, pos int, piece string, h long").join(g.verdicts, "h", "left")
    mended = pieces.withColumn("piece", F.coalesce(_restore(F.when(F.expr("how is not null or clean is not null"), F.col("piece")), "how", "clean"), "piece"))
    # the pieces of one text
    joined = mended.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("parts"))
    whole = F.array_join(F.col("parts.piece"), "")
    return joined.select(F.col("id").alias(doc_id), whole.alias("text"), (~F.contains(whole, F.lit(LOST))).alias("whole"))
