"""Evaluation texts leaking into training text.

Method: template canonicalisation. Items and documents are folded to blank-free skeletons in which
letters that recognition confuses are one letter. In the template numbers, names and units are typed
placeholders, found on both sides by the same marks (digits; a capital within a sentence; the word
after a number). Windows of ``WINDOW`` letters of the plain and the template skeletons are hash-joined,
items against documents. At each hit the item's words are followed through the document in both
directions, which tells how many consecutive words it holds. A slot that is filled otherwise binds its
kind and value to that filling: a value needs one filling wherever it recurs, else the refill is
inconsistent and reported as such. With the same numbers, names and units the item leaked; with
others, consistently, the question was re-parameterised.

Cue numbers and times, markup, sound descriptions and speakers' names are taken out first, whatever
their length. What is taken out is searched as well, as a text of its own, and documents with adverts
or names are followed both with and without them, so nothing is lost to a wrong guess.

Scale: the corpus is read once, whatever the number of items. Each document's windows are tried
against a Bloom filter of all items' windows, the only thing that is broadcast (at most ``MOST_BITS``
bits, whatever the items), and only documents with hits are written. Those are joined with the items
in blocks of ``BLOCK_CHARS`` letters: the rows of a block are spread over all tasks by the document,
each task gets the block's items first and then streams its documents past them. With several blocks
a document goes to those that share a window with it. The driver sees counts and the filter.

Defined results: null and empty texts hold nothing; items of fewer than ``MIN_WORDS`` words are never
found; items with equal text each get a row, a repeated item none; a document gets one row per item
however often it holds it; equal documents each get rows; documents or items without id are ignored;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, shuffle_partitions
from .subtitles import CUE, FOLD, is_advert, may_advertise, parts, repair

WINDOW = 12
MIN_WORDS = 12
#: Letters of items that a task holds at a time.
BLOCK_CHARS = 500_000
#: Bits of the filter for each window, at most, and hash functions.
BITS_EACH, MOST_BITS, HASHES = 64, 1 << 28, 8
SCHEMA = "doc_id bigint, text_id bigint, n_words int, n_template_words int, consistent boolean"

# ---------------------------------------------------------------- skeletons

#: Groups of letters and digits that recognition takes for each other.
_PAIRS = ((b"rn", b"m"), (b"vv", b"w"), (b"li", b"h"), (b"cl", b"d"))
#: Fixed value: a pair that becomes one letter when letters are already one per group.
_LATER = (b"ii", b"u")
_ALIKE = bytes.maketrans(b"aceo0il1tfjqg9s5b8", b"ooooo" + b"iiiiii" + b"ggg" + b"ss" + b"bb")
#: Marks in front of names, numbers and units; in a template they stand for them.
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
_MARKS = b"\x01\x02\x03"
_LOWER = bytes(c if chr(c).isascii() and (chr(c).islower() or chr(c).isdigit() or c in _MARKS) else ord(chr(c).lower()) if c < 128 and chr(c).isupper() else 32 for c in range(256))
_WIDE = re.compile(r"[^\x00-\x7f]+")
_MARKED = re.compile(rb"([\x01-\x03])[^ ]*")
_IS_NAME = re.compile(r" (?<=[\w,] )(?=[A-ZÀ-Þ][a-zß-ž]{2})")
_IS_NUMBER = re.compile(r" (?=[0-9][0-9.,]*(?!\w))")
_IS_UNIT = re.compile(r"\x02[0-9.,]+ (?=[^\W\d_]{3})")
_SEPARATOR = re.compile(r"[.,](?<=[0-9].)(?=[0-9]{3}(?![0-9]))")


def mark(text: str) -> str:
    """The text in one line, with marks in front of what fills a slot."""
    line = " " + " ".join(text.split())  # cue marks count as white space
    out = _IS_NUMBER.sub(" " + NUMBER, _IS_NAME.sub(" " + NAME, line))
    return _IS_UNIT.sub(r"\g<0>" + UNIT, _SEPARATOR.sub("", out)) if NUMBER in out else out


def _one_byte() -> tuple[bytes, bytes, list[tuple[bytes, bytes]]]:
    """What ``FOLD`` makes of Latin-1: a table, the characters that vanish, and those that become two letters."""
    table, gone, two = bytearray(_LOWER), bytearray(b"'`"), []
    for c in range(128, 256):
        to = FOLD[c]
        if len(to) == 1:
            table[c] = ord(to)
        elif to:
            two.append((bytes([c]), to.encode()))
        else:
            gone.append(c)
    return bytes(table), bytes(gone), two


_LATIN, _GONE, _TWO = _one_byte()
#: The punctuation beyond Latin-1 that subtitles are full of.
_QUOTES, _BLANKS = "‘’", "“”–—…♪"


def plain_letters(marked: str) -> bytes:
    """Lower-case unaccented letters, digits, marks and blanks."""
    if marked.isascii():
        return marked.encode().translate(_LOWER, b"'`")
    for c in _QUOTES:
        marked = marked.replace(c, "")
    for c in _BLANKS:
        marked = marked.replace(c, " ")
    try:
        b = marked.encode("latin-1")
    except UnicodeEncodeError:
        return _WIDE.sub(lambda m: m[0].translate(FOLD), marked).encode("ascii", "ignore").translate(_LOWER, b"'`")
    for one, letters in _TWO:
        b = b.replace(one, letters)
    return b.translate(_LATIN, _GONE)


def skeleton(letters: bytes) -> bytes:
    for pair, single in _PAIRS:
        letters = letters.replace(pair, single)
    return letters.translate(_ALIKE).replace(*_LATER)


def streams(marked_skeleton: bytes) -> tuple[bytes, bytes]:
    """The plain and the template text without blanks."""
    return marked_skeleton.translate(None, b" " + _MARKS), _MARKED.sub(rb"\1", marked_skeleton).translate(None, b" ")


def hashes(stream: bytes) -> np.ndarray:
    """A 64-bit hash of the window at every offset."""
    x = np.frombuffer(stream, np.uint8).astype(np.uint64)
    if len(x) < WINDOW:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        two = x[:-1] * base + x[1:]
        four = two[:-2] * (base * base) + two[2:]
        eight = four[:-4] * (base**4) + four[4:]
        h = eight[:-4] * (base**4) + four[8:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


# ---------------------------------------------------------------- the filter


def filter_bits(n: int) -> int:
    """Bits for ``n`` windows: a power of two."""
    return min(MOST_BITS, 1 << max(16, math.ceil(math.log2(max(1, n) * BITS_EACH))))


def _bits_of(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (h >> np.uint64(40)) | np.uint64(1)
    for i in range(HASHES):
        yield (h + np.uint64(i) * step) & np.uint64(bits - 1)


def _words_of(rows: Iterator[np.ndarray], bits: int) -> np.ndarray:
    words = np.zeros(bits // 64, np.uint64)
    for h in rows:
        for at in _bits_of(h, bits):
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return words


def may_hold(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices of the hashes that may be in the filter."""
    bits, left = len(words) * 64, np.arange(len(h))
    for i in range(HASHES):
        now = h[left]
        at = (now + np.uint64(i) * ((now >> np.uint64(40)) | np.uint64(1))) & np.uint64(bits - 1)
        left = left[((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)]
        if not len(left):
            break
    return left


def build_filter(windows: DataFrame, n: int) -> np.ndarray:
    """The filter of the column ``h``: a part per task, united in one."""
    bits = filter_bits(n)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words_of((b.column(0).to_numpy().view(np.uint64) for b in batches), bits)
        yield pa.RecordBatch.from_arrays([pa.array([words.tobytes()], pa.binary())], names=["words"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)
        for b in batches:
            for x in b.column(0):
                words |= np.frombuffer(x.as_py(), np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([words.tobytes()], pa.binary())], names=["words"])

    return np.frombuffer(windows.select("h").mapInArrow(part, "words binary").repartition(1).mapInArrow(unite, "words binary").first()[0], np.uint64)


def search_streams(text: str) -> list[bytes]:
    """What the windows of a document are taken from."""
    speech, aside = parts(text)
    texts = [speech]
    if may_advertise(speech):
        cues = speech.split(CUE)
        kept = [c for c in cues if not is_advert(c)]
        if len(kept) < len(cues):
            texts.append(" ".join(kept))
    if aside:
        texts.append(aside)
    return [s for t in texts for s in streams(skeleton(plain_letters(mark(t))))]


def _picker(words: np.ndarray, keep_hashes: bool):
    """Documents with windows that may be an item's, with those windows' hashes."""

    def chunk(docs: list[int], joined: list[bytes]) -> dict[int, np.ndarray]:
        h = hashes(b"\0".join(joined))
        hit = may_hold(words, h)
        ends = np.cumsum([len(x) + 1 for x in joined])
        where = np.searchsorted(ends, hit, side="right")
        out: dict[int, np.ndarray] = {}
        for doc in np.unique(where):
            out[docs[doc]] = np.unique(h[hit[where == doc]]) if keep_hashes else np.empty(0, np.uint64)
        return out

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, np.ndarray] = {}
            docs: list[int] = []
            joined: list[bytes] = []
            size = 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                docs.append(i)
                joined.append(b"\0".join(search_streams(text)))
                size += len(joined[-1])
                if size > 1 << 17:
                    found |= chunk(docs, joined)
                    docs, joined, size = [], [], 0
            if docs:
                found |= chunk(docs, joined)
            rows = sorted(found)
            kept = batch.take(pa.array(rows, pa.int64()))
            hs = pa.array([found[i].view(np.int64) for i in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), hs], names=["doc_id", "text", "hashes"])

    return pick


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, h`` of every window of the items' plain and template texts."""
    for batch in batches:
        blocks, out = [], []
        for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            marked = skeleton(plain_letters(mark(repair(text))))
            if len(marked.split()) >= MIN_WORDS:
                h = np.unique(np.concatenate([hashes(s) for s in streams(marked)]))
                blocks.append(np.full(len(h), block, np.int32))
                out.append(h.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(blocks) if blocks else [], pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int64())], names=["block", "h"]
        )


# ---------------------------------------------------------------- following an item through a document


@lru_cache(maxsize=1 << 15)
def _masks(word: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(word):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


@lru_cache(maxsize=1 << 16)
def prefix_distances(word: str, text: str) -> tuple[int, ...]:
    """Edit distances of ``word`` to every prefix of ``text``, the empty one first (bit-parallel)."""
    masks, size = _masks(word), len(word)
    full, high = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    out = [score]
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        more, less = down | (~(horizontal | up) & full), up & horizontal
        if more & high:
            score += 1
        elif less & high:
            score -= 1
        out.append(score)
        more, less = (more << 1) | 1, less << 1
        up, down = (less | ~(vertical | more)) & full, more & vertical & full
    return tuple(out)


class Tokens:
    """A text's words: skeletons, plain spelling, the mark of each (or none), and the streams."""

    __slots__ = ("caseless", "flat", "marks", "raw", "starts", "template", "words")

    def __init__(self, text: str):
        letters = plain_letters(mark(text))
        tokens = skeleton(letters).decode("ascii").split()
        self.marks = [t[0] if t[0] < " " else "" for t in tokens]
        self.words = [t.lstrip(NAME + NUMBER + UNIT) for t in tokens]
        self.raw = [t.lstrip(NAME + NUMBER + UNIT) for t in letters.decode("ascii").split()]
        self.flat = "".join(self.words)
        self.template = [m or w for m, w in zip(self.marks, self.words, strict=True)]
        self.starts, at = [], 0
        for w in self.words:
            self.starts.append(at)
            at += len(w)
        names = self.marks.count(NAME)
        #: Capitals tell nothing where there are none or nearly all words have them.
        self.caseless = not names or 2 * names > len(tokens)


class Document(Tokens):
    __slots__ = ("index",)

    def __init__(self, text: str):
        super().__init__(text)
        self.index = {at: i for i, at in enumerate(self.starts)}
        self.index[len(self.flat)] = len(self.words)


def readings(text: str) -> list[str]:
    """The texts in which runs are looked for: speech without adverts; the same with them and with names, if there are any; what was taken out."""
    named, _ = parts(text, names=False)
    speech, aside = parts(text)
    cues = speech.split(CUE)
    kept = [c for c in cues if not is_advert(c)] if may_advertise(speech) else cues
    out = [" ".join(kept)]
    if len(kept) < len(cues) or len(named) > len(speech):
        out.append(named)
    if aside.count(" ") + aside.count("\n") + aside.count(CUE) >= MIN_WORDS - 1:
        out.append(aside)
    return out


def _agree(a: str, b: str) -> bool:
    return a == b or min(len(a), len(b)) >= 4 and prefix_distances(a, b)[-1] <= 1


#: Own word or otherwise filled slot; the word's number; where in the document it begins and ends; errors.
Flag = tuple[bool, int, int, int, int]


class Index:
    """Items to follow."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids: list[int] = []
        self.items: list[Tokens] = []
        self.windows: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        for item, text in items:
            t = Tokens(repair(text))
            if len(t.words) < MIN_WORDS:
                continue
            n = len(self.ids)
            self.ids.append(item)
            self.items.append(t)
            for units, templates in ((t.words, False), (t.template, True)):
                stream, start = "".join(units), 0
                for k, p in enumerate(units):
                    # a window may begin inside a word, since blanks get lost; it is followed from the next word
                    for off in range(len(p)):
                        w = stream[start + off : start + off + WINDOW]
                        if len(w) == WINDOW and (not templates or not w.isalnum()):
                            self.windows[w].append((n, k, 0) if off == 0 else (n, k + 1, len(p) - off))
                    start += len(p)
        self.windows = dict(self.windows)

    def hits(self, text: str) -> Iterator[tuple[int, int, int, bool]]:
        """``item, n_words, n_template_words, consistent`` for every item of which the document holds a long enough run."""
        best: dict[int, tuple[int, tuple[bool, int]]] = {}
        for reading in readings(text):
            for n, own, alike in self._runs(Document(reading)):
                a, b = best.get(n, (0, (False, 0)))
                best[n] = max(a, own), max(b, alike)
        for n, (run, (consistent, alike)) in best.items():
            if run >= MIN_WORDS or alike >= MIN_WORDS:
                yield self.ids[n], run, max(run, alike), consistent or run >= alike

    def _runs(self, doc: Document) -> Iterator[tuple[int, int, tuple[bool, int]]]:
        template, windows, seen = "".join(doc.template), self.windows, set()
        pos = 0
        for i, p in enumerate(doc.template):
            at = doc.starts[i]
            w = doc.flat[at : at + WINDOW]
            found = windows.get(w, ())
            other = template[pos : pos + WINDOW]
            if other != w:
                found = [*found, *windows.get(other, ())]
            pos += len(p)
            for n, k, ahead in found:
                if (n, k, at + ahead) not in seen:
                    flags = self._walk(n, k - 1, at + ahead, doc, -1, seen)[::-1] + self._walk(n, k, at + ahead, doc, 1, seen)
                    if len(flags) >= MIN_WORDS:
                        yield n, self._own(n, flags, doc), self._alike(n, flags, doc)

    def _firm(self, n: int, flag: Flag, end: int, doc: Document) -> bool:
        """Whether a match can stand at that end of a run: chance makes short words, and parts of longer ones, agree there."""
        own, k, a, _, errors = flag
        size = len(self.items[n].words[k])
        if not own or errors > size // 6:
            return False
        if not errors and size >= 8:
            return True
        return end in doc.index and (size > 3 or doc.raw[min(doc.index.get(a, 0), len(doc.raw) - 1)] == self.items[n].raw[k])

    def _trimmed(self, n: int, flags: list[Flag], doc: Document) -> list[Flag]:
        """Without what isn't firm at either end."""
        a, b = 0, len(flags)
        while a < b and not self._firm(n, flags[a], flags[a][2], doc):
            a += 1
        while b > a and not self._firm(n, flags[b - 1], flags[b - 1][3], doc):
            b -= 1
        return flags[a:b]

    def _own(self, n: int, flags: list[Flag], doc: Document) -> int:
        longest, start = 0, 0
        for i in range(len(flags) + 1):
            if i == len(flags) or not flags[i][0]:
                if i - start > longest:
                    longest = max(longest, len(self._trimmed(n, flags[start:i], doc)))
                start = i + 1
        return longest

    def _alike(self, n: int, flags: list[Flag], doc: Document) -> tuple[bool, int]:
        """Whether every slot value has one filling, and the run's length."""
        item, run, fillings = self.items[n], self._trimmed(n, flags, doc), {}
        consistent = True
        for own, k, a, b, _ in run:
            if item.marks[k]:
                filling = item.words[k] if own else doc.flat[a:b]
                consistent &= _agree(fillings.setdefault((item.marks[k], item.words[k]), filling), filling)
        return consistent and len(run) >= MIN_WORDS, len(run)

    def _walk(self, n: int, k: int, at: int, doc: Document, step: int, seen: set) -> list[Flag]:
        """Flags of item ``n``'s words from ``k`` on, in the direction of ``step``, through the document from ``at``."""
        item, flags = self.items[n], []
        words, marks, flat = item.words, item.marks, doc.flat
        while 0 <= k < len(words):
            w = words[k]
            size = len(w)
            if step > 0:
                exact, to = flat.startswith(w, at), at + size
            else:
                to = at - size
                exact = to >= 0 and flat.startswith(w, to)
            kind = marks[k]
            if exact and kind == NUMBER and to not in doc.index:  # the beginning or end of another number
                exact = not doc.raw[bisect.bisect_right(doc.starts, min(at, to)) - 1].isdigit()
            own, errors = True, 0
            if not exact:
                found = None if kind == NUMBER else self._inexact(words, marks, k, at, flat, step)
                if found is not None:
                    to, errors = found
                elif kind and (filled := self._filling(item, k, at, doc, step)) is not None:
                    own, to = False, filled
                else:
                    break
            if step > 0:
                flags.append((own, k, at, to, errors))
                seen.add((n, k, at))
            else:
                flags.append((own, k, to, at, errors))
                seen.add((n, k, to))
            at = to
            k += step
        return flags

    @staticmethod
    def _filling(item: Tokens, k: int, at: int, doc: Document, step: int) -> int | None:
        """Where the document's words that fill slot ``k`` otherwise end (or begin)."""
        kind, i = item.marks[k], doc.index.get(at)
        if i is None:
            return None
        i = i if step > 0 else i - 1

        def fits(i: int) -> bool:
            if not 0 <= i < len(doc.words):
                return False
            if kind == NUMBER:
                return doc.raw[i].isdigit()
            if kind == UNIT:
                return doc.marks[i] == UNIT or i > 0 and any(c.isdigit() for c in doc.raw[i - 1])
            return doc.marks[i] == NAME or doc.caseless and not doc.raw[i].isdigit()

        if not fits(i):
            return None
        after = item.words[k + step] if 0 <= k + step < len(item.words) else ""
        while kind == NAME and doc.marks[i] == NAME:  # names of several words
            to = doc.starts[i] + len(doc.words[i]) if step > 0 else doc.starts[i]
            more = i + step
            if not after or not (0 <= more < len(doc.words)) or doc.marks[more] != NAME or (doc.flat.startswith(after, to) if step > 0 else doc.flat.endswith(after, 0, to)):
                break
            i = more
        return doc.starts[i] + len(doc.words[i]) if step > 0 else doc.starts[i]

    @staticmethod
    def _inexact(words: list[str], marks: list[str], k: int, at: int, flat: str, step: int) -> tuple[int, int] | None:
        """Where word ``k`` ends (or begins), read with a few errors, and how many; the word after it has a say."""
        w = words[k]
        size = len(w)
        # names differ in few letters from other names
        most = max(1, size // 4) if marks[k] == NAME else 1 if size <= 5 else 2 if size <= 8 else 3
        if step > 0:
            mine, text = w, flat[at : at + size + most]
        else:
            mine, text = w[::-1], flat[max(0, at - size - most) : at][::-1]
        distances = prefix_distances(mine, text)
        if min(distances) > most:
            return None
        after = words[k + step] if 0 <= k + step < len(words) else ""
        choice = None
        for length in range(max(1, size - most), len(distances)):
            d = distances[length]
            if d > most:
                continue
            to, later = at + step * length, 0
            if after:
                if step > 0:
                    later = 0 if flat.startswith(after, to) else min(3, prefix_distances(after, flat[to : to + len(after)])[-1])
                else:
                    head = flat[max(0, to - len(after)) : to]
                    later = 0 if head == after else min(3, prefix_distances(after[::-1], head[::-1])[-1])
            if size <= 2 and later:
                continue
            rank = (d + later, d, abs(length - size))
            if choice is None or rank < choice[0]:
                choice = (rank, to, d)
        return choice and choice[1:]


# ---------------------------------------------------------------- over tables


def _follower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, the block's items before its documents."""
    block, items, index = None, [], None
    for batch in batches:
        out: list[tuple] = []
        for b, is_doc, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != block:
                block, items, index = b, [], None
            if not is_doc:
                items.append((key, text))
                continue
            if index is None:
                index = Index(items)
            out += [(key, *hit) for hit in index.hits(text)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))],
            names=["doc_id", "text_id", "n_words", "n_template_words", "consistent"],
        )


def leaked_items(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, n_words, n_template_words, consistent`` of documents that hold a run of at least ``MIN_WORDS`` words.

    ``n_words``: the longest run of the item's own words; ``n_template_words``: the same with any
    filling of the slots. Rows whose ``n_words`` is lower than ``MIN_WORDS`` are re-parameterised if
    ``consistent``, that is if every slot value has one filling.
    """
    n = shuffle_partitions(documents.sparkSession)
    docs = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")
    wanted = items.where(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).select("item_id", "item_text").distinct()
    chars = wanted.agg(F.coalesce(F.sum(F.length("item_text") + 50), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / block_chars))
    texts = materialize(wanted.groupBy("item_text").agg(F.min("item_id").alias("text_id")).withColumn("block", F.pmod(F.xxhash64("item_text"), F.lit(blocks)).cast("int")))
    windows = materialize(texts.select("block", "item_text").mapInArrow(_item_windows, "block int, h bigint").distinct())
    held = build_filter(windows, windows.count())
    picked = materialize(docs.mapInArrow(_picker(held, blocks > 1), "doc_id bigint, text string, hashes array<bigint>"))
    row = F.xxhash64("doc_id", "text")
    if blocks > 1:  # with one block there is nothing to choose
        keyed = picked.withColumn("row", row)
        to = keyed.select("row", F.explode("hashes").alias("h")).distinct().join(windows, "h").select("row", "block").distinct()
        sent = keyed.join(to, "row").select("block", "doc_id", "text", "row")
    else:
        sent = picked.select(F.lit(0).alias("block"), "doc_id", "text", row.alias("row"))
    place = F.pmod(F.col("row") + F.col("block"), F.lit(n)).cast("int")
    doc_rows = sent.select("block", F.lit(True).alias("is_doc"), F.col("doc_id").alias("key"), "text", place.alias("place"))
    item_rows = texts.select("block", F.lit(False).alias("is_doc"), F.col("text_id").alias("key"), F.col("item_text").alias("text"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place"))
    spread = item_rows.unionByName(doc_rows).repartitionById(n, F.col("place")).sortWithinPartitions("block", "is_doc").drop("place")
    found = spread.mapInArrow(_follower, SCHEMA)
    ids = wanted.join(texts, "item_text").select("text_id", "item_id")
    return found.join(ids, "text_id").select("doc_id", "item_id", "n_words", "n_template_words", "consistent")
